"""Column builders: scalar functions that stay inside the JVM."""
