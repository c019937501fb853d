"""docmill: document analytics as Spark DataFrames.

Documents are rows; every operator takes DataFrames or Columns and returns
DataFrames or Columns, so Catalyst plans the whole job.
"""
