"""The registered queries, each with the SQL that must give the same rows."""

from workload import extraction, ingest, reports, summaries, vectors  # noqa: F401
from workload.registry import ORACLES, QUERIES  # noqa: F401
