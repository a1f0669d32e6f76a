"""Every operator as a query over the given tables, each with its SQL twin."""

from bitext_engine.workload import alignment, glossaries, library, passes, runs, streams, structures, terms, texts  # noqa: F401
from bitext_engine.workload.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
