"""All named queries of the engine with their SQL twins."""

from foliant.plans import detail_queries, ledger_queries, quality_queries, record_queries, stage_queries, text_queries  # noqa: F401  (they register)
from foliant.plans.text_queries import ORACLE_SQL, QUERIES
from foliant.streaming import service_queries, stream_queries  # noqa: F401

__all__ = ["ORACLE_SQL", "QUERIES"]
