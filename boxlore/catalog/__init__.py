"""All registered queries."""

from boxlore.catalog import anomaly_queries, field_queries, ingest_queries, model_queries, report_queries, store_queries, stream_queries
from boxlore.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "anomaly_queries", "field_queries", "ingest_queries", "model_queries", "report_queries",
           "store_queries", "stream_queries"]
