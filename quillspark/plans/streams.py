"""Queries that run as streams over what a folder holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import ingest as G
from . import ingest as PI

QUERIES = {
    "stm_status_counts": lambda s, f: G.drained(G.status_counts(G.table_stream(s, f, "status_log")), "status", "day", "status"),
    "stm_arrived_units": lambda s, f: G.arrived_units(s, f).select("document_id", "source_type").groupBy("source_type").agg(F.count("*").alias("units")),
}
ORACLE = {
    "stm_status_counts": "SELECT strftime(arrived_at, '%Y-%m-%d') AS day, lower(status) AS status, count(*) AS updates, max(progress) AS progress FROM status_log WHERE arrived_at IS NOT NULL GROUP BY 1, 2",
    "stm_arrived_units": f"SELECT source_type, count(*) AS units FROM ({PI.ORACLE['ing_evidence_units']}) GROUP BY 1",
}
