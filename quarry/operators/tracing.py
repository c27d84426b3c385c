"""Traces of retrievals in a store: a trace once, its steps in order, lists and details."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.administration import LONGEST_PAGE
from quarry.operators.gateway import Retrieval
from quarry.operators.state import latest
from quarry.sources.snapshot import SnapshotStore, TableSpec, Transaction

STEP = "struct<ordinal: int, step_name: string, duration_ms: long, output_count: long, status: string>"
TABLES = {
    "traces": TableSpec(
        "request_id string, query_id long, tenant_id string, principal_id string, outcome string, query_hash string, total_duration_ms long, result_count long, created_at timestamp",
        ("request_id",),
    ),
    "trace_steps": TableSpec("request_id string, ordinal int, step_name string, duration_ms long, output_count long, status string", ("request_id", "ordinal")),
}


def append(txn: Transaction, run: Retrieval, now: str) -> DataFrame:
    """Write the traces of a run and their steps in one transaction, and give the traces that were new. A
    request that has a trace keeps it and its steps, whoever sends it again and in whichever batch; of a
    request that comes twice in one run the first by query_id counts. Steps are numbered from 0 in the order that they
    ran in."""
    known = txn.read("traces").select("request_id")
    fresh = latest(run.traces, ["request_id"], ["query_id"]).join(known, "request_id", "left_anti")
    made = txn.write("traces", fresh.withColumn("created_at", F.lit(now)))
    txn.write("trace_steps", run.steps.join(made.select("request_id", "query_id"), "query_id"))
    return made


def recent(store: SnapshotStore, tenant: str, limit: int, version: int | None = None) -> DataFrame:
    """A tenant's newest traces, 1 to 200 of them; of one time those of smaller request_id first."""
    rows = store.read("traces", version).where(F.col("tenant_id") == tenant)
    return rows.orderBy(F.desc("created_at"), "request_id").limit(max(1, min(limit, LONGEST_PAGE)))


def details(store: SnapshotStore, requests: DataFrame, version: int | None = None) -> DataFrame:
    """The traces of requests(tenant_id, request_id) with their steps in order. A trace of another tenant
    is not found; one without steps has an empty list."""
    asked = requests.select("tenant_id", "request_id").distinct()
    traces = store.read("traces", version).join(asked, ["tenant_id", "request_id"])
    steps = store.read("trace_steps", version).join(asked.select("request_id").distinct(), "request_id", "left_semi")
    step = F.struct("ordinal", "step_name", "duration_ms", "output_count", "status")
    lists = steps.groupBy("request_id").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    return traces.join(lists, "request_id", "left").withColumn("steps", F.coalesce("steps", F.array().cast(f"array<{STEP}>")))
