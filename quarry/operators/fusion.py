"""Reciprocal rank fusion, evidence and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.ids import signed_order, uuid3
from quarry.functions.text import authority


def fuse(candidates: DataFrame, constant: int = 60, keep: int | None = 8) -> DataFrame:
    """One row per (query_id, chunk_id): summed 1 / (constant + rank), the sorted channels, and the
    representative of best score, KEYWORD before VECTOR among equals. relevance relates the fused
    score to the best of the query, before the cut, times the representative's score. Rows are
    ordered by fused score and signed id."""
    first = F.struct(F.col("score"), -F.ascii("channel"), -F.col("rank"))
    fused = candidates.groupBy("query_id", "chunk_id").agg(
        F.sum(1.0 / (constant + F.col("rank"))).alias("rrf"),
        F.array_sort(F.collect_set("channel")).alias("channels"),
        F.max_by("score", first).alias("score"),
        F.max_by("document_id", first).alias("document_id"),
    )
    own = Window.partitionBy("query_id")
    fused = fused.withColumn("relevance", F.col("rrf") / F.max("rrf").over(own) * F.col("score"))
    fused = fused.withColumn("position", F.row_number().over(own.orderBy(F.desc("rrf"), *signed_order(F.col("chunk_id")))))
    return fused if keep is None else fused.where(F.col("position") <= keep)


def identity_conflicts(candidates: DataFrame) -> DataFrame:
    """Chunks that channels report under different identities."""
    identity = F.struct("tenant_id", "space_id", "document_id", "revision_id")
    return candidates.groupBy("query_id", "chunk_id").agg(F.count_distinct(identity).alias("identities")).where("identities > 1")


def evidence(fused: DataFrame, live: DataFrame) -> DataFrame:
    """Evidence rows with stable ids, citation fields and the document's authority, of live chunks."""
    rows = fused.join(live.select("chunk_id", "content_hash", "ordinal", "title", "source_uri", F.col("authority").cast("string").alias("raw_authority")), "chunk_id")
    return rows.withColumn("authority", authority(F.col("raw_authority"))).withColumn("evidence_id", uuid3(F.concat(F.col("query_id").cast("string"), F.lit(":"), "chunk_id")))


def bundles(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per query: its evidence in order, and whether the first is relevant enough."""
    item = F.struct("position", "evidence_id", "chunk_id", "relevance", "authority", "title", "source_uri", "channels")
    grouped = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("evidences"))
    return grouped.withColumn("sufficient", F.get("evidences", F.lit(0))["relevance"] >= threshold)


def trace_steps(steps: list[tuple[str, int, DataFrame | None]], queries: DataFrame) -> DataFrame:
    """(query_id, ordinal, step_name, duration_ms, output_count, status) from the steps of one run: name,
    milliseconds and written rows, or None where the step failed. The milliseconds are the batch's; a
    step that gave a query nothing has 0."""
    out = None
    for ordinal, (name, ms, frame) in enumerate(steps):
        own = queries.select("query_id")
        n = own.limit(0).withColumn("n", F.lit(0)) if frame is None else frame.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
        fixed = [F.lit(ordinal).alias("ordinal"), F.lit(name).alias("step_name"), F.lit(ms).cast("long").alias("duration_ms")]
        one = own.join(n, "query_id", "left").select("query_id", *fixed, F.coalesce("n", F.lit(0)).cast("long").alias("output_count"), F.lit("FAILED" if frame is None else "OK").alias("status"))
        out = one if out is None else out.unionByName(one)
    return out
