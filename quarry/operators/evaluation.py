"""Offline evaluation of retrieval: case metrics and macro averages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def case_metrics(cases: DataFrame, expected: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """hit, recall@k, reciprocal rank and nDCG@k by query_id. expected has (query_id, label), results
    (query_id, position, label); repeated hits of a label each add gain, and the ratio ends at 1.
    A case without results scores 0; one without labels has none to find."""
    wanted = expected.distinct()
    hits = results.where(F.col("position") <= k).join(wanted, ["query_id", "label"], "left_semi")
    found = hits.groupBy("query_id").agg(
        F.min("position").alias("first"),
        F.count_distinct("label").alias("found"),
        F.sum(1 / F.log2(F.col("position") + 1.0)).alias("dcg"),
    )
    n = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("expected"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("expected"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    rows = cases.select("query_id").join(n, "query_id").join(found, "query_id", "left")
    return rows.select(
        "query_id",
        F.col("first").isNotNull().alias("hit"),
        (F.coalesce("found", F.lit(0)) / F.col("expected")).alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        F.least(F.lit(1.0), F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
    )


def macro_report(metrics: DataFrame, cases: DataFrame) -> DataFrame:
    """Averages over all cases; those without metrics failed and count as zero."""
    rows = cases.select("query_id").join(metrics, "query_id", "left")
    mean = lambda c: F.avg(F.coalesce(c, F.lit(0.0)))
    return rows.agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(F.col("hit").isNull()).alias("failed"),
        mean(F.col("hit").cast("double")).alias("hit_rate"),
        mean(F.col("recall")).alias("recall"),
        mean(F.col("reciprocal_rank")).alias("mrr"),
        mean(F.col("ndcg")).alias("ndcg"),
    )


def complete_runs(runs: DataFrame, kept: DataFrame, metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Next runs and next case results. metrics has a row per case of each run that ends: run_id, case_id,
    hit, recall, reciprocal_rank and ndcg, null where the case failed. Only RUNNING runs end; the results
    of others are not taken. Results replace those kept under the same run and case."""
    ended = metrics.join(runs.where("status = 'RUNNING'").select("run_id"), "run_id", "left_semi")
    scored = ended.select("run_id", "case_id", F.when(F.col("hit").isNull(), "FAILED").otherwise("SUCCEEDED").alias("status"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("hit", "recall", "reciprocal_rank", "ndcg")])
    means = [F.avg(c).alias(n) for c, n in (("hit", "hit_rate"), ("recall", "recall"), ("reciprocal_rank", "mrr"), ("ndcg", "ndcg"))]
    report = scored.groupBy("run_id").agg(F.count(F.lit(1)).alias("case_count"), F.count_if(F.col("status") == "FAILED").alias("failed_count"), *means)
    rows = runs.select("run_id", "status").join(report, "run_id", "left")
    next_runs = rows.withColumn("status", F.when(F.col("case_count").isNotNull(), "SUCCEEDED").otherwise(F.col("status")))
    return next_runs, kept.join(scored.select("run_id", "case_id"), ["run_id", "case_id"], "left_anti").unionByName(scored)


def next_version(rows: DataFrame, existing: DataFrame, key: list[str], version: str, order: list[str]) -> DataFrame:
    """New rows numbered on from the highest version of their key."""
    high = existing.groupBy(*key).agg(F.max(version).alias("high"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.join(high, key, "left").withColumn(version, (F.coalesce("high", F.lit(0)) + place).cast("long")).drop("high")
