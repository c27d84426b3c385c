"""State changes as pure functions: current rows and changes in, next rows out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import backoff_ms


def revision_actions(incoming: DataFrame, documents: DataFrame, revisions: DataFrame) -> DataFrame:
    """What publishing does to each incoming (document_id, content_hash, title, authority): NONE for the
    active content unchanged, METADATA where only title or authority differ, REACTIVATE for a known
    inactive revision, CREATE for new content; with the revision's number."""
    known = revisions.select("document_id", "content_hash", "revision_number").groupBy("document_id", "content_hash").agg(F.max("revision_number").alias("known_number"))
    high = revisions.groupBy("document_id").agg(F.max("revision_number").alias("high"))
    now = documents.select("document_id", "active_revision", F.col("title").alias("old_title"), F.col("authority").alias("old_authority"))
    rows = incoming.join(known, ["document_id", "content_hash"], "left").join(high, "document_id", "left").join(now, "document_id", "left")
    changed = ~(F.col("title").eqNullSafe(F.col("old_title")) & F.col("authority").eqNullSafe(F.col("old_authority")))
    action = (
        F.when(F.col("known_number").isNull(), "CREATE")
        .when(F.col("known_number") != F.col("active_revision"), "REACTIVATE")
        .when(changed, "METADATA")
        .otherwise("NONE")
    )
    number = F.coalesce("known_number", F.coalesce("high", F.lit(0)) + 1)
    return rows.select("document_id", "content_hash", action.alias("action"), number.cast("long").alias("revision_number"))


def upsert(current: DataFrame, changes: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Next rows: changed values replace, versions rise only where one differs, update times never fall."""
    new = changes.select(*key, *[F.col(c).alias(f"new_{c}") for c in values], F.col("updated_at").alias("new_at"))
    joined = current.join(new, key, "full_outer")
    present = F.col("new_at").isNotNull()
    same = F.lit(True)
    for c in values:
        same = same & F.col(c).eqNullSafe(F.col(f"new_{c}"))
    touched = present & (F.col("version").isNull() | ~same)
    return joined.select(
        *key,
        *[F.when(present, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in values],
        F.when(touched, F.greatest(F.coalesce("updated_at", "new_at"), "new_at")).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(touched, F.coalesce("version", F.lit(0)) + 1).otherwise(F.col("version")).cast("long").alias("version"),
    )


def enqueue(jobs: DataFrame, wanted: DataFrame, keep_running: bool = False) -> DataFrame:
    """wanted(revision_id, projection_type) become PENDING jobs: new ones are added; SUCCEEDED and DEAD
    ones start over. With keep_running (a rebuild) all but RUNNING ones do."""
    w = wanted.select("revision_id", "projection_type").distinct().withColumn("wanted", F.lit(True))
    joined = jobs.join(w, ["revision_id", "projection_type"], "full_outer")
    resets = F.col("status") != "RUNNING" if keep_running else F.col("status").isin("SUCCEEDED", "DEAD")
    fresh = F.coalesce(F.col("wanted"), F.lit(False)) & (F.col("status").isNull() | resets)
    return joined.select(
        "revision_id",
        "projection_type",
        F.when(fresh, "PENDING").otherwise(F.col("status")).alias("status"),
        F.when(fresh, 0).otherwise(F.col("attempts")).cast("long").alias("attempts"),
        fresh.alias("requeued"),
    )


def claim(jobs: DataFrame, now: str, limit: int) -> DataFrame:
    """Jobs a worker takes: due PENDING or RETRY ones and RUNNING ones whose lease is over, oldest first."""
    at = F.lit(now).cast("timestamp")
    due = (F.col("status").isin("PENDING", "RETRY") & (F.col("available_at") <= at)) | ((F.col("status") == "RUNNING") & (F.col("lease_until") < at))
    # limit rows: the order is taken by a bounded top-k, then numbered
    first = jobs.where(due).orderBy("available_at", "created_at", "job_id").limit(limit)
    return first.withColumn("attempts", F.col("attempts") + 1)


def fail(jobs: DataFrame, longest_attempts: int = 5) -> DataFrame:
    """After a failure: RETRY with a doubled delay, or DEAD at the last attempt."""
    dead = F.col("attempts") >= longest_attempts
    return jobs.withColumn("status", F.when(dead, "DEAD").otherwise("RETRY")).withColumn("delay_ms", F.when(~dead, backoff_ms(F.col("attempts"))))


def requeue_dead(jobs: DataFrame, heads: DataFrame) -> DataFrame:
    """DEAD jobs of active revisions are due again (RETRY, no attempts); others stay as they are."""
    live = heads.where("status = 'ACTIVE'").select("revision_id", F.lit(True).alias("live"))
    joined = jobs.join(live, "revision_id", "left")
    again = (F.col("status") == "DEAD") & F.coalesce("live", F.lit(False))
    return joined.withColumns({"attempts": F.when(again, 0).otherwise(F.col("attempts")), "status": F.when(again, "RETRY").otherwise(F.col("status"))}).select(jobs.columns)


def single_flight(runs: DataFrame) -> DataFrame:
    """Of several RUNNING runs of a connector the newest stays; the others are CANCELLED."""
    place = F.row_number().over(Window.partitionBy("tenant_id", "connector_id").orderBy(F.desc("started_at"), F.desc("run_id")))
    running = runs.where("status = 'RUNNING'").withColumn("place", place)
    running = running.withColumn("status", F.when(F.col("place") > 1, "CANCELLED").otherwise(F.col("status"))).drop("place")
    return running.unionByName(runs.where("status <> 'RUNNING'"))


def grant(grants: DataFrame, more: DataFrame) -> DataFrame:
    return grants.unionByName(more).dropDuplicates()


def revoke(grants: DataFrame, gone: DataFrame) -> DataFrame:
    return grants.join(gone.distinct(), grants.columns, "left_anti")


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("place = 1").drop("place")


def repeated_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Violations of a unique key."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(children: DataFrame, parents: DataFrame, key: list[str]) -> DataFrame:
    """Violations of a foreign key."""
    return children.join(parents.select(*key).distinct(), key, "left_anti")
