"""Publishing, leases, connector runs, provisioning and projections: current tables and changes in, next
tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.ids import joined, uuid3
from quarry.functions.text import backoff_ms
from quarry.operators.state import enqueue, latest, revision_actions


def publish(incoming: DataFrame, documents: DataFrame, revisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Next documents (document_id, title, authority, active_revision, version), next revisions
    (document_id, revision_number, content_hash) and the result of each incoming row (document_id,
    action, changed, revision_number).

    incoming holds one row per document (document_id, content_hash, title, authority). New content is a
    new revision, known inactive content becomes active again, other metadata alone raises the version;
    the same again changes nothing.
    """
    done = revision_actions(incoming, documents, revisions)
    results = done.select("document_id", "content_hash", "action", (F.col("action") != "NONE").alias("changed"), "revision_number")
    new = incoming.select("document_id", F.col("title").alias("new_title"), F.col("authority").alias("new_authority"))
    steps = results.select("document_id", "changed", F.col("revision_number").alias("new_number")).join(new, "document_id")
    rows = documents.join(steps, "document_id", "full_outer")
    changed = F.coalesce("changed", F.lit(False))
    take = lambda old, fresh: F.when(changed, F.col(fresh)).otherwise(F.col(old)).alias(old)
    next_documents = rows.select(
        "document_id",
        take("title", "new_title"),
        take("authority", "new_authority"),
        F.when(changed, F.col("new_number")).otherwise(F.col("active_revision")).cast("long").alias("active_revision"),
        (F.coalesce("version", F.lit(0)) + changed.cast("int")).cast("long").alias("version"),
    )
    made = results.where("action = 'CREATE'").select("document_id", "revision_number", "content_hash")
    return next_documents, revisions.select("document_id", F.col("revision_number").cast("long"), "content_hash").unionByName(made), results


def publish_jobs(results: DataFrame, jobs: DataFrame, types: tuple[str, ...] = ("KEYWORD", "VECTOR")) -> DataFrame:
    """Next jobs after publishing: each changed document asks for every projection of its new head."""
    kinds = F.explode(F.array(*[F.lit(t) for t in types]))
    wanted = results.where("changed").select(revision_id("document_id", "revision_number").alias("revision_id"), kinds.alias("projection_type"))
    return enqueue(jobs, wanted)


def revision_id(document: str, number: str) -> Column:
    return uuid3(F.concat(F.col(document), F.lit(":"), F.col(number).cast("string")))


def ingest_result(results: DataFrame, counts: DataFrame, vector_enabled: bool) -> DataFrame:
    """What a caller is told: the changed flag, the number of chunks of the head, and the vector status."""
    status = F.lit("SKIPPED") if not vector_enabled else F.when(F.col("changed"), "QUEUED").otherwise("UNCHANGED")
    warning = F.lit(None if vector_enabled else "VECTOR_PROJECTION_DISABLED").cast("string")
    rows = results.withColumn("revision_id", revision_id("document_id", "revision_number")).join(counts, "revision_id", "left")
    return rows.select("document_id", "changed", F.coalesce("chunk_count", F.lit(0)).cast("long").alias("chunk_count"), status.alias("vector_status"), warning.alias("warning"))


def lease(jobs: DataFrame, taken: DataFrame, owner: str, now: str, minutes: int = 2) -> DataFrame:
    """Next jobs after a claim: taken ones are RUNNING under the owner until the lease is over."""
    mine = taken.select("job_id", F.lit(True).alias("mine"))
    rows = jobs.join(mine, "job_id", "left")
    mine_now = F.coalesce("mine", F.lit(False))
    until = F.lit(now).cast("timestamp") + F.make_dt_interval(mins=F.lit(minutes))
    return rows.withColumns(
        {
            "status": F.when(mine_now, "RUNNING").otherwise(F.col("status")),
            "attempts": (F.col("attempts") + mine_now.cast("int")).cast("long"),
            "lease_owner": F.when(mine_now, owner).otherwise(F.col("lease_owner")),
            "lease_until": F.when(mine_now, until).otherwise(F.col("lease_until")),
        }
    ).drop("mine")


def settle(jobs: DataFrame, outcomes: DataFrame, owner: str, longest_attempts: int = 5, now: str | None = None) -> DataFrame:
    """Next jobs after work: outcomes (job_id, ok, perhaps error_code) count only for RUNNING jobs under the
    owner's lease. Done ones are SUCCEEDED; others RETRY, due again after the doubled delay of their
    attempts, or DEAD at the last attempt, with the error's code; leases end. applied says whether an outcome
    counted. Delays run from now, or from available_at."""
    code = F.col("error_code") if "error_code" in outcomes.columns else F.lit(None).cast("string")
    rows = jobs.join(outcomes.select("job_id", "ok", code.alias("new_code")), "job_id", "left")
    if "last_error_code" not in jobs.columns:
        rows = rows.withColumn("last_error_code", F.lit(None).cast("string"))
    counts = F.col("ok").isNotNull() & (F.col("status") == "RUNNING") & F.coalesce(F.col("lease_owner") == owner, F.lit(False))
    end = F.when(F.col("ok"), "SUCCEEDED").when(F.col("attempts") >= longest_attempts, "DEAD").otherwise("RETRY")
    rows = rows.withColumn("applied", counts).withColumn("end", F.when(F.col("applied"), end))
    start = F.col("available_at") if now is None else F.lit(now).cast("timestamp")
    due = F.timestamp_millis(F.unix_millis(start) + backoff_ms(F.col("attempts")))
    return rows.withColumns(
        {
            "status": F.coalesce("end", "status"),
            "available_at": F.when(F.col("end") == "RETRY", due).otherwise(F.col("available_at")),
            "last_error_code": F.when(~F.col("applied"), F.col("last_error_code")).when(~F.col("ok"), F.col("new_code")),
            "lease_owner": F.when(~F.col("applied"), F.col("lease_owner")),
            "lease_until": F.when(~F.col("applied"), F.col("lease_until")),
        }
    ).drop("ok", "new_code", "end")


def sync_counts(records: DataFrame) -> DataFrame:
    """records(run_id, batch, changed, failed) of connector runs: the batches before the first failed one
    are checkpoints (none if it is the first); a failed run reports no counts."""
    batches = records.groupBy("run_id", "batch").agg(F.count(F.lit(1)).alias("seen"), F.count_if("changed").alias("changed"), F.bool_or("failed").alias("failed"))
    runs = batches.groupBy("run_id").agg(
        F.sum("seen").alias("seen"),
        F.sum("changed").alias("changed"),
        F.bool_or("failed").alias("failed"),
        F.min(F.when(F.col("failed"), F.col("batch"))).alias("stop"),
        F.max("batch").alias("last"),
    )
    count = lambda c: F.when(~F.col("failed"), F.col(c)).otherwise(0).cast("long")
    return runs.select(
        "run_id",
        F.when(F.col("failed"), "FAILED").otherwise("SUCCEEDED").alias("status"),
        count("seen").alias("records_seen"),
        count("changed").alias("records_changed"),
        F.when(F.col("failed"), F.when(F.col("stop") > 0, F.col("stop") - 1)).otherwise(F.col("last")).cast("long").alias("checkpoint"),
        F.when(F.col("failed"), "CONNECTOR_SYNC_FAILED").alias("error_code"),
    )


def provision(principals: DataFrame, wanted: DataFrame) -> DataFrame:
    """Next principals (tenant_id, principal_id, status): unknown ones are ACTIVE, known ones keep their
    status, so that a suspended one stays so. admitted says who may go on."""
    key = ["tenant_id", "principal_id"]
    asked = wanted.select(*key).distinct().withColumn("asked", F.lit(True))
    rows = principals.select(*key, "status").join(asked, key, "full_outer")
    status = F.coalesce("status", F.lit("ACTIVE"))
    return rows.select(*key, status.alias("status"), (F.coalesce("asked", F.lit(False)) & (status == "ACTIVE")).alias("admitted"))


def provision_spaces(spaces: DataFrame, wanted: DataFrame) -> DataFrame:
    """Next spaces (tenant_id, space_id, name, status): a space that is asked for takes the stripped name
    and is ACTIVE again; the others stay as they are."""
    asked = wanted.select("tenant_id", "space_id", F.trim("name").alias("new_name")).dropDuplicates(["tenant_id", "space_id"])
    rows = spaces.select("tenant_id", "space_id", "name", "status").join(asked, ["tenant_id", "space_id"], "full_outer")
    return rows.select("tenant_id", "space_id", F.coalesce("new_name", "name").alias("name"), F.when(F.col("new_name").isNotNull(), "ACTIVE").otherwise(F.col("status")).alias("status"))


def safe_identifier(value: Column) -> Column:
    """A name for a collection: lower case, runs of other characters as one _; null unless 1 to 64 long."""
    plain = F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9]+", "_")
    plain = F.regexp_replace(plain, "^_|_$", "")
    return F.when(F.length(plain).between(1, 64), plain)


def finite(vector: Column) -> Column:
    """Whether a vector has components, all of them finite."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def projection_key(*parts: str) -> Column:
    """The key under which retries overwrite: base64 for urls, without padding."""
    plain = F.translate(F.base64(joined(*[F.col(p) for p in parts]).cast("binary")), "+/", "-_")
    return F.regexp_replace(plain, "[=\r\n]", "")


def append_once(kept: DataFrame, more: DataFrame, key: list[str], order: list) -> DataFrame:
    """kept and those of more whose key is new; of repeated new keys the first by order."""
    fresh = latest(more, key, order).join(kept.select(*key), key, "left_anti")
    return kept.unionByName(fresh)


def cascade(root: DataFrame, levels: list[tuple[str, DataFrame, list[str]]]) -> list[tuple[str, DataFrame]]:
    """Rows of each level (name, rows, key of the level above) that go with deleted roots."""
    out, gone = [], root
    for name, rows, key in levels:
        gone = rows.join(gone.select(*key).distinct(), key, "left_semi")
        out.append((name, gone))
    return out
