"""The projection worker: due jobs are leased, their revisions projected, and what still holds is committed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import tokens
from quarry.operators.lifecycle import lease, projection_key, settle
from quarry.operators.publishing import TABLES
from quarry.operators.state import claim
from quarry.sources.snapshot import Conflict, SnapshotStore, TableSpec

JOB_KEY = ["tenant_id", "revision_id", "projection_type"]
PROJECTION_TABLES = TABLES | {
    "jobs": TableSpec(TABLES["jobs"].schema + ", lease_owner string, lease_until timestamp, last_error_code string", TABLES["jobs"].key),
    "keyword_index": TableSpec("tenant_id string, key string, space_id string, document_id string, revision_id string, chunk_id string, terms array<string>", ("tenant_id", "key")),
    "projection_runs": TableSpec("worker string, batch long, leased long, published long, superseded long, failed long"),
}


def keyword_rows(chunks: DataFrame) -> DataFrame:
    """What the keyword index keeps of chunks: retries write the same key again."""
    return chunks.select("tenant_id", projection_key("tenant_id", "chunk_id").alias("key"), "space_id", "document_id", "revision_id", "chunk_id", tokens(F.col("content")).alias("terms"))


def _jobs(rows: DataFrame) -> DataFrame:
    return rows.withColumn("job_id", F.concat_ws("\x1f", *JOB_KEY))


def active(rows: DataFrame, documents: DataFrame) -> DataFrame:
    heads = documents.where("status = 'ACTIVE'").select("tenant_id", "document_id", F.col("active_revision_id").alias("revision_id"))
    return rows.join(heads, ["tenant_id", "document_id", "revision_id"], "left_semi")


def run_batch(store: SnapshotStore, worker: str, batch: int, now: str, limit: int = 8, project: Callable[[DataFrame], DataFrame] = keyword_rows, table: str = "keyword_index", kind: str = "KEYWORD", minutes: int = 2) -> int:
    """Lease at most `limit` due jobs of a kind, project them and commit; gives how many were leased.

    The work is guarded twice: jobs whose revision is not the active one when they are leased are done
    without being projected, and heads are read again when the results are committed, so that those of a revision
    that was replaced meanwhile are left out (its job is done all the same). If someone commits between that read
    and ours, the marker conflicts and the guard runs again on what they wrote. A projection that raises gives its
    jobs RETRY with a doubled delay and the error's code, or DEAD at the last attempt; outcomes count only
    for the owner of a lease. Delivered again after its end, a batch finds its outcome in and changes nothing."""
    app = f"projection:{worker}"
    while True:
        txn = store.begin(f"{app}:lease", batch)
        if txn.done:
            break
        jobs = _jobs(txn.read("jobs")).where(F.col("projection_type") == kind)
        taken = txn.stage("taken", claim(jobs, now, limit))
        mine = jobs.join(taken.select("job_id"), "job_id", "left_semi")
        txn.write("jobs", lease(mine, taken, worker, now, minutes))
        try:
            txn.commit()
            break
        except Conflict:
            continue
    if store.applied(app) >= batch:
        return 0
    first = store.begin(app, batch)
    held = _jobs(first.read("jobs")).where((F.col("status") == "RUNNING") & (F.col("lease_owner") == worker) & (F.col("projection_type") == kind))
    # jobs are leased in the order of their ids: the range of a batch's revisions leaves most other chunks unread
    n, low, high = held.agg(F.count(F.lit(1)), F.min("revision_id"), F.max("revision_id")).first()
    live = active(held, first.read("documents"))
    work, error = None, None
    try:
        near = first.read("chunks").where(F.col("revision_id").between(low, high))
        chunks = near.join(live.select("tenant_id", "revision_id"), ["tenant_id", "revision_id"], "left_semi")
        work = first.write(table, project(chunks))
    except Exception as failure:  # whatever a projection raises is its jobs' failure
        error = type(failure).__name__
    while True:
        txn = store.begin(app, batch)
        documents = txn.read("documents")
        still = active(held, documents)
        failed = still.limit(0) if error is None else still
        outcomes = held.join(failed.select("job_id", F.lit(False).alias("ok")), "job_id", "left").select("job_id", F.coalesce("ok", F.lit(True)).alias("ok"), F.lit(error).alias("error_code"))
        settled = settle(held, outcomes, worker, now=now)
        txn.write("jobs", settled)
        if work is not None and txn.base["version"] == first.base["version"]:
            txn.written[table] = first.written[table]  # nobody has committed since: what is written holds as it is
        elif work is not None:
            txn.write(table, active(work, documents))
        published = 0 if error else still.count()
        row = store.spark.range(1).select(*[F.lit(v).alias(k) for k, v in {"worker": worker, "batch": batch, "leased": n, "published": published, "superseded": n - (published if error is None else failed.count()), "failed": 0 if error is None else failed.count()}.items()])
        txn.write("projection_runs", row)
        try:
            txn.commit()
            return n
        except Conflict:
            continue


def drain(store: SnapshotStore, worker: str, now: str, limit: int = 8, first: int = 0, **more) -> int:
    """Batches until no job is due; the number of the next batch."""
    while run_batch(store, worker, first, now, limit, **more):
        first += 1
    return first + 1
