"""Connector runs: page by page, each page's facts and checkpoint in one commit."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quarry.operators.publishing import TABLES, publish
from quarry.operators.state import repeated_keys
from quarry.sources.snapshot import Conflict, SnapshotStore, TableSpec, Transaction

RUN = "tenant_id string, connector_id string, run_id string, snapshot_id string, status string, records_seen long, records_changed long, error_code string, started_at timestamp, completed_at timestamp"
SYNC_TABLES = TABLES | {
    "checkpoints": TableSpec("tenant_id string, connector_id string, snapshot_id string, next_offset long, page long, seen long, changed long, done boolean, updated_at timestamp", ("tenant_id", "connector_id")),
    "sync_runs": TableSpec(RUN, ("tenant_id", "connector_id", "run_id")),
}


class AlreadyRunning(RuntimeError):
    """A connector has one run at a time."""


def _row(store: SnapshotStore, table: str, **values) -> DataFrame:
    schema = store.spark.createDataFrame([], store.tables[table].schema).schema
    row = store.spark.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in schema])
    return row


def _of(store: SnapshotStore, table: str, connector) -> DataFrame:
    d = connector.definition
    return store.read(table).where((F.col("tenant_id") == d.tenant_id) & (F.col("connector_id") == d.connector_id))


def start(store: SnapshotStore, connector, now: str) -> str:
    """A RUNNING run, unless the connector has one."""
    if _of(store, "sync_runs", connector).where("status = 'RUNNING'").limit(1).count():
        raise AlreadyRunning(connector.definition.connector_id)
    d, run_id = connector.definition, str(uuid.uuid4())
    txn = store.begin(f"run:{run_id}", 0)
    txn.write("sync_runs", _row(store, "sync_runs", tenant_id=d.tenant_id, connector_id=d.connector_id, run_id=run_id, snapshot_id=connector.snapshot_id, status="RUNNING", started_at=now))
    txn.commit()
    return run_id


def finish(store: SnapshotStore, connector, run_id: str, now: str, seen: int = 0, changed: int = 0, error: str | None = None) -> bool:
    """The end of a run, told once: only a RUNNING one can end. A failed run has no counts."""
    running = _of(store, "sync_runs", connector).where((F.col("run_id") == run_id) & (F.col("status") == "RUNNING"))
    if not running.limit(1).count():
        return False
    txn = store.begin(f"run:{run_id}", 1)
    status, counts = ("FAILED", (None, None)) if error else ("SUCCEEDED", (seen, changed))
    txn.write("sync_runs", running.withColumns({"status": F.lit(status), "records_seen": F.lit(counts[0]), "records_changed": F.lit(counts[1]), "error_code": F.lit(error), "completed_at": F.lit(now)}))
    txn.commit()
    return True


def ingest_page(store: SnapshotStore, connector, page, number: int, before: dict, now: str) -> dict:
    """One page's facts and the checkpoint after it, together: either both are there or neither. The page's
    counts are observed as its results are written."""
    d = connector.definition
    txn = store.begin(f"sync:{d.tenant_id}:{d.connector_id}:{connector.snapshot_id}", number)
    if txn.done:
        return checkpoint(store, connector)
    publish(Observed(txn), page.records, now)
    seen, changed = (before[k] + txn.counts[k] for k in ("seen", "changed"))
    after = {"snapshot_id": connector.snapshot_id, "next_offset": page.next_offset, "page": number, "seen": seen, "changed": changed, "done": not page.has_more}
    txn.write("checkpoints", _row(store, "checkpoints", tenant_id=d.tenant_id, connector_id=d.connector_id, updated_at=now, **after))
    txn.commit()
    return after


def ingest_pages(store: SnapshotStore, connector, at: dict, page_size: int, now: str) -> dict:
    """The next page, or, where the connector gives ranges (pull_pages()), as many in one commit as are in
    already. Each commit reads the tables as they are, so that its cost is that of its own records, and the number of
    commits grows with the logarithm of the pages. Where a range fails, or holds a record twice (of which each page's
    counts), its pages are taken one by one, so that a bad page leaves the checkpoint of the page before."""
    n = at["page"] + 1
    if n > 1 and hasattr(connector, "pull_pages"):
        try:
            page, number = connector.pull_pages(at["next_offset"], page_size, n)
            own = ["document_id"] if "document_id" in page.records.columns else ["space_id", "connector_id", "external_id"]
            if repeated_keys(page.records, ["tenant_id", *own]).isEmpty():
                return ingest_page(store, connector, page, at["page"] + number, at, now)
        except Conflict:
            raise
        except Exception:  # one of its pages will raise it again
            pass
    for _ in range(max(1, n)):
        at = ingest_page(store, connector, connector.pull(at["next_offset"], page_size), at["page"] + 1, at, now)
        if at["done"]:
            break
    return at


class Observed:
    """A transaction whose results are counted by the job that writes them."""

    def __init__(self, txn: Transaction):
        self._txn = txn

    def __getattr__(self, name: str):
        return getattr(self._txn, name)

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        if name != "results":
            return self._txn.write(name, rows)
        seen = Observation(f"results-{uuid.uuid4().hex}")
        out = self._txn.write(name, rows.observe(seen, F.count(F.lit(1)).alias("seen"), F.count_if("changed").alias("changed")))
        self._txn.counts = seen.get
        return out


def checkpoint(store: SnapshotStore, connector) -> dict | None:
    """Where the connector's snapshot stands; None before its first page."""
    rows = _of(store, "checkpoints", connector).where(F.col("snapshot_id") == connector.snapshot_id).limit(1).collect()
    return rows[0].asDict() if rows else None


def synchronize(store: SnapshotStore, connector, now: str, page_size: int = 100) -> str:
    """Pull a connector page by page from where its snapshot stands, and give the run's id.

    A page that fails leaves the former checkpoint (none, if it is the first) and a FAILED run without counts. The
    next run on the same files goes on behind the last page that is in; other files begin anew, where
    records that are known already change nothing. Counts are of all pages of the snapshot. Of connectors that
    give ranges of pages a commit takes as many as are in already (see ingest_pages()).
    """
    run_id = start(store, connector, now)
    try:
        at = checkpoint(store, connector)
        if at is None or at["done"]:
            at = {"next_offset": 0, "page": at["page"] if at else -1, "seen": 0, "changed": 0, "done": False}
        while not at["done"]:
            at = ingest_pages(store, connector, at, page_size, now)
    except Exception:
        finish(store, connector, run_id, now, error="CONNECTOR_SYNC_FAILED")
        raise
    finish(store, connector, run_id, now, at["seen"], at["changed"])
    return run_id


def ingest_stream(store: SnapshotStore, records: DataFrame, app: str, checkpoint_dir: str, now: str) -> None:
    """A stream of source records published batch by batch until none is left. A batch that is delivered
    again, after a failure between its commit and the stream's own, changes nothing."""

    def ingest(rows: DataFrame, batch: int) -> None:
        txn = store.begin(app, batch)
        if not txn.done:
            publish(txn, rows, now)
            txn.commit()

    records.writeStream.option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).foreachBatch(ingest).start().awaitTermination()
