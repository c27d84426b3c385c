"""The projection worker and generations: leases, two guards, conflicts, backoff, and the switch of an index."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import generations, publishing
from quarry.operators.vectors import Contract
from quarry.sources.snapshot import SnapshotStore, Transaction
from quarry.streaming import projection
from tests.test_publishing import T0, T1, frame, record

LATER = "2024-02-01 00:00:00"


@pytest.fixture
def store(spark, tmp_path):
    return SnapshotStore(spark, f"file://{tmp_path}/store", projection.PROJECTION_TABLES)


def put(store, batch, rows, now=T0):
    txn = store.begin("test", batch)
    publishing.publish(txn, frame(store.spark, rows), now, types=("KEYWORD",))
    txn.commit()


def jobs(store):
    rows = store.read("jobs").join(store.read("revisions").select("revision_id", "revision_number"), "revision_id")
    names = store.read("documents").select("document_id", "external_id")
    return {(r["external_id"], r["revision_number"]): (r["status"], r["attempts"]) for r in rows.join(names, "document_id").collect()}


def indexed(store):
    names = store.read("documents").select("document_id", "external_id")
    return {r["external_id"]: r["terms"] for r in store.read("keyword_index").join(names, "document_id").collect()}


def runs(store):
    return [tuple(r)[1:] for r in store.read("projection_runs").orderBy("batch").collect()]


def test_jobs_are_leased_in_bounded_batches_and_a_batch_counts_once(spark, store):
    put(store, 0, [record(n, f"text {n}") for n in "abc"])
    assert projection.run_batch(store, "w", 0, T1, limit=2) == 2
    version = store.version()
    assert projection.run_batch(store, "w", 0, T1, limit=2) == 0 and store.version() == version
    assert projection.drain(store, "w", T1, limit=2, first=1) == 3
    assert set(jobs(store).values()) == {("SUCCEEDED", 1)} and indexed(store) == {n: ["text", n] for n in "abc"}
    assert runs(store) == [(0, 2, 2, 0, 0), (1, 1, 1, 0, 0), (2, 0, 0, 0, 0)]


def test_a_head_that_moves_between_read_and_commit_drops_the_result(spark, store):
    put(store, 0, [record("a", "old text"), record("b", "stays")])

    def slow(chunks):
        out = projection.keyword_rows(chunks)
        put(store, 1, [record("a", "new text")], T1)  # while the projection runs
        return out

    assert projection.run_batch(store, "w", 0, T1, project=slow) == 2
    assert indexed(store) == {"b": ["stays"]} and runs(store) == [(0, 2, 1, 1, 0)]
    assert jobs(store) == {("a", 1): ("SUCCEEDED", 1), ("a", 2): ("PENDING", 0), ("b", 1): ("SUCCEEDED", 1)}
    projection.drain(store, "w", T1, first=1)
    assert indexed(store) == {"a": ["new", "text"], "b": ["stays"]}


def test_a_commit_in_between_makes_the_guard_run_again(spark, store, monkeypatch):
    put(store, 0, [record("a", "old text")])
    read = store._merged
    moved = []

    def merged(name, parts):
        out = read(name, parts)
        # heads have been read for the last guard, but nothing is committed yet
        if name == "documents" and store.applied("projection:w:lease") == 0 and not moved:
            moved.append(1)
        elif name == "documents" and moved == [1]:
            moved.append(2)
            put(store, 1, [record("a", "newest text")], T1)
        return out

    monkeypatch.setattr(store, "_merged", merged)
    assert projection.run_batch(store, "w", 0, T1) == 1
    monkeypatch.undo()
    assert moved == [1, 2] and indexed(store) == {} and runs(store) == [(0, 1, 0, 1, 0)]


def test_jobs_of_replaced_revisions_are_done_without_being_projected(spark, store):
    put(store, 0, [record("a", "one")])
    put(store, 1, [record("a", "two")], T1)
    seen = []
    projection.run_batch(store, "w", 0, LATER, project=lambda c: seen.extend(r["content"] for r in c.collect()) or projection.keyword_rows(c))
    assert seen == ["two"] and set(jobs(store).values()) == {("SUCCEEDED", 1)} and indexed(store) == {"a": ["two"]}


def test_failures_back_off_and_die_and_a_lost_lease_is_taken_over(spark, store):
    put(store, 0, [record("a", "one")])

    def fails(chunks):
        raise TimeoutError("the index is away")

    times = ["2024-01-02 00:00:00", "2024-01-02 00:00:01", "2024-01-02 00:00:02", "2024-01-02 00:01:00", "2024-01-02 00:02:00", "2024-01-02 00:03:00"]
    leased = [projection.run_batch(store, "w", i, t, project=fails) for i, t in enumerate(times)]
    # two seconds after the first failure the job is not due after one, but after two
    assert leased == [1, 0, 1, 1, 1, 1]
    (job,) = store.read("jobs").collect()
    assert (job["status"], job["attempts"], job["last_error_code"], job["lease_owner"]) == ("DEAD", 5, "TimeoutError", None)
    put(store, 1, [record("a", "one", title="New")], T1)
    assert jobs(store) == {("a", 1): ("PENDING", 0)}

    class Dies(Exception):
        pass

    def dies(rows, documents):
        raise Dies

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(projection, "active", dies)
        with pytest.raises(Dies):
            projection.run_batch(store, "w", 9, T1)
    assert jobs(store) == {("a", 1): ("RUNNING", 1)}
    assert projection.run_batch(store, "other", 0, T1) == 0  # the lease holds
    assert projection.run_batch(store, "other", 1, LATER) == 1
    assert jobs(store) == {("a", 1): ("SUCCEEDED", 2)} and indexed(store) == {"a": ["one"]}


def test_generations_are_built_beside_the_active_one_and_switched_at_once(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/g", generations.TABLES)
    spaces = spark.createDataFrame([("t", "s1"), ("t", "s2")], "tenant_id string, space_id string")
    rows = spark.createDataFrame([("t", s, f"c{i}", i, [float(i), 1.0]) for i, s in enumerate(("s1", "s2", "s1"))], "tenant_id string, space_id string, chunk_id string, vec_id long, embedding array<double>")
    old, new = Contract("p", "m1", 2), Contract("p", "m2", 1)

    def build(number, contract, vectors):
        txn = store.begin("g", number)
        made = generations.resolve(txn, spaces, contract, T0)
        generations.add_vectors(txn, made, vectors, contract)
        return made, txn.commit()

    first, _ = build(0, old, rows)
    assert {r["status"] for r in first.collect()} == {"ACTIVE"}
    with pytest.raises(ValueError, match="vectors of 1 numbers, not 2"):
        build(1, new, rows)
    second, before = build(1, new, rows.withColumn("embedding", F.slice("embedding", 1, 1)))
    sizes = lambda v=None: {len(r["embedding"]) for r in generations.active_vectors(store, v).collect()}
    assert {r["status"] for r in second.collect()} == {"BUILDING"} and sizes() == {2}
    txn = store.begin("g", 2)
    generations.activate(txn, second.where("space_id = 's1'"))
    txn.commit()
    assert {(r["space_id"], len(r["embedding"])) for r in generations.active_vectors(store).collect()} == {("s1", 1), ("s2", 2)} and sizes(before) == {2}
    # the same contract again is the same generation
    txn = store.begin("g", 3)
    again = generations.resolve(txn, spaces, old, T1)
    assert {r["generation_id"] for r in again.collect()} == {r["generation_id"] for r in first.collect()}
    txn.commit()
    assert store.read("generations").count() == 4
    txn = store.begin("g", 4)
    txn.write("generations", store.read("generations").withColumn("status", F.lit("ACTIVE")))
    txn.commit()
    with pytest.raises(ValueError, match="two active"):
        generations.active_vectors(store)


def test_a_projection_is_written_once_where_nobody_commits_meanwhile(spark, store, monkeypatch):
    put(store, 0, [record("a", "one"), record("b", "two")])
    written, write = [], Transaction.write
    monkeypatch.setattr(Transaction, "write", lambda self, name, rows: written.append(name) or write(self, name, rows))
    monkeypatch.setattr(Transaction, "stage", lambda self, tag, rows, stage=Transaction.stage: written.append(tag) or stage(self, tag, rows))
    assert projection.run_batch(store, "w", 0, T1) == 2
    assert written.count("keyword_index") == 1 and "projected" not in written and indexed(store) == {"a": ["one"], "b": ["two"]}
