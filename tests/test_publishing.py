"""Snapshots, publishing, connectors and their runs: whole versions only, replays, failures half-way, resumes."""

import os

import pytest
from pyspark.sql import functions as F

from quarry.operators import publishing
from quarry.sources import registry
from quarry.sources.snapshot import Conflict, SnapshotStore, TableSpec
from quarry.streaming import sync

T0, T1, T2 = "2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-03 00:00:00"


def record(name, content, title="T", **more):
    row = {"tenant_id": "t", "space_id": "s", "connector_id": "c", "external_id": name, "source_type": "API", "source_uri": f"u/{name}", "title": title, "authority": 50}
    row |= {"metadata": "{}", "media_type": "text/markdown", "language": "en", "content": content, "modified_at": None, "deleted": False}
    return row | more


def frame(spark, rows):
    names = [f.strip().split()[0] for f in publishing.RECORD.split(",")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], publishing.RECORD)


def contents(store):
    """All tables without what a second attempt may name anew."""
    return {t: sorted(map(str, (tuple(r) for r in store.read(t).collect()))) for t in store.tables}


@pytest.fixture
def store(spark, tmp_path):
    return SnapshotStore(spark, f"file://{tmp_path}/store", sync.SYNC_TABLES)


def put(store, spark, batch, rows, now, app="test"):
    txn = store.begin(app, batch)
    results = publishing.publish(txn, frame(spark, rows), now)
    if not txn.done:
        txn.commit()
    return {r["document_id"]: r for r in results.collect()}


def heads(store):
    docs = store.read("documents").join(store.read("revisions").select(F.col("revision_id").alias("active_revision_id"), "revision_number"), "active_revision_id")
    return {r["external_id"]: (r["version"], r["revision_number"], r["title"]) for r in docs.collect()}


def test_revisions_go_from_a_to_b_and_back(spark, store):
    put(store, spark, 0, [record("x", "# H\n\none"), record("y", "same")], T0)
    assert heads(store) == {"x": (1, 1, "T"), "y": (1, 1, "T")}
    got = put(store, spark, 1, [record("x", "# H\n\ntwo\n\n- l"), record("y", "same")], T1)
    assert sorted((r["action"], r["changed"], r["element_count"], r["chunk_count"]) for r in got.values()) == [("CREATE", True, 3, 1), ("NONE", False, 1, 1)]
    got = put(store, spark, 2, [record("x", "# H\n\none"), record("y", "same", title="New"), record("z", "z", deleted=True), record("e", " \n")], T0)
    assert sorted((r["action"], r["error_code"], r["chunk_count"]) for r in got.values()) == [("METADATA", None, 1), ("REACTIVATE", None, 1), ("REJECTED", "DELETED_RECORD", 0), ("REJECTED", "EMPTY_CONTENT", 0)]
    assert heads(store) == {"x": (3, 1, "T"), "y": (2, 1, "New")}
    docs = {r["external_id"]: str(r["updated_at"])[:10] for r in store.read("documents").collect()}
    assert docs["x"] == "2024-01-02"  # times never fall
    assert store.read("revisions").count() == 3 and store.read("chunks").count() == 3 and store.read("jobs").count() == 6
    # the second version is still there
    assert {r["external_id"]: r["version"] for r in store.read("documents", 2).collect()} == {"x": 2, "y": 1}


def test_a_document_cannot_move_and_the_latest_of_repeated_records_counts(spark, store):
    rows = frame(spark, [record("x", "one", modified_at=None), record("x", "two")]).withColumn("modified_at", F.when(F.col("content") == "one", F.lit(T1).cast("timestamp")))
    txn = store.begin("test", 0)
    publishing.publish(txn, rows, T0)
    txn.commit()
    (doc,) = store.read("documents").collect()
    assert [r["content"] for r in store.read("chunks").collect()] == ["one"]
    moved = frame(spark, [record("x", "three", space_id="other")]).withColumn("document_id", F.lit(doc["document_id"]))
    txn = store.begin("test", 1)
    (result,) = publishing.publish(txn, moved, T1).collect()
    txn.commit()
    assert (result["action"], result["error_code"]) == ("REJECTED", "IDENTITY_MOVED") and store.read("revisions").count() == 1


@pytest.mark.parametrize("table", ["revisions", "chunks", "documents", "results", "commit"])
def test_a_batch_that_dies_half_way_leaves_nothing_and_its_replay_everything(spark, tmp_path, table):
    one, two = (SnapshotStore(spark, f"file://{tmp_path}/{n}", sync.SYNC_TABLES) for n in "ab")
    first, second = [record("x", "one"), record("y", "why")], [record("x", "two"), record("z", "zed")]
    for s in (one, two):
        put(s, spark, 0, first, T0)
    before = contents(one)

    class Dies:
        def __init__(self, txn):
            self.txn = txn

        def __getattr__(self, name):
            return getattr(self.txn, name)

        def write(self, name, rows):
            out = self.txn.write(name, rows)
            if name == table:
                raise OSError("executor and driver lost")
            return out

    txn = Dies(one.begin("test", 1))
    if table == "commit":
        publishing.publish(txn, frame(spark, second), T1)
    else:
        with pytest.raises(OSError):
            publishing.publish(txn, frame(spark, second), T1)
    assert contents(one) == before and one.version() == 1 and one.applied("test") == 0
    put(one, spark, 1, second, T1)
    put(two, spark, 1, second, T1)
    assert contents(one) == contents(two)
    again = put(one, spark, 1, [record("x", "something else")], T2)
    assert contents(one) == contents(two) and {r["action"] for r in again.values()} == {"CREATE"}


def test_two_writers_conflict_and_compaction_keeps_rows(spark, store):
    put(store, spark, 0, [record("x", "one"), record("y", "y")], T0)
    mine, other = store.begin("a", 0), store.begin("b", 0)
    for txn in (mine, other):
        publishing.publish(txn, frame(spark, [record("x", "two")]), T1)
    other.commit()
    with pytest.raises(Conflict):
        mine.commit()
    assert store.version() == 2 and store.applied("a") == -1 and heads(store)["x"] == (2, 2, "T")
    before = contents(store)
    assert store.compact() == 3 and contents(store) == before and len(store.marker()["parts"]["documents"]) == 1
    assert store.applied("b") == 0 and heads(store)["y"] == (1, 1, "T")


def test_an_empty_batch_and_an_empty_store(spark, store):
    assert store.read("documents").count() == 0 and store.version() == 0
    assert put(store, spark, 0, [], T0) == {} and store.version() == 1
    plain = SnapshotStore(spark, store.root + "-2", {"t": TableSpec("a int")})
    txn = plain.begin("x", 0)
    txn.write("t", spark.range(3).select(F.col("id").alias("a")))
    assert plain.read("t").count() == 0
    txn.commit()
    assert sorted(r["a"] for r in plain.read("t").collect()) == [0, 1, 2]


# ---- connectors


@pytest.fixture(scope="module")
def vault(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("vaults") / "my vault"
    for i in range(7):
        path = root / ("deep" if i % 2 else ".") / f"n{i}.md"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"---\ntitle: N{i}\ntags: [a]\n---\nsee [[n{i}]] #t{i}\n", encoding="utf-8")
    (root / ".obsidian").mkdir()
    (root / ".obsidian" / "no.md").write_text("no")
    (root / "no.txt").write_text("no")
    outside = tmp_path_factory.mktemp("outside")
    (outside / "secret.md").write_text("secret")
    os.symlink(outside / "secret.md", root / "link.md")
    os.symlink(outside, root / "linked")
    return root, registry.vault_provider(spark, (str(root.parent),), longest=2000)


def definition(root, **config):
    return registry.Definition("c1", "OBSIDIAN", "t", "s", {"vaultPath": str(root), "vaultName": "v"} | config)


def opened(spark, vault):
    sources = registry.SourceRegistry(spark)
    sources.register("OBSIDIAN", vault[1])
    return sources.open(definition(vault[0]))


def test_registry_takes_one_provider_a_type_and_allowed_roots_only(spark, vault, tmp_path):
    sources = registry.SourceRegistry(spark)
    sources.register("OBSIDIAN", vault[1])
    with pytest.raises(ValueError, match="has a provider"):
        sources.register("OBSIDIAN", vault[1])
    with pytest.raises(ValueError, match="no provider"):
        sources.open(registry.Definition("c", "GIT", "t", "s"))
    with pytest.raises(ValueError, match="lacks vaultPath"):
        sources.open(definition("  "))
    with pytest.raises(ValueError, match="outside the allowed"):
        sources.open(definition(tmp_path))
    with pytest.raises(ValueError, match="no directory"):
        sources.open(definition(vault[0] / "n0.md"))
    with pytest.raises(Exception, match="outside the allowed"):
        spark.read.format("quarry-vault").load(str(tmp_path)).count()


def test_batch_pages_and_stream_give_equal_rows(spark, vault, tmp_path):
    connector = opened(spark, vault)
    key = lambda rows: sorted(map(str, map(tuple, rows)))
    whole = spark.read.format("quarry-vault").load(str(vault[0])).collect()
    assert [r["external_id"] for r in whole] == sorted(r["external_id"] for r in whole) and len(whole) == 7
    assert not any("link" in r["external_id"] or "no" in r["external_id"] for r in whole)
    pages, offset, more = [], 0, True
    while more:
        page = connector.pull(offset, 3)
        pages.append(page.records.collect())
        offset, more = page.next_offset, page.has_more
    assert [len(p) for p in pages] == [3, 3, 1] and offset == 0
    out = str(tmp_path / "out")
    connector.stream().writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert key(spark.read.parquet(out).collect()) == key([r for p in pages for r in p])
    row = pages[0][0]
    assert row["external_id"] == "deep/n1.md" and row["title"] == "N1" and '"obsidian.tags":"a\\u001ft1"' in row["metadata"].lower()
    options = lambda **o: [r["external_id"] for r in spark.read.format("quarry-vault").options(**o).load(str(vault[0])).collect()]
    assert options(offset=2, limit=2) == [r["external_id"] for r in whole[2:4]] and options(offset=7) == []
    for bad in ({"offset": 8}, {"limit": 0}, {"limit": 10_001}, {"offset": -1}):
        with pytest.raises(Exception, match="offset|limit"):
            options(**bad)


def test_a_run_fails_at_a_page_and_the_next_goes_on_behind_the_last_good_one(spark, store, vault):
    root = vault[0]
    big = root / "n4.md"
    text = big.read_text()
    runs = lambda: [(r["status"], r["records_seen"], r["records_changed"], r["error_code"]) for r in store.read("sync_runs").orderBy("started_at").collect()]
    try:
        big.write_text("x" * 3000)
        connector = opened(spark, vault)
        with pytest.raises(Exception, match="more than 2000"):
            sync.synchronize(store, connector, T0, page_size=3)
        assert runs() == [("FAILED", None, None, "CONNECTOR_SYNC_FAILED")]
        at = sync.checkpoint(store, connector)
        assert (at["next_offset"], at["page"], at["done"]) == (3, 0, False) and store.read("documents").count() == 3
    finally:
        big.write_text(text)
    before = store.version()
    sync.synchronize(store, connector, T1, page_size=3)
    assert runs()[1] == ("SUCCEEDED", 7, 7, None) and store.read("documents").count() == 7
    assert store.version() == before + 2 + 2  # a start, two pages and an end
    # once more: all records are known
    sync.synchronize(store, opened(spark, vault), T2, page_size=5)
    assert runs()[2] == ("SUCCEEDED", 7, 0, None) and store.read("revisions").count() == 7


def test_a_first_page_that_fails_leaves_no_checkpoint_and_a_connector_has_one_run(spark, store, vault):
    connector = opened(spark, vault)
    connector.longest = 5
    with pytest.raises(Exception, match="more than 5"):
        sync.synchronize(store, connector, T0, page_size=3)
    assert sync.checkpoint(store, connector) is None and store.read("documents").count() == 0
    run = sync.start(store, connector, T1)
    with pytest.raises(sync.AlreadyRunning):
        sync.synchronize(store, connector, T1)
    assert sync.finish(store, connector, run, T2, 1, 1) and not sync.finish(store, connector, run, T2, error="LATE")


def test_a_page_that_is_in_is_not_ingested_again(spark, store, vault):
    connector = opened(spark, vault)
    start = {"next_offset": 0, "page": -1, "seen": 0, "changed": 0, "done": False}
    first = sync.ingest_page(store, connector, connector.pull(0, 4), 0, start, T0)
    version = store.version()
    again = sync.ingest_page(store, connector, connector.pull(0, 4), 0, start, T1)
    assert store.version() == version and {k: again[k] for k in first} == first


def test_a_stream_is_published_once(spark, store, vault, tmp_path):
    connector = opened(spark, vault)
    for _ in range(2):
        sync.ingest_stream(store, connector.stream(), "stream", str(tmp_path / "cp"), T0)
    assert store.read("documents").count() == 7 and store.applied("stream") == 0
    # the stream forgets, the store does not
    sync.ingest_stream(store, connector.stream(), "stream", str(tmp_path / "other"), T1)
    assert store.version() == 1 and store.read("results").count() == 7


def test_a_stream_that_goes_on_gives_new_files_wherever_they_stand(spark, store, tmp_path):
    root = tmp_path / "vaults" / "v"
    root.mkdir(parents=True)
    provider = registry.vault_provider(spark, (str(tmp_path / "vaults"),))
    (root / "m.md").write_text("first")
    open_ = lambda: provider(spark, definition(root)).stream()
    sync.ingest_stream(store, open_(), "stream", str(tmp_path / "cp"), T0)
    (root / "a.md").write_text("stands before")
    sync.ingest_stream(store, open_(), "stream", str(tmp_path / "cp"), T1)
    assert {r["external_id"] for r in store.read("documents").collect()} == {"a.md", "m.md"}
    assert {r["action"] for r in store.read("results").where("batch = 1").collect()} == {"CREATE", "NONE"} and store.applied("stream") == 1


def test_what_is_decided_is_decided_without_texts(spark, store, monkeypatch):
    staged = {}
    stage = publishing.Transaction.stage
    monkeypatch.setattr(publishing.Transaction, "stage", lambda self, tag, rows: staged.setdefault(tag, stage(self, tag, rows)))
    txn = store.begin("test", 0)
    publishing.publish(txn, frame(spark, [record("x", "# H\n\none"), record("y", "two")]), T0)
    txn.commit()
    assert "content" not in staged["plan"].columns and "content_hash" in staged["plan"].columns
    assert sorted(r["content"] for r in store.read("chunks").collect()) == ["H\n\none", "two"]


def test_commits_of_a_table_grow_with_the_logarithm_of_its_pages(spark, store):
    rows = frame(spark, [record(f"n{i:02}", f"text {i}") for i in range(9)])
    connector = registry.TableConnector(registry.Definition("c", "TABLE", "t", "s"), rows, ["external_id"])
    sync.synchronize(store, connector, T0, page_size=1)
    # a start, pages 1, 1, 2, 4, 1 and an end
    assert store.version() == 7 and store.read("documents").count() == 9
    (run,) = store.read("sync_runs").collect()
    assert (run["status"], run["records_seen"], run["records_changed"]) == ("SUCCEEDED", 9, 9)
    assert sync.checkpoint(store, connector)["page"] == 8
