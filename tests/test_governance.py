"""Integrity rules and deletions, stored traces, connectors by version, evaluation set-up, language tags."""

import pytest
from pyspark.sql import functions as F

from quarry.functions.text import language_tag
from quarry.operators import governance, tracing
from quarry.operators.gateway import Retrieval
from quarry.operators.integrity import Blocked, Check, Reference, Unique, broken_rows, delete, violations
from quarry.sources.snapshot import SnapshotStore


def rows_of(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


@pytest.fixture(scope="module")
def family(spark):
    parents = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, None)], "id int, name string")
    children = spark.createDataFrame([(10, 1, 5), (11, 9, -1), (12, None, None), (13, 9, 7)], "child int, id int, n int")
    return {"parents": parents, "children": children}


RULES = [Unique("id", "parents", ("id",)), Unique("name", "parents", ("name",)), Unique("small", "parents", ("id",), where="id < 2"), Reference("parent", "children", ("id",), "parents", ("id",)), Check("n", "children", "n >= 0"), Check("child", "children", "child > 0")]


def test_violations_count_rows_and_nulls_break_nothing(family):
    assert dict(rows_of(violations(family, RULES), "rule", "violations")) == {"id": 1, "name": 1, "small": 0, "parent": 2, "n": 1, "child": 0}
    empty = {name: rows.limit(0) for name, rows in family.items()}
    assert {v for _, v in rows_of(violations(empty, RULES), "rule", "violations")} == {0}


def test_broken_rows_are_found_whole(family):
    by = {r.name: r for r in RULES}
    assert rows_of(broken_rows(family, by["id"]), "id", "name") == [(2, "b"), (2, "b")]
    assert rows_of(broken_rows(family, by["parent"]), "child") == [(11,), (13,)] and rows_of(broken_rows(family, by["n"]), "child") == [(11,)]


KEYS = {"docs": ("doc",), "revs": ("rev",), "parts": ("part",), "cites": ("cite",)}
CASCADES = [
    Reference("head", "docs", ("head",), "revs", ("rev",)),
    Reference("rev_doc", "revs", ("doc",), "docs", ("doc",), cascade=True),
    Reference("part_rev", "parts", ("rev",), "revs", ("rev",), cascade=True),
    Reference("part_part", "parts", ("above",), "parts", ("part",), cascade=True),
    Reference("cite_part", "cites", ("part",), "parts", ("part",)),
]


@pytest.fixture(scope="module")
def tree(spark):
    parts = [(1, 1, None), (2, None, 1), (3, None, 2), (4, None, 3), (5, 2, None), (6, None, 7), (7, None, 6), (8, 3, 6)]
    return {
        "docs": spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "doc int, head int"),
        "revs": spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "rev int, doc int"),
        "parts": spark.createDataFrame(parts, "part int, rev int, above int"),
        "cites": spark.createDataFrame([(1, 4), (2, 5)], "cite int, part int"),
    }


def test_a_deletion_follows_references_down_a_tree_and_stops_at_those_that_hold_it(spark, tree):
    done = delete(tree, KEYS, CASCADES, {"docs": spark.createDataFrame([(1,)], "doc int")})
    assert {name: rows_of(rows, KEYS[name][0]) for name, rows in done.gone.items()} == {"docs": [(1,)], "revs": [(1,)], "parts": [(1,), (2,), (3,), (4,)]}
    assert dict(rows_of(done.blocked, "rule", "rows")) == {"head": 0, "cite_part": 1}
    with pytest.raises(Blocked, match=r"^cite_part \(1 rows\)$"):
        done.after()


def test_parts_in_a_ring_go_once_and_the_rest_stays(spark, tree):
    free = tree | {"cites": tree["cites"].limit(0)}
    done = delete(free, KEYS, CASCADES, {"parts": spark.createDataFrame([(6,), (6,)], "part int"), "docs": spark.createDataFrame([(2,)], "doc int")})
    assert rows_of(done.gone["parts"], "part") == [(5,), (6,), (7,), (8,)]
    after = done.after()
    assert rows_of(after["parts"], "part") == [(1,), (2,), (3,), (4,)] and rows_of(after["docs"], "doc") == [(1,), (3,)]
    nothing = delete(free, KEYS, CASCADES, {"docs": spark.createDataFrame([(99,)], "doc int")})
    assert all(rows.isEmpty() for rows in nothing.gone.values()) and nothing.after()["docs"].count() == 3
    assert delete(free, KEYS, CASCADES, {}).after() == free


def test_cascades_between_tables_that_form_a_ring_are_refused(tree):
    with pytest.raises(ValueError, match="form a ring"):
        delete(tree, KEYS, [*CASCADES, Reference("back", "docs", ("head",), "parts", ("part",), cascade=True)], {})


# ---- traces


def run_of(spark, ids, steps=("ACCESS", "PLAN"), tenant="t"):
    traces = spark.createDataFrame([(r, q, tenant, "u", "OK", "h" * 64, 7, 1) for r, q in ids], "request_id string, query_id long, tenant_id string, principal_id string, outcome string, query_hash string, total_duration_ms long, result_count long")
    rows = [(q, i, s, i, 1, "OK") for _, q in ids for i, s in enumerate(steps)]
    return Retrieval(None, None, spark.createDataFrame(rows, "query_id long, ordinal int, step_name string, duration_ms long, output_count long, status string"), traces)


def test_a_trace_is_stored_once_with_its_own_steps(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/traces", tracing.TABLES)
    for number, ids, steps, at in ((0, [("a", 1), ("b", 2)], ("ACCESS", "PLAN"), "2024-01-01"), (1, [("b", 5), ("c", 6), ("c", 7)], ("X",), "2024-01-02"), (2, [("d", 1)], (), "2024-01-02")):
        lost = store.begin("app", number)
        tracing.append(lost, run_of(spark, [("lost", 1)]), at)
        txn = store.begin("app", number)
        tracing.append(txn, run_of(spark, ids, steps), at)
        txn.commit()
        assert store.begin("app", number).done
    asked = spark.createDataFrame([("t", r) for r in "aabcd"] + [("other", "a"), ("t", "none"), (None, None)], "tenant_id string, request_id string")
    found = {r["request_id"]: (r["query_id"], [(s["ordinal"], s["step_name"]) for s in r["steps"]]) for r in tracing.details(store, asked).collect()}
    assert found == {"a": (1, [(0, "ACCESS"), (1, "PLAN")]), "b": (2, [(0, "ACCESS"), (1, "PLAN")]), "c": (6, [(0, "X")]), "d": (1, [])}
    assert [r["request_id"] for r in tracing.recent(store, "t", 3).collect()] == ["c", "d", "a"]
    assert tracing.recent(store, "t", 0).count() == 1 and tracing.recent(store, "t", 10_000).count() == 4 and tracing.recent(store, "x", 5).count() == 0


# ---- connectors and evaluation


CONNECTORS = "tenant_id string, connector_id string, space_id string, connector_type string, display_name string, config_json string, status string, version long, created_at timestamp, updated_at timestamp"


def test_registrations_raise_versions_and_only_active_spaces_take_them(spark):
    spaces = spark.createDataFrame([("t", "s", "ACTIVE"), ("t", "old", "ARCHIVED")], "tenant_id string, space_id string, status string")
    at = lambda day: F.lit(f"2024-01-0{day}").cast("timestamp")
    asked = spark.createDataFrame([("t", "c", "s", "api", "A", 10, {"k": "v", "authority": "1"}, 1), ("t", "c", "s", "api", "B", 20, None, 2), ("t", "d", "old", "api", "D", 5, {}, 1), ("t", "e", "none", "api", "E", 5, {}, 1)], "tenant_id string, connector_id string, space_id string, connector_type string, display_name string, authority int, config map<string,string>, day int")
    asked = asked.withColumn("occurred_at", F.when(F.col("day") == 1, at(1)).otherwise(at(2))).drop("day")
    first, taken = governance.configure(spark.createDataFrame([], CONNECTORS), spaces, asked)
    assert rows_of(taken, "connector_id", "applied") == [("c", True), ("c", True), ("d", False), ("e", False)]
    assert rows_of(first, "connector_id", "display_name", "config_json", "status", "version") == [("c", "B", '{"authority":"20"}', "ACTIVE", 1)]
    again, _ = governance.configure(first.withColumn("status", F.lit("PAUSED")), spaces, asked.where("display_name = 'A'"))
    row = again.first()
    assert (row["version"], row["status"], row["config_json"], row["created_at"] <= row["updated_at"]) == (2, "ACTIVE", '{"authority":"10","k":"v"}', True)
    bare = again.withColumn("config_json", F.lit('{"k":"v"}'))
    assert [(r["authority"], r["config"]) for r in governance.active_definitions(again.unionByName(bare)).orderBy("authority").collect()] == [(10, {"k": "v"}), (70, {"k": "v"})]
    assert governance.active_definitions(again.withColumn("status", F.lit("ERROR"))).isEmpty()


def test_datasets_count_versions_and_runs_end_once(spark):
    datasets = spark.createDataFrame([("t", 1, "x", "", 3, "ACTIVE", 0)], "tenant_id string, dataset_id long, name string, description string, version long, status string, created_at long")
    wanted = spark.createDataFrame([("t", 1, "x", "", 1), ("t", 2, "x", "", 2), ("t", 3, "x", "", 1), ("u", 4, "x", "", 1), ("u", 4, "x", "", 1)], "tenant_id string, dataset_id long, name string, description string, created_at long")
    made = governance.create_datasets(datasets, wanted)
    assert rows_of(made, "dataset_id", "version", "status") == [(1, 3, "ACTIVE"), (2, 5, "DRAFT"), (3, 4, "DRAFT"), (4, 1, "DRAFT")]
    ddl = "tenant_id string, case_id long, dataset_id long, query string, top_k int"
    cases, refused = governance.create_cases(spark.createDataFrame([("t", 1, 1, "kept", 3)], ddl), made, spark.createDataFrame([("t", 1, 1, "again", 4), ("t", 2, 1, "q", None), ("t", 3, 4, "q", 1), ("t", 4, 2, "q", 0), ("t", 5, 2, None, 1)], ddl))
    assert rows_of(cases, "case_id", "query", "top_k") == [(1, "kept", 3), (2, "q", 8)] and rows_of(refused, "case_id", "error") == [(3, "NO_DATASET"), (4, "TOP_K"), (5, "QUERY")]
    none = spark.createDataFrame([], "tenant_id string, run_id long, dataset_id long, requested_by string, started_at long, status string, case_count long, failed_count long, error_code string")
    runs = governance.start_runs(none, cases, spark.createDataFrame([("t", 1, 1, "u", 0), ("t", 1, 1, "u", 0), ("t", 2, 2, "u", 0)], "tenant_id string, run_id long, dataset_id long, requested_by string, started_at long"))
    failed = governance.fail_runs(runs, spark.createDataFrame([("t", 2, "B"), ("t", 2, "A"), ("t", 9, "A")], "tenant_id string, run_id long, error_code string"))
    assert rows_of(failed.fillna("", ["error_code"]), "run_id", "status", "case_count", "error_code") == [(1, "RUNNING", 2, ""), (2, "FAILED", 0, "A")]
    late = governance.fail_runs(failed, spark.createDataFrame([("t", 2, "LATE")], "tenant_id string, run_id long, error_code string"))
    assert rows_of(late.where("run_id = 2"), "error_code") == [("A",)]


@pytest.mark.parametrize(
    ("tag", "canonical"),
    [
        ("EN", "en"), (" de-at ", "de-AT"), ("zh-hans-CN", "zh-Hans-CN"), ("es-419", "es-419"), ("ZH-yue-HK", "yue-HK"), ("sl-ROZAJ-biske-1994", "sl-rozaj-biske-1994"), ("de-DE-u-co-phonebk-a-b1", "de-DE-a-b1-u-co-phonebk"),
        ("en-x-AB-c", "en-x-ab-c"), ("x-Whatever", "x-whatever"), ("und", "und"), ("iw-IL", "he-IL"), ("in", "id"), ("abcdefgh", "abcdefgh"), ("en-a-bb-x-a-bb", "en-a-bb-x-a-bb"),
        ("en_US", None), ("e", None), ("en-", None), ("-en", None), ("en--US", None), ("abcdefghi", None), ("en-u", None), ("en-x", None), ("de-1996-1996", None), ("en-a-bb-a-cc", None), ("en-US-US", None), ("", None), ("  ", None), (None, None), ("ſe", None),
    ],
)
def test_language_tags(spark, tag, canonical):
    assert spark.createDataFrame([(tag,)], "tag string").select(language_tag(F.col("tag")).alias("t")).first()["t"] == canonical
