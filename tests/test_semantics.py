"""Rules of parsing, chunking, fusion and job state on small inputs."""

import pytest
from pyspark.sql import functions as F

from quarry.functions.ids import signed_order, uuid3
from quarry.operators import evaluation, fusion, state
from quarry.sources import markdown
from quarry.streaming import outbox


def blocks(text):
    return [(kind, path, content) for _, kind, path, content, _ in markdown.elements_of(text)]


def test_headings_are_trimmed_by_count():
    found = blocks("# A\n### B\n### C\n## D\ntext")
    assert [p for k, p, _ in found if k == "HEADING"] == [["A"], ["A", "B"], ["A", "B", "C"], ["A", "D"]]
    assert found[-1] == ("PARAGRAPH", ["A", "D"], "text")


def test_blocks_of_a_note():
    text = "---\ntitle: x\n---\nfirst\nsecond\n\n- a\n- b\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```java\nint x;\n```\n"
    assert [(k, c) for k, _, c in blocks(text)] == [("PARAGRAPH", "first\nsecond"), ("LIST", "- a\n- b"), ("TABLE", "| a | b |\n|---|---|\n| 1 | 2 |"), ("CODE", "int x;")]
    assert blocks(None) == blocks("") == [] and blocks("```\n```")[0][2] == ""


def test_long_elements_are_cut_and_nothing_is_lost(spark):
    text = "# H\n" + "abcdef. " * 200 + "\n\nshort"
    elements = markdown.parse_elements(spark.createDataFrame([("r", text)], "revision_id string, content string"))
    chunks = markdown.pack_chunks(elements, 128, 180).orderBy("ordinal").collect()
    assert [c["ordinal"] for c in chunks] == list(range(len(chunks)))
    assert max(len(c["content"]) for c in chunks) <= 180
    joined = "".join("".join(c["content"] for c in chunks).split())
    assert joined == "".join(text.replace("# H", "H").split())
    with pytest.raises(ValueError):
        markdown.pack_chunks(elements, 100, 180)


def candidates(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "query_id long, channel string, rank int, score double, chunk_id string, document_id string")


def test_fusion_adds_ranks_and_prefers_keyword_among_equals(spark):
    a, b = "00000000-0000-4000-8000-000000000001", "f0000000-0000-4000-8000-000000000002"
    rows = [("KEYWORD", 1, 0.5, a, "k"), ("VECTOR", 2, 0.5, a, "v"), ("VECTOR", 1, 0.9, b, "v")]
    found = {r["chunk_id"]: r for r in fusion.fuse(candidates(spark, rows)).collect()}
    assert found[a]["rrf"] == pytest.approx(1 / 61 + 1 / 62) and found[a]["channels"] == ["KEYWORD", "VECTOR"]
    assert found[a]["document_id"] == "k" and found[a]["position"] == 1
    assert found[b]["relevance"] == pytest.approx((1 / 61) / (1 / 61 + 1 / 62) * 0.9)


def test_ties_follow_signed_ids(spark):
    ids = ["00000000-0000-4000-8000-000000000001", "f0000000-0000-4000-8000-000000000002", "7fffffff-0000-4000-8000-000000000003", "80000000-0000-4000-8000-000000000004"]
    frame = spark.createDataFrame([(i,) for i in ids], "id string").orderBy(*signed_order(F.col("id")))
    assert [r["id"][:2] for r in frame.collect()] == ["80", "f0", "00", "7f"]


def test_name_based_uuids(spark):
    import hashlib
    import uuid

    raw = uuid.UUID(bytes=hashlib.md5(b"t:s:c:e").digest(), version=3)
    assert spark.range(1).select(uuid3(F.lit("t:s:c:e")).alias("u")).first()["u"] == str(raw)


def test_outcomes_advance_jobs():
    assert outbox.advance("PENDING", 0, "ok") == ("SUCCEEDED", 1, None)
    assert outbox.advance("RETRY", 1, "error") == ("RETRY", 2, 4_000)
    assert outbox.advance("RETRY", 4, "error") == ("DEAD", 5, None)
    assert outbox.advance("DEAD", 5, "ok") == ("DEAD", 5, None)
    assert outbox.delay_ms(40) == 300_000


def test_newest_running_run_stays(spark):
    rows = [(1, "c", "RUNNING", "2024-01-01"), (2, "c", "RUNNING", "2024-01-02"), (3, "c", "FAILED", "2024-01-03"), (4, "d", "RUNNING", "2024-01-01")]
    runs = spark.createDataFrame(rows, "run_id long, connector_id string, status string, at string")
    runs = runs.select("*", F.lit("t").alias("tenant_id"), F.col("at").cast("timestamp").alias("started_at"), F.col("run_id").cast("string").alias("id"))
    found = {r["run_id"]: r["status"] for r in state.single_flight(runs).collect()}
    assert found == {1: "CANCELLED", 2: "RUNNING", 3: "FAILED", 4: "RUNNING"}


def test_metrics_of_a_case(spark):
    cases = spark.createDataFrame([(1,), (2,)], "query_id long")
    expected = spark.createDataFrame([(1, "a"), (1, "b"), (2, "z")], "query_id long, label string")
    results = spark.createDataFrame([(1, 1, "x"), (1, 2, "a")], "query_id long, position int, label string")
    found = {r["query_id"]: r.asDict() for r in evaluation.case_metrics(cases, expected, results, 8).collect()}
    assert 0.5 in found[1].values() and 0.0 in found[2].values()
