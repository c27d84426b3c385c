"""Searches with phrases, alternatives and exclusions, cover density, and tokens of scripts without spaces."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import retrieval

SEARCHES = {
    'a "b c" d': [(0, False, ["a"]), (0, False, ["b", "c"]), (0, False, ["d"])],
    "a OR b or -c d": [(0, False, ["a"]), (1, False, ["b"]), (2, True, ["c"]), (2, False, ["d"])],
    '-"x y" z-w': [(0, True, ["x", "y"]), (0, False, ["z", "w"])],
    "or a or": [(1, False, ["a"])],
    '"open end': [(0, False, ["open", "end"])],
    '"" - …': [],
    "": [],
    'Ä"B"c': [(0, False, ["ä"]), (0, False, ["b"]), (0, False, ["c"])],
}


def test_searches_are_read_as_groups_of_parts(spark):
    rows = spark.createDataFrame([(s,) for s in SEARCHES] + [(None,)], "s string")
    got = {r["s"]: r["p"] for r in rows.select("s", tx.search_parts(F.col("s")).alias("p")).collect()}
    assert {s: [(x["grp"], x["excluded"], x["words"]) for x in p] for s, p in got.items() if s is not None} == SEARCHES


@pytest.fixture(scope="module")
def found(spark):
    texts = {
        "c1": "the quick brown fox jumps over the lazy dog",
        "c2": "brown quick fox",
        "c3": "quick brown quick brown bear",
        "c4": "lazy the brown",
        "c5": "",
    }
    rows = [(i, "t", "s", t, f"Title of {i}") for i, t in texts.items()] + [("far", "t", "other", texts["c1"], "x"), ("own", "u", "s", texts["c1"], "x")]
    live = spark.createDataFrame(rows, "chunk_id string, tenant_id string, space_id string, content string, title string")

    def run(text):
        asked = spark.createDataFrame([(1, "t", text, 40)], "query_id long, tenant_id string, normalised string, candidate_limit int")
        scope = spark.createDataFrame([(1, "t", "s")], "query_id long, tenant_id string, space_id string")
        return {r["chunk_id"]: round(r["score"], 6) for r in retrieval.websearch(live, asked, scope).collect()}

    return run


def test_phrases_need_their_words_side_by_side(found):
    assert set(found("quick brown")) == {"c1", "c2", "c3"}
    assert set(found('"quick brown"')) == {"c1", "c3"}
    assert found('"brown quick"') == {"c2": 0.1, "c3": 0.1}
    assert set(found('"quick brown" bear')) == {"c3"}
    assert set(found("quick-brown")) == {"c1", "c3"}
    assert found('"the the"') == {}


def test_exclusions_and_alternatives(found):
    assert set(found("brown -lazy")) == {"c2", "c3"}
    assert set(found('brown -"quick brown"')) == {"c2", "c4"}
    assert set(found('bear or "lazy dog"')) == {"c1", "c3"}
    assert found("-brown") == {} and found("") != {} and found("…") == {}
    # a word and a phrase that begins with it stand at one place
    assert found('"quick brown" quick')["c1"] == 0.1


def test_literal_matches_outrank_covers(found):
    assert found("lazy dog") == {"c1": 0.75}
    assert found("Title of c4")["c4"] == 0.95


def test_runs_of_cjk_are_pairs_and_words_stay_words(spark):
    cases = {"Redis故障处理 OK": ["redis", "故障", "障处", "处理", "ok"], "单": ["单"], "カナ한국어x": ["カナ", "ナ한", "한국", "국어", "x"], "plain Text-9": ["plain", "text", "9"], "": [], "…": []}
    rows = spark.createDataFrame([(s,) for s in cases], "s string").select("s", tx.analysed(F.col("s")).alias("t")).collect()
    assert {r["s"]: r["t"] for r in rows} == cases


def test_a_part_of_a_run_is_found_by_bm25(spark):
    chunks = spark.createDataFrame([("c1", "t", "数据库故障处理手册"), ("c2", "t", "用户中心"), ("c3", "t", "故 障")], "chunk_id string, tenant_id string, content string")
    asked = spark.createDataFrame([(1, "t", "故障处理")], "query_id long, tenant_id string, normalised string")
    got = retrieval.bm25(retrieval.postings(chunks), retrieval.query_terms(asked), retrieval.index_stats(chunks)).collect()
    assert [r["chunk_id"] for r in got] == ["c1"]


def test_postings_of_asked_terms_are_those_of_the_whole_index(spark):
    rows = spark.createDataFrame([("c1", "t", "a b a 依赖关系"), ("c2", "t", "b c"), ("c3", "t", None)], "chunk_id string, tenant_id string, content string")
    asked = spark.createDataFrame([("a",), ("赖关",), ("a",), ("z",)], "term string")
    plain = lambda found: sorted(tuple(r[c] for c in ("chunk_id", "term", "tf", "length")) for r in found.collect())
    want = [x for x in plain(retrieval.postings(rows)) if x[1] in ("a", "赖关")]
    assert plain(retrieval.postings(rows, asked=asked)) == plain(retrieval.postings(retrieval.with_terms(rows, "content"), asked=asked)) == want == [("c1", "a", 2, 6), ("c1", "赖关", 1, 6)]
    assert retrieval.index_stats(rows).collect() == retrieval.index_stats(retrieval.with_terms(rows, "content")).collect()
