"""BM25 of the best rows of each request, without a shuffle of postings or pairs."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import retrieval
from quarry.plans.governance import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("fields", [{"content": 1.0}, {"title": 3.0, "content": 1.0}])
def test_the_best_rows_are_those_of_the_whole_index(spark, fields):
    dice = random.Random(7)
    words = lambda n: " ".join(dice.choice("abcdefghij") for _ in range(n))
    data = [(f"c{i:04}", "t", dice.choice("xy"), words(dice.randrange(3)), words(dice.randrange(12))) for i in range(3000)] + [("null", "t", "x", None, None), ("cjk", "t", "x", "", "\u4f9d\u8d56\u5173 a")]
    rows = spark.createDataFrame(data, "chunk_id string, tenant_id string, space_id string, title string, content string").repartition(3)
    asked = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "c"), (3, "z"), (4, "\u8d56\u5173"), (5, "a")], "query_id long, term string")
    reach = spark.createDataFrame([(1, "t", "x"), (1, "t", "y"), (2, "t", "y"), (3, "t", "x"), (4, "t", "x"), (5, "u", "x")], "query_id long, tenant_id string, space_id string")
    found = retrieval.found_terms(rows.select("chunk_id", "tenant_id", "space_id", *fields), asked, *fields)
    got = retrieval.bm25_best(found, asked, reach, fields, 7, ["tenant_id", "space_id"]).collect()

    whole = None
    for f, w in fields.items():
        part = retrieval.bm25(retrieval.postings(rows, f), asked, retrieval.index_stats(rows, f)).withColumn("raw_score", F.col("raw_score") * w)
        whole = part if whole is None else whole.unionByName(part)
    whole = whole.groupBy("query_id", "chunk_id").agg(F.round(F.max("raw_score"), 9).alias("raw_score"))
    want = retrieval.top_candidates(whole.join(rows, "chunk_id").join(reach, ["query_id", "tenant_id", "space_id"], "left_semi"), F.lit(7)).collect()
    plain = lambda found: sorted((r["query_id"], r["rank"], r["chunk_id"], r["raw_score"], r["space_id"]) for r in found)
    assert plain(got) == plain(want) and {r["query_id"] for r in got} == {1, 2, 4}


def test_a_task_hands_on_its_best_alone(spark):
    rows = spark.range(0, 50_000, 1, 2).select((F.col("id") % 3).alias("query_id"), F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("chunk_id"), (F.col("id") * 7919 % 1000).cast("double").alias("raw_score"))
    best = retrieval.best_of_tasks(rows, 5)
    assert best.count() == 2 * 3 * 5
    want = retrieval.top_candidates(rows.where("raw_score > 0"), F.lit(5))
    assert sorted(map(tuple, retrieval.top_candidates(best, F.lit(5)).collect())) == sorted(map(tuple, want.select("query_id", "chunk_id", "raw_score", "rank").collect()))


@pytest.mark.parametrize("name", ["bm25_topk", "bm25_best_fields_topk", "cjk_bm25_topk", "keyword_websearch_topk"])
def test_no_chunk_is_shuffled_by_its_id(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and not [x for x in plan.splitlines() if "hashpartitioning" in x and "chunk_id" in x]
