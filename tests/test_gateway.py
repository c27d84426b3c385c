"""Vector search by blocks against brute force; retrievals with channels that fail, stray or are missing; traces."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import gateway, retrieval, vectors


def cosines(asked, rows, limit):
    out = []
    for q, space, own, v in asked:
        found = []
        for i, of, w in rows:
            if of == space and i != own and v is not None and w is not None and np.linalg.norm(v) > 0 and np.linalg.norm(w) > 0:
                found.append((-round(float(np.dot(v, w) / np.sqrt(np.dot(v, v) * np.dot(w, w))), 9), i))
        out += [(q, i, -s, k + 1) for k, (s, i) in enumerate(sorted(found)[:limit])]
    return sorted(out)


@pytest.mark.parametrize("block", [3, 1024])
def test_blocks_give_what_brute_force_gives(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "ASKED", 2)
    rng = np.random.default_rng(1)
    rows = [(f"c{i:03}", "hot" if i % 3 else f"s{i % 4}", rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(90)]
    rows += [("null", "hot", None), ("zero", "hot", [0.0] * 4), *[(f"same{i}", "hot", [1.0, 1.0, 0.0, 0.0]) for i in range(12)]]
    asked = [(i, s, i_, v) for i, (i_, s, v) in enumerate(rows) if i % 5 == 0] + [(500, "hot", None, None), (501, "none", None, [1.0] * 4), (502, "hot", None, [0.0] * 4), (503, "hot", None, [1.0, 1.0, 0.0, 0.0])]
    frame = spark.createDataFrame(asked, "query_id long, space string, self_id string, vector array<double>").withColumn("limit", F.lit(7))
    index = spark.createDataFrame(rows, "id string, space string, vector array<double>")
    best = vectors.top_k(frame, index, ["space"], digits=9)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = sorted((r["query_id"], r["id"], round(r["raw_score"], 9), r["rank"]) for r in best.collect())
    assert got == [(q, i, round(s, 9), k) for q, i, s, k in cosines(asked, rows, 7)]
    assert vectors.top_k(frame.limit(0), index, ["space"]).count() == vectors.top_k(frame, index.limit(0), ["space"]).count() == 0


def test_a_contract_holds_the_width_of_its_vectors(spark):
    vectors.HASHING.check(256)
    with pytest.raises(ValueError, match="256 numbers, not 16"):
        vectors.HASHING.check(16)


def test_rare_words_weigh_more(spark):
    index = spark.createDataFrame([(i, "t", "s", f"common word number{i % 2} " + ("rare" if i == 3 else "plain")) for i in range(8)], "i int, tenant_id string, space_id string, content string")
    index = retrieval.text_index(index.withColumn("chunk_id", F.concat(F.lit("c"), F.col("i").cast("string"))))
    asked = spark.createDataFrame([(1, "t", "s", "rare common", 3), (2, "t", "s", "…", 3)], "query_id long, tenant_id string, space_id string, normalised string, candidate_limit int")
    got = retrieval.text_channel(asked, index).orderBy("rank").collect()
    assert [r["query_id"] for r in got] == [1, 1, 1] and got[0]["chunk_id"] == "c3" and got[0]["score"] > 1.5 * got[1]["score"]


# ---- gateway


@pytest.fixture(scope="module")
def world(spark):
    spaces = spark.createDataFrame([("t", "s1", "One", "ACTIVE"), ("t", "s2", "Two", "ACTIVE"), ("x", "s1", "Other", "ACTIVE")], "tenant_id string, space_id string, name string, status string")
    grants = spark.createDataFrame([("t", "s1", "USER", "u", "READ"), ("x", "s1", "USER", "u", "READ")], "tenant_id string, space_id string, subject_type string, subject_id string, permission string")
    rows = [(f"c{t}{s}{i}", t, s, f"d{t}{s}{i}", f"r{t}{s}{i}", i, f"alpha text {i}", f"h{i}", "en" if i else "de", f"Title {i}", 50, "u", "API") for t, s in (("t", "s1"), ("t", "s2"), ("x", "s1")) for i in range(3)]
    live = spark.createDataFrame(rows, "chunk_id string, tenant_id string, space_id string, document_id string, revision_id string, ordinal int, content string, content_hash string, language string, title string, authority int, source_uri string, source_type string")
    heads = live.select("tenant_id", "document_id", "revision_id").distinct().withColumn("status", F.lit("ACTIVE"))
    return gateway.Tables(spaces, grants, heads, live)


def requests(spark, rows):
    return spark.createDataFrame(rows, "query_id long, tenant_id string, principal_id string, text string, top_k int, filters map<string,string>")


def run(spark, world, gate, rows):
    asked = requests(spark, rows)
    principals = asked.select("query_id", "tenant_id", "principal_id", F.lit("ACTIVE").alias("status"), F.array().cast("array<string>").alias("roles"), F.lit(False).alias("is_system"))
    return gate.retrieve(asked, principals, asked.limit(0).select("query_id", F.lit("").alias("space_id")), world)


def raises(asked, tables):
    raise ConnectionError("the store is away")


def outcomes(found):
    return {r["query_id"]: (r["outcome"], r["n_evidence"]) for r in found.bundles.collect()}


ASKED = [(1, "t", "u", "alpha", 5, {}), (2, "t", "nobody", "alpha", 5, {}), (3, "t", "u", " ", 5, {}), (4, "t", "u", "alpha", 101, {}), (5, "t", "u", "alpha", 5, {"language": "de"}), (6, "t", "u", "alpha", 5, {"colour": "red"}), (7, "t", "u", "alpha", 5, {"language": " "})]


def test_outcomes_filters_and_statuses(spark, world):
    found = run(spark, world, gateway.default_gateway(), ASKED)
    assert outcomes(found) == {1: ("OK", 3), 2: ("DENY_ALL", 0), 3: ("INVALID", 0), 4: ("INVALID", 0), 5: ("OK", 1), 6: ("INVALID", 0), 7: ("INVALID", 0)}
    statuses = {(r["query_id"], r["channel"]): (r["status"], r["warning"]) for r in found.statuses.collect()}
    assert statuses == {
        (1, "KEYWORD"): ("OK", None), (1, "VECTOR"): ("OK", None), (1, "GRAPH"): ("NOT_CONFIGURED", "RETRIEVER_GRAPH_UNAVAILABLE"),
        (5, "KEYWORD"): ("OK", None), (5, "VECTOR"): ("FAILED", "RETRIEVER_VECTOR_UNAVAILABLE"), (5, "GRAPH"): ("NOT_CONFIGURED", "RETRIEVER_GRAPH_UNAVAILABLE"),
    }


def test_a_channel_that_raises_fails_alone(spark, world):
    gate = gateway.Gateway().register("KEYWORD", gateway.Channel(gateway.keyword_channel)).register("VECTOR", gateway.Channel(raises))
    found = run(spark, world, gate, ASKED[:1])
    assert outcomes(found) == {1: ("OK", 3)}
    assert {r["channel"]: r["status"] for r in found.statuses.collect()} == {"KEYWORD": "OK", "VECTOR": "FAILED", "GRAPH": "NOT_CONFIGURED"}
    steps = {r["step_name"]: (r["output_count"], r["status"]) for r in found.steps.collect()}
    assert steps["VECTOR"] == (0, "FAILED") and steps["KEYWORD"] == (3, "OK") and steps["EVIDENCE"] == (3, "OK")
    # a channel whose rows fail when they are made fails alone as well
    late = gateway.Gateway().register("KEYWORD", gateway.Channel(gateway.keyword_channel)).register("GRAPH", gateway.Channel(lambda a, t: gateway.keyword_channel(a, t).withColumn("score", F.raise_error(F.lit("late")).cast("double"))))
    assert {r["channel"]: r["status"] for r in run(spark, world, late, ASKED[:1]).statuses.collect()}["GRAPH"] == "FAILED"
    none = gateway.Gateway().register("KEYWORD", gateway.Channel(raises))
    assert outcomes(run(spark, world, none, ASKED[:2])) == {1: ("OK", 0), 2: ("DENY_ALL", 0)}
    with pytest.raises(ValueError, match="is registered"):
        gate.register("VECTOR", gateway.Channel(raises))


@pytest.mark.parametrize("change", [{"tenant_id": "x"}, {"space_id": "s2"}, {"document_id": "other"}])
def test_a_stray_candidate_or_a_second_identity_fails_the_request(spark, world, change):
    def stray(asked, tables):
        rows = gateway.keyword_channel(asked, tables)
        for name, value in change.items():
            rows = rows.withColumn(name, F.when(F.col("query_id") == 1, value).otherwise(F.col(name)))
        return rows

    gate = gateway.Gateway().register("KEYWORD", gateway.Channel(gateway.keyword_channel)).register("GRAPH", gateway.Channel(stray))
    found = run(spark, world, gate, [ASKED[0], (8, "t", "u", "alpha", 5, {})])
    assert outcomes(found) == {1: ("FAILED", 0), 8: ("OK", 3)}


def test_traces_have_ids_of_their_own_hashes_and_times(spark, world):
    ticks = iter(range(1000))
    gate = gateway.Gateway(clock=lambda: next(ticks)).register("KEYWORD", gateway.Channel(gateway.keyword_channel))
    found = run(spark, world, gate, ASKED[:2])
    rows = found.traces.collect()
    assert [r["request_id"] for r in rows] == [r["request_id"] for r in found.traces.collect()] and len({r["request_id"] for r in rows}) == 2
    assert "text" not in found.traces.columns and "normalised" not in found.traces.columns and all(len(r["query_hash"]) == 64 and r["total_duration_ms"] > 6000 for r in rows)
    steps = found.steps.where("query_id = 1").orderBy("ordinal").collect()
    assert [s["step_name"] for s in steps] == ["ACCESS", "PLAN", "KEYWORD", "GUARD", "FUSE", "EVIDENCE"] and all(s["duration_ms"] == 1000 for s in steps)


def test_a_batch_without_requests(spark, world):
    found = run(spark, world, gateway.default_gateway(), [])
    assert found.bundles.count() == found.statuses.count() == found.steps.count() == found.traces.count() == 0
