"""What operators leave in Python workers, which Spark keeps for later stages, and how many they take."""

import numpy as np
import pandas as pd
import pytest

from quarry.llm import minhash, mixing, sentencepiece_bpe
from quarry.llm.bloom import build_filter


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_encoder_of_copies_goes_with_its_task(spark):
    model_path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(i, f"some words of text {i % 7}") for i in range(200)], "doc_id long, text string")
    assert sentencepiece_bpe.encode(docs, model_path, 0.1, 3, copies=True).where("n_tokens > 0").count() == 200

    def held(batches):
        from quarry.llm import sentencepiece_bpe as module

        for pdf in batches:
            yield pd.DataFrame({"n": [len(module._ENCODERS)] * len(pdf)})

    # workers take turns; more rounds than an executor keeps workers
    assert {r["n"] for _ in range(4) for r in spark.range(0, 64, 1, 16).mapInPandas(held, "n int").collect()} == {0}


@pytest.mark.parametrize("rows", [[], [(None, 40, 3)], [("a", 5, 2), ("b", 9, 1), (None, 7, 4)]])
def test_rounds_of_the_mix_read_their_rows_without_python(spark, rows):
    cells = spark.createDataFrame(rows, "source string, size long, n long")
    totals = {s: size * n for s, size, n in rows}
    targets = mixing.source_targets(totals)
    by_source = spark.createDataFrame([(s, float(targets[s]), totals[s], float(size)) for s, size, n in rows], "source string, target double, source_size long, scale double")
    tilts = mixing.solve_tilts(cells, by_source)
    assert "ExistingRDD" not in plan_of(tilts)
    assert tilts.dtypes == [("source", "string"), ("lam", "double")]
    found = {r["source"]: r["lam"] for r in tilts.collect()}
    assert found.keys() == totals.keys()
    for s, size, n in rows:
        assert min(2.0, np.exp(min(50.0, found[s]))) * n * size == pytest.approx(targets[s])


def test_filter_and_sets_of_near_dedup_are_made_in_two_stages(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    clustered = spark.createDataFrame([(3, 1), (5, 1)], "id long, node long")
    keys = clustered.selectExpr("xxhash64(id) as key_hash")
    texts = minhash._clustered_texts(docs, clustered, build_filter(keys, 2))
    assert sorted(r["text"] for r in texts.collect()) == ["text 3", "text 5"]
    assert "SortMergeJoin" in plan_of(texts) and "BroadcastHashJoin" not in plan_of(texts)
