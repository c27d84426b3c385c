"""The five stages of the pipeline, each on what its predecessor kept, and the whole run."""

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(6)
    sentence = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(800)}" for _ in range(n))
    passage = "\n".join(sentence(8) for _ in range(4))
    rows, labels = [], []
    for i in range(240):
        toxic = i % 6 == 0
        lines = [sentence(10) for _ in range(6)]
        if toxic:
            lines[2] += " vermin rotten scoundrel vermin"
        elif i % 10 == 1:
            lines[3:3] = passage.split("\n")
        rows.append([i, "\n".join(lines)])
        labels.append((i, int(toxic)))
    for k in range(12):  # near copies, one word of 60 changed, of clean documents
        rows[12 * k + 2][1] = rows[12 * k + 2][1].replace("\n", " ")  # one line: no window repeats
        words = rows[12 * k + 2][1].split(" ")
        words[30] = "changed"
        rows.append([500 + k, " ".join(words)])
    rows = [(i, t, "en", ["s0", "s0", "s1", None][i % 4], len(t)) for i, t in rows] + [(900, None, None, None, None), (901, "", "en", "s0", 0), (2, rows[2][1], "en", "s1", len(rows[2][1]))]
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, FIELDS).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out)


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    out["documents"] = docs.collect()
    for name, stage in pipeline.STAGES:
        docs = pipeline.write_stage(stage(spark, docs, sf_dir), "test-" + name.replace(" ", "-"))
        out[name] = docs.collect()
    return out


def test_toxic_documents_go_and_clean_ones_stay(stages):
    kept = {r["doc_id"] for r in stages["toxicity"]}
    toxic = {i for i in range(240) if i % 6 == 0}
    assert kept == {r["doc_id"] for r in stages["documents"]} - toxic
    assert [f for f in stages["toxicity"][0].asDict()] == pipeline.COLUMNS


def test_repeated_windows_go(stages):
    from tests.llm.test_operators import dedupe

    rows = [(r["doc_id"], r["text"], r) for r in stages["toxicity"]]
    want = dedupe(rows)
    got = stages["line dedup"]
    assert len(got) == len(rows) and sum(r["text"] is None for r in got) == 1
    texts = sorted((str(r["doc_id"]), r["text"], r["n_chars"]) for r in got if r["text"] is not None)
    assert texts == sorted((str(i), want[(i, t)], len(want[(i, t)])) for i, t, _ in rows if t is not None)
    assert sum(want[(i, t)] != t for i, t, _ in rows if t is not None) >= 15


def test_one_row_of_each_group_stays(stages):
    from tests.llm.test_operators import closure, shingle_set

    rows = [(k, r["doc_id"], shingle_set(r["text"])) for k, r in enumerate(sorted(stages["line dedup"], key=lambda r: (r["doc_id"], str(r["source"]))))]
    linked = [(a, b) for a, _, x in rows for b, _, y in rows if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y)]
    root = closure([k for k, _, _ in rows], linked)
    want = sorted(i for k, i, _ in rows if root[k] == k)
    assert sorted(r["doc_id"] for r in stages["MinHash near-dedup"]) == want and len(want) <= len(rows) - 10


def test_mix_repeats_or_leaves_out_rows(stages):
    before, after = stages["MinHash near-dedup"], stages["mixing sources"]
    assert set(map(tuple, after)) <= set(map(tuple, before))
    words = lambda rows: sum(len((r["text"] or "").split()) for r in rows)
    assert abs(words(after) - 1.5 * words(before)) <= 0.02 * words(before)
    assert max(sum(tuple(x) == tuple(r) for x in after) for r in after[:40]) <= 2


def test_ids_decode_to_the_texts_and_copies_vary(spark, stages):
    from quarry.llm import queries, sentencepiece_bpe

    rows = stages["SentencePiece"]
    assert len(rows) == len(stages["mixing sources"])
    decoded = sentencepiece_bpe.decode(spark.createDataFrame(rows, "doc_id long, source string, copy long, n_tokens long, ids array<int>"), queries.tokenizer_path()).collect()
    assert sorted((r["doc_id"], r["decoded"] or "") for r in decoded) == sorted((r["doc_id"], r["text"] or "") for r in stages["mixing sources"])
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(tuple(r["ids"] or ()))
    twice = [v for v in by_doc.values() if len(v) == 2 and len(v[0]) > 20]
    assert twice and sum(a != b for a, b in twice) > 0.9 * len(twice)


def test_the_run_is_the_stages(spark, sf_dir, stages):
    got = pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, stages["SentencePiece"]), key=str)


def test_an_empty_table_gives_an_empty_result(spark, sf_dir, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
