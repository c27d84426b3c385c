"""Nulls, empty tables, long texts, ties, repeated rows and clashing names, operator by operator."""

import random

import numpy as np
import pytest

from quarry.llm import chroma, hmm, language, line_dedup, minhash, mixing, pivot_index, sentencepiece_bpe, toxicity, url_filter

CLASHING = "row own_id own_key own_url own_grp of_doc of_key of_url of_source of_size of_grp luck base copy said said_ text_key removed doc node grp last_luck key".split()
RULES = [("allow", "org", "/"), ("block", "com", "/de/")]


@pytest.fixture(scope="module")
def model_path():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def docs_of(spark, rows, extra=CLASHING):
    """Documents with a column of its own value for each name that an operator might use inside."""
    fields = "doc_id long, text string, lang string, source string" + "".join(f", {c} string" for c in extra)
    return spark.createDataFrame([(*r, *(f"{c}-{r[0]}" for c in extra)) for r in rows], fields)


def base_rows():
    rng = random.Random(1)
    rows = [(i, "\n".join(" ".join(f"w{rng.randrange(90)}" for _ in range(9)) for _ in range(4)), "en" if i % 2 else "fr", f"s{i % 3}") for i in range(24)]
    rows += [(100, None, None, None), (101, "", "en", "s0"), (None, "a null id has text", "fr", "s1"), rows[0], rows[0]]
    return rows


def operators(spark, model_path):
    marks = lambda docs: docs.select("doc_id", (docs["doc_id"] % 2).cast("int").alias("toxic"))
    return {
        "toxicity": lambda d: toxicity.judge(d, marks(d)),
        "language": language.identify,
        "line_dedup": line_dedup.dedupe_lines,
        "mix": mixing.mix,
        "urls": lambda d: url_filter.judge_urls(d.withColumnRenamed("text", "url"), RULES, spark.createDataFrame([("http://a.b/c",)], "url string")).withColumnRenamed("url", "text"),
        "sentencepiece": lambda d: sentencepiece_bpe.decode(sentencepiece_bpe.encode(d, model_path, 0.1, 3), model_path),
    }


@pytest.mark.parametrize("name", ["toxicity", "language", "line_dedup", "mix", "urls", "sentencepiece"])
def test_extra_columns_pass_through_whatever_their_names(spark, model_path, name):
    rows = base_rows()
    got = operators(spark, model_path)[name](docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert all(r[c] == f"{c}-{r['doc_id']}" for c in CLASHING)
    # repeated rows have equal results
    assert len({str(r) for r in got if r["doc_id"] == 0}) == 1


@pytest.mark.parametrize("name", ["toxicity", "language", "line_dedup", "mix", "urls", "sentencepiece"])
def test_empty_tables_give_empty_results(spark, model_path, name):
    assert operators(spark, model_path)[name](docs_of(spark, base_rows()).limit(0)).count() == 0


def test_hmm_and_near_duplicates_ignore_extra_columns_and_take_empty_tables(spark):
    docs = docs_of(spark, base_rows())
    assert hmm.score_held_out(docs).count() == minhash.near_duplicates(docs).count() == len(base_rows())
    assert hmm.score_held_out(docs.limit(0)).count() == minhash.near_duplicates(docs.limit(0)).count() == minhash.keep_one(docs.limit(0)).count() == 0


def test_keep_one_decides_on_rows(spark):
    n, m, k = "one two three four five six seven", "north south east west up down left right", "k l m n o p q r s t u v"
    rows = [(7, n), (5, m), (7, m), (9, k), (9, k), (None, k), (3, None), (3, None), (4, "")]
    docs = docs_of(spark, [(i, t, "en", "s") for i, t in rows])
    got = minhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(7, n), (5, m), (9, k), (None, k), (3, None), (3, None), (4, "")], key=str)


def test_minhash_keeps_texts_of_one_doc_id_apart(spark):
    n, m = "one two three four five six seven", "north south east west up down left right"
    got = minhash.near_duplicates(spark.createDataFrame([(5, n), (5, m), (6, n), (7, m)], "doc_id long, text string"))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == [(5, 3, 5), (5, 4, 5), (6, 3, 5), (7, 4, 5)]


def test_pivot_index_keeps_vectors_of_one_id_apart(spark):
    rows = [(5, [1.0, 0.0], 1, "a"), (5, [0.0, 1.0], 1, "b"), (6, [1.0, 0.001], 1, "c"), (7, [0.001, 1.0], 1, "d"), (8, [-1.0, 0.0], 1, "e"), (8, [-1.0, 0.0], 1, "e")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in pivot_index.near_vectors(vectors).collect())
    assert got == [(5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (7, 1, 5, False), (8, 1, 8, True), (8, 1, 8, True)]
    assert pivot_index.near_vectors(vectors.limit(0)).count() == 0


def test_pivot_index_at_exactly_the_bound(spark):
    other = [0.98, float(np.sqrt(1 - 0.98**2)), 0.0]
    rows = [(1, [1.0, 0.0, 0.0], 1), (2, other, 1), (3, [0.979, float(np.sqrt(1 - 0.979**2)), 0.0], 2), (4, [2.0, 0.0, 0.0], 2)]
    got = {r["vec_id"]: r["n_links"] for r in pivot_index.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got[3] == got[4] == 0 and got[1] == got[2]


def test_pivot_index_recall_on_planted_pairs(spark):
    rng = np.random.default_rng(12)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    n, pairs = 20_000, 3_000
    x = unit(rng.normal(size=(n, 64)))
    angle = np.arccos(rng.uniform(0.98, 0.999, pairs))[:, None]
    side = unit(rng.normal(size=(pairs, 64)))
    side = unit(side - (side * x[:pairs]).sum(axis=1, keepdims=True) * x[:pairs])
    x[pairs : 2 * pairs] = np.cos(angle) * x[:pairs] + np.sin(angle) * side
    rows = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    got = pivot_index.near_vectors(rows.repartition(8)).toPandas().set_index("vec_id").reindex(range(n))
    y = unit(x)
    want = np.concatenate([(y[i : i + 2000] @ y.T >= 0.98).sum(axis=1) - 1 for i in range(0, n, 2000)])
    assert (got["n_links"].to_numpy() <= want).all() and want.sum() >= 2 * pairs - 20
    assert got["n_links"].sum() >= 0.98 * want.sum()


def test_language_ties_and_repeats(spark):
    """Two languages of one family with the same texts: the decision is the same in every run."""
    rows = [(i, "the wished thing", g) for i in range(40) for g in (["en", "de"][i % 2],)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a, b = ({(r["doc_id"], r["lang_pred"], round(r["score"], 6)) for r in language.identify(docs.repartition(n)).collect()} for n in (1, 4))
    assert a == b and len({x[1] for x in a}) == 1
    doubled = docs.union(docs)
    assert language.identify(doubled).count() == 80
    assert {r["lang_pred"] for r in language.identify(doubled).collect()} == {x[1] for x in a}


def test_language_decisions_match_a_dense_computation(spark):
    from tests.llm.test_operators import language_rows

    docs = spark.createDataFrame(language_rows(), "doc_id long, text string, lang string")
    model = language.fit(docs)
    index = {g: i for i, g in enumerate(model["features"])}
    for r in language.predict(docs.limit(30), model).collect():
        x = np.zeros(len(index))
        for w in r["text"].lower().split():
            for n in (1, 2, 3, 4):
                for i in range(len(w) + 3 - n):
                    g = f"<{w}>"[i : i + n]
                    if g in index:
                        x[index[g]] += 1
        margins = x / x.sum() @ model["weights"] + model["bias"]
        lang, score = language.decide(model, margins)
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score)


def test_very_long_texts(spark, model_path):
    rng = random.Random(2)
    long = "\n".join(" ".join(f"w{rng.randrange(5000)}" for _ in range(12)) for _ in range(20_000))
    rows = [(1, long, "en", "s0"), (2, long + "\nend", "en", "s0"), (3, "short text of a few words", "fr", "s1"), (4, "another short one", "fr", "s1"), (5, "x" * 300_000, "en", "s0")]
    docs = docs_of(spark, rows, [])
    for name, run in operators(spark, model_path).items():
        assert run(docs).count() == 5, name
    removed = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedupe_lines(docs).collect()}
    assert removed == {1: 0, 2: 20_000, 3: 0, 4: 0, 5: 0}
    assert {r["doc_id"]: r["n_tokens"] for r in hmm.score_held_out(docs).collect()}[1] == 240_001
    assert sorted(r["doc_id"] for r in minhash.keep_one(docs).collect()) == [1, 3, 4, 5]


def test_mix_matches_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), "en", ["a", "b", "é", None][i % 4]) for i in range(400)]
    got = mixing.mix(docs_of(spark, rows, [])).collect()
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    weights = dict(zip(["a", "b", "é", None], [5, 2, 1, 5], strict=True))
    left, open_, target = 1.5 * sum(sizes.values()), set(weights), {}
    while open_:
        share = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 2 * sizes[s]}
        target |= {s: 2 * sizes[s] for s in full} if full else share
        left, open_ = left - sum(2 * sizes[s] for s in full), open_ - full if full else set()
    for s in weights:
        own = [len(t.split()) for _, t, _, x in rows if x == s]
        lo, hi = -50.0, 50.0
        for _ in range(200):
            lam = (lo + hi) / 2
            total = sum(n * min(2, np.exp(min(50, lam * n / (sizes[s] / len(own))))) for n in own)
            lo, hi = (lam, hi) if total < target[s] else (lo, lam)
        for r in (r for r in got if r["source"] == s):
            assert r["size"] == len(r["text"].split()) and r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s])
            assert r["rate"] == pytest.approx(min(2, np.exp(min(50, lam * r["size"] / (sizes[s] / len(own))))), abs=1e-6)
        taken = sum(r["copies"] * r["size"] for r in got if r["source"] == s)
        assert abs(taken - target[s]) <= 2


def test_sonify_and_fingerprint_inputs(spark):
    rows = [(1, [0.5, -1.0] * 40, "x"), (1, [0.5, -1.0] * 40, "x"), (2, None, "x"), (3, [], "x"), (4, [0.0] * 8, "x"), (5, [None, float("nan"), 1.0], "x"), (None, [1.0, 2.0], "x")]
    tunes = chroma.sonify(spark.createDataFrame(rows, "vec_id long, embedding array<double>, audio string"))
    prints = chroma.fingerprint(tunes)
    got = [(r["vec_id"], len(r["fingerprint"])) for r in prints.collect()]
    assert len(got) == 7 and all(n == 0 for i, n in got if i in (2, 3, 4)) and [n for i, n in got if i == 1][0] > 50
    ids = prints.selectExpr("vec_id as id", "fingerprint")
    assert chroma.align(ids, ids).count() == 0
    assert chroma.align(ids.limit(0), ids).count() == chroma.fingerprint(tunes.limit(0)).count() == 0


def test_copies_of_a_document_draw_for_themselves(spark, model_path):
    from pyspark.sql import functions as F

    rows = [(i, "internationalization and understanding") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    got = sentencepiece_bpe.encode(docs, model_path, 0.3, 3, turns=True)
    assert len({tuple(r["ids"]) for r in got.collect()}) > 100
    same = got.groupBy("doc_id").agg(F.count_distinct("ids").alias("n")).where("n = 2").count()
    assert same > 200
    assert {tuple(r["ids"]) for r in got.where("copy = 1").collect()} == {tuple(r["ids"]) for r in sentencepiece_bpe.encode(docs.where("copy = 1"), model_path, 0.3, 3).collect()}
