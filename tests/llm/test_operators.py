"""The ten operators against brute force, on small tables with nulls, ties, repeats and empty rows."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import bloom, chroma, components, hmm, language, line_dedup, minhash, mixing, pivot_index, sentencepiece_bpe, toxicity, url_filter
from quarry.llm.common import shingles

DOCS = "doc_id long, text string, extra string"


def words(text):
    return text.encode().lower().split() if text else []


def rand_text(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def closure(ids, linked):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def test_components_follow_long_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(60)]
    hub = [(100, 100 + i) for i in range(1, 80)]
    edges = spark.createDataFrame(chain + hub + [(7, 7), (7, 6), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {100 + i: 100 for i in range(1, 80)}
    assert components.connected_components(edges.limit(0)).count() == 0


def near_rows():
    rng = random.Random(3)
    rows = []
    for k in range(30):
        base = rand_text(rng, 60 + 10 * k).split()
        rows.append((k * 10, " ".join(base), "x"))
        for c in range(1, 4):
            copy = list(base)
            for _ in range(c):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(9)}"
            rows.append((k * 10 + c, " ".join(copy), None))
    common = rand_text(rng, 40)
    rows += [(1000 + i, common + " " + rand_text(rng, 60), None) for i in range(40)]
    rows += [(2000 + i, "same text of six words here", None) for i in range(50)]
    rows += [(3000, None, None), (3001, "", None), (3002, " \t\n", None), (3003, "two words", None), (3004, "Two  words", None), (None, "two words", None), (3005, rand_text(rng, 30_000), None)]
    return rows + [rows[0], rows[0]]


def test_minhash_matches_brute_force(spark):
    rows = near_rows()
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), percent=85).collect()
    assert len(got) == len(rows)
    sets = {i: shingle_set(t) for i, t, _ in rows if i is not None}
    ids = sorted(sets)
    linked = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    root = closure(ids, linked)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), root[r["doc_id"]], root[r["doc_id"]] == r["doc_id"])


def test_minhash_on_an_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_shingles_of_short_texts():
    assert len(shingles(None)) == len(shingles(" ")) == 0
    assert len(shingles("a b")) == len(shingles("a b c d e")) == 1
    assert len(shingles("a b c d e f")) == 2
    assert not set(shingles("a b")) & set(shingles("b a"))


def dedupe(rows):
    seen, out = {}, {}
    order = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0]))
    for i, t in order:
        lines = t.split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if seen.setdefault(w, (i, p)) != (i, p):
                gone |= {p, p + 1, p + 2}
        out[(i, t)] = "\n".join(x for p, x in enumerate(lines) if p not in gone)
    return out


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(5)
    passages = ["\n".join(f"line {rng.randrange(1000)}" for _ in range(5)) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = ["\n".join(f"own {i} {k}" for k in range(rng.randrange(4)))] + rng.sample(passages, 2) + [f"end {i}"]
        rows.append((i, "\n".join(p for p in parts if p), str(i)))
    rows += [(100, None, ""), (101, "", ""), (102, "a\nb", ""), (103, "a\na\na\na", ""), (104, "x\ny\nx\ny\nx", ""), (None, passages[0], ""), (105, "\n\n\n", "")]
    rows.append(rows[0])
    got = line_dedup.dedupe_lines(spark.createDataFrame(rows, "doc_id long, text string, removed string")).collect()
    want = dedupe(rows)
    assert len(got) == len(rows)
    texts = sorted((str(r["doc_id"]), r["text"]) for r in got if r["text"] is not None)
    assert texts == sorted((str(i), want[(i, t)]) for i, t, _ in rows if t is not None)
    assert sum(r["text"] is None for r in got) == 1


def test_line_dedup_plan_has_no_python(spark):
    plan = line_dedup.dedupe_lines(spark.createDataFrame([(1, "a\nb\nc")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert line_dedup.dedupe_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_targets_reshare_the_excess():
    t = mixing.source_targets({"a": 10, "b": 100, None: 100})
    assert t["a"] == 20 and abs(t["b"] - 295 * 2 / 3) < 1e-9 and abs(t[None] - 295 / 3) < 1e-9
    full = mixing.source_targets({"a": 10, "b": 10, "c": 1000})
    assert full["a"] == full["b"] == 20 and abs(full["c"] - 1490) < 1e-9
    assert mixing.source_targets({}) == {}


def test_mix_meets_targets_and_reruns_agree(spark):
    rng = random.Random(7)
    rows = [(i, rand_text(rng, int(rng.lognormvariate(4, 1))), f"s{min(rng.randrange(9), 4)}", 1) for i in range(600)]
    rows += [(1000 + i, rand_text(rng, 50, 1), "s0", 1) for i in range(200)]
    rows += [(2000, None, "s1", 1), (2001, "", None, 1), (2002, "only one", None, 1), (2003, "a b", "s9", 1), (2003, "a b", "s9", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rate int").repartition(5)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()), key=str)
    sums = {}
    for r in got:
        assert 0 <= r["copies"] <= 2 and r["size"] == len(words(r["text"]))
        one = sums.setdefault(r["source"], [r["target"], 0, r["source_size"]])
        one[1] += r["copies"] * r["size"]
    assert abs(sum(t for t, _, _ in sums.values()) - 1.5 * sum(r["size"] for r in got)) < 1e-6
    for source, (target, taken, size) in sums.items():
        assert abs(taken - target) <= max(3, 0.01 * target), source
    assert mixing.repeat_rows(mixing.mix(docs)).count() == sum(r["copies"] for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_tilts_solve_the_dual(spark):
    cells = spark.createDataFrame([("a", s, 3) for s in (1, 5, 20, 80)] + [(None, 10, 4)], "source string, size long, n long")
    targets = spark.createDataFrame([("a", 318, 200.0, 26.5), (None, 40, 60.0, 10.0)], "source string, source_size long, target double, scale double")
    lam = {r["source"]: r["lam"] for r in mixing.solve_tilts(cells, targets).collect()}
    got = sum(3 * s * min(2, np.exp(lam["a"] * s / 26.5)) for s in (1, 5, 20, 80))
    assert abs(got - 200) < 1e-5 and abs(40 * np.exp(lam[None]) - 60) < 1e-5


def toxic_rows(n=400):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        w = rand_text(rng, 40).split()
        toxic = i % 4 == 0
        if toxic:
            w[5:5] = ["rotten" + rng.choice(["er", "ly", ""]), "vermin"]
        if toxic or i % 5 == 0:
            w.insert(9, rng.choice(["muslim", "christian"]))
        rows.append((i, " ".join(w), None))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_learns_and_ignores_identity_terms(spark):
    rows, labels = toxic_rows()
    rows += [(900, None, "a"), (901, "", "a"), (902, "we met a muslim and a christian", "a"), (903, "you rottenest thing", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.judge(docs, marks).collect()}
    assert len(got) == len(rows)
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i in held)
    assert np.mean([got[i]["predicted"] == (i % 4 == 0) for i in held]) > 0.97
    assert got[900]["score"] == got[901]["score"] < 0.5
    assert got[902]["predicted"] == 0
    model = toxicity.fit(docs, marks)
    gap = [w for f, w in zip(model.features, model.weights, strict=True) if f in ("<muslim>", "<christian>")]
    assert all(abs(g) < 0.3 for g in gap)
    for text in (None, "", "a vermin met RottenEr things. and a muslim", "vermin vermin 12"):
        found = {g for w in re.findall(r"[^\W\d_]+", (text or "").lower()) for n in (4, 5, 6, len(w) + 2) for g in [f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)]}
        want = model.bias + sum(w for f, w in zip(model.features, model.weights, strict=True) if f in found)
        one = spark.createDataFrame([(1, text)], "doc_id long, text string")
        assert toxicity.score(one, model).first()["score"] == pytest.approx(1 / (1 + np.exp(-want)))


def test_toxicity_penalty_shrinks_changes_under_swaps(spark):
    rng = random.Random(21)
    rows, labels = [], []
    for i in range(600):
        w = rand_text(rng, 30).split()
        toxic = i % 3 == 0
        if toxic:
            w[3:3] = ["vermin"]
        if rng.random() < (0.6 if toxic else 0.1):
            w[7:7] = ["muslim."]
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = spark.createDataFrame([x for x in labels if x[0] % 5], "doc_id long, toxic int")
    held = docs.where("doc_id % 5 = 0")
    plain, penalised = (toxicity.fit(docs, train, counterfactual=c) for c in (0.0, toxicity.COUNTERFACTUAL))
    assert plain.pairs == penalised.pairs >= 480
    (n, before), (m, after) = (toxicity.mean_swap_change(held, x) for x in (plain, penalised))
    assert n == m >= 120 and after < 0.2 * before


def test_counterfactuals_swap_or_insert_terms_in_sentences():
    two = toxicity.counterfactuals("A muslim came. Nothing here! The men and a muslim.", "7")
    assert [len(a) for a, _ in two] == [3, 5] and two == toxicity.counterfactuals("A muslim came. Nothing here! The men and a muslim.", "7")
    assert all(len(a - b) == len(b - a) in (1, 2) and "muslim" in a - b for a, b in two)
    [(a, b)] = toxicity.counterfactuals("Nothing here. Nor there", "8")
    assert len(a - b) == len(b - a) == 1 and len(a & b) == 2
    assert toxicity.counterfactuals(None, "9") == toxicity.counterfactuals(" .\n", "9") == []


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.judge(docs, none).first()["score"] == pytest.approx(0.5)
    assert toxicity.judge(docs.limit(0), none).count() == 0


def language_rows():
    rng = random.Random(11)
    parts = {"en": ["the", "ing", "sh", "wh", "ed"], "de": ["sch", "ein", "ung", "ß", "ch"], "es": ["ción", "ñ", "rr", "ar"], "fr": ["eau", "ç", "ê", "que"]}
    return [(i, " ".join("".join(rng.choices(parts[g], k=3)) for _ in range(30)), g) for i in range(240) for g in [list(parts)[i % 4]]]


def test_language_id_on_held_out_rows(spark):
    rows = language_rows() + [(900, None, "en"), (901, "12 34 !", "de"), (902, "the wished", None)]
    got = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [(i, g) for i, _, g in rows[:240] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and np.mean([got[i]["lang_pred"] == g for i, g in held]) > 0.97
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_id_with_one_or_no_language(spark):
    one = spark.createDataFrame([(i, "the wished thing", "en") for i in range(9)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.identify(one).collect()} == {"en"}
    none = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert language.identify(none).first()["lang_pred"] == "und"
    assert language.identify(none.limit(0)).count() == 0


def brute_likelihood(ids, start, move, ratio):
    a = start * ratio[ids[0]]
    for i in ids[1:]:
        a = (a @ move) * ratio[i]
    return np.log(a.sum())


def brute_counts(ids, start, move, ratio):
    k, n = len(move), len(ids)
    a, b = np.zeros((n, k)), np.ones((n, k))
    a[0] = start * ratio[ids[0]]
    for t in range(1, n):
        a[t] = (a[t - 1] @ move) * ratio[ids[t]]
    for t in range(n - 2, -1, -1):
        b[t] = move @ (ratio[ids[t + 1]] * b[t + 1])
    z = a[-1].sum()
    moved = sum(np.outer(a[t], ratio[ids[t + 1]] * b[t + 1]) * move for t in range(n - 1)) / z if n > 1 else np.zeros((k, k))
    emitted = np.zeros((len(ratio), k))
    np.add.at(emitted, ids, a * b / z)
    return a[0] * b[0] / z, moved, emitted


def test_hmm_recursions_match_brute_force(monkeypatch):
    monkeypatch.setattr(hmm, "SEGMENT", 7)
    rng = np.random.default_rng(1)
    start, move, ratio = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.gamma(2, 0.5, (9, 3))
    texts = [rng.integers(0, 9, n).astype(np.int32) for n in (1, 2, 7, 8, 9, 30, 15)]
    total = hmm.forward(hmm.Batch(texts), start, move, ratio)[0]
    assert np.allclose(total, [brute_likelihood(t, start, move, ratio) for t in texts])
    sums = hmm.expected_counts(hmm.Batch(texts), start, move, ratio)[:3]
    want = [sum(x) for x in zip(*[brute_counts(t, start, move, ratio) for t in texts], strict=True)]
    for got, x in zip(sums, want, strict=True):
        assert np.allclose(got, x)
    single = hmm.expected_counts(hmm.Batch(texts), *(p.astype(np.float32) for p in (start, move, ratio)))
    for got, x in zip(single, [*want, total], strict=True):
        assert np.allclose(got, x, rtol=1e-4, atol=1e-4)


def test_hmm_multiplies_matrices_over_middle_segments_only(monkeypatch):
    monkeypatch.setattr(hmm, "SEGMENT", 7)
    widths, products = [], hmm._products
    monkeypatch.setattr(hmm, "_products", lambda *args: (lambda x: widths.append(x[0].shape[2]) or x)(products(*args)))
    rng = np.random.default_rng(1)
    start, move, ratio = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.gamma(2, 0.5, (9, 3))
    for sizes, middle in (((1,), 0), ((1, 2, 8, 9, 15), 0), ((16, 22, 23, 1, 30), 7)):
        texts = [rng.integers(0, 9, n).astype(np.int32) for n in sizes]
        batch = hmm.Batch(texts)
        assert np.allclose(hmm.forward(batch, start, move, ratio)[0], [brute_likelihood(t, start, move, ratio) for t in texts])
        want = [sum(x) for x in zip(*[brute_counts(t, start, move, ratio) for t in texts], strict=True)]
        assert all(np.allclose(a, b) for a, b in zip(hmm.expected_counts(batch, start, move, ratio)[:3], want, strict=True))
        assert set(widths) == {middle}
        widths.clear()


def test_hmm_words_that_tasks_do_not_hold_are_counted_once_a_text():
    v = hmm.Vocabulary([(b"a", 4), (b"", 3)], np.zeros(hmm.TAIL_CLASSES), 9, 4)
    texts = [b"A b a B c", None, b"", b"c c\x0bb"]
    classes = {b"a": 0, b"": 1} | {w: hmm.HEAD_CLASSES + zlib.crc32(w) % hmm.TAIL_CLASSES for w in (b"b", b"c")}
    for _ in range(2):
        n, held, logs, rest, times, ids = (x.to_pylist() for x in hmm._mapped(texts, hmm.Mapper(v)))
        assert (n, held) == ([6, 1, 1, 4], [3, 1, 1, 1])
        assert np.allclose(logs, [2 * np.log10(5) + np.log10(4), *[np.log10(4)] * 3])
        assert [dict(zip(r, t, strict=True)) for r, t in zip(rest, times, strict=True)] == [{b"b": 2, b"c": 1}, {}, {}, {b"c": 2, b"b": 1}]
        assert [np.frombuffer(x, np.int16).tolist() for x in ids] == [[classes[w] for w in words(t.decode() if t else t) + [b""]] for t in texts]


def test_hmm_base_scores_and_gain(spark, monkeypatch):
    monkeypatch.setattr(hmm, "HELD_COUNTS", 50)
    rng = random.Random(13)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{int(rng.expovariate(0.05))}" for _ in range(80)), None) for i in range(150)]
    rows += [(500, None, None), (501, "", None), (502, "Never SEEN\u00a0Words", None), (None, "a1 a2", None), (3, "a1", None)]
    got = hmm.score_held_out(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    tokens = [(i, [*words(t), b""]) for i, t, _ in rows]
    counts = {}
    for i, ts in tokens:
        if zlib.crc32((str(i) if i is not None else "").encode()) % 7 != 2:
            for w in ts:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((len(ts), sum(w in counts for w in ts), round(sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in ts), 6)) for _, ts in tokens)
    assert sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n}
    held = [r for r in got if r["held_out"] and r["n_tokens"] > 10]
    assert held and all(r["score"] > r["base_score"] for r in held)


def test_pivot_index_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    rows, base = [], rng.normal(size=(40, 16))
    for i in range(400):
        x = base[i % 40] + rng.normal(size=16) * (0.02 if i % 3 else 0.6)
        rows.append((i, [float(np.float32(v)) for v in x], i % 4 % 3))
    bad = [None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] * 16, [float("inf")] * 16]
    rows += [(1000 + i, b, 1) for i, b in enumerate(bad)] + [(1010, rows[0][1], None), (None, rows[0][1], 0), (1011, rows[0][1], 0), (1012, rows[0][1][:8], 0)]
    got = pivot_index.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == len(rows)
    good = {i: (np.array(x), g) for i, x, g in rows if i is not None and g is not None and (i < 1000 or i >= 1010)}
    unit = {i: x / np.linalg.norm(x) for i, (x, _) in good.items()}
    linked = [(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98]
    root, n = closure(list(good), linked), {i: 0 for i in good}
    for a, b in linked:
        n[a] += 1
        n[b] += 1
    found = {r["vec_id"]: r for r in got if r["vec_id"] is not None}
    total = sum(found[i]["n_links"] for i in good)
    assert 0.9 * sum(n.values()) <= total <= sum(n.values()) and linked
    assert np.mean([found[i]["component_id"] == root[i] for i in good]) > 0.95
    assert all(found[1000 + i]["n_links"] == 0 for i in range(6)) and found[1010]["n_links"] == 0


@pytest.mark.parametrize("spread", [0.1, 0.14])
def test_pivot_index_keeps_the_links_of_a_large_tight_group(spark, spread):
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    n, hot = 10_200, 3_400
    x = unit(rng.normal(size=(n, 64)))
    x[:hot] = unit(x[hot] + spread * x[:hot])
    pairs = rng.choice(np.arange(hot + 1, n), 1000, replace=False).reshape(2, -1)
    x[pairs[1]] = unit(x[pairs[0]] + 0.19 * x[pairs[1]])
    want = np.concatenate([(x[i : i + 1000] @ x.T >= 0.98).sum(axis=1) - 1 for i in range(0, n, 1000)])
    rows = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    got = pivot_index.near_vectors(rows.repartition(8)).toPandas().set_index("vec_id")["n_links"].reindex(range(n)).to_numpy()
    assert want[:hot].min() > 100 and want[hot + 1 :].sum() >= 900
    assert (got[:hot] == want[:hot]).all() and (got <= want).all()
    assert got[hot + 1 :].sum() >= 0.99 * want[hot + 1 :].sum()


def judge(url, rules, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    if rest is None:
        return "", "", None, "allow"
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, *max(fits, key=lambda f: (len(f[0]), f[0]))
    canon = host[4:] if host.startswith("www.") else host[2:] if host.startswith("m.") else host
    return host, path, None, "block" if host and canon + path.rstrip("/") in listed else "allow"


def test_url_filter_matches_brute_force(spark):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    rng = random.Random(17)
    urls = [f"{rng.choice(['http', 'https'])}://{rng.choice(['', 'www.', 'm.', 'a.'])}{rng.choice(['Example.org', 'x.com', 'net.net', 'org', 'examplexorg'])}{rng.choice(['', '/', '/es/1', '/en/12', '/en/2/', '/fr/3', '/de/4', '/es'])}{rng.choice(['', '?q=/de/', '#f'])}" for _ in range(300)]
    urls += [None, "", "nothing", "://", "http://", "x://A.B/c://d", "http://.org/", "http://com/de/"]
    listed = ["http://net.net/en/2?utm=1", "https://www.net.net/", None, "bad", "http://x.com/es/1"]
    known = {"net.net/en/2", "net.net", "x.com/es/1"}
    rows = [(i, u, "r") for i, u in enumerate(urls)] + [(0, urls[0], "r")]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, rule string"), rules, spark.createDataFrame([(x,) for x in listed], "url string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judge(r["url"], rules, known), r


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key_hash"), "id")
    some = bloom.build_filter(keys.where("id < 1000"), 1000)
    hits = keys.where(bloom.held(some, spark, F.col("key_hash"))).select("id").toPandas()["id"]
    assert (hits < 1000).sum() == 1000 and (hits >= 1000).sum() < 100


def tone(hz, seconds, rate=5512):
    t = np.arange(int(seconds * rate)) / rate
    return np.concatenate([np.sin(2 * np.pi * h * t) for h in hz])


def test_chroma_aligns_shifted_and_noisy_copies(spark):
    rng = np.random.default_rng(4)
    tunes = [tone(220 * 2 ** (rng.integers(0, 24, 40) / 12), 0.2) for _ in range(6)]
    pcm = lambda x: (x * 9000).astype("<i2").tobytes()
    rows = [(i, pcm(t), 5512) for i, t in enumerate(tunes)]
    rows += [(10, pcm(tunes[0][5512:]), 5512), (11, pcm(np.clip(tunes[1] + rng.normal(size=len(tunes[1])) * 0.02, -3, 3)), 5512)]
    rows += [(20, None, 5512), (21, b"", 5512), (22, bytes(60000), 5512), (23, pcm(tunes[0][:100]), 5512), (24, pcm(tunes[0]), None), (25, pcm(tunes[0]), 0)]
    prints = chroma.fingerprint(spark.createDataFrame(rows, "id long, audio binary, rate int")).select("id", "fingerprint")
    got = {(r["query_id"], r["id"]): r for r in chroma.align(prints, prints).collect()}
    assert {(0, 10), (10, 0), (1, 11), (11, 1)} == set(got)
    assert abs(abs(got[(0, 10)]["offset"]) - 5512 / chroma.HOP) <= 1 and got[(0, 10)]["bit_errors"] < 0.2
    assert all(len(r["fingerprint"]) == 0 for r in prints.where("id >= 20").collect())


def test_chroma_meets_every_pair_that_brute_force_aligns(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.integers(-40, 40, 30).astype(np.int32).tolist()) for i in range(40)]
    rows += [(100 + i, p[i % 9 :] + p[: i % 7]) for i, p in rows[:15]] + [(200, None), (201, []), (None, rows[0][1])]
    prints = spark.createDataFrame(rows, "id long, fingerprint array<int>")
    got = {(r["query_id"], r["id"]): (r["offset"], r["votes"], round(r["bit_errors"], 9)) for r in chroma.align(prints.where("id % 2 = 0"), prints, most_errors=0.5, least=2).collect()}
    want = {}
    for a, p in rows[:55]:
        for b, q in rows[:55]:
            if a % 2 == 0 and a != b:
                offset, votes, errors = brute_offset(p, q)
                if votes >= 2 and errors <= 0.5:
                    want[a, b] = (offset, votes, round(errors, 9))
    assert got == want and len(want) > 15


def brute_offset(p, q):
    votes = collections.Counter(j - i for i, x in enumerate(p) for j, y in enumerate(q) if x == y)
    if not votes:
        return 0, 0, 1.0
    most, rated = max(votes.values()), []
    for offset in (o for o, n in votes.items() if n == most):
        both = [(x, q[i + offset]) for i, x in enumerate(p) if 0 <= i + offset < len(q)]
        rated.append((sum(((x ^ y) & 0xFFFFFFFF).bit_count() for x, y in both) / (32 * len(both)), offset))
    errors, offset = min(rated)
    return offset, most, errors


def test_chroma_ties_copies_and_hot_values(spark, monkeypatch):
    monkeypatch.setattr(chroma, "SPLIT", 7)
    rows = [(i, [5] * 6) for i in range(5)] + [(10, [5, 9, 5, 9, 5, 9]), (11, [9, 5, 9, 5, 9, 5, -1]), (12, [-1, -2, -3, -4])]
    rows.append(rows[0])
    prints = spark.createDataFrame(rows, "id long, fingerprint array<int>")
    got = sorted((r["query_id"], r["id"], r["offset"], r["votes"], round(r["bit_errors"], 9)) for r in chroma.align(prints, prints, most_errors=1.0, least=3).collect())
    want = sorted((a, b, o, n, round(e, 9)) for a, p in rows for b, q in rows for o, n, e in [brute_offset(p, q)] if a != b and n >= 3)
    assert got == want and (1, 2, 0, 6, 0.0) in got


def test_chroma_rates(spark):
    tune = tone(220 * 2 ** (np.arange(24) / 12), 0.2, rate=22050)
    pcm = (tune * 9000).astype("<i2").tobytes()
    rows = [(i, pcm, r) for i, r in enumerate([0.5, 1.0, float("inf"), float("nan"), -3.0, 1e9, 22050.0])]
    got = [r["fingerprint"] for r in chroma.fingerprint(spark.createDataFrame(rows, "id long, audio binary, rate double")).orderBy("id").collect()]
    assert [len(x) for x in got[:6]] == [0] * 6 and len(got[6]) > 50
    # a tone beyond the kept range leaves no trace after the filter
    high = np.sin(2 * np.pi * 5400 * np.arange(22050) / 22050)
    assert np.abs(chroma.resampled(high, 22050)[200:-200]).max() < 0.02
    low = np.sin(2 * np.pi * 440 * np.arange(22050) / 22050)
    assert np.abs(chroma.resampled(low, 22050)[200:-200]).max() > 0.95


def brute_print(samples):
    """The definition of the fingerprint, frame by frame and rectangle by rectangle."""
    frames = [samples[i : i + 1024] for i in range(0, len(samples) - 1023, 256)]
    rows = []
    for f in frames:
        power, row = np.abs(np.fft.rfft(f * np.hanning(1024))) ** 2, np.zeros(12)
        for k, x in enumerate(power):
            hz = k * 5512 / 1024
            if 55 <= hz < 55 * 32:
                row[round(12 * np.log2(hz / 55)) % 12] += x
        rows.append(row / max(row.sum(), 1.0))
    padded = [rows[0]] * 2 + rows + [rows[-1]] * 2
    image = [sum(w * padded[i + k] for k, w in enumerate(chroma.SMOOTH)) for i in range(len(rows))]
    image = [x / np.linalg.norm(x) if np.linalg.norm(x) > 1e-3 else x * 0 for x in image]
    area = lambda t0, t1, y0, y1: sum(image[t][y % 12] for t in range(t0, t1) for y in range(y0, y1))
    out = []
    for t in range(len(image) - chroma.WIDEST + 1):
        bits = 0
        for kind, y, h, w in chroma.FILTERS:
            half = [
                lambda y=y, h=h, w=w: area(t, t + w // 2, y, y + h),
                lambda y=y, h=h, w=w: area(t, t + w, y, y + h // 2),
                lambda y=y, h=h, w=w: area(t, t + w // 2, y, y + h // 2) + area(t + w // 2, t + w, y + h // 2, y + h),
                lambda y=y, h=h, w=w: area(t + w // 3, t + w - w // 3, y, y + h),
            ][kind]()
            value = np.log1p(half) - np.log1p(area(t, t + w, y, y + h) - half)
            level = sum(value > x for x in (-0.25, 0, 0.25))
            bits = bits << 2 | (level ^ level >> 1)
        out.append(bits)
    return out


def test_fingerprints_match_brute_force():
    rng = np.random.default_rng(6)
    tune = tone(220 * 2 ** (rng.integers(0, 24, 8) / 12), 0.25) + rng.normal(size=8 * 1378) * 0.05
    got, want = chroma.packed(chroma.chroma(tune, 5512)).tolist(), brute_print(tune)
    assert len(got) == len(want) > 20
    # rectangle sums in another order may cross a threshold now and then
    assert sum((a ^ b).bit_count() for a, b in zip(got, want, strict=True)) <= 0.002 * 32 * len(got)


@pytest.fixture(scope="module")
def model_path():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


TEXTS = ["Hello  world", " lead and trail ", "x", "tabs\tand\nlines\n\n  indented", "ünïcödé 日本語 🙂 \ud7ff", "a" * 3000, "", "The quick brown fox", "   ", "\n", "1234567890,,,;;"]


def test_sentencepiece_without_dropout_is_the_model(spark, model_path):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in sentencepiece_bpe.encode(docs, model_path, dropout=0).collect():
        assert r["ids"] == model.encode(r["text"]), r["text"]


def test_merge_dropout_is_seeded_varied_and_lossless(spark, model_path):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS * 3)] + [(99, None, "x"), (None, "odd ▁ sign ▁▁", "x"), (100, "the same words " * 50, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    a, b, c = (sentencepiece_bpe.encode(docs, model_path, dropout=0.3, seed=s) for s in (1, 1, 2))
    key = lambda df: sorted((str(r["doc_id"]), r["ids"] or []) for r in df.collect())
    assert key(a) == key(b) != key(c)
    for r in sentencepiece_bpe.decode(a, model_path).collect():
        assert r["decoded"] == r["text"] and r["n_tokens"] == len(r["ids"] or [])
    plain = sentencepiece_bpe.encode(docs, model_path, dropout=0)
    assert a.agg(F.sum("n_tokens")).first()[0] > plain.agg(F.sum("n_tokens")).first()[0]
    assert sentencepiece_bpe.encode(docs.limit(0), model_path).count() == 0


def test_words_side_by_side_agree_with_single_ones(model_path):
    pieces, byte_ids, _ = sentencepiece_bpe.load_pieces(model_path)
    rng = random.Random(19)
    for dropout in (0, 0.1, 0.5):
        encoder = sentencepiece_bpe.Encoder(pieces, byte_ids, dropout, 5)
        chunks = ["".join(rng.choice(" thereandioné日▁🙂\0") for _ in range(rng.randrange(1, 30))) for _ in range(500)]
        for v in (0, 1, 2**40 + 3):
            assert encoder.encode_many(chunks, v) == [encoder.word(c, v) for c in chunks]


def test_each_occurrence_of_a_word_draws_for_itself(model_path):
    pieces, byte_ids, _ = sentencepiece_bpe.load_pieces(model_path)
    encoder = sentencepiece_bpe.Encoder(pieces, byte_ids, 0.3, 5)
    text = " ".join(["understanding"] * 200)
    ids = encoder.texts([text, text], [1, 2])
    keys = [encoder._keys(200, k) for k in (1, 2)]
    forms = [[encoder.word(" understanding", int(k)) for k in own] for own in keys]
    assert [b"".join(f) for f in forms] == [r.tobytes() for r in ids]
    assert len(set(forms[0])) > 20 and forms[0] != forms[1]


def test_words_that_come_up_once_leave_no_node(model_path, monkeypatch):
    pieces, byte_ids, _ = sentencepiece_bpe.load_pieces(model_path)
    encoder = sentencepiece_bpe.Encoder(pieces, byte_ids, 0.3, 5)
    rng = random.Random(23)
    words = [f"{rand_text(rng, 1)}x{i}" for i in range(300)]
    forms = [encoder.word(" " + w, int(k)) for w, k in zip(words, encoder._keys(300, 1), strict=True)]
    monkeypatch.setattr(encoder, "by_heap", None)  # line ends and signs without a piece go side by side too
    assert encoder.texts([" ".join(words)], [1])[0].tobytes() == b"".join(forms)
    assert encoder.nodes.n == 0
    encoder.texts([" ".join(words) + "\n\n ▁ ▁"], [2])
    assert encoder.nodes.n >= len(words)


def test_runs_of_any_size_give_the_same_ids(model_path, monkeypatch):
    pieces, byte_ids, surface = sentencepiece_bpe.load_pieces(model_path)
    rng = random.Random(29)
    texts = ["".join(rng.choice("  \n\nthereandioné日▁🙂\0") for _ in range(rng.randrange(200))) for _ in range(40)] + ["", None, " ", "\n", "y" * 60 + " z"] + TEXTS
    chunks = [re.findall(r" *[^ \n]+| +|\n", " " + t) if t else [] for t in texts]
    found, counts = sentencepiece_bpe.split(texts)
    assert found.to_pylist() == [c for own in chunks for c in own] and counts.tolist() == [len(own) for own in chunks]
    keys = list(range(len(texts)))
    encoder = sentencepiece_bpe.Encoder(pieces, byte_ids, 0.3, 5)
    want = [b"".join(encoder.word(c, int(k)) for c, k in zip(own, encoder._keys(len(own), key), strict=True)) for own, key in zip(chunks, keys, strict=True)]
    for sizes in ({}, {"WORDS": 7, "RUN": 3, "SIDE_BY_SIDE": 2}, {"WORDS": 100, "REMEMBERED": 5, "MET": 4}):
        for name, size in sizes.items():
            monkeypatch.setattr(sentencepiece_bpe, name, size)
        encoder = sentencepiece_bpe.Encoder(pieces, byte_ids, 0.3, 5)
        for _ in range(3):
            got = encoder.texts(texts, keys)
            assert [b"" if r is None else r.tobytes() for r in got] == want and [r is None for r in got] == [t is None for t in texts]
    assert sentencepiece_bpe.spelt_out(pa.array(surface, pa.large_binary()), got) == texts


def test_tasks_read_ahead_without_losing_rows(spark, model_path):
    rows = [(i, f"row {i} of many words", i % 3) for i in range(700)] + [(None, None, 1), (800, "", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark int").repartition(2)
    key = lambda df: sorted((str(r["doc_id"]), r["mark"], r["ids"]) for r in df.collect())
    found = key(sentencepiece_bpe.encode(docs, model_path, 0.3, 3))
    assert len(found) == len(rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    assert key(sentencepiece_bpe.encode(docs, model_path, 0.3, 3)) == key(sentencepiece_bpe.encode(docs, model_path, 0.3, 3, copies=True)) == found
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_copies_have_draws_by_number_whatever_the_partitions(spark):
    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    rng = random.Random(3)
    texts = [rand_text(rng, 60) for _ in range(3)]
    rows = [(1, texts[0])] * 6 + [(2, texts[1])] * 2 + [(2, texts[2])] * 2 + [(3, texts[1]), (None, texts[0]), (None, texts[0]), (4, None), (4, None)]
    rng.shuffle(rows)
    got = []
    for n in (1, 6):
        docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, copy string").repartition(n)
        found = sentencepiece_bpe.encode(docs, path, 0.1, 17, copies=True).select("doc_id", "text", "copy", "ids").collect()
        got.append(sorted((str(r["doc_id"]), r["text"] or "", r["copy"], tuple(r["ids"] or ())) for r in found))
    assert got[0] == got[1] and len(got[0]) == len(rows)
    by_row = collections.defaultdict(list)
    for doc, text, copy, ids in got[0]:
        by_row[doc, text].append((copy, ids))
    for (_, text), found in by_row.items():
        assert [c for c, _ in found] == list(range(1, len(found) + 1))
        assert not text or len({ids for _, ids in found}) == len(found)
    # the first copy is what a single row gets
    plain = {(str(r["doc_id"]), r["text"] or ""): tuple(r["ids"] or ()) for r in sentencepiece_bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), path, 0.1, 17).collect()}
    assert all(found[0][1] == plain[key] for key, found in by_row.items())


def test_rules_of_equal_length_go_by_code_point(spark):
    pages = spark.createDataFrame([(1, "http://a.b.org/xyz"), (2, "http://c.org/x"), (3, "http://b.org/xz")], "page_id long, url string")
    listed = spark.createDataFrame([], "url string")
    rules = [("allow", "b.org", "/xy"), ("block", "a.b.org", "/"), ("block", "c.org", "/"), ("allow", "c.org", "/")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules, listed).collect()}
    assert got == {1: ("a.b.org/", "block"), 2: ("c.org/", "allow"), 3: (None, "allow")}


def test_shared_pivot_counts_prune_pairs_but_no_link(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(120, 16))
    rows = np.concatenate([base, base[:60] + rng.normal(scale=0.04, size=(60, 16)), base[:60] + rng.normal(scale=0.3, size=(60, 16))])
    unit = rows / np.sqrt((rows**2).sum(axis=1, keepdims=True))
    known, apart = pivot_index._thin(unit[::3])
    listed = list(pivot_index._listed({16: (known, apart)}, 40, 0.98)(iter([__import__("pandas").DataFrame({"node": range(len(rows)), "copies": 1, "label": "a", "dim": 16, "embedding": list(rows)})])))[0]
    assert all((np.diff(a) >= 0).all() for a in listed["angles"])
    names = np.arange(len(known))
    inside = pivot_index._incidence(listed, names)
    shared, angle = inside @ inside.T, float(np.arccos(0.98))
    needed = pivot_index._needed(listed, listed, angle)
    allowed = shared >= np.maximum(needed, needed.T)
    linked = unit @ unit.T >= 0.98
    met = shared > 0
    assert allowed[linked & met].all() and linked.sum() > len(rows) + 60
    # of the pairs that meet but are no links many are never verified
    assert (~allowed & met & ~linked).sum() > 0.2 * (met & ~linked).sum()
