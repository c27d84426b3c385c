"""Toxicity: a logistic classifier regularised by counterfactual identity terms."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import crc_mod, drop_stage, give_back, small_batches, tidy, write_stage

#: Labelled rows the fit reads: those of lowest hash of doc_id.
MAX_LABELLED = 20_000
#: Character n-grams kept as features, and the z value of their difference between the labels.
MAX_FEATURES, MIN_Z = 600, 4.0
#: n-grams that a task counts before it hands on what it has, and words a worker remembers.
COUNTED, REMEMBERED = 250_000, 100_000
#: Weight of squared score changes under swaps, and of the ordinary ridge.
COUNTERFACTUAL, RIDGE = 10.0, 0.5

#: Neutral group terms, swapped within one list. Fixed values.
IDENTITY_TERMS = (
    ("women", "men", "people", "children", "elders"),
    ("woman", "man", "person", "child", "elder"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "trans", "queer", "heterosexual"),
    ("immigrants", "refugees", "natives", "foreigners", "locals"),
    ("deaf", "blind", "disabled", "autistic", "elderly", "young"),
    ("mujeres", "hombres", "personas", "frauen", "männer", "menschen", "femmes", "hommes", "personnes"),
)
_GROUP = {t: g for g in IDENTITY_TERMS for t in g}
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def grams(word: str) -> set[str]:
    """The word between marks and its 4- to 6-character n-grams, marks included."""
    marked = f"<{word}>"
    return {marked} | {marked[i : i + n] for n in (4, 5, 6) for i in range(len(marked) - n + 1)}


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def counterfactuals(text: str | None, key: str) -> list[tuple[set[str], set[str]]]:
    """Pairs of word sets: the sentences of a text with an identity term, and the same with each such
    term replaced by another of its list. A text without such terms, most likely, gives one pair as
    well: a term is put into one of its sentences, and another of the same list in its place. What is
    chosen depends on key, so that it comes out alike in every run. No sentence, no pair."""
    draw = lambda *parts: xxhash.xxh3_64_intdigest("|".join(map(str, (key, *parts))).encode("utf-8", "surrogatepass"))
    sentences = [w for w in (words(x) for x in _SENTENCE.split(text or "")) if w]
    out = []
    for n, found in enumerate(sentences):
        terms = sorted(w for w in found if w in _GROUP)
        if terms:
            swapped = found - set(terms)
            for t in terms:
                others = [o for o in _GROUP[t] if o != t]
                swapped.add(others[draw(n, t) % len(others)])
            out.append((found, swapped))
    if sentences and not out:
        found, group = sentences[draw("sentence") % len(sentences)], IDENTITY_TERMS[draw("list") % len(IDENTITY_TERMS)]
        at, step = draw("term") % len(group), 1 + draw("other") % (len(group) - 1)
        out.append((found | {group[at]}, found | {group[(at + step) % len(group)]}))
    return out


class Scorer:
    """Word-wise lookup of features, remembered for words met before."""

    def __init__(self, features: list[str]):
        self.index, self.known = {g: i for i, g in enumerate(features)}, {}

    def features(self, found: set[str]) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        out: set[int] = set()
        for w in found:
            hit = self.known.get(w)
            if hit is None:
                hit = self.known[w] = tuple(self.index[g] for g in grams(w) if g in self.index)
            if hit:
                out.update(hit)
        return sorted(out)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    by_label = (Counter(), Counter())

    def flushed() -> Iterator[pd.DataFrame]:
        for toxic, counts in enumerate(by_label):
            grams_met, n = list(counts), list(counts.values())
            counts.clear()
            if n:
                yield pd.DataFrame({"gram": grams_met, "neg": [0] * len(n) if toxic else n, "pos": n if toxic else [0] * len(n)})

    for pdf in batches:
        for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
            by_label[toxic].update({g for w in words(text) for g in grams(w)})
            if sum(map(len, by_label)) > COUNTED:
                yield from flushed()
    yield from flushed()


@dataclass
class Model:
    """Features with their weights, the bias, and how many counterfactual pairs the fit was given."""

    features: list[str]
    weights: np.ndarray
    bias: float
    pairs: int = 0


def _changes(scorer: Scorer, text: str | None, key: str) -> Iterator[tuple[list[int], list[int]]]:
    """For each counterfactual pair: the features that only one side has, and those only the other has."""
    for a, b in counterfactuals(text, key):
        x, y = set(scorer.features(a)), set(scorer.features(b))
        yield sorted(x - y), sorted(y - x)


def _products(features: list[str]):
    """Sums over counterfactual pairs of the products of feature changes, (i, j, total), i <= j, and as
    (-1, -1) the number of pairs: of a size that the features bound, whatever the texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, sums = Scorer(features), Counter()
        for pdf in batches:
            for key, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                for lost, gained in _changes(scorer, text, str(key)):
                    sums[-1, -1] += 1
                    signed = [(i, 1) for i in lost] + [(i, -1) for i in gained]
                    for i, a in signed:
                        for j, b in signed:
                            if i <= j:
                                sums[i, j] += a * b
        if sums:
            yield pd.DataFrame([(i, j, n) for (i, j), n in sums.items()], columns=["i", "j", "total"])

    return run


def mean_swap_change(docs: DataFrame, model: Model) -> tuple[int, float]:
    """The counterfactual pairs of docs(doc_id, text), and the mean absolute change of the log odds
    between their sides: what the penalty is to keep small."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model.features)
        for pdf in batches:
            found = [abs(model.weights[a].sum() - model.weights[b].sum()) for key, text in zip(pdf["doc_id"], pdf["text"], strict=True) for a, b in _changes(scorer, text, str(key))]
            yield pd.DataFrame({"pairs": [len(found)], "change": [float(sum(found))]})

    total = docs.select("doc_id", "text").mapInPandas(run, "pairs long, change double").agg(F.sum("pairs").alias("pairs"), F.sum("change").alias("change")).first()
    return (total["pairs"], total["change"] / total["pairs"]) if total["pairs"] else (0, 0.0)


def _fit_weights(x: np.ndarray, y: np.ndarray, products: np.ndarray, counterfactual: float) -> tuple[np.ndarray, float]:
    """Newton's method on log loss + RIDGE/2 |w|^2 + counterfactual/2 * the sum of squared score changes
    over the pairs, which is a quadratic form of the summed products of changes."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    penalty = np.diag(np.r_[np.full(x.shape[1] - 1, RIDGE), 1e-6])
    penalty[:-1, :-1] += counterfactual * products
    w = np.zeros(x.shape[1])
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty @ w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, gradient)
        w -= step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, counterfactual: float = COUNTERFACTUAL) -> Model:
    """A model from docs(doc_id, text) and labels(doc_id, toxic).

    At most max_labelled labels, those of lowest hash of doc_id, are used; a doc_id with several
    labels counts as toxic if one says so, null labels and texts without a row are left out, and of
    several texts of a doc_id the first by code point counts. Spark counts n-grams by label over the
    whole texts of these rows and picks the MAX_FEATURES of largest z >= MIN_Z; it also sums the
    products of feature changes over the counterfactual pairs of all these rows. Without rows of
    both labels there are no features, and the score is the share of toxic rows (one half without any).
    """
    small_batches(docs.sparkSession)
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") >= 1).cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # max_labelled rows
    rows = write_stage(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "labelled-texts")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("pos")).first()
    n_pos, n_neg = max(1, total["pos"]), max(1, total["n"] - total["pos"])
    counted = rows.select("text", "toxic").mapInPandas(tidy(_count), "gram string, neg long, pos long").groupBy("gram").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    p, q = (F.col("pos") + 0.5) / (n_pos + 1.0), (F.col("neg") + 0.5) / (n_neg + 1.0)
    both = (F.col("pos") + F.col("neg") + 1.0) / (n_pos + n_neg + 2.0)
    z = F.abs(p - q) / F.sqrt(both * (1 - both) * (1.0 / n_pos + 1.0 / n_neg))
    features = [r["gram"] for r in counted.withColumn("z", z).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "gram").limit(MAX_FEATURES).collect()]
    if not total["pos"] or total["pos"] == total["n"] or not features:
        rate = total["pos"] / total["n"] if total["n"] else 0.5
        return Model([], np.zeros(0), float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6))))

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(features)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype(str), "toxic": pdf["toxic"], "has": [scorer.features(words(t)) for t in pdf["text"]]})

    seen = rows.mapInPandas(tidy(describe), "doc_id string, toxic int, has array<int>").collect()  # max_labelled rows at most
    seen.sort(key=lambda r: r["doc_id"])  # the sums of the fit come out alike in every run
    x, products, pairs = np.zeros((len(seen), len(features)), np.float32), np.zeros((len(features), len(features))), 0
    for i, r in enumerate(seen):
        x[i, r["has"]] = 1
    sums = rows.select("doc_id", "text").mapInPandas(tidy(_products(features)), "i int, j int, total long").groupBy("i", "j").agg(F.sum("total").alias("total"))
    for r in sums.collect():  # MAX_FEATURES squared at most
        if r["i"] < 0:
            pairs = r["total"]
        else:
            products[r["i"], r["j"]] = products[r["j"], r["i"]] = r["total"]
    drop_stage(rows)
    weights, bias = _fit_weights(x, np.array([r["toxic"] for r in seen], np.float64), products, counterfactual)
    return Model(features, weights, bias, pairs)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a score of 0 to 1 for each whole text; null and empty texts have the base score.
    Extra columns pass through, one that bears the new name is replaced."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model.features)
        for texts in batches:
            sums = np.array([model.bias + model.weights[scorer.features(words(t))].sum() for t in texts])
            yield pd.Series(1 / (1 + np.exp(-np.clip(sums, -50, 50))))
        give_back()

    return docs.withColumn(name, scored("text"))


def judge(docs: DataFrame, labels: DataFrame, folds: int = 5, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """docs with held_out, score and predicted, one row for each of docs, repeated ones too. Labels are
    learned only from rows whose crc32(doc_id as text) modulo folds is not 0; only texts are scored.
    Null and empty texts have the base score. Extra columns pass through; those that bear an added
    column's name are replaced."""
    learned = labels.where(crc_mod(F.col("doc_id"), folds) != 0)
    model = fit(docs, learned, max_labelled)
    scored = score(docs, model).withColumn("held_out", crc_mod(F.col("doc_id"), folds) == 0)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
