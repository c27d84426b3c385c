"""Language ID by hierarchical discrimination: family first, then pairwise linear SVMs within it."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import crc_mod, drop_stage, packed, small_batches, write_stage

#: Labelled documents the fit reads: those of lowest hash of doc_id.
MAX_TRAINING = 8_000
#: Character n-grams kept, those that most of these documents contain.
MAX_FEATURES = 3_000

#: Language families by code. Fixed values; a code that is missing is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("es", "fr", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "pl", "cs", "sk", "uk", "bg", "sr", "hr"),
    "uralic": ("fi", "et", "hu"),
}
_LETTERS = re.compile(r"[^\W\d_]+")


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang.split("-")[0].lower() in codes), lang)


def grams(word: str) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for n in (1, 2, 3, 4) for i in range(len(marked) - n + 1)]


def counted(text: str | None) -> Counter:
    return Counter(_LETTERS.findall(text.lower())) if text else Counter()


class Totals:
    """Sums of a per-word vector over the words of a text, remembering words met before."""

    def __init__(self, features: list[str], weights: np.ndarray):
        self.index, self.weights, self.known = {g: i for i, g in enumerate(features)}, weights, {}
        self.rows = np.zeros((1024, weights.shape[1] + 1))

    def word(self, w: str) -> int:
        at = len(self.known)
        if at == len(self.rows):
            self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
        own = [self.index[g] for g in grams(w) if g in self.index]
        self.rows[at, :-1] = self.weights[own].sum(axis=0) if own else 0
        self.rows[at, -1] = len(own)
        self.known[w] = at
        return at

    def of(self, words: Counter) -> np.ndarray:
        """Mean weight vector over all n-gram occurrences of the text."""
        if len(self.known) > 200_000:
            self.known.clear()
        known = self.known
        at = [known[w] if w in known else self.word(w) for w in words]
        total = np.fromiter(words.values(), float, len(words)) @ self.rows[at]
        return total[:-1] / max(1.0, total[-1])


def _grams_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    met = Counter()
    for pdf in batches:
        for text in pdf["text"]:
            met.update({g for w in counted(text) for g in grams(w)})
    items = list(met.items())
    for i in range(0, len(items), 100_000):
        yield pd.DataFrame(items[i : i + 100_000], columns=["gram", "n"])


def _svms(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 300, settled: float = 1e-3) -> np.ndarray:
    """Weights (bias last) of squared-hinge linear SVMs, one for each column of y, all in one product a
    round: rows of y = 0 are out, and the two classes of a machine weigh alike. Nesterov's gradient,
    until no weight moves by more than `settled` of the largest. The last column of x is 1."""
    if not y.size:
        return np.zeros((x.shape[1], y.shape[1]), np.float32)
    share = np.where(y > 0, 0.5 / np.maximum(1, (y > 0).sum(axis=0)), 0.5 / np.maximum(1, (y < 0).sum(axis=0))) * (y != 0)
    share = share.astype(x.dtype)
    v = np.ones((x.shape[1], y.shape[1]), x.dtype)
    for _ in range(30):
        v = x.T @ (share * (x @ v))
        top = np.linalg.norm(v, axis=0) + 1e-30
        v /= top
    rate = 1 / (2 * top * 1.05 + ridge)
    w = np.zeros_like(v)
    ahead = w.copy()
    for k in range(rounds):
        gap = share * y * np.maximum(0, 1 - y * (x @ ahead))
        following = ahead - rate * (ridge * ahead - 2 * (x.T @ gap))
        moved = np.abs(following - w).max()
        ahead = following + k / (k + 3) * (following - w)
        w = following
        if moved < settled * np.abs(w).max():
            break
    return w


def fit(docs: DataFrame, max_training: int = MAX_TRAINING) -> dict:
    """A model from docs(doc_id, text, lang). At most max_training documents with text and lang, those
    of lowest hash of doc_id, are used, and of a repeated doc_id the first row by text and lang; a null
    doc_id is not learned from. n-gram frequencies are counted in Spark over their whole texts."""
    small_batches(docs.sparkSession)
    rows = docs.where("lang is not null and text is not null").select("text", "lang", "doc_id")
    chosen = rows.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_training)
    rows = rows.join(F.broadcast(chosen), "doc_id")  # max_training ids
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("row")).select("row.*")
    rows = write_stage(rows, "training-texts")
    met = rows.select("text").mapInPandas(_grams_of, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    features = [r["gram"] for r in met.orderBy(F.desc("n"), "gram").limit(MAX_FEATURES).collect()]

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = {g: i for i, g in enumerate(features)}
        for pdf in batches:
            out = []
            for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
                x = Counter()
                for w, n in counted(text).items():
                    for g in grams(w):
                        if g in index:
                            x[index[g]] += n
                if x:
                    met = np.array(sorted(x), np.int16)
                    out.append((lang, met.tobytes(), (np.array([x[i] for i in met.tolist()], np.float32) / x.total()).tobytes()))
            yield pd.DataFrame(out, columns=["lang", "at", "x"])

    seen = rows.mapInPandas(vectors, "lang string, at binary, x binary").collect()  # max_training rows of MAX_FEATURES at most
    drop_stage(rows)
    seen.sort(key=lambda r: (r["lang"], r["at"], r["x"]))  # the sums below come out alike in every run
    langs = sorted({r["lang"] for r in seen})
    families = sorted({family_of(g) for g in langs})
    y = np.array([r["lang"] for r in seen], object)
    kin = np.array([family_of(r["lang"]) for r in seen], object)
    x = np.zeros((len(seen), len(features) + 1), np.float32)  # one matrix, scaled in place
    x[:, -1] = 1
    for row, r in zip(x, seen, strict=True):
        row[np.frombuffer(r["at"], np.int16)] = np.frombuffer(r["x"], np.float32)
    del seen
    spread = np.sqrt(np.einsum("ij,ij->j", x[:, :-1], x[:, :-1], dtype=np.float64) / len(x)) + 1e-6 if len(x) else np.ones(len(features))
    x[:, :-1] /= (spread * np.sqrt(max(1, len(features)))).astype(np.float32)
    tasks, signs = [], []
    for f in families if len(families) > 2 else families[: len(families) - 1]:
        tasks.append(("family", f, None))
        signs.append(np.where(kin == f, 1, -1))
    for a, b in (p for f in families for p in combinations([g for g in langs if family_of(g) == f], 2)):
        tasks.append(("pair", a, b))
        signs.append(np.where(y == a, 1, np.where(y == b, -1, 0)))
    w = _svms(x, np.array(signs, np.float32).reshape(len(tasks), len(x)).T).astype(np.float64).T
    return {"features": features, "langs": langs, "families": families, "tasks": tasks, "weights": (w[:, :-1] / spread / np.sqrt(max(1, len(features)))).T, "bias": w[:, -1]}


def decide(model: dict, margins: np.ndarray) -> tuple[str, float]:
    """The language that wins most pairs within the winning family, and a confidence of 0 to 1."""
    chance = 1 / (1 + np.exp(-np.clip(4 * margins, -50, 50)))
    families = model["families"]
    rated = {t[1]: c for t, c in zip(model["tasks"], chance, strict=True) if t[0] == "family"}
    if len(families) == 2:
        rated[families[1]] = 1 - rated[families[0]]
    rated = rated or {families[0]: 1.0}
    family = max(families, key=lambda f: (rated[f], f))
    wins = {g: [0, 0.0, 0] for g in model["langs"] if family_of(g) == family}
    for (kind, a, b), c in zip(model["tasks"], chance, strict=True):
        if kind == "pair" and a in wins:
            for g, p in ((a, c), (b, 1 - c)):
                wins[g] = [wins[g][0] + (p >= 0.5), wins[g][1] + p, wins[g][2] + 1]
    best = max(wins, key=lambda g: (wins[g][0], wins[g][1], g))
    votes = wins[best]
    return best, float(rated[family] * (votes[1] / votes[2] if votes[2] else 1.0))


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """docs with lang_pred and score of each whole text: `und` and 0 where the text is null or has no
    letter, or nothing was learned. Extra columns pass through; same-named ones are replaced."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        totals = Totals(model["features"], model["weights"])
        for texts in batches:
            out = []
            for text in texts:
                words = counted(text) if model["langs"] else None
                out.append(decide(model, totals.of(words) + model["bias"]) if words else ("und", 0.0))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    rows, unpacked = packed(docs, predicted("text").alias("said"), without={"lang_pred", "score"})
    return rows.select(*unpacked, "said.lang_pred", "said.score")


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2, max_training: int = MAX_TRAINING) -> DataFrame:
    """docs with held_out, lang_pred and score, learned only from text and lang of rows whose
    crc32(doc_id as text) modulo folds is not held_out."""
    remainder = crc_mod(F.col("doc_id"), folds)
    model = fit(docs.where(remainder != held_out), max_training)
    return predict(docs, model).withColumn("held_out", remainder == held_out)
