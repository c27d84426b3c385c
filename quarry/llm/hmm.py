"""Language-model scoring by a hidden Markov model over words."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import crc_mod, small_batches, write_stage

STATES = 8
#: Emission classes: the most frequent words each, all others by hash. Within a class, words are
#: drawn by their own counts, whatever the state.
HEAD_CLASSES, TAIL_CLASSES = 6144, 2048
#: Words whose counts every task holds; the counts of all others come from a join.
HELD_COUNTS = 131_072
#: Seeds only: documents (lowest hashes, of at most SEED_TOKENS tokens) and rounds by which the states
#: come apart from noise. All that is kept of a corpus comes from the full rounds after these.
SEED_DOCS, SEED_TOKENS, SEED_ROUNDS = 400, 5000, 8
#: Full rounds go on until the log likelihood ratio of a token gains less than SETTLED, or up to ROUNDS.
ROUNDS, SETTLED = 8, 0.003
#: Tokens' worth of the plain word distribution that each state's emissions are smoothed with.
SMOOTHING = 200.0
#: Tokens of one segment: segments of all texts of a batch, of about BATCH_TOKENS, advance together.
SEGMENT, BATCH_TOKENS = 512, 400_000
END = b""


def _text() -> Column:
    """Whole texts as bytes, which no task has to decode."""
    return F.col("text").cast("string").cast("binary").alias("text")


def _words(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased words between ASCII white space, and the end."""
    words = text.lower().split() if text else []
    words.append(END)
    return words


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    met: Counter = Counter()

    def flushed() -> Iterator[pa.RecordBatch]:
        words, n = pa.array(list(met), pa.binary()), pa.array(list(met.values()), pa.int64())
        met.clear()
        for i in range(0, len(n), 100_000):
            yield pa.RecordBatch.from_arrays([words[i : i + 100_000], n[i : i + 100_000]], names=["word", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            met.update(_words(text))
        if len(met) > 250_000:
            yield from flushed()
    yield from flushed()


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary; the empty one is the end of a text) and n over all whole texts of docs."""
    return docs.select(_text()).mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _tail_classes(words: list[bytes]) -> np.ndarray:
    return (HEAD_CLASSES + np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % TAIL_CLASSES).astype(np.int16)


class Vocabulary:
    """Classes and held counts, as every task needs them; of fixed size."""

    def __init__(self, held: list[tuple[bytes, int]], tail_mass: np.ndarray, total: int, distinct: int):
        self.total, self.distinct = total, distinct
        self.words = [w for w, _ in held]
        counts = np.array([n + 1 for _, n in held], float)
        self.logs, self.classes = np.log10(counts), _tail_classes(self.words)
        heads = min(HEAD_CLASSES, len(held))
        self.classes[:heads] = np.arange(heads)
        mass = np.zeros(HEAD_CLASSES + TAIL_CLASSES)
        mass[:heads] = counts[:heads]
        mass[HEAD_CLASSES:] = tail_mass + 1
        self.norm = mass.sum()
        self.share = np.where(mass > 0, mass / self.norm, 1.0)


class Mapper:
    """Words to their number here: that in the vocabulary, or the next one. By number: the word, its
    class and log10(count + 1), where -1 marks counts that a join gives."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._begin()

    def _begin(self) -> None:
        v = self.vocabulary
        self.words, self.classes, self.logs = list(v.words), v.classes, v.logs
        self.numbers = defaultdict(count(len(v.words)).__next__, zip(v.words, range(len(v.words)), strict=True))

    def map(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """The numbers of each text's words, which hold until the next call."""
        known = len(self.words)
        if known > len(self.vocabulary.words) + 100_000:
            self._begin()
            known = len(self.words)
        number = self.numbers.__getitem__
        at = [np.fromiter(map(number, words), np.int64, len(words)) for words in map(_words, texts)]
        new = list(islice(self.numbers, known, None))
        self.words += new
        self.classes = np.concatenate([self.classes, _tail_classes(new)])
        self.logs = np.concatenate([self.logs, np.full(len(new), -1.0)])
        return at


def vocabulary(counts: DataFrame) -> Vocabulary:
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    # the least count that at most HELD_COUNTS words reach, to a sixteenth of an octave
    octave = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    room, least = HELD_COUNTS, None
    for r in sorted(counts.groupBy(octave.alias("o")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["o"]):
        room -= r["n"]
        if room < 0:
            break
        least = r["o"]
    top = counts.where(octave >= (least if least is not None else 1 << 20)).toPandas()
    if len(top) < HEAD_CLASSES:  # one frequency alone may have more words than tasks hold
        top = counts.orderBy(F.desc("n"), "word").limit(HEAD_CLASSES).toPandas()
    held = sorted(zip(map(bytes, top["word"]), map(int, top["n"]), strict=True), key=lambda x: (-x[1], x[0]))
    # all words fall into hashed classes here; the head words, known by name, are taken out again
    mass = np.zeros(TAIL_CLASSES)
    tails = counts.groupBy((F.crc32("word") % TAIL_CLASSES).alias("c")).agg(F.sum(F.col("n") + 1).alias("n")).collect()
    for r in tails:
        mass[r["c"]] = r["n"]
    for w, n in held[:HEAD_CLASSES]:
        mass[zlib.crc32(w) % TAIL_CLASSES] -= n + 1
    return Vocabulary(held, mass, int(sums["n"]), int(sums["v"]))


class Batch:
    """Class sequences of many texts, cut into segments that advance side by side, the longest first. The
    first token of a text stands alone, so that every token of a segment has a predecessor. Only a text of
    more than two segments has middle ones, whose neighbours are both unknown when they are met."""

    def __init__(self, texts: list[np.ndarray]):
        sizes = np.array([len(t) for t in texts], np.int64)
        flat, begins = np.concatenate(texts).astype(np.intp), sizes.cumsum() - sizes
        self.first = flat[begins]
        parts = -((1 - sizes) // SEGMENT)
        of = np.repeat(np.arange(len(texts)), parts)
        turn = np.arange(len(of)) - np.repeat(parts.cumsum() - parts, parts)
        length = np.minimum(sizes[of] - 1 - turn * SEGMENT, SEGMENT)
        order = np.argsort(-length, kind="stable")
        self.of, turn, length = of[order], turn[order], length[order]
        begins = begins[self.of] + 1 + turn * SEGMENT
        #: How many segments have a token at each step, and its class.
        self.active = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0))
        self.ids = [flat[begins[:n] + t] for t, n in enumerate(self.active.tolist())]
        last = turn == parts[self.of] - 1
        self.opening, self.closing = np.nonzero(turn == 0)[0], np.nonzero(last)[0]
        self.heads, self.tails = np.nonzero((turn == 0) & ~last)[0], np.nonzero((turn > 0) & last)[0]
        self.middle = np.nonzero((turn > 0) & ~last)[0]
        turn = turn[self.middle]
        self.by_turn = [np.nonzero(turn == j)[0] for j in range(1, int(turn.max(initial=0)) + 1)]


def _products(batch: Batch, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The product of transition and emission over each middle segment (to state, from state, segment),
    scaled, and the log of its scale. Segments are the last axis, so that work runs along long rows. All
    recursions work in the precision of the parameters: double for scores, single for training."""
    k, n = len(move), len(batch.middle)
    x, logs = np.repeat(np.eye(k, dtype=emit.dtype)[:, :, None], n, axis=2), np.zeros(n)
    for t, ids in enumerate(batch.ids if n else []):  # all of them are whole
        x = (move.T @ x.reshape(k, -1)).reshape(k, k, n)
        x *= emit.take(ids[batch.middle], axis=1)[:, None, :]
        if t % 8 == 7:
            scale = x.reshape(k * k, n).sum(axis=0)
            x /= scale
            logs += np.log(scale)
    return x, logs


def _advance(batch: Batch, segs: np.ndarray, a: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states at the end of the segments segs, from those before them, scaled, and the log of the scale."""
    out, logs = a.copy(), np.zeros(len(segs))
    for t, n in enumerate(np.searchsorted(segs, batch.active).tolist()):
        if n < a.shape[1]:
            out[:, n : a.shape[1]] = a[:, n:]
            if not n:
                break
        a = move.T @ a[:, :n]
        a *= emit.take(batch.ids[t][segs[:n]], axis=1)
        if t % 4 == 3:
            scale = a.sum(axis=0)
            a /= scale
            logs[:n] += np.log(scale)
    else:
        out[:, : a.shape[1]] = a
    scale = out.sum(axis=0)
    return out / scale, logs + np.log(scale)


def _retreat(batch: Batch, segs: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """What the tokens of the segments segs, with nothing after them, say of the states before them, scaled."""
    b = np.ones((len(move), len(segs)), emit.dtype)
    for t, n in reversed(list(enumerate(np.searchsorted(segs, batch.active).tolist()))):
        if n:
            now = move @ (emit.take(batch.ids[t][segs[:n]], axis=1) * b[:, :n])
            b[:, :n] = now / now.sum(axis=0) if t % 4 == 0 else now
    return b


def _entered(batch: Batch, first: np.ndarray, move: np.ndarray, emit: np.ndarray):
    """From the states at first tokens: those before each segment, the log likelihood ratio of each text up to
    its last segment, and the products over middle segments."""
    a, x_logs = first.copy(), np.zeros(first.shape[1])
    before = np.zeros((len(move), len(batch.of)), emit.dtype)
    before[:, batch.opening] = a[:, batch.of[batch.opening]]
    d = batch.of[batch.heads]
    a[:, d], x_logs[d] = _advance(batch, batch.heads, a[:, d], move, emit)
    x, logs = _products(batch, move, emit)
    for at in batch.by_turn:
        segs = batch.middle[at]
        d = batch.of[segs]
        before[:, segs] = a[:, d]
        after = np.einsum("ks,lks->ls", a[:, d], x[:, :, at])
        scale = after.sum(axis=0)
        a[:, d] = after / scale
        x_logs[d] += np.log(scale) + logs[at]
    before[:, batch.tails] = a[:, batch.of[batch.tails]]
    return before, x_logs, x


def _began(batch: Batch, start: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states at first tokens, and the log likelihood ratio of these."""
    a = start[:, None] * emit.take(batch.first, axis=1)
    scale = a.sum(axis=0)
    return a / scale, np.log(scale, dtype=np.float64)


def forward(batch: Batch, start: np.ndarray, move: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward recursion: the log likelihood ratio of each text, and the states before each segment."""
    emit = np.ascontiguousarray(ratio.T)
    first, total = _began(batch, start, emit)
    before, logs, _ = _entered(batch, first, move, emit)
    total += logs
    total[batch.of[batch.closing]] += _advance(batch, batch.closing, before[:, batch.closing], move, emit)[1]
    return total, before


def expected_counts(batch: Batch, start: np.ndarray, move: np.ndarray, ratio: np.ndarray):
    """Baum-Welch: expected starts, transitions and emissions, and the log likelihood ratio."""
    emit = np.ascontiguousarray(ratio.T)
    first, total = _began(batch, start, emit)
    before, _, x = _entered(batch, first, move, emit)
    # what follows each segment
    after, b = np.ones_like(before), np.ones_like(first)
    b[:, batch.of[batch.tails]] = _retreat(batch, batch.tails, move, emit)
    for at in reversed(batch.by_turn):
        segs = batch.middle[at]
        d = batch.of[segs]
        after[:, segs] = b[:, d]
        back = np.einsum("lks,ls->ks", x[:, :, at], b[:, d])
        b[:, d] = back / back.sum(axis=0)
    after[:, batch.heads] = b[:, batch.of[batch.heads]]
    # states at each token, and emissions divided by its scale: with these the states before a token, its
    # scaled emissions and what follows it multiply to expected counts, without a sum of their own
    states, emits, a, end = [], [], before, before.copy()
    logs = np.zeros(len(batch.of))
    for ids in batch.ids:
        n = len(ids)
        end[:, n : a.shape[1]] = a[:, n:]
        e = emit.take(ids, axis=1)
        a = move.T @ a[:, :n]
        a *= e
        scale = a.sum(axis=0)
        logs[:n] += np.log(scale)
        a /= scale
        e /= scale
        states.append(a)
        emits.append(e)
    end[:, : a.shape[1]] = a
    total += np.bincount(batch.of, weights=logs, minlength=len(total))
    after /= (end * after).sum(axis=0)
    moved = np.zeros_like(move, np.float64)
    for t in range(len(emits) - 1, -1, -1):
        u, n = emits.pop(), states[t].shape[1]
        u *= after[:, :n]
        moved += (states[t - 1] if t else before)[:, :n] @ u.T
        # the states themselves are not needed any more: what was seen goes where they stood
        states[t] *= after[:, :n]
        after[:, :n] = move @ u
    g = first.copy()
    g[:, batch.of[batch.opening]] *= after[:, batch.opening]
    g /= g.sum(axis=0)
    ids, seen = np.concatenate([batch.first, *batch.ids]), np.concatenate([g, *states], axis=1)
    emitted = np.stack([np.bincount(ids, weights=row, minlength=len(ratio)) for row in seen], axis=1)
    return g.sum(axis=1), moved * move, emitted, total


def _maximised(starts: np.ndarray, moved: np.ndarray, emitted: np.ndarray, share: np.ndarray):
    start = (starts + 1) / (starts.sum() + len(starts))
    move = (moved + 1) / (moved.sum(axis=1, keepdims=True) + len(starts))
    emit = (emitted + SMOOTHING * share[:, None]) / (emitted.sum(axis=0) + SMOOTHING)
    return start, move, emit / share[:, None]


def _batches(sequences: Iterable[np.ndarray]) -> Iterator[list[np.ndarray]]:
    part, n = [], 0
    for t in sequences:
        part.append(t)
        n += len(t)
        if n >= BATCH_TOKENS:
            yield part
            part, n = [], 0
    if part:
        yield part


def _sequences(column: Iterable[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int16) for x in column]


def _mapped(texts: list[bytes | None], mapper: Mapper) -> list[pa.Array]:
    """n_tokens, n_held, logs, rest, times and ids of texts, see sequences()."""
    at = mapper.map(texts)
    sizes = np.array([len(x) for x in at], np.int64)
    at = np.concatenate(at)
    logs, begins = mapper.logs[at], sizes.cumsum() - sizes
    lacking = np.nonzero(logs < 0)[0]
    # the words of each text that tasks do not hold, once each
    rows = np.searchsorted(begins, lacking, side="right") - 1
    keys, times = np.unique(rows * len(mapper.words) + at[lacking], return_counts=True)
    rows, rest = np.divmod(keys, len(mapper.words))
    ends = pa.array(np.searchsorted(rows, np.arange(len(sizes) + 1)), pa.int32())
    logs[lacking] = 0.0
    held = sizes - np.bincount(rows, weights=times, minlength=len(sizes)).astype(np.int64)
    offsets = np.r_[0, 2 * sizes.cumsum()].astype(np.int32)
    return [
        pa.array(sizes),
        pa.array(held),
        pa.array(np.add.reduceat(logs, begins)),
        pa.ListArray.from_arrays(ends, pa.array([mapper.words[i] for i in rest.tolist()], pa.binary())),
        pa.ListArray.from_arrays(ends, pa.array(times, pa.int64())),
        pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(mapper.classes[at])]),
    ]


def sequences(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """docs(doc_id, text, held_out) with each whole text as classes, written as a stage: n_tokens, the
    n_held of them whose counts tasks hold with the sum of their logs, and the rest by word. Rows have a
    row_id, as doc_ids may repeat."""
    shared = docs.sparkSession.sparkContext.broadcast(v)  # HELD_COUNTS words at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapper = Mapper(shared.value)
        for batch in batches:
            if batch.num_rows:
                doc_id, text, held_out = batch.columns
                yield pa.RecordBatch.from_arrays([doc_id, held_out, *_mapped(text.to_pylist(), mapper)], names=names)

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text(), "held_out")
    fields = "doc_id long, held_out boolean, n_tokens long, n_held long, logs double, rest array<binary>, times array<long>, ids binary"
    names = [f.split()[0] for f in fields.split(", ")]
    return write_stage(read.mapInArrow(run, fields).withColumn("row_id", F.monotonically_increasing_id()), "sequences")


def train(rows: DataFrame, v: Vocabulary, rounds: int = ROUNDS):
    """Start, transition and emission-ratio parameters by Baum-Welch over all rows of sequences().

    A round sums the expected counts of all documents across partitions, by class, and replaces the
    parameters; rounds go on until the likelihood settles. A bounded number of bounded documents only
    gives the seeds of the first round, from seeded noise. Where no document is short enough to be a
    seed, the noise is the seed.
    """
    spark = rows.sparkSession
    noise = np.random.default_rng(5)
    classes = HEAD_CLASSES + TAIL_CLASSES
    start, move = np.full(STATES, 1 / STATES), np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
    move /= move.sum(axis=1, keepdims=True)
    ratio = noise.gamma(2.0, 0.5, (classes, STATES))
    ratio /= (v.share[:, None] * ratio).sum(axis=0) / v.share.sum()
    few = rows.where(F.col("n_tokens") <= SEED_TOKENS).select("doc_id", "ids").orderBy(F.xxhash64("doc_id"), "doc_id", "ids").limit(SEED_DOCS).collect()
    some = [Batch(part) for part in _batches(_sequences([r["ids"] for r in few]))]
    for _ in range(SEED_ROUNDS if some else 0):
        sums = [expected_counts(b, start, move, ratio)[:3] for b in some]
        start, move, ratio = _maximised(*(sum(x) for x in zip(*sums, strict=True)), v.share)

    before = None
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(tuple(p.astype(np.float32) for p in (start, move, ratio)))

        def own(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            sums, gained = None, 0.0
            for part in _batches(chain.from_iterable(_sequences(pdf["ids"]) for pdf in batches)):
                *found, total = expected_counts(Batch(part), *now.value)
                sums = found if sums is None else [a + b for a, b in zip(sums, found, strict=True)]
                gained += float(total.sum())
            if sums is not None:
                # the last row: the log likelihood ratio of these documents
                table = np.vstack([sums[0][None, :], sums[1], sums[2], np.r_[gained, np.zeros(STATES - 1)][None, :]])
                met = np.nonzero(np.abs(table).sum(axis=1))[0]
                yield pd.DataFrame({"at": met.astype(np.int32)} | {f"s{k}": table[met, k] for k in range(STATES)})

        fields = ", ".join(f"s{k} double" for k in range(STATES))
        parts = rows.select("ids").mapInPandas(own, f"at int, {fields}")
        whole = parts.groupBy("at").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(STATES)]).toPandas()
        if not len(whole):
            break
        table = np.zeros((2 + STATES + classes, STATES))
        table[whole["at"].to_numpy()] = whole[[f"s{k}" for k in range(STATES)]].to_numpy()
        start, move, ratio = _maximised(table[0], table[1 : 1 + STATES], table[1 + STATES : -1], v.share)
        now.unpersist()
        gained = table[-1, 0] / v.total
        if before is not None and gained - before < SETTLED:
            break
        before = gained
    return start, move, ratio


def score(rows: DataFrame, counts: DataFrame, v: Vocabulary, parameters) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, one for each row of
    sequences().

    score is the log10 probability of the whole text: the forward recursion sums over all state
    sequences. Null and empty texts are the end token alone. Words that tasks do not hold go, with
    their number in the text, to a join with all counts; words unseen in training count 0.
    """
    shared = rows.sparkSession.sparkContext.broadcast(parameters)

    @F.pandas_udf("double")
    def lift(ids: pd.Series) -> pd.Series:
        parts = [forward(Batch(p), *shared.value)[0] for p in _batches(_sequences(ids))]
        return pd.Series(np.concatenate(parts) / math.log(10) if parts else [], dtype=float)

    rest = rows.where(F.size("rest") > 0).select("row_id", F.explode(F.arrays_zip("rest", "times")).alias("r")).select("row_id", F.col("r.rest").alias("word"), F.col("r.times").alias("times"))
    found = rest.join(counts, "word").groupBy("row_id").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_logs"))
    lifted = rows.select("row_id", "doc_id", "held_out", "n_tokens", "n_held", "logs", lift("ids").alias("lift"))
    both = lifted.join(found, "row_id", "left")
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_held") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * math.log10(v.total + v.distinct + 1)).alias("base_score"),
        (logs - F.col("n_tokens") * math.log10(v.norm) + F.col("lift")).alias("score"),
    )


def score_held_out(docs: DataFrame, folds: int = 7, held_out: int = 2, rounds: int = ROUNDS) -> DataFrame:
    """score() of all rows by a model of those whose crc32(doc_id as text) modulo folds is not
    held_out. Rows of a null doc_id count by the empty text. Columns beside doc_id and text are
    ignored. Without training rows every count is 0, and states differ by noise only; an empty table
    gives an empty result."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", (crc_mod(F.col("doc_id"), folds) == held_out).alias("held_out"))
    counts = write_stage(word_counts(rows.where("not held_out")), "words")
    v = vocabulary(counts)
    mapped = sequences(rows, v)
    return score(mapped, counts, v, train(mapped.where("not held_out"), v, rounds))
