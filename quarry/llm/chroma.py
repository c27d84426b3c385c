"""Media columns: chroma audio fingerprints, and alignment of recordings by them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import drop_stage, small_batches, write_stage

#: Frame and hop at FRAME_RATE, to which other rates are brought; rates outside the bounds are refused.
FRAME_RATE, FRAME, HOP = 5512, 1024, 256
LOWEST_RATE, HIGHEST_RATE = 2000, 384_000
#: Notes that count, from A1 on, in equal temperament.
LOWEST_HZ, OCTAVES = 55.0, 5
#: Weights by which neighbouring frames are averaged.
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25]) / 3
#: Recordings that a worker holds at a time.
BATCH = 128
#: Places of one value in recordings that a task joins at a time; lists beyond it are split by hash.
SPLIT = 20_000
#: (rectangle pattern, first pitch class, pitch classes, frames): 16 filters by rule.
FILTERS = [(k % 4, (5 * k) % 12, 2 + k % 5, 4 + 3 * (k % 6)) for k in range(16)]
WIDEST = max(f[3] for f in FILTERS)


_HZ = np.fft.rfftfreq(FRAME, 1 / FRAME_RATE)
_INSIDE = (_HZ >= LOWEST_HZ) & (_HZ < LOWEST_HZ * 2**OCTAVES)
_BINS = np.eye(12)[np.round(12 * np.log2(_HZ[_INSIDE] / LOWEST_HZ)).astype(np.int64) % 12]
_WINDOW = np.hanning(FRAME)


def resampled(samples: np.ndarray, rate: float) -> np.ndarray:
    """A signal at FRAME_RATE: frequencies beyond its range are filtered out first (a windowed sinc),
    then samples are interpolated."""
    if rate == FRAME_RATE or not len(samples):
        return samples
    if rate > FRAME_RATE:
        half = int(np.ceil(8 * rate / FRAME_RATE))
        kernel = np.sinc(np.arange(-half, half + 1) * FRAME_RATE / rate) * np.hanning(2 * half + 3)[1:-1]
        samples = np.convolve(samples, kernel / kernel.sum(), mode="full")[half : half + len(samples)]
    n = int(len(samples) * FRAME_RATE / rate)
    return np.interp(np.arange(n) * (rate / FRAME_RATE), np.arange(len(samples)), samples)


def chroma(samples: np.ndarray, rate: float) -> np.ndarray:
    """Frames by 12 pitch classes of a mono signal, each frame of unit length; silence is zero."""
    samples = resampled(samples, rate)
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = np.concatenate([np.abs(np.fft.rfft(frames[i : i + 2048] * _WINDOW, axis=1)[:, _INSIDE]) ** 2 @ _BINS for i in range(0, len(frames), 2048)])
    out = out / np.maximum(out.sum(axis=1, keepdims=True), 1.0)
    padded = np.pad(out, ((len(SMOOTH) // 2, len(SMOOTH) // 2), (0, 0)), mode="edge")
    out = np.tensordot(np.lib.stride_tricks.sliding_window_view(padded, len(SMOOTH), axis=0), SMOOTH, axes=(2, 0))
    length = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.where(length > 1e-3, out / np.maximum(length, 1e-3), 0)


def packed(image: np.ndarray) -> np.ndarray:
    """One 32-bit integer for each run of WIDEST frames: sixteen filters over the integral image,
    each a difference of rectangle sums in logs, in two Gray-coded bits."""
    n = len(image) - WIDEST + 1
    if n <= 0 or not image.any():
        return np.empty(0, np.uint32)
    wide = np.hstack([image, image])  # pitch classes are a circle
    total = np.zeros((len(wide) + 1, 25))
    total[1:, 1:] = wide.cumsum(axis=0).cumsum(axis=1)
    t = np.arange(n)

    def area(t0, t1, y0, y1):
        return total[t + t1, y1] - total[t + t0, y1] - total[t + t1, y0] + total[t + t0, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        whole = area(0, w, y, y + h)
        half = [area(0, w // 2, y, y + h), area(0, w, y, y + h // 2), area(0, w // 2, y, y + h // 2) + area(w // 2, w, y + h // 2, y + h), area(w // 3, w - w // 3, y, y + h)][kind]
        value = np.log1p(half) - np.log1p(whole - half)
        level = (value > -0.25).astype(np.uint32) + (value > 0) + (value > 0.25)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1))).astype(np.uint32)
    return out


def fingerprint(media: DataFrame, audio: str = "audio", rate: str = "rate") -> DataFrame:
    """media with fingerprint, an array of integers, of a binary column of 16-bit little-endian mono
    samples. Null, empty, silent and too short recordings have an empty one, and so have those whose rate
    is null, not finite or outside LOWEST_RATE to HIGHEST_RATE. Extra columns pass through; one named fingerprint is replaced."""
    small_batches(media.sparkSession, BATCH)

    @F.pandas_udf("array<int>")
    def printed(sounds: pd.Series, rates: pd.Series) -> pd.Series:
        out = []
        for sound, r in zip(sounds, rates, strict=True):
            usable = sound is not None and len(sound) > 1 and r is not None and LOWEST_RATE <= r <= HIGHEST_RATE
            x = np.frombuffer(sound[: len(sound) // 2 * 2], "<i2").astype(np.float64) / 32768 if usable else np.empty(0)
            out.append(packed(chroma(x, float(r))).view(np.int32) if usable else np.empty(0, np.int32))
        return pd.Series(out, dtype=object)

    return media.withColumn("fingerprint", printed(audio, rate))


def align(queries: DataFrame, recordings: DataFrame, most_errors: float = 0.2, least: int = 4) -> DataFrame:
    """Rows (query_id, id, offset, votes, bit_errors) of recordings that align with a query.

    Both sides have id and fingerprint. Every pair of equal values is a vote for an offset (place in
    the recording less place in the query), and a pair of recordings whose best offset has `least`
    votes is aligned there; of offsets with equally many votes the one of fewest bit errors over the
    overlap counts, and of those the smallest. Pairs whose share of unlike bits exceeds most_errors
    go. A recording never matches its own id; null ids and empty fingerprints match nothing; repeated
    rows give repeated results. Other columns are ignored.

    Equal fingerprints form a class that votes once. Votes are an equi-join on the value, summed by
    (query, recording, offset) in Spark; whole fingerprints join only pairs with enough votes. Places
    of a frequent value are split by hash, so that no value is left to one task.
    """

    def marked(df: DataFrame, asks: bool) -> DataFrame:
        some = df.where("id is not null and size(fingerprint) > 0").select(F.col("id").cast("long").alias("id"), "fingerprint")
        return some.withColumn("asks", F.lit(asks))

    both = marked(queries, True).unionByName(marked(recordings, False))
    both = write_stage(both.select("id", "asks", "fingerprint", F.xxhash64("fingerprint").alias("h1"), F.xxhash64(F.lit("second"), "fingerprint").alias("h2")), "recordings")
    key = ["h1", "h2"]
    classes = both.groupBy(*key).agg(F.first("fingerprint").alias("fingerprint"), F.bool_or("asks").alias("asking"), F.bool_or(~F.col("asks")).alias("held"))
    classes = write_stage(classes.withColumn("node", F.monotonically_increasing_id()), "fingerprint-classes")
    members = both.select("id", "asks", *key).join(classes.select(*key, "node"), key)

    place = F.posexplode("fingerprint").alias("place", "value")
    held = classes.where("held").select(F.col("node").alias("other"), place).withColumnRenamed("place", "at")
    parts = held.groupBy("value").agg(F.ceil(F.count(F.lit(1)) / SPLIT).cast("int").alias("parts")).where("parts > 1")
    split = lambda df: df.join(parts, "value", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    held = split(held).select("value", "other", "at", F.pmod(F.xxhash64("other", "at"), "parts").cast("int").alias("part"))
    asked = split(classes.where("asking").select("node", place)).select("value", "node", "place", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    votes = asked.join(held, ["value", "part"]).groupBy("node", "other", (F.col("at") - F.col("place")).alias("offset")).agg(F.count(F.lit(1)).alias("votes"))
    votes = write_stage(votes.where(F.col("votes") >= least), "votes")

    most = votes.groupBy("node", "other").agg(F.max("votes").alias("most"))
    best = votes.join(most, ["node", "other"]).where("votes = most").select("node", "other", "offset", "votes")
    prints = classes.select("node", "fingerprint")
    best = best.join(prints, "node").join(prints.select(F.col("node").alias("other"), F.col("fingerprint").alias("second")), "other")
    a = F.when(F.col("offset") < 0, F.slice("fingerprint", 1 - F.col("offset"), F.size("fingerprint"))).otherwise(F.col("fingerprint"))
    b = F.when(F.col("offset") > 0, F.slice("second", F.col("offset") + 1, F.size("second"))).otherwise(F.col("second"))
    unlike = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(F.bit_count(x.bitwiseXOR(y).bitwiseAND(F.lit(0xFFFFFFFF))), F.lit(0))), F.lit(0), lambda s, x: s + x)
    best = best.select("node", "other", "offset", "votes", (unlike / (32.0 * F.least(F.size(a), F.size(b)))).alias("bit_errors"))
    one = best.groupBy("node", "other").agg(F.min(F.struct("bit_errors", "offset", "votes")).alias("m")).where(F.col("m.bit_errors") <= most_errors)
    one = write_stage(one.select("node", "other", F.col("m.offset").cast("int").alias("offset"), F.col("m.votes").cast("int").alias("votes"), F.col("m.bit_errors").alias("bit_errors")), "alignments")
    drop_stage(votes)
    asking = members.where("asks").select("node", F.col("id").alias("query_id"))
    found = one.join(asking, "node").join(members.where("not asks").select(F.col("node").alias("other"), "id"), "other")
    return found.where("query_id <> id").select("query_id", "id", "offset", "votes", "bit_errors")


def sonify(vectors: DataFrame, seconds_per_note: float = 0.1) -> DataFrame:
    """Stand-in recordings for tables without media: each vector as a tune, a note a component, its
    pitch the component's rank among 24 steps of the vector's own spread. vec_id, audio, rate."""

    @F.pandas_udf("binary")
    def tune(rows: pd.Series) -> pd.Series:
        out = []
        for row in rows:
            x = np.asarray(row if row is not None else [], float)
            x = x[np.isfinite(x)]
            if not len(x) or not x.any():
                out.append(b"")
                continue
            step = np.clip(np.round(6 * x / np.sqrt((x * x).mean())), -12, 12)
            hz = np.repeat(220 * 2 ** (step / 12), int(FRAME_RATE * seconds_per_note))
            out.append((np.sin(2 * np.pi * np.cumsum(hz) / FRAME_RATE) * 12000).astype("<i2").tobytes())
        return pd.Series(out, dtype=object)

    return vectors.select("vec_id", tune("embedding").alias("audio"), F.lit(FRAME_RATE).alias("rate"))
