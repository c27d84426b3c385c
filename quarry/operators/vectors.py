"""Vector search by blocks: the best of each query without a row for each pair, and an embedder of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import tokens

#: Vectors and queries of one block, which a task multiplies at a time.
BLOCK, ASKED = 1024, 256
DIMS = 256


@dataclass(frozen=True)
class Contract:
    """What the vectors of an index have in common: two indexes of one contract may be compared."""

    provider: str
    model: str
    dims: int
    metric: str = "COSINE"

    def check(self, width: int) -> None:
        if width != self.dims:
            raise ValueError(f"{self.provider}/{self.model} has vectors of {self.dims} numbers, not {width}")


HASHING = Contract("hashing", "signed-256", DIMS)


def token_codes(text: Column) -> Column:
    """A code of 12 bits for each token of a text: 8 for its dimension, and the sign (from md5)."""
    return F.transform(tokens(text), lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 1, 3), 16, 10).cast("int"))


def hashed(codes: pa.ListArray) -> np.ndarray:
    """Signed token counts by dimension, a row for each list of codes. Whole numbers: sums are exact."""
    flat = codes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(codes)), codes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    out = np.zeros((len(codes), DIMS))
    np.add.at(out, (row, flat >> 4), np.where(flat & 8, -1.0, 1.0))
    return out


def plain(vectors: pa.ListArray) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))


def weighed_queries(asked: DataFrame, text: str, index: DataFrame) -> DataFrame:
    """asked with `vector`: signed token counts, each token weighed by how rare it is among the index's texts
    (whole bits of n / documents that have it). index has `words`, the distinct tokens of each row."""
    words = asked.select("query_id", F.explode(tokens(F.col(text))).alias("word"))
    found = index.select(F.explode("words").alias("word")).join(words.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    size = index.agg(F.count(F.lit(1)).alias("n"))
    bits = F.length(F.bin(F.floor(F.col("n") / F.coalesce("df", F.lit(1))).cast("long")))
    m = F.md5(F.col("word").cast("binary"))
    sign = F.when(F.substring(m, 3, 1) < "8", 1).otherwise(-1)
    parts = words.join(found, "word", "left").join(F.broadcast(size)).select("query_id", F.conv(F.substring(m, 1, 2), 16, 10).cast("int").alias("dim"), (sign * bits).alias("x"))
    summed = parts.groupBy("query_id", "dim").agg(F.sum("x").cast("double").alias("x"))
    by_dim = summed.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("dim", "x"))).alias("by_dim"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(DIMS - 1)), lambda i: F.coalesce(F.try_element_at("by_dim", i), F.lit(0.0)))
    return asked.join(by_dim, "query_id").withColumn("vector", dense).drop("by_dim")


def _counted(rows: DataFrame, on: list[str], size: int) -> DataFrame:
    return rows.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / size).cast("long").alias("n_blocks"))


def _blocks(rows: DataFrame, n: DataFrame, on: list[str], order: str, item: Column, name: str) -> DataFrame:
    """Lists of rows: each key's are dealt by hash, so that a key with many has many lists. n has a row for each key."""
    dealt = rows.join(F.broadcast(n), on).withColumn("block", F.pmod(F.xxhash64(order), F.col("n_blocks")))
    return dealt.groupBy(*on, "block").agg(F.collect_list(item).alias(name))


def _best(dense: Callable[[pa.ListArray], np.ndarray], digits: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block of queries and vectors the best of each query, by score and then by id."""
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for q, c in zip(batch["q"], batch["c"], strict=True):
                asked, rows = q.values, c.values
                x, y = plain(asked.field("vector")), dense(rows.field("vector"))
                ids = np.array(rows.field("id").to_pylist(), object)
                norms = np.sqrt((x * x).sum(axis=1)[:, None] * (y * y).sum(axis=1)[None, :])
                with np.errstate(invalid="ignore", divide="ignore"):
                    scores = (x @ y.T) / norms
                scores[~(norms > 0)] = np.nan
                if digits is not None:
                    scores = np.round(scores, digits)
                for query, own, limit, s in zip(asked.field("query_id").to_pylist(), asked.field("self_id").to_pylist(), asked.field("limit").to_pylist(), scores, strict=True):
                    at = np.nonzero(~np.isnan(s) & (ids != own))[0]
                    if len(at) > limit:
                        edge = np.partition(s[at], len(at) - limit)[len(at) - limit]
                        more, even = at[s[at] > edge], at[s[at] == edge]
                        even = even[np.argsort(ids[even], kind="stable")][: limit - len(more)]
                        at = np.concatenate([more, even])
                    out[0].extend([query] * len(at))
                    out[1].extend(ids[at])
                    out[2].extend(s[at].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], names=["query_id", "id", "raw_score"])

    return run


def top_k(asked: DataFrame, index: DataFrame, on: list[str], dense: Callable[[pa.ListArray], np.ndarray] = plain, digits: int | None = None) -> DataFrame:
    """(query_id, id, raw_score, rank) of the nearest vectors by cosine, exact.

    asked has query_id, vector, limit and the columns of `on`, perhaps several rows a query (its spaces) and
    self_id, which it never meets; index has id, vector and the columns of `on`. Queries and vectors of a
    key meet as blocks: a task multiplies two blocks and hands on `limit` rows a query, of which Spark keeps the best. So
    no row is made for a pair, and a key with a third of all vectors is many blocks. Vectors that are
    null or of length zero are near nothing."""
    own = F.col("self_id") if "self_id" in asked.columns else F.lit(None).cast("string")
    asked, index = asked.where("vector is not null"), index.where("vector is not null")
    index = index.join(asked.select(*on).distinct(), on, "left_semi")  # keys that nobody asks are not dealt
    n_asked, n_index = _counted(asked, on, ASKED), _counted(index, on, BLOCK)
    queries = _blocks(asked, n_asked, on, "query_id", F.struct("query_id", own.alias("self_id"), F.col("limit").cast("int").alias("limit"), F.col("vector").cast("array<double>").alias("vector")), "q")
    vectors = _blocks(index, n_index, on, "id", F.struct("id", "vector"), "c")
    # each list of queries goes to each block of its key: blocks, not keys, are dealt to tasks
    queries = queries.drop("block").join(n_index, on).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    pairs = vectors.join(queries, [*on, "block"]).select("q", "c")
    best = pairs.mapInArrow(_best(dense, digits), "query_id long, id string, raw_score double")
    limits = asked.groupBy("query_id").agg(F.max("limit").alias("limit"))
    order = Window.partitionBy("query_id").orderBy(F.desc("raw_score"), "id")
    ranked = best.withColumn("rank", F.row_number().over(order)).join(limits, "query_id")
    return ranked.where("rank <= limit").drop("limit")
