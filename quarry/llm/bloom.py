"""Blocked Bloom filters over 64-bit hashes, of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import mix64

#: Largest filter: beyond its capacity more keys pass to the join, and results stay the same.
MAX_FILTER_BYTES = 32 << 20
#: A block is eight 32-bit words, and a key sets one bit in each.
WORDS = 8


def _bits(keys: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each key, and its eight one-bit words."""
    block = (mix64(keys, 31) % np.uint64(n_blocks)).astype(np.int64)
    second = mix64(keys, 32)
    turns = np.arange(WORDS, dtype=np.uint64) * np.uint64(5)
    return block, (np.uint64(1) << ((second[:, None] >> turns) & np.uint64(31))).astype(np.uint32)


def build_filter(keys: DataFrame, n_keys: int, column: str = "key_hash", bits_per_key: int = 16) -> np.ndarray:
    """The filter over a column of 64-bit hashes: partitions OR their own blocks, then Spark ORs
    those by block. Its size follows n_keys up to MAX_FILTER_BYTES."""
    n_blocks = max(1, min(MAX_FILTER_BYTES // (4 * WORDS), -(-n_keys * bits_per_key // (32 * WORDS))))

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            block, words = _bits(pdf[column].to_numpy(np.int64).view(np.uint64), n_blocks)
            met, at = np.unique(block, return_inverse=True)
            merged = np.zeros((len(met), WORDS), np.uint32)
            np.bitwise_or.at(merged, at, words)
            yield pd.DataFrame({"block": met} | {f"w{k}": merged[:, k].astype(np.int64) for k in range(WORDS)})

    fields = ", ".join(f"w{k} long" for k in range(WORDS))
    blocks = keys.select(column).where(F.col(column).isNotNull()).mapInPandas(own, f"block long, {fields}")
    whole = blocks.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)])
    out = np.zeros((n_blocks, WORDS), np.uint32)
    rows = whole.toPandas()  # n_blocks rows at most
    out[rows["block"].to_numpy(np.int64)] = rows[[f"w{k}" for k in range(WORDS)]].to_numpy(np.int64).astype(np.uint32)
    return out


def possible(bloom: np.ndarray, spark):
    """A function of an array of hashes that keeps those the filter may hold."""
    shared = spark.sparkContext.broadcast(bloom)

    @F.pandas_udf("array<boolean>")
    def probe(hashes: pd.Series) -> pd.Series:
        sizes = hashes.map(len).to_numpy()
        flat = np.concatenate([*hashes, np.empty(0, np.int64)]).astype(np.int64).view(np.uint64)
        block, words = _bits(flat, len(shared.value))
        hit = ((shared.value[block] & words) == words).all(axis=1)
        return pd.Series(np.split(hit, np.cumsum(sizes)[:-1]) if len(sizes) else [], dtype=object)

    return probe.asNondeterministic()  # keeps a filter on its result above the distinct


def held(bloom: np.ndarray, spark, hashes: Column) -> Column:
    """Whether the filter may hold each hash; never false for one it was built from."""
    shared = spark.sparkContext.broadcast(bloom)

    @F.pandas_udf("boolean")
    def probe(keys: pd.Series) -> pd.Series:
        block, words = _bits(keys.to_numpy(np.int64).view(np.uint64), len(shared.value))
        return pd.Series(((shared.value[block] & words) == words).all(axis=1))

    return probe.asNondeterministic()(hashes)
