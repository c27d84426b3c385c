"""Helpers that the operators of this subpackage share: written stages, tokens, table access."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.shared import give_back, shared_dir, small_batches, tidy  # noqa: F401

#: ASCII white space splits words: the complement of [^\x20\x09-\x0D]+.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_stage(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here and
    a lost executor costs no more than the stage that was running."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry-stages/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def drop_stage(df: DataFrame) -> None:
    """Remove a written stage that no later plan reads."""
    path = getattr(df, "stage_path", None)
    if path:
        spark = df.sparkSession
        hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def few_rows(spark: SparkSession, rows: list[tuple], **columns: pa.DataType) -> DataFrame:
    """Rows of the driver, a few, as a DataFrame. From a list alone Spark would read them with Python workers
    on the executors."""
    values = [[r[i] for r in rows] for i in range(len(columns))]
    return spark.createDataFrame(pa.table([pa.array(v, t) for v, t in zip(values, columns.values(), strict=True)], names=list(columns)))


def packed(df: DataFrame, *added: Column, without: frozenset[str] | set[str] = frozenset()) -> tuple[DataFrame, list[Column]]:
    """df as one struct column `row` and the added columns, whose names no column of df can clash with
    then, and the columns that unpack it again. Columns named in `without` (lower case) are left out."""
    names = [c for c in df.columns if c.lower() not in without]
    own = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in names])
    return df.select(own.alias("row"), *added), [F.col("row").getField(c).alias(c) for c in names]


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased words between ASCII white space; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser over whole arrays."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x1B873593CC9E2D51) % 2**64)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
        return x ^ (x >> np.uint64(32))


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text. A text with fewer
    words than size is one shingle; one without words has none."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    n = max(1, len(h) - size + 1)
    width = min(size, len(h))
    total = np.full(n, width, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            total += mix64(h[j : j + n], j + 1)
    return np.unique(mix64(total))
