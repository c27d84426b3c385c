"""Line dedup by overlapping three-line windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import packed

WINDOW = 3


def repeated_line_positions(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, text_key, removed): the 0-based line positions that later occurrences cover.

    Every run of `window` consecutive lines is hashed to 128 bits. A window that occurs more than
    once keeps its occurrence of lowest (doc_id, text key, position); nulls come first. All lines
    of the other occurrences are covered, and overlapping ones merge into one set of positions.
    Repeated rows of one doc_id and text are one document here, so they get one and the same result.
    """
    lines = F.split(F.col("text"), "\n")
    one = docs.where(F.col("text").contains("\n")).select("doc_id", F.xxhash64("text").alias("text_key"), lines.alias("lines"))
    one = one.where(F.size("lines") >= window)
    starts = F.sequence(F.lit(0), F.size("lines") - window)
    parts = lambda i: [F.get("lines", i + k) for k in range(window)]
    hashes = F.transform(starts, lambda i: F.struct(F.xxhash64(*parts(i)).alias("h1"), F.xxhash64(F.lit("second"), *parts(i)).alias("h2")))
    windows = one.select("doc_id", "text_key", F.posexplode(hashes).alias("pos", "h"))
    windows = windows.select(F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2"), F.struct("doc_id", "text_key", "pos").alias("at"))
    first = windows.groupBy("h1", "h2").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at")).where("first_at <> last_at")
    later = windows.join(first.select("h1", "h2", "first_at"), ["h1", "h2"]).where("at <> first_at").select("at.*")
    covered = F.collect_set("pos")
    steps = F.flatten(F.transform(covered, lambda p: F.sequence(p, p + window - 1)))
    return later.groupBy("doc_id", "text_key").agg(F.array_sort(F.array_distinct(steps)).alias("removed"))


def dedupe_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with text replaced by its kept lines, and n_lines, n_removed and removed_positions.

    Every row of docs stays, in whatever order. Null texts stay null and texts of fewer than
    `window` lines stay as they are, as do columns beside doc_id and text. A text whose lines all
    go becomes the empty text. Extra columns that bear the name of an added column are replaced by
    it; all others, whatever their names, pass through. Only built-in expressions, two equi-joins and
    grouped minima run.
    """
    removed = repeated_line_positions(docs, window)
    rows, unpacked = packed(docs, F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_key"), without={"n_lines", "n_removed", "removed_positions"})
    joined = rows.join(removed, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_key") == F.col("text_key")), "left")
    names = joined.schema["row"].dataType.names
    text = F.col("row").getField(next(c for c in names if c.lower() == "text"))
    # the lines as a column of their own, split once: in a lambda they would be split again for each line
    joined = joined.select("row", "removed", F.split(text, "\n").alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("removed"))
    rest = F.array_join(F.transform(left, lambda p: F.get("lines", p)), "\n")
    return joined.select(
        *[F.when(F.col("removed").isNull(), text).otherwise(rest).alias(c) if c.lower() == "text" else column for c, column in zip(names, unpacked, strict=True)],
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed_positions"),
    )
