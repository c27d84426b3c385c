"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import WORD_PATTERN, few_rows, give_back, packed, write_stage

#: Documents of one (source, size) cell are ranked in hash groups of about this many rows.
GROUP_ROWS = 50_000
#: One row per source goes to the driver; this many fit it with ease.
MAX_SOURCES = 1_000_000


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: dict[str | None, int], weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict:
    """Target tokens by source. Sources in code point order, null last, take the weights in turn and
    split share * all tokens by them; a target stops at most * its source's tokens and the excess
    is shared anew by weight among the others until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8", "surrogatepass")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_sources, target = share * sum(sizes.values()), list(order), {}
    while open_sources:
        total = sum(weight[s] for s in open_sources)
        full = [s for s in open_sources if left * weight[s] / total >= most * sizes[s]]
        if not full:
            return target | {s: left * weight[s] / total for s in open_sources}
        for s in full:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in full)
        open_sources = [s for s in open_sources if s not in target]
    return target


def _tilted(lam: float, size, scale: float, most: float):
    return F.round(F.least(F.lit(float(most)), F.exp(F.least(F.lit(50.0), lam * size / scale))), 12)


def solve_tilts(cells: DataFrame, targets: DataFrame, most: float = 2.0, rounds: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """Newton's method on the convex dual of entropy balancing, all sources in one Spark job a round.

    The document rates that lie closest in relative entropy to 1, given the tokens of each source
    and a ceiling, are min(most, exp(lambda * size / scale)): one multiplier per source. A round
    sums gradient and curvature over the cells (source, size, n) and takes the Newton step, kept
    inside the bracket found so far (halving it otherwise). targets has source, target,
    source_size and scale; returns source, lam, where a source whose target is its ceiling has
    the largest multiplier and one without tokens has 0.
    """
    spark = cells.sparkSession
    rows = targets.collect()  # one row per source
    state = {r["source"]: {"lam": 0.0, "lo": -np.inf, "hi": np.inf, "target": r["target"], "scale": r["scale"], "done": r["source_size"] == 0, "most": most * r["source_size"]} for r in rows}
    for s in state.values():
        if not s["done"] and s["target"] >= s["most"] * (1 - 1e-12):
            s |= {"lam": 1e6, "done": True}
    exact = lambda x: F.sum(x.cast("decimal(30,6)")).cast("double")  # in any order the same
    for _ in range(rounds):
        todo = [(k, s["lam"], s["scale"]) for k, s in state.items() if not s["done"]]
        if not todo:
            break
        now = few_rows(spark, todo, source=pa.string(), lam=pa.float64(), scale=pa.float64())
        w = _tilted(F.col("lam"), F.col("size"), F.col("scale"), most)
        joined = cells.join(F.broadcast(now), cells["source"].eqNullSafe(now["source"])).select(cells["source"], "n", "size", "scale", w.alias("w"))
        sums = joined.groupBy("source").agg(
            exact(F.col("n") * F.col("size") * F.col("w")).alias("got"),
            exact(F.when(F.col("w") < most, F.col("n") * F.col("size") * F.col("w") * F.col("size") / F.col("scale")).otherwise(0.0)).alias("slope"),
        )
        for r in sums.collect():
            s = state[r["source"]]
            gap = s["target"] - r["got"]
            if abs(gap) <= tolerance * max(1.0, s["target"]):
                s["done"] = True
                continue
            s["lo" if gap > 0 else "hi"] = s["lam"]
            step = s["lam"] + gap / r["slope"] if r["slope"] > 0 else np.inf
            if not s["lo"] < step < s["hi"] or abs(step) > 1e6:
                if np.isfinite(s["lo"]) and np.isfinite(s["hi"]):
                    step = (s["lo"] + s["hi"]) / 2
                else:
                    step = 2 * s["lam"] + (1.0 if gap > 0 else -1.0)
            s["lam"] = float(step)
    return few_rows(spark, [(k, s["lam"]) for k, s in state.items()], source=pa.string(), lam=pa.float64())


def _spread(cells: pd.DataFrame) -> pd.DataFrame:
    """Whole copies for the cells of one source: from long to short documents, each cell takes the
    sum of its rates plus what rounding has left over so far, so that the source ends within about half
    its shortest document of its target."""
    cells = cells.sort_values("size", ascending=False)
    size, n, rate, most = (cells[c].to_numpy() for c in ("size", "n", "rate", "most"))
    copies, left = np.zeros(len(cells), np.int64), 0.0
    for i in range(len(cells)):
        if size[i]:
            left += rate[i] * n[i] * size[i]
            copies[i] = min(max(round(left / size[i]), 0), int(most[i] * n[i]))
            left -= copies[i] * size[i]
    out = cells.assign(copies=copies).drop(columns=["most", "text_source", "no_source"])
    give_back()
    return out


def plan_mix(rows: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2) -> tuple[DataFrame, int]:
    """How often a mix takes rows(source, size, luck), by (source, size, hash group): base copies
    for each row and one more up to a threshold of luck. Also the number of hash groups.

    Cells are the distinct (source, size) pairs; the cells of one source meet in one task, the rows
    of a cell in hash groups of about GROUP_ROWS, so neither a source nor a group of copies with a
    third of all rows does. The driver sees one row per source (MAX_SOURCES at most, else it raises).
    """
    spark = rows.sparkSession
    cells = write_stage(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "cells")
    per_source = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs"), F.max("n").alias("largest"))
    found = per_source.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    targets = source_targets({r["source"]: r["source_size"] for r in found}, weights, share, most)
    sources = [(r["source"], r["source_size"], float(targets[r["source"]]), max(1.0, r["source_size"] / r["n_docs"])) for r in found]
    by_source = few_rows(spark, sources, source=pa.string(), source_size=pa.int64(), target=pa.float64(), scale=pa.float64())
    tilts = solve_tilts(cells, by_source, most)
    known = by_source.join(tilts, by_source["source"].eqNullSafe(tilts["source"])).select(by_source["*"], "lam")
    known = F.broadcast(known.withColumnRenamed("source", "of_source"))  # one row per source
    rated = cells.join(known, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    rated = rated.withColumn("rate", F.when(F.col("size") > 0, _tilted(F.col("lam"), F.col("size"), F.col("scale"), most)).otherwise(0.0))
    want = rated.select("source", "size", "n", "rate", "source_size", "target", F.lit(most).alias("most"), F.coalesce("source", F.lit("")).alias("text_source"), F.col("source").isNull().alias("no_source"))
    copies = want.groupBy("text_source", "no_source").applyInPandas(_spread, "source string, size long, n long, rate double, source_size long, target double, copies long")

    n_groups = max(1, -(-max((r["largest"] for r in found), default=1) // GROUP_ROWS))
    rows = rows.withColumn("grp", F.pmod("luck", F.lit(n_groups)))
    counted = rows.groupBy("source", "size", "grp").agg(F.count(F.lit(1)).alias("group_n")).withColumnsRenamed({"source": "of_source", "size": "of_size"})
    same_cell = F.col("source").eqNullSafe(F.col("of_source")) & (F.col("size") == F.col("of_size"))
    split = copies.join(counted, same_cell).drop("of_source", "of_size")
    base = F.floor(F.col("copies") / F.col("n"))
    split = split.withColumn("base", base).withColumn("rest", F.col("copies") - base * F.col("n"))
    upto = F.sum("group_n").over(Window.partitionBy("source", "size").orderBy("grp"))
    share_to = lambda c: F.floor(F.col("rest") * c / F.col("n"))
    split = split.withColumn("upto", upto).withColumn("extra", share_to(F.col("upto")) - share_to(F.col("upto") - F.col("group_n")))
    split = write_stage(split.select("source", "size", "grp", "rate", "source_size", "target", "base", "extra"), "groups")

    order = Window.partitionBy("source", "size", "grp").orderBy("luck")
    some = split.where("extra > 0").select(F.col("source").alias("of_source"), F.col("size").alias("of_size"), F.col("grp").alias("of_grp"), "extra")
    same = same_cell & (F.col("grp") == F.col("of_grp"))
    ranked = rows.select("source", "size", "grp", "luck").withColumn("place", F.row_number().over(order)).join(some, same)
    last = ranked.where("place = extra").select("of_source", "of_size", "of_grp", F.col("luck").alias("last_luck"))
    return write_stage(split.join(last, same, "left").drop("of_source", "of_size", "of_grp", "extra"), "mix-plan"), n_groups


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """docs with size, source_size, target, rate and copies: how often the mix takes each row.

    size is the number of words (null text: 0). Rates come from solve_tilts(): rows of one source
    and size have one rate. Their copies are rounded together, and rows of lowest hash of id and
    text take what is left over, so reruns agree, no row exceeds `most` copies, and a source ends
    within about half its shortest document of its target. Null sources are one source, sorted
    last. Whole repeated rows share their decision. A row without words takes none; an empty table
    gives an empty result. Extra columns pass through; those that bear an added column's name are
    replaced.
    """
    size, luck = word_count().alias("size"), F.xxhash64(F.lit("mix"), "doc_id", "text").alias("luck")
    plan, n_groups = plan_mix(write_stage(docs.select("source", size, luck), "sizes"), weights, share, most)
    plan = plan.withColumnsRenamed({"source": "of_source", "size": "of_size", "grp": "of_grp"})
    rows, unpacked = packed(docs, F.col("source"), size, luck, without={"size", "source_size", "target", "rate", "copies"})
    same = F.col("source").eqNullSafe(F.col("of_source")) & (F.col("size") == F.col("of_size")) & (F.pmod("luck", F.lit(n_groups)) == F.col("of_grp"))
    copies = F.col("base") + F.coalesce(F.col("luck") <= F.col("last_luck"), F.lit(False)).cast("long")
    return rows.join(plan, same, "left").select(*unpacked, "size", "source_size", "target", "rate", copies.cast("long").alias("copies"))


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """Each row of mix() as often as its copies say; rows without copies, or with null, go."""
    rows, unpacked = packed(mixed.where("copies > 0"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return rows.select(*unpacked)
