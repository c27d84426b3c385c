"""Embedding near-dedup by a pivot-permutation index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import drop_stage, write_stage
from quarry.llm.components import block_turns, connected_components, local_roots, named_by_smallest

#: Nearest pivots by which a vector is listed.
PREFIX = 12
#: Vectors sampled for pivots: 4 * sqrt(vectors) within these bounds, those of lowest hash of id.
FEWEST_PIVOTS, MOST_PIVOTS = 256, 4096
#: Pivots have no greater cosine with each other: the first of these that leaves an eighth of the
#: sample, or else the first. A tight group, however large, so owns few pivots.
APART = (0.7, 0.8, 0.9)
#: Vectors of one list are compared in blocks of about this many.
BLOCK = 768


def _unit(rows: pd.Series) -> np.ndarray:
    x = np.stack(rows.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _thin(sample: np.ndarray) -> tuple[np.ndarray, float]:
    """The pivots among unit vectors, in their order, and the cosine that no two of them exceed."""
    found = []
    for apart in APART:
        open_, kept = np.ones(len(sample), bool), []
        for i in range(len(sample)):
            if open_[i]:
                kept.append(i)
                open_[i + 1 :] &= sample[i + 1 :] @ sample[i] <= apart
        found.append((sample[kept], apart))
        if 8 * len(kept) >= len(sample):
            return found[-1]
    return found[0]


def _reach(apart: float, cosine: float) -> tuple[float, float]:
    """Cosines (own, near). At most PREFIX pivots lie within `near` of any vector: seen from it, their
    directions have pairwise cosines of -1 / (PREFIX - 1) or less. So if x is within `own` of a
    pivot, that pivot is among the PREFIX nearest of every y linked with x, and within `near` of y."""
    near = np.arcsin(np.sqrt((1 - apart) * (PREFIX - 1) / PREFIX))
    own = near - np.arccos(min(1.0, cosine))
    return (float(np.cos(own)) + 1e-9 if own > 0 else 2.0), float(np.cos(near)) - 1e-9


def _listed(pivots: dict[int, tuple[np.ndarray, float]], n_pivots: int, cosine: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                if dim not in pivots:  # a length that the sample lacks
                    drawn = np.random.default_rng(int(dim)).normal(size=(n_pivots, int(dim)))
                    pivots[dim] = _thin(drawn / np.sqrt((drawn**2).sum(axis=1, keepdims=True)))
                known, apart = pivots[dim]
                own, near = _reach(apart, cosine)
                x = _unit(part["embedding"])
                cosines = x @ known.T
                k = min(PREFIX, cosines.shape[1])
                top = np.argpartition(-cosines, k - 1, axis=1)[:, :k].astype(np.int32)
                close = np.take_along_axis(cosines, top, axis=1)
                order = np.argsort(-close, axis=1, kind="stable")  # nearest first
                top, close = np.take_along_axis(top, order, axis=1), np.take_along_axis(close, order, axis=1)
                # a vector close to a pivot meets all its links there, and needs no list of far pivots
                sparse = close[:, 0] < own
                listed = (close >= near) | sparse[:, None]
                angles = np.arccos(np.clip(close, -1, 1))
                # every pivot within its radius lists the vector
                radius = angles[:, -1] if k < cosines.shape[1] else np.full(len(part), np.pi)
                radius = np.where(sparse, radius, np.minimum(radius, np.arccos(near)))
                rows = zip(top, angles.astype(np.float32), listed, strict=True)
                prefix, far = zip(*[(t[m], a[m]) for t, a, m in rows], strict=True)
                yield part[["node", "copies", "label", "dim"]].assign(unit=list(x), prefix=list(prefix), angles=list(far), radius=radius)

    return run


def _incidence(part: pd.DataFrame, names: np.ndarray) -> np.ndarray:
    out = np.zeros((len(part), len(names)), np.float32)
    rows = np.repeat(np.arange(len(part)), part["prefix"].map(len))
    out[rows, np.searchsorted(names, np.concatenate(part["prefix"].to_numpy()))] = 1
    return out


def _needed(part: pd.DataFrame, other: pd.DataFrame, angle: float) -> np.ndarray:
    """How many of its pivots a vector shares at least with another that is within the angle: all those
    that are nearer than the other's radius less the angle."""
    angles = np.full((len(part), PREFIX), np.inf, np.float32)
    for i, a in enumerate(part["angles"]):
        angles[i, : len(a)] = a
    bound = (other["radius"].to_numpy() - angle - 1e-5).astype(np.float32)
    return sum((angles[:, k][:, None] <= bound[None, :]).astype(np.int8) for k in range(PREFIX))


def _links(cosine: float):
    """Within one block pair of one list: links found here and in no list of an earlier pivot."""
    angle = float(np.arccos(min(1.0, cosine)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        same = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        left, right = pdf[pdf["side"] == 0], (pdf if same else pdf[pdf["side"] == 1])
        empty = pd.DataFrame({"node": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64")})
        if not len(left) or not len(right):
            return empty
        names = np.unique(np.concatenate(pdf["prefix"].to_numpy()))
        a, b = _incidence(left, names), _incidence(right, names)
        before = int(np.searchsorted(names, pdf["pivot"].iloc[0]))
        # a pair is met at the first pivot it shares, and is a candidate if it shares as many as links do
        candidate = a[:, :before] @ b[:, :before].T == 0
        candidate &= a @ b.T >= np.maximum(_needed(left, right, angle), _needed(right, left, angle).T)
        if not candidate.any():
            return empty
        x, y = np.stack(left["unit"].to_numpy()), np.stack(right["unit"].to_numpy())
        linked = candidate & (x @ y.T >= cosine) & (left["node"].to_numpy()[:, None] != right["node"].to_numpy()[None, :])
        if not linked.any():
            return empty
        ids = (left["node"].to_numpy(), right["node"].to_numpy())
        links = (linked @ right["copies"].to_numpy(), left["copies"].to_numpy() @ linked)
        roots = local_roots(linked, *ids)
        sides = (0,) if same else (0, 1)
        out = pd.concat([pd.DataFrame({"node": ids[s], "links": links[s], "root": roots[s]}) for s in sides])
        return out[out["links"] > 0]

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """Rows vec_id, n_links, component_id, kept, one per row of vectors(vec_id, embedding, label).

    Two rows are linked when their labels are equal and not null and their cosine, in double
    precision, reaches the bound. Vectors that are null, empty, zero or hold null or non-finite
    components, rows without label and rows with null vec_id link with nothing (a null vec_id has
    a null component and is kept); so do vectors of different lengths with each other. Identical
    vectors are linked and are compared once; repeated rows count as vectors of their own, and rows
    of one vec_id with different vectors have links and a component each. Other columns are ignored.

    Each vector is described by its PREFIX nearest pivots in their order; pivots are kept apart. Rows meet in
    the inverted list of a pivot (within label), in blocks, at the first pivot they share. Their shared
    pivots are counted: by the triangle inequality a link shares every pivot of one end that is nearer than the
    other's farthest listed one less the link's angle, so that pairs with fewer are no links, and
    only the others are verified. No link is lost of a vector close to a pivot (see _reach), so none within
    a tight group that has one; other pairs are lost if they share none of PREFIX pivots. Neither
    links nor vectors go to the driver, apart from the sample. A block gives sums of links and a
    spanning forest, not pairs.
    """
    spark = vectors.sparkSession
    values = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(values, lambda x: x != 0)
    usable = F.coalesce((F.size("embedding") > 0) & sound & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("string").alias("label"),
        F.coalesce(F.size("embedding"), F.lit(0)).alias("dim"),
        F.xxhash64("embedding").alias("h1"),
        F.xxhash64(F.lit("second"), "embedding").alias("h2"),
        usable.alias("usable"),
        "embedding",
    )
    key = ["label", "dim", "h1", "h2"]
    classes = rows.where("usable").groupBy(*key).agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
    # a class has a number of its own: several classes may hold one vec_id, if ids repeat
    classes = write_stage(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    n_pivots = int(min(MOST_PIVOTS, max(FEWEST_PIVOTS, 4 * classes.count() ** 0.5)))
    sample = classes.orderBy(F.xxhash64("id"), "id", "h1").limit(n_pivots).select("dim", "embedding").toPandas()
    pivots = {int(d): _thin(_unit(part["embedding"])) for d, part in sample.groupby("dim") if len(part) >= PREFIX}
    fields = "node long, copies long, label string, dim int, unit array<double>, prefix array<int>, angles array<float>, radius double"
    listed = write_stage(classes.select("node", "copies", "label", "dim", "embedding").mapInPandas(_listed(pivots, n_pivots, cosine), fields), "prefixes")
    posts = listed.select("node", "copies", "label", "dim", "unit", "prefix", "angles", "radius", F.explode("prefix").alias("pivot"))
    sizes = listed.select("label", "dim", F.explode("prefix").alias("pivot")).groupBy("label", "dim", "pivot").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    posts = posts.join(sizes, ["label", "dim", "pivot"]).withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    dealt = posts.withColumn("t", F.explode(block_turns(F.col("block"), blocks))).select("label", "dim", "pivot", "t.*", "node", "copies", "unit", "prefix", "angles", "radius")
    found = write_stage(dealt.groupBy("label", "dim", "pivot", "i", "j").applyInPandas(_links(cosine), "node long, links long, root long"), "vector-links")
    drop_stage(listed)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    names = named_by_smallest(connected_components(found, "node", "root"), classes)
    known = classes.select(*key, "id", "node", "copies").join(counts, "node", "left").join(names, "node", "left")
    known = known.select(*key, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    met = rows.where("usable").select("vec_id", *key).join(known, key).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long"), F.col("vec_id"))
    out = met.union(alone)
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
