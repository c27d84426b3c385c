"""MinHash near-dedup by a signature-coordinate inverted join."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from quarry.llm.bloom import build_filter, held
from quarry.llm.common import drop_stage, give_back, mix64, packed, shingles, small_batches, tidy, write_stage
from quarry.llm.components import block_turns, connected_components, local_roots, named_by_smallest

#: Signature length, and the chance at which a pair of exactly the asked similarity may be lost.
COORDINATES, LOST = 64, 5e-5
#: Cells of the frequency sketch by which coordinate values are ordered, rare ones first.
SKETCH_CELLS = 1 << 16
#: Documents of one posting list are compared in blocks of about this many.
BLOCK = 512
#: The same where whole shingle sets are compared.
SET_BLOCK = 256

_A = np.array([mix64(np.array([k], np.uint64), 101)[0] | np.uint64(1) for k in range(COORDINATES)], np.uint64)
_B = np.array([mix64(np.array([k], np.uint64), 202)[0] for k in range(COORDINATES)], np.uint64)


def lost(percent: int, matches: int) -> float:
    """The chance that a pair of this similarity has fewer than `matches` equal coordinates."""
    p = percent / 100
    return sum(comb(COORDINATES, k) * p**k * (1 - p) ** (COORDINATES - k) for k in range(matches))


def matches_for(percent: int) -> int:
    """The matching coordinates that a pair must show before its sets are compared: the most that lose
    a pair with a chance of LOST or less. 42 for 85 percent, 38 for 80."""
    return max((m for m in range(1, COORDINATES + 1) if lost(percent, m) <= LOST), default=1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """COORDINATES minima (32 bits each) of seeded hashes over a non-empty set."""
    low = np.full(COORDINATES, 2**32 - 1, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), 1024):
            values = (hashes[i : i + 1024, None] * _A + _B) >> np.uint64(32)
            low = np.minimum(low, values.min(axis=0).astype(np.uint32))
    return low


def _print(hashes: np.ndarray, salt: int) -> int:
    return int(mix64(hashes, salt).sum(dtype=np.uint64).astype(np.int64))


def _describe(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                h = shingles(text, size)
                rows.append((len(h), _print(h, 7), _print(h, 8), signature(h).tobytes() if len(h) else b""))
            out = pd.DataFrame(rows, columns=["n_shingles", "print_a", "print_b", "sig"])
            yield out.assign(doc_id=pdf["doc_id"].astype("Int64"), row_key=pdf["row_key"])

    return run


def describe(docs: DataFrame, size: int = 5, row_key: Column | None = None) -> DataFrame:
    """doc_id, row_key (0 unless given), n_shingles, a 128-bit fingerprint of the shingle set, and its
    MinHash signature, of each row."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.lit(0).cast("long") if row_key is None else row_key).alias("row_key"), "text")
    return read.mapInPandas(tidy(_describe(size)), "doc_id long, row_key long, n_shingles long, print_a long, print_b long, sig binary")


def _keys(sigs: pd.Series) -> np.ndarray:
    """A 64-bit key for each coordinate-value pair: rows by documents."""
    values = np.frombuffer(b"".join(sigs), np.uint32).reshape(len(sigs), COORDINATES).astype(np.uint64)
    return mix64(values | (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)), 3)


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(SKETCH_CELLS, np.int64)
    for pdf in batches:
        if len(pdf):
            total += np.bincount((_keys(pdf["sig"]) >> np.uint64(48)).ravel().astype(np.int64), minlength=SKETCH_CELLS)
    cells = np.nonzero(total)[0]
    yield pd.DataFrame({"cell": cells, "n": total[cells]})


def _post(counts: np.ndarray, length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            keys = _keys(pdf["sig"])
            often = np.minimum(counts[(keys >> np.uint64(48)).astype(np.int64)], 2**31).astype(np.uint64)
            order = np.argpartition((often << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF)), length - 1, axis=1)[:, :length]
            yield pd.DataFrame({"key": np.take_along_axis(keys, order, axis=1).ravel().astype(np.int64), "node": np.repeat(pdf["node"].to_numpy(), length)})

    return run


def _forest(rows: list, same: bool, linked_of) -> list[tuple[int, int]]:
    """(node, root) of the members of a block pair that linked_of(left, right) links to others."""
    left = [m for m in rows if m["side"] == 0]
    right = left if same else [m for m in rows if m["side"] == 1]
    if not left or not right:
        return []
    ids = [np.array([m["node"] for m in side], np.int64) for side in (left, right)]
    linked = linked_of(left, right) & (ids[0][:, None] != ids[1][None, :])
    if not linked.any():
        return []
    out = []
    for side, roots in zip(ids, local_roots(linked, *ids), strict=True):
        out += [(int(x), int(r)) for x, r in zip(side, roots, strict=True) if x != r]
    return out


def _colliding(matches: int):
    """Pairs with so many equal coordinates at least."""

    def run(left: list, right: list) -> np.ndarray:
        x, y = (np.frombuffer(b"".join(m["sig"] for m in side), np.uint32).reshape(len(side), COORDINATES) for side in (left, right))
        total = np.zeros((len(x), len(y)), np.uint8)
        for k in range(COORDINATES):
            total += x[:, k][:, None] == y[:, k][None, :]
        return total >= matches

    return run


def _alike(percent: int):
    """Pairs whose whole shingle sets reach the percentage, by products of their incidence matrices."""

    def run(left: list, right: list) -> np.ndarray:
        sets = [[np.frombuffer(m["members"], np.uint64) for m in side] for side in (left, right)]
        sizes = [np.array([len(x) for x in side]) for side in sets]
        flat = [np.concatenate(side) for side in sets]
        owner = [np.repeat(np.arange(len(s)), s) for s in sizes]
        common = np.intersect1d(*flat)
        both = np.zeros((len(left), len(right)), np.int64)
        places = [np.searchsorted(common, f) for f in flat]
        held = [np.isin(f, common) for f in flat]
        for start in range(0, len(common), 4096):
            marks = []
            for side in (0, 1):
                here = held[side] & (places[side] >= start) & (places[side] < start + 4096)
                m = np.zeros((len(sets[side]), min(4096, len(common) - start)), np.float32)
                m[owner[side][here], places[side][here] - start] = 1
                marks.append(m)
            both += (marks[0] @ marks[1].T).astype(np.int64)
        return (both > 0) & (100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both))

    return run


def _linked_blocks(members: DataFrame, group: str, linked_of, block_rows: int) -> DataFrame:
    """Edges (node, root) that span the links within each group of members(group, n, node, ...). Groups
    of more than block_rows are compared block by block; a block gives a forest, never its pairs."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block_rows)).cast("int")
    payload = [c for c in members.columns if c not in (group, "n", "node")]
    block = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = members.withColumn("t", F.explode(block_turns(block, blocks)))
    dealt = dealt.groupBy(group, "t.i", "t.j").agg(F.collect_list(F.struct("node", *payload, F.col("t.side").alias("side"))).alias("rows"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = {e for rows, same in zip(pdf["rows"], pdf["same"], strict=True) for e in _forest(rows, same, linked_of)}
            yield pd.DataFrame(sorted(found), columns=["node", "root"], dtype="int64")

    return dealt.select("rows", (F.col("i") == F.col("j")).alias("same")).mapInPandas(tidy(run), "node long, root long")


def _clustered_texts(docs: DataFrame, clustered: DataFrame, bloom: np.ndarray) -> DataFrame:
    """clustered(id, ...) with texts. The join is by shuffle, also where clustered is small: were it broadcast, one
    task would keep a Python worker for the filter and another for the sets, and both stay for later stages."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null")
    return texts.where(held(bloom, docs.sparkSession, F.xxhash64("id"))).join(clustered.hint("merge"), "id")


def _classes(docs: DataFrame, described: DataFrame, size: int, percent: int) -> DataFrame:
    """Rows (print_a, print_b, n_shingles, group, component_id), one for each shingle set of described:
    a number for its component, and the smallest doc_id of that."""
    matches = matches_for(percent)
    usable = described.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("print_a", "print_b", "n_shingles").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"))
    # a class has a number of its own: several classes may hold one doc_id, if ids repeat
    classes = write_stage(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    reps = classes.select("node", "sig")

    counts = np.zeros(SKETCH_CELLS, np.int64)
    for row in reps.select("sig").mapInPandas(tidy(_sketch), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # SKETCH_CELLS rows at most
        counts[row["cell"]] = row["n"]
    posts = write_stage(reps.mapInPandas(tidy(_post(counts, COORDINATES - matches + 1)), "key long, node long"), "posts")
    lists = posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = posts.join(lists, "key").join(reps, "node")
    collisions = write_stage(_linked_blocks(members, "key", _colliding(matches), BLOCK).distinct(), "collisions")
    clusters = connected_components(collisions, "node", "root")
    drop_stage(posts)

    clusters = clusters.union(clusters.select("component", "component").distinct())
    clusters = write_stage(clusters.join(classes.select("node", "id", "print_a"), "node"), "clusters")
    drop_stage(collisions)
    sizes = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    clustered = clusters.join(sizes, "component")
    # texts of documents in no cluster stay where they are: a small filter holds them back
    bloom = build_filter(clusters.select(F.xxhash64("id").alias("key_hash")), clusters.count())
    texts = _clustered_texts(docs, clustered, bloom)

    @F.pandas_udf("print long, members binary")
    def sets(text: pd.Series) -> pd.DataFrame:
        found = [shingles(t, size) for t in text]
        out = pd.DataFrame({"print": [_print(h, 7) for h in found], "members": [h.tobytes() for h in found]})
        give_back()
        return out

    sets = sets.asNondeterministic()  # evaluated once, after the join
    whole = texts.select("component", "n", "node", "print_a", sets("text").alias("s")).where("s.print = print_a")
    whole = whole.select("component", "n", "node", "s.members").dropDuplicates(["node"])
    links = write_stage(_linked_blocks(whole, "component", _alike(percent), SET_BLOCK).distinct(), "links")
    drop_stage(clusters)
    labels = connected_components(links, "node", "root")
    keyed = classes.join(named_by_smallest(labels, classes), "node", "left")
    keyed = keyed.select("print_a", "print_b", "n_shingles", F.coalesce("component", "node").alias("grp"), F.coalesce("component_id", "id").alias("component_id"))
    keyed = write_stage(keyed, "groups")
    for stage in (classes, links, labels):
        drop_stage(stage)
    return keyed


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Rows doc_id, n_shingles, component_id, kept, one per row of docs.

    Two documents are linked when 100 * shared shingles >= percent * shingles of either; components
    are the transitive closure, named by their smallest doc_id, and kept marks that document.
    Documents without words, with null text or with null doc_id link with nothing; a null doc_id has
    a null component and is kept. Repeated rows of a doc_id get one row each, from their own text.
    Columns beside doc_id and text are ignored.

    Documents with one shingle set form a class, and only one of it goes on. Each class posts itself
    under the rarest of its coordinate-value pairs, all but matches_for(percent) - 1 of them: any two
    with as many collisions share one of those, in whatever fixed order, and frequent values, such as a
    common passage brings, come last in the order and are skipped. Within a list, collisions are
    counted over whole signatures, block by block; a block hands on a spanning forest of the pairs
    that have enough. In the clusters these form, all whole shingle sets are compared, again by
    blocks, so every link is confirmed on the sets (64-bit hashes of the shingles) and no pairs are
    written out. A pair with too few collisions is lost: at exactly the asked similarity with a
    chance of LOST at most, and above it soon less.
    """
    small_batches(docs.sparkSession)
    described = write_stage(describe(docs, size), "signatures")
    keyed = _classes(docs, described, size, percent)
    rows = described.select("doc_id", "n_shingles", "print_a", "print_b")
    joined = rows.where("n_shingles > 0 and doc_id is not null").join(keyed, ["print_a", "print_b", "n_shingles"]).select("doc_id", "n_shingles", "component_id")
    alone = rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.union(alone).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but one row of each group of near_duplicates(), in whatever order.

    The row of smallest doc_id stays; of several rows with that doc_id the one of lowest hash over
    all columns, and of rows that repeat in every column one. So the decision is on rows: a row goes
    only if another of its own group stays. Rows without words, with null text or with null doc_id
    link with nothing and all stay. Columns pass through; maps among them do not count for the hash.
    """
    small_batches(docs.sparkSession)
    row_key = F.xxhash64(*[F.col("`" + f.name.replace("`", "``") + "`") for f in docs.schema.fields if not isinstance(f.dataType, MapType)])
    described = write_stage(describe(docs, size, row_key), "signatures")
    keyed = _classes(docs, described, size, percent).select("print_a", "print_b", "n_shingles", "grp")
    rows = described.where("n_shingles > 0 and doc_id is not null").join(keyed, ["print_a", "print_b", "n_shingles"])
    rows = write_stage(rows.groupBy("grp", F.struct("doc_id", "row_key").alias("at")).agg(F.count(F.lit(1)).alias("n")), "rows")
    first = rows.groupBy("grp").agg(F.min("at").alias("first"), F.sum("n").alias("whole")).where("whole > 1")
    decided = rows.join(first.select("grp", "first"), "grp").where("at <> first or n > 1")
    decided = write_stage(decided.select("at.*", (F.col("at") == F.col("first")).alias("stays")), "decisions")
    drop_stage(described)
    whole, unpacked = packed(docs, F.col("doc_id").cast("long").alias("own_id"), row_key.alias("own_key"))
    same = (F.col("own_id") == F.col("doc_id")) & (F.col("own_key") == F.col("row_key"))
    others = whole.join(decided, same, "left_anti")
    # of repeated rows that stay, one: few, as a rule none
    once = whole.join(decided.where("stays"), same, "left_semi").dropDuplicates(["own_id", "own_key"])
    return others.unionByName(once).select(*unpacked)
