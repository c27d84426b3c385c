"""Source divergence audit: how far the term shares of the sources of a language lie apart."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import drop_stage, small_batches, write_stage

#: Separators become spaces and A-Z lower case, so that the terms of a text are its split bytes.
_BYTES = bytes(32 if b < 65 or 91 <= b < 97 or 123 <= b < 128 else b + 32 if b < 91 else b for b in range(256))
#: Entries that a task counts before it hands them on.
HELD = 400_000
#: One row per (lang, source) goes to every task; the result has a row for each pair of them.
MAX_GROUPS = 100_000
SCALE = 1_000_000_000
_SHARE = f"1 + ({SCALE}::HUGEINT * (%s + 5)) // (%s + 5 * %s)"


def _database() -> duckdb.DuckDBPyConnection:
    """One shard's tables: in memory, one thread, within a bound."""
    return duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "preserve_insertion_order": False})


def _fill(con: duckdb.DuckDBPyConnection, name: str, rows: pa.Table | pa.RecordBatchReader, sql: str) -> None:
    con.register(name, rows)
    con.execute(sql)
    con.unregister(name)


def _answer(con: duckdb.DuckDBPyConnection, sql: str) -> Iterator[pa.RecordBatch]:
    yield from con.sql(sql).to_arrow_table().combine_chunks().to_batches(max_chunksize=20_000)


def _counted(ids: dict[tuple[str, str], tuple[int, int]]):
    """ids: (number of the language, number of the group) of each (lang, source)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Occurrences and documents of each term by group, in parts of bounded size."""
        seen: dict[tuple[int, int], tuple[Counter, Counter]] = {}

        def parts() -> Iterator[pa.RecordBatch]:
            for (lang, group), (n, docs) in seen.items():
                if n:
                    terms = pa.array(list(n), pa.binary()).cast(pa.string())
                    same = lambda v, size=len(n): pa.array([v], pa.int32()).take(pa.nulls(size, pa.int32()).fill_null(0))
                    yield pa.RecordBatch.from_arrays(
                        [same(lang), terms, same(group), pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())],
                        names=["lang", "term", "grp", "n", "docs"],
                    )
            seen.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                terms = text.encode("utf-8", "surrogatepass").translate(_BYTES).split()
                n, docs = seen.setdefault(ids[lang, source], (Counter(), Counter()))
                n.update(terms)
                docs.update(set(terms))
            if sum(len(n) for n, _ in seen.values()) > HELD:
                yield from parts()
        yield from parts()

    return task


def _kept_terms(least_docs: int):
    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One shard of (lang, term): the terms in enough documents, each with its counts by group. The
        rows stream through the first sum, which holds one row for each term and group."""
        first = next(batches, None)
        if first is None:
            return
        con = _database()
        rows = pa.RecordBatchReader.from_batches(first.schema, chain([first], batches))
        _fill(con, "rows_in", rows, "CREATE TABLE part AS SELECT lang, term, grp, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM rows_in GROUP BY lang, term, grp")
        con.execute(f"CREATE TABLE kept AS SELECT lang, term FROM part GROUP BY lang, term HAVING sum(docs) >= {least_docs}")
        yield from _answer(con, "SELECT lang, term, list(grp) AS groups, list(n) AS counts FROM part JOIN kept USING (lang, term) GROUP BY lang, term")
        con.close()

    return shard


def _divergences(groups: pa.Table, keep: int):
    """groups: grp, lang, n, n_lang, v, absent of every (lang, source) whose language keeps terms."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a shard's whole terms: partial sums by pair of groups (beyond what the shares of absent
        terms give), and the best terms of each group.

        A pair meets at the terms that either group has: each of its terms is joined to the other groups
        of the language, so that terms with few sources cost few rows."""
        con = _database()
        _fill(con, "g", groups, "CREATE TABLE groups AS SELECT * FROM g")
        con.execute("CREATE TABLE pairs (a INTEGER, b INTEGER, value HUGEINT)")
        con.execute("CREATE TABLE best (grp INTEGER, term VARCHAR, value BIGINT)")
        for batch in batches:
            _fill(con, "batch", pa.Table.from_batches([batch]), "CREATE OR REPLACE TABLE terms AS SELECT row_number() OVER () AS t, term, list_sum(counts) AS total, unnest(groups) AS grp, unnest(counts) AS n FROM batch")
            con.execute(f"""CREATE OR REPLACE TABLE shares AS SELECT t, term, total, g.*, {_SHARE % ('terms.n', 'g.n', 'v')} AS p FROM terms JOIN groups g ON g.grp = terms.grp""")
            con.execute("""INSERT INTO pairs SELECT least(x.grp, g.grp), greatest(x.grp, g.grp), sum(abs(x.p - coalesce(y.p, g.absent)) - abs(x.absent - g.absent))
                FROM shares x JOIN groups g ON g.lang = x.lang AND g.grp <> x.grp LEFT JOIN shares y ON y.t = x.t AND y.grp = g.grp
                WHERE y.grp IS NULL OR x.grp < y.grp GROUP BY ALL""")
            con.execute(f"""CREATE OR REPLACE TABLE best AS SELECT grp, term, value FROM (SELECT * FROM best UNION ALL
                SELECT grp, term, (p - q)::BIGINT AS value FROM (SELECT grp, term, p, {_SHARE % ('total', 'n_lang', 'v')} AS q FROM shares) WHERE p > q)
                QUALIFY row_number() OVER (PARTITION BY grp ORDER BY value DESC, term) <= {keep}""")
        yield from _answer(con, "SELECT a, b, NULL::VARCHAR AS term, sum(value)::BIGINT AS value FROM pairs GROUP BY a, b UNION ALL SELECT grp, NULL, term, value FROM best")
        con.close()

    return shard


def audit(docs: DataFrame, least_docs: int = 30, keep: int = 50) -> DataFrame:
    """Of docs(lang, source, text): lang, source, part, item, value, rank.

    Terms are runs of letters (A-Z lower-cased) and of characters beyond ASCII; a language keeps those in
    at least least_docs of its documents. Each source of a language, and the language itself, gives each
    kept term the share 1 + floor(10^9 (count + 5) / (total + 5 kept terms)). Part `pair` is the
    sum of share differences to each other source, part `term` the kept terms whose share exceeds the
    language's, of which the first `keep` stay. Ranks go by value, largest first, then by item in UTF-8 order.

    Tasks count terms; shards by (lang, term) add counts in DuckDB, pick the kept terms and, once the totals of all
    sources are known, sum the differences of each pair over their terms; Spark merges sums and rankings. All
    numbers are whole and exact.

    Null text, lang and source count as ''. Repeated rows count each time. A source without terms has
    its pairs; a language without kept terms has pairs of value 0. An empty table gives an empty result. Other
    columns are ignored. More than MAX_GROUPS pairs of lang and source raise an error.
    """
    spark = docs.sparkSession
    small_batches(spark, 256)
    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    named = docs.select(*plain[:2]).distinct().limit(MAX_GROUPS + 1).collect()
    if len(named) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} pairs of lang and source")
    named = sorted((r["lang"], r["source"]) for r in named)
    langs = {lang: i for i, lang in enumerate(sorted({lang for lang, _ in named}))}
    ids = {(lang, source): (langs[lang], i) for i, (lang, source) in enumerate(named)}

    counted = docs.select(*plain).mapInArrow(_counted(ids), "lang int, term string, grp int, n long, docs long")
    kept = counted.repartition("lang", "term").mapInArrow(_kept_terms(least_docs), "lang int, term string, groups array<int>, counts array<long>")
    kept = write_stage(kept, "kept-terms")
    n, n_lang, v = Counter(), Counter(), Counter()
    for r in kept.select(F.explode(F.arrays_zip("groups", "counts")).alias("c")).groupBy(F.col("c.groups").alias("grp")).agg(F.sum("c.counts").alias("n")).collect():
        n[r["grp"]] = r["n"]
    for r in kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v")).collect():
        v[r["lang"]] = r["v"]
    for lang, group in ids.values():
        n_lang[lang] += n[group]
    known = [(group, lang, n[group], n_lang[lang], v[lang], 1 + SCALE * 5 // (n[group] + 5 * v[lang]) if v[lang] else 0) for lang, group in ids.values()]
    columns = list(zip(*known, strict=True)) or [[]] * 6
    whole = pa.table({"grp": pa.array(columns[0], pa.int32()), "lang": pa.array(columns[1], pa.int32()), **{c: pa.array(x, pa.int64()) for c, x in zip(("n", "n_lang", "v", "absent"), columns[2:], strict=True)}})

    shards = write_stage(kept.mapInArrow(_divergences(whole, keep), "a int, b int, term string, value long"), "divergences")
    drop_stage(kept)
    # from the shares of absent terms alone, what all kept terms would give; the shards have the rest
    rows = [(group, lang, source, v[langs[lang]], known[group][5]) for (lang, source), (_, group) in ids.items()]
    groups = spark.createDataFrame(rows, "a int, lang string, source string, v long, absent long")
    other = groups.select(F.col("a").alias("b"), "lang", F.col("source").alias("item"), F.col("absent").alias("other_absent"))
    sums = shards.where("b is not null").groupBy("a", "b").agg(F.sum("value").alias("more"))
    both = sums.unionByName(sums.select(F.col("b").alias("a"), F.col("a").alias("b"), "more"))
    pairs = groups.join(other, "lang").where("a <> b").join(both, ["a", "b"], "left")
    value = F.col("v") * F.abs(F.col("absent") - F.col("other_absent")) + F.coalesce("more", F.lit(0))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    best = shards.where("b is null").join(groups, "a").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    best = best.withColumn("rank", place).where(F.col("rank") <= keep)
    return pairs.withColumn("rank", place).unionByName(best)
