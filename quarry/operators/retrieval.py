"""Retrieval channels over a batch of queries: every request is a row, every channel one plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import analysed, mentions_relation, normalised_query, search_parts, tokens
from quarry.operators.vectors import DIMS, HASHING, Contract, hashed, token_codes, top_k, weighed_queries
from quarry.sources.shared import tidy

BEST_BELOW_ONE = 0.999999


def plan_queries(queries: DataFrame, multiplier: int = 5) -> DataFrame:
    """Normalised text, channel hint and candidate limit of each query, and its input errors: TOP_K beyond 1 to
    100, TEXT beyond 1 to 16000 characters, FILTER_KEY for filters that nobody knows, FILTER_VALUE for values
    beyond 1 to 128 characters."""
    if not 1 <= multiplier <= 20:
        raise ValueError("multiplier from 1 to 20")
    filters = F.coalesce(F.col("filters") if "filters" in queries.columns else F.lit(None).cast("map<string,string>"), F.create_map().cast("map<string,string>"))
    unfit = F.exists(F.map_values(filters), lambda v: ~F.coalesce((F.trim(v) != "") & (F.length(v) <= 128), F.lit(False)))
    errors = F.array_compact(
        F.array(
            F.when(F.size(unsupported_filters(filters)) > 0, "FILTER_KEY"),
            F.when(unfit, "FILTER_VALUE"),
            F.when(~F.coalesce(F.col("top_k").between(1, 100), F.lit(False)), "TOP_K"),
            F.when(~F.coalesce(F.length(F.trim("text")).between(1, 16_000), F.lit(False)), "TEXT"),
        )
    )
    return queries.select(
        "*",
        normalised_query(F.col("text")).alias("normalised"),
        mentions_relation(normalised_query(F.col("text"))).alias("relational"),
        F.least(F.lit(1000), F.col("top_k") * multiplier).alias("candidate_limit"),
        errors.alias("errors"),
    )


def top_candidates(scored: DataFrame, limit: Column | str = "candidate_limit") -> DataFrame:
    """The best rows of each query by raw_score, then chunk_id, with their rank from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc("raw_score"), "chunk_id")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= (F.col(limit) if isinstance(limit, str) else limit))


#: Requests whose texts are looked for in one pass over a chunk.
NEEDLES = 512


def asked_in_scope(plans: DataFrame, scope: DataFrame, *more: str) -> DataFrame:
    """(query, space) rows: what each query asks in each space that it may read."""
    names = ["normalised", "candidate_limit", *[c for c in ("filters",) if c in plans.columns], *more]
    return plans.join(scope, ["query_id", "tenant_id"]).select("query_id", "tenant_id", "space_id", *names)


#: Filters of a request, and the column of a chunk that each restricts.
FILTERS = {"language": "language", "sourceType": "source_type"}


def unsupported_filters(filters: Column) -> Column:
    """The keys that no channel knows."""
    return F.array_except(F.map_keys(filters), F.array(*[F.lit(k) for k in FILTERS]))


def literal_hits(chunks: DataFrame, asked: DataFrame, on: list[str]) -> DataFrame:
    """(query, chunk) rows of literal matches, whatever the case: raw_score is 0.75 for one in the
    content, 0.95 in the title. asked has query_id, normalised, candidate_limit and the columns of `on`; if it has
    `filters`, a chunk has to agree with those that it names.

    The requests of a key travel as lists of at most NEEDLES: a chunk meets a list, not each request, and only
    matches become rows."""
    place = F.floor((F.row_number().over(Window.partitionBy(*on).orderBy("query_id")) - 1) / NEEDLES)
    filters = F.col("filters") if "filters" in asked.columns else F.create_map().cast("map<string,string>")
    item = F.struct("query_id", "candidate_limit", F.lower("normalised").alias("needle"), *[F.try_element_at(filters, F.lit(k)).alias(k) for k in FILTERS])
    needles = asked.withColumn("part", place).groupBy(*on, "part").agg(F.collect_list(item).alias("needles")).drop("part")
    rows = chunks.withColumns({"content_l": F.lower("content"), "title_l": F.lower("title")}).join(needles, on)
    in_title, in_content = (lambda n, c=c: F.coalesce(F.contains(c, n["needle"]), F.lit(False)) for c in ("title_l", "content_l"))
    agrees = lambda n: _all(n[k].isNull() | F.coalesce(F.col(c) == n[k], F.lit(False)) for k, c in FILTERS.items() if c in chunks.columns)
    hits = rows.withColumn("n", F.explode(F.filter("needles", lambda n: (in_content(n) | in_title(n)) & agrees(n)))).drop("needles")
    score = F.when(in_title(F.col("n")), 0.95).otherwise(0.75)
    return hits.select(*chunks.columns, "n.query_id", "n.candidate_limit", score.alias("raw_score"))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def cover_density(hits: DataFrame) -> DataFrame:
    """(query_id, chunk_id, density) of hits(query_id, chunk_id, place, term, needed): the places in a
    chunk of the terms of a query, of which `needed` have to be there.

    A cover is a window of places that holds all needed terms and none shorter within it; it adds 0.1,
    less by the other words inside: 0.1 / (1 + words between the places). With one needed term each of
    its places is a cover. One fold over the places of a chunk keeps the last place of each term: they
    begin the window that ends here, and of windows with one begin the first counts.
    """
    place = F.struct(F.col("place").cast("int").alias("place"), "term")
    rows = hits.groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_list(place)).alias("places"), F.max("needed").alias("needed"))
    return rows.select("query_id", "chunk_id", F.expr(_covers("places", "needed")).alias("density"))


def _covers(places: str, needed: str) -> str:
    """The fold of cover_density() over an array of (place, term)."""
    last = "map_concat(map_filter(a.last, (k, v) -> k <> x.term), map(x.term, struct(x.place AS place, a.n + 1 AS n)))"
    return f"""aggregate({places}, struct(CAST(map() AS map<string, struct<place: int, n: int>>) AS last, 0 AS n, -1 AS begin, CAST(0 AS double) AS total),
        (a, x) -> struct({last} AS last, a.n + 1 AS n,
            IF(size({last}) = {needed}, array_min(map_values({last})).place, a.begin) AS begin,
            a.total + IF(size({last}) = {needed} AND array_min(map_values({last})).place <> a.begin,
                0.1D / (1 + greatest(0, (x.place - array_min(map_values({last})).place) - (a.n + 1 - array_min(map_values({last})).n))), 0D) AS total),
        a -> a.total)"""


def keyword_substring(chunks: DataFrame, asked: DataFrame, on: tuple[str, ...] = ("tenant_id", "space_id")) -> DataFrame:
    """Candidates by literal_hits()."""
    return top_candidates(literal_hits(chunks, asked, list(on))).withColumn("score", F.least("raw_score", F.lit(BEST_BELOW_ONE)))


def websearch(live: DataFrame, asked: DataFrame, scope: DataFrame) -> DataFrame:
    """Candidates of searches with phrases, alternatives and exclusions (see search_parts()): asked has
    query_id, tenant_id, normalised, candidate_limit; live has the chunks of active heads with their titles.

    A chunk is found by a group all of whose parts it has, and none of the excluded ones; a group of
    exclusions alone finds nothing. A phrase is found where each of its words stands at its place: the places of its words,
    moved back by their number in the phrase, meet. The score is the greatest of the cover density, summed over the
    groups (a phrase counts at its first word), and of a literal match of the whole search in the content (0.75) or title (0.95).

    As in literal_hits(), a chunk meets lists of requests: it knows the places of the words asked, so that all this is settled in
    its own row, and a task hands on the best of each request."""
    parts = _searched(asked)
    item = F.struct("item", "excluded", "words")
    groups = parts.groupBy("query_id", "grp").agg(F.count_if(~F.col("excluded")).alias("needed"), F.array_sort(F.collect_list(item)).alias("items"))
    groups = groups.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("grp", "needed", "items"))).alias("groups"))
    request = F.struct("query_id", "candidate_limit", F.lower("normalised").alias("needle"), "groups")
    place = F.floor((F.row_number().over(Window.partitionBy("tenant_id", "space_id").orderBy("query_id")) - 1) / NEEDLES)
    lists = asked.join(groups, "query_id", "left").join(scope, ["query_id", "tenant_id"]).withColumn("part", place)
    lists = lists.groupBy("tenant_id", "space_id", "part").agg(F.collect_list(request).alias("requests")).drop("part")
    reach = live.join(F.broadcast(scope.select("tenant_id", "space_id").distinct()), ["tenant_id", "space_id"], "left_semi")

    own = ["chunk_id", "tenant_id", "space_id"]
    rows = reach.select(*own, F.lower("content").alias("content_l"), F.lower("title").alias("title_l"), tokens(F.col("content")).alias("words"))
    rows = rows.crossJoin(asked_array(parts.select(F.explode("words").alias("term")))).withColumn("found", F.array_intersect("words", "asked_terms"))
    at = lambda t: F.filter(F.transform("words", lambda w, i: F.when(w == t, i)), lambda i: i.isNotNull())
    rows = rows.select(*own, "content_l", "title_l", F.map_from_arrays("found", F.transform("found", at)).alias("places"))

    there = lambda w: F.map_contains_key("places", w)
    has_all = lambda g: F.forall(g["items"], lambda x: x["excluded"] | F.forall(x["words"], there))
    in_title, in_content = (lambda n, c=c: F.coalesce(F.contains(c, n), F.lit(False)) for c in ("title_l", "content_l"))
    may = lambda q: in_content(q["needle"]) | in_title(q["needle"]) | F.coalesce(F.exists(q["groups"], has_all), F.lit(False))
    pairs = rows.join(F.broadcast(lists), own[1:]).withColumn("q", F.explode(F.filter("requests", may)))

    moved = lambda x: F.transform(x["words"], lambda w, i: F.transform(F.coalesce(F.try_element_at("places", w), F.array().cast("array<int>")), lambda p: p - i))
    met = lambda x: F.aggregate(F.slice(moved(x), 2, F.size(x["words"])), F.get(moved(x), F.lit(0)), F.array_intersect)
    started = lambda g: F.struct(g["needed"].alias("needed"), F.transform(g["items"], lambda x: F.struct(x["item"].cast("string").alias("term"), x["excluded"].alias("excluded"), met(x).alias("starts"))).alias("items"))
    pairs = pairs.withColumn("groups", F.transform("q.groups", started))
    fits = lambda g: F.forall(g["items"], lambda x: x["excluded"] == (F.size(x["starts"]) == 0))
    of = lambda x: F.transform(x["starts"], lambda p: F.struct(p.alias("place"), x["term"].alias("term")))
    covered = lambda g: F.struct(g["needed"].alias("needed"), F.array_sort(F.flatten(F.transform(F.filter(g["items"], lambda x: ~x["excluded"]), of))).alias("places"))
    pairs = pairs.withColumn("groups", F.transform(F.filter("groups", fits), covered))
    density = F.expr(f"coalesce(aggregate(groups, 0D, (total, g) -> total + {_covers('g.places', 'g.needed')}), 0D)")
    literal = F.when(in_title(F.col("q.needle")), 0.95).when(in_content(F.col("q.needle")), 0.75).otherwise(0.0)
    scored = pairs.select("q.query_id", "q.candidate_limit", "chunk_id", F.round(F.greatest(density, literal), 9).alias("raw_score"))
    best = best_of_tasks(scored, "candidate_limit").join(F.broadcast(asked.select("query_id", "candidate_limit")), "query_id")
    return top_candidates(best).withColumn("score", F.least("raw_score", F.lit(BEST_BELOW_ONE)))


def _searched(asked: DataFrame) -> DataFrame:
    """(query_id, tenant_id, grp, item, excluded, words) of the groups that can find something."""
    parts = asked.select("query_id", "tenant_id", F.explode(search_parts(F.col("normalised"))).alias("p")).select("query_id", "tenant_id", "p.*")
    able = parts.where("not excluded").select("query_id", "grp").distinct()
    return parts.join(able, ["query_id", "grp"], "left_semi")


def websearch_by_key(live: DataFrame, asked: DataFrame, scope: DataFrame) -> DataFrame:
    """websearch() by joins of words and places, for chunks whose rows meet by chunk_id, because it repeats."""
    parts = _searched(asked)
    words = parts.select("query_id", "tenant_id", "grp", "item", "excluded", F.size("words").alias("n_words"), F.posexplode("words").alias("offset", "term"))
    reach = live.join(scope.select("tenant_id", "space_id").distinct(), ["tenant_id", "space_id"], "left_semi")
    places = reach.select("chunk_id", "tenant_id", "space_id", F.posexplode(tokens(F.col("content"))).alias("place", "term"))
    places = places.join(words.select("tenant_id", "term").distinct(), ["tenant_id", "term"], "left_semi")
    hits = places.join(words, ["tenant_id", "term"]).join(scope, ["query_id", "tenant_id", "space_id"], "left_semi")
    met = hits.groupBy("query_id", "grp", "item", "excluded", "n_words", "chunk_id", (F.col("place") - F.col("offset")).alias("place")).agg(F.count(F.lit(1)).alias("n")).where("n = n_words")
    needed = parts.where("not excluded").groupBy("query_id", "grp").agg(F.count_distinct("item").alias("needed"))
    found = met.groupBy("query_id", "grp", "chunk_id").agg(F.count_distinct(F.when(~F.col("excluded"), F.col("item"))).alias("n"), F.bool_or("excluded").alias("barred"))
    matched = found.join(needed, ["query_id", "grp"]).where("n = needed and not barred").select("query_id", "grp", "chunk_id", "needed")
    own = met.where("not excluded").join(matched, ["query_id", "grp", "chunk_id"])
    # one group at a time: its key stands for the query, and alternatives add their covers
    keyed = own.select(F.struct("query_id", "grp").alias("query_id"), "chunk_id", "place", F.col("item").cast("string").alias("term"), "needed")
    density = cover_density(keyed).groupBy(F.col("query_id.query_id").alias("query_id"), "chunk_id").agg(F.sum("density").alias("density"))
    literal = literal_hits(live, asked_in_scope(asked, scope), ["tenant_id", "space_id"]).select("query_id", "chunk_id", F.col("raw_score").alias("literal"))
    both = literal.join(density, ["query_id", "chunk_id"], "full_outer").join(asked.select("query_id", "candidate_limit"), "query_id")
    scored = both.withColumn("raw_score", F.round(F.greatest(F.coalesce("density", F.lit(0.0)), F.coalesce("literal", F.lit(0.0))), 9))
    return top_candidates(scored).withColumn("score", F.least("raw_score", F.lit(BEST_BELOW_ONE)))


def with_terms(rows: DataFrame, *fields: str) -> DataFrame:
    """rows with the terms of text columns in their place, for postings() and index_stats() to find when written."""
    return rows.withColumns({f"{f}_terms": analysed(F.col(f)) for f in fields}).drop(*fields)


def _terms(rows: DataFrame, text: str) -> Column:
    return F.col(f"{text}_terms") if f"{text}_terms" in rows.columns else analysed(F.col(text))


def postings(chunks: DataFrame, text: str = "content", key: str = "chunk_id", asked: DataFrame | None = None) -> DataFrame:
    """(key, tenant_id, term, tf, length): the inverted index of a text column; with asked(term, ...), its
    postings of those terms alone, which are taken out before anything is grouped."""
    terms = chunks.select(key, "tenant_id", _terms(chunks, text).alias("terms"))
    rows = terms.select(key, "tenant_id", F.size("terms").alias("length"), F.explode("terms").alias("term"))
    if asked is not None:
        rows = rows.join(asked.select("term").distinct(), "term", "left_semi")
    return rows.groupBy(key, "tenant_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.max("length").alias("length"))


def bm25(index: DataFrame, asked: DataFrame, stats: DataFrame, key: str = "chunk_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, key, raw_score) of asked(query_id, term) against an index of postings; stats is one
    row with n and mean_length. Documents of a term are counted over the whole index, whatever the
    scope of a query; only postings of asked terms are joined. Where asked and index both have a
    column tenant_id, hits stay within the tenant."""
    asked = asked.distinct()
    index = index.join(asked.select("term").distinct(), "term", "left_semi")
    df = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    own = ["term", "tenant_id"] if "tenant_id" in index.columns and "tenant_id" in asked.columns else ["term"]
    hits = index.join(asked, own).join(df, "term").join(F.broadcast(stats))  # one row
    return hits.groupBy("query_id", key).agg(F.sum(idf * tf).alias("raw_score"))


def index_stats(chunks: DataFrame, text: str = "content") -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(_terms(chunks, text))).alias("mean_length"))


def asked_array(asked: DataFrame) -> DataFrame:
    """The distinct terms of requests as one row, for each task to have."""
    return F.broadcast(asked.agg(F.array_sort(F.collect_set("term")).alias("asked_terms")))


def found_terms(rows: DataFrame, asked: DataFrame, *fields: str, analyse: Callable[[Column], Column] = analysed) -> DataFrame:
    """rows with two columns for each text, in its place: f_length, its number of terms, and f_hits, the asked terms in it with
    their counts. Of rows without any only the lengths are kept, so that this, written, is much smaller than the
    texts and still tells all that bm25_best() needs. No row meets another."""
    kept = [c for c in rows.columns if c not in fields]
    rows = rows.select(*kept, *[analyse(F.col(f)).alias(f) for f in fields]).crossJoin(asked_array(asked))
    count = lambda f: lambda t: F.struct(t.alias("term"), F.size(F.filter(f, lambda x: x == t)).alias("tf"))
    rows = rows.select(*kept, *[F.size(f).alias(f"{f}_length") for f in fields], *[F.transform(F.array_intersect(f, "asked_terms"), count(f)).alias(f"{f}_hits") for f in fields])
    some = _any(F.size(f"{f}_hits") > 0 for f in fields)
    return rows.select(*[F.when(some, F.col(c)).alias(c) for c in kept], *[f"{f}_length" for f in fields], *[f"{f}_hits" for f in fields])


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def bm25_best(found: DataFrame, asked: DataFrame, reach: DataFrame, fields: dict[str, float], limit: int, on: Sequence[str], key: str = "chunk_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, raw_score, rank and the columns of found but its terms) of the `limit` best rows of each request: the greatest
    of its fields' BM25 scores, times their weights, to 9 digits. found is found_terms(), written; asked has (query_id,
    term), reach (query_id, *on) what rows a request may have. Documents of a term are counted over all rows, whatever
    the reach.

    As in literal_hits(), a row meets lists of requests and has all that its scores are made of; a task hands on `limit` rows a
    request. So neither postings nor the pairs of rows and requests are shuffled."""
    asked = asked.select("query_id", "term").distinct()
    sizes = found.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"{f}_length").alias(f"{f}_mean") for f in fields])
    named = lambda f: lambda h: F.struct(F.lit(f).alias("field"), h["term"].alias("term"))
    none = F.array().cast("array<struct<field:string,term:string>>")
    counted = found.select(F.explode(F.concat(*[F.coalesce(F.transform(f"{f}_hits", named(f)), none) for f in fields])).alias("h"))
    df = counted.groupBy("h.field", "h.term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = df.crossJoin(F.broadcast(sizes)).groupBy("term").pivot("field", list(fields)).agg(F.first(idf))
    terms = asked.join(known, "term").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", *[F.col(f) for f in fields]))).alias("terms"))
    place = F.floor((F.row_number().over(Window.partitionBy(*on).orderBy("query_id")) - 1) / NEEDLES)
    lists = reach.join(terms, "query_id").withColumn("part", place).groupBy(*on, "part").agg(F.collect_list(F.struct("query_id", "terms")).alias("requests")).drop("part")
    lists = lists.crossJoin(F.broadcast(sizes.drop("n")))

    rows = found.where(F.col(key).isNotNull()).join(F.broadcast(lists), list(on))
    part = lambda f: lambda h: F.struct(h["term"], h["tf"] * (k1 + 1) / (h["tf"] + k1 * (1 - b + b * F.col(f"{f}_length") / F.col(f"{f}_mean"))))
    rows = rows.withColumns({f"{f}_parts": F.map_from_entries(F.transform(f"{f}_hits", part(f))) for f in fields})
    of = lambda q, f: F.aggregate(q["terms"], F.lit(0.0), lambda a, t: a + F.coalesce(t[f] * F.try_element_at(f"{f}_parts", t["term"]), F.lit(0.0)))
    best = lambda q: F.greatest(*[of(q, f) * w for f, w in fields.items()]) if len(fields) > 1 else of(q, *fields) * next(iter(fields.values()))
    scored = rows.select(key, F.explode(F.transform("requests", lambda q: F.struct(q["query_id"].alias("query_id"), best(q).alias("raw_score")))).alias("s"))
    first = best_of_tasks(scored.select("s.query_id", key, F.round("s.raw_score", 9).alias("raw_score")), limit, key)
    ranked = top_candidates(first.withColumnRenamed(key, "chunk_id"), F.lit(limit)).withColumnRenamed("chunk_id", key)
    return found.select(*[c for c in found.columns if not c.endswith(("_hits", "_length"))]).join(F.broadcast(ranked), key)


#: Rows of a task beyond the best of its requests that are looked through together.
PENDING = 1 << 16


def best_of_tasks(scored: DataFrame, limit: int | str, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, raw_score) of the rows that are among the `limit` best of their request within their task, by score and
    then by key; limit may name a column, which is the same in all rows of a request. Scores of 0 are none. A task
    keeps these alone, so that nothing is sorted or shuffled before."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, edge, limits = [], {}, {}

        def best(parts: list) -> tuple:
            query, score, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((ids, -score, query))
            query, score, ids = query[order], score[order], ids[order]
            names, start, n = np.unique(query, return_index=True, return_counts=True)
            place, most = np.arange(len(query)) - np.repeat(start, n), np.repeat([limits[q] for q in names.tolist()], n)
            edge.update(zip(query[place == most - 1].tolist(), score[place == most - 1].tolist(), strict=True))
            return query[place < most], score[place < most], ids[place < most]

        for batch in batches:
            if not len(batch):
                continue
            query, score, most = (batch[c].to_numpy(zero_copy_only=False) for c in ("query_id", "raw_score", "most"))
            names, first, at = np.unique(query, return_index=True, return_inverse=True)
            limits.update(zip(names.tolist(), most[first].tolist(), strict=True))
            fit = np.nonzero((score > 0) & (score >= np.array([edge.get(q, 0.0) for q in names.tolist()])[at]))[0]
            if len(fit):
                held.append((query[fit], score[fit], np.array(batch[key].take(pa.array(fit)).to_pylist(), object)))
            if sum(len(h[0]) for h in held[1:]) > PENDING:
                held = [best(held)]
        if held:
            query, score, ids = best(held)
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(ids, pa.string()), pa.array(score, pa.float64())], names=["query_id", key, "raw_score"])

    most = F.col(limit) if isinstance(limit, str) else F.lit(limit)
    return scored.select(F.col("query_id").cast("long"), key, "raw_score", most.cast("int").alias("most")).mapInArrow(run, f"query_id long, {key} string, raw_score double")


def query_terms(plans: DataFrame) -> DataFrame:
    return plans.select("query_id", "tenant_id", F.explode(F.array_distinct(analysed(F.col("normalised")))).alias("term"))


def relative_to_best(scored: DataFrame) -> DataFrame:
    """Scores as a share of the best of their query, below one."""
    best = F.max("raw_score").over(Window.partitionBy("query_id"))
    return scored.withColumn("score", F.least(F.col("raw_score") / best, F.lit(BEST_BELOW_ONE)))


def vector_search(asked: DataFrame, vectors: DataFrame, limit: int) -> DataFrame:
    """Exact cosine top-k of asked(query_id, tenant_id, space_id, self_id, vector) within tenant and space:
    vectors(chunk_id, embedding, ...) with query_id, rank, raw_score and score."""
    index = vectors.select("tenant_id", "space_id", F.col("chunk_id").alias("id"), F.col("embedding").alias("vector"))
    best = top_k(asked.withColumn("limit", F.lit(limit)), index, ["tenant_id", "space_id"])
    found = best.withColumnRenamed("id", "chunk_id").join(vectors.drop("embedding"), "chunk_id")
    return found.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "raw_score")))


def text_index(live: DataFrame) -> DataFrame:
    """What the vector channel over text keeps of each chunk: its token codes, and its distinct tokens."""
    return live.select("tenant_id", "space_id", F.col("chunk_id").alias("id"), token_codes(F.col("content")).alias("vector"), F.array_distinct(tokens(F.col("content"))).alias("words"))


def text_channel(asked: DataFrame, index: DataFrame, contract: Contract = HASHING) -> DataFrame:
    """(query_id, chunk_id, raw_score, rank, score) of the vector channel over text: asked has query_id,
    normalised, candidate_limit and a row for each space; index is text_index(), of the embedder's contract.
    Texts without tokens are not found."""
    contract.check(DIMS)
    queries = weighed_queries(asked.select("query_id", "normalised").distinct(), "normalised", index).select("query_id", "vector")
    rows = asked.select("query_id", "tenant_id", "space_id", F.col("candidate_limit").alias("limit")).join(queries, "query_id")
    best = top_k(rows, index.where(F.size("vector") > 0), ["tenant_id", "space_id"], hashed, digits=9)
    return best.withColumnRenamed("id", "chunk_id").withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "raw_score")))


def route_vector_queries(plans: DataFrame) -> DataFrame:
    """The vector channel takes no metadata filters: such queries fail there and get a warning."""
    filtered = F.size("filters") > 0
    return plans.select("query_id", F.when(filtered, "FAILED").otherwise("OK").alias("status"), F.when(filtered, "RETRIEVER_VECTOR_UNAVAILABLE").alias("warning"))


def retain_active(candidates: DataFrame, heads: DataFrame) -> DataFrame:
    """Candidates whose revision is the active one of an active document; ranks keep their gaps."""
    live = heads.where("status = 'ACTIVE'").select("tenant_id", "document_id", "revision_id")
    return candidates.join(live, ["tenant_id", "document_id", "revision_id"], "left_semi")
