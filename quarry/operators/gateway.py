"""A retrieval from requests to evidence bundles: channels that may fail on their own, guards, fusion, traces."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.ids import sha256
from quarry.operators import access, fusion, retrieval
from quarry.sources.shared import staged

CANDIDATE = ["query_id", "chunk_id", "tenant_id", "space_id", "document_id", "revision_id", "rank", "score"]
CHANNELS = ("KEYWORD", "VECTOR", "GRAPH")


@dataclass
class Tables:
    """What a retrieval reads. live holds the chunks of active heads with title, authority and source_uri."""

    spaces: DataFrame
    grants: DataFrame
    heads: DataFrame
    live: DataFrame

    @cached_property
    def stage(self) -> DataFrame:
        """The live chunks, written once for all channels and the evidence."""
        return staged(self.live, "live")


@dataclass(frozen=True)
class Channel:
    """retrieve(asked, tables) gives candidates (see CANDIDATE) of asked(query_id, tenant_id, space_id,
    normalised, candidate_limit, filters). A channel that knows no filters fails requests that have some."""

    retrieve: Callable[[DataFrame, Tables], DataFrame]
    knows_filters: bool = True


def keyword_channel(asked: DataFrame, tables: Tables) -> DataFrame:
    return retrieval.keyword_substring(tables.stage, asked)


def vector_channel(asked: DataFrame, tables: Tables) -> DataFrame:
    index = staged(retrieval.text_index(tables.stage), "vectors")
    found = retrieval.text_channel(asked, index)
    return found.join(tables.stage.select("chunk_id", "tenant_id", "space_id", "document_id", "revision_id"), "chunk_id")


@dataclass
class Retrieval:
    """bundles: a row per request. statuses: a row per request that was carried out and channel. steps: what
    each step gave and took. traces: a row per request, with its request_id (drawn once where it brings none) and
    the hash of its text."""

    bundles: DataFrame
    statuses: DataFrame
    steps: DataFrame
    traces: DataFrame


@dataclass
class Gateway:
    """Channels by name, each once. Of CHANNELS those without an entry are NOT_CONFIGURED."""

    channels: dict[str, Channel] = field(default_factory=dict)
    clock: Callable[[], float] = time.monotonic

    def register(self, name: str, channel: Channel) -> Gateway:
        if name in self.channels:
            raise ValueError(f"channel {name} is registered")
        self.channels[name] = channel
        return self

    def retrieve(self, requests: DataFrame, principals: DataFrame, requested: DataFrame, tables: Tables) -> Retrieval:
        """Carry out a batch of requests (query_id, tenant_id, principal_id, text, top_k, perhaps filters).

        The outcome is INVALID for a request with input errors, DENY_ALL where no space is in reach, FAILED
        where a candidate of any channel leaves the request's scope or a chunk has two identities; else OK.
        Only OK requests have evidence. requested(query_id, space_id) narrows the scope of the queries it names. A
        channel that raises is FAILED for all requests, one that knows no filters for those that have
        some: its warning is RETRIEVER_<channel>_UNAVAILABLE, and the other channels answer. Each step is written, so that
        nothing runs twice.
        """
        began, took = self.clock(), []

        def step(name: str, make: Callable[[], DataFrame]) -> DataFrame:
            start = self.clock()
            out = staged(make(), name.lower())
            took.append((name, max(0, round((self.clock() - start) * 1000)), out))
            return out

        if "filters" not in requests.columns:
            requests = requests.withColumn("filters", F.create_map().cast("map<string,string>"))
        scope = step("ACCESS", lambda: access.restrict(access.resolve_scope(principals, tables.spaces, tables.grants), requested))
        plans = step("PLAN", lambda: retrieval.plan_queries(requests))
        asked = retrieval.asked_in_scope(plans.where(F.size("errors") == 0), scope)
        has_filters = F.coalesce(F.size("filters") > 0, F.lit(False))

        candidates, status = [], []
        for name in (*CHANNELS, *[c for c in self.channels if c not in CHANNELS]):
            channel = self.channels.get(name)
            if channel is None:
                status.append((name, F.lit("NOT_CONFIGURED")))
                continue
            mine = asked if channel.knows_filters else asked.where(~has_filters)
            try:
                found = step(name, lambda c=channel, mine=mine, name=name: c.retrieve(mine, tables).select(*CANDIDATE, F.lit(name).alias("channel")))
            except Exception:  # whatever a channel's code or store raises is its own failure
                status.append((name, F.lit("FAILED")))
                took.append((name, 0, None))
                continue
            candidates.append(found)
            status.append((name, F.lit("OK") if channel.knows_filters else F.when(has_filters, "FAILED").otherwise("OK")))

        found = candidates[0] if candidates else asked.limit(0).select(*[F.lit(None).alias(c) for c in (*CANDIDATE, "channel")])
        for more in candidates[1:]:
            found = found.unionByName(more)
        broken = staged(access.violations(found, scope).select("query_id").unionByName(fusion.identity_conflicts(found).select("query_id")).distinct(), "broken")
        kept = step("GUARD", lambda: retrieval.retain_active(found, tables.heads).join(broken, "query_id", "left_anti"))
        fused = step("FUSE", lambda: fusion.fuse(kept))
        evidence = step("EVIDENCE", lambda: fusion.evidence(fused, tables.stage))

        reach = scope.select("query_id").distinct().withColumn("reach", F.lit(True))
        rows = plans.join(reach, "query_id", "left").join(broken.withColumn("broken", F.lit(True)), "query_id", "left")
        outcome = F.when(F.size("errors") > 0, "INVALID").when(F.col("reach").isNull(), "DENY_ALL").when(F.col("broken"), "FAILED").otherwise("OK")
        rows = staged(rows.withColumn("outcome", outcome), "outcomes")
        count = F.when(F.col("evidences").isNull(), 0).otherwise(F.size("evidences"))
        bundles = rows.select("query_id", "outcome").join(fusion.bundles(evidence), "query_id", "left")
        bundles = bundles.select("query_id", "outcome", count.alias("n_evidence"), "evidences", F.coalesce("sufficient", F.lit(False)).alias("sufficient"))
        total = max(0, round((self.clock() - began) * 1000))
        return Retrieval(bundles, self._statuses(rows, status), fusion.trace_steps(took, plans), self._traces(rows, evidence, total))

    @staticmethod
    def _statuses(rows: DataFrame, status: list[tuple[str, Column]]) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("channel"), s.alias("status")) for n, s in status])).alias("s")
        out = rows.where("outcome in ('OK', 'FAILED')").select("query_id", each).select("query_id", "s.*")
        return out.withColumn("warning", F.when(F.col("status") != "OK", F.concat(F.lit("RETRIEVER_"), "channel", F.lit("_UNAVAILABLE"))))

    @staticmethod
    def _traces(rows: DataFrame, evidence: DataFrame, total_ms: int) -> DataFrame:
        n = evidence.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
        out = rows.join(n, "query_id", "left").select(
            (F.coalesce("request_id", F.uuid()) if "request_id" in rows.columns else F.uuid()).alias("request_id"),
            *["query_id", "tenant_id", "principal_id", "outcome"],
            sha256(F.col("normalised")).alias("query_hash"),
            F.lit(total_ms).cast("long").alias("total_duration_ms"),
            F.coalesce("n", F.lit(0)).cast("long").alias("result_count"),
        )
        return staged(out, "traces")


def default_gateway() -> Gateway:
    return Gateway().register("KEYWORD", Channel(keyword_channel)).register("VECTOR", Channel(vector_channel, knows_filters=False))
