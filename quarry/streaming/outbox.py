"""The projection outbox as a stream: job outcomes advance a keyed state machine."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MAX_ATTEMPTS, FIRST_DELAY_MS, LONGEST_DELAY_MS = 5, 2_000, 300_000


def delay_ms(attempt: int) -> int:
    return min(LONGEST_DELAY_MS, FIRST_DELAY_MS * 2 ** min(max(attempt - 1, 0), 20))


def advance(status: str, attempts: int, outcome: str) -> tuple[str, int, int | None]:
    """One attempt's outcome: (status, attempts, delay until the next one). Ended jobs stay as they are."""
    if status in ("SUCCEEDED", "DEAD"):
        return status, attempts, None
    attempts += 1
    if outcome in ("ok", "superseded"):
        return "SUCCEEDED", attempts, None
    if attempts >= MAX_ATTEMPTS:
        return "DEAD", attempts, None
    return "RETRY", attempts, delay_ms(attempts)


def _run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, attempts = state.get if state.exists else ("PENDING", 0)
    wait = None
    # a job ends within MAX_ATTEMPTS outcomes, so later ones of this run change nothing and are not held
    events = None
    for batch in batches:
        events = pd.concat([events, batch]).sort_values(["at", "event_id"]).head(MAX_ATTEMPTS)
    for outcome in events["outcome"]:
        status, attempts, wait = advance(status, attempts, outcome)
    state.update((status, attempts))
    yield pd.DataFrame({"job_id": [key[0]], "status": [status], "attempts": [attempts], "delay_ms": pd.array([wait], "Int64")})


def job_states(outcomes: DataFrame) -> DataFrame:
    """outcomes(job_id, event_id, at, outcome), a stream, to the state of each job that changed."""
    return outcomes.groupBy("job_id").applyInPandasWithState(
        _run,
        "job_id long, status string, attempts int, delay_ms long",
        "status string, attempts int",
        "update",
        GroupStateTimeout.NoTimeout,
    )


def superseded(outcomes: DataFrame, heads: DataFrame) -> DataFrame:
    """Outcomes of jobs whose revision is no longer active become `superseded`: they end the job
    without publishing. A stream-static join."""
    live = heads.select("revision_id", F.lit(True).alias("live"))
    joined = outcomes.join(live, "revision_id", "left")
    return joined.withColumn("outcome", F.when(F.col("live"), F.col("outcome")).otherwise("superseded")).drop("live")


def run_once(states: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> None:
    """Process what is there and stop. Delivery is at least once: apply must be idempotent by batch."""
    states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start().awaitTermination()
