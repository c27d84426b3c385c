"""Generations of a vector index: each space's vectors under one contract, replaced as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.ids import joined, sha256, uuid3
from quarry.operators.state import repeated_keys
from quarry.operators.vectors import Contract
from quarry.sources.snapshot import SnapshotStore, TableSpec, Transaction

TABLES = {
    "generations": TableSpec("tenant_id string, space_id string, generation_id string, contract_hash string, status string, created_at timestamp", ("tenant_id", "space_id", "generation_id")),
    "vectors": TableSpec("tenant_id string, space_id string, generation_id string, chunk_id string, vec_id long, embedding array<double>"),
}
SPACE = ["tenant_id", "space_id"]


def fingerprint(contract: Contract) -> Column:
    """What the vectors of a space's index have in common, as one key."""
    return joined(F.lit(contract.provider), F.lit(contract.model), F.lit(str(contract.dims)), F.lit(contract.metric), *[F.col(c) for c in SPACE])


def resolve(txn: Transaction, spaces: DataFrame, contract: Contract, now: str) -> DataFrame:
    """The generation of each space under a contract: one that is there, or a new one, which is ACTIVE if it
    is the space's first and else BUILDING, until activate()."""
    key = fingerprint(contract)
    wanted = spaces.select(*SPACE, uuid3(key).alias("generation_id"), sha256(key).alias("contract_hash"))
    known = txn.read("generations")
    any_ = known.select(*SPACE).distinct().withColumn("has", F.lit(True))
    fresh = wanted.join(known, [*SPACE, "generation_id"], "left_anti").join(any_, SPACE, "left")
    status = F.when(F.col("has"), "BUILDING").otherwise("ACTIVE")
    made = txn.write("generations", fresh.withColumn("status", status).withColumn("created_at", F.lit(now)))
    return known.join(wanted.select(*SPACE, "generation_id"), [*SPACE, "generation_id"], "left_semi").unionByName(made)


def add_vectors(txn: Transaction, generations: DataFrame, rows: DataFrame, contract: Contract) -> DataFrame:
    """Vectors (tenant_id, space_id, chunk_id, vec_id, embedding) of a contract's generation. A vector of
    another width fails the whole batch."""
    wrong = rows.where(F.size("embedding") != contract.dims).select(F.size("embedding").alias("width")).limit(1).collect()
    if wrong:
        contract.check(wrong[0]["width"])
    return txn.write("vectors", rows.join(generations.select(*SPACE, "generation_id"), SPACE))


def activate(txn: Transaction, generations: DataFrame) -> DataFrame:
    """These generations become the ACTIVE ones of their spaces; those that were are RETIRED. The
    commit shows both changes at once."""
    now = generations.select(*SPACE, F.col("generation_id").alias("chosen"))
    rows = txn.read("generations").join(now, SPACE)
    status = F.when(F.col("generation_id") == F.col("chosen"), "ACTIVE").when(F.col("status") == "ACTIVE", "RETIRED").otherwise(F.col("status"))
    return txn.write("generations", rows.withColumn("status", status))


def active_vectors(store: SnapshotStore, version: int | None = None) -> DataFrame:
    """The vectors of each space's ACTIVE generation, of which there may be one only."""
    live = store.read("generations", version).where("status = 'ACTIVE'")
    if repeated_keys(live, SPACE).limit(1).count():
        raise ValueError("a space has two active generations")
    return store.read("vectors", version).join(live.select(*SPACE, "generation_id"), [*SPACE, "generation_id"], "left_semi")
