"""Publishing source records: documents, revisions, elements, chunks and jobs, in one commit for each batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.ids import sha256, uuid3
from quarry.functions.text import stripped
from quarry.operators.state import enqueue, latest, repeated_keys
from quarry.sources import markdown
from quarry.sources.snapshot import TableSpec, Transaction

PARSER_VERSION = "markdown-1"
RECORD = (
    "tenant_id string, space_id string, connector_id string, external_id string, source_type string, source_uri string, title string, "
    "authority int, metadata string, media_type string, language string, content string, modified_at timestamp, deleted boolean"
)
TABLES = {
    "documents": TableSpec(
        "tenant_id string, document_id string, space_id string, connector_id string, external_id string, source_type string, source_uri string, "
        "title string, status string, authority int, metadata string, active_revision_id string, version long, created_at timestamp, updated_at timestamp",
        ("tenant_id", "document_id"),
    ),
    "revisions": TableSpec("tenant_id string, revision_id string, document_id string, revision_number long, content_hash string, media_type string, language string, parser_version string, created_at timestamp"),
    "elements": TableSpec("tenant_id string, revision_id string, element_id string, ordinal int, element_type string, section_path array<string>, content string, language string"),
    "chunks": TableSpec("tenant_id string, space_id string, document_id string, revision_id string, chunk_id string, ordinal int, section_path array<string>, element_ids array<string>, content string, content_hash string"),
    "jobs": TableSpec(
        "tenant_id string, space_id string, document_id string, revision_id string, projection_type string, status string, attempts long, available_at timestamp, created_at timestamp",
        ("tenant_id", "revision_id", "projection_type"),
    ),
    "results": TableSpec("app string, batch long, tenant_id string, document_id string, action string, changed boolean, revision_id string, element_count long, chunk_count long, error_code string"),
}


def with_identity(records: DataFrame) -> DataFrame:
    """records with document_id, the name-based id of their source key, unless they bring their own."""
    if "document_id" in records.columns:
        return records
    return records.withColumn("document_id", uuid3(F.concat_ws(":", "tenant_id", "space_id", "connector_id", "external_id")))


def decided(records: DataFrame, documents: DataFrame, revisions: DataFrame) -> DataFrame:
    """What publishing does to each record (one for each document, with content_hash and `blank` for its content): action, revision_number, revision_id
    and error_code, beside the stored document's columns (old_...).

    A new fingerprint (content, media type, language and parser) is CREATE, a known one that is not
    active REACTIVATE, other titles, addresses, authorities or metadata alone METADATA, else NONE. REJECTED are
    deleted records, records without content, and those that would move a document to another source or space."""
    fingerprint = ["tenant_id", "document_id", "content_hash", "media_type", "language", "parser_version"]
    known = revisions.select(*fingerprint, F.col("revision_number").alias("known_number"), F.col("revision_id").alias("known_id"))
    high = revisions.groupBy("tenant_id", "document_id").agg(F.max("revision_number").alias("high"))
    kept = ["space_id", "connector_id", "external_id", "source_type", "source_uri", "title", "status", "authority", "metadata", "active_revision_id", "version", "created_at", "updated_at"]
    stored = documents.select("tenant_id", "document_id", *[F.col(c).alias(f"old_{c}") for c in kept])
    rows = records.withColumn("parser_version", F.lit(PARSER_VERSION))
    rows = rows.join(stored, ["tenant_id", "document_id"], "left").join(high, ["tenant_id", "document_id"], "left").join(known, fingerprint, "left")
    differs = lambda *names: ~_all(F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in names)
    there = F.col("old_version").isNotNull()
    error = (
        F.when(F.coalesce("deleted", F.lit(False)), "DELETED_RECORD")
        .when(F.col("blank"), "EMPTY_CONTENT")
        .when(there & differs("space_id", "connector_id", "external_id", "source_type"), "IDENTITY_MOVED")
    )
    active = (F.col("known_id") == F.col("old_active_revision_id")) & (F.col("old_status") == "ACTIVE")
    action = (
        F.when(F.col("error_code").isNotNull(), "REJECTED")
        .when(F.col("known_id").isNull(), "CREATE")
        .when(~F.coalesce(active, F.lit(False)), "REACTIVATE")
        .when(differs("title", "source_uri", "authority", "metadata"), "METADATA")
        .otherwise("NONE")
    )
    number = F.coalesce("known_number", F.coalesce("high", F.lit(0)) + 1)
    rows = rows.withColumn("error_code", error).withColumn("action", action).withColumn("revision_number", number.cast("long"))
    return rows.withColumn("revision_id", F.coalesce("known_id", uuid3(F.concat_ws(":", "document_id", F.col("revision_number").cast("string")))))


def _all(parts) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def publish(txn: Transaction, records: DataFrame, now: str, types: tuple[str, ...] = ("KEYWORD", "VECTOR"), target: int = 1200, longest: int = 2000) -> DataFrame:
    """Write what a batch of records (see RECORD) changes into a transaction, and give a result for each document.

    Of several records of one document in a batch the latest counts (by modified_at, then content). A changed
    document becomes ACTIVE with version + 1 and asks for each projection type of its head; times never fall.
    Elements and chunks are made for new revisions only. The caller commits. If the batch is in
    already, nothing is written and its stored results are given again.
    """
    if txn.done:
        return txn.read("results").where((F.col("app") == txn.app) & (F.col("batch") == txn.batch))
    key = ["tenant_id", "document_id"]
    # texts are read once, and go to another task once, if they are new: what is decided, is decided by their hashes
    given = with_identity(records).withColumn("content_hash", sha256(F.col("content"))).withColumn("blank", F.coalesce(stripped(F.col("content")), F.lit("")) == "")
    given = txn.stage("records", given)
    repeated = txn.stage("repeated", repeated_keys(given, key).select(*key))
    if not repeated.isEmpty():
        last = latest(given.join(repeated, key, "left_semi"), key, [F.desc_nulls_last("modified_at"), F.desc("content")])
        given = given.join(repeated, key, "left_anti").unionByName(txn.stage("latest", last))
    incoming = given.drop("content")
    ids = incoming.select(*key)
    # documents and revisions of this batch alone: the joins are on their keys
    documents, revisions = (txn.read(t).join(ids, key, "left_semi") for t in ("documents", "revisions"))
    plan = txn.stage("plan", decided(incoming, documents, revisions))
    changed, at = F.col("action").isin("CREATE", "REACTIVATE", "METADATA"), F.lit(now).cast("timestamp")

    made = plan.where("action = 'CREATE'")
    txn.write("revisions", made.withColumn("created_at", at))
    own = ["tenant_id", "space_id", "document_id", "revision_id"]
    texts = given.select(*key, "content").join(made.select(*own), key)
    parsed = txn.stage("parsed", markdown.parse_arrays(texts))
    elements = txn.write("elements", parsed.select("tenant_id", "revision_id", F.explode("elements").alias("e")).select("tenant_id", "revision_id", "e.*"))
    chunks = txn.write("chunks", markdown.pack_arrays(parsed, target, longest, own[:3]))

    moved = plan.where(changed)
    txn.write(
        "documents",
        moved.select(
            *key,
            *["space_id", "connector_id", "external_id", "source_type", "source_uri", "title", "authority", "metadata"],
            F.lit("ACTIVE").alias("status"),
            F.col("revision_id").alias("active_revision_id"),
            (F.coalesce("old_version", F.lit(0)) + 1).alias("version"),
            F.coalesce("old_created_at", at).alias("created_at"),
            F.greatest(F.coalesce("old_updated_at", at), at).alias("updated_at"),
        ),
    )
    kinds = F.explode(F.array(*[F.lit(t) for t in types]))
    wanted = moved.select("tenant_id", "space_id", "document_id", "revision_id", kinds.alias("projection_type"))
    jobs = txn.read("jobs").join(wanted.select("tenant_id", "revision_id", "projection_type"), ["tenant_id", "revision_id", "projection_type"], "left_semi")
    queued = enqueue(jobs.select("revision_id", "projection_type", "status", "attempts"), wanted).where("requeued")
    txn.write("jobs", queued.join(wanted, ["revision_id", "projection_type"]).withColumn("available_at", at).withColumn("created_at", at))

    count = lambda rows, name: rows.groupBy("revision_id").agg(F.count(F.lit(1)).alias(name))
    earlier = lambda t: txn.read(t).join(plan.where("known_id is not null").select("revision_id"), "revision_id", "left_semi")
    n_elements = count(elements.select("revision_id").unionByName(earlier("elements").select("revision_id")), "element_count")
    n_chunks = count(chunks.select("revision_id").unionByName(earlier("chunks").select("revision_id")), "chunk_count")
    kept = plan.select(*key, "action", changed.alias("changed"), F.when(F.col("action") != "REJECTED", F.col("revision_id")).alias("revision_id"), "error_code")
    results = kept.join(n_elements, "revision_id", "left").join(n_chunks, "revision_id", "left").na.fill(0, ["element_count", "chunk_count"])
    return txn.write("results", results.withColumn("app", F.lit(txn.app)).withColumn("batch", F.lit(txn.batch)))
