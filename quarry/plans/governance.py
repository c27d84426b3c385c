"""Queries on integrity, stored traces, connectors and evaluation set-up. QUERIES is the whole catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import gateway, governance, tracing
from quarry.operators.integrity import Check, Reference, Unique, delete, violations
from quarry.plans.catalogue import NOW, big, everything, query, tables_of, tenant_of
from quarry.plans.lifecycle import QUERIES, store_of
from quarry.plans.model import Model
from quarry.sources.shared import staged

__all__ = ["QUERIES"]
SPACE = ("tenant_id", "space_id")
DOCUMENT = ("tenant_id", "document_id")
REVISION = ("tenant_id", "revision_id")
CONNECTOR = ("tenant_id", "connector_id")

#: Primary keys of the knowledge tables.
KEYS = {
    "tenants": ("tenant_id",),
    "spaces": SPACE,
    "acl": (*SPACE, "subject_type", "subject_id", "permission"),
    "connectors": CONNECTOR,
    "checkpoints": CONNECTOR,
    "documents": DOCUMENT,
    "revisions": REVISION,
    "chunks": ("tenant_id", "chunk_id"),
    "jobs": ("job_id",),
    "datasets": ("dataset_id",),
    "cases": ("case_id",),
    "runs": ("run_id",),
    "results": ("run_id", "line"),
}

RULES = [
    *[Unique(f"{table}_key", table, key) for table, key in KEYS.items()],
    Unique("document_source", "documents", (*SPACE, "connector_id", "external_id")),
    Unique("revision_number", "revisions", (*DOCUMENT, "revision_number")),
    Unique("revision_content", "revisions", (*DOCUMENT, "content_hash")),
    Unique("chunk_place", "chunks", (*REVISION, "ordinal")),
    Reference("space_tenant", "spaces", ("tenant_id",), "tenants", ("tenant_id",)),
    Reference("acl_space", "acl", SPACE, "spaces", SPACE, cascade=True),
    Reference("connector_space", "connectors", SPACE, "spaces", SPACE),
    Reference("checkpoint_connector", "checkpoints", CONNECTOR, "connectors", CONNECTOR, cascade=True),
    Reference("document_space", "documents", SPACE, "spaces", SPACE),
    Reference("document_connector", "documents", (*SPACE, "connector_id"), "connectors", (*SPACE, "connector_id")),
    Reference("document_head", "documents", ("tenant_id", "document_id", "active_revision_id"), "revisions", ("tenant_id", "document_id", "revision_id")),
    Reference("revision_document", "revisions", DOCUMENT, "documents", DOCUMENT, cascade=True),
    Reference("chunk_document", "chunks", (*SPACE, "document_id"), "documents", (*SPACE, "document_id"), cascade=True),
    Reference("chunk_revision", "chunks", REVISION, "revisions", REVISION, cascade=True),
    Reference("job_document", "jobs", DOCUMENT, "documents", DOCUMENT, cascade=True),
    Reference("job_revision", "jobs", REVISION, "revisions", REVISION, cascade=True),
    Reference("case_dataset", "cases", ("dataset_id",), "datasets", ("dataset_id",), cascade=True),
    Reference("run_dataset", "runs", ("dataset_id",), "datasets", ("dataset_id",)),
    Reference("result_run", "results", ("run_id",), "runs", ("run_id",), cascade=True),
    Check("space_status", "spaces", "status in ('ACTIVE', 'ARCHIVED', 'DELETED')"),
    Check("acl_subject", "acl", "subject_type in ('USER', 'ROLE', 'DEPARTMENT', 'TENANT')"),
    Check("acl_permission", "acl", "permission in ('READ', 'WRITE', 'ADMIN')"),
    Check("checkpoint_version", "checkpoints", "version >= 0"),
    Check("document_status", "documents", "status in ('DRAFT', 'ACTIVE', 'DEPRECATED', 'ARCHIVED', 'DELETED')"),
    Check("document_authority", "documents", "authority between 0 and 100"),
    Check("revision_positive", "revisions", "revision_number > 0"),
    Check("chunk_ordinal", "chunks", "ordinal >= 0"),
    Check("job_status", "jobs", "status in ('PENDING', 'RUNNING', 'RETRY', 'SUCCEEDED', 'DEAD')"),
    Check("job_attempts", "jobs", "attempts >= 0"),
    Check("run_status", "runs", "status in ('RUNNING', 'SUCCEEDED', 'FAILED', 'CANCELLED')"),
    Check("result_metrics", "results", "recall between 0 and 1 and result_count >= 0"),
]


def governed(m: Model) -> dict[str, DataFrame]:
    """The knowledge tables; nations, customers, orders and their lines stand for evaluation datasets,
    cases, runs and results."""
    owner = m.raw("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("dataset_id"))
    status = F.create_map(*[F.lit(x) for x in ("O", "RUNNING", "F", "SUCCEEDED", "P", "FAILED")])
    documents = m.heads.select("doc_id", "tenant_id", "document_id", "space_id", "connector_id", "external_id", "status", "authority", F.col("revision_id").alias("active_revision_id"))
    connectors = m.documents.groupBy("tenant_id", "space_id", "connector_id").agg(F.count(F.lit(1)).alias("version"))
    return {
        "tenants": m.spaces.select("tenant_id").distinct(),
        "spaces": m.spaces,
        "acl": m.grants,
        "connectors": connectors.select("tenant_id", "space_id", "connector_id"),
        "checkpoints": connectors.select("tenant_id", "connector_id", "version"),
        "documents": documents,
        "revisions": m.revisions.select("doc_id", "tenant_id", "document_id", "revision_id", "revision_number", "content_hash"),
        "chunks": m.chunks.select("doc_id", "tenant_id", "space_id", "document_id", "revision_id", "chunk_id", "ordinal"),
        "jobs": m.jobs.select("job_id", "tenant_id", "document_id", "revision_id", "status", "attempts"),
        "datasets": m.raw("nation").select(F.col("n_nationkey").alias("dataset_id")),
        "cases": m.raw("customer").select(F.col("c_custkey").alias("case_id"), F.col("c_nationkey").alias("dataset_id")),
        "runs": m.raw("orders").join(owner, "o_custkey").select(F.col("o_orderkey").alias("run_id"), "dataset_id", F.element_at(status, F.col("o_orderstatus")).alias("status")),
        "results": m.raw("lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("line"), F.lit(0.5).alias("recall"), F.col("l_quantity").alias("result_count")),
    }


def planted(m: Model) -> dict[str, DataFrame]:
    """governed() with faults by number: documents moved to a space that is not there or of authority 101,
    revisions missing or written twice, chunks before the first, jobs of unknown status, grants of unknown
    permission, datasets and runs missing, results below nothing."""
    t = governed(m)
    put = lambda name, column, when, value: t[name].withColumn(column, F.when(F.expr(when), value).otherwise(F.col(column)))
    t["documents"] = put("documents", "space_id", "doc_id % 41 = 0", F.lit("nowhere"))
    t["documents"] = put("documents", "authority", "doc_id % 43 = 0", F.lit(101))
    kept = t["revisions"].where("doc_id % 37 <> 0")
    t["revisions"] = kept.unionByName(kept.where("doc_id % 31 = 0"))
    t["chunks"] = put("chunks", "ordinal", "doc_id % 29 = 0", F.lit(-1))
    t["jobs"] = put("jobs", "status", "job_id % 14 = 0", F.lit("LOST"))
    t["acl"] = put("acl", "permission", "subject_type = 'ROLE' and subject_id = 'role-1'", F.lit("OWN"))
    t["datasets"] = t["datasets"].where("dataset_id % 9 <> 0")
    t["runs"] = t["runs"].where("run_id % 100 <> 0")
    t["results"] = t["results"].withColumn("result_count", F.col("result_count") - 2)
    return t


@query
def integrity_report(m: Model) -> DataFrame:
    """Violations by rule of the tables with planted faults; most rules have none."""
    t = planted(m)
    # many rules read these, and each would make them from the texts again
    return violations(t | {name: staged(t[name], name) for name in ("documents", "revisions", "chunks", "jobs")}, RULES)


@query
def integrity_cascade(m: Model) -> DataFrame:
    """What goes with archived documents and every third dataset, by table, and the rows that hold it back by rule."""
    t = governed(m)
    roots = {"documents": t["documents"].where("status = 'ARCHIVED'"), "datasets": t["datasets"].where("dataset_id % 3 = 0")}
    done = delete(t, KEYS, RULES, roots)
    out = done.blocked.select(F.lit("blocked").alias("part"), F.col("rule").alias("name"), F.col("rows").alias("n"))
    for name, rows in done.gone.items():
        out = out.unionByName(rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit("gone").alias("part"), F.lit(name).alias("name"), "n"))
    return out


@query
def trace_store(m: Model) -> DataFrame:
    """Stored traces with their ordered steps: those of a run are appended, delivered again, and then sent
    once more with the requests of a second run, whose odd ones are new."""
    store = store_of(m, tracing.TABLES)
    named = m.queries.withColumn("request_id", F.concat(F.lit("r"), F.col("query_id").cast("string")))
    even = named.where("query_id % 2 = 0")
    first = gateway.default_gateway().retrieve(even, m.principals.where("query_id % 2 = 0"), everything(m), tables_of(m))
    second = gateway.Gateway().register("KEYWORD", gateway.Channel(gateway.keyword_channel)).retrieve(named, m.principals, everything(m), tables_of(m))
    for number, run in ((0, first), (0, first), (1, second)):
        txn = store.begin("traces", number)
        if not txn.done:
            tracing.append(txn, run, NOW)
            txn.commit()
    asked = named.select("tenant_id", "request_id")
    steps = F.array_join(F.transform("steps", lambda s: F.concat_ws(":", s["ordinal"].cast("string"), s["step_name"])), ",")
    return tracing.details(store, asked).select("request_id", "outcome", "query_hash", "result_count", steps.alias("steps"))


@query
def connector_versions(m: Model) -> DataFrame:
    """A connector for each space, known before for those of even number: registered once, twice where the number
    is a multiple of three, or for a space that is not ACTIVE."""
    n = F.regexp_extract("space_id", "([0-9]+)", 1).cast("int")
    own = m.spaces.withColumn("n", n).withColumn("connector_id", F.concat("space_id", F.lit(":c")))
    at = lambda day: F.lit(f"2024-01-{day:02}").cast("timestamp")
    known = own.where("n % 2 = 0").select("tenant_id", "connector_id", "space_id", F.lit("api").alias("connector_type"), F.lit("Old").alias("display_name"), F.lit('{"path":"/old"}').alias("config_json"), F.lit("PAUSED").alias("status"), F.lit(4).cast("long").alias("version"), at(1).alias("created_at"), at(1).alias("updated_at"))
    config = F.create_map(F.lit("path"), F.concat(F.lit("/"), "space_id"), F.lit("authority"), F.lit("1"))
    one = own.select("tenant_id", "connector_id", "space_id", F.lit("vault").alias("connector_type"), F.lit("New").alias("display_name"), (F.col("n") % 101).alias("authority"), config.alias("config"), at(2).alias("occurred_at"), "n")
    two = one.where("n % 3 = 0").withColumns({"display_name": F.lit("Newer"), "occurred_at": at(3)})
    rows, _ = governance.configure(known, m.spaces, one.unionByName(two).drop("n"))
    defined = governance.active_definitions(rows).select("tenant_id", "connector_id", big("authority", "authority"), F.element_at("config", "path").alias("path"))
    return rows.join(defined, ["tenant_id", "connector_id"], "left").select("tenant_id", "connector_id", "connector_type", "display_name", "status", "version", "authority", "path", F.unix_millis("created_at").alias("created_ms"))


@query
def evaluation_setup(m: Model) -> DataFrame:
    """Datasets by tenant and region as names (each nation a version), customers as cases, suppliers as runs:
    some cases ask for too much, lack a dataset or a query, and every seventh run fails."""
    key = lambda c, name: F.col(c).cast("long").alias(name)
    empty = lambda ddl: m.spark.createDataFrame([], ddl)
    nation = m.raw("nation")
    wanted = nation.select(tenant_of("n_nationkey").alias("tenant_id"), key("n_nationkey", "dataset_id"), F.concat(F.lit("set-"), F.col("n_regionkey").cast("string")).alias("name"), F.lit("").alias("description"), key("n_nationkey", "created_at"))
    datasets = governance.create_datasets(empty("tenant_id string, dataset_id long, name string, description string, version long, status string, created_at long"), wanted)
    n = F.col("c_custkey")
    cases, refused = governance.create_cases(
        empty("tenant_id string, case_id long, dataset_id long, query string, top_k int"),
        datasets,
        m.raw("customer").select(tenant_of("c_nationkey").alias("tenant_id"), key("c_custkey", "case_id"), F.when(n % 10 == 0, 1000).otherwise(F.col("c_nationkey")).cast("long").alias("dataset_id"), F.when(n % 10 == 1, " ").otherwise(F.col("c_name")).alias("query"), F.when(n % 10 == 2, 101).when(n % 10 == 3, 5).cast("int").alias("top_k")),
    )
    runs = governance.start_runs(
        empty("tenant_id string, run_id long, dataset_id long, requested_by string, started_at long, status string, case_count long, failed_count long, error_code string"),
        cases,
        m.raw("supplier").select(tenant_of("s_nationkey").alias("tenant_id"), key("s_suppkey", "run_id"), key("s_nationkey", "dataset_id"), F.lit("u").alias("requested_by"), key("s_suppkey", "started_at")),
    )
    runs = governance.fail_runs(runs, runs.where("run_id % 7 = 0").select("tenant_id", "run_id", F.lit("STOPPED").alias("error_code")))
    by = lambda rows, *cols: rows.groupBy("tenant_id", *cols).agg(F.count(F.lit(1)).alias("n"))
    parts = [
        by(datasets, "name", "version").select("tenant_id", F.lit("dataset").alias("part"), F.concat_ws("/", "name", F.col("version").cast("string"), F.lit("DRAFT")).alias("item"), "n"),
        by(cases, "top_k").select("tenant_id", F.lit("case"), F.col("top_k").cast("string"), "n"),
        by(refused, "error").select("tenant_id", F.lit("refused"), "error", "n"),
        by(runs, "status", "error_code", "case_count").select("tenant_id", F.lit("run"), F.concat_ws("/", "status", "error_code", F.col("case_count").cast("string")), "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query
def language_tag_forms(m: Model) -> DataFrame:
    """Tags with scripts, regions, variants, extensions and private use, in any case; some are ill-formed."""
    forms = ["{}", " {}-aT ", "{}-LATN-at", "{}-1996-FONIPA", "{}-u-CO-phonebk-a-xyz", "{}-x-Own", "zh-CMN-hans-cn", "iw", "{}_AT", "{}-1996-1996", "{}-a-xx-a-yy", "{}-", "x-Lone"]
    raw = F.get(F.array(*[F.replace(F.lit(f), F.lit("{}"), F.upper("lang")) for f in forms]), (F.col("doc_id") % len(forms)).cast("int"))
    return m.raw("documents").select("doc_id", tx.language_tag(raw).alias("language"))
