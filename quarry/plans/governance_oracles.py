"""The queries of plans.governance as DuckDB SQL. ORACLES is the whole catalogue's."""

from __future__ import annotations

from quarry.operators.integrity import Check, Reference, Rule, Unique
from quarry.plans.governance import RULES
from quarry.plans.lifecycle_oracles import ORACLES
from quarry.plans.oracles import sql

__all__ = ["ORACLES"]
TENANT = "'tenant-' || (['en','de','es','fr'])[{} % 4 + 1]"
REVISIONS = "SELECT doc_id, tenant_id, document_id, revision_id, revision_number, content_hash FROM rev WHERE doc_id % 37 <> 0"

#: The tables with planted faults.
PLANTED = {
    "tenants": "SELECT DISTINCT tenant_id FROM space",
    "spaces": "SELECT * FROM space",
    "acl": "SELECT tenant_id, space_id, subject_type, subject_id, CASE WHEN subject_id = 'role-1' THEN 'OWN' ELSE permission END AS permission FROM acl",
    "connectors": "SELECT DISTINCT tenant_id, space_id, connector_id FROM kdoc",
    "checkpoints": "SELECT tenant_id, connector_id, count(*) AS version FROM kdoc GROUP BY tenant_id, space_id, connector_id",
    "documents": "SELECT tenant_id, document_id, CASE WHEN doc_id % 41 = 0 THEN 'nowhere' ELSE space_id END AS space_id, connector_id, external_id, status, CASE WHEN doc_id % 43 = 0 THEN 101 ELSE authority END AS authority, revision_id AS active_revision_id FROM head",
    "revisions": f"{REVISIONS} UNION ALL {REVISIONS} AND doc_id % 31 = 0",
    "chunks": "SELECT tenant_id, space_id, document_id, revision_id, chunk_id, CASE WHEN doc_id % 29 = 0 THEN -1 ELSE ordinal END AS ordinal FROM chunk",
    "jobs": "SELECT job_id, tenant_id, document_id, revision_id, CASE WHEN job_id % 14 = 0 THEN 'LOST' ELSE status END AS status, attempts FROM job",
    "datasets": "SELECT n_nationkey AS dataset_id FROM nation WHERE n_nationkey % 9 <> 0",
    "cases": "SELECT c_custkey AS case_id, c_nationkey AS dataset_id FROM customer",
    "runs": "SELECT o_orderkey AS run_id, c_nationkey AS dataset_id, CASE o_orderstatus WHEN 'O' THEN 'RUNNING' WHEN 'F' THEN 'SUCCEEDED' WHEN 'P' THEN 'FAILED' END AS status FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 100 <> 0",
    "results": "SELECT l_orderkey AS run_id, l_linenumber AS line, 0.5 AS recall, l_quantity - 2 AS result_count FROM lineitem",
}


def broken(rule: Rule) -> str:
    """The number of violations of a rule over PLANTED."""
    rows = f"(SELECT * FROM p_{rule.table})"
    if isinstance(rule, Check):
        return f"SELECT count(*) FROM {rows} WHERE NOT ({rule.holds})"
    whole = " AND ".join(f"c.{k} IS NOT NULL" for k in rule.key)
    if isinstance(rule, Unique):
        return f"SELECT count(*) - count(DISTINCT ({', '.join(f'c.{k}' for k in rule.key)})) FROM {rows} c WHERE {whole}"
    assert isinstance(rule, Reference)
    same = " AND ".join(f"c.{k} = p.{q}" for k, q in zip(rule.key, rule.parent_key, strict=True))
    return f"SELECT count(*) FROM {rows} c WHERE {whole} AND NOT EXISTS (SELECT 1 FROM p_{rule.parent} p WHERE {same})"


FAULTY = ", ".join(f"p_{name} AS MATERIALIZED ({rows})" for name, rows in PLANTED.items())
ORACLES["integrity_report"] = sql(f"SELECT * FROM (WITH {FAULTY} " + " UNION ALL ".join(f"SELECT '{r.name}' AS rule, ({broken(r)})::BIGINT AS violations" for r in RULES) + ")", "space", "acl", "head", "chunk", "job")

GONE = "SELECT document_id FROM kdoc WHERE status = 'ARCHIVED'"
ORACLES["integrity_cascade"] = sql(
    f"""SELECT part, name, n FROM (SELECT 'gone' AS part, 'documents' AS name, (SELECT count(*) FROM ({GONE})) AS n
    UNION ALL SELECT 'gone', 'revisions', (SELECT count(*) FROM rev WHERE document_id IN ({GONE}))
    UNION ALL SELECT 'gone', 'chunks', (SELECT count(*) FROM chunk WHERE document_id IN ({GONE}))
    UNION ALL SELECT 'gone', 'jobs', (SELECT count(*) FROM job WHERE document_id IN ({GONE}))
    UNION ALL SELECT 'gone', 'datasets', (SELECT count(*) FROM nation WHERE n_nationkey % 3 = 0)
    UNION ALL SELECT 'gone', 'cases', (SELECT count(*) FROM customer WHERE c_nationkey % 3 = 0)
    UNION ALL SELECT 'blocked', 'document_head', 0
    UNION ALL SELECT 'blocked', 'run_dataset', (SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey % 3 = 0))""",
    "chunk", "job",
)


def traced(steps: str, rest: int, **how: str) -> str:
    names = ",".join(f"{i}:{s}" for i, s in enumerate(steps.split()))
    return sql(
        f"""SELECT 'r' || query_id AS request_id, CASE WHEN query_id IN (SELECT query_id FROM scope) THEN 'OK' ELSE 'DENY_ALL' END AS outcome, sha256(normalised) AS query_hash,
        (SELECT count(*) FROM evid e WHERE e.query_id = q.query_id) AS result_count, '{names}' AS steps FROM q WHERE query_id % 2 = {rest}""",
        "evid", "scope", **how,
    )


ORACLES["trace_store"] = f"SELECT * FROM ({traced('ACCESS PLAN KEYWORD VECTOR GUARD FUSE EVIDENCE', 0)}) UNION ALL SELECT * FROM ({traced('ACCESS PLAN KEYWORD GUARD FUSE EVIDENCE', 1, novector='AND false')})"
ORACLES["connector_versions"] = sql(
    """SELECT tenant_id, space_id || ':c' AS connector_id, CASE WHEN live THEN 'vault' ELSE 'api' END AS connector_type, CASE WHEN NOT live THEN 'Old' WHEN n % 3 = 0 THEN 'Newer' ELSE 'New' END AS display_name,
    CASE WHEN live THEN 'ACTIVE' ELSE 'PAUSED' END AS status, (CASE WHEN known THEN 4 ELSE -1 END + CASE WHEN NOT live THEN 0 WHEN n % 3 = 0 THEN 2 ELSE 1 END)::BIGINT AS version,
    CASE WHEN live THEN n % 101 END::BIGINT AS authority, CASE WHEN live THEN '/' || space_id END AS path, epoch_ms(CASE WHEN known THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-01-02' END) AS created_ms
    FROM (SELECT s.tenant_id, s.space_id, n, status = 'ACTIVE' AS live, n % 2 = 0 AS known FROM space s JOIN num m ON m.tenant_id = s.tenant_id AND m.space_id = s.space_id) WHERE live OR known""",
    "num",
)
NATION = TENANT.format("c_nationkey")
ORACLES["evaluation_setup"] = f"""WITH cases AS (SELECT {NATION} AS tenant_id, c_nationkey AS dataset_id, CASE c_custkey % 10 WHEN 0 THEN 'NO_DATASET' WHEN 1 THEN 'QUERY' WHEN 2 THEN 'TOP_K' END AS error, CASE c_custkey % 10 WHEN 3 THEN 5 ELSE 8 END AS top_k FROM customer)
    SELECT tenant_id, 'dataset' AS part, name || '/' || row_number() OVER (PARTITION BY tenant_id, name ORDER BY n_nationkey) || '/DRAFT' AS item, 1::BIGINT AS n FROM (SELECT n_nationkey, {TENANT.format("n_nationkey")} AS tenant_id, 'set-' || n_regionkey AS name FROM nation)
    UNION ALL SELECT tenant_id, 'case', top_k::VARCHAR, count(*) FROM cases WHERE error IS NULL GROUP BY ALL
    UNION ALL SELECT tenant_id, 'refused', error, count(*) FROM cases WHERE error IS NOT NULL GROUP BY ALL
    UNION ALL SELECT tenant_id, 'run', item, count(*) FROM (SELECT {TENANT.format("s_nationkey")} AS tenant_id,
        CASE WHEN s_suppkey % 7 = 0 THEN 'FAILED/STOPPED/' ELSE 'RUNNING/' END || (SELECT count(*) FROM cases c WHERE c.dataset_id = s_nationkey AND c.error IS NULL) AS item FROM supplier) GROUP BY ALL"""
ORACLES["language_tag_forms"] = """SELECT doc_id, CASE WHEN lang IS NULL THEN NULL ELSE CASE doc_id % 13 WHEN 0 THEN lower(lang) WHEN 1 THEN lower(lang) || '-AT' WHEN 2 THEN lower(lang) || '-Latn-AT' WHEN 3 THEN lower(lang) || '-1996-fonipa'
    WHEN 4 THEN lower(lang) || '-a-xyz-u-co-phonebk' WHEN 5 THEN lower(lang) || '-x-own' WHEN 6 THEN 'cmn-Hans-CN' WHEN 7 THEN 'he' WHEN 12 THEN 'x-lone' END END AS language FROM documents"""
