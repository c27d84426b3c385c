"""The queries of plans.lifecycle as DuckDB SQL. ORACLES is the whole catalogue's."""

from __future__ import annotations

from quarry.plans.oracles import ELEMENTS, ORACLES, sql, tokens, uuid3

__all__ = ["ORACLES"]
NOW = "TIMESTAMP '2024-01-15 00:00:00'"
KNOWN = "h.doc_id % 7 <> 6"
#: each head with what publishing does to it
DONE = f"""(SELECT *, action <> 'NONE' AS changed FROM (SELECT h.*, {KNOWN} AS known,
        CASE h.doc_id % 4 WHEN 2 THEN (SELECT r.content_hash FROM rev r WHERE r.document_id = h.document_id AND r.revision_number = 1) WHEN 3 THEN sha256(h.content || '!') ELSE h.content_hash END AS new_hash,
        CASE WHEN h.doc_id % 4 = 1 THEN 'New ' || title ELSE title END AS new_title,
        CASE WHEN NOT ({KNOWN}) THEN 'CREATE' WHEN h.doc_id % 4 = 0 THEN 'NONE' WHEN h.doc_id % 4 = 1 THEN CASE WHEN title IS NULL THEN 'NONE' ELSE 'METADATA' END
            WHEN h.doc_id % 4 = 2 THEN CASE active_revision WHEN 2 THEN 'REACTIVATE' ELSE 'NONE' END ELSE 'CREATE' END AS action,
        CASE WHEN NOT ({KNOWN}) THEN 1 WHEN h.doc_id % 4 = 2 THEN 1 WHEN h.doc_id % 4 = 3 THEN active_revision + 1 ELSE active_revision END::BIGINT AS new_number FROM head h))"""
WANTED = f"SELECT {uuid3("document_id || ':' || new_number")} AS revision_id, t.projection_type FROM {DONE} d, (VALUES ('KEYWORD'), ('VECTOR')) t(projection_type) WHERE changed"
TAKEN = f"""SELECT job_id FROM job WHERE (status IN ('PENDING', 'RETRY') AND available_at <= {NOW}) OR (status = 'RUNNING' AND lease_until < {NOW}) ORDER BY available_at, created_at, job_id LIMIT 500"""
LEASED = f"""(SELECT j.job_id, CASE WHEN t.job_id IS NOT NULL THEN 'RUNNING' ELSE status END AS status, (attempts + (t.job_id IS NOT NULL)::INT)::BIGINT AS attempts,
        CASE WHEN t.job_id IS NOT NULL THEN 'worker-1' WHEN status = 'RUNNING' THEN 'worker-0' END AS lease_owner,
        CASE WHEN t.job_id IS NOT NULL THEN {NOW} + INTERVAL 2 MINUTE ELSE lease_until END AS lease_until FROM job j LEFT JOIN ({TAKEN}) t ON t.job_id = j.job_id)"""
KEY = "replace(replace(rtrim(to_base64(encode(concat_ws(chr(31), c.tenant_id, c.chunk_id))), '='), '+', '-'), '/', '_')"


def count_of(name: str, rows: str) -> str:
    return f"SELECT '{name}' AS name, (SELECT count(*) FROM ({rows}))"


def repeated(rows: str, key: str) -> str:
    return f"SELECT 1 FROM ({rows}) GROUP BY {key} HAVING count(*) > 1"


ORACLES["publish_documents"] = sql(
    f"""SELECT document_id, CASE WHEN changed THEN new_title ELSE title END AS title, authority::BIGINT AS authority,
        CASE WHEN changed THEN new_number ELSE active_revision END::BIGINT AS active_revision, (known::INT + changed::INT)::BIGINT AS version FROM {DONE}""",
    "head", "rev",
)
ORACLES["publish_revisions"] = sql(
    f"SELECT document_id, revision_number::BIGINT AS revision_number, content_hash FROM rev h WHERE {KNOWN} UNION ALL SELECT document_id, new_number, new_hash FROM {DONE} WHERE action = 'CREATE'", "head", "rev"
)
ORACLES["publish_jobs"] = sql(
    f"""SELECT coalesce(j.revision_id, w.revision_id) AS revision_id, coalesce(j.projection_type, w.projection_type) AS projection_type,
        CASE WHEN fresh THEN 'PENDING' ELSE status END AS status, CASE WHEN fresh THEN 0 ELSE attempts END::BIGINT AS attempts, fresh AS requeued
        FROM job j FULL JOIN ({WANTED}) w ON w.revision_id = j.revision_id AND w.projection_type = j.projection_type,
        LATERAL (SELECT w.revision_id IS NOT NULL AND (j.status IS NULL OR j.status IN ('SUCCEEDED', 'DEAD')) AS fresh)""",
    "head", "rev", "job",
)
ORACLES["ingest_results"] = sql(
    f"""SELECT d.document_id, changed, coalesce(n, 0)::BIGINT AS chunk_count, CASE WHEN changed THEN 'QUEUED' ELSE 'UNCHANGED' END AS vector_status, NULL::VARCHAR AS warning
        FROM {DONE} d LEFT JOIN (SELECT revision_id, count(*) AS n FROM chunk GROUP BY revision_id) c ON c.revision_id = {uuid3("d.document_id || ':' || d.new_number")}""",
    "head", "rev", "chunk",
)
ORACLES["job_lease"] = sql(f"SELECT * FROM {LEASED}", "job")
ORACLES["job_settle"] = sql(
    f"""SELECT job_id, status, attempts, lease_owner, applied, last_error_code, CASE WHEN status = 'RETRY' AND applied THEN epoch_ms({NOW}) + least(300000, 2000 * pow(2, greatest(attempts - 1, 0)))::BIGINT ELSE epoch_us(available_at) // 1000 END AS available_ms FROM (
        SELECT job_id, CASE WHEN NOT applied THEN status WHEN job_id % 2 = 0 THEN 'SUCCEEDED' WHEN attempts >= 5 THEN 'DEAD' ELSE 'RETRY' END AS status, attempts, available_at,
        CASE WHEN NOT applied THEN lease_owner END AS lease_owner, CASE WHEN applied AND job_id % 2 <> 0 THEN 'PROJECTION_FAILED' END AS last_error_code, applied
        FROM (SELECT l.*, j.available_at, l.job_id % 3 <> 0 AND l.status = 'RUNNING' AND coalesce(l.lease_owner = 'worker-1', false) AS applied FROM {LEASED} l JOIN job j ON j.job_id = l.job_id))""",
    "job",
)
ORACLES["connector_sync_runs"] = """SELECT l_orderkey AS run_id, CASE WHEN bad THEN 'FAILED' ELSE 'SUCCEEDED' END AS status, CASE WHEN bad THEN 0 ELSE seen END::BIGINT AS records_seen,
    CASE WHEN bad THEN 0 ELSE changed END::BIGINT AS records_changed, CASE WHEN NOT bad THEN last WHEN stop > 0 THEN stop - 1 END::BIGINT AS checkpoint, CASE WHEN bad THEN 'CONNECTOR_SYNC_FAILED' END AS error_code FROM (
    SELECT l_orderkey, count(*) AS seen, count(*) FILTER (WHERE l_returnflag = 'R') AS changed, bool_or(l_quantity >= 48) AS bad, max((l_linenumber - 1) // 2) AS last,
        min(CASE WHEN l_quantity >= 48 THEN (l_linenumber - 1) // 2 END) AS stop FROM lineitem GROUP BY l_orderkey)"""
ORACLES["principals_provisioned"] = sql(
    """SELECT tenant_id, principal_id, status, query_id % 2 = 0 AND status = 'ACTIVE' AS admitted FROM prin
        UNION ALL SELECT tenant_id, principal_id || '-new', 'ACTIVE', true FROM prin WHERE query_id % 2 = 0""",
    "prin",
)
ORACLES["spaces_provisioned"] = sql(
    """SELECT s.tenant_id, s.space_id, CASE WHEN first_doc % 2 = 0 THEN 'Renamed ' || s.space_id ELSE name END AS name, CASE WHEN first_doc % 2 = 0 THEN 'ACTIVE' ELSE status END AS status
        FROM space s JOIN (SELECT tenant_id, space_id, min(doc_id) AS first_doc FROM kdoc GROUP BY tenant_id, space_id) f ON f.tenant_id = s.tenant_id AND f.space_id = s.space_id
        UNION ALL SELECT DISTINCT tenant_id, 'space-new', 'New', 'ACTIVE' FROM space""",
    "space",
)
ORACLES["document_lookup"] = sql("SELECT doc_id, CASE WHEN doc_id % 10 <> 0 AND doc_id % 30 <> 7 THEN document_id END AS document_id, doc_id % 30 = 7 AS ambiguous FROM kdoc", "kdoc")
ORACLES["projection_source"] = sql(
    """SELECT c.chunk_id, c.ordinal::BIGINT AS ordinal, '{"space":"' || c.space_id || '","language":"' || coalesce(c.language, 'und') || '"}' AS metadata
        FROM chunk c JOIN head h ON h.revision_id = c.revision_id AND h.status = 'ACTIVE'""",
    "chunk", "head",
)
ORACLES["keyword_projection"] = sql(f"SELECT {KEY} AS key, c.chunk_id, len({tokens('c.content')})::BIGINT AS length FROM chunk c JOIN head h ON h.revision_id = c.revision_id AND h.status = 'ACTIVE'", "chunk", "head")
ORACLES["vector_projection"] = sql(
    rf"""SELECT {KEY} AS key, vec_id, trim(regexp_replace(lower('Quarry ' || tenant_id || '--' || space_id || '__64 '), '[^a-z0-9]+', '_', 'g'), '_') AS collection
        FROM vec c WHERE vec_id % 13 NOT BETWEEN 1 AND 5 AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0""",
    "vec",
)
ORACLES["trace_sink"] = """SELECT user_id, event_type, event_id FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 3 <> 0, ts, event_id) = 1"""
ARCHIVED = "(SELECT k.* FROM kdoc k JOIN space s ON s.tenant_id = k.tenant_id AND s.space_id = k.space_id AND s.status = 'ARCHIVED')"
ORACLES["cascade_delete"] = sql(
    " UNION ALL ".join(
        f"SELECT '{name}' AS name, (SELECT count(*) FROM {rows}) AS deleted"
        for name, rows in {
            "documents": ARCHIVED,
            "revisions": f"rev WHERE document_id IN (SELECT document_id FROM {ARCHIVED})",
            "chunks": f"chunk WHERE document_id IN (SELECT document_id FROM {ARCHIVED})",
            "acl": "acl a JOIN space s ON s.tenant_id = a.tenant_id AND s.space_id = a.space_id AND s.status = 'ARCHIVED'",
            "jobs": f"job WHERE document_id IN (SELECT document_id FROM {ARCHIVED})",
        }.items()
    ),
    "space", "acl", "chunk", "job",
)
FIRST_DOC = "(SELECT tenant_id, space_id, min(doc_id) AS first_doc FROM kdoc GROUP BY tenant_id, space_id)"
ORACLES["constraint_violations_planted"] = sql(
    "SELECT name, violations FROM ("
    + " UNION ALL ".join(
        [
            count_of("source_identity", "SELECT 1 FROM kdoc WHERE doc_id % 50 = 0") + " AS violations",
            count_of("revision_number", "SELECT 1 FROM rev WHERE doc_id % 30 = 0"),
            count_of("revision_fingerprint", "SELECT 1 FROM rev WHERE doc_id % 30 = 0"),
            count_of("active_generation", f"SELECT 1 FROM {FIRST_DOC} WHERE first_doc % 8 = 1"),
            count_of("job_key", "SELECT 1 FROM job WHERE job_id % 6 = 0"),
            count_of("job_values", "SELECT 1 FROM job WHERE job_id % 14 = 0 OR attempts - CASE WHEN job_id % 12 = 0 THEN 1 ELSE 0 END < 0"),
            count_of("job_lease", "SELECT 1 FROM job WHERE status = 'RUNNING' AND job_id % 4 = 0"),
            count_of("trace_request", repeated("SELECT * FROM events", "user_id, event_type")),
            count_of("batch_owner", "SELECT 1 FROM chunk c LEFT JOIN head h ON h.revision_id = c.revision_id AND h.document_id = c.document_id AND h.doc_id % 9 <> 0 WHERE h.doc_id IS NULL"),
        ]
    )
    + ")",
    "head", "chunk", "job",
)
EVALUATED = """(SELECT v.vec_id AS case_id, (v.vec_id // 20) % 5 AS run_id, c.query_id IS NULL AS failed, coalesce(hit::INT::DOUBLE, 0) AS hit, coalesce(recall, 0) AS recall,
    coalesce(reciprocal_rank, 0) AS reciprocal_rank, coalesce(ndcg, 0) AS ndcg FROM vec v LEFT JOIN case_ c ON c.query_id = v.vec_id WHERE v.vec_id % 20 = 0)"""
ORACLES["evaluation_runs"] = sql(
    f"""SELECT r.run_id::BIGINT AS run_id, CASE WHEN r.run_id = 4 THEN 'FAILED' WHEN n IS NULL THEN 'RUNNING' ELSE 'SUCCEEDED' END AS status, n AS case_count, f AS failed_count, a AS hit_rate, b AS recall, c AS mrr, d AS ndcg
        FROM range(5) r(run_id) LEFT JOIN (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE failed) AS f, round(avg(hit), 9) AS a, round(avg(recall), 9) AS b, round(avg(reciprocal_rank), 9) AS c, round(avg(ndcg), 9) AS d
        FROM {EVALUATED} WHERE run_id <> 4 GROUP BY run_id) e ON e.run_id = r.run_id""",
    "case_",
)
ORACLES["evaluation_results"] = sql(
    f"""SELECT run_id, case_id, CASE WHEN failed OR run_id = 4 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
        {", ".join(f"CASE WHEN run_id = 4 THEN 0 ELSE round({c}, 9) END AS {c}" for c in ("hit", "recall", "reciprocal_rank", "ndcg"))} FROM {EVALUATED} WHERE run_id <> 4 OR case_id % 3 = 0""",
    "case_",
)
SPACE_NUMBER = "CAST(regexp_extract(space_id, '([0-9]+)', 1) AS INTEGER)"
ORACLES["scope_restricted"] = sql(
    f"""SELECT query_id, tenant_id, space_id FROM scope s WHERE query_id % 2 <> 0 OR {SPACE_NUMBER} = 1
        OR NOT EXISTS (SELECT 1 FROM space t WHERE t.tenant_id = s.tenant_id AND CAST(regexp_extract(t.space_id, '([0-9]+)', 1) AS INTEGER) = 1)""",
    "scope",
)
# the scope is narrowed before the candidates are found, so those parts are made over it
NARROW = f"""SELECT query_id, tenant_id, space_id FROM ({{}}) s WHERE query_id % 9 <> 0 AND (query_id % 3 <> 0 OR {SPACE_NUMBER} % 2 = 0
    OR NOT EXISTS (SELECT 1 FROM space t WHERE t.tenant_id = s.tenant_id AND CAST(regexp_extract(t.space_id, '([0-9]+)', 1) AS INTEGER) % 2 = 0))"""
ORACLES["retrieve_bundles"] = sql(
    """SELECT q.query_id, CASE WHEN q.query_id % 9 = 0 THEN 'INVALID' WHEN q.query_id NOT IN (SELECT query_id FROM scope) THEN 'DENY_ALL' ELSE 'OK' END AS outcome,
        count(e.evidence_id) AS n_evidence, coalesce(string_agg(evidence_id, ',' ORDER BY position), '') AS evidence_ids, coalesce(arg_min(relevance, position) >= 0.5, false) AS sufficient
        FROM q LEFT JOIN evid e ON e.query_id = q.query_id GROUP BY q.query_id""",
    "evid", "scope",
    over={"scope": NARROW},
)
ORACLES["retrieve_straying"] = sql(
    """SELECT query_id, CASE WHEN query_id NOT IN (SELECT query_id FROM scope) THEN 'DENY_ALL' WHEN query_id % 5 = 0 THEN 'FAILED' ELSE 'OK' END AS outcome,
        CASE WHEN query_id % 5 = 0 THEN 0 ELSE (SELECT count(*) FROM evid e WHERE e.query_id = q.query_id) END AS n_evidence FROM q""",
    "evid", "scope",
    novector="AND false",
)
LETTERS = r"'[^\p{L}\p{N}]'"
ORACLES["snapshot_publish"] = rf"""SELECT doc_id, CASE WHEN doc_id % 8 = 3 THEN 3 WHEN doc_id % 4 IN (1, 3) THEN 2 ELSE 1 END::BIGINT AS version, CASE WHEN doc_id % 8 = 7 THEN 2 ELSE 1 END::BIGINT AS revision_number,
    CASE WHEN doc_id % 4 = 1 THEN 'New ' ELSE 'Doc ' END || doc_id AS title, CASE WHEN doc_id % 4 = 3 THEN 2 ELSE 1 END::BIGINT AS n_revisions, CASE WHEN doc_id % 4 = 3 THEN 4 ELSE 2 END::BIGINT AS n_jobs,
    md5(regexp_replace(text || CASE WHEN doc_id % 8 = 7 THEN chr(10) || 'more' ELSE '' END, {LETTERS}, '', 'g')) AS letters
    FROM documents WHERE regexp_matches(text, '\S')"""
ORACLES["snapshot_results"] = r"""SELECT batch::BIGINT AS batch, action, count(*) AS n FROM (SELECT 0 AS batch, CASE WHEN regexp_matches(text, '\S') THEN 'CREATE' ELSE 'REJECTED' END AS action FROM documents
    UNION ALL SELECT 1, CASE WHEN NOT regexp_matches(text, '\S') THEN 'REJECTED' WHEN doc_id % 4 = 1 THEN 'METADATA' WHEN doc_id % 4 = 3 THEN 'CREATE' ELSE 'NONE' END FROM documents WHERE doc_id % 4 <> 2
    UNION ALL SELECT 2, CASE WHEN NOT regexp_matches(text, '\S') THEN 'REJECTED' ELSE 'REACTIVATE' END FROM documents WHERE doc_id % 8 = 3) GROUP BY ALL"""
ORACLES["connector_pages"] = r"""SELECT n.run_id, status, seen::BIGINT AS records_seen, changed::BIGINT AS records_changed, error_code, (SELECT count(*) FROM documents)::BIGINT AS documents FROM (SELECT 0 AS run_id, 'FAILED' AS status, NULL::BIGINT AS seen, NULL::BIGINT AS changed, 'CONNECTOR_SYNC_FAILED' AS error_code
    UNION ALL SELECT 1, 'SUCCEEDED', (SELECT count(*) FROM documents), (SELECT count(*) FROM documents WHERE regexp_matches(text, '\S')), NULL
    UNION ALL SELECT 2, 'SUCCEEDED', (SELECT count(*) FROM documents), 0, NULL) n"""
ORACLES["projection_worker"] = rf"""SELECT doc_id, CASE WHEN doc_id % 8 = 7 THEN 2 ELSE 1 END::BIGINT AS revision_number, length(array_to_string({tokens("text || CASE WHEN doc_id % 8 = 7 THEN chr(10) || 'more' ELSE '' END")}, ''))::BIGINT AS n_letters, 'SUCCEEDED' AS status,
    CASE WHEN doc_id % 4 = 3 THEN 2 ELSE 1 END::BIGINT AS n_jobs FROM documents WHERE regexp_matches(text, '\S')"""
ORACLES["generation_switch"] = sql(
    """SELECT phase, query_id, vec_id, rank, round(least(1.0, greatest(0.0, raw)), 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY phase, query_id ORDER BY raw DESC, chunk_id) AS rank FROM (
        SELECT p.phase, a.vec_id AS query_id, b.vec_id, b.chunk_id, CASE p.phase WHEN 'AFTER' THEN list_cosine_similarity(b.embedding[1:32], a.embedding[1:32]) ELSE list_cosine_similarity(b.embedding, a.embedding) END AS raw
        FROM vec a JOIN vec b ON b.tenant_id = a.tenant_id AND b.space_id = a.space_id AND b.vec_id <> a.vec_id, (VALUES ('BEFORE'), ('BUILDING'), ('AFTER')) p(phase) WHERE a.vec_id % 20 = 0)) WHERE rank <= 5""",
    "vec",
)
ORACLES["generation_states"] = sql("SELECT tenant_id, space_id, dims::BIGINT AS dims, CASE dims WHEN 64 THEN 'RETIRED' ELSE 'ACTIVE' END AS status, count(*) AS vectors FROM vec, (VALUES (64), (32)) d(dims) GROUP BY ALL", "vec")
ORACLES["markdown_elements"] = ELEMENTS
