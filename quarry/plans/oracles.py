"""The queries of the catalogue as DuckDB SQL over the same tables."""

from __future__ import annotations

from quarry.functions.text import RELATION_MARKERS


def uuid3(key: str) -> str:
    m = f"md5({key})"
    digit = f"(strpos('0123456789abcdef', substr({m}, 17, 1)) - 1) % 4 + 1"
    return f"(substr({m},1,8) || '-' || substr({m},9,4) || '-3' || substr({m},14,3) || '-' || substr('89ab', {digit}, 1) || substr({m},18,3) || '-' || substr({m},21,12))"


def tokens(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


NORMALISED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
MARKERS = "|".join(RELATION_MARKERS)

PARTS = {
    "kdoc": f"""SELECT d.doc_id, 'tenant-' || lang AS tenant_id, source AS space_id, 'api-upload:' || source AS connector_id,
        'doc-' || d.doc_id AS external_id,
        {uuid3("'tenant-' || lang || ':' || source || ':api-upload:' || source || ':doc-' || d.doc_id")} AS document_id,
        substr(split_part(text, chr(10), 1), 1, 80) AS title,
        CASE quality WHEN 1 THEN 80 WHEN 0 THEN 40 ELSE 50 END AS authority,
        CASE WHEN d.doc_id % 17 = 0 THEN 'ARCHIVED' ELSE 'ACTIVE' END AS status, lang AS language, CASE WHEN d.doc_id % 3 = 0 THEN 'OBSIDIAN' ELSE 'API' END AS source_type,
        'https://example.org/' || d.doc_id AS source_uri,
        CASE WHEN d.doc_id % 5 = 0 THEN 2 ELSE 1 END AS active_revision, text
        FROM documents d LEFT JOIN (SELECT doc_id, quality FROM labels) l ON l.doc_id = d.doc_id""",
    "rev": f"""SELECT doc_id, tenant_id, space_id, document_id, n AS revision_number,
        {uuid3("document_id || ':' || n")} AS revision_id,
        CASE WHEN n = 2 THEN text || ' v2' ELSE text END AS content,
        sha256(CASE WHEN n = 2 THEN text || ' v2' ELSE text END) AS content_hash, language
        FROM kdoc, (VALUES (1), (2)) v(n) WHERE n <= active_revision""",
    "head": """SELECT k.* EXCLUDE (text), r.revision_id, r.content, r.content_hash FROM kdoc k
        JOIN rev r ON r.document_id = k.document_id AND r.revision_number = k.active_revision""",
    "chunk": f"""SELECT * EXCLUDE (lines), {uuid3("revision_id || ':' || ordinal")} AS chunk_id, sha256(content) AS content_hash,
        coalesce(array_to_string(list_slice({tokens('lines[ordinal]')}, 1, 2), ' '), '') AS section_path FROM (
        SELECT doc_id, tenant_id, space_id, document_id, revision_id, language, string_split(content, chr(10)) AS lines,
            unnest(string_split(content, chr(10))) AS content,
            generate_subscripts(string_split(content, chr(10)), 1) - 1 AS ordinal FROM rev) WHERE trim(content) <> ''""",
    "q": f"""SELECT query_id, tenant_id, principal_id, text, 8 AS top_k, {NORMALISED} AS normalised, 40 AS candidate_limit FROM (
        SELECT item_id AS query_id, 'tenant-' || (['en','de','es','fr'])[(item_id % 2) * (item_id % 4) + 1] AS tenant_id,
            'user-' || item_id AS principal_id, array_to_string(list_slice(string_split(text, ' '), 1, 2), ' ') AS text FROM benchmark)""",
    "space": """SELECT tenant_id, space_id, 'Space ' || space_id AS name,
        CASE WHEN min(doc_id) % 13 = 0 THEN 'ARCHIVED' ELSE 'ACTIVE' END AS status FROM kdoc GROUP BY tenant_id, space_id""",
    "num": "SELECT tenant_id, space_id, CAST(regexp_extract(space_id, '([0-9]+)', 1) AS INTEGER) AS n FROM space",
    "acl": """SELECT tenant_id, space_id, 'ROLE' AS subject_type, 'role-' || (n % 3) AS subject_id, 'READ' AS permission FROM num
        UNION ALL SELECT tenant_id, space_id, 'USER', 'user-' || (n % 7), 'WRITE' FROM num
        UNION ALL SELECT tenant_id, space_id, 'TENANT', tenant_id, 'READ' FROM num WHERE n % 5 = 0""",
    "prin": """SELECT query_id, tenant_id, principal_id, CASE WHEN query_id % 11 = 3 THEN 'SUSPENDED' ELSE 'ACTIVE' END AS status,
        'role-' || (query_id % 3) AS role_id, query_id % 10 = 9 AS is_system FROM q""",
    "scope": """SELECT DISTINCT p.query_id, p.tenant_id, s.space_id FROM prin p JOIN space s ON s.tenant_id = p.tenant_id AND s.status = 'ACTIVE'
        LEFT JOIN acl a ON a.tenant_id = s.tenant_id AND a.space_id = s.space_id
        WHERE p.is_system OR (p.status = 'ACTIVE' AND ((a.subject_type = 'USER' AND a.subject_id = p.principal_id)
            OR (a.subject_type = 'ROLE' AND a.subject_id = p.role_id) OR (a.subject_type = 'TENANT' AND a.subject_id = p.tenant_id)))""",
    "kw": """SELECT * FROM (SELECT query_id, chunk_id, tenant_id, space_id, document_id, revision_id, content, raw_score,
            row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, chunk_id) AS rank, candidate_limit,
            least(raw_score, 0.999999) AS score FROM (
        SELECT q.query_id, q.candidate_limit, c.*, greatest(CASE WHEN contains(lower(c.content), lower(q.normalised)) THEN 0.75::DOUBLE ELSE 0 END,
            CASE WHEN contains(lower(h.title), lower(q.normalised)) THEN 0.95::DOUBLE ELSE 0 END) AS raw_score
        FROM q JOIN scope s ON s.query_id = q.query_id AND s.tenant_id = q.tenant_id
        JOIN chunk c ON c.tenant_id = s.tenant_id AND c.space_id = s.space_id
        JOIN head h ON h.revision_id = c.revision_id AND h.status = 'ACTIVE') WHERE raw_score > 0) WHERE rank <= candidate_limit""",
    "live": "SELECT c.*, h.title, h.authority, h.source_uri, h.source_type FROM chunk c JOIN head h ON h.revision_id = c.revision_id AND h.status = 'ACTIVE'",
    # signed counts of tokens by the first hex digits of their md5; those of a query by the whole bits of n / df
    "word": f"SELECT chunk_id, tenant_id, space_id, unnest({tokens('content')}) AS word FROM live",
    "cvec": "SELECT chunk_id, tenant_id, space_id, dim, x, sum(x * x) OVER (PARTITION BY chunk_id) AS norm FROM (SELECT chunk_id, tenant_id, space_id, substr(md5(word), 1, 2) AS dim, sum(CASE WHEN substr(md5(word), 3, 1) < '8' THEN 1 ELSE -1 END) AS x FROM word GROUP BY ALL)",
    "qvec": f"""SELECT query_id, dim, x, sum(x * x) OVER (PARTITION BY query_id) AS norm FROM (SELECT query_id, substr(md5(w.word), 1, 2) AS dim,
        sum(CASE WHEN substr(md5(w.word), 3, 1) < '8' THEN 1 ELSE -1 END * length(bin(((SELECT count(*) FROM live) // coalesce(d.df, 1))::BIGINT))) AS x
        FROM (SELECT query_id, unnest({tokens('normalised')}) AS word FROM q) w LEFT JOIN (SELECT word, count(DISTINCT chunk_id) AS df FROM word GROUP BY word) d ON d.word = w.word GROUP BY ALL)""",
    # pairs that share no dimension have a dot product of 0 and count as well
    "vtext": """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, chunk_id) AS rank FROM (SELECT p.query_id, p.chunk_id, round(coalesce(dot, 0)::DOUBLE / sqrt((p.qn * p.cn)::DOUBLE), 9) AS raw
        FROM (SELECT s.query_id, c.chunk_id, q.norm AS qn, c.norm AS cn FROM scope s JOIN (SELECT DISTINCT query_id, norm FROM qvec WHERE norm > 0) q ON q.query_id = s.query_id
            JOIN (SELECT DISTINCT chunk_id, tenant_id, space_id, norm FROM cvec WHERE norm > 0) c ON c.tenant_id = s.tenant_id AND c.space_id = s.space_id) p
        LEFT JOIN (SELECT q.query_id, c.chunk_id, sum(q.x * c.x) AS dot FROM qvec q JOIN cvec c ON c.dim = q.dim GROUP BY ALL) d ON d.query_id = p.query_id AND d.chunk_id = p.chunk_id)""",
    "both": """SELECT query_id, chunk_id, tenant_id, space_id, document_id, revision_id, rank, score, 'KEYWORD' AS channel FROM kw
        UNION ALL SELECT v.query_id, v.chunk_id, c.tenant_id, c.space_id, c.document_id, c.revision_id, rank, least(1.0, greatest(0.0, raw)) AS score, 'VECTOR' FROM vtext v JOIN live c ON c.chunk_id = v.chunk_id WHERE rank <= 40 {novector}""",
    "fused": """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, substr(chunk_id, 1, 1) >= '8' DESC, chunk_id) AS position FROM (
        SELECT *, rrf / max(rrf) OVER (PARTITION BY query_id) * score AS relevance FROM (
            SELECT query_id, chunk_id, any_value(document_id) AS document_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf,
                string_agg(channel, ',' ORDER BY channel) AS channels, max(score) AS score FROM both_ GROUP BY query_id, chunk_id))""",
    "evid": f"""SELECT f.*, {uuid3("f.query_id || ':' || f.chunk_id")} AS evidence_id, h.authority FROM fused f JOIN head h ON h.document_id = f.document_id WHERE position <= 8""",
    "tenant_hits": """SELECT * FROM (SELECT query_id, chunk_id, tenant_id, space_id, document_id, revision_id,
            row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS rank FROM (
        SELECT q.query_id, c.* FROM q JOIN chunk c ON c.tenant_id = q.tenant_id WHERE contains(lower(c.content), lower(q.normalised)))) WHERE rank <= 40""",
    "vec": """SELECT v.vec_id, v.label, v.embedding::DOUBLE[] AS embedding, c.chunk_id, c.tenant_id, c.space_id, c.document_id FROM (
            SELECT vec_id, label, embedding, vec_id % (SELECT count(*) FROM documents) AS doc_id, vec_id // (SELECT count(*) FROM documents) AS ordinal FROM embeddings) v
        JOIN chunk c ON c.doc_id = v.doc_id AND c.ordinal = v.ordinal JOIN head h ON h.revision_id = c.revision_id""",
    "vtop": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, chunk_id) AS rank FROM (
        SELECT a.vec_id AS query_id, b.vec_id, b.chunk_id, list_cosine_similarity(b.embedding, a.embedding) AS raw FROM vec a
        JOIN vec b ON b.tenant_id = a.tenant_id AND b.space_id = a.space_id AND b.vec_id <> a.vec_id WHERE a.vec_id % 20 = 0 {more})) WHERE rank <= 10""",
    "job": """SELECT * EXCLUDE (place) FROM (SELECT e.event_id AS job_id, h.tenant_id, h.document_id, h.revision_id, h.status AS document_status,
            CASE WHEN user_id % 2 = 0 THEN 'KEYWORD' ELSE 'VECTOR' END AS projection_type,
            CASE event_type WHEN 'view' THEN 'PENDING' WHEN 'click' THEN 'RUNNING' WHEN 'error' THEN 'RETRY' WHEN 'purchase' THEN 'SUCCEEDED' WHEN 'signup' THEN 'DEAD' END AS status,
            event_id % 6 AS attempts, ts AS available_at, ts AS created_at, CASE event_type WHEN 'click' THEN ts + INTERVAL 2 MINUTE END AS lease_until,
            row_number() OVER (PARTITION BY h.revision_id, user_id % 2 = 0 ORDER BY ts DESC, event_id DESC) AS place
        FROM events e JOIN head h ON h.doc_id = e.event_id % (SELECT count(*) FROM documents)) WHERE place = 1""",
    "run": """SELECT o_orderkey AS run_id, o_custkey AS connector_id, o_orderdate AS started_at,
        CASE o_orderstatus WHEN 'O' THEN 'RUNNING' WHEN 'F' THEN 'SUCCEEDED' WHEN 'P' THEN 'FAILED' END AS status FROM orders""",
    "want": "SELECT revision_id, projection_type FROM head, (VALUES ('KEYWORD'), ('VECTOR')) t(projection_type) WHERE status = 'ACTIVE'",
    "ebase": """SELECT a.vec_id AS query_id, count(*) FILTER (WHERE b.label = a.label) AS expected FROM vec a JOIN vec b ON b.tenant_id = a.tenant_id AND b.space_id = a.space_id
        AND b.vec_id <> a.vec_id WHERE a.vec_id % 20 = 0 GROUP BY a.vec_id HAVING expected > 0""",
    "case_": """SELECT e.query_id, count(v.rank) > 0 AS hit, count(v.rank)::DOUBLE / any_value(expected) AS recall, coalesce(1.0::DOUBLE / min(v.rank), 0) AS reciprocal_rank,
            least(1.0::DOUBLE, coalesce(sum(1.0::DOUBLE / log2(v.rank + 1.0::DOUBLE)), 0) / (SELECT sum(1.0::DOUBLE / log2(i + 1.0::DOUBLE)) FROM range(1, least(any_value(expected), 5) + 1) r(i))) AS ndcg
        FROM ebase e LEFT JOIN (SELECT t.query_id, t.rank FROM vtop t JOIN vec b ON b.vec_id = t.vec_id JOIN vec a ON a.vec_id = t.query_id WHERE a.label = b.label AND rank <= 5) v
        ON v.query_id = e.query_id GROUP BY e.query_id""",
}
NEEDS = {
    "rev": ["kdoc"], "head": ["rev"], "chunk": ["rev"], "space": ["kdoc"], "num": ["space"], "acl": ["num"], "prin": ["q"],
    "scope": ["prin", "acl"], "kw": ["scope", "chunk", "head"], "both": ["kw", "vtext"], "live": ["chunk", "head"], "word": ["live"], "cvec": ["word"], "qvec": ["word", "q"], "vtext": ["cvec", "qvec", "scope"], "fused": ["both"], "evid": ["fused"],
    "tenant_hits": ["q", "chunk"], "vec": ["chunk", "head"], "vtop": ["vec"], "job": ["head"], "want": ["head"], "ebase": ["vec"], "case_": ["ebase", "vtop"],
}


def sql(select: str, *parts: str, more: str = "", novector: str = "", over: dict[str, str] | None = None) -> str:
    """A statement with the named parts, and those they need, as common table expressions; over wraps parts."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for p in parts:
        add(p)
    named = {"both": "both_"}
    body = ", ".join(f"{named.get(n, n)} AS MATERIALIZED ({(over or {}).get(n, '{}').replace('{}', PARTS[n].replace('{more}', more).replace('{novector}', novector))})" for n in order)
    return (f"WITH {body} " if body else "") + select


def bm25(index: str, stats: str, key: str) -> str:
    """Scores by query_id and key over index(key, term, tf, length) and stats(n, mean_length)."""
    return f"""SELECT t.query_id, i.{key}, sum(ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * i.tf * 2.2 / (i.tf + 1.2 * (0.25 + 0.75 * i.length / s.mean_length))) AS raw_score
        FROM terms t JOIN {index} i ON i.term = t.term JOIN (SELECT term, count(*)::DOUBLE AS df FROM {index} GROUP BY term) d ON d.term = t.term, {stats} s GROUP BY t.query_id, i.{key}"""


def index_of(source: str, text: str, key: str) -> str:
    return f"SELECT {key}, term, count(*)::DOUBLE AS tf, any_value(length)::DOUBLE AS length FROM (SELECT {key}, len({tokens(text)}) AS length, unnest({tokens(text)}) AS term FROM {source}) GROUP BY {key}, term"


def stats_of(source: str, text: str) -> str:
    return f"SELECT count(*)::DOUBLE AS n, avg(len({tokens(text)})) AS mean_length FROM {source}"


CJK_CLASS = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}"


def analysed(text: str) -> str:
    """tokens() with runs of CJK_CLASS as overlapping pairs."""
    return rf"""flatten(list_transform(list_filter(regexp_split_to_array(regexp_replace(lower({text}), '([{CJK_CLASS}]+)', ' \1 ', 'g'), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> ''),
        lambda t: CASE WHEN regexp_matches(t, '^[{CJK_CLASS}]') AND length(t) > 1 THEN list_transform(range(1, length(t)), lambda i: substr(t, i, 2)) ELSE [t] END))"""


CJK_LINES = """SELECT doc_id, tenant_id, ordinal, doc_id || ':' || ordinal AS chunk_id, translate(lower(line), 'aeioustn', '依赖关かカ한系调') AS content
    FROM (SELECT doc_id, 'tenant-' || lang AS tenant_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ordinal FROM documents)"""
SEARCHES = rf"""SELECT query_id, trim(regexp_replace(CASE query_id % 6 WHEN 0 THEN w0 || ' ' || w1 WHEN 1 THEN w0 || ' OR ' || w1 WHEN 2 THEN w0 || ' -' || w1 WHEN 3 THEN w0 || ' ' || w1 || ' or ' || w2
    WHEN 4 THEN '"' || w1 || ' ' || w2 || '"' ELSE '"' || w0 || ' ' || w1 || '" ' || w3 || ' or -"' || w4 || ' ' || w5 || '" ' || w6 END, '\s+', ' ', 'g')) AS text
    FROM (SELECT item_id AS query_id, {", ".join(f"coalesce(w[{i + 1}], '') AS w{i}" for i in range(7))} FROM (SELECT item_id, {tokens('text')} AS w FROM benchmark))"""
SEARCH_PARTS = rf"""SELECT query_id, len(list_filter(raw[1:i], lambda p: lower(p) = 'or')) AS grp, i AS item, starts_with(p, '-') AS excluded, {tokens('p')} AS words
    FROM (SELECT query_id, raw, unnest(raw) AS p, generate_subscripts(raw, 1) - 1 AS i FROM (SELECT query_id, regexp_extract_all(text, '(-?"[^"]*"?|[^\s"]+)', 1) AS raw FROM ({SEARCHES})))
    WHERE lower(p) <> 'or' AND len({tokens('p')}) > 0"""
TERMS = f"SELECT DISTINCT query_id, unnest({tokens('normalised')}) AS term FROM q"
REACH = "JOIN chunk c ON c.chunk_id = x.chunk_id JOIN scope s ON s.query_id = x.query_id AND s.tenant_id = c.tenant_id AND s.space_id = c.space_id"
TOP10 = "row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, {key}) AS rank"

ORACLES = {
    "documents_active": sql("SELECT document_id, tenant_id, space_id, title, authority::BIGINT AS authority, language, source_uri, content_hash FROM head WHERE status = 'ACTIVE'", "head"),
    "chunks_lines": sql("SELECT chunk_id, document_id, revision_id, ordinal::BIGINT AS ordinal, content_hash FROM chunk", "chunk"),
    "source_uri_policy": r"SELECT page_id, coalesce(regexp_matches(url, '^[hH][tT][tT][pP][sS]?://[^/?#@\s]+([/?#]\S*)?$'), false) AS allowed FROM pages",
    "language_tag": "SELECT doc_id, lower(lang) || CASE WHEN doc_id % 2 = 0 THEN '-AT' ELSE '' END AS language FROM documents",
    "query_plan": sql(f"SELECT query_id, normalised, regexp_matches(lower(normalised), '{MARKERS}') AS relational, 40::BIGINT AS candidate_limit, 0::BIGINT AS n_errors FROM q", "q"),
    "acl_scope": sql("SELECT query_id, tenant_id, space_id FROM scope", "scope"),
    "accessible_spaces": sql("SELECT s.query_id, s.space_id, 'Space ' || s.space_id AS name, (SELECT count(*) FROM kdoc k WHERE k.tenant_id = s.tenant_id AND k.space_id = s.space_id AND k.status = 'ACTIVE') AS active_documents FROM scope s", "scope", "kdoc"),
    "keyword_substring_topk": sql("SELECT query_id, chunk_id, rank, score FROM kw", "kw"),
    "keyword_websearch_topk": sql(
        f"""SELECT query_id, chunk_id, rank, least(raw_score, 0.999999) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, chunk_id) AS rank FROM (
        WITH part AS ({SEARCH_PARTS}),
        able AS (SELECT * FROM part p WHERE EXISTS (SELECT 1 FROM part o WHERE o.query_id = p.query_id AND o.grp = p.grp AND NOT o.excluded)),
        asked AS (SELECT query_id, grp, item, excluded, len(words) AS n, unnest(words) AS term, generate_subscripts(words, 1) AS off FROM able),
        place AS (SELECT chunk_id, tenant_id, space_id, unnest(t) AS term, generate_subscripts(t, 1) AS place FROM (SELECT chunk_id, tenant_id, space_id, {tokens('content')} AS t FROM live)),
        met AS (SELECT a.query_id, grp, item, excluded, p.chunk_id, place - off AS start FROM place p JOIN asked a ON a.term = p.term JOIN scope s ON s.query_id = a.query_id AND s.tenant_id = p.tenant_id AND s.space_id = p.space_id
            GROUP BY ALL HAVING count(*) = any_value(n)),
        need AS (SELECT query_id, grp, count(DISTINCT item) AS needed FROM able WHERE NOT excluded GROUP BY query_id, grp),
        ok AS (SELECT m.query_id, m.grp, m.chunk_id, any_value(needed) AS needed FROM met m JOIN need n ON n.query_id = m.query_id AND n.grp = m.grp GROUP BY m.query_id, m.grp, m.chunk_id
            HAVING count(DISTINCT CASE WHEN NOT excluded THEN item END) = any_value(needed) AND NOT bool_or(excluded)),
        own AS (SELECT m.*, o.needed FROM met m JOIN ok o ON o.query_id = m.query_id AND o.grp = m.grp AND o.chunk_id = m.chunk_id WHERE NOT excluded),
        pair AS (SELECT *, lag(item) OVER w AS prev, lag(start) OVER w AS prev_start FROM own WINDOW w AS (PARTITION BY query_id, grp, chunk_id ORDER BY start, item::VARCHAR)),
        dens AS (SELECT query_id, chunk_id, sum(CASE needed WHEN 1 THEN 0.1::DOUBLE ELSE 0.1::DOUBLE / (1 + greatest(0, start - prev_start - 1)) END) AS density FROM pair WHERE needed = 1 OR prev <> item GROUP BY query_id, chunk_id),
        lit AS (SELECT a.query_id, c.chunk_id, CASE WHEN contains(lower(title), lower(a.text)) THEN 0.95::DOUBLE ELSE 0.75 END AS literal FROM ({SEARCHES}) a JOIN scope s ON s.query_id = a.query_id
            JOIN live c ON c.tenant_id = s.tenant_id AND c.space_id = s.space_id WHERE contains(lower(content), lower(a.text)) OR contains(lower(title), lower(a.text)))
        SELECT coalesce(l.query_id, d.query_id) AS query_id, coalesce(l.chunk_id, d.chunk_id) AS chunk_id, round(greatest(coalesce(density, 0), coalesce(literal, 0)), 9) AS raw_score
        FROM lit l FULL JOIN dens d ON d.query_id = l.query_id AND d.chunk_id = l.chunk_id)) WHERE rank <= 40""",
        "live", "scope",
    ),
    "search_syntax": f"SELECT query_id, grp::BIGINT AS grp, item::BIGINT AS item, excluded, array_to_string(words, ' ') AS words FROM ({SEARCH_PARTS})",
    "cjk_tokens": f"SELECT doc_id, ordinal, len(t)::BIGINT AS n_terms, sha256(array_to_string(t, ' ')) AS terms_sha256 FROM (SELECT *, {analysed('content')} AS t FROM ({CJK_LINES}))",
    "cjk_bm25_topk": f"""SELECT query_id, chunk_id, rank, raw_score FROM (SELECT *, {TOP10.format(key='chunk_id')} FROM (SELECT query_id, chunk_id, round(raw_score, 9) AS raw_score FROM (
        WITH line AS MATERIALIZED (SELECT chunk_id, tenant_id, {analysed('content')} AS t FROM ({CJK_LINES})), terms AS (SELECT DISTINCT query_id, tenant_id, unnest({analysed('a')}) AS term FROM (SELECT item_id AS query_id, 'tenant-' || (['en','de','es','fr'])[(item_id % 2) * (item_id % 4) + 1] AS tenant_id,
            translate(substr(lower(array_to_string(list_slice(string_split(text, ' '), 1, 2), ' ')), 2, 3), 'aeioustn', '依赖关かカ한系调') AS a FROM benchmark)),
        ix AS MATERIALIZED (SELECT chunk_id, any_value(tenant_id) AS tenant_id, term, count(*)::DOUBLE AS tf, any_value(length)::DOUBLE AS length FROM (SELECT chunk_id, tenant_id, len(t) AS length, unnest(t) AS term FROM line) GROUP BY chunk_id, term),
        st AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS mean_length FROM line)
        SELECT t.query_id, i.chunk_id, sum(ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * i.tf * 2.2 / (i.tf + 1.2 * (0.25 + 0.75 * i.length / s.mean_length))) AS raw_score
        FROM terms t JOIN ix i ON i.term = t.term AND i.tenant_id = t.tenant_id JOIN (SELECT term, count(*)::DOUBLE AS df FROM ix GROUP BY term) d ON d.term = t.term, st s GROUP BY t.query_id, i.chunk_id))) WHERE rank <= 20""",
    "bm25_topk": sql(
        f"""SELECT b.query_id, b.chunk_id, b.rank, b.raw_score FROM (SELECT *, {TOP10.format(key='chunk_id')} FROM (SELECT x.query_id, x.chunk_id, c.revision_id, round(raw_score, 9) AS raw_score FROM (
        WITH terms AS ({TERMS}), ix AS ({index_of('chunk', 'content', 'chunk_id')}), st AS ({stats_of('chunk', 'content')}) {bm25('ix', 'st', 'chunk_id')}) x {REACH})) b
        JOIN head h ON h.revision_id = b.revision_id AND h.status = 'ACTIVE' WHERE rank <= 40""",
        "q", "chunk", "scope", "head",
    ),
    "bm25_best_fields_topk": sql(
        f"""SELECT b.query_id, b.chunk_id, b.rank, round(least(raw_score / top, 0.999999), 9) AS score FROM (SELECT *, max(raw_score) OVER (PARTITION BY query_id) AS top FROM (SELECT *, {TOP10.format(key='chunk_id')} FROM (
        SELECT x.query_id, x.chunk_id, any_value(c.revision_id) AS revision_id, round(max(raw_score), 9) AS raw_score FROM (WITH rows_ AS (SELECT c.*, k.title FROM chunk c JOIN kdoc k ON k.document_id = c.document_id), terms AS ({TERMS}),
            ti AS ({index_of('rows_', 'title', 'chunk_id')}), ts AS ({stats_of('rows_', 'title')}), si AS ({index_of('rows_', 'section_path', 'chunk_id')}), ss AS ({stats_of('rows_', 'section_path')}),
            bi AS ({index_of('rows_', 'content', 'chunk_id')}), bs AS ({stats_of('rows_', 'content')})
            SELECT query_id, chunk_id, 3 * raw_score AS raw_score FROM ({bm25('ti', 'ts', 'chunk_id')}) UNION ALL SELECT query_id, chunk_id, 2 * raw_score FROM ({bm25('si', 'ss', 'chunk_id')}) UNION ALL {bm25('bi', 'bs', 'chunk_id')}) x {REACH} GROUP BY x.query_id, x.chunk_id)) WHERE rank <= 40) b
        JOIN head h ON h.revision_id = b.revision_id AND h.status = 'ACTIVE'""",
        "q", "chunk", "scope", "head",
    ),
    "vector_cosine_topk": sql("SELECT query_id, vec_id, rank, round(least(1.0, greatest(0.0, raw)), 9) AS score FROM vtop", "vtop"),
    "vector_filtered_topk": sql("SELECT query_id, vec_id, rank, round(least(1.0, greatest(0.0, raw)), 9) AS score FROM vtop", "vtop", more="AND b.document_id IN (SELECT document_id FROM kdoc WHERE doc_id % 2 = 0)"),
    "vector_filter_rejected": "SELECT item_id AS query_id, CASE WHEN item_id % 4 = 0 THEN 'FAILED' ELSE 'OK' END AS status, CASE WHEN item_id % 4 = 0 THEN 'RETRIEVER_VECTOR_UNAVAILABLE' END AS warning FROM benchmark",
    "active_guard": sql("SELECT t.query_id, t.chunk_id, t.rank FROM tenant_hits t JOIN head h ON h.revision_id = t.revision_id AND h.status = 'ACTIVE'", "tenant_hits", "head"),
    "rrf_fusion": sql("SELECT query_id, chunk_id, position, round(rrf, 9) AS rrf, channels, round(relevance, 9) AS relevance FROM fused WHERE position <= 8", "fused"),
    "rrf_ties_signed_uuid": sql("SELECT query_id, chunk_id, position FROM (SELECT c.doc_id AS query_id, c.chunk_id, row_number() OVER (PARTITION BY c.doc_id ORDER BY substr(chunk_id, 1, 1) >= '8' DESC, chunk_id) AS position FROM chunk c JOIN head h ON h.revision_id = c.revision_id) WHERE position <= 8", "chunk", "head"),
    "evidence_bundle": sql("SELECT query_id, count(*) AS n_evidence, string_agg(evidence_id, ',' ORDER BY position) AS evidence_ids, round(arg_min(relevance, position), 9) AS best_relevance, arg_min(authority, position)::BIGINT AS best_authority, arg_min(relevance, position) >= 0.5 AS sufficient FROM evid GROUP BY query_id", "evid"),
    "scope_violations": sql("SELECT t.query_id, t.chunk_id FROM tenant_hits t ANTI JOIN scope s ON s.query_id = t.query_id AND s.tenant_id = t.tenant_id AND s.space_id = t.space_id", "tenant_hits", "scope"),
    "vector_text_topk": sql("SELECT query_id, chunk_id, rank, least(1.0, greatest(0.0, raw)) AS score FROM vtext WHERE rank <= 40", "vtext"),
    "keyword_filtered_topk": sql(
        """SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, chunk_id) AS rank, least(raw_score, 0.999999) AS score FROM (
        SELECT q.query_id, c.chunk_id, CASE WHEN contains(lower(title), lower(normalised)) THEN 0.95::DOUBLE ELSE 0.75 END AS raw_score FROM q JOIN scope s ON s.query_id = q.query_id
        JOIN live c ON c.tenant_id = s.tenant_id AND c.space_id = s.space_id WHERE (contains(lower(title), lower(normalised)) OR contains(lower(content), lower(normalised)))
        AND (q.query_id % 4 NOT IN (0, 2) OR language = 'en') AND (q.query_id % 4 NOT IN (1, 2) OR source_type = 'OBSIDIAN')) QUALIFY rank <= 40""",
        "live", "scope",
    ),
    "channel_status_warnings": sql(
        """SELECT query_id, channel, status, CASE WHEN status <> 'OK' THEN 'RETRIEVER_' || channel || '_UNAVAILABLE' END AS warning FROM (
        SELECT query_id, channel, CASE WHEN channel = 'GRAPH' THEN 'NOT_CONFIGURED' WHEN channel = 'VECTOR' AND query_id % 4 <> 3 THEN 'FAILED' ELSE 'OK' END AS status
        FROM (SELECT DISTINCT query_id FROM scope), (VALUES ('KEYWORD'), ('VECTOR'), ('GRAPH')) c(channel))""",
        "scope",
    ),
    "trace_steps": sql(
        """SELECT q.query_id, s.ordinal::BIGINT AS ordinal, s.step_name, CASE s.ordinal WHEN 0 THEN (SELECT count(*) FROM scope x WHERE x.query_id = q.query_id) WHEN 1 THEN 1
        WHEN 2 THEN (SELECT count(*) FROM both_ x WHERE x.query_id = q.query_id AND channel = 'KEYWORD') WHEN 3 THEN (SELECT count(*) FROM both_ x WHERE x.query_id = q.query_id AND channel = 'VECTOR')
        WHEN 4 THEN (SELECT count(*) FROM both_ x WHERE x.query_id = q.query_id) ELSE (SELECT count(*) FROM fused x WHERE x.query_id = q.query_id AND position <= 8) END AS output_count, 'OK' AS status
        FROM q, (VALUES (0, 'ACCESS'), (1, 'PLAN'), (2, 'KEYWORD'), (3, 'VECTOR'), (4, 'GUARD'), (5, 'FUSE'), (6, 'EVIDENCE')) s(ordinal, step_name)""",
        "scope", "fused",
    ),
    "retrieval_traces": sql(
        """SELECT query_id, tenant_id, principal_id, CASE WHEN query_id IN (SELECT query_id FROM scope) THEN 'OK' ELSE 'DENY_ALL' END AS outcome, sha256(normalised) AS query_hash,
        (SELECT count(*) FROM evid e WHERE e.query_id = q.query_id) AS result_count FROM q""",
        "scope", "evid",
    ),
    "eval_case_metrics": sql("SELECT query_id, hit, round(recall, 9) AS recall, round(reciprocal_rank, 9) AS reciprocal_rank, round(ndcg, 9) AS ndcg FROM case_", "case_"),
    "eval_macro_report": sql("SELECT count(*) AS cases, count(*) FILTER (WHERE c.query_id IS NULL) AS failed, round(avg(coalesce(hit::INT::DOUBLE, 0)), 9) AS hit_rate, round(avg(coalesce(recall, 0)), 9) AS recall, round(avg(coalesce(reciprocal_rank, 0)), 9) AS mrr, round(avg(coalesce(ndcg, 0)), 9) AS ndcg FROM (SELECT vec_id FROM vec WHERE vec_id % 20 = 0) v LEFT JOIN case_ c ON c.query_id = v.vec_id", "case_"),
    "eval_datasets": "SELECT n_nationkey::BIGINT AS dataset_id, n_name AS name, count(DISTINCT c_custkey) AS case_count, count(DISTINCT o_orderkey) AS run_count FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_nationkey, n_name",
    "admin_overview": sql("SELECT k.tenant_id, (SELECT count(*) FROM space s WHERE s.tenant_id = k.tenant_id) AS spaces, count(*) FILTER (WHERE status = 'ACTIVE') AS documents, (SELECT count(*) FROM chunk c WHERE c.tenant_id = k.tenant_id) AS chunks, count(DISTINCT connector_id) AS connectors, (SELECT count(*) FROM job j WHERE j.tenant_id = k.tenant_id AND j.status IN ('PENDING', 'RETRY', 'RUNNING')) AS open_jobs, (SELECT count(*) FROM job j WHERE j.tenant_id = k.tenant_id AND j.status = 'DEAD') AS dead_jobs, (SELECT count(*) FROM nation WHERE 'tenant-' || (['en','de','es','fr'])[n_nationkey % 4 + 1] = k.tenant_id) AS datasets, (SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE 'tenant-' || (['en','de','es','fr'])[c_nationkey % 4 + 1] = k.tenant_id) AS runs FROM kdoc k GROUP BY k.tenant_id", "chunk", "job", "space"),
    "admin_documents_pages": sql("""SELECT request_id::BIGINT AS request_id, place, total, document_id FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY doc_id DESC, document_id) AS place, count(*) OVER (PARTITION BY request_id) AS total FROM (
        SELECT n_nationkey AS request_id, document_id, doc_id, greatest(1, least(200, n_nationkey * 37 % 300 - 20)) AS n, greatest(0, n_nationkey * 3 - 15) AS first FROM nation JOIN kdoc k ON k.tenant_id = 'tenant-' || (['en','de','es','fr'])[n_nationkey % 4 + 1]
        AND (n_nationkey % 3 <> 0 OR k.space_id = 'src' || n_nationkey % 20) AND (n_nationkey % 5 > 1 OR k.status = (['ACTIVE','ARCHIVED'])[n_nationkey % 5 + 1]))) WHERE place > first AND place <= first + n""", "kdoc"),
    "admin_spaces": sql("SELECT s.tenant_id, s.space_id, s.name, s.status, (SELECT count(*) FROM kdoc k WHERE k.tenant_id = s.tenant_id AND k.space_id = s.space_id) AS document_count FROM space s", "space", "kdoc"),
    "admin_documents_page": sql("SELECT h.document_id, h.space_id, h.title, h.status, (SELECT count(*) FROM chunk c WHERE c.revision_id = h.revision_id) AS chunk_count, coalesce((SELECT j.status FROM job j WHERE j.revision_id = h.revision_id AND j.projection_type = 'KEYWORD'), 'SKIPPED') AS keyword_status, (SELECT count(*) FROM head WHERE tenant_id = 'tenant-en') AS total FROM (SELECT * FROM head WHERE tenant_id = 'tenant-en' ORDER BY doc_id DESC, document_id LIMIT 50 OFFSET 50) h", "head", "chunk", "job"),
    "admin_connectors_last_run": sql("SELECT c_custkey AS connector_id, c_name AS name, r.run_id AS last_run, r.status AS last_status FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY connector_id ORDER BY started_at DESC, run_id DESC) AS place FROM run) r ON r.connector_id = c_custkey AND r.place = 1", "run"),
    "admin_traces": "SELECT event_id, user_id, round(value, 2) AS duration FROM events ORDER BY ts DESC, event_id LIMIT 200",
    "trace_mean_latency": "SELECT event_type, coalesce(round(avg(value), 6), 0.0::DOUBLE) AS mean_duration, count(*) AS traces FROM events GROUP BY event_type",
    "document_chunks": sql("SELECT c.document_id, c.chunk_id, c.ordinal::BIGINT AS ordinal, c.content FROM chunk c JOIN head h ON h.revision_id = c.revision_id AND h.status = 'ACTIVE'", "chunk", "head"),
    "space_grants": sql("SELECT tenant_id, space_id, subject_type, subject_id, permission FROM acl", "acl"),
    "job_states": sql("SELECT document_id, projection_type, status, attempts::BIGINT AS attempts FROM job WHERE document_status = 'ACTIVE'", "job"),
    "revision_actions": sql(
        """SELECT document_id, content_hash, action, revision_number FROM (SELECT h.document_id,
        CASE h.doc_id % 4 WHEN 2 THEN (SELECT content_hash FROM rev r WHERE r.document_id = h.document_id AND r.revision_number = 1) WHEN 3 THEN sha256(h.content || '!') ELSE h.content_hash END AS content_hash,
        CASE h.doc_id % 4 WHEN 0 THEN 'NONE' WHEN 1 THEN 'METADATA' WHEN 2 THEN CASE WHEN h.active_revision = 2 THEN 'REACTIVATE' ELSE 'NONE' END ELSE 'CREATE' END AS action,
        CASE h.doc_id % 4 WHEN 2 THEN 1 WHEN 3 THEN h.active_revision + 1 ELSE h.active_revision END::BIGINT AS revision_number FROM head h)""",
        "head", "rev",
    ),
    "document_upsert": """SELECT c_custkey AS id, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 2 = 0 THEN c_name || '+' ELSE c_name END AS name, c_mktsegment AS segment,
        CASE WHEN c_custkey % 3 = 0 THEN 50 WHEN c_custkey % 5 <> 0 AND c_custkey % 2 = 0 THEN greatest(c_custkey % 100, 50) ELSE c_custkey % 100 END::BIGINT AS updated_at,
        CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS version FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 5 <> 0""",
    "next_revision_number": sql("SELECT document_id, draft, (active_revision + n)::BIGINT AS revision_number FROM kdoc, (VALUES ('a', 1), ('b', 2)) d(draft, n) WHERE doc_id % 3 = 0", "kdoc"),
    "job_claim": sql("SELECT job_id, (attempts + 1)::BIGINT AS attempts FROM (SELECT * FROM job WHERE (status IN ('PENDING', 'RETRY') AND available_at <= TIMESTAMP '2024-01-15 00:00:00') OR (status = 'RUNNING' AND lease_until < TIMESTAMP '2024-01-15 00:00:00') ORDER BY available_at, created_at, job_id LIMIT 20)", "job"),
    "job_fail_backoff": sql("SELECT job_id, CASE WHEN attempts >= 5 THEN 'DEAD' ELSE 'RETRY' END AS status, CASE WHEN attempts < 5 THEN least(300000, 2000 * pow(2, greatest(attempts - 1, 0)))::BIGINT END AS delay_ms FROM job WHERE status = 'RUNNING'", "job"),
    "job_requeue_dead": sql("SELECT job_id, CASE WHEN status = 'DEAD' AND document_status = 'ACTIVE' THEN 'RETRY' ELSE status END AS status, CASE WHEN status = 'DEAD' AND document_status = 'ACTIVE' THEN 0 ELSE attempts END::BIGINT AS attempts FROM job", "job"),
    "generation_fingerprint": sql(f"SELECT tenant_id, space_id, sha256(c) AS contract_hash, {uuid3('c')} AS generation_id FROM (SELECT tenant_id, space_id, concat_ws(chr(31), 'hashing', 'v1', '64', 'COSINE', tenant_id, space_id) AS c FROM space)", "space"),
    "projection_status": sql("SELECT h.revision_id, coalesce(max(CASE WHEN projection_type = 'KEYWORD' THEN s END), 'SKIPPED') AS keyword_status, coalesce(max(CASE WHEN projection_type = 'VECTOR' THEN s END), 'SKIPPED') AS vector_status FROM head h LEFT JOIN (SELECT revision_id, projection_type, CASE status WHEN 'SUCCEEDED' THEN 'SUCCEEDED' WHEN 'DEAD' THEN 'FAILED' ELSE 'PENDING' END AS s FROM job) j ON j.revision_id = h.revision_id WHERE h.status = 'ACTIVE' GROUP BY h.revision_id", "job"),
    "single_flight_cancel": sql("SELECT run_id, CASE WHEN status = 'RUNNING' AND row_number() OVER (PARTITION BY connector_id, status ORDER BY started_at DESC, run_id DESC) > 1 THEN 'CANCELLED' ELSE status END AS status FROM run", "run"),
    "acl_grant_revoke": sql("SELECT DISTINCT tenant_id, space_id, subject_type, subject_id, permission FROM acl WHERE NOT (subject_type = 'ROLE' AND subject_id = 'role-1')", "acl"),
    "connector_configure": sql("SELECT s.tenant_id, s.space_id, 1::BIGINT AS version, CASE WHEN n % 2 = 0 THEN n ELSE 70 END::BIGINT AS authority FROM space s JOIN num m ON m.tenant_id = s.tenant_id AND m.space_id = s.space_id WHERE s.status = 'ACTIVE'", "num"),
    "legacy_space_repair": sql("SELECT j.job_id, k.space_id FROM job j JOIN kdoc k ON k.document_id = j.document_id", "job"),
    "constraint_violations": sql("SELECT 'document_key' AS name, (SELECT count(*) FROM (SELECT document_id FROM kdoc GROUP BY document_id HAVING count(*) > 1)) AS violations UNION ALL SELECT 'chunk_ordinal', (SELECT count(*) FROM (SELECT revision_id FROM chunk GROUP BY revision_id, ordinal HAVING count(*) > 1)) UNION ALL SELECT 'running_per_connector', (SELECT count(*) FROM (SELECT connector_id FROM run WHERE status = 'RUNNING' GROUP BY connector_id HAVING count(*) > 1)) UNION ALL SELECT 'order_customer', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) UNION ALL SELECT 'lineitem_order', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) UNION ALL SELECT 'lease_iff_running', (SELECT count(*) FROM job WHERE (status = 'RUNNING') <> (lease_until IS NOT NULL))", "chunk", "run", "job"),
    "signed_uuid_order": sql("SELECT chunk_id, row_number() OVER (PARTITION BY revision_id ORDER BY substr(chunk_id, 1, 1) >= '8' DESC, chunk_id) AS place FROM chunk", "chunk"),
}


def _requeued(resets: str, wanted: str) -> str:
    same = "w.revision_id = j.revision_id AND w.projection_type = j.projection_type"
    fresh = f"w.revision_id IS NOT NULL AND (j.status IS NULL OR {resets})"
    return f"""SELECT coalesce(j.revision_id, w.revision_id) AS revision_id, coalesce(j.projection_type, w.projection_type) AS projection_type,
        CASE WHEN {fresh} THEN 'PENDING' ELSE j.status END AS status, CASE WHEN {fresh} THEN 0 ELSE j.attempts END::BIGINT AS attempts,
        ({fresh}) AS requeued FROM job j FULL JOIN ({wanted}) w ON {same}"""


ORACLES["job_enqueue"] = sql(_requeued("j.status IN ('SUCCEEDED', 'DEAD')", "SELECT * FROM want"), "job", "want")
ORACLES["job_rebuild"] = sql(_requeued("j.status <> 'RUNNING'", "SELECT * FROM want WHERE revision_id IN (SELECT revision_id FROM chunk)"), "job", "want", "chunk")

W = [f"coalesce(w[{i}], 'x')" for i in (1, 2, 3, 4)]
FIRST = f"coalesce(({tokens('line')})[1], 'x')"
# the same notes, with patterns that need no lookbehind
NOTES = f"""(SELECT doc_id, w, '---' || chr(10) || 'title: "T ' || {W[0]} || '"' || chr(10) || 'tags: [#' || {W[1]} || ', z]' || chr(10) || '---' || chr(10) || '# Head' || chr(10) || 'see [[' || {W[2]} || '#part|alias]] and ![[' || {W[3]} || ']] #' || {W[0]} || '/sub ok' || chr(10) || body AS note
    FROM (SELECT doc_id, {tokens('text')} AS w, array_to_string(list_transform(string_split(text, chr(10)), lambda line: line || ' [[' || {FIRST} || ']] #' || {FIRST}), chr(10)) AS body FROM documents))"""
ORACLES["vault_links_tags"] = rf"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(note, '(?:^|[^!])\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]', 1), lambda x: trim(x)))), ',') AS wikilinks,
    array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(note, '!\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]', 1), lambda x: trim(x)))), ',') AS embeds,
    array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(note, '(?:^|[^\p{{L}}\p{{N}}_])#([\p{{L}}\p{{N}}_/-]+)', 1), [{W[1]}, 'z']))), ',') AS tags FROM {NOTES}"""
ORACLES["vault_frontmatter"] = f"SELECT doc_id, 'T ' || {W[0]} AS title, '[#' || {W[1]} || ', z]' AS raw_tags FROM {NOTES}"
ORACLES["outbox_stream"] = """SELECT job_id, status, attempts::BIGINT AS attempts, CASE WHEN status = 'RETRY' THEN (2000 * pow(2, attempts - 1))::BIGINT END AS delay_ms FROM (
    SELECT job_id, CASE WHEN first_ok <= 5 THEN 'SUCCEEDED' WHEN n >= 5 THEN 'DEAD' ELSE 'RETRY' END AS status, least(coalesce(first_ok, 5), 5, n) AS attempts FROM (
    SELECT user_id AS job_id, count(*) AS n, min(CASE WHEN event_type IN ('purchase', 'signup') THEN place END) AS first_ok FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events) GROUP BY user_id))"""
ELEMENTS = """SELECT doc_id::VARCHAR AS revision_id, 0 AS ordinal, 'HEADING' AS element_type, 'Doc ' || doc_id AS content, 'Doc ' || doc_id AS section_path FROM documents
    UNION ALL SELECT doc_id::VARCHAR, i, CASE (i - 1) % 4 WHEN 1 THEN 'LIST' WHEN 3 THEN 'CODE' ELSE 'PARAGRAPH' END, CASE WHEN (i - 1) % 4 = 1 THEN '- ' ELSE '' END || line, 'Doc ' || doc_id FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"""
