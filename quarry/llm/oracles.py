"""DuckDB SQL for the operator queries that SQL can express.

Scores of the trained models (op1, op2, op5), seeded segmentations (op4), fingerprints (op8), tilted
copies (op10) and a library's tokens (op12) are not SQL; tests/llm compares them with brute force, round trips and held-out labels.
"""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def closure(nodes: str, links: str) -> str:
    """CTEs reach(id, other) and root(id, component_id) of links(a, b) among nodes(id)."""
    return f"""sym AS (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}),
    reach(id, other) AS (SELECT a, b FROM sym UNION SELECT r.id, y.b FROM reach r JOIN sym y ON y.a = r.other),
    root AS (SELECT n.id, least(n.id, min(r.other)) AS component_id FROM {nodes} n LEFT JOIN reach r ON r.id = n.id GROUP BY n.id)"""


OP3 = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.label = b.label AND a.id < b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
{closure('v', 'links')}
SELECT id AS vec_id, (SELECT count(*) FROM links l WHERE l.a = root.id OR l.b = root.id) AS n_links, component_id, id = component_id AS kept FROM root"""

OP6 = rf"""WITH split AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (SELECT page_id, url, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM split),
named AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '') END AS canon FROM parts),
rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best AS (SELECT page_id, h || p AS rule, verdict AS said FROM named, rules
    WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, h || p, verdict) = 1)
SELECT n.page_id, host, path, rule, coalesce(said, CASE WHEN canon IN (SELECT canon FROM named WHERE contains(url, 'utm_source=') AND canon IS NOT NULL) THEN 'block' ELSE 'allow' END) AS verdict
FROM named n LEFT JOIN best b ON b.page_id = n.page_id"""

OP7 = """WITH lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
windows AS (SELECT doc_id, i AS pos, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] AS w FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM lines WHERE len(l) >= 3)),
later AS (SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS k FROM windows) WHERE k > 1),
gone AS (SELECT doc_id, list_sort(list(DISTINCT pos + o - 1)) AS removed FROM later, (VALUES (0), (1), (2)) t(o) GROUP BY doc_id)
SELECT d.doc_id, len(l)::BIGINT AS n_lines, coalesce(len(removed), 0)::BIGINT AS n_removed, coalesce(array_to_string(removed, ','), '') AS removed_positions,
    CASE WHEN removed IS NULL THEN text ELSE array_to_string(list_filter(l, lambda x, i: NOT list_contains(removed, i - 1)), chr(10)) END AS text
FROM lines d LEFT JOIN gone g ON g.doc_id = d.doc_id"""

OP9 = rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(text, '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT w.doc_id AS id, count(s.s) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id JOIN n x ON x.id = a.doc_id JOIN n y ON y.id = b.doc_id
    GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))),
{closure('n', 'links')}
SELECT r.id AS doc_id, n.n AS n_shingles, component_id, r.id = component_id AS kept FROM root r JOIN n ON n.id = r.id"""

OP11 = rf"""WITH docs AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text, row_number() OVER () AS r FROM documents),
terms AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM terms GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
n AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM terms t JOIN kept k ON k.lang = t.lang AND k.term = t.term GROUP BY ALL),
grps AS (SELECT DISTINCT lang, source FROM docs),
every AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n FROM grps g JOIN kept k ON k.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
shares AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p,
    1 + (1000000000::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM every JOIN v USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term GROUP BY ALL),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM grps a JOIN grps b ON b.lang = a.lang AND b.source <> a.source
    LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts) WHERE part = 'pair' OR rank <= 50"""

#: Bit by bit, the remainder that crc32 gives the text in k.
CRC = """(4294967295 - list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, 1 + length(k)), lambda i: ascii(substr(k, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))))"""

#: costs: the least cost to finish from place i on in each of the grammar's states; then the edits, letter by letter.
OP13 = rf"""WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hit AS (SELECT *, {CRC} % 20 AS h FROM raw),
rows_ AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM (SELECT *, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM hit)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS seen FROM rows_),
turns AS (SELECT conv_id, turn, role, text, i, n, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN seen = '' THEN 'B' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'D' WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 'T' ELSE '' END AS fault FROM placed),
costs(conv_id, i, h0, h1, h2, h3) AS (SELECT conv_id, n, 0, 6, 3, 0 FROM turns WHERE i = n
    UNION ALL SELECT conv_id, i - 1, least(g0, 3 + g2, 6 + g3), least(g1, 3 + g2, 6 + g3), least(g2, 3 + g3), least(g3, 3 + g2) FROM (
        SELECT c.conv_id, c.i, t + least(4 - t + h0, CASE WHEN stays THEN least(3 + h2, CASE WHEN r = 'u' THEN h2 WHEN r = 's' THEN h1 ELSE 999 END) ELSE 999 END) AS g0,
            t + least(4 - t + h1, CASE WHEN stays THEN least(3 + h2, CASE WHEN r = 'u' THEN h2 ELSE 999 END) ELSE 999 END) AS g1,
            t + least(4 - t + h2, CASE WHEN stays THEN least(3 + h3, CASE WHEN r = 'a' THEN h3 ELSE 999 END) ELSE 999 END) AS g2,
            t + least(4 - t + h3, CASE WHEN stays THEN least(3 + h2, CASE WHEN r = 'u' THEN h2 ELSE 999 END) ELSE 999 END) AS g3
        FROM (SELECT c.*, m.r, m.fault NOT IN ('B', 'D') AS stays, CASE WHEN m.fault = 'T' THEN 3 ELSE 0 END AS t FROM costs c JOIN turns m ON m.conv_id IS NOT DISTINCT FROM c.conv_id AND m.i = c.i) c)),
walk(conv_id, i, s, rest, audit, lines) AS (SELECT conv_id, 0, 0, h0, '', []::VARCHAR[] FROM costs WHERE i = 0
    UNION ALL SELECT conv_id, CASE e WHEN 'I' THEN i ELSE i + 1 END, CASE e WHEN 'D' THEN s WHEN 'K' THEN CASE role0 WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE nx END,
        rest - CASE e WHEN 'D' THEN 4 WHEN 'I' THEN 3 WHEN 'K' THEN t ELSE 3 + t END, audit || e,
        CASE e WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text) ELSE list_append(lines, CASE nx WHEN 2 THEN 'user:' ELSE 'assistant:' END || CASE e WHEN 'I' THEN '' ELSE text END) END
    FROM (SELECT *, CASE WHEN there AND [d0, d1, d2, d3][s + 1] + 4 = rest THEN 'D' WHEN [h0, h1, h2, h3][nx + 1] + 3 = rest THEN 'I'
            WHEN there AND ((role0 = 'u' AND s <> 2 AND d2 + t = rest) OR (role0 = 'a' AND s = 2 AND d3 + t = rest) OR (role0 = 's' AND s = 0 AND d1 + t = rest)) THEN 'K' ELSE 'R' END AS e
        FROM (SELECT w.*, CASE w.s WHEN 2 THEN 3 ELSE 2 END AS nx, m.i IS NOT NULL AS there, m.r AS role0, m.role, m.text, CASE WHEN m.fault = 'T' THEN 3 ELSE 0 END AS t,
                c.h0, c.h1, c.h2, c.h3, d.h0 AS d0, d.h1 AS d1, d.h2 AS d2, d.h3 AS d3
            FROM walk w JOIN costs c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.i = w.i
            LEFT JOIN turns m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1 LEFT JOIN costs d ON d.conv_id IS NOT DISTINCT FROM w.conv_id AND d.i = w.i + 1
            WHERE w.rest > 0 OR m.i IS NOT NULL))),
ended AS (SELECT w.conv_id, audit, sha256(array_to_string(lines, chr(10))) AS hash FROM walk w LEFT JOIN turns m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1 WHERE rest = 0 AND m.i IS NULL),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'B') AS blank, count(*) FILTER (fault = 'D') AS duplicate,
    count(*) FILTER (fault = 'T') AS truncated, count(*) FILTER (i > 1 AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
    coalesce(illegal, 0)::BIGINT AS illegal, coalesce(h0, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(hash, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN costs c ON c.conv_id IS NOT DISTINCT FROM o.conv_id AND c.i = 0
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""

ORACLES = {"op3_pivot_index": OP3, "op6_url_filter": OP6, "op7_line_dedup": OP7, "op9_minhash": OP9, "op11_divergence": OP11, "op13_turn_repair": OP13}
