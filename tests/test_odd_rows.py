"""Queries against their SQL over documents that the given tables lack: blank texts, lines that look like Markdown, numbers
that repeat or are missing."""

import duckdb
import pytest

from quarry.plans.governance import QUERIES
from quarry.plans.governance_oracles import ORACLES

TEXTS = [
    *["", " ", "\n", "  \n\t", "a\n\nb", "x\n  \ny", "   lead\ntrail  ", " ", "　\n ", "\x0b", "end \n mid", "a\rb\r\nc", "back\\slash\n\\start\\\n\\"],
    *["# Head\n- item\n1. one\n* star\n```py\ncode\n```\n> q\n```", "---\ntitle: x\n---\nrest", "---\nopen", "| a | b |\n|---|---|\n| 1 | 2 |", "١. digit\n12) par\n+1 (2)", "```", "q\n```js"],
]


def written(folder, rows):
    """rows(doc_id, text) as documents, with labels for some, below a folder."""
    made = duckdb.connect()
    made.execute("CREATE TABLE d (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    made.executemany("INSERT INTO d VALUES (?, ?, ?, ?, ?)", [(i, t, ["en", "de"][k % 2], f"src{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)])
    made.execute(f"COPY d TO '{folder}/documents.parquet' (FORMAT parquet)")
    made.execute(f"COPY (SELECT DISTINCT doc_id, 1::INTEGER AS quality, 0::INTEGER AS toxic FROM d WHERE doc_id % 3 = 0) TO '{folder}/labels.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    texts = [(i, t) for i, t in enumerate(TEXTS * 3)]
    plain = [(i, f"one {i}\ntwo\n\nthree") for i in range(24)]
    keys = plain + plain[:12] + [(i, f"other {i}") for i in range(0, 24, 5)] + [(None, "no number"), (None, "none"), (None, "none")]
    return {n: written(tmp_path_factory.mktemp(n), rows) for n, rows in {"texts": texts, "keys": keys}.items()}


def assert_equals_sql(spark, name, folder):
    frame = QUERIES[name](spark, folder)
    columns = sorted(frame.columns)
    tables = duckdb.connect()
    tables.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    wanted = tables.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(repr(tuple(r[c] for c in columns)) for r in frame.collect()) == sorted(map(repr, wanted))


@pytest.mark.parametrize("kind", ["texts", "keys"])
@pytest.mark.parametrize("name", ["markdown_elements", "snapshot_publish", "snapshot_results", "projection_worker"])
def test_odd_rows_give_what_the_sql_gives(spark, folders, name, kind):
    assert_equals_sql(spark, name, folders[kind])


def test_a_document_without_text_is_its_heading(spark, tmp_path):
    assert_equals_sql(spark, "markdown_elements", written(tmp_path, [(0, None), (1, "a"), (None, None)]))
