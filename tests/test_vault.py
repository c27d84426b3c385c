"""Vaults of files, read at once and as a stream, and chunk limits in UTF-16 units."""

import pandas as pd
from pyspark.sql import functions as F

from quarry.sources import markdown, vault
from quarry.streaming import outbox


def written(root):
    for name, text in {
        "a.md": "---\ntitle: One\ntags: [x, #y]\n---\nsee [[b|B]] and ![[pic.png]] #z",
        "deep er/b+c.MD": "# Head\ntext",
        ".obsidian/no.md": "# no",
        "deep er/.trash/no.md": "# no",
        "c.txt": "no note",
        "empty.md": "",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text, encoding="utf-8")


def rows(frame):
    return {r["external_id"]: (r["title"], r["wikilinks"], r["embeds"], r["tags"], r["uri"]) for r in frame.collect()}


def test_batch_and_stream_give_the_same_notes(spark, tmp_path):
    root = tmp_path / "my.vault (1)"
    written(root)
    found = rows(vault.read_vault(spark, str(root), "c", "v"))
    assert found["a.md"][:4] == ("One", ["b"], ["pic.png"], ["x", "y", "z"])
    assert found["deep er/b+c.MD"][0] == "Head"
    assert set(found) - {"empty.md"} == {"a.md", "deep er/b+c.MD"}
    stream = vault.read_vault(spark, str(root), "c", "v", stream=True, files_per_trigger=1)
    out = str(tmp_path / "out")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.parquet(out)) == found


def test_limits_count_utf16_units_and_cut_no_character():
    text = "😀" * 300
    parts = markdown.pieces(text, 201)
    assert "".join(parts) == text and all(markdown.units(p) <= 201 for p in parts)
    plain = "a" * 90 + ". " + "b" * 100
    assert markdown.pieces(plain, 100) == ["a" * 90 + ".", "b" * 100]
    assert markdown.pieces("", 100) == []


def test_a_job_with_many_outcomes_ends_as_one_at_a_time():
    class State:
        exists = False

        def update(self, value):
            self.value = value

    events = pd.DataFrame({"at": range(1000, 0, -1), "event_id": range(1000), "outcome": ["failed"] * 998 + ["ok", "failed"]})
    state = State()
    out = list(outbox._run((1,), iter([events[:400], events[400:]]), state))[0]
    assert state.value == ("SUCCEEDED", 2) and out["status"].tolist() == ["SUCCEEDED"]


def test_front_matter_is_cut_out_before_its_lines_are_looked_at(spark):
    """Notes of many lines, and of many keys: both once took the square of their lines or more."""
    import time

    text = "---\ntitle: T\ntags: [a]\n---\n" + "a line: of text\n" * 20_000
    keys = "---\n" + "".join(f"k{i % 4000}: v{i}\n" for i in range(8_000))
    odd = "--- \r\na: 'b'\r\nb: \"q\"\r\na: c\r\n ---\t\r\nz: 1"
    rows = spark.createDataFrame([(1, text), (2, keys), (3, odd), (4, "---\n---\nx: y"), (5, "--- x\na: b\n---"), (6, None)], "i int, note string")
    began = time.time()
    found = {r["i"]: r["m"] for r in rows.select("i", vault.front_matter(F.col("note")).alias("m")).collect()}
    assert time.time() - began < 30
    assert found[1] == {"title": "T", "tags": "[a]"} and found[3] == {"b": "q", "a": "c"} and found[4] == found[5] == found[6] == {}
    assert len(found[2]) == 4000 and found[2]["k0"] == "v4000" and found[2]["k3999"] == "v7999"
