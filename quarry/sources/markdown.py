"""Markdown to structural elements, and elements to heading-aware chunks, as DataFrame transforms."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.ids import sha256, uuid3
from quarry.functions.text import stripped
from quarry.sources.shared import give_back, small_batches, tidy

#: Block patterns. Fixed values.
HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$")
LIST_ITEM = re.compile(r"^\s*(?:[-+*]|\d+[.)])\s+.+$")
SENTENCE_ENDS = "\n。.！？"

#: Lines that an element would not hold as they are: empty ones, those with white space at an end or a carriage return, and
#: those that begin like a heading, list item, fence or rule, or with the mark of escaped(). Fixed values.
WHITE = r"\s\x1C-\x1F\x85\p{Z}"
UNFIT = rf"^$|^[\\#+*`{WHITE}-]|^\p{{Nd}}+[.)]|[{WHITE}]$|\r"
#: Where a line would open front matter or a fence.
OPENS = r"(?m)^(?=[\t\x0B\f\x1C-\x1F\x85\p{Z}]*(?:---|```))"

ELEMENT = "ordinal int, element_type string, section_path array<string>, content string, language string"


def _kind(line: str) -> str:
    """What a line can start or end: blank, heading, fence or text."""
    if not line.strip():
        return "blank"
    if HEADING.match(line):
        return "heading"
    return "fence" if line.lstrip().startswith("```") else "text"


def _is_rule(line: str) -> bool:
    return "-" in line and not set(line) - set("|:- ")


def elements_of(text: str | None) -> list[tuple]:
    """(ordinal, type, path, content, language) of each block. Front matter is skipped if it closes; an
    open fence runs to the end; headings keep as many parents as their level allows. Empty fences
    give an element without content, which the caller may reject."""
    lines = re.split(r"\r\n|\r|\n", text or "")
    if lines and lines[-1] == "":
        lines.pop()
    at = 0
    if lines and lines[0].strip() == "---":
        at = next((i + 1 for i in range(1, len(lines)) if lines[i].strip() == "---"), 0)
    out, path = [], []
    while at < len(lines):
        line, kind = lines[at], _kind(lines[at])
        stop = at + 1
        if kind == "heading":
            marks, title = HEADING.match(line).groups()
            path = [*path[: len(marks) - 1], title.strip()]
            out.append(("HEADING", list(path), title.strip(), None))
        elif kind == "fence":
            stop = next((i for i in range(at + 1, len(lines)) if lines[i].lstrip().startswith("```")), len(lines))
            out.append(("CODE", list(path), "\n".join(lines[at + 1 : stop]).lstrip("\n") if stop > at + 1 else "", line.lstrip()[3:].strip() or None))
            stop = min(stop + 1, len(lines))
        elif kind == "text":
            table = "|" in line and at + 1 < len(lines) and _is_rule(lines[at + 1])
            block = "LIST" if LIST_ITEM.match(line) else "TABLE" if table else "PARAGRAPH"
            goes_on = {"LIST": lambda x: LIST_ITEM.match(x), "TABLE": lambda x: "|" in x, "PARAGRAPH": lambda x: True}[block]
            while stop < len(lines) and _kind(lines[stop]) == "text" and goes_on(lines[stop]):
                stop += 1
            out.append((block, list(path), "\n".join(lines[at:stop]), None))
        at = stop
    return [(i, *e) for i, e in enumerate(out)]


#: Texts whose elements are Python objects at one time.
FEW = 64


def slices(batch: pa.Array | pa.RecordBatch) -> Iterator:
    return (batch.slice(i, FEW) for i in range(0, len(batch), FEW))


def parse_arrays(revisions: DataFrame, text: str = "content") -> DataFrame:
    """revisions(revision_id, text, ...) with `elements`, the array of their elements, in place of the text: ids
    are deterministic, and content is stripped after the id is taken from it."""
    inner = f"array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in ELEMENT.split(','))}>>"
    kind = pa.list_(pa.struct([("ordinal", pa.int32()), ("element_type", pa.string()), ("section_path", pa.list_(pa.string())), ("content", pa.string()), ("language", pa.string())]))

    @F.arrow_udf(inner)
    def parsed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        keys = [f.name for f in kind.value_type]
        try:
            for texts in batches:
                few = [pa.array([[dict(zip(keys, e, strict=True)) for e in elements_of(t)] for t in part.to_pylist()], kind) for part in slices(texts)]
                yield pa.concat_arrays(few) if few else pa.array([], kind)
        finally:
            give_back()

    small_batches(revisions.sparkSession)
    key = lambda e: F.concat_ws(":", "revision_id", e["ordinal"].cast("string"), e["element_type"], e["content"])
    made = lambda e: F.struct(*[e[c].alias(c) for c in ("ordinal", "element_type", "section_path")], stripped(e["content"]).alias("content"), e["language"].alias("language"), uuid3(key(e)).alias("element_id"))
    rows = revisions.withColumn("elements", parsed(text))
    return rows.withColumn("elements", F.transform("elements", made)).drop(text)


def parse_elements(revisions: DataFrame, text: str = "content") -> DataFrame:
    """revisions(revision_id, text) to element rows (see parse_arrays()). Null and empty texts have none."""
    arrays = parse_arrays(revisions.select("revision_id", text), text)
    return arrays.select("revision_id", F.explode("elements").alias("e")).select("revision_id", "e.*")


def escaped(line: Column) -> Column:
    """A line that stays one paragraph, list item or line of a fence, whatever it holds: those that would not are put between
    backslashes, with theirs as \\b and carriage returns as \\r."""
    inner = F.replace(F.replace(line, F.lit("\\"), F.lit("\\b")), F.lit("\r"), F.lit("\\r"))
    return F.when(line.rlike(UNFIT), F.concat(F.lit("\\"), inner, F.lit("\\"))).otherwise(line)


def unescaped(line: Column) -> Column:
    """What escaped() was given."""
    inner = F.replace(F.replace(F.substr(line, F.lit(2), F.length(line) - 2), F.lit("\\r"), F.lit("\r")), F.lit("\\b"), F.lit("\\"))
    return F.when(line.startswith("\\"), inner).otherwise(line)


def plain(text: Column) -> Column:
    """Text as Markdown that loses none of its words: a backslash stands before what would open front matter or a fence, and before
    a text of nothing but white space."""
    opened = F.when(text.contains("---") | text.contains("```"), F.regexp_replace(text, OPENS, r"\\")).otherwise(text)
    return F.when(text.rlike(f"[^{WHITE}]"), opened).otherwise(F.concat(F.lit("\\"), text))


def units(text: str) -> int:
    """Length in UTF-16 code units, in which all limits count."""
    return len(text) + sum(c > "\uffff" for c in text)


def pieces(text: str, longest: int) -> list[str]:
    """Cuts of at most `longest` UTF-16 units, at the last sentence or line end beyond the middle (and
    beyond 64 units) where there is one. No character is cut in two."""
    wide = text.encode("utf-16-le", "surrogatepass")
    codes = wide.decode("utf-16-le", "surrogatepass") if units(text) == len(text) else "".join(map(chr, memoryview(wide).cast("H")))
    out, start = [], 0
    while start < len(codes):
        end = min(start + longest, len(codes))
        if end < len(codes):
            least = start + max(64, (end - start) // 2)
            end = next((i for i in range(end, least, -1) if codes[i - 1] in SENTENCE_ENDS), end)
            if "\ud800" <= codes[end - 1] <= "\udbff" and "\udc00" <= codes[end] <= "\udfff":
                end -= 1
        out.append(codes[start:end].strip().encode("utf-16-le", "surrogatepass").decode("utf-16-le", "surrogatepass"))
        start = end
        while start < len(codes) and codes[start].isspace():
            start += 1
    return out


def packed(elements: list[dict], target: int, longest: int) -> list[tuple[list[str], list[str], str]]:
    """(path, element ids, content) of the chunks of one revision's ordered elements."""
    out: list[tuple[list[str], list[str], list[str]]] = []
    fresh = True
    for e in elements:
        content = e["content"]
        if e["element_type"] == "HEADING" or fresh:
            out.append((list(e["section_path"]), [], []))
            fresh = False
        path, ids, parts = out[-1]
        if e["element_type"] != "HEADING":
            if ids and sum(map(units, parts)) + 2 * len(parts) + units(content) > target:
                out.append((list(e["section_path"]), [], []))
            if units(content) > longest:
                if not out[-1][1]:
                    out.pop()
                out += [(list(e["section_path"]), [e["element_id"]], [p]) for p in pieces(content, longest)]
                fresh = True
                continue
        out[-1][1].append(e["element_id"])
        out[-1][2].append(content)
    return [(path, ids, "\n\n".join(parts)) for path, ids, parts in out if ids]


def pack_chunks(elements: DataFrame, target: int = 1200, longest: int = 2000) -> DataFrame:
    """Elements to chunks: a heading starts one, one ends where the next element would pass the target,
    and an element beyond `longest` is cut. One revision's elements meet in one row. Returns revision_id,
    ordinal, section_path, element_ids, content, content_hash and chunk_id."""
    item = F.struct("ordinal", "element_id", "element_type", "section_path", "content")
    return pack_arrays(elements.groupBy("revision_id").agg(F.array_sort(F.collect_list(item)).alias("elements")), target, longest)


def pack_arrays(rows: DataFrame, target: int = 1200, longest: int = 2000, kept: Sequence[str] = ()) -> DataFrame:
    """pack_chunks() of rows(revision_id, elements), whose arrays are in order already; kept names columns of
    text that each chunk has as well."""
    if not (128 <= target <= 20_000 and target <= longest <= 50_000):
        raise ValueError("target 128 to 20000, and longest from there to 50000")
    names = [*kept, "revision_id"]

    kinds = [*[(n, pa.string()) for n in names], ("ordinal", pa.int32()), ("section_path", pa.list_(pa.string())), ("element_ids", pa.list_(pa.string())), ("content", pa.string())]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = [(*[row[n] for n in names], i, *c) for row in part.to_pylist() for i, c in enumerate(packed(row["elements"] or [], target, longest))]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], t) for k, (_, t) in enumerate(kinds)], schema=pa.schema(kinds))

    small_batches(rows.sparkSession)

    item = lambda e: F.struct(*[e[c].alias(c) for c in ("ordinal", "element_id", "element_type", "section_path", "content")])
    chunks = rows.select(*names, F.transform("elements", item).alias("elements")).mapInArrow(run, ", ".join(f"{n} string" for n in names) + ", ordinal int, section_path array<string>, element_ids array<string>, content string")
    chunks = chunks.withColumn("content_hash", sha256(F.col("content")))
    return chunks.withColumn("chunk_id", uuid3(F.concat_ws(":", "revision_id", F.col("ordinal").cast("string"), "content_hash")))
