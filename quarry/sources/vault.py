"""Vaults of Markdown notes: files to source records, with links, tags and front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.ids import sha256
from quarry.functions.text import stripped

#: Note syntax. Fixed values.
WIKI_LINK = r"(?<!\!)\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?]]"
EMBED = r"!\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?]]"
TAG = r"(?<![\p{L}\p{N}_])#([\p{L}\p{N}_/-]+)"
LONGEST_FILE = 2_097_152
#: Front matter: its first line, what lies before the closing one (or the end), in group 1, and that.
_RULE = r"[\p{javaWhitespace}&&[^\r\n]]*---[\p{javaWhitespace}&&[^\r\n]]*(?=[\r\n]|\z)"
FRONT = rf"\A{_RULE}((?s:.*?))(?:[\r\n]{_RULE}|\z)"


def found(text: Column, pattern: str) -> Column:
    """Distinct stripped first groups, sorted, so that equal notes have equal metadata."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda x: F.trim(x))))


def unquoted(value: Column) -> Column:
    return F.regexp_replace(value, "^(?:\"(.*)\"|'(.*)')$", "$1$2")


def front_matter(text: Column) -> Column:
    """The scalars between the opening and the closing --- as a map; the last of equal keys counts."""
    # the block alone is cut into lines: the text behind it is not looked at
    inner = F.split(F.regexp_replace(F.regexp_extract(text, FRONT, 1), "\r\n?", "\n"), "\n")
    pairs = F.transform(
        F.filter(inner, lambda x: F.instr(x, ":") > 1),
        lambda x: F.struct(stripped(F.substring_index(x, ":", 1)).alias("key"), unquoted(stripped(F.substring(x, F.instr(x, ":") + 1, F.length(x)))).alias("value")),
    )
    pairs = F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != ""))
    # what a lambda names from outside is made again for each element, so lists are handed in as its variable
    numbered = F.array_sort(F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), i.alias("at"), p["value"].alias("value"))))
    last = F.get(F.transform(F.array(numbered), lambda s: F.filter(s, lambda p, i: F.coalesce(F.get(s, i + 1)["key"] != p["key"], F.lit(True)))), F.lit(0))
    in_order = F.array_sort(F.transform(last, lambda p: F.struct(p["at"], p["key"].alias("key"), p["value"].alias("value"))))
    empty = F.create_map().cast("map<string,string>")
    return F.when(F.regexp_extract(text, FRONT, 0) != "", F.map_from_entries(F.transform(in_order, lambda p: F.struct(p["key"], p["value"])))).otherwise(empty)


def front_matter_tags(raw: Column) -> Column:
    inner = F.regexp_replace(stripped(raw), r"^\[(.*)\]$", "$1")
    tags = F.transform(F.split(inner, ","), lambda x: F.regexp_replace(unquoted(stripped(x)), "^#", ""))
    return F.coalesce(F.filter(tags, lambda x: stripped(x) != ""), F.array().cast("array<string>"))


def note_columns(text: Column, file_name: Column) -> dict[str, Column]:
    meta = front_matter(text)
    heading = F.regexp_extract(text, r"(?m)^\s*#{1,6}[ \t]+(.+)$", 1)
    title = F.coalesce(F.nullif(stripped(F.element_at(meta, "title")), F.lit("")), F.nullif(stripped(heading), F.lit("")), F.regexp_replace(file_name, r"(?i)\.md$", ""))
    return {
        "title": title,
        "wikilinks": found(text, WIKI_LINK),
        "embeds": found(text, EMBED),
        "tags": F.array_sort(F.array_union(found(text, TAG), front_matter_tags(F.element_at(meta, "tags")))),
        "metadata": meta,
    }


def read_vault(spark: SparkSession, root: str, connector_id: str, vault: str, ignored: tuple[str, ...] = (".obsidian", ".git", ".trash"), stream: bool = False, files_per_trigger: int = 100) -> DataFrame:
    """Source records of the .md files below a root in any store Spark reads, or a stream of new ones.
    Files below ignored directories are left out; a file beyond LONGEST_FILE is an error. Links of a file system are
    followed here as Spark's reader does; the data source of `registry` refuses them."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger) if stream else spark.read
    files = reader.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM][dD]").load(root)
    path = F.col("_metadata.file_path")
    files = files.select(F.col("value").alias("content"), path.alias("file_path"), F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_modification_time").alias("modified_at"))
    below = root.rstrip("/").split("://")[-1].removeprefix("file:") + "/"
    # file paths are percent-encoded, but a plus in them is a plus
    decoded = F.url_decode(F.replace("file_path", F.lit("+"), F.lit("%2B")))
    relative = decoded.substr(F.locate(below, decoded) + len(below), F.length(decoded))
    parts = F.split(relative, "/")
    kept = ~F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda d: d.isin(*ignored))
    too_long = F.raise_error(F.concat(F.lit("note of more than "), F.lit(str(LONGEST_FILE)), F.lit(" bytes: "), "external_id"))
    files = files.withColumn("external_id", relative).where(kept)
    files = files.withColumn("content", F.when(F.col("file_size") > LONGEST_FILE, too_long).otherwise(F.col("content")))
    return files.select(
        F.lit(connector_id).alias("connector_id"),
        "external_id",
        F.concat(F.lit("obsidian://open?vault="), F.url_encode(F.lit(vault)), F.lit("&file="), F.url_encode("external_id")).alias("uri"),
        "content",
        sha256(F.col("content")).alias("content_hash"),
        "modified_at",
        *[c.alias(n) for n, c in note_columns(F.col("content"), F.col("file_name")).items()],
    )
