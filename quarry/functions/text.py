"""Text normalisation, tokens and checks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that mark a question about relations. Fixed values.
RELATION_MARKERS = ("依赖", "关系", "调用", "影响", "关联", "上游", "下游", "depends", "calls", "related", "impact", "upstream", "downstream")
SOURCE_SCHEMES = ("http", "https", "obsidian", "file", "api")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\p{javaWhitespace}+|\p{javaWhitespace}+$", "")



def normalised_query(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def mentions_relation(text: Column) -> Column:
    lowered = F.lower(text)
    found = F.lit(False)
    for marker in RELATION_MARKERS:
        found = found | lowered.contains(marker)
    return found



def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


#: Scripts that are written without spaces between words. Fixed values.
CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"


def analysed(text: Column) -> Column:
    """tokens(), but runs of Han, Kana and Hangul as overlapping pairs of characters (one alone as itself),
    so that a part of a run can be found."""
    low = F.lower(text)
    apart = F.when(low.rlike(f"[{CJK}]"), F.regexp_replace(low, f"([{CJK}]+)", " $1 ")).otherwise(low)
    words = F.filter(F.split(apart, r"[^\p{L}\p{N}]+"), lambda t: t != "")
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
    split = F.flatten(F.transform(words, lambda t: F.when(t.rlike(f"^[{CJK}]") & (F.length(t) > 1), pairs(t)).otherwise(F.array(t))))
    return F.when(low.rlike(f"[{CJK}]"), split).otherwise(words)


def search_parts(text: Column) -> Column:
    """A search as an array of (grp, item, excluded, words): what stands between `or` is a group of its
    own; in quotes, or within one word, several tokens are a phrase; a minus excludes. Parts without
    tokens say nothing."""
    raw = F.regexp_extract_all(text, F.lit(r"(-?\"[^\"]*\"?|[^\s\"]+)"), 1)
    is_or = lambda p: F.lower(p) == "or"
    parts = F.transform(
        raw,
        lambda p, i: F.struct(
            F.size(F.filter(F.slice(raw, F.lit(1), i), is_or)).alias("grp"), i.alias("item"), p.startswith("-").alias("excluded"), F.when(is_or(p), F.array().cast("array<string>")).otherwise(tokens(p)).alias("words")
        ),
    )
    return F.filter(parts, lambda p: F.size(p["words"]) > 0)


def allows_source_uri(uri: Column, schemes=("http", "https")) -> Column:
    """Absolute, of an allowed scheme; http(s) needs a host and no user information."""
    part = lambda name: F.try_parse_url(uri, F.lit(name))
    scheme = F.lower(part("PROTOCOL"))
    web = scheme.isin("http", "https")
    fine = scheme.isin(*schemes) & (~web | (F.coalesce(part("HOST"), F.lit("")) != "") & part("USERINFO").isNull())
    return F.coalesce(fine, F.lit(False))


#: Old codes of languages and those that replace them. Fixed values.
LANGUAGE_CODES = {"iw": "he", "ji": "yi", "in": "id"}
#: A well-formed tag in lower case: language with its extensions, script, region, variants, single-letter
#: extensions, private use; or private use alone.
TAG = (
    r"^(?:(?:[a-z]{2,3}(?:-[a-z]{3}){0,3}|[a-z]{4,8})(?:-[a-z]{4})?(?:-(?:[a-z]{2}|[0-9]{3}))?(?:-(?:[a-z0-9]{5,8}|[0-9][a-z0-9]{3}))*"
    r"(?:-[a-wyz0-9](?:-[a-z0-9]{2,8})+)*(?:-x(?:-[a-z0-9]{1,8})+)?|x(?:-[a-z0-9]{1,8})+)$"
)


def language_tag(tag: Column) -> Column:
    """The canonical form of a well-formed tag of language, script, region, variants, extensions and private use,
    stripped: an extended language stands for the language before it, old codes become new ones, and
    extensions are sorted by their letter. Null for a tag that is blank, ill-formed, or repeats a variant or an
    extension's letter."""
    low = F.lower(stripped(tag))
    private = F.when(low.startswith("x-"), low).otherwise(F.nullif(F.regexp_extract(low, "-(x-.*)$", 1), F.lit("")))
    public = F.when(low.startswith("x-"), F.lit("")).otherwise(F.regexp_replace(low, "-x-.*$", ""))
    plain = F.regexp_replace(public, "-[a-z0-9]-.*$", "")
    extensions = F.array_sort(F.regexp_extract_all(public, F.lit("-([a-z0-9](?:-[a-z0-9]{2,8})+)"), 1))
    letters = F.transform(extensions, lambda e: F.substring(e, 1, 1))
    words = F.split(plain, "-")
    extended = F.regexp_extract(plain, "^[a-z]{2,3}-([a-z]{3})(?:-|$)", 1)
    language = F.when(extended != "", extended).otherwise(F.get(words, F.lit(0)))
    for old, new in LANGUAGE_CODES.items():
        language = F.when(language == old, new).otherwise(language)
    rest = F.regexp_replace(plain, "^[a-z]{2,8}(?:-[a-z]{3}(?=-|$)){0,3}-?", "")
    parts = F.filter(F.split(rest, "-"), lambda w: w != "")
    shaped = F.transform(parts, lambda w: F.when(w.rlike("^[a-z]{4}$"), F.initcap(w)).when(w.rlike("^(?:[a-z]{2}|[0-9]{3})$"), F.upper(w)).otherwise(w))
    variants = F.filter(parts, lambda w: F.length(w) > 3)
    fine = low.rlike(TAG) & (F.size(F.array_distinct(variants)) == F.size(variants)) & (F.size(F.array_distinct(letters)) == F.size(letters))
    whole = F.when(low.startswith("x-"), private).otherwise(F.concat_ws("-", language, F.nullif(F.array_join(F.concat(shaped, extensions), "-"), F.lit("")), private))
    return F.when(fine, whole)


def authority(raw: Column) -> Column:
    """A whole number of 0 to 100; 50 where there is none."""
    number = F.when(raw.rlike("^[+-]?[0-9]+$"), raw.try_cast("int"))
    return F.least(F.lit(100), F.greatest(F.lit(0), F.coalesce(number, F.lit(50))))



def backoff_ms(attempt: Column, initial: int = 2_000, longest: int = 300_000) -> Column:
    """Doubling delay by attempt, its exponent capped at 20 and itself at the longest."""
    exponent = F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(20))
    return F.least(F.lit(float(longest)), initial * F.pow(F.lit(2.0), exponent)).cast("long")
