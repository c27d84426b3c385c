"""Identifiers and hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_SEPARATOR = "\x1f"


def uuid3(key: Column) -> Column:
    """The name-based (MD5) UUID of a key, in lower-case text."""
    m = F.md5(key.cast("binary"))
    digit = F.conv(F.substring(m, 17, 1), 16, 10).cast("int") % 4
    variant = F.substring(F.lit("89ab"), digit + 1, F.lit(1))
    return F.concat(F.substring(m, 1, 8), F.lit("-"), F.substring(m, 9, 4), F.lit("-3"), F.substring(m, 14, 3), F.lit("-"), variant, F.substring(m, 18, 3), F.lit("-"), F.substring(m, 21, 12))


def signed_order(uuid: Column) -> list[Column]:
    """Sort keys for UUIDs whose halves compare as signed 64-bit numbers: leading 8 to f first."""
    return [(F.substring(uuid, 1, 1) >= "8").desc(), uuid.asc()]


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def joined(*parts: Column) -> Column:
    return F.concat_ws(UNIT_SEPARATOR, *parts)
