"""Administration lists: pages of documents by filter, and overviews, for a batch of requests in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONGEST_PAGE = 200


def absent_if_blank(value: str) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def clamped(limit: Column) -> Column:
    """A page has 1 to LONGEST_PAGE rows, whatever is asked."""
    return F.greatest(F.lit(1), F.least(F.coalesce(limit, F.lit(LONGEST_PAGE)), F.lit(LONGEST_PAGE)))


def pages(rows: DataFrame, requests: DataFrame, order: list[Column]) -> DataFrame:
    """(request_id, place, total, the columns of rows) of the rows that each request asks for.

    requests has request_id, tenant_id, limit, offset and perhaps space_id and status: blank or null ones
    restrict nothing, DELETED rows are never shown, negative offsets are 0. Rows are numbered within their request and cut
    at the page's end, so that a task keeps no more than it. total counts all rows of the filter;
    a request whose page is empty has no rows."""
    asked = requests.select(
        "request_id",
        "tenant_id",
        *[(absent_if_blank(c) if c in requests.columns else F.lit(None).cast("string")).alias(f"asked_{c}") for c in ("space_id", "status")],
        F.greatest(F.lit(0), F.coalesce("offset", F.lit(0))).alias("first"),
        clamped(F.col("limit")).alias("n"),
    )
    fits = (F.col("asked_space_id").isNull() | (F.col("space_id") == F.col("asked_space_id"))) & (F.col("asked_status").isNull() | (F.col("status") == F.col("asked_status")))
    met = rows.where("status <> 'DELETED'").join(asked, "tenant_id").where(fits)
    total = met.groupBy("request_id").agg(F.count(F.lit(1)).alias("total"))
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(*order))
    page = met.withColumn("place", place).where((F.col("place") > F.col("first")) & (F.col("place") <= F.col("first") + F.col("n")))
    return page.join(total, "request_id").select("request_id", "place", "total", *rows.columns)


def overview(tables: dict[str, DataFrame]) -> DataFrame:
    """One row for each tenant that any table has: how many rows each table, filtered before, has of it."""
    counted = None
    for name, rows in tables.items():
        one = rows.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(name))
        counted = one if counted is None else counted.unionByName(one)
    return counted.groupBy("tenant_id").agg(*[F.coalesce(F.sum(F.when(F.col("name") == n, F.col("n"))), F.lit(0)).alias(n) for n in tables])
