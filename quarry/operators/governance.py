"""What administrators set up: connectors of spaces, and evaluation datasets, cases and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.evaluation import next_version

DEFAULT_AUTHORITY = 70
CONNECTOR = ["tenant_id", "connector_id"]


def stored_configuration(config: Column, authority: Column) -> Column:
    """A configuration as JSON text with sorted keys, the authority among them."""
    own = F.map_filter(F.coalesce(config, F.create_map().cast("map<string,string>")), lambda k, v: k != "authority")
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(own, F.create_map(F.lit("authority"), authority.cast("string")))))))


def configure(connectors: DataFrame, spaces: DataFrame, registrations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Next connectors, and which registrations were taken (tenant_id, connector_id, occurred_at, applied).

    A registration (tenant_id, connector_id, space_id, connector_type, display_name, authority, config,
    occurred_at) of an ACTIVE space makes a connector of version 0 or replaces what is known of it, raises its
    version and makes it ACTIVE again; one of any other space changes nothing. Several of one connector count one
    after another by time (then by space and name), so each raises the version and the last one stays.
    """
    live = spaces.where("status = 'ACTIVE'").select("tenant_id", "space_id").withColumn("live", F.lit(True))
    asked = registrations.join(live, ["tenant_id", "space_id"], "left").withColumn("applied", F.coalesce("live", F.lit(False)))
    values = F.struct("occurred_at", "space_id", "display_name", "connector_type", stored_configuration(F.col("config"), F.col("authority")).alias("config_json"))
    new = asked.where("applied").groupBy(*CONNECTOR).agg(F.max(values).alias("new"), F.min("occurred_at").alias("first_at"), F.count(F.lit(1)).alias("times"))
    rows = connectors.join(new, CONNECTOR, "full_outer")
    touched = F.col("new").isNotNull()
    take = lambda c: F.when(touched, F.col("new")[c]).otherwise(F.col(c)).alias(c)
    next_connectors = rows.select(
        *CONNECTOR,
        *[take(c) for c in ("space_id", "connector_type", "display_name", "config_json")],
        F.when(touched, "ACTIVE").otherwise(F.col("status")).alias("status"),
        (F.coalesce("version", F.lit(-1)) + F.coalesce("times", F.lit(0))).cast("long").alias("version"),
        F.coalesce("created_at", "first_at").alias("created_at"),
        F.when(touched, F.col("new.occurred_at")).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    return next_connectors, asked.select(*CONNECTOR, "occurred_at", "applied")


def active_definitions(connectors: DataFrame) -> DataFrame:
    """ACTIVE connectors as definitions: the authority, taken out of the configuration (DEFAULT_AUTHORITY
    where it holds no number), and the other entries."""
    config = F.coalesce(F.from_json("config_json", "map<string,string>"), F.create_map().cast("map<string,string>"))
    authority = F.coalesce(F.element_at(config, "authority").try_cast("int"), F.lit(DEFAULT_AUTHORITY))
    kept = F.map_filter(config, lambda k, v: k != "authority")
    return connectors.where("status = 'ACTIVE'").select(*CONNECTOR, "space_id", "connector_type", "display_name", authority.alias("authority"), kept.alias("config"))


def create_datasets(datasets: DataFrame, wanted: DataFrame) -> DataFrame:
    """Next datasets: each of wanted (tenant_id, dataset_id, name, description, created_at) is a DRAFT of the next
    version of its name. A dataset whose id is there already, or comes twice, is made once."""
    fresh = wanted.dropDuplicates(["tenant_id", "dataset_id"]).join(datasets.select("tenant_id", "dataset_id"), ["tenant_id", "dataset_id"], "left_anti")
    made = next_version(fresh, datasets, ["tenant_id", "name"], "version", ["created_at", "dataset_id"])
    return datasets.unionByName(made.withColumn("status", F.lit("DRAFT")).select(datasets.columns))


def create_cases(cases: DataFrame, datasets: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Next cases, and the errors of those refused (tenant_id, case_id, error): NO_DATASET of the tenant, TOP_K
    beyond 1 to 100, or a blank QUERY. wanted has the columns of cases; without top_k a case asks for 8."""
    known = datasets.select("tenant_id", "dataset_id").withColumn("known", F.lit(True))
    rows = wanted.withColumn("top_k", F.coalesce("top_k", F.lit(8))).join(known, ["tenant_id", "dataset_id"], "left")
    error = F.when(F.col("known").isNull(), "NO_DATASET").when(~F.col("top_k").between(1, 100), "TOP_K").when(F.coalesce(F.trim("query"), F.lit("")) == "", "QUERY")
    rows = rows.withColumn("error", error).drop("known")
    key = ["tenant_id", "case_id"]
    made = rows.where("error is null").select(cases.columns).dropDuplicates(key).join(cases.select(*key), key, "left_anti")
    return cases.unionByName(made), rows.where("error is not null").select(*key, "error")


def start_runs(runs: DataFrame, cases: DataFrame, wanted: DataFrame) -> DataFrame:
    """Next runs: each of wanted (tenant_id, run_id, dataset_id, requested_by, started_at) is RUNNING over the cases that its
    dataset has now, none of which has failed yet. Known runs stay as they are."""
    n = cases.groupBy("tenant_id", "dataset_id").agg(F.count(F.lit(1)).alias("case_count"))
    fresh = wanted.dropDuplicates(["tenant_id", "run_id"]).join(runs.select("tenant_id", "run_id"), ["tenant_id", "run_id"], "left_anti").join(n, ["tenant_id", "dataset_id"], "left")
    fresh = fresh.withColumns({"status": F.lit("RUNNING"), "case_count": F.coalesce("case_count", F.lit(0)), "failed_count": F.lit(0).cast("long"), "error_code": F.lit(None).cast("string")})
    return runs.unionByName(fresh.select(runs.columns))


def fail_runs(runs: DataFrame, failed: DataFrame) -> DataFrame:
    """Next runs: RUNNING ones among failed (tenant_id, run_id, error_code) are FAILED with the code; runs that
    have ended stay."""
    codes = failed.groupBy("tenant_id", "run_id").agg(F.min("error_code").alias("new_code"))
    rows = runs.join(codes.withColumn("hit", F.lit(True)), ["tenant_id", "run_id"], "left")
    ends = F.coalesce("hit", F.lit(False)) & (F.col("status") == "RUNNING")
    return rows.withColumns({"error_code": F.when(ends, F.col("new_code")).otherwise(F.col("error_code")), "status": F.when(ends, "FAILED").otherwise(F.col("status"))}).select(runs.columns)
