"""Access scope: which spaces a principal may read, and checks that nothing leaves it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

READING = ("READ", "WRITE", "ADMIN")


def subjects(principals: DataFrame) -> DataFrame:
    """Each principal as the (subject_type, subject_id) rows that a grant may name."""
    user = F.array(F.struct(F.lit("USER").alias("subject_type"), F.col("principal_id").alias("subject_id")))
    roles = F.transform("roles", lambda r: F.struct(F.lit("ROLE").alias("subject_type"), r.alias("subject_id")))
    tenant = F.array(F.struct(F.lit("TENANT").alias("subject_type"), F.col("tenant_id").alias("subject_id")))
    rows = principals.where("status = 'ACTIVE' and not is_system")
    return rows.select("query_id", "tenant_id", F.explode(F.concat(user, roles, tenant)).alias("s")).select("query_id", "tenant_id", "s.*")


def resolve_scope(principals: DataFrame, spaces: DataFrame, grants: DataFrame) -> DataFrame:
    """(query_id, tenant_id, space_id): active spaces that a grant opens, by equi-join on the subject;
    all active ones of the tenant for system principals."""
    active = spaces.where("status = 'ACTIVE'").select("tenant_id", "space_id")
    given = grants.where(F.col("permission").isin(*READING)).join(active, ["tenant_id", "space_id"], "left_semi")
    own = subjects(principals).join(given, ["tenant_id", "subject_type", "subject_id"]).select("query_id", "tenant_id", "space_id")
    system = principals.where("is_system").select("query_id", "tenant_id").join(active, "tenant_id").select("query_id", "tenant_id", "space_id")
    return own.unionByName(system).distinct()


def restrict(scope: DataFrame, requested: DataFrame) -> DataFrame:
    """The scope within the requested spaces (query_id, space_id); queries that request none keep all."""
    asked = requested.select("query_id").distinct().withColumn("asks", F.lit(True))
    hit = requested.select("query_id", "space_id").distinct().withColumn("hit", F.lit(True))
    joined = scope.join(asked, "query_id", "left").join(hit, ["query_id", "space_id"], "left")
    return joined.where("asks is null or hit").select(*scope.columns)


def violations(candidates: DataFrame, scope: DataFrame) -> DataFrame:
    """Candidates outside the scope of their query: one is enough to fail that query."""
    return candidates.join(scope, ["query_id", "tenant_id", "space_id"], "left_anti")


def accessible_spaces(principals: DataFrame, spaces: DataFrame, grants: DataFrame, documents: DataFrame) -> DataFrame:
    """Readable spaces of each query's principal with their number of active documents."""
    counted = documents.groupBy("tenant_id", "space_id").agg(F.count_if(F.col("status") == "ACTIVE").alias("active_documents"))
    rows = resolve_scope(principals, spaces, grants).join(spaces.select("tenant_id", "space_id", "name"), ["tenant_id", "space_id"])
    return rows.join(counted, ["tenant_id", "space_id"], "left").select("query_id", "space_id", "name", F.coalesce("active_documents", F.lit(0)).alias("active_documents"))
