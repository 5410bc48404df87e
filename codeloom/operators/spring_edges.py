"""Edges of Spring entities, J17 to J21, over frames that an extractor gives.

repos: id, repoRoot, file, entityType; tables: id, repoRoot, name; columns: id, repoRoot, file, table;
security: id, repoRoot, componentType, configuredPaths; apis: id, repoRoot, direction, route; classes:
id, repoRoot, name.  Nulls in a key give no edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import api_path
from ..functions.spring import path_matches, path_matches_literal


def accesses_table(repos: DataFrame, tables: DataFrame) -> DataFrame:
    """A repository's table is its entity's name in lower case with an s."""
    r = repos.select(F.col("id").alias("fromId"), "repoRoot", F.concat(F.lower("entityType"), F.lit("s")).alias("name"))
    return r.join(tables.select(F.col("id").alias("toId"), "repoRoot", "name"), ["repoRoot", "name"]).select("fromId", F.lit("ACCESSES_TABLE").alias("type"), "toId").distinct()


def queries_column(repos: DataFrame, columns: DataFrame) -> DataFrame:
    r = repos.select(F.col("id").alias("fromId"), "repoRoot", "file")
    return r.join(columns.select(F.col("id").alias("toId"), "repoRoot", "file"), ["repoRoot", "file"]).select("fromId", F.lit("QUERIES_COLUMN").alias("type"), "toId").distinct()


def has_column(tables: DataFrame, columns: DataFrame) -> DataFrame:
    t = tables.select(F.col("id").alias("fromId"), "repoRoot", F.col("name").alias("table"))
    return t.join(columns.select(F.col("id").alias("toId"), "repoRoot", "table"), ["repoRoot", "table"]).select("fromId", F.lit("HAS_COLUMN").alias("type"), "toId").distinct()


def secures_api(security: DataFrame, apis: DataFrame, literal: bool = False) -> DataFrame:
    """A configuration's first pattern that fits a provided endpoint of its repository; ``literal`` takes patterns as first written."""
    s = security.where("componentType = 'SecurityConfig'").select(F.col("id").alias("fromId"), "repoRoot", F.posexplode("configuredPaths").alias("pos", "pattern"))
    a = apis.where("direction = 'provided'").select(F.col("id").alias("toId"), "repoRoot", api_path(F.col("route")).alias("path"), "route")
    j = s.join(a, "repoRoot").where(path_matches_literal(F.col("path"), F.col("pattern")) if literal else path_matches(F.col("route"), F.col("pattern")))
    return j.groupBy("fromId", F.lit("SECURES_API").alias("type"), "toId").agg(F.min_by("pattern", "pos").alias("pattern"))


def used_by(security: DataFrame, classes: DataFrame) -> DataFrame:
    s = security.where("componentType = 'UserDetailsService'").select(F.col("id").alias("fromId"), "repoRoot")
    c = classes.where(F.col("name").contains("Controller") | F.col("name").contains("Service")).select(F.col("id").alias("toId"), "repoRoot")
    return s.join(c, "repoRoot").select("fromId", F.lit("USED_BY").alias("type"), "toId").distinct()
