"""Keyed upserts, versioned edges, resets and cleanups over Parquet tables.

Parquet has no MERGE: a merge is a join with the target, written to a new folder and swapped in by the
caller.  ``merge_first`` keeps what was written first, ``merge_last`` what came last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coalesce_batch(batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key of a batch: for each field its first value that is not null."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fields = [c for c in batch.columns if c != key]
    return batch.select(key, *[F.first(c, ignorenulls=True).over(w).alias(c) for c in fields]).distinct()


def meta_json(meta: dict[str, Column], nested: tuple[str, ...] = ()) -> Column:
    """Metadata as a JSON text; values named in ``nested`` are no primitives and become texts of JSON within it.  Nulls stay as nulls."""
    return F.to_json(F.struct(*[(F.to_json(v) if k in nested else v).alias(k) for k, v in meta.items()]), {"ignoreNullFields": "false"})


def merge_first(target: DataFrame, batch: DataFrame, key: str, touch: tuple[str, ...] = ("snapshotVersion",)) -> DataFrame:
    """Target and batch by key: a row that is there keeps its fields but for ``touch``, which the batch renews."""
    t, b = target.alias("t"), batch.alias("b")
    cols = []
    for c in target.columns:
        if c == key:
            cols.append(F.coalesce(F.col(f"t.{c}"), F.col(f"b.{c}")).alias(c))
        elif c in touch:
            cols.append(F.when(F.col(f"b.{key}").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
        else:
            cols.append(F.when(F.col(f"t.{key}").isNotNull(), F.col(f"t.{c}")).otherwise(F.col(f"b.{c}")).alias(c))
    return t.join(b, F.col(f"t.{key}") == F.col(f"b.{key}"), "full_outer").select(*cols)


def merge_last(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Target and batch by key: the batch's row replaces the target's."""
    return target.join(batch.select(key), key, "left_anti").unionByName(batch.select(*target.columns))


def upsert_edges(target: DataFrame | None, edges: DataFrame, nodes: DataFrame, snapshot: str) -> DataFrame:
    """Edges of a snapshot whose ends are both nodes, added to the target once for each (from, type, to, snapshot)."""
    ids = nodes.select("id").distinct()
    live = edges.join(ids.withColumnRenamed("id", "fromId"), "fromId", "left_semi").join(ids.withColumnRenamed("id", "toId"), "toId", "left_semi")
    new = live.select("fromId", "type", "toId").distinct().withColumn("snapshotVersion", F.lit(snapshot))
    return new if target is None else target.unionByName(new).dropDuplicates(["fromId", "type", "toId", "snapshotVersion"])


def reset_repository(nodes: DataFrame, edges: DataFrame, repo_root: str) -> tuple[DataFrame, DataFrame]:
    """Nodes without a repository's and edges without those that touch them."""
    gone = nodes.where(F.col("repoRoot") == repo_root).select("id")
    kept = edges.join(gone.withColumnRenamed("id", "fromId"), "fromId", "left_anti").join(gone.withColumnRenamed("id", "toId"), "toId", "left_anti")
    return nodes.where(~F.col("repoRoot").eqNullSafe(repo_root)), kept


def cleanup_apis(nodes: DataFrame, edges: DataFrame, repo_root: str, provided: bool) -> tuple[DataFrame, DataFrame]:
    """API nodes without a repository's provided (or consumed) ones, and edges without those that touch them."""
    is_gone = (F.col("repoRoot").eqNullSafe(repo_root)) & ((F.col("direction") == "provided").eqNullSafe(F.lit(provided)))
    gone = nodes.where(is_gone).select("id").distinct()
    kept = edges.join(gone.withColumnRenamed("id", "fromId"), "fromId", "left_anti").join(gone.withColumnRenamed("id", "toId"), "toId", "left_anti")
    return nodes.where(~is_gone), kept


def reset_all(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Empty frames, with the numbers of nodes and edges before and after; nodes count also where there are no edges."""
    n, e = nodes.limit(0), edges.limit(0)
    return n, e, {"nodes": nodes.count(), "edges": edges.count(), "nodesLeft": n.count(), "edgesLeft": e.count()}
