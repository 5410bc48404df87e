"""Walks over edges: closed trails, reachability in a bounded number of hops, callers within a radius."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _levels(edges: DataFrame, hops: int) -> list[DataFrame]:
    """start, end, nodes, used of the trails of 1, 2, ... ``hops`` edges."""
    e = edges.select("fromId", "toId").distinct().withColumn("eid", F.concat_ws(">", "fromId", "toId"))
    step = e.select(F.col("fromId").alias("end"), F.col("toId").alias("next"), "eid")
    out = [e.select(F.col("fromId").alias("start"), F.col("toId").alias("end"), F.array("fromId", "toId").alias("nodes"), F.array("eid").alias("used"))]
    for _ in range(hops - 1):
        grown = out[-1].join(step, "end").where(~F.array_contains("used", F.col("eid")))
        out.append(grown.select("start", F.col("next").alias("end"), F.concat("nodes", F.array("next")).alias("nodes"), F.concat("used", F.array("eid")).alias("used")))
    return out


def trails(edges: DataFrame, hops: int) -> DataFrame:
    """start, end, nodes, hops of every trail of 1 to ``hops`` edges; an edge is used once at most, nodes may repeat.

    Each hop joins the open trails with the edges; trails that have closed go on too, as a longer
    closed trail may pass through their start.
    """
    out, *longer = _levels(edges, hops)
    for level in longer:
        out = out.unionByName(level)
    return out.select("start", "end", "nodes", F.size("used").alias("hops"))


def closed_trails(edges: DataFrame, hops: int) -> DataFrame:
    """``trails`` that end where they start, by way of the open ones: what ``closed_by_halves`` is tested against."""
    return trails(edges, hops).where("start = end")


def trimmed(edges: DataFrame, rounds: int) -> DataFrame:
    """The edges without those that are on no closed trail because nothing leads to their start or from their end; what that uncovers goes in the next of at most ``rounds`` rounds."""
    e = cut(edges.select("fromId", "toId").distinct())
    n = e.count()
    for _ in range(rounds):
        e = cut(e.join(e.select(F.col("toId").alias("fromId")).distinct(), "fromId", "left_semi").join(e.select(F.col("fromId").alias("toId")).distinct(), "toId", "left_semi").select("fromId", "toId"))
        left = e.count()
        if left == n:
            break
        n = left
    return e


def closed_by_halves(edges: DataFrame, hops: int) -> DataFrame:
    """start, nodes, hops of every closed trail of 1 to ``hops`` edges: its halves meet by an equality join on both ends, so that no open trail is longer than a half."""
    levels = [cut(level) for level in _levels(trimmed(edges, hops), (hops + 1) // 2)]
    out = levels[0].where("start = end").select("start", "nodes", F.lit(1).alias("hops"))
    for h in range(2, hops + 1):
        back = levels[h // 2 - 1].select(F.col("start").alias("end"), F.col("end").alias("start"), F.col("nodes").alias("more"), F.col("used").alias("others"))
        both = levels[(h + 1) // 2 - 1].join(back, ["start", "end"]).where(~F.arrays_overlap("used", "others"))
        out = out.unionByName(both.select("start", F.concat("nodes", F.slice("more", 2, h)).alias("nodes"), F.lit(h).alias("hops")))
    return out


def reach(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """seed, node, hop: every node that a seed reaches, with the least number of hops; the seeds' own nodes have hop 0.

    Levels hold each (seed, node) once, and go on from what the level before saw first; each is
    written, so that no level is computed again for the next.
    """
    e = cut(edges.select(F.col("fromId").alias("node"), F.col("toId").alias("next")).distinct())
    front = seen = cut(seeds.select("seed", "node").distinct().withColumn("hop", F.lit(0)))
    for h in range(1, hops + 1):
        onward = front.join(e, "node").select("seed", F.col("next").alias("node")).distinct()
        front = cut(onward.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hop", F.lit(h)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


BLOCK = 512  # members of a key that one task pairs with as many others, about


def member_pairs(rows: DataFrame, keys: list[str], member: str, block: int = BLOCK) -> DataFrame:
    """keys, a < b: every two members of a key.  rows are distinct.

    A key with many members is split into blocks by hash, and each two blocks meet on their own, so
    that no key is gathered in one task; a key with few has one block.
    """
    sized = rows.join(rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).where("blocks > 1"), keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = sized.withColumn("own", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = own.select(*keys, F.col(member).alias("a"), F.col("own").alias("i"), other.alias("j"))
    right = own.select(*keys, F.col(member).alias("b"), other.alias("i"), F.col("own").alias("j"))
    return left.join(right, [*keys, "i", "j"]).where("a < b").select(*keys, "a", "b")


def joined(column, sep: str = ","):
    """The distinct non-null values of a group, sorted, as one string."""
    return F.array_join(F.array_sort(F.collect_set(column)), sep)
