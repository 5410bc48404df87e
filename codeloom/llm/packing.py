"""Problems 6 and 7: token counts, vector bin packing, and mixing sources by temperature."""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The pre-tokenizer pattern that belongs to that public vocabulary. Fixed value.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
SHARD_ROWS = 50_000  # documents packed together in one task
SEGMENTS = (6, 1 / 32)  # segments that a container may hold: so many, and a share of its capacity
LOSS_SHARE = 0.99  # loss-bearing tokens that a container may hold, as a share of its capacity
SHOWN_SOURCES = ("prompt",)  # sources whose documents are instructions: a model is shown them and not trained to write them
BLOCK_TOKENS = 2_000_000  # tokens of a hash block of a source's permutation, about
BLOCK_GROUPS = 1024  # groups of blocks, and blocks of a group, whose sums are looked at
TOLERANCE = 0.003  # how far the exponent may move a share from its weight


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding("packing", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, tokens, loss_tokens of each document with text, by the vocabulary file at a path of the driver's.

    Loss-bearing are the tokens outside of fenced code, quoted lines and instructions, which a model is
    shown but not trained to write.  Whole texts are counted; null and empty texts give no row.
    """

    docs.sparkSession.sparkContext.addFile(vocabulary)  # executors need no copy of their own

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(SparkFiles.get(os.path.basename(vocabulary)))
        for pdf in batches:
            n, loss = [], []
            for t, source in zip(pdf["text"], pdf["source"], strict=True):
                k = len(enc.encode_ordinary(t))
                n.append(k)
                if source in SHOWN_SOURCES:
                    loss.append(0)
                    continue
                shown = []
                if "```" in t or "\n>" in t or t[0] == ">":
                    fenced = False
                    for line in t.split("\n"):
                        if line.startswith("```"):
                            fenced = not fenced
                        elif fenced or line.startswith(">"):
                            shown.append(line)
                loss.append(max(0, k - (len(enc.encode_ordinary("\n".join(shown))) if shown else 0)))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": n, "loss_tokens": loss})

    src = docs.where(F.col("text").isNotNull() & (F.col("text") != "")).select("doc_id", F.lower(F.trim("source")).alias("source"), "text")
    return src.mapInPandas(run, "doc_id bigint, source string, tokens bigint, loss_tokens bigint")


def pack_shard(ids: np.ndarray, tokens: np.ndarray, loss: np.ndarray, capacity: int, segments: int, loss_cap: int) -> list[tuple[int, int, int, int, int]]:
    """(doc_id, part, tokens, loss, container) of each item: a container takes, again and again, the item
    that fits and whose demand has the largest dot product with what the container has left of tokens,
    segments and loss-bearing tokens, each relative to its limit.

    Items of equal demand are one candidate with a count, so that the product is taken with every item
    that is left.  A text longer than a container falls into parts of the largest size within both
    limits and a rest.  A text that fits but bears more loss than the limit stays whole, with its true
    count, in a container that takes nothing else that bears loss.
    """
    out: list[tuple[int, int, int, int, int]] = []
    stock: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for d, n, x in sorted(zip(ids.tolist(), tokens.tolist(), loss.tolist(), strict=True)):
        part = 0
        while n > capacity:
            k = min(capacity, max(1, loss_cap * n // x)) if x else capacity
            share = min(x, loss_cap, round(x * k / n))
            stock.setdefault((k, share), []).append((d, part))
            n, x, part = n - k, x - share, part + 1
        stock.setdefault((n, min(x, n)), []).append((d, part))
    if not stock:
        return out
    demand = np.array(sorted(stock), dtype=np.int64)
    size, bears = demand[:, 0], demand[:, 1]
    left = np.array([len(stock[(n, x)]) for n, x in demand.tolist()])
    heavy = [k for k in np.flatnonzero(bears > loss_cap).tolist() for _ in range(left[k])]
    total, bin_no = int(left.sum()), 0
    while total:
        room, slots, bearable = capacity, segments, loss_cap
        first = heavy.pop() if heavy else -1
        while slots > 0:
            if first >= 0:
                k, first = first, -1
            else:
                m = int(np.searchsorted(size, room, "right"))
                dot = size[:m] * (room / capacity**2) + bears[:m] * (bearable / loss_cap**2) + slots / segments**2
                dot[(bears[:m] > bearable) | (left[:m] == 0)] = -1.0
                k = int(dot.argmax()) if m else -1
                if k < 0 or dot[k] < 0:
                    break
            n, x = int(size[k]), int(bears[k])
            d, part = stock[(n, x)].pop()
            out.append((d, part, n, x, bin_no))
            left[k] -= 1
            total -= 1
            room, slots, bearable = room - n, slots - 1, max(0, bearable - x)
        bin_no += 1
    return out


def pack(counts: DataFrame, specs: DataFrame) -> DataFrame:
    """spec_name, doc_id, part, tokens, loss_tokens, container of each document for each spec.

    Documents fall by hash into shards of about SHARD_ROWS, each packed in one task; a container
    never spans shards, which costs at most one badly filled container a shard and size.  Only texts
    longer than the capacity are split.  A spec without a positive
    capacity is passed over; no documents or no specs give no rows.
    """
    from ..session import cut

    sizes = cut(counts)
    shards = max(1, math.ceil(sizes.count() / SHARD_ROWS))
    specs = specs.where(F.col("capacity_tokens") > 0).select("spec_name", F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cap, name, shard = int(pdf["capacity"].iloc[0]), pdf["spec_name"].iloc[0], int(pdf["shard"].iloc[0])
        rows = pack_shard(pdf["doc_id"].to_numpy(), pdf["tokens"].to_numpy(), pdf["loss_tokens"].to_numpy(), cap, int(SEGMENTS[0] + SEGMENTS[1] * cap), max(1, int(LOSS_SHARE * cap)))
        out = pd.DataFrame(rows, columns=["doc_id", "part", "tokens", "loss_tokens", "container"])
        out["container"] = [f"{name}-{shard}-{k}" for k in out["container"]]
        out.insert(0, "spec_name", name)
        return out

    keyed = sizes.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards))).join(F.broadcast(specs))
    return keyed.groupBy("spec_name", "shard").applyInPandas(run, "spec_name string, doc_id bigint, part bigint, tokens bigint, loss_tokens bigint, container string")


def fills(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """spec_name, container, segments, tokens, loss_tokens and fill of each container."""
    caps = specs.select("spec_name", F.col("capacity_tokens").cast("double").alias("capacity")).distinct()
    return (
        packed.groupBy("spec_name", "container")
        .agg(F.count(F.lit(1)).alias("segments"), F.sum("tokens").alias("tokens"), F.sum("loss_tokens").alias("loss_tokens"))
        .join(F.broadcast(caps), "spec_name")
        .select("spec_name", "container", "segments", "tokens", "loss_tokens", F.round(F.col("tokens") / F.col("capacity"), 6).alias("fill"))
    )


# --- problem 7 -------------------------------------------------------------------------------------


def _bisect(holds, lo: float = 0.0, hi: float = 1.0) -> tuple[float, float]:
    """(last value at which ``holds`` is as at ``lo``, first at which it is not), to within rounding."""
    at_lo = holds(lo)
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if holds(mid) == at_lo else (lo, mid)
    return lo, hi


def temperature_weights(weights: dict[str, float], sizes: dict[str, float], limits: dict[str, float], budget: float | None = None, tolerance: float = 0.0, entropy: float | None = None) -> tuple[dict[str, float], float, float]:
    """(share of each source, budget, exponent) of a mix.

    The shares are weight * (size / weight) ** a, normalised: the given weights at a = 0, the sources'
    own sizes at a = 1.  The exponent is found by bisection:
    with ``entropy``, where the shares have that entropy (in nats), or the end of the range that is nearer;
    with ``budget``, as the least at which no source would be repeated more often than its limit;
    with neither, as the largest that moves no share further than ``tolerance`` from its weight.
    The budget is what is asked for, or the largest that the repetition limits allow.
    """
    live = {s: w for s, w in weights.items() if w > 0 and sizes.get(s, 0) > 0}
    if not live:
        return {}, 0.0, 0.0
    total = sum(live.values())
    live = {s: w / total for s, w in live.items()}

    def at(a: float) -> dict[str, float]:
        raw = {s: w * (sizes[s] / w) ** a for s, w in live.items()}
        z = sum(raw.values())
        return {s: v / z for s, v in raw.items()}

    def most(p: dict[str, float]) -> float:
        return min(limits[s] * sizes[s] / p[s] for s in p)

    if entropy is not None:
        h = lambda a: -sum(v * math.log(v) for v in at(a).values())
        a = _bisect(lambda a: h(a) >= entropy)[1] if (h(0.0) >= entropy) != (h(1.0) >= entropy) else min((0.0, 1.0), key=lambda a: abs(h(a) - entropy))
        return at(a), most(at(a)) if budget is None else min(budget, most(at(a))), a
    if budget is None:
        near = lambda a: max(abs(at(a)[s] - w) for s, w in live.items()) <= tolerance + 1e-12
        a = 1.0 if near(1.0) else _bisect(near)[0]
        a = a if most(at(a)) > most(at(0.0)) else 0.0  # without more tokens there is no reason to leave the weights
        return at(a), most(at(a)), a
    budget = min(budget, sum(limits[s] * sizes[s] for s in live))
    fits = lambda a: budget <= most(at(a)) * (1 + 1e-9)
    if fits(0.0):
        return at(0.0), budget, 0.0
    a = _bisect(fits)[1] if fits(1.0) else 1.0
    return at(a), min(budget, most(at(a))), a  # where limits differ so much that not even the own sizes fit, the budget gives way


def nearest(sizes: np.ndarray, goal: float) -> np.ndarray:
    """Which documents, of a permutation's next ones, to take so that their sizes add up to nearly ``goal``.

    In order, each that fits is taken; then one is added, dropped or exchanged as long as that comes
    nearer, on either side of the goal.
    """
    taken, left = np.zeros(len(sizes), dtype=bool), goal
    for i, n in enumerate(sizes.tolist()):
        if n <= left:
            taken[i], left = True, left - n
    while len(sizes):
        ins, outs = np.flatnonzero(taken), np.flatnonzero(~taken)
        best, drop, add = abs(left), -1, -1
        if len(outs):
            outs = outs[np.argsort(sizes[outs], kind="stable")]
            gives = np.concatenate([[0.0], sizes[ins]])
            at = np.searchsorted(sizes[outs], left + gives)
            for j in (np.maximum(at - 1, 0), np.minimum(at, len(outs) - 1)):
                off = np.abs(left + gives - sizes[outs[j]])
                k = int(off.argmin())
                if off[k] < best - 1e-6:
                    best, drop, add = float(off[k]), int(ins[k - 1]) if k else -1, int(outs[j[k]])
        if len(ins):
            off = np.abs(left + sizes[ins])
            k = int(off.argmin())
            if off[k] < best - 1e-6:
                best, drop, add = float(off[k]), int(ins[k]), -1
        if drop < 0 and add < 0:
            return taken
        if drop >= 0:
            taken[drop], left = False, left + sizes[drop]
        if add >= 0:
            taken[add], left = True, left - sizes[add]
    return taken


def repeats(sizes: np.ndarray, goal: float, most: int, slack: float) -> np.ndarray:
    """How often to take each document so that their sizes add up to nearly ``goal``: once at most, but where so few documents leave more than ``slack`` open, up to ``most`` times."""
    taken = np.zeros(len(sizes), dtype=np.int64)
    while most > 0 and goal > slack:
        more = nearest(sizes, goal)
        if not more.any():
            break
        taken, goal, most = taken + more, goal - float(sizes[more].sum()), most - 1
    return taken


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(11)), blocks)


def _ends(used: DataFrame, needs: dict[tuple[str, str], float], blocks: dict[str, int]) -> dict[tuple[str, str], tuple[int, float]]:
    """(block in which a permutation's part of so many tokens ends, tokens still needed there) of each (mix, source).

    Sums are looked at on two levels, BLOCK_GROUPS of each at most: groups of blocks, and the blocks of
    the group in which the part ends.
    """
    table = F.create_map(*[F.lit(x) for s, n in blocks.items() for x in (s, n)])
    b = used.select("source", "tokens", table[F.col("source")].cast("bigint").alias("blocks"), _block(table[F.col("source")].cast("bigint")).alias("block"))
    b = b.withColumn("width", F.ceil(F.col("blocks") / F.lit(BLOCK_GROUPS)).cast("bigint")).withColumn("part", F.floor(F.col("block") / F.col("width")))
    width = {s: math.ceil(n / BLOCK_GROUPS) for s, n in blocks.items()}

    def walk(sums: dict[int, float], need: float, last: int) -> tuple[int, float]:
        for k in range(last):
            if need < sums.get(k, 0):
                return k, need
            need -= sums.get(k, 0)
        return last - 1, need + sums.get(last - 1, 0)

    first: dict[str, dict[int, float]] = {}
    for r in b.groupBy("source", "part").agg(F.sum("tokens").alias("n")).collect():  # BLOCK_GROUPS for each source of the targets
        first.setdefault(r["source"], {})[r["part"]] = r["n"]
    groups = {(m, s): walk(first.get(s, {}), need, math.ceil(blocks[s] / width[s])) for (m, s), need in needs.items()}
    wanted = sorted({(s, g) for (_, s), (g, _) in groups.items() if width[s] > 1})
    second: dict[tuple[str, int], dict[int, float]] = {}
    if wanted:
        chosen = used.sparkSession.createDataFrame(wanted, "source string, part bigint")
        for r in b.join(F.broadcast(chosen), ["source", "part"]).groupBy("source", "part", "block").agg(F.sum("tokens").alias("n")).collect():
            second.setdefault((r["source"], r["part"]), {})[r["block"] - r["part"] * width[r["source"]]] = r["n"]
    out = {}
    for (m, s), (g, rest) in groups.items():
        k, rest = (0, rest) if width[s] == 1 else walk(second.get((s, g), {}), rest, min(width[s], blocks[s] - g * width[s]))
        out[(m, s)] = (g * width[s] + k, rest)
    return out


_MIX = "mix_name string, source string, doc_id bigint, tokens bigint, repeats bigint, aimed double, exponent double"


def mix(counts: DataFrame, targets: DataFrame, budget: float | None = None, tolerance: float = TOLERANCE, entropy: float | None = None) -> DataFrame:
    """mix_name, source, doc_id, tokens, repeats of each chosen document, and the share aimed at and the exponent of its source.

    A source's budget is met by whole passes over it and by the beginning of one more permutation:
    hash blocks up to the one in which the budget ends, and of that block's documents those that come
    nearest to what is still needed (again within the limit where they are so few that once leaves a gap).  Blocks are of about BLOCK_TOKENS, so that the one at the end is
    small however large the source.  Documents with no or an unknown source are in no mix; a source
    without documents leaves its weight to the others; no targets give no rows.
    """
    from ..session import cut

    spark = counts.sparkSession
    goals = targets.where((F.col("weight") > 0) & (F.col("max_repeats") > 0)).select("mix_name", F.lower(F.trim("source")).alias("source"), "weight", "max_repeats").distinct()
    used = cut(counts.join(F.broadcast(goals.select("source").distinct()), "source").where("tokens > 0").select("source", "doc_id", "tokens"))
    sizes = {r["source"]: float(r["n"]) for r in used.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}  # a row for each source of the targets
    blocks = {s: max(1, math.ceil(n / BLOCK_TOKENS)) for s, n in sizes.items()}
    by_mix: dict[str, list] = {}
    for r in goals.collect():
        by_mix.setdefault(r["mix_name"], []).append(r)
    plan, needs, slack = {}, {}, {}
    for name, rows in sorted(by_mix.items()):
        limits = {r["source"]: float(r["max_repeats"]) for r in rows}
        shares, size, a = temperature_weights({r["source"]: r["weight"] for r in rows}, sizes, limits, budget, tolerance, entropy)
        for s, p in sorted(shares.items()):
            passes = min(int(limits[s]), int(p * size / sizes[s] + 1e-6))
            needs[(name, s)] = max(0.0, p * size - passes * sizes[s]) if passes < limits[s] else 0.0
            plan[(name, s)] = (passes, p, a)
            slack[(name, s)] = (int(limits[s]) - passes, tolerance * size / 4)
    if not plan:
        return spark.createDataFrame([], _MIX)
    ends = _ends(used, needs, blocks)
    steps = spark.createDataFrame([(m, s, passes, blocks[s], *ends[(m, s)], *slack[(m, s)], p, a) for (m, s), (passes, p, a) in plan.items()], "mix_name string, source string, passes bigint, blocks bigint, end bigint, rest double, most bigint, slack double, aimed double, exponent double")
    rows = used.join(F.broadcast(steps), "source").withColumn("block", _block(F.col("blocks")))
    out = ["mix_name", "source", "doc_id", "tokens", "repeats", "aimed", "exponent"]
    whole = rows.where("block <> end").withColumn("repeats", F.col("passes") + (F.col("block") < F.col("end")).cast("bigint"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "doc_id"], kind="stable")
        one = pdf.iloc[0]
        pdf["repeats"] = pdf["passes"] + repeats(pdf["tokens"].to_numpy(dtype="float64"), float(one["rest"]), int(one["most"]), float(one["slack"]))
        return pdf[out]

    edge = rows.where("block = end").withColumn("order", F.xxhash64("doc_id", F.lit(13))).groupBy("mix_name", "source").applyInPandas(run, _MIX)
    return whole.select(out).unionByName(edge).where("repeats > 0")


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """mix_name, source, weight, tokens, documents, most_repeats, share, the share aimed at and the exponent, and the largest document's part of the mix, of each source of each mix."""
    got = chosen.groupBy("mix_name", "source").agg(
        F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats"), F.first("aimed").alias("aimed"), F.first("exponent").alias("exponent"), F.max("tokens").alias("largest")
    )
    goals = targets.select("mix_name", F.lower(F.trim("source")).alias("source"), "weight").distinct()
    total = got.groupBy("mix_name").agg(F.sum("tokens").alias("total"))
    out = F.broadcast(goals).join(got, ["mix_name", "source"], "left").join(F.broadcast(total), "mix_name", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "mix_name", "source", "weight", zero("tokens").alias("tokens"), zero("documents").alias("documents"), zero("most_repeats").alias("most_repeats"),
        F.round(F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)), 6).alias("share"), F.round("aimed", 6).alias("aimed"), F.round("exponent", 6).alias("exponent"), F.round(F.col("largest") / F.col("total"), 6).alias("grain"),
    )
