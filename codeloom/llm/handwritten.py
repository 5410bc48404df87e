"""Problem 1: files that nobody in the repository wrote by hand.

Per file, a Re-Pair grammar over the abstract tokens outside of data runs: code that a tool wrote or
squeezed repeats its frames, so that rules used again, and long ones, cover most of it, while those of
hand-written code cover idioms.  Literals that make up (almost) all of a file and that hardly
compress, or runs of data, flag blobs.  Across files, rules of a corpus-wide grammar
(``repair.phrases`` over the concrete tokens) that occur in several product groups flag third-party
copies.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repair import abstract, concrete, data_mask, grammar_stats, phrases, tokens

EXTENSIONS = ("js", "jsx", "ts", "tsx", "py", "java", "cs")
REUSE = 0.6  # share of a file's code under rules of at least 8 tokens that its grammar uses again
FRAMES = 0.6  # and under its long rules (see grammar_stats): of code written by a tool or squeezed by one
GRAMMAR_FACTOR = 7.5  # symbols of a tool's grammar for each doubling of the file: frames repeat, so that it stays of logarithmic size
LEAST_CODE = 40  # tokens of code from which a grammar says anything
DATA_SHARE = 0.88  # share of a file's characters in data runs
BLOB_SHARE = 0.95  # share in literals, with next to no other tokens
BLOB_DENSITY = 0.3  # zlib size of the literals by their size, from which they count as hardly compressible
TOKENS_PER_LINE = 40  # of squeezed code
SHARED_SHARE = 0.5  # share of a file's tokens under rules that other groups use too
PHRASE_LEVELS, PHRASE_LEAST = 4, 24  # rounds of pairing; tokens that a rule must stand for
SALTS = 16

OWNER = "Corvane"  # whose own notices a file's head may hold: what its groups share is no third party's


def extension(path: F.Column) -> F.Column:
    """Lower-case extension of a path written in any way; null path gives null."""
    return F.lower(F.regexp_extract(F.regexp_replace(path, r"\\", "/"), r"\.([A-Za-z0-9]+)/*$", 1))


def group_of(repo_root: F.Column) -> F.Column:
    """Product group of a repository: the folder below the scan root."""
    return F.coalesce(F.nullif(F.regexp_extract(repo_root, r"^/srv/scan/([^/]+)", 1), F.lit("")), repo_root, F.lit(""))


_HEAD = re.compile(r"(?:\s*+(?:#.*+|/\*[\s\S]*?\*/|//.*+))*+")


def _classify(text: str, toks: list, mask: list[bool], stats: dict) -> str | None:
    chars = sum(len(t) for _, t, _ in toks) or 1
    literal = sum(len(t) for c, t, _ in toks if c in "sn") / chars
    data = sum(len(t) for (_, t, _), m in zip(toks, mask, strict=True) if m) / chars
    if stats["n"] >= LEAST_CODE and stats["reuse"] >= REUSE and stats["top"] >= FRAMES:
        lines = 1 + text.count("\n", 0, len(text.rstrip()))
        if len(toks) / lines >= TOKENS_PER_LINE:
            return "squeezed"
        if stats["size"] + 2 * stats["rules"] <= GRAMMAR_FACTOR * math.log2(stats["n"]):
            return "tool"
    if data >= DATA_SHARE:
        return "data"
    if literal >= BLOB_SHARE and stats["n"] <= LEAST_CODE and len(text) >= 200:
        raw = "".join(t for c, t, _ in toks if c in "sn").encode("utf-8", "replace")
        if len(zlib.compress(raw)) >= BLOB_DENSITY * len(raw):
            return "data"
    return None


def profile_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """file_id, kind (null: nothing within the file), tokens, and the file's long corpus rules with their lengths; a file under the owner's notice has none."""
    for pdf in batches:
        ids, texts = pdf["file_id"].tolist(), pdf["content"].tolist()
        rows = []
        for k in range(0, len(ids), 128):
            part = texts[k : k + 128]
            toks = [tokens(t) for t in part]
            masks = [data_mask(t) for t in toks]
            stats = grammar_stats([abstract([t for t, m in zip(x, ms, strict=True) if not m]) for x, ms in zip(toks, masks, strict=True)])
            for fid, text, x, ms, s in zip(ids[k : k + 128], part, toks, masks, stats, strict=True):
                kind = _classify(text, x, ms, s)
                names: list[int] = []
                lens: list[int] = []
                if kind is None and OWNER.lower() not in _HEAD.match(text).group().lower():
                    p, length = phrases(concrete(x), PHRASE_LEVELS)
                    keep = length >= PHRASE_LEAST
                    names = p[keep].astype("int64").tolist()
                    lens = length[keep].tolist()
                rows.append((fid, kind, len(x), names, lens))
        yield pd.DataFrame(rows, columns=["file_id", "kind", "n_tokens", "rules", "lengths"])


PROFILE = "file_id bigint, kind string, n_tokens bigint, rules array<bigint>, lengths array<bigint>"


def find_foreign(files: DataFrame) -> DataFrame:
    """file_id and kind (tool, squeezed, data, copy) of each file that nobody wrote by hand.

    files: fileId, repoRoot, relPath, content in any of its deliveries; other columns are not read.
    Null or empty contents and other extensions are no cases; an empty table gives none.  The rule
    table is pre-aggregated to one row for each rule and group before it is counted, and joined
    back with salted keys, so that a rule in a third of all files makes no hot task.
    """
    from ..session import cut

    src = files.where(extension(F.col("relPath")).isin(*EXTENSIONS) & F.col("content").isNotNull() & (F.col("content") != ""))
    # the group travels with the profile: the id of a file fixes its repository
    narrow = src.select(F.col("fileId").alias("file_id"), group_of(F.col("repoRoot")).alias("grp"), "content")
    schema = PROFILE.replace("file_id bigint", "file_id bigint, grp string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = next(profile_batches(iter([pdf[["file_id", "content"]]])))
            out.insert(1, "grp", pdf["grp"].to_numpy())
            yield out

    prof = cut(narrow.mapInPandas(run, schema).dropDuplicates(["file_id"]))
    inside = prof.where(F.col("kind").isNotNull()).select("file_id", "kind")
    used = prof.where(F.size("rules") > 0).select("file_id", "grp", "n_tokens", F.explode(F.arrays_zip("rules", "lengths")).alias("r"))
    used = used.select("file_id", "grp", "n_tokens", F.col("r.rules").alias("rule"), F.col("r.lengths").alias("length"))
    shared = used.select("rule", "grp").distinct().groupBy("rule").agg(F.count(F.lit(1)).alias("groups")).where("groups >= 2")
    salted = shared.select("rule", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    covered = (
        used.withColumn("salt", F.pmod(F.col("file_id"), F.lit(SALTS)).cast("int"))
        .join(salted, ["rule", "salt"])
        .groupBy("file_id")
        .agg(F.sum("length").alias("covered"), F.first("n_tokens").alias("n_tokens"))
        .where(F.col("covered") >= SHARED_SHARE * F.col("n_tokens"))
    )
    both = inside.unionByName(covered.select("file_id", F.lit("copy").alias("kind")))
    return both.groupBy("file_id").agg(F.min("kind").alias("kind"))
