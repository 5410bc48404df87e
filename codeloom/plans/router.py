"""Prompts to queries: raw SQL, templates in a fixed order, and a keyword search for the rest."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import NODE_COLUMNS, CodeGraph
from ..operators.traversal import reach
from . import graph_queries as Q

# Prompts in the order in which they are tried, with the group of the argument. Fixed values.
TEMPLATES = (
    ("call_cycles", re.compile(r"(circular|cycle|cyclic).*(function|call|dependency)(?:.*[\"'`](.+?)[\"'`])?", re.I), 3),
    ("repo_cycles", re.compile(r"(circular|cycle|cyclic).*(api).*(repo|repository)", re.I), 0),
    ("endpoint_impact", re.compile(r"(impact|affected|affect).*(api|endpoint).*(GET|POST|PUT|DELETE|PATCH|OPTIONS|HEAD)?[^\"'`]*[\"'`](.+?)[\"'`]", re.I), 4),
    ("file_impact", re.compile(r"(affected|impact).*(files|apis|tables|tests).*(for|if).*(file\s+)?[\"'`](.+?)[\"'`]", re.I), 5),
    ("provided", re.compile(r"(list|show).*(provided\s+apis|apis\s+provided).*?(in|for).*(repo|repository|path)\s+[\"'`](.+?)[\"'`]", re.I), 5),
    ("consumed", re.compile(r"(list|show).*(consumed\s+apis|apis\s+consumed).*?(in|for).*(repo|repository|path)\s+[\"'`](.+?)[\"'`]", re.I), 5),
    ("who_calls", re.compile(r"(who|which).*(calls|invokes).*(function)\s+[\"'`](.+?)[\"'`]", re.I), 4),
    ("configs", re.compile(r"(what|which).*(configs|config).*(used|uses).*file\s+[\"'`](.+?)[\"'`]", re.I), 4),
)
_KINDS = (("api", r"api|endpoint|route|url|path"), ("function", r"function|call|invoke|caller|callee"), ("file", r"file|path|[/.]"))  # Fixed values.
# Freer wordings, tried next: one word of each set, and whether something must be quoted.
FREE = (
    ("repo_cycles", (("cycle", "cycles", "circular", "cyclic"), ("api", "apis"), ("repo", "repos", "repository", "repositories", "service", "services")), False),
    ("endpoint_impact", (("impact", "affected", "affects"), ("endpoint", "endpoints")), True),
    ("file_impact", (("impact", "affected", "affects"), ("file",)), True),
    ("provided", (("provided", "exposed"), ("api", "apis", "endpoint", "endpoints")), True),
    ("consumed", (("consumed", "used"), ("api", "apis", "endpoint", "endpoints")), True),
    ("who_calls", (("who", "which", "what"), ("calls", "invokes")), True),
    ("configs", (("config", "configs"), ("file",)), True),
)
_QUOTED = re.compile(r"[\"'`](.+?)[\"'`]")
DEFAULT_LIMIT = 100
_READ_ONLY = re.compile(r"^\s*(?:select|with)\b", re.I)


@dataclass(frozen=True)
class Routed:
    name: str
    arg: str = ""
    words: tuple[str, ...] = ()


def clamp(limit: float | None) -> int:
    """A row limit: 100 if absent, floored, never below 0."""
    return DEFAULT_LIMIT if limit is None else max(0, int(limit // 1))


def route(prompt: str) -> Routed:
    if prompt.strip().upper().startswith("SQL:"):
        return Routed("raw", prompt.strip()[4:].strip())
    for name, rx, k in TEMPLATES:
        m = rx.search(prompt)
        if m:
            return Routed(name, (m.group(k) or "") if k else "")
    words = tuple(w for w in re.sub(r"[^a-z0-9_/.\-\s]", " ", prompt.lower()).split() if w)
    quoted = _QUOTED.search(prompt)
    for name, sets, asked in FREE:
        if (quoted or not asked) and all(any(w in words for w in one) for one in sets):
            return Routed(name, quoted.group(1) if quoted else "")
    for kind, rx in _KINDS:
        if re.search(rx, prompt, re.I):
            return Routed(f"search_{kind}", words=tuple(w for w in words if kind not in w))
    return Routed("search", words=words)


def _has_any(words: tuple[str, ...], *cols: str) -> F.Column:
    cond = F.lit(False)
    for c in cols:
        for w in words:
            cond = cond | F.coalesce(F.lower(F.col(c)).contains(w), F.lit(False))
    return cond


def run(g: CodeGraph, prompt: str, limit: float | None = None) -> DataFrame:
    """The rows that answer a prompt.  Raw SQL may only read; it sees the views nodes (with all stored columns) and edges (of all kinds), and gets the limit unless it names one."""
    r, n = route(prompt), clamp(limit)
    if r.name == "raw":
        if not _READ_ONLY.match(r.arg) or ";" in r.arg.rstrip("; \n"):
            raise ValueError("only a single SELECT may be run")
        views = {"nodes": lambda: g.node_rows(*NODE_COLUMNS[2:]), "edges": g.edges}
        for name, view in views.items():
            if re.search(rf"\b{name}\b", r.arg, re.I):
                view().createOrReplaceTempView(name)
        out = g.spark.sql(r.arg.rstrip("; \n"))
        return out if re.search(r"\blimit\s+\d+", r.arg, re.I) else out.limit(n)
    if r.name == "call_cycles":
        return Q.q01_call_cycles(g, r.arg or None).orderBy(F.desc("cycleLength")).limit(n)
    if r.name == "repo_cycles":
        return Q.q02_repo_cycles(g).orderBy(F.desc("hops")).limit(n)
    if r.name == "endpoint_impact":
        return Q.q03_endpoint_impact(g).where(F.lower("route").contains(r.arg.lower())).limit(n)
    if r.name == "file_impact":
        return impact(g, r.arg, Q.HOPS)
    if r.name in ("provided", "consumed"):
        rows = (Q.q05_provided if r.name == "provided" else Q.q06_consumed)(g)
        return rows.where(F.col("repoRoot").contains(r.arg)).limit(n)
    if r.name == "who_calls":
        return Q.q07_who_calls(g).where(F.col("callee") == r.arg).limit(n)
    if r.name == "configs":
        return Q.q08_configs(g).where(F.col("file") == r.arg).limit(n)
    if not r.words:
        return g.nodes.limit(0)
    if r.name == "search_api":
        return g.apis.where(_has_any(r.words, "route", "repoRoot", "method")).select("direction", "method", "route", "file", "repoRoot").orderBy("route").limit(n)
    if r.name == "search_function":
        return Q.q07_who_calls(g).where(_has_any(r.words, "caller", "callee")).limit(n)
    if r.name == "search_file":
        return g.files.where(_has_any(r.words, "file", "repoRoot")).select("file", "repoRoot").orderBy("file").limit(n)
    every = g.nodes
    for w in r.words:
        every = every.where(_has_any((w,), "name", "file", "repoRoot", "id"))
    return every.limit(n)


def _seed(g: CodeGraph, file: str, repo_root: str | None) -> DataFrame:
    rel = F.when(F.lit(file).startswith(F.concat("repoRoot", F.lit("/"))), F.lit(file).substr(F.length("repoRoot") + 2, F.lit(len(file)))).otherwise(F.lit(file))
    return g.files.where((F.col("file") == rel) & (F.lit(True) if repo_root is None else F.col("repoRoot") == repo_root))


def impact(g: CodeGraph, file: str, depth: float = 3, repo_root: str | None = None) -> DataFrame:
    """type, name, file of everything that a change of a file reaches within ``depth`` hops (1 at least), in all repositories that have a file of this name."""
    seed = _seed(g, file, repo_root).select("repoRoot", "file").distinct()
    own = g.keep_functions().nodes.where("type <> 'File'").join(seed, ["repoRoot", "file"], "left_semi").select(F.lit(file).alias("seed"), F.col("id").alias("node"))
    ends = g.nodes.where("type <> 'API'").select(F.col("id").alias("node"), "type", "name", "file").unionByName(g.apis.select(F.col("id").alias("node"), F.lit("API").alias("type"), F.col("route").alias("name"), "file"))
    return reach(own, Q.dependencies(g), max(1, int(depth))).join(ends, "node").select("type", "name", "file", "hop").distinct()


def impact_lists(g: CodeGraph, file: str, depth: float = 3, repo_root: str | None = None) -> DataFrame:
    """The lists of ``graph_queries.impact`` for one file in each repository that has it."""
    return Q.impact(g, max(1, int(depth)), _seed(g, file, repo_root).select("id"))


SHOWN = 50  # lines of a section of a report. Fixed value.


def report(lists: DataFrame) -> list[str]:
    """Lines of text for each row of ``impact_lists``: a section for each list, SHOWN entries at most and, of files, how many more."""
    out = []
    for r in lists.toLocalIterator():
        for name in lists.columns[1:]:
            items = [x for x in r[name].split(",") if x]
            out += [f"{name} ({len(items)}):", *(f"  - {x}" for x in items[:SHOWN])]
            if name == "affectedFiles" and len(items) > SHOWN:
                out.append(f"  ...and {len(items) - SHOWN} more")
    return out
