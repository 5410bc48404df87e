"""Typed frames of the code graph over the scanned tables, and its edge builders.

Each builder is declared as joins and aggregations on ``fromId, type, toId`` and the edge's
properties.  Deliveries that repeat fall together first, the earliest winning; a builder's edges are
distinct.  Nulls in a join key give no edge; empty tables give empty frames.  A builder selects the
columns that it needs before deliveries fall together, so that neither the scan nor the shuffle sees
others.  What is found in a file's text is found where the text is read; only the findings move.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import api_path, match_confidence, method_of, path_id, stable_id, test_framework
from ..session import cut, table
from .traversal import member_pairs

# What orders the deliveries of a node, the first winning.
DELIVERED = {"developer_entity": ("seq", "snapshotVersion", "totalCommits"), "commit_entity": ("seq", "ingestedAt")}
# Columns of a stored node, and of a stored API node. Fixed values.
NODE_COLUMNS = ("id", "type", "name", "repoRoot", "file", "language", "spanStart", "spanEnd", "snapshotVersion", "metaJson", "size", "params", "returns", "table", "valueSample", "framework", "message")
API_COLUMNS = ("id", "type", "name", "repoRoot", "file", "language", "spanStart", "spanEnd", "direction", "method", "path", "url", "snapshotVersion", "metaJson")
_TYPED = {"spanStart": "int", "spanEnd": "int", "size": "bigint"}
CALL_COLUMNS = ("name", "repoRoot", "file", "spanStart", "spanEnd", "calls", "apisProvided", "apisUsed", "tablesQueried", "configsUsed", "reads", "writes")
CLASS_HEAD = r"^\s*(?:(?:export|default|public|private|protected|internal|static|final|sealed|abstract|partial)\s+)*class\s+([A-Za-z_]\w*)"
TYPE_HEAD = r"^\s*(?:(?:export|public|private|protected|internal|declare|const)\s+)*(interface|enum|type)\s+([A-Za-z_]\w*)\s*(?:[<{:=]|extends\b|implements\b|$)"
ERROR_TEXT = r"(?:throw|raise)[ \t]+(?:new[ \t]+)?[\w.]+\(\s*[^;\"'`()\n]*[\"'`]([^\"'`\n]+)[\"'`]"
_QUOTED_OR_COMMENT = r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`[^`]*`|//.*"


def first_by(df: DataFrame, keys: list[str], order: list[str], keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns if None) of the row of each key that comes first in ``order``; partial aggregation keeps the shuffle to one narrow row a key and task."""
    rest = [c for c in (df.columns if keep is None else keep) if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


class CodeGraph:
    """The graph of a folder of tables; with ``events`` the events table's users count as repositories too, their events as functions that call each other and provide and consume endpoints."""

    def __init__(self, spark: SparkSession, folder: str, events: bool = False):
        self.spark, self.folder, self.events = spark, folder, events
        self._kept: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def rows(self, name: str, *cols: str) -> DataFrame:
        """id and ``cols`` of the nodes of a table, the first delivery of each."""
        if name in self._kept and set(cols) <= set(self._kept[name].columns):
            return self._kept[name].select("id", *cols)
        order = list(DELIVERED.get(name, ("seq", "snapshotVersion")))
        out = first_by(self.raw(name).where(F.col("id").isNotNull()).select(*dict.fromkeys(("id", *cols, *order))), ["id"], order, list(cols))
        return out.unionByName(self._event_functions().select("id", *cols)) if self.events and name == "function_entity" else out

    def fn(self, *cols: str) -> DataFrame:
        return self.rows("function_entity", *cols)

    def keep_functions(self, *more: str) -> CodeGraph:
        """Functions written once, for queries over many kinds of edges: each reads its columns from there."""
        if "function_entity" not in self._kept:
            self._kept["function_entity"] = cut(self.fn(*CALL_COLUMNS, *more))
        return self

    def keep(self, *frames: str) -> CodeGraph:
        """Some of the graph's frames written once, for queries that use them several times."""
        for name in frames:
            self.__dict__[name] = cut(getattr(self, name))
        return self

    def _event_functions(self) -> DataFrame:
        """Functions out of events: a view calls by its number, a purchase of a low number provides an endpoint, a click of one consumes it."""
        k = F.get_json_object("props", "$.k").cast("int")
        who = F.concat(F.lit("user-"), F.col("user_id").cast("string"))
        is_ = lambda kind: F.col("event_type") == kind
        low = k < 25
        path = F.concat_ws("/", F.lit("/shop"), k.cast("string"), F.floor(F.col("event_id") / 256).cast("bigint").cast("string"))
        none = {"returns": "string", "language": "string", "metaJson": "string", "params": "array<string>", "tablesQueried": "array<string>", "configsUsed": "array<string>", "reads": "array<string>", "writes": "array<string>"}
        e = self.raw("events").where(is_("view") | (is_("purchase") | is_("click")) & low)
        return e.select(
            F.md5(F.concat(F.lit("Function|"), F.col("event_id").cast("string"))).alias("id"), F.concat(F.lit("f"), (k % 8).cast("string")).alias("name"), who.alias("repoRoot"), who.alias("file"),
            F.col("event_id").cast("int").alias("spanStart"), (F.col("event_id") + 500).cast("int").alias("spanEnd"), F.lit("v1").alias("snapshotVersion"), F.col("event_id").alias("seq"),
            F.when(is_("view"), F.array(F.concat(F.lit("f"), (F.floor(k / 8) % 8).cast("string")))).alias("calls"),
            F.when(is_("purchase"), F.array(F.struct(F.lit("GET").alias("method"), F.concat(path, F.lit("/{item}")).alias("path")))).alias("apisProvided"),
            F.when(is_("click"), F.array(F.struct(F.lit("GET").alias("method"), F.concat(F.lit("https://shop.example"), path, F.lit("/"), F.col("event_id").cast("string")).alias("url")))).alias("apisUsed"),
            *[F.lit(None).cast(t).alias(c) for c, t in none.items()],
        )

    # --- nodes ---
    @cached_property
    def functions(self) -> DataFrame:
        return self.rows("function_entity", *(c for c in self.raw("function_entity").columns if c != "id"))

    @cached_property
    def repo_ids(self) -> DataFrame:
        """repoRoot, id, name of the first repository row of each root."""
        return first_by(self.rows("repository_entity", "name", "repoRoot", "seq"), ["repoRoot"], ["seq", "id"], ["id", "name"])

    def _file(self) -> Column:
        return F.col("absPath").substr(F.length("repoRoot") + 2, F.length("absPath"))

    @cached_property
    def files(self) -> DataFrame:
        src = self.raw("file_info").where(F.col("fileId").isNotNull()).select("fileId", "repoRoot", "absPath", "snapshotVersion", "scannedAt")
        one = first_by(src, ["fileId"], ["scannedAt", "snapshotVersion"], ["repoRoot", "absPath", "snapshotVersion"])
        return one.select("fileId", "repoRoot", self._file().alias("file"), stable_id(F.col("repoRoot"), F.lit("File"), self._file()).alias("id"), "snapshotVersion")

    @cached_property
    def texts(self) -> DataFrame:
        """fileId, repoRoot, file, content of every delivery with content: equal for all of a file, so that findings in them are made distinct, not the texts."""
        return self.raw("file_info").where(F.col("content").isNotNull()).select("fileId", "repoRoot", self._file().alias("file"), "content")

    @cached_property
    def lines(self) -> DataFrame:
        """fileId, repoRoot, file, ln, line, nxt (the next line) of every delivery with content."""
        return self._lines_of(self.texts)

    @staticmethod
    def _lines_of(texts: DataFrame) -> DataFrame:
        split = texts.withColumn("ls", F.split("content", "\n")).select("fileId", "repoRoot", "file", F.arrays_zip(F.col("ls").alias("line"), F.slice("ls", 2, F.size("ls")).alias("nxt")).alias("z"))
        return split.select("fileId", "repoRoot", "file", F.posexplode("z").alias("p", "z")).select("fileId", "repoRoot", "file", (F.col("p") + 1).alias("ln"), "z.line", "z.nxt")

    @cached_property
    def classes(self) -> DataFrame:
        """Classes with their spans: to the line that closes their brace, or in Python to the last line that is indented deeper.

        Braces in strings and line comments don't count; a class that isn't closed goes to the last line.
        """
        line = F.col("line")
        bare = F.when(line.contains('"') | line.contains("'") | line.contains("`") | line.contains("//"), F.regexp_replace("line", _QUOTED_OR_COMMENT, "")).otherwise(line)
        n = lambda ch: F.length("bare") - F.length(F.replace("bare", F.lit(ch), F.lit("")))
        l = self._lines_of(self.texts.where(F.col("fileId").isNotNull() & F.col("content").rlike("(?m)" + CLASS_HEAD)))
        name = F.when(line.contains("class"), F.regexp_extract("line", CLASS_HEAD, 1)).otherwise("")
        l = l.select("fileId", "repoRoot", "file", "ln", name.alias("name"), bare.alias("bare"), F.length(F.regexp_extract("line", r"^[ \t]*", 0)).alias("indent"), (F.regexp_replace("line", r"\s", "") != "").alias("full"))
        own = F.when(F.col("name") != "", F.struct("repoRoot", "file")).alias("place")  # only where a class begins: lines travel narrow
        l = l.select("fileId", "ln", "name", own, (n("{") - n("}")).alias("d"), F.contains("bare", F.lit("}")).alias("closes"), "indent", "full").distinct()
        up = Window.partitionBy("fileId").orderBy("ln")
        l = l.withColumn("depth", F.sum("d").over(up)).withColumn("before", F.max(F.when(F.col("full"), F.col("ln"))).over(up.rowsBetween(Window.unboundedPreceding, -1)))
        l = l.withColumn("last", F.max(F.when(F.col("full"), F.col("ln"))).over(Window.partitionBy("fileId")))
        c = l.where("name <> ''").select("fileId", "place.repoRoot", "place.file", "name", F.col("ln").alias("a"), (F.col("depth") - F.col("d")).alias("base"), F.col("indent").alias("own"), "last")
        later = l.select("fileId", "ln", "depth", "closes", "indent", "full", "before")
        python = F.lower("file").endswith(".py")
        found = c.join(later, "fileId").where("ln >= a").groupBy("fileId", "repoRoot", "file", "name", "a", "last").agg(
            F.min(F.when(F.col("closes") & (F.col("depth") <= F.col("base")), F.col("ln"))).alias("closed"), F.min(F.when(F.col("full") & (F.col("indent") <= F.col("own")) & (F.col("ln") > F.col("a")), F.col("before"))).alias("dedented")
        )
        end = F.coalesce(F.when(python, F.col("dedented")).otherwise(F.col("closed")), F.col("last"))
        spans = found.select("repoRoot", "file", "name", F.col("a").alias("spanStart"), end.alias("spanEnd"))
        return spans.select(stable_id(F.col("repoRoot"), F.lit("Class"), F.col("file"), F.col("name"), F.col("spanStart"), F.col("spanEnd")).alias("id"), "name", "repoRoot", "file", "spanStart", "spanEnd").distinct()

    @cached_property
    def errors(self) -> DataFrame:
        """Error messages: the string in what is thrown or raised, on its line or the next; in Java also those of error logs."""
        both = F.concat_ws("\n", "line", "nxt")
        msg = F.regexp_extract(both, "^[^\n]*" + ERROR_TEXT, 1)
        log = F.when(F.lower("file").endswith(".java"), F.regexp_extract("line", r"\.error\(\s*\"([^\"]+)\"", 1))
        e = self.lines.where(F.col("line").rlike(r"throw|raise|\.error\(")).select("fileId", "repoRoot", "file", "ln", F.coalesce(F.nullif(msg, F.lit("")), F.nullif(log, F.lit(""))).alias("message")).where("message IS NOT NULL")
        return e.select("fileId", stable_id(F.col("repoRoot"), F.lit("ErrorMessage"), F.col("file"), F.col("message"), F.col("ln")).alias("id"), "message", "repoRoot", "file", F.col("ln").alias("line")).distinct()

    @cached_property
    def type_definitions(self) -> DataFrame:
        t = self.lines.where(F.col("line").rlike(TYPE_HEAD)).select("fileId", "repoRoot", "file", "ln", F.regexp_extract("line", TYPE_HEAD, 1).alias("kind"), F.regexp_extract("line", TYPE_HEAD, 2).alias("name"))
        return t.select("fileId", stable_id(F.col("repoRoot"), F.lit("TypeDefinition"), F.col("file"), F.col("name"), F.col("ln")).alias("id"), "repoRoot", "file", "ln", "kind", "name").distinct()

    @cached_property
    def tests(self) -> DataFrame:
        """Test files: by .test. or .spec. in the path, or by a framework that the text names."""
        t = self.texts.select("repoRoot", "file", test_framework(F.col("content")).alias("framework")).where(F.lower("file").rlike(r"\.test\.|\.spec\.") | F.col("framework").isNotNull()).distinct()
        t = t.withColumn("framework", F.coalesce("framework", F.lit("unknown")))
        return t.select(stable_id(F.col("repoRoot"), F.lit("Test"), F.col("file"), F.col("framework")).alias("id"), "repoRoot", "file", "framework")

    @cached_property
    def packages(self) -> DataFrame:
        """repoRoot, manager, name, version and id of packages that a repository imports, without the platforms' own; imports name no version."""
        java = F.regexp_extract("line", r"^import ([\w.]+);", 1)
        py = F.regexp_extract("line", r"^from ([\w.]+) import (\w+)", 1)
        name = F.when(java != "", java).when(py != "", F.concat_ws(".", py, F.regexp_extract("line", r"^from ([\w.]+) import (\w+)", 2)))
        heads = self.lines.where(F.col("line").rlike("^(?:import|from) "))
        p = heads.select("repoRoot", F.when(java != "", "maven").otherwise("pip").alias("manager"), name.alias("name")).where("name IS NOT NULL AND NOT name RLIKE '^(java|javax|os|sys)[.]'").distinct()
        return p.select("repoRoot", "manager", "name", F.lit(None).cast("string").alias("version"), stable_id(F.lit("Package"), F.col("manager"), F.col("name")).alias("id"))

    @cached_property
    def apis(self) -> DataFrame:
        f = self.fn("repoRoot", "file", "apisProvided", "apisUsed")
        prov = f.select("repoRoot", "file", F.lit("provided").alias("direction"), F.explode("apisProvided").alias("a")).select("repoRoot", "file", "direction", F.col("a.method").alias("method"), F.col("a.path").alias("route"))
        used = f.select("repoRoot", "file", F.lit("consumed").alias("direction"), F.explode("apisUsed").alias("a")).select("repoRoot", "file", "direction", F.col("a.method").alias("method"), F.col("a.url").alias("route"))
        every = prov.unionByName(used).where(F.col("route").isNotNull()).distinct()
        return every.withColumn("id", stable_id(F.col("repoRoot"), F.lit("API"), F.col("direction"), method_of(F.col("method")), path_id(F.col("route"))))

    @cached_property
    def tables(self) -> DataFrame:
        """repoRoot, file, name, id of queried tables; the id is the repository's, whatever file names the table."""
        t = self.fn("repoRoot", "file", "tablesQueried").select("repoRoot", "file", F.explode("tablesQueried").alias("name")).where("name IS NOT NULL").distinct()
        return t.select("repoRoot", "file", "name", stable_id(F.col("repoRoot"), F.lit("DatabaseTable"), F.col("name")).alias("id"))

    @cached_property
    def variables(self) -> DataFrame:
        """Names read or written within a function; a name that several functions of a file use is a variable of each."""
        none = F.array().cast("array<string>")
        names = F.array_distinct(F.concat(F.coalesce("reads", none), F.coalesce("writes", none)))
        v = self.fn("repoRoot", "file", "spanStart", "spanEnd", "reads", "writes").where(F.col("spanStart").isNotNull()).select("repoRoot", "file", "spanStart", "spanEnd", F.explode(names).alias("name")).where("name IS NOT NULL").distinct()
        return v.select(stable_id(F.col("repoRoot"), F.lit("Variable"), F.col("file"), F.col("name"), F.col("spanStart"), F.col("spanEnd")).alias("id"), "name", "repoRoot", "file", "spanStart", "spanEnd")

    def entities(self, *cols: str, placed: bool = False) -> DataFrame:
        """id, type and ``cols`` (of NODE_COLUMNS) of all entities of fifteen types, with ``placed`` of those that have a file; an entity that several files name has a row for each."""
        c = F.col
        api = F.when(c("direction") == "provided", c("route"))
        have = {
            "Repository": (lambda *k: self.rows("repository_entity", *k), {x: c(x) for x in ("name", "repoRoot", "language", "snapshotVersion", "metaJson")}),
            "File": (lambda *k: self.files, {"name": c("file"), "repoRoot": c("repoRoot"), "file": c("file"), "snapshotVersion": c("snapshotVersion")}),
            "Function": (lambda *k: self.fn(*k), {**{x: c(x) for x in ("name", "repoRoot", "file", "language", "spanStart", "spanEnd", "snapshotVersion", "metaJson", "returns")}, "params": F.to_json("params") if "params" in cols else None}),
            "Config": (lambda *k: self.rows("config_entity", *k), {x: c(x) for x in ("name", "repoRoot", "file", "language", "spanStart", "spanEnd", "snapshotVersion", "metaJson", "valueSample")}),
            "Class": (lambda *k: self.classes, {x: c(x) for x in ("name", "repoRoot", "file", "spanStart", "spanEnd")}),
            "Variable": (lambda *k: self.variables, {x: c(x) for x in ("name", "repoRoot", "file", "spanStart", "spanEnd")}),
            "ErrorMessage": (lambda *k: self.errors, {"name": c("message"), "repoRoot": c("repoRoot"), "file": c("file"), "spanStart": c("line"), "spanEnd": c("line"), "message": c("message")}),
            "TypeDefinition": (lambda *k: self.type_definitions, {"name": c("name"), "repoRoot": c("repoRoot"), "file": c("file"), "spanStart": c("ln")}),
            "Test": (lambda *k: self.tests, {"name": c("file"), "repoRoot": c("repoRoot"), "file": c("file"), "framework": c("framework")}),
            "API": (lambda *k: self.apis, {"name": F.concat_ws(" ", method_of(c("method")), c("route")), "repoRoot": c("repoRoot"), "file": c("file")}),
            "DatabaseTable": (lambda *k: self.tables, {"name": c("name"), "repoRoot": c("repoRoot"), "file": c("file"), "table": c("name")}),
            "Package": (lambda *k: self.packages, {"name": c("name"), "repoRoot": c("repoRoot")}),
            "Developer": (lambda *k: self.rows("developer_entity", *k), {x: c(x) for x in ("name", "repoRoot", "snapshotVersion", "metaJson")}),
            "Team": (lambda *k: self.rows("team_entity", *k), {x: c(x) for x in ("name", "repoRoot", "snapshotVersion", "metaJson", "size")}),
            "Commit": (lambda *k: self.rows("commit_entity", *k), {x: c(x) for x in ("name", "repoRoot", "snapshotVersion", "message")}),
        }
        out = None
        for kind, (frame, props) in have.items():
            if placed and "file" not in props:
                continue
            asked = [k for k in cols if props.get(k) is not None]
            part = frame(*asked).select("id", F.lit(kind).alias("type"), *[(props[k] if k in asked else F.lit(None)).cast(_TYPED.get(k, "string")).alias(k) for k in cols])
            out = part if out is None else out.unionByName(part)
        return out

    @cached_property
    def nodes(self) -> DataFrame:
        return self.node_rows("name", "repoRoot", "file")

    def node_rows(self, *cols: str) -> DataFrame:
        """One row for each node: of an entity that several files or repositories name, the first by repository and file."""
        return first_by(self.entities(*cols), ["id", "type"], [c for c in ("repoRoot", "file", *cols) if c in cols], list(cols))

    def api_rows(self) -> DataFrame:
        """API nodes with API_COLUMNS: of one endpoint in several files, the fields of the first."""
        c = F.col
        given = c("direction") == "provided"
        a = self.apis.select("id", "repoRoot", "file", "direction", method_of(c("method")).alias("method"), F.when(given, c("route")).alias("path"), F.when(~given, c("route")).alias("url"))
        one = first_by(a, ["id"], ["file", "path", "url"], ["repoRoot", "file", "direction", "method", "path", "url"])
        blank = {x: F.lit(None).cast(_TYPED.get(x, "string")).alias(x) for x in ("language", "spanStart", "spanEnd", "snapshotVersion", "metaJson")}
        return one.select(*[blank.get(x, {"type": F.lit("API").alias("type"), "name": F.concat_ws(" ", "method", F.coalesce("path", "url")).alias("name")}.get(x, c(x))) for x in API_COLUMNS])

    # --- edges: structure and calls ---
    @staticmethod
    def _edge(df: DataFrame, kind: str, *props: str) -> DataFrame:
        return df.select("fromId", F.lit(kind).alias("type"), "toId", *props).distinct()

    def _in_file(self, entities: DataFrame, kind: str) -> DataFrame:
        f = self.files.select(F.col("id").alias("fromId"), "repoRoot", "file")
        return self._edge(f.join(entities.select(F.col("id").alias("toId"), "repoRoot", "file"), ["repoRoot", "file"]).where("fromId <> toId"), kind)

    def contains(self) -> DataFrame:
        return self._in_file(self.entities("repoRoot", "file", placed=True), "CONTAINS")

    def declares(self) -> DataFrame:
        parts = [self.fn("repoRoot", "file"), self.classes.select("id", "repoRoot", "file"), self.variables.select("id", "repoRoot", "file")]
        return self._in_file(parts[0].unionByName(parts[1]).unionByName(parts[2]), "DECLARES")

    def has_function(self) -> DataFrame:
        c = self.classes.select(F.col("id").alias("fromId"), "repoRoot", "file", F.col("spanStart").alias("a"), F.col("spanEnd").alias("b"))
        f = self.fn("repoRoot", "file", "spanStart", "spanEnd").withColumnRenamed("id", "toId")
        return self._edge(c.join(f, ["repoRoot", "file"]).where("spanStart >= a AND spanEnd <= b"), "HAS_FUNCTION")

    def _named(self, column: str, target: DataFrame, kind: str) -> DataFrame:
        f = self.fn("repoRoot", column).select(F.col("id").alias("fromId"), "repoRoot", F.explode(column).alias("name")).distinct()
        return self._edge(f.join(target.select(F.col("id").alias("toId"), "repoRoot", "name"), ["repoRoot", "name"]).where("fromId <> toId"), kind)

    def calls(self) -> DataFrame:
        return self._named("calls", self.fn("repoRoot", "name"), "CALLS")

    def queries_table(self) -> DataFrame:
        return self._named("tablesQueried", self.tables.select("id", "repoRoot", "name").distinct(), "QUERIES")

    def uses_config(self) -> DataFrame:
        return self._named("configsUsed", self.rows("config_entity", "repoRoot", "name"), "USES_CONFIG")

    def _api_edge(self, column: str, route: str, direction: str, kind: str) -> DataFrame:
        f = self.fn("repoRoot", "file", column).select(F.col("id").alias("fromId"), "repoRoot", "file", F.explode(column).alias("a")).select("fromId", "repoRoot", "file", F.col(f"a.{route}").alias("route"), method_of(F.col("a.method")).alias("m"))
        a = self.apis.where(F.col("direction") == direction).select(F.col("id").alias("toId"), "repoRoot", "file", "route", method_of(F.col("method")).alias("m"))
        return self._edge(f.join(a, ["repoRoot", "file", "route", "m"] if direction == "provided" else ["repoRoot", "file", "route"]), kind)

    def provides_api(self) -> DataFrame:
        return self._api_edge("apisProvided", "path", "provided", "PROVIDES_API")

    def uses_api(self) -> DataFrame:
        return self._api_edge("apisUsed", "url", "consumed", "USES_API")

    # --- edges: lineage ---
    def _resolved(self, refs: DataFrame) -> DataFrame:
        """refs (fnId, repoRoot, file, a, b, name, ...) with the variables they mean: those within the function's span if there are any, else all of that name in the file."""
        v = self.variables.select(F.col("id").alias("varId"), "repoRoot", "file", "name", "spanStart", "spanEnd")
        j = refs.join(v, ["repoRoot", "file", "name"]).withColumn("inside", ((F.col("spanStart") >= F.col("a")) & (F.col("spanEnd") <= F.col("b"))).cast("int"))
        best = F.max("inside").over(Window.partitionBy("fnId", "name"))
        return j.withColumn("best", best).where("inside = best").drop("spanStart", "spanEnd", "inside", "best")

    def _refs(self, column: str, alias: str = "name") -> DataFrame:
        f = self.fn("repoRoot", "file", "spanStart", "spanEnd", "seq", column).where(F.col("spanStart").isNotNull())
        return f.select(F.col("id").alias("fnId"), "repoRoot", "file", F.col("spanStart").alias("a"), F.col("spanEnd").alias("b"), "seq", F.posexplode(column).alias("pos", alias))

    def _read_or_written(self, column: str, kind: str) -> DataFrame:
        refs = self._refs(column).drop("seq", "pos").distinct()
        return self._edge(self._resolved(refs).select(F.col("fnId").alias("fromId"), F.col("varId").alias("toId")), kind)

    def reads_from(self) -> DataFrame:
        return self._read_or_written("reads", "READS_FROM")

    def writes_to(self) -> DataFrame:
        return self._read_or_written("writes", "WRITES_TO")

    def _derives(self) -> DataFrame:
        d = self._refs("derives", "d")
        return d.select("fnId", "repoRoot", "file", "a", "b", "pos", F.col("d.target").alias("name"), F.col("d.sources").alias("sources"), F.col("d.op").alias("op"))

    def transforms(self) -> DataFrame:
        """Derived variables with their sources and operation, of several derivations of one target the first."""
        one = first_by(self._derives().withColumn("sources", F.array_join("sources", ",")), ["fnId", "repoRoot", "file", "a", "b", "name"], ["pos"], ["sources", "op"])
        return self._edge(self._resolved(one).select(F.col("fnId").alias("fromId"), F.col("varId").alias("toId"), "sources", "op"), "TRANSFORMS", "sources", "op")

    def derives_from(self) -> DataFrame:
        d = self._derives()
        left = self._resolved(d.select("fnId", "repoRoot", "file", "a", "b", "name").distinct()).select("fnId", F.col("name").alias("target"), F.col("varId").alias("fromId"))
        pairs = d.select("fnId", "repoRoot", "file", "a", "b", F.col("name").alias("target"), F.explode("sources").alias("name")).distinct()
        right = self._resolved(pairs.drop("target").distinct()).select("fnId", "name", F.col("varId").alias("toId"))
        return self._edge(left.join(pairs.select("fnId", "target", "name"), ["fnId", "target"]).join(right, ["fnId", "name"]).where("fromId <> toId"), "DERIVES_FROM")

    def passes_to(self) -> DataFrame:
        """Variables and the functions that they are passed to, with the first argument place by the functions' order and the place in the list."""
        p = self._refs("passesTo", "p").select("fnId", "repoRoot", "file", "a", "b", "seq", "pos", F.col("p.sourceVar").alias("name"), F.col("p.callee").alias("callee"), F.col("p.argIndex").alias("argIndex"), F.col("p.paramName").alias("paramName"))
        r = self._resolved(p).select(F.col("varId").alias("fromId"), "repoRoot", F.col("callee").alias("name"), "seq", "fnId", "pos", "argIndex", "paramName")
        j = r.join(self.fn("repoRoot", "name").withColumnRenamed("id", "toId"), ["repoRoot", "name"])
        one = first_by(j, ["fromId", "toId"], ["seq", "fnId", "pos"], ["argIndex", "paramName"])
        return one.select("fromId", F.lit("PASSES_TO").alias("type"), "toId", "argIndex", "paramName")

    def emits_error(self) -> DataFrame:
        f = self.fn("repoRoot", "file", "spanStart", "spanEnd").withColumnRenamed("id", "fromId")
        e = self.errors.select(F.col("id").alias("toId"), "repoRoot", "file", "line")
        return self._edge(f.join(e, ["repoRoot", "file"]).where("line BETWEEN spanStart AND spanEnd"), "EMITS_ERROR")

    # --- edges: packages and services ---
    def repo_packages(self) -> DataFrame:
        r = self.rows("repository_entity", "repoRoot").withColumnRenamed("id", "fromId")
        return self._edge(r.join(self.packages.select(F.col("id").alias("toId"), "repoRoot", "manager", "version"), "repoRoot"), "REPO_DEPENDS_ON_PACKAGE", "manager", "version")

    def shares_package(self) -> DataFrame:
        """Pairs of repositories with the number of packages both import and the first ten of them; a package of many repositories is paired in blocks."""
        both = member_pairs(self.packages.select("id", "repoRoot").distinct(), ["id"], "repoRoot").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set("id")), 1, 10), ",").alias("packages"))
        r = self.repo_ids.select("repoRoot", "id")
        return (
            both.join(r.select(F.col("repoRoot").alias("a"), F.col("id").alias("fromId")), "a").join(r.select(F.col("repoRoot").alias("b"), F.col("id").alias("toId")), "b").select("fromId", F.lit("SHARES_PACKAGE_WITH").alias("type"), "toId", "n", "packages")
        )

    def _repo_api(self, provided: bool, kind: str) -> DataFrame:
        r = self.rows("repository_entity", "repoRoot").withColumnRenamed("id", "fromId")
        a = self.apis.where((F.col("direction") == "provided") == F.lit(provided)).select(F.col("id").alias("toId"), "repoRoot")
        return self._edge(r.join(a, "repoRoot"), kind)

    def repo_provides(self) -> DataFrame:
        return self._repo_api(True, "REPO_PROVIDES_API")

    def repo_uses(self) -> DataFrame:
        return self._repo_api(False, "REPO_USES_API")

    def path_matches(self) -> DataFrame:
        """cPath, pPath that match by equality, by containment or by template, over distinct paths.

        No path is compared with all others: a consumed path emits its substrings of the lengths that provided paths have,
        and for templates one form for each set of open segments that templates of its length have;
        those are joined by equality, and their open segments are then compared.
        """
        a = self.apis.withColumn("path", api_path(F.col("route")))
        c = a.where("direction = 'consumed' AND path <> ''").select(F.col("path").alias("cPath")).distinct()
        p = a.where("direction = 'provided' AND path <> ''").select(F.col("path").alias("pPath")).distinct()
        equal = c.join(p, F.col("cPath") == F.col("pPath"))
        sizes = p.select(F.length("pPath").alias("k")).distinct().where("k >= 2")  # no more rows than the longest path has characters
        starts = c.join(F.broadcast(sizes), F.length("cPath") >= F.col("k")).select("cPath", "k", F.explode(F.sequence(F.lit(1), F.length("cPath") - F.col("k") + 1)).alias("s"))
        within = starts.select("cPath", F.col("cPath").substr(F.col("s"), F.col("k")).alias("pPath")).distinct().join(p, "pPath").select("cPath", "pPath")
        hole = r"\{[^/}]+\}|:[a-z_][a-z0-9_]*"
        form = lambda: F.array_join(F.expr("transform(seg, (x, i) -> CASE WHEN array_contains(open, i) THEN '*' ELSE x END)"), "/")
        tmpl = p.where(F.lower("pPath").rlike(hole)).withColumn("seg", F.split(F.regexp_replace(F.lower("pPath"), hole, "\u0001"), "/"))
        tmpl = tmpl.withColumn("open", F.expr("filter(sequence(0, size(seg) - 1), i -> contains(seg[i], '\u0001'))"))
        # literal parts are quoted; paths are in lower case, so that none ends a quote
        tmpl = tmpl.withColumn("pattern", F.concat(F.lit(r"^\Q"), F.replace(F.array_join("seg", "/"), F.lit("\u0001"), F.lit(r"\E[^/]+\Q")), F.lit(r"\E$")))
        tmpl = tmpl.select("pPath", "pattern", "open", F.size("seg").alias("n"), form().alias("key"))
        segs = c.withColumn("seg", F.split(F.lower("cPath"), "/")).withColumn("n", F.size("seg"))
        shaped = segs.join(tmpl.select("n", "open").distinct(), "n").select("cPath", "n", "open", form().alias("key"))
        by_template = shaped.join(tmpl, ["n", "open", "key"]).where(F.rlike(F.lower("cPath"), F.col("pattern"))).select("cPath", "pPath")
        return equal.unionByName(within).unionByName(by_template).distinct()

    def consumes_api_from(self) -> DataFrame:
        """Repository pairs over matching endpoints: the least matching pair, its confidence, and the number of matches."""
        a = self.apis.select("repoRoot", "direction", "route", "method", method_of(F.col("method")).alias("m"), api_path(F.col("route")).alias("path"))
        c = a.where("direction = 'consumed'").select(F.col("repoRoot").alias("cRepo"), F.col("route").alias("cUrl"), "m", F.col("path").alias("cPath")).distinct()
        p = a.where("direction = 'provided'").select(F.col("repoRoot").alias("pRepo"), F.col("route").alias("pRoute"), "m", F.col("path").alias("pPath")).distinct()
        j = c.join(self.path_matches(), "cPath").join(p, ["pPath", "m"]).where("cRepo <> pRepo")
        conf = F.round(match_confidence(F.col("cUrl"), F.col("m"), F.col("cRepo"), F.col("pRoute"), F.col("m"), F.col("pRepo")), 6)
        best = j.withColumn("conf", conf).groupBy("cRepo", "pRepo").agg(F.min(F.struct("cUrl", "pRoute", "m", "conf")).alias("f"), F.count(F.lit(1)).alias("n"))
        return best.select("cRepo", "pRepo", F.col("f.cUrl").alias("consumed"), F.col("f.pRoute").alias("provided"), F.col("f.conf").alias("confidence"), "n")

    # --- edges: people ---
    def belongs_to(self) -> DataFrame:
        """A developer's team: by id or name within the repository, the first; without a team id, the repository's only team."""
        t = self.rows("team_entity", "name", "repoRoot", "seq").select(F.col("id").alias("toId"), F.col("name").alias("tName"), "repoRoot", F.col("seq").alias("tSeq"))
        d = self.rows("developer_entity", "repoRoot", "teamId").withColumnRenamed("id", "fromId")
        named = d.where("teamId IS NOT NULL")
        keys = t.select("repoRoot", F.explode(F.array("toId", "tName")).alias("teamId"), "toId", "tSeq")
        by_key = named.join(keys, ["repoRoot", "teamId"]).groupBy("fromId").agg(F.min(F.struct("tSeq", "toId")).alias("f")).select("fromId", F.col("f.toId").alias("toId"))
        only = t.groupBy("repoRoot").agg(F.count(F.lit(1)).alias("n"), F.min("toId").alias("toId")).where("n = 1")
        sole = d.where("teamId IS NULL").join(only, "repoRoot").select("fromId", "toId")
        return self._edge(by_key.unionByName(sole), "BELONGS_TO")

    def _repo_of(self, column: str) -> DataFrame:
        return self.repo_ids.select("repoRoot", F.col("id").alias(column))

    def owns_repository(self, now: str | None = None) -> DataFrame:
        """Teams and their repository; since is what the team's metadata say, or the ``now`` that the caller gives."""
        t = self.rows("team_entity", "repoRoot", "size", "metaJson").select(F.col("id").alias("fromId"), "repoRoot", F.coalesce(F.get_json_object("metaJson", "$.since"), F.lit(now)).alias("since"), F.col("size").alias("teamSize"))
        return self._edge(t.join(self._repo_of("toId"), "repoRoot"), "OWNS_REPOSITORY", "since", "teamSize")

    def contributed_to(self) -> DataFrame:
        none = F.array().cast("array<string>")
        d = self.rows("developer_entity", "repoRoot", "totalCommits", "firstCommit", "lastCommit", "primaryLanguages").select(
            F.col("id").alias("fromId"), "repoRoot", F.coalesce("totalCommits", F.lit(0)).alias("commits"), F.unix_micros("firstCommit").alias("firstCommit"), F.unix_micros("lastCommit").alias("lastCommit"), F.array_join(F.coalesce("primaryLanguages", none), ",").alias("primaryLanguages")
        )
        return self._edge(d.join(self._repo_of("toId"), "repoRoot"), "CONTRIBUTED_TO", "commits", "firstCommit", "lastCommit", "primaryLanguages")

    def authors(self) -> DataFrame:
        """fromId, toId: each commit's developer, the first of the repository whose mail (in lower case), alias or name is the author's.

        The three conditions are one equality: a developer emits its keys, a commit its two.
        """
        none = F.array().cast("array<string>")
        keys = F.concat(F.transform(F.array_compact(F.concat(F.array(F.lower("email")), F.coalesce("aliases", none))), lambda x: F.concat(F.lit("m:"), x)), F.array_compact(F.array(F.concat(F.lit("n:"), "name"))))
        d = self.rows("developer_entity", "repoRoot", "seq", "email", "aliases", "name").select(F.col("id").alias("fromId"), "repoRoot", "seq", F.explode(F.array_distinct(keys)).alias("key"))
        keyed = d.groupBy("repoRoot", "key").agg(F.min(F.struct("seq", "fromId")).alias("dev"))
        c = self.rows("commit_entity", "repoRoot", "author", "authorEmail").select(F.col("id").alias("toId"), "repoRoot", F.explode(F.array_compact(F.array(F.concat(F.lit("m:"), "authorEmail"), F.concat(F.lit("n:"), "author")))).alias("key"))
        return c.join(keyed, ["repoRoot", "key"]).groupBy("toId").agg(F.min("dev").alias("dev")).select(F.col("dev.fromId").alias("fromId"), "toId")

    def committed(self) -> DataFrame:
        c = self.rows("commit_entity", "timestamp", "additions", "deletions", "filesChanged").select(
            F.col("id").alias("toId"), F.unix_micros("timestamp").alias("timestamp"), "additions", "deletions", F.when(F.col("filesChanged").isNull(), 0).otherwise(F.size("filesChanged")).cast("bigint").alias("filesChanged")
        )
        return self.authors().join(c, "toId").select("fromId", F.lit("COMMITTED").alias("type"), "toId", "timestamp", "additions", "deletions", "filesChanged")

    def contains_commit(self) -> DataFrame:
        return self._edge(self._repo_of("fromId").join(self.rows("commit_entity", "repoRoot").withColumnRenamed("id", "toId"), "repoRoot"), "CONTAINS_COMMIT")

    def modified_file(self) -> DataFrame:
        c = self.rows("commit_entity", "repoRoot", "timestamp", "filesChanged").select(F.col("id").alias("fromId"), "repoRoot", F.unix_micros("timestamp").alias("timestamp"), F.explode("filesChanged").alias("file")).distinct()
        return self._edge(c.join(self.files.select("repoRoot", "file", F.col("id").alias("toId")), ["repoRoot", "file"]), "MODIFIED_FILE", "timestamp")

    def touched(self) -> DataFrame:
        """repoRoot, file, dev: who changed what, once."""
        c = self.rows("commit_entity", "repoRoot", "filesChanged").select(F.col("id").alias("toId"), "repoRoot", F.explode("filesChanged").alias("file"))
        return self.authors().select(F.col("fromId").alias("dev"), "toId").join(c, "toId").select("repoRoot", "file", "dev").distinct()

    def collaborates_with(self) -> DataFrame:
        """Developers with the number of files that both changed, in both directions; a file of many developers is paired in blocks."""
        one = member_pairs(self.touched(), ["repoRoot", "file"], "dev").groupBy("a", "b").agg(F.count(F.lit(1)).alias("sharedFiles"))
        both = F.explode(F.array(F.struct(F.col("a").alias("fromId"), F.col("b").alias("toId")), F.struct(F.col("b").alias("fromId"), F.col("a").alias("toId"))))
        return one.select(both.alias("e"), "sharedFiles").select("e.fromId", F.lit("COLLABORATES_WITH").alias("type"), "e.toId", "sharedFiles")

    def manages_team(self) -> DataFrame:
        d = self.rows("developer_entity", "repoRoot", "seq", "name", "email").select(F.col("id").alias("fromId"), "repoRoot", "seq", F.explode(F.array_compact(F.array("name", "email"))).alias("lead"))
        keys = d.groupBy("repoRoot", "lead").agg(F.min(F.struct("seq", "fromId")).alias("dev"))
        t = self.rows("team_entity", "repoRoot", "lead").withColumnRenamed("id", "toId")
        return self._edge(t.join(keys, ["repoRoot", "lead"]).select(F.col("dev.fromId").alias("fromId"), "toId"), "MANAGES_TEAM")

    def has_member(self) -> DataFrame:
        """Teams and the developers whose team id is the team's id or name in the repository; lead is the first developer of that name anywhere."""
        first = first_by(self.rows("developer_entity", "name", "seq").where("name IS NOT NULL"), ["name"], ["seq", "id"], ["id"]).select(F.col("name").alias("lead"), F.col("id").alias("leadId"))
        t = self.rows("team_entity", "name", "repoRoot", "lead").join(first, "lead", "left").select(F.col("id").alias("fromId"), "repoRoot", F.explode(F.array_distinct(F.array_compact(F.array("id", "name")))).alias("teamId"), "leadId")
        d = self.rows("developer_entity", "repoRoot", "teamId", "firstCommit", "totalCommits").select(F.col("id").alias("toId"), "repoRoot", "teamId", F.unix_micros("firstCommit").alias("joinDate"), F.coalesce("totalCommits", F.lit(0)).alias("contributions"))
        j = t.join(d, ["repoRoot", "teamId"]).withColumn("role", F.when(F.col("leadId") == F.col("toId"), "lead").otherwise("member"))
        return self._edge(j, "HAS_MEMBER", "role", "joinDate", "contributions")

    # --- all edges ---
    BUILDERS = (
        "contains", "declares", "has_function", "calls", "provides_api", "uses_api", "queries_table", "uses_config", "reads_from", "writes_to", "transforms", "derives_from", "passes_to", "emits_error", "repo_packages", "shares_package",
        "repo_provides", "repo_uses", "repo_consumes", "belongs_to", "owns_repository", "contributed_to", "committed", "contains_commit", "modified_file", "collaborates_with", "manages_team", "has_member",
    )

    def repo_consumes(self) -> DataFrame:
        """``consumes_api_from`` between the repositories' nodes."""
        r = self.repo_ids
        return (
            self.consumes_api_from().join(r.select(F.col("repoRoot").alias("cRepo"), F.col("id").alias("fromId")), "cRepo").join(r.select(F.col("repoRoot").alias("pRepo"), F.col("id").alias("toId")), "pRepo")
            .select("fromId", F.lit("CONSUMES_API_FROM").alias("type"), "toId", "consumed", "provided", F.col("confidence").alias("matchConfidence"))
        )

    def edges(self) -> DataFrame:
        """fromId, type, toId, relKey, properties (by name, as text, without nulls) of all kinds of edges."""
        out = None
        for name in self.BUILDERS:
            e = getattr(self, name)()
            props = [c for c in e.columns if c not in ("fromId", "type", "toId")]
            held = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in props]), lambda p: p["v"].isNotNull())) if props else F.create_map().cast("map<string,string>")
            part = e.select("fromId", "type", "toId", F.concat_ws("|", "fromId", "type", "toId").alias("relKey"), held.alias("properties"))
            out = part if out is None else out.unionByName(part)
        return out
