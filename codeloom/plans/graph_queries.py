"""Registered graph queries, aggregations, scalar functions and upserts, each with the SQL that it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import store
from ..operators.cycles import call_cycles
from ..operators.graph import NODE_COLUMNS, CodeGraph
from ..session import cut
from ..operators.traversal import closed_by_halves, joined, reach
from . import edge_queries as E
from .base_sql import BASE, BASE_EVENTS, api_path, method, path_id

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
HOPS = 3  # callers and dependencies followed by the impact queries
CYCLE_HOPS = 8
REPO_CYCLE_HOPS = 5
WORDS = ("refund", "gateway")  # of the keyword searches


def query(sql: str | None = None, events: bool = False):
    """Registers a query with its SQL; with ``events`` both run over the scanned functions and those that events stand for."""

    def wrap(f: Callable[[CodeGraph], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(CodeGraph(spark, folder, events))
        if sql is not None:
            SQL[f.__name__] = (BASE_EVENTS if events else BASE) + sql
        return f

    return wrap


def dependencies(g: CodeGraph) -> DataFrame:
    """The six kinds of edges that a change follows."""
    out = g.calls().select("fromId", "toId")
    for e in (g.uses_api(), g.provides_api(), g.queries_table(), g.uses_config(), g.emits_error()):
        out = out.unionByName(e.select("fromId", "toId"))
    return out.distinct()


# --- cycles and impact ---


@query(
    """, tr AS (SELECT fromId AS s, toId AS e, [fromId, toId] AS ns, [fromId || '>' || toId] AS us FROM calls UNION ALL
SELECT t.s, c.toId, list_append(t.ns, c.toId), list_append(t.us, c.fromId || '>' || c.toId) FROM tr t JOIN calls c ON c.fromId = t.e WHERE len(t.us) < 8 AND NOT list_contains(t.us, c.fromId || '>' || c.toId)),
cy AS (SELECT s, len(us) + 1 AS n, array_to_string(ns, ',') AS trail, ns FROM tr WHERE s = e), pt AS (SELECT trail, unnest(ns) AS id FROM cy)
SELECT cy.s AS start, cy.n AS cycleLength, cy.trail, array_to_string(list_sort(list(DISTINCT f.name)), ',') AS functions, array_to_string(list_sort(list(DISTINCT f.file)), ',') AS files FROM cy JOIN pt USING (trail) JOIN fn f ON f.id = pt.id GROUP BY 1, 2, 3""",
    events=True,
)
def q01_call_cycles(g: CodeGraph, scope: str | None = None) -> DataFrame:
    """Closed trails of up to eight calls, a row for each start, with the functions and files on them; with ``scope`` those with a file that contains it."""
    out = call_cycles(g.fn("name", "repoRoot", "file", "calls"), CYCLE_HOPS)
    return out if scope is None else out.where(F.lower("files").contains(scope.lower()))


def _repo_edges(g: CodeGraph) -> DataFrame:
    return g.consumes_api_from().select(F.col("cRepo").alias("fromId"), F.col("pRepo").alias("toId"))


@query(
    E.J24_CTES
    + """, tr AS (SELECT fromId AS s, toId AS e, [fromId, toId] AS ns, [fromId || '>' || toId] AS us FROM rr UNION ALL
SELECT t.s, c.toId, list_append(t.ns, c.toId), list_append(t.us, c.fromId || '>' || c.toId) FROM tr t JOIN rr c ON c.fromId = t.e WHERE len(t.us) < 5 AND NOT list_contains(t.us, c.fromId || '>' || c.toId))
SELECT array_to_string(ns, ',') AS repositories, len(us) AS hops FROM tr WHERE s = e""",
    events=True,
)
def q02_repo_cycles(g: CodeGraph) -> DataFrame:
    return closed_by_halves(_repo_edges(g), REPO_CYCLE_HOPS).select(F.array_join("nodes", ",").alias("repositories"), F.col("hops").cast("bigint").alias("hops"))


@query(
    f""", prov AS (SELECT DISTINCT {method("method")} AS method, route, repoRoot, file, id FROM api WHERE direction = 'provided'),
cl AS (SELECT DISTINCT fromId AS caller, toId AS fnId, 1 AS h FROM calls UNION SELECT c.fromId, x.fnId, x.h + 1 FROM cl x JOIN calls c ON c.toId = x.caller WHERE x.h < 3),
inner_f AS (SELECT p.id, p.file, array_to_string(list_sort(list(DISTINCT f.file)), ',') AS files FROM prov p JOIN provides e ON e.toId = p.id JOIN fn o ON o.id = e.fromId AND o.file = p.file JOIN cl ON cl.fnId = e.fromId JOIN fn f ON f.id = cl.caller GROUP BY 1, 2),
cons AS (SELECT DISTINCT p.method, p.route, f.repoRoot, f.file FROM prov p JOIN api a ON a.direction = 'consumed' AND contains(lower(a.route), lower(p.route)) AND {method("a.method")} = p.method JOIN uses u ON u.toId = a.id JOIN fn f ON f.id = u.fromId),
cons2 AS (SELECT method, route, array_to_string(list_sort(list(DISTINCT repoRoot)), ',') AS repos, array_to_string(list_sort(list(DISTINCT file)), ',') AS files FROM cons GROUP BY 1, 2)
SELECT p.method, p.route, p.repoRoot AS providerRepo, p.file AS providerFile, coalesce(i.files, '') AS internalAffectedFiles, coalesce(c.repos, '') AS consumerRepos, coalesce(c.files, '') AS consumerFiles
FROM prov p LEFT JOIN inner_f i ON i.id = p.id AND i.file = p.file LEFT JOIN cons2 c ON c.method = p.method AND c.route = p.route"""
)
def q03_endpoint_impact(g: CodeGraph) -> DataFrame:
    g.keep_functions()
    prov = g.apis.where("direction = 'provided'").select(P.method_of(F.col("method")).alias("method"), "route", "repoRoot", "file", "id").distinct()
    back = g.calls().select(F.col("toId").alias("fromId"), F.col("fromId").alias("toId"))
    own = g.provides_api().select(F.col("fromId").alias("node"), F.col("toId").alias("id"))
    f = g.fn("file").withColumnRenamed("id", "node")
    mine = own.join(f, "node").join(prov.select("id", "file"), ["id", "file"])
    callers = reach(mine.select(F.concat_ws("|", "id", "file").alias("seed"), "node"), back, HOPS).where("hop > 0").join(f, "node").groupBy("seed").agg(joined("file").alias("internalAffectedFiles"))
    # containment by equality: each distinct consumed URL emits its substrings of the lengths that routes have
    routes = prov.select(F.lower("route").alias("low")).distinct()
    sizes = routes.select(F.length("low").alias("k")).distinct()
    urls = g.apis.where("direction = 'consumed'").select("id", F.lower("route").alias("url"), P.method_of(F.col("method")).alias("method")).distinct()
    cut = urls.select("url").distinct().join(F.broadcast(sizes), F.length("url") >= F.col("k")).select("url", "k", F.explode(F.sequence(F.lit(1), F.length("url") - F.col("k") + 1)).alias("s"))
    hits = cut.select("url", F.col("url").substr(F.col("s"), F.col("k")).alias("low")).distinct().join(routes, "low")
    users = g.uses_api().select(F.col("fromId").alias("node"), F.col("toId").alias("id")).join(g.fn("repoRoot", "file").withColumnRenamed("id", "node"), "node")
    cons = hits.join(urls, "url").join(users, "id").groupBy("low", "method").agg(joined("repoRoot").alias("consumerRepos"), joined("file").alias("consumerFiles"))
    out = prov.withColumn("seed", F.concat_ws("|", "id", "file")).withColumn("low", F.lower("route")).join(callers, "seed", "left").join(cons, ["low", "method"], "left")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select("method", "route", F.col("repoRoot").alias("providerRepo"), F.col("file").alias("providerFile"), blank("internalAffectedFiles"), blank("consumerRepos"), blank("consumerFiles"))


LISTS = {"Function": "functions", "Class": "classes", "Config": "configKeys", "DatabaseTable": "tables", "ErrorMessage": "errors", "Test": "testFiles"}  # listed by name and file


def impact(g: CodeGraph, hops: int, seeds: DataFrame | None = None) -> DataFrame:
    """Of each file, what a change of it touches within ``hops`` dependencies: files, provided and consumed endpoints, and the lists of LISTS; each sorted, as text.

    A node's name and file are those of the node; files are all that contain it.  ``seeds``: file_info's ids of files, all if None.
    """
    g.keep_functions().keep("files", "classes", "errors")
    held = cut(g.contains().select(F.col("fromId").alias("seed"), F.col("toId").alias("node")))
    own = held if seeds is None else held.join(seeds.select(F.col("id").alias("seed")), "seed", "left_semi")
    r = cut(reach(own, dependencies(g), hops).select("seed", "node"))
    files = r.join(held.select("node", F.col("seed").alias("id")), "node").join(g.files.select("id", F.col("file").alias("held")), "id").groupBy("seed").agg(joined("held").alias("affectedFiles"))
    where = lambda c: F.concat(c, F.when(F.col("file").isNull(), "").otherwise(F.concat(F.lit(" @ "), "file")))
    api = g.api_rows().select("id", F.when(F.col("direction") == "provided", "providedApis").otherwise("consumedApis").alias("kind"), where(F.concat_ws(" ", "method", F.coalesce("path", "url"))).alias("label"))
    kinds = F.create_map(*[F.lit(x) for kv in LISTS.items() for x in kv])
    named = g.nodes.where(F.col("type").isin(*LISTS)).select("id", kinds[F.col("type")].alias("kind"), where(F.col("name")).alias("label"))
    hit = r.join(api.unionByName(named).withColumnRenamed("id", "node"), "node")
    lists = [joined(F.when(F.col("kind") == k, F.col("label"))).alias(k) for k in ("providedApis", "consumedApis", *LISTS.values())]
    return files.join(hit.groupBy("seed").agg(*lists), "seed", "left").select(F.col("seed").alias("fileId"), "affectedFiles", *[F.coalesce(k, F.lit("")).alias(k) for k in ("providedApis", "consumedApis", *LISTS.values())])


_AT = "CASE WHEN file IS NULL THEN '' ELSE ' @ ' || file END"
_IMPACT = f""", held AS (SELECT DISTINCT f.id AS seed, n.id AS node FROM fl f JOIN ents n ON n.repoRoot = f.repoRoot AND n.file = f.file WHERE n.id <> f.id),
rc AS (SELECT seed, node, 0 AS h FROM held UNION SELECT r.seed, d.toId, r.h + 1 FROM rc r JOIN dep d ON d.fromId = r.node WHERE r.h < {{h}}), re AS (SELECT DISTINCT seed, node FROM rc),
af AS (SELECT re.seed, array_to_string(list_sort(list(DISTINCT f.file)), ',') AS affectedFiles FROM re JOIN held h ON h.node = re.node JOIN fl f ON f.id = h.seed GROUP BY 1),
lab AS (SELECT id, CASE WHEN direction = 'provided' THEN 'providedApis' ELSE 'consumedApis' END AS kind, verb || ' ' || route || {_AT} AS label FROM apin
 UNION ALL SELECT id, CASE type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LISTS.items())} END, name || {_AT} FROM nodes WHERE type IN ({", ".join(f"'{k}'" for k in LISTS)})),
ls AS (SELECT seed, {", ".join(f"coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (kind = '{k}')), ','), '') AS {k}" for k in ("providedApis", "consumedApis", *LISTS.values()))} FROM re JOIN lab ON lab.id = re.node GROUP BY 1)
SELECT af.seed AS fileId, affectedFiles, {", ".join(f"coalesce({k}, '') AS {k}" for k in ("providedApis", "consumedApis", *LISTS.values()))} FROM af LEFT JOIN ls ON ls.seed = af.seed"""


@query(_IMPACT.replace("{h}", "3"))
def q04_file_impact(g: CodeGraph) -> DataFrame:
    return impact(g, HOPS)


@query(_IMPACT.replace("{h}", "1"))
def q14_impact_depth(g: CodeGraph) -> DataFrame:
    return impact(g, 1)


@query(
    """, held AS (SELECT DISTINCT f.id AS seed, n.id AS node FROM fl f JOIN ents n ON n.repoRoot = f.repoRoot AND n.file = f.file WHERE n.id <> f.id),
rc AS (SELECT seed, node, 0 AS h FROM held UNION SELECT r.seed, d.toId, r.h + 1 FROM rc r JOIN dep d ON d.fromId = r.node WHERE r.h < 3)
SELECT DISTINCT rc.seed AS fileId, f.file FROM rc JOIN held h ON h.node = rc.node JOIN fl f ON f.id = h.seed"""
)
def q19_surface(g: CodeGraph) -> DataFrame:
    held = cut(g.keep_functions().keep("files", "errors").contains().select(F.col("fromId").alias("seed"), F.col("toId").alias("node")))
    r = reach(held, dependencies(g), HOPS).select(F.col("seed").alias("fileId"), "node").join(held, "node").select("fileId", F.col("seed").alias("id")).distinct()
    return r.join(g.files.select("id", "file"), "id").select("fileId", "file").distinct()


# --- listings and searches ---


@query("SELECT method, route AS path, file, repoRoot FROM api WHERE direction = 'provided'")
def q05_provided(g: CodeGraph) -> DataFrame:
    return g.apis.where("direction = 'provided'").select("method", F.col("route").alias("path"), "file", "repoRoot").orderBy("file", "path")


@query("SELECT method, route AS url, file, repoRoot FROM api WHERE direction = 'consumed'")
def q06_consumed(g: CodeGraph) -> DataFrame:
    return g.apis.where("direction = 'consumed'").select("method", F.col("route").alias("url"), "file", "repoRoot").orderBy("file", "url")


@query("SELECT g.name AS callee, f.name AS caller, f.repoRoot, f.file FROM calls c JOIN fn g ON g.id = c.toId JOIN fn f ON f.id = c.fromId")
def q07_who_calls(g: CodeGraph) -> DataFrame:
    f = g.fn("name", "repoRoot", "file")
    callee, caller = f.select(F.col("id").alias("toId"), F.col("name").alias("callee")), f.select(F.col("id").alias("fromId"), F.col("name").alias("caller"), "repoRoot", "file")
    return g.calls().join(callee, "toId").join(caller, "fromId").select("callee", "caller", "repoRoot", "file").orderBy(F.asc_nulls_last("file"), "caller")


@query("SELECT DISTINCT t.name AS key, f.file, f.repoRoot FROM ucfg u JOIN fn f ON f.id = u.fromId JOIN cfg t ON t.id = u.toId")
def q08_configs(g: CodeGraph) -> DataFrame:
    f, c = g.fn("file", "repoRoot").withColumnRenamed("id", "fromId"), g.rows("config_entity", "name").select(F.col("id").alias("toId"), F.col("name").alias("key"))
    return g.uses_config().join(f, "fromId").join(c, "toId").select("key", "file", "repoRoot").distinct().orderBy("key")


def _any_word(*cols: str) -> F.Column:
    cond = F.lit(False)
    for c in cols:
        for w in WORDS:
            cond = cond | F.coalesce(F.lower(F.col(c)).contains(w), F.lit(False))
    return cond


_W = lambda *cols: " OR ".join(f"coalesce(contains(lower({c}), '{w}'), FALSE)" for c in cols for w in WORDS)


@query(f"SELECT DISTINCT direction, {method('method')} AS method, route, file, repoRoot FROM api WHERE {_W('route', 'repoRoot')}")
def q09_api_search(g: CodeGraph) -> DataFrame:
    return g.apis.where(_any_word("route", "repoRoot")).select("direction", P.method_of(F.col("method")).alias("method"), "route", "file", "repoRoot").distinct()


@query(f"SELECT f.name AS caller, f.file AS callerFile, g.name AS callee, g.file AS calleeFile FROM calls c JOIN fn f ON f.id = c.fromId JOIN fn g ON g.id = c.toId WHERE {_W('f.name', 'g.name')}")
def q10_call_search(g: CodeGraph) -> DataFrame:
    f = g.fn("name", "file")
    a, b = f.select(F.col("id").alias("fromId"), F.col("name").alias("caller"), F.col("file").alias("callerFile")), f.select(F.col("id").alias("toId"), F.col("name").alias("callee"), F.col("file").alias("calleeFile"))
    return g.calls().join(a, "fromId").join(b, "toId").where(_any_word("caller", "callee")).select("caller", "callerFile", "callee", "calleeFile")


@query(f"SELECT file, repoRoot FROM fl WHERE {_W('file', 'repoRoot')}")
def q11_file_search(g: CodeGraph) -> DataFrame:
    return g.files.where(_any_word("file", "repoRoot")).select("file", "repoRoot")


def _holds(word: str):
    return lambda v: F.coalesce(F.lower(v).contains(word), F.lit(False))


@query("SELECT type AS labels, id, name, file, repoRoot FROM nodes WHERE " + " AND ".join(f"({' OR '.join(f'coalesce(contains(lower({c}), {chr(39)}{w}{chr(39)}), FALSE)' for c in ('type', 'name', 'file', 'repoRoot', 'id'))})" for w in WORDS))
def q12_generic(g: CodeGraph, words: tuple[str, ...] = WORDS) -> DataFrame:
    """Nodes of all types that have every word in some property."""
    cols = ("type", "name", "file", "repoRoot", "id")
    n = g.nodes.withColumn("props", F.map_from_arrays(F.array(*[F.lit(c) for c in cols]), F.array(*cols)))
    for w in words:
        n = n.where(F.exists(F.map_values("props"), _holds(w)))
    return n.select(F.col("type").alias("labels"), "id", "name", "file", "repoRoot")


@query("SELECT type AS label, count(*) AS cnt FROM nodes GROUP BY 1")
def q15_labels(g: CodeGraph) -> DataFrame:
    return g.nodes.groupBy(F.col("type").alias("label")).agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"))


@query(f"SELECT DISTINCT direction AS dir, {method('method')} AS method, route, file FROM api ORDER BY direction, route, method, file NULLS FIRST LIMIT 25")
def q16_recent_apis(g: CodeGraph) -> DataFrame:
    return g.apis.select(F.col("direction").alias("dir"), P.method_of(F.col("method")).alias("method"), "route", "file").distinct().orderBy("dir", "route", "method", "file").limit(25)


@query("SELECT f.name AS caller, g.name AS callee FROM calls c JOIN fn f ON f.id = c.fromId JOIN fn g ON g.id = c.toId ORDER BY c.fromId, c.toId LIMIT 25")
def q17_call_edges(g: CodeGraph) -> DataFrame:
    f = g.fn("name")
    top = g.calls().orderBy("fromId", "toId").limit(25)
    return top.join(f.select(F.col("id").alias("fromId"), F.col("name").alias("caller")), "fromId").join(f.select(F.col("id").alias("toId"), F.col("name").alias("callee")), "toId").select("caller", "callee")


@query("SELECT f.file, array_to_string(list_sort(list(DISTINCT t.name)), ',') AS keys FROM ucfg u JOIN fn f ON f.id = u.fromId JOIN cfg t ON t.id = u.toId GROUP BY 1 ORDER BY f.file LIMIT 50")
def q18_config_keys(g: CodeGraph) -> DataFrame:
    f, c = g.fn("file").withColumnRenamed("id", "fromId"), g.rows("config_entity", "name").withColumnRenamed("id", "toId")
    return g.uses_config().join(f, "fromId").join(c, "toId").groupBy("file").agg(joined("name").alias("keys")).orderBy("file").limit(50)


@query("SELECT id, repoRoot, file FROM fl")
def q20_seed_lookup(g: CodeGraph) -> DataFrame:
    return g.files.select("id", "repoRoot", "file")


@query("SELECT repoRoot, count(DISTINCT id) FILTER (direction = 'provided') AS provides, count(DISTINCT id) FILTER (direction <> 'provided') AS uses FROM api GROUP BY 1")
def q21_repo_counts(g: CodeGraph) -> DataFrame:
    d = lambda c: F.count_distinct(F.when(c, F.col("id")))
    return g.apis.groupBy("repoRoot").agg(d(F.col("direction") == "provided").alias("provides"), d(F.col("direction") != "provided").alias("uses"))


# --- aggregations ---


@query(
    r""", n AS (SELECT repoRoot, lower(regexp_replace(regexp_replace(trim(author), '\s+', ' ', 'g'), '[^A-Za-z0-9_\s.\-]', '', 'g')) AS person, lower(authorEmail) AS mail, author, count(*) AS c, max({'t': timestamp, 'i': id}) AS latest FROM cm WHERE author IS NOT NULL GROUP BY ALL),
m AS (SELECT repoRoot, person, mail, sum(c) AS c, max(latest) AS latest FROM n GROUP BY 1, 2, 3), nm AS (SELECT repoRoot, person, array_to_string(list_sort(list(DISTINCT author)), ',') AS names, array_to_string(list_sort(list(DISTINCT mail)), ',') AS aliases FROM n GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY repoRoot, person ORDER BY (mail IS NULL), c DESC, latest DESC) AS rn FROM m)
SELECT repoRoot, person, max(mail) FILTER (rn = 1) AS email, sum(c)::BIGINT AS commits, count(DISTINCT mail) AS mails, coalesce(any_value(aliases), '') AS aliases, any_value(names) AS names FROM r JOIN nm USING (repoRoot, person) GROUP BY 1, 2"""
)
def a06_identity(g: CodeGraph) -> DataFrame:
    """Developers of each repository by normalized name: the mail used most (of equals the latest), all mails and all spellings."""
    n = g.rows("commit_entity", "repoRoot", "author", "authorEmail", "timestamp").where("author IS NOT NULL").groupBy("repoRoot", P.person_name(F.col("author")).alias("person"), F.lower("authorEmail").alias("mail"), "author").agg(F.count(F.lit(1)).alias("c"), F.max(F.struct("timestamp", "id")).alias("latest"))
    m = n.groupBy("repoRoot", "person", "mail").agg(F.sum("c").alias("c"), F.max("latest").alias("latest"), F.collect_set("author").alias("names"))
    # a mail is used most, and of equals latest, by the greatest of these; mails that are missing come last
    rank = F.struct(F.col("mail").isNotNull(), "c", "latest")
    return m.groupBy("repoRoot", "person").agg(
        F.max_by("mail", rank).alias("email"), F.sum("c").alias("commits"), F.count_distinct("mail").alias("mails"), joined("mail").alias("aliases"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))), ",").alias("names")
    )


_LANG = "CASE lower(regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.LANGUAGE_BY_ENDING.items()) + " ELSE 'other' END"


@query(
    """, st AS (SELECT k.fromId AS dev, count(*) AS commits, epoch_us(min(c.timestamp)) AS firstCommit, epoch_us(max(c.timestamp)) AS lastCommit FROM committed k JOIN cm c ON c.id = k.toId GROUP BY 1),
fs AS (SELECT k.fromId AS dev, c.file FROM committed k JOIN (SELECT id, unnest(filesChanged) AS file FROM cm) c ON c.id = k.toId), fc AS (SELECT dev, count(DISTINCT file) AS files FROM fs GROUP BY 1),
lg AS (SELECT dev, {LANG} AS language, count(*) AS n FROM fs GROUP BY 1, 2), lc AS (SELECT dev, array_to_string(list_sort(list(language || '=' || n)), ',') AS languages FROM lg GROUP BY 1)
SELECT st.*, coalesce(files, 0) AS files, coalesce(languages, '') AS languages FROM st LEFT JOIN fc ON fc.dev = st.dev LEFT JOIN lc ON lc.dev = st.dev""".replace("{LANG}", _LANG)
)
def a07_dev_stats(g: CodeGraph) -> DataFrame:
    """Commits, first and last of them, distinct files and changed files by language of each developer."""
    c = g.authors().join(g.rows("commit_entity", "timestamp", "filesChanged").withColumnRenamed("id", "toId"), "toId").withColumnRenamed("fromId", "dev")
    st = c.groupBy("dev").agg(F.count(F.lit(1)).alias("commits"), F.unix_micros(F.min("timestamp")).alias("firstCommit"), F.unix_micros(F.max("timestamp")).alias("lastCommit"))
    f = c.select("dev", F.explode("filesChanged").alias("file")).groupBy("dev", "file").agg(F.count(F.lit(1)).alias("n"))
    lang = f.groupBy("dev", P.language(F.col("file")).alias("language")).agg(F.sum("n").alias("n"), F.count("file").alias("files"))
    per = lang.groupBy("dev").agg(F.sum("files").alias("files"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "language", F.col("n").cast("string")))), ",").alias("languages"))
    return st.join(per, "dev", "left").select("dev", "commits", "firstCommit", "lastCommit", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("languages", F.lit("")).alias("languages"))


@query(
    f""", u AS (SELECT k.fromId AS dev, {_LANG} AS language, count(*) AS n FROM (SELECT id, unnest(filesChanged) AS file FROM cm) c JOIN committed k ON k.toId = c.id GROUP BY 1, 2)
SELECT dev, language, n FROM (SELECT *, row_number() OVER (PARTITION BY dev ORDER BY n DESC, language) AS rn FROM u) WHERE rn <= 5 AND language <> 'other'"""
)
def a08_top_languages(g: CodeGraph) -> DataFrame:
    c = g.rows("commit_entity", "filesChanged").select(F.col("id").alias("toId"), F.explode("filesChanged").alias("file"))
    u = g.authors().join(c, "toId").groupBy(F.col("fromId").alias("dev"), P.language(F.col("file")).alias("language")).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("dev").orderBy(F.desc("n"), "language"))
    return u.withColumn("rn", rank).where("rn <= 5 AND language <> 'other'").select("dev", "language", "n")


@query(
    ", fc AS (SELECT repoRoot, array_to_string(list_sort(list(DISTINCT file)), ',') AS fileList FROM (SELECT repoRoot, unnest(filesChanged) AS file FROM cm) GROUP BY 1) SELECT s.*, coalesce(fileList, '') AS fileList FROM (SELECT repoRoot, count(*) AS commits, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions, sum(len(filesChanged))::BIGINT AS files FROM cm GROUP BY 1) s LEFT JOIN fc ON fc.repoRoot = s.repoRoot"
)
def a09_commit_stats(g: CodeGraph) -> DataFrame:
    """Commits, lines and changed files of each repository, with the list of the files."""
    c = g.rows("commit_entity", "repoRoot", "additions", "deletions", "filesChanged")
    sums = c.groupBy("repoRoot").agg(F.count(F.lit(1)).alias("commits"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.sum(F.when(F.col("filesChanged").isNotNull(), F.size("filesChanged"))).alias("files"))
    listed = c.select("repoRoot", F.explode("filesChanged").alias("file")).groupBy("repoRoot").agg(joined("file").alias("fileList"))
    return sums.join(listed, "repoRoot", "left").withColumn("fileList", F.coalesce("fileList", F.lit("")))


@query("SELECT r.repoRoot, CASE WHEN p > 0 AND c > 0 THEN 'both' WHEN p > 0 THEN 'provider' WHEN c > 0 THEN 'consumer' ELSE 'none' END AS class FROM (SELECT DISTINCT repoRoot FROM repo) r LEFT JOIN (SELECT repoRoot, count(*) FILTER (direction = 'provided') AS p, count(*) FILTER (direction <> 'provided') AS c FROM api GROUP BY 1) a ON a.repoRoot = r.repoRoot")
def a16_repo_class(g: CodeGraph) -> DataFrame:
    a = g.apis.groupBy("repoRoot").agg(F.count_if(F.col("direction") == "provided").alias("p"), F.count_if(F.col("direction") != "provided").alias("c"))
    kind = F.when((F.col("p") > 0) & (F.col("c") > 0), "both").when(F.col("p") > 0, "provider").when(F.col("c") > 0, "consumer").otherwise("none")
    return g.rows("repository_entity", "repoRoot").select("repoRoot").distinct().join(a, "repoRoot", "left").select("repoRoot", kind.alias("class"))


@query("SELECT repoRoot, file, count(*) AS endpoints, array_to_string(list_sort(list(DISTINCT route)), ',') AS routes FROM api WHERE direction = 'provided' GROUP BY 1, 2")
def a17_provided_listing(g: CodeGraph) -> DataFrame:
    return g.apis.where("direction = 'provided'").groupBy("repoRoot", "file").agg(F.count(F.lit(1)).alias("endpoints"), joined("route").alias("routes"))


# --- scalar functions over the tables ---


@query(f"SELECT DISTINCT route, {path_id('route')} AS path FROM api")
def f02_path_id(g: CodeGraph) -> DataFrame:
    return g.apis.select("route").distinct().select("route", P.path_id(F.col("route")).alias("path"))


@query(f"SELECT DISTINCT route, {api_path('route')} AS path FROM api")
def f07_api_path(g: CodeGraph) -> DataFrame:
    return g.apis.select("route").distinct().select("route", P.api_path(F.col("route")).alias("path"))


@query(r"SELECT DISTINCT name, lower(regexp_replace(regexp_replace(trim(name), '\s+', ' ', 'g'), '[^A-Za-z0-9_\s.\-]', '', 'g')) AS normalized FROM dev WHERE name IS NOT NULL")
def f13_name(g: CodeGraph) -> DataFrame:
    return g.rows("developer_entity", "name").where("name IS NOT NULL").select("name").distinct().select("name", P.person_name(F.col("name")).alias("normalized"))


@query(f"SELECT file, {_LANG} AS language, count(*) AS n FROM fl GROUP BY ALL")
def f14_language(g: CodeGraph) -> DataFrame:
    return g.files.groupBy("file", P.language(F.col("file")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


@query(
    r"""SELECT DISTINCT name, coalesce(nullif(regexp_extract(name, '^(find|read|get|query|search|stream)(?:One|First|Top|Distinct|All)?By.+$', 1), ''), nullif(regexp_extract(name, '^(count)(?:Distinct)?By.+$', 1), ''), nullif(regexp_extract(name, '^(exists)By.+$', 1), ''), nullif(regexp_extract(name, '^(delete|remove)(?:All)?By.+$', 1), ''),
 CASE WHEN regexp_matches(name, '^(save|persist|store|insert|update)') THEN 'save' WHEN regexp_matches(name, '^(delete|remove)') THEN 'delete' WHEN regexp_matches(name, '^(find|get|load|fetch)All$') THEN 'findAll' END) AS operation FROM fn WHERE name IS NOT NULL"""
)
def f15_method_name(g: CodeGraph) -> DataFrame:
    return g.fn("name").where("name IS NOT NULL").select("name").distinct().select("name", P.query_operation(F.col("name")).alias("operation"))


@query(r"SELECT doc_id, len(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9_/.\-\s]', ' ', 'g'), '\s+'), lambda w: w <> '')) AS words FROM documents WHERE text IS NOT NULL")
def f28_tokens(g: CodeGraph) -> DataFrame:
    return g.raw("documents").where("text IS NOT NULL").select("doc_id", F.size(P.keywords(F.col("text"))).cast("bigint").alias("words"))


# --- upserts ---


@query(
    """, b AS (SELECT id, 'h' AS half, nullif(file, '') AS file, method, route FROM api WHERE direction = 'provided'),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file NULLS FIRST, route, method NULLS FIRST) AS rn, arg_min(method, rk) FILTER (method IS NOT NULL) OVER (PARTITION BY id) AS m FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file NULLS FIRST, route, method NULLS FIRST) AS rk FROM b))
SELECT id, file, m AS method, route AS path, 'v2' AS snapshotVersion FROM o WHERE rn = 1"""
)
def k02_last_write(g: CodeGraph) -> DataFrame:
    """Provided API nodes after two ingests: within a batch a missing field is filled from later rows of the id; between batches the last one's fields stand."""
    a = g.apis.where("direction = 'provided'").select("id", F.nullif("file", F.lit("")).alias("file"), "method", F.col("route").alias("path"))
    batch = store.coalesce_batch(a, "id", ["file", "path", "method"])
    old = batch.select("id", F.lit("gone").alias("file"), F.lit("OLD").alias("method"), "path", F.lit("v1").alias("snapshotVersion"))
    return store.merge_last(old, batch.withColumn("snapshotVersion", F.lit("v2")), "id")


@query("SELECT id, totalCommits, snapshotVersion FROM (SELECT id, arg_max(totalCommits, (snapshotVersion, totalCommits)) AS totalCommits, max(snapshotVersion) AS snapshotVersion FROM developer_entity WHERE id IS NOT NULL GROUP BY 1)")
def k02_newest_developers(g: CodeGraph) -> DataFrame:
    """Developers after all deliveries: the newest snapshot's values win."""
    d = g.raw("developer_entity").where("id IS NOT NULL")
    return d.groupBy("id").agg(F.max_by("totalCommits", F.struct("snapshotVersion", "totalCommits")).alias("totalCommits"), F.max("snapshotVersion").alias("snapshotVersion"))


@query("SELECT id, to_json({'firstCommit': epoch_us(firstCommit), 'primaryLanguages': CASE WHEN primaryLanguages IS NULL THEN NULL ELSE '[' || array_to_string(list_transform(primaryLanguages, lambda x: '\"' || x || '\"'), ',') || ']' END})::VARCHAR AS metaJson FROM dev")
def k04_meta(g: CodeGraph) -> DataFrame:
    """Metadata as one JSON text: primitives stay, others are texts of JSON within it."""
    d = g.rows("developer_entity", "firstCommit", "primaryLanguages")
    return d.select("id", store.meta_json({"firstCommit": F.unix_micros("firstCommit"), "primaryLanguages": F.col("primaryLanguages")}, nested=("primaryLanguages",)).alias("metaJson"))


_CUT = "2023-07-01"


@query(
    f""", a AS (SELECT id, arg_min(name, (seq, snapshotVersion)) AS name, max(snapshotVersion) AS snapshotVersion FROM config_entity WHERE snapshotVersion < '{_CUT}' AND id IS NOT NULL GROUP BY 1), b AS (SELECT id, arg_min(name, (seq, snapshotVersion)) AS name, max(snapshotVersion) AS snapshotVersion FROM config_entity WHERE snapshotVersion >= '{_CUT}' AND id IS NOT NULL GROUP BY 1)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NOT NULL THEN a.name ELSE b.name END AS name, coalesce(b.snapshotVersion, a.snapshotVersion) AS snapshotVersion FROM a FULL JOIN b ON a.id = b.id"""
)
def k03_first_write(g: CodeGraph) -> DataFrame:
    """Config nodes after two ingests: what was written first stays, the snapshot is renewed."""
    c = g.raw("config_entity").where("id IS NOT NULL")
    part = lambda cond: c.where(cond).groupBy("id").agg(F.min_by("name", F.struct("seq", "snapshotVersion")).alias("name"), F.max("snapshotVersion").alias("snapshotVersion"))
    return store.merge_first(part(F.col("snapshotVersion") < _CUT), part(F.col("snapshotVersion") >= _CUT), "id")


@query("SELECT fromId, 'CALLS' AS type, toId, s AS snapshotVersion FROM calls, (SELECT unnest(['v1', 'v2']) AS s)")
def k05_edge_versions(g: CodeGraph) -> DataFrame:
    """A rescan adds a parallel edge for its snapshot; edges without both ends are left out."""
    e, n = g.calls(), g.fn()
    return store.upsert_edges(store.upsert_edges(None, e, n, "v1"), e.unionByName(e), n, "v2")


_MONO = "/srv/scan/corvane/platform-monorepo"


@query(f"SELECT c.fromId, c.toId FROM calls c JOIN fn f ON f.id = c.fromId WHERE f.repoRoot <> '{_MONO}'")
def k07_repo_reset(g: CodeGraph) -> DataFrame:
    """Call edges that are left when one repository is taken out of the graph."""
    return store.reset_repository(g.fn("repoRoot"), g.calls().select("fromId", "toId"), _MONO)[1]


_CLEAN = """, gone AS (SELECT DISTINCT id FROM api WHERE repoRoot = '{mono}' AND direction {op} 'provided'), ed AS (SELECT r.id AS fromId, '{kind}' AS type, a.id AS toId FROM repo r JOIN (SELECT DISTINCT repoRoot, id, direction FROM api) a ON a.repoRoot = r.repoRoot AND a.direction {op} 'provided' UNION SELECT fromId, '{own}', toId FROM {edges})
SELECT fromId, type, toId, (SELECT count(*) FROM ed) AS before FROM ed WHERE toId NOT IN (SELECT id FROM gone)"""


def _cleaned(g: CodeGraph, provided: bool) -> DataFrame:
    nodes = g.apis.select("id", "repoRoot", "direction").distinct()
    edges = (g.repo_provides() if provided else g.repo_uses()).unionByName(g.provides_api() if provided else g.uses_api())
    _, kept = store.cleanup_apis(nodes, edges, _MONO, provided)
    return kept.crossJoin(edges.agg(F.count(F.lit(1)).alias("before")))  # one row


@query(_CLEAN.format(mono=_MONO, op="=", kind="REPO_PROVIDES_API", own="PROVIDES_API", edges="provides"))
def k08_cleanup_provided(g: CodeGraph) -> DataFrame:
    """Edges to provided endpoints that are left when one repository's are taken out with their edges, and the number before."""
    return _cleaned(g, True)


@query(_CLEAN.format(mono=_MONO, op="<>", kind="REPO_USES_API", own="USES_API", edges="uses"))
def k09_cleanup_consumed(g: CodeGraph) -> DataFrame:
    """The same for consumed endpoints."""
    return _cleaned(g, False)


# --- extraction from the files ---


@query(r"SELECT DISTINCT fileId, regexp_extract(line, 'process\.env\.([A-Za-z_]\w*)', 1) AS key FROM lines WHERE regexp_matches(line, 'process\.env\.[A-Za-z_]\w*')")
def e09_config_keys(g: CodeGraph) -> DataFrame:
    key = F.regexp_extract("line", r"process\.env\.([A-Za-z_]\w*)", 1)
    return g.lines.select("fileId", key.alias("key")).where("key <> ''").distinct()


@query("SELECT DISTINCT fileId, line AS ln, message FROM err")
def e10_errors(g: CodeGraph) -> DataFrame:
    return g.errors.select("fileId", F.col("line").alias("ln"), "message")


@query(
    "SELECT fileId, CASE WHEN contains(lower(content), 'jest') THEN 'jest' WHEN contains(lower(content), 'mocha') THEN 'mocha' WHEN contains(lower(content), 'pytest') THEN 'pytest' WHEN contains(lower(content), 'unittest') THEN 'unittest' WHEN contains(lower(content), 'junit') THEN 'junit' WHEN contains(lower(content), 'xunit') THEN 'xunit' WHEN contains(lower(content), 'nunit') THEN 'nunit' END AS framework FROM txt"
)
def e11_test_framework(g: CodeGraph) -> DataFrame:
    return g.texts.select("fileId", P.test_framework(F.col("content")).alias("framework")).distinct()


@query("SELECT repoRoot, file, name, spanStart, spanEnd FROM cls")
def e04_classes(g: CodeGraph) -> DataFrame:
    return g.classes.select("repoRoot", "file", "name", "spanStart", "spanEnd")


_DECLARED = r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)"


@query(rf"SELECT DISTINCT fileId, ln, regexp_extract(line, '{_DECLARED}', 1) AS name FROM lines WHERE regexp_matches(lower(file), '\.(?:js|jsx|ts|tsx)$') AND regexp_matches(line, '{_DECLARED}')")
def e04_variables(g: CodeGraph) -> DataFrame:
    """Variables that JavaScript and TypeScript files declare, the first of each declaration."""
    rows = g.lines.where(F.lower("file").rlike(r"\.(?:js|jsx|ts|tsx)\z") & F.col("line").rlike(_DECLARED))
    return rows.select("fileId", "ln", F.regexp_extract("line", _DECLARED, 1).alias("name")).distinct()


# An annotation belongs to the next line that is none; one before a class is the class's.
_ANN, _MAP, _PATH = r"^\s*@[A-Za-z]", r"@(Get|Post|Put|Delete|Patch|Request)Mapping\b", r"Mapping\([^\x22]*\x22([^\x22]*)\x22"
_VERB = r"RequestMethod\.(GET|POST|PUT|DELETE|PATCH)"


@query(
    rf""", al AS (SELECT DISTINCT fileId, repoRoot, file, ln, line FROM lines WHERE ends_with(lower(file), '.java')),
an AS (SELECT *, min(ln) FILTER (NOT regexp_matches(line, '{_ANN}') AND trim(line) <> '') OVER (PARTITION BY fileId ORDER BY ln ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS target FROM al),
hd AS (SELECT a.fileId, a.ln, a.target, a.line, c.id AS cls FROM an a LEFT JOIN cls c ON c.repoRoot = a.repoRoot AND c.file = a.file AND c.spanStart = a.target WHERE regexp_matches(a.line, '{_ANN}')),
ct AS (SELECT cls, bool_or(regexp_matches(line, '@(?:Rest)?Controller\b')) AS controller, max(nullif(regexp_extract(line, '@Request{_PATH}', 1), '')) AS base FROM hd WHERE cls IS NOT NULL GROUP BY 1),
me AS (SELECT a.fileId, a.repoRoot, a.file, a.ln, a.line FROM an a JOIN hd h ON h.fileId = a.fileId AND h.ln = a.ln WHERE h.cls IS NULL AND regexp_matches(a.line, '{_MAP}')),
en AS (SELECT m.*, c.id AS cls, row_number() OVER (PARTITION BY m.fileId, m.ln ORDER BY c.spanStart DESC NULLS LAST) AS rn FROM me m LEFT JOIN cls c ON c.repoRoot = m.repoRoot AND c.file = m.file AND m.ln BETWEEN c.spanStart AND c.spanEnd),
pt AS (SELECT en.*, coalesce(ct.controller, FALSE) AS controller, regexp_replace(coalesce(ct.base, ''), '/$', '') AS base, regexp_extract(line, '{_PATH}', 1) AS own, regexp_extract(line, '{_MAP}', 1) AS verb, upper(regexp_extract(line, '(?i){_VERB}', 1)) AS asked FROM en LEFT JOIN ct ON ct.cls = en.cls WHERE rn = 1),
fp AS (SELECT *, base || CASE WHEN own <> '' AND NOT starts_with(own, '/') THEN '/' ELSE '' END || own AS path FROM pt)
SELECT fileId, ln, CASE WHEN starts_with(path, '/') THEN path ELSE '/' || path END AS path, CASE WHEN verb <> 'Request' THEN upper(verb) WHEN asked <> '' THEN asked ELSE 'GET' END AS method, controller FROM fp"""
)
def e14_spring_endpoints(g: CodeGraph) -> DataFrame:
    """Endpoints of mapping annotations on Java methods: the class's base path and the method's, the verb, and whether the class is a controller (others provide nothing)."""
    l = g.lines.where(F.lower("file").endswith(".java")).select("fileId", "repoRoot", "file", "ln", "line").distinct()
    noted = F.col("line").rlike(_ANN)
    ahead = Window.partitionBy("fileId").orderBy("ln").rowsBetween(1, Window.unboundedFollowing)
    a = l.withColumn("target", F.min(F.when(~noted & (F.trim("line") != ""), F.col("ln"))).over(ahead)).where(noted)
    c = g.classes.select(F.col("id").alias("cls"), "repoRoot", "file", "spanStart", "spanEnd")
    h = cut(a.join(c.select("cls", "repoRoot", "file", F.col("spanStart").alias("target")), ["repoRoot", "file", "target"], "left"))
    base = F.nullif(F.regexp_extract("line", "@Request" + _PATH, 1), F.lit(""))
    heads = h.where("cls IS NOT NULL").groupBy("cls").agg(F.bool_or(F.col("line").rlike(r"@(?:Rest)?Controller\b")).alias("controller"), F.max(base).alias("base"))
    m = h.where(F.col("cls").isNull() & F.col("line").rlike(_MAP)).select("fileId", "repoRoot", "file", "ln", "line")
    inner = m.join(c, ["repoRoot", "file"], "left").where("cls IS NULL OR ln BETWEEN spanStart AND spanEnd").groupBy("fileId", "ln").agg(F.max_by("cls", "spanStart").alias("cls"))
    j = m.join(inner, ["fileId", "ln"], "left").join(heads, "cls", "left")
    own, verb, asked = F.regexp_extract("line", _PATH, 1), F.regexp_extract("line", _MAP, 1), F.upper(F.regexp_extract("line", "(?i)" + _VERB, 1))
    path = F.concat(F.regexp_replace(F.coalesce("base", F.lit("")), r"/\z", ""), F.when((own != "") & ~own.startswith("/"), "/").otherwise(""), own)
    return j.select(
        "fileId", "ln", F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)).alias("path"), F.when(verb != "Request", F.upper(verb)).when(asked != "", asked).otherwise("GET").alias("method"), F.coalesce("controller", F.lit(False)).alias("controller")
    )


@query("SELECT id, name, repoRoot FROM (SELECT *, row_number() OVER (PARTITION BY repoRoot ORDER BY seq, id) AS rn FROM repo) WHERE rn = 1")
def s15_repositories(g: CodeGraph) -> DataFrame:
    return g.repo_ids.select("id", "name", "repoRoot")


_BODY = r"(?m)^[ \t]*(?:(?:export|public|private|protected|internal|declare|const)\s+)*(?:interface|enum)\s+([A-Za-z_]\w*)[^{};=]*\{([^{}]*)\}"
_MEMBER = r"(?m)(?:^|[;,{])[ \t]*(?:readonly\s+)?([A-Za-z_]\w*)[ \t]*(?:\??:[^;,\n]*|=[^;,\n]*)?"


@query("SELECT fileId, ln, kind, name FROM tdef")
def e20_type_definitions(g: CodeGraph) -> DataFrame:
    return g.type_definitions.select("fileId", "ln", "kind", "name")


@query(
    rf", td AS (SELECT fileId, unnest(regexp_extract_all(content, '{_BODY}', 0)) AS whole FROM txt), tb AS (SELECT fileId, regexp_extract(whole, '{_BODY}', 1) AS name, regexp_extract(whole, '{_BODY}', 2) AS body FROM td) SELECT DISTINCT fileId, name, unnest(regexp_extract_all(body, '{_MEMBER}', 1)) AS member FROM tb"
)
def e20_type_members(g: CodeGraph) -> DataFrame:
    """Properties of interfaces and values of enums, of definitions without braces within."""
    whole = g.texts.select("fileId", F.explode(F.regexp_extract_all("content", F.lit(_BODY), 0)).alias("whole")).distinct()
    body = whole.select("fileId", F.regexp_extract("whole", _BODY, 1).alias("name"), F.regexp_extract("whole", _BODY, 2).alias("body"))
    return body.select("fileId", "name", F.explode(F.regexp_extract_all("body", F.lit(_MEMBER), 1)).alias("member")).distinct()


_FIELD = r"^\s*(public|private|protected)\s+(?:static\s+|final\s+|readonly\s+|const\s+)*([\w<>\[\], .?]+?)\s+([A-Za-z_]\w*)\s*(?:=[^=].*|;\s*)$"


@query(
    rf""", fd AS (SELECT DISTINCT fileId, repoRoot, file, ln, regexp_extract(line, '{_FIELD}', 1) AS visibility, regexp_extract(line, '{_FIELD}', 2) AS fieldType, regexp_extract(line, '{_FIELD}', 3) AS name FROM lines WHERE regexp_matches(lower(file), '\.(?:java|cs)$') AND regexp_matches(line, '{_FIELD}')),
cf AS (SELECT fd.*, c.name AS class, row_number() OVER (PARTITION BY fd.fileId, fd.ln ORDER BY c.spanStart DESC) AS rn FROM fd JOIN cls c ON c.repoRoot = fd.repoRoot AND c.file = fd.file AND fd.ln BETWEEN c.spanStart AND c.spanEnd)
SELECT fileId, ln, class, name, fieldType, visibility FROM cf WHERE rn = 1"""
)
def e21_fields(g: CodeGraph) -> DataFrame:
    """Fields of Java and C# classes with type and visibility, under the innermost class around them."""
    l = g.lines.where(F.lower("file").rlike(r"\.(?:java|cs)\z") & F.col("line").rlike(_FIELD))
    part = lambda k: F.regexp_extract("line", _FIELD, k)
    f = l.select("fileId", "repoRoot", "file", "ln", part(1).alias("visibility"), part(2).alias("fieldType"), part(3).alias("name")).distinct()
    c = g.classes.select("repoRoot", "file", F.col("name").alias("class"), "spanStart", "spanEnd")
    return f.join(c, ["repoRoot", "file"]).where("ln BETWEEN spanStart AND spanEnd").groupBy("fileId", "ln", "name", "fieldType", "visibility").agg(F.max_by("class", "spanStart").alias("class"))


@query(
    r"""SELECT fileId, regexp_matches(lower(content), '\b(?:from\s+[''"](?:express|fastify|koa|hapi|restify)[''"]|require\([''"](?:express|fastify|koa|hapi|restify)[''"]\))') OR regexp_matches(lower(content), '\b(?:createserver\s*\(|express\s*\(|fastify\s*\(|new\s+koa\s*\(|restify\.)') AS server,
 regexp_matches(lower(content), '\bfrom\s+[''"](?:react|react-dom|next|vite|vue|@angular/core)[''"]') AS frontend FROM txt WHERE regexp_matches(lower(file), '\.(?:js|jsx|ts|tsx)$')"""
)
def e08_context(g: CodeGraph) -> DataFrame:
    """Whether a JavaScript or TypeScript file looks like a server's or a page's."""
    t = g.texts.where(F.lower("file").rlike(r"\.(?:js|jsx|ts|tsx)\z"))
    return t.select("fileId", P.server_context(F.col("content")).alias("server"), P.frontend_context(F.col("content")).alias("frontend")).distinct()


@query("SELECT id, repoRoot, file, framework FROM tst")
def e25_tests(g: CodeGraph) -> DataFrame:
    return g.tests.select("id", "repoRoot", "file", "framework")


@query(E.counts())
def a15_edge_counts(g: CodeGraph) -> DataFrame:
    """Edges of each type."""
    return g.keep_functions("seq", "derives", "passesTo").keep("files", "classes", "errors", "variables", "packages").edges().groupBy("type").agg(F.count(F.lit(1)).alias("cnt"))


@query("SELECT (SELECT count(*) FROM fl) AS files, (SELECT count(*) FROM fn) AS functions, (SELECT count(*) FROM cfg) AS configs, (SELECT count(*) FROM repo) AS repositories, (SELECT count(*) FROM dev) AS developers, (SELECT count(*) FROM cm) AS commits")
def a14_summary(g: CodeGraph) -> DataFrame:
    """Counts of a scan's entities."""
    parts = {"files": g.files, "functions": g.fn(), "configs": g.rows("config_entity"), "repositories": g.rows("repository_entity"), "developers": g.rows("developer_entity"), "commits": g.rows("commit_entity")}
    out = None
    for name, df in parts.items():
        n = df.agg(F.count(F.lit(1)).alias(name))
        out = n if out is None else out.join(n, F.lit(True))  # single rows
    return out


@query(r"SELECT fl.fileId, regexp_matches(lower(fl.file), '\.test\.|\.spec\.') OR fw.framework IS NOT NULL AS isTest FROM fl LEFT JOIN fw ON fw.fileId = fl.fileId")
def pr15_test_files(g: CodeGraph) -> DataFrame:
    named = g.texts.where(P.test_framework(F.col("content")).isNotNull()).select("fileId", F.lit(True).alias("named")).distinct()
    return g.files.select("fileId", "file").join(named, "fileId", "left").select("fileId", (F.lower("file").rlike(r"\.test\.|\.spec\.") | F.col("named").isNotNull()).alias("isTest"))


@query("SELECT type, count(*) AS n, count(name) AS names, count(repoRoot) AS roots, count(file) AS files FROM ents GROUP BY 1")
def pr01_entities(g: CodeGraph) -> DataFrame:
    """Entities of each type before those of one id fall together."""
    return g.entities("name", "repoRoot", "file").distinct().groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count("name").alias("names"), F.count("repoRoot").alias("roots"), F.count("file").alias("files"))


@query("SELECT id, 'Function' AS type, name, repoRoot, file, language, spanStart, spanEnd, snapshotVersion, metaJson, NULL::BIGINT AS size, CASE WHEN params IS NULL THEN NULL ELSE to_json(params)::VARCHAR END AS params, returns, NULL::VARCHAR AS table, NULL::VARCHAR AS valueSample, NULL::VARCHAR AS framework, NULL::VARCHAR AS message FROM fn UNION ALL SELECT id, 'Config', name, repoRoot, file, language, spanStart, spanEnd, snapshotVersion, metaJson, NULL, NULL, NULL, NULL, valueSample, NULL, NULL FROM cfg")
def pr02_node_projection(g: CodeGraph) -> DataFrame:
    """Functions and configurations with all columns of a stored node."""
    return g.entities(*NODE_COLUMNS[2:]).where("type IN ('Function', 'Config')").select(*NODE_COLUMNS)


@query("SELECT id, 'API' AS type, verb || ' ' || route AS name, repoRoot, file, NULL::VARCHAR AS language, NULL::INT AS spanStart, NULL::INT AS spanEnd, direction, verb AS method, CASE WHEN direction = 'provided' THEN route END AS path, CASE WHEN direction <> 'provided' THEN route END AS url, NULL::VARCHAR AS snapshotVersion, NULL::VARCHAR AS metaJson FROM apin")
def pr03_api_projection(g: CodeGraph) -> DataFrame:
    """API nodes with all columns of a stored one."""
    return g.api_rows()


@query("SELECT fromId || '|CALLS|' || toId AS relKey, fromId, toId, 'v1' AS snapshotVersion FROM calls")
def pr04_edge_rows(g: CodeGraph) -> DataFrame:
    return g.calls().select(F.concat_ws("|", "fromId", "type", "toId").alias("relKey"), "fromId", "toId", F.lit("v1").alias("snapshotVersion"))


_HTTP = r"(?i)^(?:fetch|axios|request)$|\.(?:get|post|put|delete|patch)$|^(?:superagent|got|needle)\.|axios"
_ROUTES = r"(?i)^(?:app|router|server|fastify|koa|hapi|restify)\.(?:get|post|put|delete|patch)$"


@query(
    rf"SELECT DISTINCT c AS callee, NOT regexp_matches(c, '{_ROUTES}') AND regexp_matches(c, '{_HTTP}') AS http, nullif(upper(regexp_extract(c, '(?i)(?:^|\.)(get|post|put|delete|patch)$', 1)), '') AS method FROM (SELECT unnest(calls) AS c FROM fn UNION ALL SELECT regexp_extract(line, '([A-Za-z_$][\w$.]*)\(', 1) FROM lines WHERE regexp_matches(line, '[A-Za-z_$][\w$.]*\(')) WHERE c IS NOT NULL"
)
def f05_http_calls(g: CodeGraph) -> DataFrame:
    """Callees, as listed and as the first call of each line, that are HTTP clients' calls, and their verb."""
    listed = g.fn("calls").select(F.explode("calls").alias("callee"))
    seen = g.lines.where(F.col("line").rlike(r"[A-Za-z_$][\w$.]*\(")).select(F.regexp_extract("line", r"([A-Za-z_$][\w$.]*)\(", 1).alias("callee"))
    c = listed.unionByName(seen).where("callee IS NOT NULL").distinct()
    return c.select("callee", P.is_http_call(F.col("callee")).alias("http"), P.method_in_name(F.col("callee")).alias("method"))


_SIGNATURE = r"^\s*((?:(?:public|private|protected|static|final|abstract|synchronized|async|override|virtual|sealed|internal)\s+)*)[\w<>\[\], .?]+\s+[A-Za-z_]\w*\s*\([^;]*\)[^;=]*\{?\s*$"


@query(
    rf"SELECT DISTINCT fileId, ln, CASE WHEN contains(m, 'public') THEN 'public' WHEN contains(m, 'private') THEN 'private' WHEN contains(m, 'protected') THEN 'protected' ELSE 'package-private' END AS visibility FROM (SELECT fileId, ln, regexp_extract(line, '{_SIGNATURE}', 1) AS m FROM lines WHERE ends_with(lower(file), '.java') AND regexp_matches(line, '{_SIGNATURE}') AND NOT regexp_matches(line, '^\s*(?:return|new|else|throw)\b'))"
)
def f26_visibility(g: CodeGraph) -> DataFrame:
    """Visibility of the methods that Java files define."""
    l = g.lines.where(F.lower("file").endswith(".java") & F.col("line").rlike(_SIGNATURE) & ~F.col("line").rlike(r"^\s*(?:return|new|else|throw)\b"))
    return l.select("fileId", "ln", P.visibility(F.regexp_extract("line", _SIGNATURE, 1)).alias("visibility")).distinct()


@query(r"SELECT DISTINCT route, CASE WHEN regexp_matches(route, '(?i)^(?:https?:)?//') THEN 'consumed' ELSE direction END AS direction FROM api")
def pr14_reclassified(g: CodeGraph) -> DataFrame:
    """Provided endpoints with a full URL are consumed ones."""
    return g.apis.select("route", F.when(P.is_full_url(F.col("route")), "consumed").otherwise(F.col("direction")).alias("direction")).distinct()
