"""Edge builders and traversals on small tables, with nulls, repeats and empty tables."""

import pytest
from pyspark.sql import functions as F

from codeloom.operators import store
from codeloom.operators.graph import CodeGraph
from codeloom.operators.traversal import closed_trails, reach
from codeloom.plans import graph_queries as Q
from codeloom.plans import router

NODE = "id string, type string, name string, repoRoot string, file string, language string, spanStart int, spanEnd int, snapshotVersion string, metaJson string, seq bigint"
FUNCTION = NODE + (
    ", params array<string>, returns string, isAsync boolean, calls array<string>, apisProvided array<struct<method:string,path:string>>, apisUsed array<struct<method:string,url:string>>, tablesQueried array<string>, configsUsed array<string>, reads array<string>, writes array<string>"
    ", derives array<struct<target:string,sources:array<string>,op:string>>, passesTo array<struct<callee:string,argIndex:int,sourceVar:string,paramName:string>>"
)


def fn(i, name, repo="r", file="a.py", a=1, b=9, calls=None, prov=None, used=None, tabs=None, cfgs=None, reads=None, writes=None, derives=None, passes=None, seq=1):
    return (i, "Function", name, repo, file, None, a, b, "v1", None, seq, None, None, None, calls, prov, used, tabs, cfgs, reads, writes, derives, passes)


def node(i, kind, name, repo="r", file="a.py", seq=1):
    return (i, kind, name, repo, file, None, 1, 1, "v1", None, seq)


@pytest.fixture(scope="module")
def g(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = [
        fn("f1", "a", calls=["b", "zz", "a"], prov=[(None, "/users/{id}")], tabs=["t"], cfgs=["K"], reads=["v"], writes=["w"], derives=[("w", ["v"], "call")], passes=[("b", 0, "v", None)]),
        fn("f2", "b", a=20, b=30, calls=["c"], reads=["v"]),
        fn("f3", "c", a=40, b=50, calls=["a"]),
        fn("f3", "c2", a=40, b=50, seq=2),
        fn("f4", None, repo="s", file="b.py", used=[("GET", "https://h.x/api/users/42"), ("GET", "https://h.x/other")]),
    ]
    spark.createDataFrame(rows, FUNCTION).write.parquet(f"{d}/function_entity.parquet")
    spark.createDataFrame([(*node("c1", "Config", "K"), "v"), (*node("c2", "Config", None), None)], NODE + ", valueSample string").write.parquet(f"{d}/config_entity.parquet")
    spark.createDataFrame([node("r1", "Repository", "R", file=None), node("r1", "Repository", "R", file=None), node("s1", "Repository", "S", repo="s", file=None)], NODE).write.parquet(f"{d}/repository_entity.parquet")
    team = NODE + ", description string, lead string, size int, repositories array<string>, expertise array<string>"
    spark.createDataFrame([(*node("t1", "Team", "red", file=None), None, "Ann", 3, None, None)], team).write.parquet(f"{d}/team_entity.parquet")
    dev = NODE + ", email string, aliases array<string>, primaryLanguages array<string>, totalCommits bigint, firstCommit timestamp, lastCommit timestamp, teamId string"
    devs = [(*node("d1", "Developer", "Ann", file=None, seq=2), "A@x", None, None, 5, None, None, "red"), (*node("d2", "Developer", "Bob", file=None, seq=1), None, ["b@x"], None, 2, None, None, None)]
    spark.createDataFrame(devs, dev).write.parquet(f"{d}/developer_entity.parquet")
    cm = "id string, type string, name string, repoRoot string, hash string, shortHash string, message string, author string, authorEmail string, timestamp timestamp, additions bigint, deletions bigint, filesChanged array<string>, snapshotVersion string, ingestedAt timestamp, seq bigint"
    c = lambda i, who, mail, files: (i, "Commit", i, "r", i, i, None, who, mail, None, None, 1, files, "v1", None, 1)
    spark.createDataFrame([c("m1", "Ann", None, ["a.py", "gone.py"]), c("m2", "x", "b@x", ["a.py"]), c("m3", None, None, None)], cm).write.parquet(f"{d}/commit_entity.parquet")
    fi = "fileId bigint, repoRoot string, relPath string, absPath string, language string, content string, snapshotVersion string, scannedAt timestamp"
    files = [(1, "r", "a.py", "r/a.py", None, "class A:\n  x = 1\n  raise E('boom')\n", "v1", None), (1, "r", "./a.py", "r/a.py", None, "class A:\n  x = 1\n  raise E('boom')\n", "v1", None), (2, "s", "b.py", "s/b.py", None, None, "v1", None)]
    spark.createDataFrame(files, fi).write.parquet(f"{d}/file_info.parquet")
    return CodeGraph(spark, d)


def ends(df):
    return sorted((r["fromId"], r["toId"]) for r in df.collect())


def test_calls_and_names(g):
    assert ends(g.calls()) == [("f1", "f2"), ("f2", "f3"), ("f3", "f1")]
    assert len(ends(g.queries_table())) == 1 and ends(g.uses_config()) == [("f1", "c1")]
    assert len(ends(g.provides_api())) == 1 and len(ends(g.uses_api())) == 2


def test_contains_and_spans(g):
    file_ids = {r["file"]: r["id"] for r in g.files.collect()}
    assert {t for f, t in ends(g.contains()) if f == file_ids["a.py"]} >= {"f1", "f2", "f3", "c1"}
    assert {t for _, t in ends(g.has_function())} == set()  # the class ends before its last function
    assert len(ends(g.emits_error())) == 1


def test_lineage(g):
    v = {(r["name"], r["spanStart"]): r["id"] for r in g.variables.collect()}
    assert ends(g.reads_from()) == sorted([("f1", v["v", 1]), ("f2", v["v", 20])])  # each function's own v
    assert ends(g.derives_from()) == [(v["w", 1], v["v", 1])]
    assert ends(g.transforms()) == [("f1", v["w", 1])]
    assert [(r["fromId"], r["toId"], r["argIndex"]) for r in g.passes_to().collect()] == [(v["v", 1], "f2", 0)]


def test_consumes(g):
    rows = g.consumes_api_from().collect()
    assert [(r["cRepo"], r["pRepo"], r["n"]) for r in rows] == [("s", "r", 1)]  # by template
    paths = {(r["cPath"], r["pPath"]) for r in g.path_matches().collect()}
    assert paths == {("/users/42", "/users/{id}")}


def test_path_matches_equal_brute_force(spark, g):
    import random
    import re

    random.seed(5)
    segs = ["a", "ab", "42", "x"]
    cons = {"/" + "/".join(random.choices(segs, k=random.randint(1, 3))) for _ in range(25)}
    prov = {"/" + "/".join(random.choices([*segs, "{id}", ":k"], k=random.randint(1, 3))) for _ in range(25)}
    h = CodeGraph(spark, "unused")
    h.__dict__["apis"] = spark.createDataFrame([("consumed", p) for p in cons] + [("provided", p) for p in prov], "direction string, route string")
    got = {(r["cPath"], r["pPath"]) for r in h.path_matches().collect()}
    rx = lambda p: re.compile("^" + re.sub(r"\{[^/}]+\}|:[A-Za-z_]\w*", "[^/]+", p) + "$", re.I)
    assert got == {(c, p) for c in cons for p in prov if c == p or len(p) > 1 and p in c or rx(p).match(c)}


def test_people(g):
    assert ends(g.belongs_to()) == [("d1", "t1"), ("d2", "t1")]
    assert ends(g.committed()) == [("d1", "m1"), ("d2", "m2")]
    assert [(r["fromId"], r["toId"], r["sharedFiles"]) for r in g.collaborates_with().orderBy("fromId").collect()] == [("d1", "d2", 1), ("d2", "d1", 1)]
    assert ends(g.manages_team()) == [("d1", "t1")]
    assert [(r["toId"], r["role"]) for r in g.has_member().collect()] == [("d1", "lead")]
    assert ends(g.owns_repository()) == [("t1", "r1")] and len(ends(g.modified_file())) == 2


def test_trails(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("a", "b")], "fromId string, toId string")
    got = sorted((r["start"], r["hops"]) for r in closed_trails(e, 8).collect())
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("b", "a")]

    def brute(path, used):
        out = [(path[0], len(used))] if used and path[0] == path[-1] else []
        for x in edges:
            if x[0] == path[-1] and x not in used and len(used) < 8:
                out += brute([*path, x[1]], [*used, x])
        return out

    assert got == sorted(x for s in "abc" for x in brute([s], []))
    assert closed_trails(e.limit(0), 3).count() == 0


def test_repo_cycles_of_five_hops(spark, monkeypatch):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "a"), ("b", "a"), ("c", "a"), ("e", "x"), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "a")]
    monkeypatch.setattr(Q, "_repo_edges", lambda g: spark.createDataFrame(edges + edges[:2], "fromId string, toId string"))

    def brute(path, used):
        out = [(",".join(path), len(used))] if used and path[0] == path[-1] else []
        for x in edges:
            if x[0] == path[-1] and x not in used and len(used) < 5:
                out += brute([*path, x[1]], [*used, x])
        return out

    want = sorted(x for s in "abcdexyzw" for x in brute([s], []))
    assert sorted(map(tuple, Q.q02_repo_cycles(None).collect())) == want and {n for _, n in want} == {2, 3, 5}
    monkeypatch.setattr(Q, "_repo_edges", lambda g: spark.createDataFrame([], "fromId string, toId string"))
    assert Q.q02_repo_cycles(None).count() == 0


def test_long_and_partly_open_templates(spark):
    long = "/".join(f"s{k}" for k in range(14))
    rows = [("consumed", f"/{long}/7/end"), ("provided", f"/{long}/{{id}}/end"), ("consumed", "/files/X-42.json"), ("provided", "/files/x-{id}.json"), ("provided", "/files/y-:id"), ("consumed", "/files/x-1/json"), ("consumed", "/files/x-.json"), ("consumed", "/a/1/b/2"), ("provided", "/a/:p/b/{q}")]
    h = object.__new__(CodeGraph)
    h.__dict__["apis"] = spark.createDataFrame(rows, "direction string, route string")
    got = sorted((r["cPath"], r["pPath"]) for r in h.path_matches().collect())
    assert got == sorted([(f"/{long}/7/end", f"/{long}/{{id}}/end"), ("/files/X-42.json", "/files/x-{id}.json"), ("/a/1/b/2", "/a/:p/b/{q}")])


def test_reach(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "c")], "fromId string, toId string")
    s = spark.createDataFrame([("S", "a")], "seed string, node string")
    assert sorted((r["node"], r["hop"]) for r in reach(s, e, 2).collect()) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]


def test_cycles_and_impact(g):
    assert sorted(r["cycleLength"] for r in Q.q01_call_cycles(g).collect()) == [4, 4, 4]
    reached = {(r["type"], r["name"]) for r in router.impact(g, "a.py").collect()}
    assert ("API", "/users/{id}") in reached and ("Function", "a") in reached
    assert router.run(g, "who calls 'b'").collect()[0]["caller"] == "a"
    assert router.run(g, "SQL: select count(*) as n from nodes where type = 'Function'").first()["n"] == 4
    with pytest.raises(ValueError):
        router.run(g, "SQL: drop table x")
    assert router.run(g, "").count() == 0


def test_store(spark):
    t = spark.createDataFrame([("a", "old", "v1"), ("b", "keep", "v1")], "id string, name string, snapshotVersion string")
    b = spark.createDataFrame([("a", "new", "v2"), ("c", "new", "v2")], "id string, name string, snapshotVersion string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(store.merge_first(t, b, "id")) == [("a", "old", "v2"), ("b", "keep", "v1"), ("c", "new", "v2")]
    assert rows(store.merge_last(t, b, "id")) == [("a", "new", "v2"), ("b", "keep", "v1"), ("c", "new", "v2")]
    dup = spark.createDataFrame([("a", None, 1), ("a", "x", 2), ("a", "y", 3)], "id string, name string, seq int")
    assert rows(store.coalesce_batch(dup, "id", ["seq"])) == [("a", "x", 1)]
    e = spark.createDataFrame([("a", "T", "b"), ("a", "T", "zz")], "fromId string, type string, toId string")
    v1 = store.upsert_edges(None, e, t, "v1")
    again = store.upsert_edges(store.upsert_edges(v1, e, t, "v1"), e, t, "v2")
    assert [r["snapshotVersion"] for r in again.orderBy("snapshotVersion").collect()] == ["v1", "v2"]


def test_stream_is_batch(spark, g):
    from codeloom.streaming import upserts

    got = {r["fileId"] for r in upserts.stream_query(spark, g.folder).collect()}
    assert got == {1, 2}


def test_all_queries_run_on_empty_tables(spark, g, tmp_path):
    for name in ("function_entity", "config_entity", "repository_entity", "team_entity", "developer_entity", "commit_entity", "file_info"):
        g.raw(name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    empty = CodeGraph(spark, str(tmp_path))
    for build in ("contains", "calls", "reads_from", "derives_from", "consumes_api_from", "committed", "collaborates_with", "has_member", "shares_package"):
        assert getattr(empty, build)().count() == 0, build
    assert Q.q04_file_impact(empty).count() == 0
    assert F is not None
