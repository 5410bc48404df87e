"""Class ends, pairs in blocks, trimmed edges, cleanups, metadata, scans, teams, prompts, reports and the stream."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from codeloom.engine import Engine
from codeloom.functions import paths as P
from codeloom.functions import spring as S
from codeloom.operators import cycles, store
from codeloom.operators.graph import CodeGraph, first_by
from codeloom.operators.traversal import closed_by_halves, closed_trails, member_pairs, trimmed
from codeloom.plans import router
from codeloom.session import cut
from codeloom.sources import manifests as M
from codeloom.sources import scan
from codeloom.streaming import upserts
from test_graph import g as _g

g = _g  # the small tables of test_graph


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def texts(spark, *rows):
    h = object.__new__(CodeGraph)
    h.spark, h.folder, h.events, h._kept = spark, "", False, {}
    h.__dict__["texts"] = spark.createDataFrame([(k, "r", f, t) for k, (f, t) in enumerate(rows)] * 2, "fileId bigint, repoRoot string, file string, content string")
    return h


def test_class_ends(spark):
    h = texts(
        spark,
        ("a.ts", 'export class A {\n  m() { return "}"; } // }\n}\nfunction f() {\n}\nclass B { }\nclass C\n{\n  class D {\n  }\n}\n'),
        ("b.py", "class A:\n    x = 1\n\n    def f(self):\n        pass\n\ny = 2\nclass B(A):\n    pass\n"),
        ("c.cs", "class Open {\n  int x;\n"), ("d.py", ""),
    )
    got = sorted((r["file"], r["name"], r["spanStart"], r["spanEnd"]) for r in h.classes.collect())
    assert got == [("a.ts", "A", 1, 3), ("a.ts", "B", 6, 6), ("a.ts", "C", 7, 11), ("a.ts", "D", 9, 10), ("b.py", "A", 1, 5), ("b.py", "B", 8, 9), ("c.cs", "Open", 1, 2)]


def test_errors_over_two_lines(spark):
    h = texts(spark, ("a.ts", "throw new Error(\n  'on the next');\nthrow err;\nlog('no');"), ("b.py", "raise ValueError(f'x {y}')\nraise\nfoo('no')"), ("c.java", 'log.error("logged");'))
    assert sorted((r["file"], r["line"], r["message"]) for r in h.errors.collect()) == [("a.ts", 1, "on the next"), ("b.py", 1, "x {y}"), ("c.java", 1, "logged")]


def test_member_pairs_equal_brute_force(spark):
    random.seed(3)
    rows = {(f"k{random.randint(0, 2)}", f"m{random.randint(0, 60):02d}") for _ in range(150)} | {("one", "m00")}
    df = spark.createDataFrame(sorted(rows), "k string, m string")
    want = {(k, a, b) for k in {r[0] for r in rows} for a, b in itertools.combinations(sorted(m for x, m in rows if x == k), 2)}
    for block in (1000, 7):
        got = member_pairs(df, ["k"], "m", block).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert member_pairs(df.limit(0), ["k"], "m").count() == 0


def test_trimming_keeps_closed_trails(spark):
    random.seed(9)
    edges = spark.createDataFrame([(f"n{random.randint(0, 11)}", f"n{random.randint(0, 11)}") for _ in range(24)], "fromId string, toId string")
    whole = sorted(",".join(r["nodes"]) for r in closed_trails(edges, 5).collect())
    assert sorted(",".join(r["nodes"]) for r in closed_by_halves(edges, 5).collect()) == whole and whole
    line = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "fromId string, toId string")
    assert trimmed(line, 5).count() == 0


def test_call_cycles_move_functions_alone(spark, monkeypatch):
    random.seed(4)
    cols = "id string, name string, repoRoot string, file string, calls array<string>"
    some = lambda k, root: (k, f"n{random.randint(0, 4)}", root, random.choice(["x", "y", None]), random.choice([None, [], ["n0", None, "n1"], ["n2", "n3"], ["n4", "no"]]))
    plain = [some(f"a{k}", "r") for k in range(11)] + [some(f"b{k}", "s") for k in range(5)] + [("c", "n0", None, "z", ["n0"]), (None, "n1", "r", "z", ["n0"]), ("d", None, "r", "z", ["n0"])]
    twice = plain + [some(k, root) for k in ("a1", "a2", "b3") for root in ("r", "s", "t", None)] + [("t1", "n1", "t", "w", ["n1", "n0"]), ("t2", "n1", "t", "w", ["n1"])]  # ids under several names and roots
    for rows in (plain, twice):
        edges = {(f[0], g[0]) for f in rows for g in rows if f[2] and f[2] == g[2] and g[1] in (f[4] or []) and g[1] and f[0] and g[0] and f[0] != g[0]}
        want = set()
        for r in closed_trails(spark.createDataFrame(sorted(edges), "fromId string, toId string"), 5).collect():
            of = lambda c: ",".join(sorted({x[c] for x in rows if x[0] in r["nodes"] and x[c] is not None}))  # noqa: B023, E731
            want.add((r["start"], r["hops"] + 1, ",".join(r["nodes"]), of(1), of(3)))
        df = spark.createDataFrame(rows, cols)
        for block, most in ((10**6, 10**6), (3, 4)):
            monkeypatch.setattr(cycles, "TOGETHER", 4 if block == 3 else 10**6)
            monkeypatch.setattr(cycles, "MOST", most)
            got = cycles.call_cycles(df, 5, block).collect()
            assert len(got) == len(want) and {tuple(r) for r in got} == want and want
    plan = cycles.call_cycles(spark.createDataFrame(plain, cols), 8)._jdf.queryExecution().analyzed().toString()
    assert "trail" not in plan[plan.index("Repartition") :]  # no trail is shuffled
    assert cycles.call_cycles(df.limit(0), 8).count() == 0


def test_first_by_keeps_what_is_asked(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, None), ("b", 1, "y")], "k string, o int, v string")
    assert sorted(map(tuple, first_by(df, ["k"], ["o"], ["v"]).collect())) == [("a", None), ("b", "y")]
    assert first_by(df, ["k"], ["o"], []).columns == ["k"]


def test_edges_and_nodes_hold_everything(g):
    kinds = {r["type"]: r["n"] for r in g.nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {"Repository", "File", "Class", "Function", "Variable", "API", "DatabaseTable", "Config", "ErrorMessage", "Developer", "Team", "Commit"} <= kinds.keys()
    edges = {(r["type"], r["relKey"]): r["properties"] for r in g.edges().collect()}
    assert {"CALLS", "CONSUMES_API_FROM", "COMMITTED", "HAS_MEMBER", "PASSES_TO"} <= {t for t, _ in edges}
    member = next(p for (t, _), p in edges.items() if t == "HAS_MEMBER")
    assert member == {"role": "lead", "contributions": "5"}
    assert g.api_rows().count() == 3 and set(g.node_rows("file", "valueSample").columns) == {"id", "type", "file", "valueSample"}


def test_events_are_functions(spark, g, tmp_path):
    rows = [(k, None, k % 3, ("view", "purchase", "click")[k % 3], 1.0, f'{{"k": {k % 7}}}') for k in range(300)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    h = CodeGraph(spark, g.folder, events=True)
    h.raw = lambda name: spark.read.parquet(f"{tmp_path if name == 'events' else g.folder}/{name}.parquet")
    assert h.fn().count() == g.fn().count() + 300 and h.consumes_api_from().where("cRepo LIKE 'user-%'").count() == 1


def test_api_cleanup_and_reset(spark):
    n = spark.createDataFrame([("p", "r", "provided"), ("c", "r", "consumed"), ("q", "s", "provided"), ("z", None, None)], "id string, repoRoot string, direction string")
    e = spark.createDataFrame([("x", "p"), ("x", "c"), ("y", "q")], "fromId string, toId string")
    left, kept = store.cleanup_apis(n, e, "r", True)
    assert sorted(r["id"] for r in left.collect()) == ["c", "q", "z"] and sorted(r["toId"] for r in kept.collect()) == ["c", "q"]
    assert store.reset_all(n, e.limit(0))[2] == {"nodes": 4, "edges": 0, "nodesLeft": 0, "edgesLeft": 0}


def test_meta_json(spark):
    df = spark.createDataFrame([(1, ["a"]), (None, None)], "n int, l array<string>")
    assert [r["x"] for r in df.select(store.meta_json({"n": F.col("n"), "l": F.col("l")}, ("l",)).alias("x")).collect()] == ['{"n":1,"l":"[\\"a\\"]"}', '{"n":null,"l":null}']


@pytest.mark.parametrize("callee, http, method", [("app.get", False, "GET"), ("this.app.get", True, "GET"), ("map.get", True, "GET"), ("fetch", True, None), ("axios.post", True, "POST"), ("post", False, "POST"), ("x", False, None)])
def test_callees(spark, callee, http, method):
    assert (one(spark, P.is_http_call(F.col("c")), c=callee), one(spark, P.method_in_name(F.col("c")), c=callee)) == (http, method)


def test_texts_of_code(spark):
    assert one(spark, P.annotation(F.col("t")), t='@o.s.RequestMapping(value = "/a", method = RequestMethod.POST)').asDict() == {"name": "RequestMapping", "path": "/a", "method": "POST"}
    assert one(spark, P.annotation(F.col("t")), t="@Override").asDict() == {"name": "Override", "path": None, "method": None}
    assert one(spark, P.visibility(F.col("t")), t="protected static") == "protected" and one(spark, P.visibility(F.col("t")), t="") == "package-private"
    assert one(spark, P.server_context(F.col("t")), t="const app = express()") and not one(spark, P.server_context(F.col("t")), t="let a")
    assert one(spark, P.frontend_context(F.col("t")), t="import R from 'react'")
    assert one(spark, S.entity_info(F.col("t")), t='@Entity @Table(name = "u", schema = "s") class U').asDict() == {"isEntity": True, "tableName": "u", "schemaName": "s"}
    assert one(spark, S.repository_types(F.col("t")), t="interface A extends JpaRepository<User, Long>").asDict() == {"entityType": "User", "idType": "Long"}
    kind = lambda t, n: one(spark, S.security_component(F.col("t"), F.col("n")), t=t, n=n)
    assert [kind("class A implements UserDetailsService", "A"), kind("@Bean AuthenticationManager", "A"), kind("", "JwtFilter"), kind("@Configuration", "SecurityConf"), kind("x", "y")] == ["UserDetailsService", "AuthenticationManager", "SecurityFilter", "SecurityConfig", None]
    assert one(spark, S.security_annotations(F.col("t")), t="@Secured @PreAuthorize") == ["@PreAuthorize", "@Secured"]
    assert one(spark, P.query_operation(F.col("t")), t="findFirstByName") == "find" and one(spark, P.query_operation(F.col("t")), t="persistAll") == "save" and one(spark, P.query_operation(F.col("t")), t="removeByX") == "remove"


def test_scan_obeys_gitignore(spark, tmp_path):
    for p, t in (("src/__init__.py", "x"), ("build/a.py", "no"), ("src/a.min.js", "no"), ("gen/b.ts", "no"), ("gen/keep.ts", "k"), ("deep/node_modules/c.js", "d"), ("src/e.txt", "no")):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    (tmp_path / ".gitignore").write_text("gen/*\n!gen/keep.ts\n# no\n")
    assert sorted((r["relPath"], r["content"]) for r in scan.scan(spark, str(tmp_path)).collect()) == [("deep/node_modules/c.js", "d"), ("gen/keep.ts", "k"), ("src/__init__.py", "x")]


def test_teams(spark):
    f = spark.createDataFrame([("/x/a-b", "package.json", '{"maintainers": ["Ann", {"name": "Bob"}]}'), ("/x/c-d", "team.json", '{"team": "blue", "manager": "m", "members": ["1", "2"]}')], "repoRoot string, file string, content string")
    meta = {r["name"]: (r["description"], r["lead"], r["size"]) for r in M.team_metadata(f).collect()}
    assert meta == {"maintainers": ("Maintainers: Ann, Bob", None, None), "blue": (None, "m", 2)}
    repos = spark.createDataFrame([("/x/a-b",), ("/x/tool-red",), ("/x/plain",)], "repoRoot string")
    assert sorted((r["repoRoot"], r["name"]) for r in M.teams(f, repos).collect()) == [("/x/a-b", "maintainers"), ("/x/c-d", "blue"), ("/x/tool-red", "red")]


def test_prompts():
    r = router.route
    assert r("circular dependency in 'src/x'") == router.Routed("call_cycles", "src/x")
    assert r("cycle of api between repository") == router.Routed("repo_cycles", "")
    assert r("show apis provided in repo 'r'") == router.Routed("provided", "r") and r("list consumed apis for path 'r'").name == "consumed"
    assert r("which one calls the function 'f'") == router.Routed("who_calls", "f") and r("which configs are used by file 'a.ts'") == router.Routed("configs", "a.ts")
    assert r("who invokes it").name == "search_function" and r("src/a.ts").name == "search_file"


def test_engine(spark, g):
    e = Engine(spark, g.folder)
    calls = cut(e.graph.calls())
    e.graph.edges = lambda: calls  # all kinds together are tested above
    assert e.query("SQL: select count(*) as n from edges e join nodes n on n.id = e.toId").first()["n"] == 3
    lines = e.impact_report("a.py")
    assert "affectedFiles (1):" in lines and "  - GET /users/{id} @ a.py" in lines and "configKeys (1):" in lines
    left, kept, n = e.reset("r")
    assert n["nodesLeft"] < n["nodes"] and left.where("repoRoot = 'r'").count() == 0 and n["edgesLeft"] == kept.count()
    assert e.reset()[2]["nodesLeft"] == 0 and "SQL" in e.learn()
    many = spark.createDataFrame([("f", ",".join(f"x{k}" for k in range(60)))], "fileId string, affectedFiles string")
    assert router.report(many)[-1] == "  ...and 10 more" and len(router.report(many)) == 52


def test_stream_buckets_and_tombstones(spark, tmp_path):
    schema = "fileId bigint, repoRoot string, absPath string, content string, scannedAt timestamp, snapshotVersion string, deleted boolean"
    batch = lambda *rows: spark.createDataFrame([(k, "r", f"r/{k}.py", f"class A{v}:\n  pass", None, v, gone) for k, v, gone in rows], schema)
    run, d = upserts.merge_batch(str(tmp_path)), str(tmp_path)
    state = lambda n: {r["fileId"]: r["snapshotVersion"] for r in upserts.current(spark, d, n).collect()}
    run(batch((1, "v1", False), (2, "v1", False)), 0)
    run(batch((2, "v2", False), (3, "v2", False)), 1)
    run(batch((1, "v3", True)), 2)
    run(batch((1, "v3", True)), 2)  # again, as after a failure
    assert state(0) == {1: "v1", 2: "v1"} and state(1) == {1: "v1", 2: "v2", 3: "v2"} and state(2) == {2: "v2", 3: "v2"}
    edges = spark.read.parquet(f"{d}/edges")
    assert {(r["batch"], r["snapshotVersion"]) for r in edges.collect()} == {(0, "batch-0"), (1, "batch-1")} and edges.where("type = 'DECLARES'").count() == 4


def test_stream_of_source_files(spark, tmp_path):
    root, out = tmp_path / "repo", tmp_path / "out"
    root.mkdir()
    (root / "a.py").write_text("class A:\n  pass\n")
    (root / "b.txt").write_text("no")
    q = upserts.watch_repository(spark, str(root), str(out), once=True)
    q.awaitTermination()
    assert upserts.current(spark, str(out), 0).count() == 1 and spark.read.parquet(f"{out}/edges").count() == 2
