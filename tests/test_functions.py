"""Scalar functions against vectors worked out by hand."""

import pytest
from pyspark.sql import functions as F

from codeloom.functions import paths as P
from codeloom.functions import spring as S
from codeloom.plans import router
from codeloom.sources import scan


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "url, want",
    [("https://h.x/api/v1/users/?q=1#t", "/v1/users"), ("users", "/users"), ("", ""), ("/api", "/"), ("/api-v2/x", "/x"), ("/API/Users", "/Users"), ("${BASE}/orders//1/", "/orders/1"), ("https://h.x", "/"), ("//h/x", "/h/x"), (None, None), ("/a%20b%2Fc+d", "/a b%2Fc+d")],
)
def test_api_path(spark, url, want):
    assert one(spark, P.api_path(F.col("u")), u=url) == want


@pytest.mark.parametrize("url, want", [("https://h.x/a/?q#z", "/a"), ("//h.x/a", "/a"), ("/api/x/", "/api/x"), ("", "/")])
def test_path_id(spark, url, want):
    assert one(spark, P.path_id(F.col("u")), u=url) == want


def test_confidence(spark):
    def conf(u, p):
        c = P.match_confidence(F.col("u"), F.lit("GET"), F.lit("a"), F.col("p"), F.lit("GET"), F.lit("b"))
        return round(one(spark, c.cast("string"), u=u, p=p) and float(one(spark, c.cast("string"), u=u, p=p)), 6)

    assert conf("/users", "/api/users") == 0.5
    assert conf("https://h/api/users", "/api/users") == 0.6  # an absolute URL has no equal normal form
    assert conf("/a2345678901234567890", "/a2345678901234567890") == 1.0


@pytest.mark.parametrize("name, want", [("  José  O'Neil-Jr. ", "jos oneil-jr."), ("", ""), (None, None)])
def test_person_name(spark, name, want):
    assert one(spark, P.person_name(F.col("n")), n=name) == want


@pytest.mark.parametrize(
    "name, op, fields",
    [("findByEmailAndActive", "find", ["email", "active"]), ("countByStatusIn", "count", ["status"]), ("findByIsActiveTrue", "find", ["active"]), ("findByStatusNotIn", "find", ["status"]), ("findByOrderId", "find", ["derId"]), ("findTop10ByName", None, None), ("saveAll", "save", None), ("removeX", "delete", None), ("fetchAll", "findAll", None)],
)
def test_derived_queries(spark, name, op, fields):
    assert one(spark, P.query_operation(F.col("n")), n=name) == op
    assert one(spark, P.query_fields(F.col("n")), n=name) == fields


def test_languages_and_tokens(spark):
    assert one(spark, P.language(F.col("p")), p="src/A.TSX") == "typescript"
    assert one(spark, P.language(F.col("p")), p="Makefile") == "other"
    assert one(spark, scan.language(F.col("p")), p="x.go") == "unknown"
    assert one(spark, P.keywords(F.col("p")), p="Show  API, /v1/users!") == ["show", "api", "/v1/users"]


def test_spring_texts(spark):
    q = "SELECT u FROM User u WHERE u.status = ?1"
    assert one(spark, S.jpql_tables(F.col("q")), q=q) == ["User"]
    assert one(spark, S.jpql_columns(F.col("q")), q=q) == ["status"]
    s = "SELECT * FROM users WHERE created_date > ?1"
    assert one(spark, S.sql_tables(F.col("q")), q=s) == ["users"]
    assert one(spark, S.sql_columns(F.col("q")), q=s) == ["created_date"]
    assert one(spark, S.repository_interface(F.col("q")), q="interface A extends ReactiveCrudRepository<A, Long>") == "CrudRepository"
    assert one(spark, S.security_paths(F.col("q")), q='.antMatchers("/api/public/**").requestMatchers(HttpMethod.GET, "/x")') == ["/api/public/**", "/x"]
    lit = lambda p, x: one(spark, S.path_matches_literal(F.col("p"), F.col("x")), p=p, x=x)
    assert lit("/public/x", "/public/**") and not lit("/public/x/y", "/public/**")
    assert one(spark, S.path_matches(F.col("p"), F.col("x")), p="/public/x/y", x="/public/**")


def test_limits_and_routes():
    assert [router.clamp(x) for x in (7.9, -3, None)] == [7, 0, 100]
    r = router.route
    assert r("SQL: select 1").name == "raw"
    assert r("show circular function calls").name == "call_cycles"
    assert r("impact of endpoint '/users'") == router.Routed("endpoint_impact", "/users")
    assert r("affected files for file 'a.ts'") == router.Routed("file_impact", "a.ts")
    assert r("affected apis for file 'a.ts'").name == "endpoint_impact"  # the earlier template takes it
    assert r("who calls 'getUser'") == router.Routed("who_calls", "getUser")
    assert r("api refunds").words == ("refunds",)
    assert r("").words == ()


def test_globs():
    import re

    assert re.match(scan.glob_pattern("**/*.js"), "a/b.js") and re.match(scan.glob_pattern("**/*.js"), "b.js")
    assert not re.match(scan.glob_pattern("*.js"), "a/b.js")
    p, neg = scan.ignore_pattern("dist/")
    assert re.match(p, "x/dist/a.js") and not neg
    assert scan.ignore_pattern("# no") is None
    assert scan.ignore_pattern("!keep.js")[1]
