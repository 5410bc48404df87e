from codeloom.operators import spring_edges as E


def ends(df):
    return sorted((r["fromId"], r["toId"]) for r in df.collect())


def test_spring_edges(spark):
    repos = spark.createDataFrame([("q", "r", "a", "User"), ("q2", "r", "b", None)], "id string, repoRoot string, file string, entityType string")
    tables = spark.createDataFrame([("t", "r", "users"), ("u", "s", "users")], "id string, repoRoot string, name string")
    columns = spark.createDataFrame([("c", "r", "a", "users"), ("d", "s", "a", "users")], "id string, repoRoot string, file string, table string")
    assert ends(E.accesses_table(repos, tables)) == [("q", "t")]
    assert ends(E.queries_column(repos, columns)) == [("q", "c")]
    assert ends(E.has_column(tables, columns)) == [("t", "c"), ("u", "d")]
    sec = spark.createDataFrame([("s", "r", "SecurityConfig", ["/api/x/**", "/api/**"]), ("v", "r", "UserDetailsService", None), ("w", None, "SecurityConfig", ["/**"])], "id string, repoRoot string, componentType string, configuredPaths array<string>")
    apis = spark.createDataFrame([("a1", "r", "provided", "/api/x/y"), ("a2", "r", "provided", "/api/z"), ("a3", "r", "consumed", "/api/z")], "id string, repoRoot string, direction string, route string")
    assert sorted((r["toId"], r["pattern"]) for r in E.secures_api(sec, apis).collect()) == [("a1", "/api/x/**"), ("a2", "/api/**")]
    assert ends(E.secures_api(sec, apis, literal=True)) == []  # the prefix is cut from the path, not from the pattern
    classes = spark.createDataFrame([("k", "r", "UserController"), ("l", "r", "userservice"), ("m", "r", None)], "id string, repoRoot string, name string")
    assert ends(E.used_by(sec, classes)) == [("v", "k")]
    assert ends(E.used_by(sec.limit(0), classes)) == []
