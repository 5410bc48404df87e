from pyspark.sql import functions as F

from codeloom.sources import manifests as M
from codeloom.sources import scan


def frame(spark, *rows):
    return spark.createDataFrame([("r", f, c) for f, c in rows], "repoRoot string, file string, content string")


def names(df):
    return sorted((r["name"], r["version"]) for r in df.collect())


def test_manifests(spark):
    f = frame(
        spark,
        ("package.json", '{"dependencies": {"a": "1", "b": "2"}, "devDependencies": {"b": "3"}}'),
        ("requirements.txt", "requests>=2.0\nflask\na!=1.0\npkg[x]==1\n# no\n"),
        ("pyproject.toml", 'dependencies = [\n "x[e]>=1.2",\n "y"\n]\n'),
        ("pom.xml", "<dependency><groupId>g</groupId><artifactId>h</artifactId><version>1</version></dependency>"),
        ("go.mod", "module m\nrequire example.org/q v1.2.3\nrequire (\n\texample.org/r v0.1.0\n)\n"),
        ("p.csproj", '<PackageReference Include="N" Version="4" /><PackageReference Include="O"><Version>5</Version></PackageReference>'),
        ("package.json", None),
    )
    assert names(M.npm(f)) == [("a", "1"), ("b", "3")]
    assert names(M.requirements(f)) == [("a", "1.0"), ("flask", None), ("requests", "2.0")]
    assert names(M.pyproject(f)) == [("x", "1.2"), ("y", None)]
    assert names(M.maven(f)) == [("g:h", "1")]
    assert names(M.go_mod(f)) == [("example.org/q", "v1.2.3"), ("example.org/r", "v0.1.0")]
    assert names(M.nuget(f)) == [("N", "4"), ("O", "5")]
    assert M.dependencies(f).count() == 12
    assert M.dependencies(f.limit(0)).count() == 0


def test_teams_and_commits(spark):
    f = frame(spark, ("CODEOWNERS", "* @acme/core\n# @acme/no\nsrc @acme/web @acme/core"), (".github/CODEOWNERS", "* @acme/ops"), ("team.yml", "name: 'red'\nsize: 3\n"), ("team.json", '{"name": "blue", "lead": "x"}'))
    assert [r["name"] for r in M.codeowners(f).collect()] == ["ops"]
    assert sorted(r["name"] for r in M.team_metadata(f).collect()) == ["blue", "red"]
    df = spark.createDataFrame([("payments-core",), ("api-gateway",), ("x",)], "n string").select(M.inferred_team(F.col("n")).alias("t"))
    assert [r["t"] for r in df.collect()] == ["payments", "gateway", None]
    log = f"{'a' * 40}|Ann|a@x|2024-01-02T03:04:05+00:00|fix | all\n\n3\t1\tsrc/a.py\n-\t-\tb.bin\n{'b' * 40}|Bob|b@x|2024-01-03T00:00:00+00:00|m\n"
    rows = M.git_log(spark.createDataFrame([("r", log), ("s", None)], "repoRoot string, log string")).orderBy("hash").collect()
    assert [(r["author"], r["additions"], r["deletions"], r["filesChanged"], r["message"]) for r in rows] == [("Ann", 3, 1, ["src/a.py", "b.bin"], "fix | all"), ("Bob", 0, 0, [], "m")]


def test_scan(spark, tmp_path):
    for p, t in (("src/a.py", "x = 1"), ("node_modules/b.js", "1"), ("c.txt", "no"), ("gen/d.ts", "let a")):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(t)
    rows = scan.scan(spark, str(tmp_path), ignore=("gen/",)).collect()
    assert [(r["relPath"], r["language"], r["content"]) for r in rows] == [("src/a.py", "python", "x = 1")]
