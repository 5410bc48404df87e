"""Dependency manifests, team files and git logs as column expressions over file texts; one row for each finding.

Input frames have repoRoot, file and content; rows with null content give nothing.  Outputs carry
manager, name and version of a package, or a team's fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import stable_id

_GENERIC = ("api", "web", "app", "service", "lib", "tool", "util")  # Words of repository names that are no team. Fixed values.


def _packages(df: DataFrame, manager: str, found: Column) -> DataFrame:
    """found: array of structs name, version."""
    rows = df.where(F.col("content").isNotNull()).select("repoRoot", "file", F.explode(found).alias("p"))
    return rows.select("repoRoot", "file", F.lit(manager).alias("manager"), F.col("p.name").alias("name"), F.nullif(F.col("p.version"), F.lit("")).alias("version")).where(F.col("name").isNotNull() & (F.col("name") != ""))


def npm(files: DataFrame) -> DataFrame:
    """package.json: dependencies, then dev, peer and optional ones; of a name in several the last counts."""
    kind = "map<string,string>"
    parsed = F.from_json("content", f"dependencies {kind}, devDependencies {kind}, peerDependencies {kind}, optionalDependencies {kind}")
    none = F.from_json(F.lit("{}"), kind)
    df = files.where(F.col("file").rlike(r"(^|/)package\.json\z")).withColumn("j", parsed)
    maps = [F.coalesce(F.col(f"j.{k}"), none) for k in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")]
    late = maps[0]
    for m in maps[1:]:
        late = F.map_concat(_without(late, m), m)
    return _packages(df, "npm", F.transform(F.map_entries(late), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version"))))


def _without(m: Column, other: Column) -> Column:
    return F.map_filter(m, lambda k, v: ~F.array_contains(F.map_keys(other), k))


def requirements(files: DataFrame) -> DataFrame:
    """requirements.txt: a name, and the version behind ==, >=, ~= or =; lines with extras, options or comments are passed over."""
    df = files.where(F.col("file").rlike(r"(^|/)requirements[\w.-]*\.txt\z"))
    lines = F.filter(F.transform(F.split("content", r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+#.*\z", ""))), lambda x: x.rlike(r"^[A-Za-z0-9._-]+\s*(?:[=<>!~].*)?\z"))
    version = lambda x: F.regexp_extract(x, r"(?:==|>=|~=|!=|=)\s*([\w.*+-]+)", 1)
    return _packages(df, "pip", F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([A-Za-z0-9._-]+)", 1).alias("name"), version(x).alias("version"))))


def pyproject(files: DataFrame) -> DataFrame:
    """pyproject.toml: the quoted entries of dependencies lists, without extras."""
    df = files.where(F.col("file").rlike(r"(^|/)pyproject\.toml\z"))
    blocks = F.regexp_extract_all("content", F.lit(r"(?s)\bdependencies\s*=\s*\[(.*?)\n?\s*\](?=\s*(?:\n|\z))"), 1)
    items = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit("[\"']([^\"']+)[\"']"), 1)))
    return _packages(df, "pip", F.transform(items, lambda x: F.struct(F.regexp_extract(x, r"^\s*([A-Za-z0-9._-]+)", 1).alias("name"), F.regexp_extract(x, r"(?:==|>=|~=)\s*([\w.*+-]+)", 1).alias("version"))))


def maven(files: DataFrame) -> DataFrame:
    """pom.xml: group:artifact and version of each dependency block."""
    df = files.where(F.col("file").rlike(r"(^|/)pom\.xml\z"))
    blocks = F.regexp_extract_all("content", F.lit(r"(?s)<dependency>(.*?)</dependency>"), 1)
    tag = lambda b, t: F.trim(F.regexp_extract(b, rf"(?s)<{t}>(.*?)</{t}>", 1))
    return _packages(df, "maven", F.transform(blocks, lambda b: F.struct(F.concat_ws(":", tag(b, "groupId"), tag(b, "artifactId")).alias("name"), tag(b, "version").alias("version"))))


def go_mod(files: DataFrame) -> DataFrame:
    """go.mod: single requirements and those of blocks."""
    df = files.where(F.col("file").rlike(r"(^|/)go\.mod\z"))
    lines = F.filter(F.transform(F.split("content", r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s*(?:require\s+)?", "")), lambda x: x.rlike(r"^[\w./~-]+\.[\w./~-]+\s+v[\w.+-]+"))
    return _packages(df, "go", F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^(\S+)", 1).alias("name"), F.regexp_extract(x, r"\s(v[\w.+-]+)", 1).alias("version"))))


def nuget(files: DataFrame) -> DataFrame:
    """*.csproj: package references with the version as attribute or element."""
    df = files.where(F.col("file").rlike(r"(?i)\.csproj\z"))
    refs = F.regexp_extract_all("content", F.lit(r"(?s)(<PackageReference\b[^>]*?(?:/>|>.*?</PackageReference>))"), 1)
    version = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r'\bVersion="([^"]*)"', 1), F.lit("")), F.regexp_extract(x, r"<Version>([^<]*)</Version>", 1))
    return _packages(df, "nuget", F.transform(refs, lambda x: F.struct(F.regexp_extract(x, r'\bInclude="([^"]*)"', 1).alias("name"), version(x).alias("version"))))


def dependencies(files: DataFrame) -> DataFrame:
    """Packages of all manifests, once for each (id, repository, file)."""
    out = npm(files)
    for f in (requirements, pyproject, maven, go_mod, nuget):
        out = out.unionByName(f(files))
    return out.withColumn("id", stable_id(F.lit("Package"), F.col("manager"), F.col("name"))).groupBy("id", "repoRoot", "file", "manager", "name").agg(F.min("version").alias("version"))


def codeowners(files: DataFrame) -> DataFrame:
    """Teams that CODEOWNERS names as @org/team; the file under .github comes before the one at the root."""
    df = files.where(F.col("file").isin(".github/CODEOWNERS", "CODEOWNERS") & F.col("content").isNotNull())
    one = df.groupBy("repoRoot").agg(F.min_by("content", F.when(F.col("file").startswith(".github"), 0).otherwise(1)).alias("content"))
    return one.select("repoRoot", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?m)^(?!\s*#).*?@[\w.-]+/([\w.-]+)"), 1))).alias("name"))


def team_metadata(files: DataFrame) -> DataFrame:
    """Name, description, lead and size of team.json, .team.json, team.yml and team.yaml, and the maintainers of package.json; team comes before name, manager behind lead, the number of members behind size."""
    j = F.from_json("content", "team string, name string, description string, lead string, manager string, size int, members array<string>")
    y = lambda k: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("content", rf"(?m)^\s*{k}:[ \t]*(.+)$", 1), "[\"']", "")), F.lit(""))
    members = F.when(F.col("j.members").isNotNull(), F.size("j.members"))
    json = files.where(F.col("file").rlike(r"(^|/)\.?team\.json\z")).select("repoRoot", j.alias("j")).select("repoRoot", F.coalesce("j.team", "j.name").alias("name"), "j.description", F.coalesce("j.lead", "j.manager").alias("lead"), F.coalesce("j.size", members).alias("size"))
    yaml = files.where(F.col("file").rlike(r"(^|/)team\.ya?ml\z")).select("repoRoot", F.coalesce(y("team"), y("name")).alias("name"), y("description").alias("description"), F.coalesce(y("lead"), y("manager")).alias("lead"), y("size").cast("int").alias("size"))
    person = lambda x: F.coalesce(F.get_json_object(x, "$.name"), x)
    kept = files.where(F.col("file").rlike(r"(^|/)package\.json\z")).select("repoRoot", F.from_json("content", "maintainers array<string>").alias("m")).where(F.size("m.maintainers") > 0)
    npm = kept.select("repoRoot", F.lit("maintainers").alias("name"), F.concat(F.lit("Maintainers: "), F.array_join(F.transform("m.maintainers", person), ", ")).alias("description"), F.lit(None).cast("string").alias("lead"), F.lit(None).cast("int").alias("size"))
    return json.unionByName(yaml).unionByName(npm).where(F.col("name").isNotNull())


def inferred_team(repo_name: Column) -> Column:
    """A team guessed from a repository's name: the word before a dash or underscore, or else behind one, that is not generic; in that order, dashes first."""
    words = [F.regexp_extract(repo_name, rx, 1) for rx in (r"^(\w+)-", r"^(\w+)_", r"-(\w+)\z", r"_(\w+)\z")]
    return F.coalesce(*[F.when((w != "") & ~F.lower(w).isin(*_GENERIC), w) for w in words])


def teams(files: DataFrame, repositories: DataFrame) -> DataFrame:
    """repoRoot, name, source of teams: of CODEOWNERS and metadata; for repositories (repoRoot) with neither, guessed from the name."""
    told = codeowners(files).select("repoRoot", "name", F.lit("codeowners").alias("source")).unionByName(team_metadata(files).select("repoRoot", "name", F.lit("metadata").alias("source"))).distinct()
    guessed = repositories.select("repoRoot").distinct().join(told.select("repoRoot").distinct(), "repoRoot", "left_anti").select("repoRoot", inferred_team(F.regexp_extract("repoRoot", r"([^/\\]+)[/\\]*\z", 1)).alias("name"), F.lit("name").alias("source"))
    return told.unionByName(guessed.where("name IS NOT NULL"))


def git_log(logs: DataFrame) -> DataFrame:
    """repoRoot and the text of `git log --numstat --format=%H|%an|%ae|%aI|%s` to commits with their changed files.

    A line of five parts that starts with a hash opens a commit; the lines up to the next are its
    numbers.  A dash counts as 0; nulls and empty logs give nothing.
    """
    head = r"(?m)^([0-9a-f]{40}\|[^\n]*(?:\n(?![0-9a-f]{40}\|)[^\n]*)*)"
    blocks = logs.where(F.col("log").isNotNull()).select("repoRoot", F.explode(F.regexp_extract_all("log", F.lit(head), 1)).alias("b"))
    top = F.split(F.substring_index("b", "\n", 1), r"\|", 5)
    stats = F.filter(F.split("b", "\n"), lambda x: x.rlike(r"^(?:\d+|-)\t(?:\d+|-)\t"))
    total = lambda i: F.aggregate(stats, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(F.try_to_number(F.nullif(F.split(x, "\t")[i], F.lit("-")), F.lit("999999999")).cast("bigint"), F.lit(0).cast("bigint")))
    return blocks.select(
        "repoRoot", top[0].alias("hash"), F.substring(top[0], 1, 7).alias("shortHash"), top[1].alias("author"), top[2].alias("authorEmail"), F.to_timestamp(top[3]).alias("timestamp"), top[4].alias("message"),
        total(0).alias("additions"), total(1).alias("deletions"), F.transform(stats, lambda x: F.split(x, "\t")[2]).alias("filesChanged"),
    )
