"""Registered edge queries, J1 to J33, each with the SQL that it is compared with."""

from __future__ import annotations

from .base_sql import BASE, BASE_EVENTS, api_path

MATCH = r"""cPath <> '' AND pPath <> '' AND (cPath = pPath OR (length(pPath) > 1 AND contains(cPath, pPath)) OR regexp_matches(pPath, '\{[^/}]+\}|:[A-Za-z_]') AND regexp_matches(cPath, '(?i)^' || regexp_replace(pPath, '\{[^/}]+\}|:[A-Za-z_][A-Za-z0-9_]*', '[^/]+', 'g') || '$'))"""
J24_CTES = f""", c AS (SELECT DISTINCT repoRoot AS cRepo, route AS cUrl, verb AS m, {api_path("route")} AS cPath FROM api WHERE direction = 'consumed'),
p AS (SELECT DISTINCT repoRoot AS pRepo, route AS pRoute, verb AS m, {api_path("route")} AS pPath FROM api WHERE direction = 'provided'),
pm AS (SELECT cPath, pPath FROM (SELECT DISTINCT cPath FROM c), (SELECT DISTINCT pPath FROM p) WHERE {MATCH}),
j AS (SELECT c.*, p.pRepo, p.pRoute, p.pPath FROM c JOIN pm ON pm.cPath = c.cPath JOIN p ON p.pPath = pm.pPath AND c.m = p.m AND c.cRepo <> p.pRepo),
k AS (SELECT *, round(greatest(0.0, least(1.0, CASE WHEN cUrl = pRoute THEN 0.5 WHEN contains(cUrl, pRoute) THEN 0.3 ELSE 0.0 END + CASE WHEN {api_path("CASE WHEN starts_with(cUrl, '/') THEN cUrl ELSE '/' || cUrl END")} = {api_path("CASE WHEN starts_with(pRoute, '/') THEN pRoute ELSE '/' || pRoute END")} THEN 0.2 ELSE 0.0 END + 0.3
 + CASE WHEN length(pRoute) > 10 THEN 0.1 ELSE 0.0 END + CASE WHEN length(pRoute) > 20 THEN 0.1 ELSE 0.0 END))::DOUBLE, 6) AS conf FROM j),
rr AS (SELECT DISTINCT cRepo AS fromId, pRepo AS toId FROM j)"""
J24 = " SELECT cRepo, pRepo, min({'a': cUrl, 'b': pRoute, 'm': m, 'c': conf}).a AS consumed, min({'a': cUrl, 'b': pRoute, 'm': m, 'c': conf}).b AS provided, min({'a': cUrl, 'b': pRoute, 'm': m, 'c': conf}).c AS confidence, count(*) AS n FROM k GROUP BY 1, 2"
EVENTS = ("consumes_api_from",)  # over the scanned functions and those that events stand for

# name -> (builder, SQL over the frames of base_sql)
EDGES: dict[str, tuple[str, str]] = {
    "j01_contains": ("contains", "SELECT DISTINCT f.id AS fromId, 'CONTAINS' AS type, n.id AS toId FROM fl f JOIN ents n ON n.repoRoot = f.repoRoot AND n.file = f.file WHERE n.id <> f.id"),
    "j02_declares": ("declares", "SELECT DISTINCT f.id AS fromId, 'DECLARES' AS type, n.id AS toId FROM fl f JOIN ents n ON n.repoRoot = f.repoRoot AND n.file = f.file WHERE n.id <> f.id AND n.type IN ('Class', 'Function', 'Variable')"),
    "j03_has_function": ("has_function", "SELECT DISTINCT c.id AS fromId, 'HAS_FUNCTION' AS type, f.id AS toId FROM cls c JOIN fn f ON f.repoRoot = c.repoRoot AND f.file = c.file WHERE f.spanStart >= c.spanStart AND f.spanEnd <= c.spanEnd"),
    "j04_calls": ("calls", "SELECT fromId, 'CALLS' AS type, toId FROM calls"),
    "j05_provides_api": ("provides_api", "SELECT fromId, 'PROVIDES_API' AS type, toId FROM provides"),
    "j06_uses_api": ("uses_api", "SELECT fromId, 'USES_API' AS type, toId FROM uses"),
    "j07_queries": ("queries_table", "SELECT fromId, 'QUERIES' AS type, toId FROM qtab"),
    "j08_uses_config": ("uses_config", "SELECT fromId, 'USES_CONFIG' AS type, toId FROM ucfg"),
    "j09_reads": ("reads_from", "SELECT DISTINCT r.id AS fromId, 'READS_FROM' AS type, v.varId AS toId FROM (SELECT id, unnest(reads) AS name FROM fn) r JOIN vres v ON v.fnId = r.id AND v.name = r.name"),
    "j10_writes": ("writes_to", "SELECT DISTINCT r.id AS fromId, 'WRITES_TO' AS type, v.varId AS toId FROM (SELECT id, unnest(writes) AS name FROM fn) r JOIN vres v ON v.fnId = r.id AND v.name = r.name"),
    "j11_transforms": (
        "transforms",
        "SELECT DISTINCT d.id AS fromId, 'TRANSFORMS' AS type, v.varId AS toId, d.sources, d.op FROM (SELECT *, row_number() OVER (PARTITION BY id, target ORDER BY pos) AS rn FROM (SELECT id, d.target AS target, array_to_string(d.sources, ',') AS sources, d.op AS op, pos FROM (SELECT id, unnest(derives) AS d, generate_subscripts(derives, 1) AS pos FROM fn WHERE spanStart IS NOT NULL))) d JOIN vres v ON v.fnId = d.id AND v.name = d.target WHERE rn = 1",
    ),
    "j12_derives": (
        "derives_from",
        "SELECT DISTINCT a.varId AS fromId, 'DERIVES_FROM' AS type, b.varId AS toId FROM (SELECT id, d.target AS target, unnest(d.sources) AS src FROM (SELECT id, unnest(derives) AS d FROM fn)) p JOIN vres a ON a.fnId = p.id AND a.name = p.target JOIN vres b ON b.fnId = p.id AND b.name = p.src WHERE a.varId <> b.varId",
    ),
    "j13_passes_to": (
        "passes_to",
        "SELECT fromId, 'PASSES_TO' AS type, toId, argIndex, paramName FROM (SELECT v.varId AS fromId, g.id AS toId, p.p.argIndex AS argIndex, p.p.paramName AS paramName, row_number() OVER (PARTITION BY v.varId, g.id ORDER BY p.seq, p.id, p.pos) AS rn FROM (SELECT id, repoRoot, seq, unnest(passesTo) AS p, generate_subscripts(passesTo, 1) AS pos FROM fn WHERE spanStart IS NOT NULL) p JOIN vres v ON v.fnId = p.id AND v.name = p.p.sourceVar JOIN fn g ON g.repoRoot = p.repoRoot AND g.name = p.p.callee) WHERE rn = 1",
    ),
    "j14_emits_error": ("emits_error", "SELECT fromId, 'EMITS_ERROR' AS type, toId FROM emits"),
    "j15_repo_packages": ("repo_packages", "SELECT DISTINCT r.id AS fromId, 'REPO_DEPENDS_ON_PACKAGE' AS type, p.id AS toId, p.manager, NULL::VARCHAR AS version FROM repo r JOIN pk p ON p.repoRoot = r.repoRoot"),
    "j16_shares_package": (
        "shares_package",
        "SELECT ra.id AS fromId, 'SHARES_PACKAGE_WITH' AS type, rb.id AS toId, n, packages FROM (SELECT a.repoRoot AS ra, b.repoRoot AS rb, count(*) AS n, array_to_string(list_sort(list(DISTINCT a.id))[1:10], ',') AS packages FROM pk a JOIN pk b ON a.id = b.id AND a.repoRoot < b.repoRoot GROUP BY 1, 2) x JOIN repo1 ra ON ra.repoRoot = x.ra JOIN repo1 rb ON rb.repoRoot = x.rb",
    ),
    "j22_repo_provides": ("repo_provides", "SELECT DISTINCT r.id AS fromId, 'REPO_PROVIDES_API' AS type, a.id AS toId FROM repo r JOIN api a ON a.repoRoot = r.repoRoot WHERE a.direction = 'provided'"),
    "j23_repo_uses": ("repo_uses", "SELECT DISTINCT r.id AS fromId, 'REPO_USES_API' AS type, a.id AS toId FROM repo r JOIN api a ON a.repoRoot = r.repoRoot WHERE a.direction <> 'provided'"),
    "j24_consumes_api_from": ("consumes_api_from", J24_CTES + J24),
    "j25_belongs_to": (
        "belongs_to",
        "SELECT DISTINCT fromId, 'BELONGS_TO' AS type, toId FROM (SELECT fromId, toId FROM (SELECT d.id AS fromId, t.id AS toId, row_number() OVER (PARTITION BY d.id ORDER BY t.seq, t.id) rn FROM dev d JOIN team t ON t.repoRoot = d.repoRoot AND d.teamId IN (t.id, t.name)) WHERE rn = 1 UNION ALL SELECT d.id, t.toId FROM dev d JOIN (SELECT repoRoot, count(*) AS n, min(id) AS toId FROM team GROUP BY 1 HAVING count(*) = 1) t ON t.repoRoot = d.repoRoot WHERE d.teamId IS NULL)",
    ),
    "j26_owns_repository": ("owns_repository", "SELECT DISTINCT t.id AS fromId, 'OWNS_REPOSITORY' AS type, r.id AS toId, json_extract_string(t.metaJson, '$.since') AS since, t.size AS teamSize FROM team t JOIN repo1 r ON r.repoRoot = t.repoRoot"),
    "j27_contributed_to": ("contributed_to", "SELECT DISTINCT d.id AS fromId, 'CONTRIBUTED_TO' AS type, r.id AS toId, coalesce(d.totalCommits, 0) AS commits, epoch_us(d.firstCommit) AS firstCommit, epoch_us(d.lastCommit) AS lastCommit, array_to_string(coalesce(d.primaryLanguages, []), ',') AS primaryLanguages FROM dev d JOIN repo1 r ON r.repoRoot = d.repoRoot"),
    "j28_committed": ("committed", "SELECT k.fromId, 'COMMITTED' AS type, k.toId, epoch_us(c.timestamp) AS timestamp, c.additions, c.deletions, coalesce(len(c.filesChanged), 0)::BIGINT AS filesChanged FROM committed k JOIN cm c ON c.id = k.toId"),
    "j29_contains_commit": ("contains_commit", "SELECT DISTINCT r.id AS fromId, 'CONTAINS_COMMIT' AS type, c.id AS toId FROM repo1 r JOIN cm c ON c.repoRoot = r.repoRoot"),
    "j30_modified_file": ("modified_file", "SELECT DISTINCT c.id AS fromId, 'MODIFIED_FILE' AS type, f.id AS toId, epoch_us(c.timestamp) AS timestamp FROM (SELECT id, repoRoot, timestamp, unnest(filesChanged) AS file FROM cm) c JOIN fl f ON f.repoRoot = c.repoRoot AND f.file = c.file"),
    "j31_collaborates_with": (
        "collaborates_with",
        ", touched AS (SELECT DISTINCT c.repoRoot, c.file, k.fromId AS dev FROM (SELECT id, repoRoot, unnest(filesChanged) AS file FROM cm) c JOIN committed k ON k.toId = c.id) SELECT a.dev AS fromId, 'COLLABORATES_WITH' AS type, b.dev AS toId, count(*) AS sharedFiles FROM touched a JOIN touched b ON a.repoRoot = b.repoRoot AND a.file = b.file WHERE a.dev <> b.dev GROUP BY 1, 3",
    ),
    "j32_manages_team": (
        "manages_team",
        "SELECT DISTINCT fromId, 'MANAGES_TEAM' AS type, toId FROM (SELECT d.id AS fromId, t.id AS toId, row_number() OVER (PARTITION BY t.id ORDER BY d.seq, d.id) rn FROM team t JOIN dev d ON d.repoRoot = t.repoRoot AND (t.lead = d.name OR t.lead = d.email)) WHERE rn = 1",
    ),
    "j33_has_member": (
        "has_member",
        "SELECT DISTINCT t.id AS fromId, 'HAS_MEMBER' AS type, d.id AS toId, CASE WHEN l.leadId = d.id THEN 'lead' ELSE 'member' END AS role, epoch_us(d.firstCommit) AS joinDate, coalesce(d.totalCommits, 0) AS contributions FROM team t JOIN dev d ON d.repoRoot = t.repoRoot AND d.teamId IN (t.id, t.name) LEFT JOIN (SELECT name, arg_min(id, (seq, id)) AS leadId FROM dev WHERE name IS NOT NULL GROUP BY 1) l ON l.name = t.lead",
    ),
}


def sql(name: str) -> str:
    return (BASE_EVENTS if EDGES[name][0] in EVENTS else BASE) + EDGES[name][1]


def counts() -> str:
    """SQL of the number of edges of each type."""
    # repositories' consumption is counted between nodes
    parts = [f"SELECT type, count(*) AS cnt FROM ({text}) GROUP BY 1" for name, (_, text) in EDGES.items() if name not in ("j24_consumes_api_from", "j31_collaborates_with")]
    parts.append(f"SELECT type, count(*) FROM ({EDGES['j31_collaborates_with'][1].split(') SELECT', 1)[0].replace(', touched AS', 'WITH touched AS')}) SELECT{EDGES['j31_collaborates_with'][1].split(') SELECT', 1)[1]}) GROUP BY 1")
    parts.append("SELECT 'CONSUMES_API_FROM', count(*) FROM rr JOIN repo1 a ON a.repoRoot = rr.fromId JOIN repo1 b ON b.repoRoot = rr.toId HAVING count(*) > 0")
    return J24_CTES + " " + " UNION ALL ".join(parts)
