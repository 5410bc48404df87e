"""The graph's frames as SQL, for comparison: common table expressions that every comparison query starts with."""

PATH_ID = r"""(CASE WHEN length(regexp_replace('/' || regexp_replace(regexp_replace(trim({x}), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*', ''), '[?#].*$', ''), '/+', '/', 'g')) > 1
 THEN regexp_replace(regexp_replace('/' || regexp_replace(regexp_replace(trim({x}), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*', ''), '[?#].*$', ''), '/+', '/', 'g'), '/$', '')
 ELSE regexp_replace('/' || regexp_replace(regexp_replace(trim({x}), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*', ''), '[?#].*$', ''), '/+', '/', 'g') END)"""
_D = r"regexp_replace('/' || regexp_replace(regexp_replace(regexp_replace({x}, '(?i)^https?://[^/]+', ''), '[?#].*$', ''), '\$\{[^}]*\}', '', 'g'), '/+', '/', 'g')"
API_PATH = (
    r"(CASE WHEN {x} = '' THEN '' ELSE regexp_replace(CASE WHEN length(" + _D + r") > 1 THEN regexp_replace(" + _D + r", '/$', '') ELSE " + _D + r" END, '(?i)^/api(?:-v[0-9]+)?(?:/|$)', '/') END)"
)
METHOD = "upper(coalesce(nullif({x}, ''), 'GET'))"


def path_id(x: str) -> str:
    return PATH_ID.replace("{x}", x)


def api_path(x: str) -> str:
    return API_PATH.replace("{x}", x)


def method(x: str) -> str:
    return METHOD.replace("{x}", x)


TYPE = r"^\s*(?:(?:export|public|private|protected|internal|declare|const)\s+)*(interface|enum|type)\s+([A-Za-z_]\w*)\s*(?:[<{:=]|extends\b|implements\b|$)"
BASE = rf"""
WITH RECURSIVE fn AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq, snapshotVersion) rn FROM function_entity WHERE id IS NOT NULL) WHERE rn = 1),
cfg AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq, snapshotVersion) rn FROM config_entity WHERE id IS NOT NULL) WHERE rn = 1),
repo AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq, snapshotVersion) rn FROM repository_entity WHERE id IS NOT NULL) WHERE rn = 1),
team AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq, snapshotVersion) rn FROM team_entity WHERE id IS NOT NULL) WHERE rn = 1),
dev AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq, snapshotVersion, totalCommits) rn FROM developer_entity WHERE id IS NOT NULL) WHERE rn = 1),
cm AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq, ingestedAt) rn FROM commit_entity WHERE id IS NOT NULL) WHERE rn = 1),
fl AS (SELECT fileId, repoRoot, substr(absPath, length(repoRoot) + 2) AS file, md5(repoRoot || '|File|' || substr(absPath, length(repoRoot) + 2)) AS id, snapshotVersion
  FROM (SELECT *, row_number() OVER (PARTITION BY fileId ORDER BY scannedAt, snapshotVersion) rn FROM file_info WHERE fileId IS NOT NULL) WHERE rn = 1),
txt AS (SELECT fileId, repoRoot, substr(absPath, length(repoRoot) + 2) AS file, min(content) AS content FROM file_info WHERE content IS NOT NULL GROUP BY ALL),
ln0 AS (SELECT fileId, repoRoot, file, string_split(content, chr(10)) AS ls FROM txt),
lines AS (SELECT fileId, repoRoot, file, len(ls) AS n_lines, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS ln FROM ln0),
ntx AS (SELECT *, lead(line) OVER (PARTITION BY fileId ORDER BY ln) AS nxt FROM lines),
cl0 AS (SELECT fileId, repoRoot, file, ln, regexp_extract(line, '^\s*(?:(?:export|default|public|private|protected|internal|static|final|sealed|abstract|partial)\s+)*class\s+([A-Za-z_]\w*)', 1) AS name,
  regexp_replace(line, '"(?:[^"\\]|\\.)*"|''(?:[^''\\]|\\.)*''|`[^`]*`|//.*', '', 'g') AS bare, length(regexp_extract(line, '^[ \t]*')) AS indent, regexp_replace(line, '\s', '', 'g') <> '' AS solid FROM lines),
cl1 AS (SELECT *, length(regexp_replace(bare, '[^{{]', '', 'g')) - length(regexp_replace(bare, '[^}}]', '', 'g')) AS d, contains(bare, '}}') AS closes FROM cl0),
cl2 AS (SELECT *, sum(d) OVER (PARTITION BY fileId ORDER BY ln) AS depth, max(ln) FILTER (solid) OVER (PARTITION BY fileId ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, max(ln) FILTER (solid) OVER (PARTITION BY fileId) AS last FROM cl1),
cl3 AS (SELECT c.fileId, c.repoRoot, c.file, c.name, c.ln AS spanStart, coalesce(CASE WHEN ends_with(lower(c.file), '.py') THEN min(l.before) FILTER (l.solid AND l.indent <= c.indent AND l.ln > c.ln) ELSE min(l.ln) FILTER (l.closes AND l.depth <= c.depth - c.d) END, c.last) AS spanEnd
  FROM cl2 c JOIN cl2 l ON l.fileId = c.fileId AND l.ln >= c.ln WHERE c.name <> '' GROUP BY c.fileId, c.repoRoot, c.file, c.name, c.ln, c.last),
cls AS (SELECT DISTINCT md5(concat_ws('|', repoRoot, 'Class', file, name, spanStart, spanEnd)) AS id, name, repoRoot, file, spanStart, spanEnd FROM cl3),
err AS (SELECT fileId, md5(concat_ws('|', repoRoot, 'ErrorMessage', file, message, ln)) AS id, message, repoRoot, file, ln AS line FROM (SELECT *, coalesce(
   nullif(regexp_extract(concat_ws(chr(10), line, nxt), '^[^\n]*(?:throw|raise)[ \t]+(?:new[ \t]+)?[\w.]+\(\s*[^;"''`()\n]*["''`]([^"''`\n]+)["''`]', 1), ''),
   CASE WHEN ends_with(lower(file), '.java') THEN nullif(regexp_extract(line, '\.error\(\s*"([^"]+)"', 1), '') END) AS message FROM ntx WHERE regexp_matches(line, 'throw|raise|\.error\(')) WHERE message IS NOT NULL),
tdef AS (SELECT *, md5(concat_ws('|', repoRoot, 'TypeDefinition', file, name, ln)) AS id FROM (SELECT fileId, repoRoot, file, ln, regexp_extract(line, '{TYPE}', 1) AS kind, regexp_extract(line, '{TYPE}', 2) AS name FROM lines WHERE regexp_matches(line, '{TYPE}'))),
fw AS (SELECT fileId, repoRoot, file, CASE WHEN contains(lower(content), 'jest') THEN 'jest' WHEN contains(lower(content), 'mocha') THEN 'mocha' WHEN contains(lower(content), 'pytest') THEN 'pytest' WHEN contains(lower(content), 'unittest') THEN 'unittest' WHEN contains(lower(content), 'junit') THEN 'junit' WHEN contains(lower(content), 'xunit') THEN 'xunit' WHEN contains(lower(content), 'nunit') THEN 'nunit' END AS framework FROM txt),
tst AS (SELECT DISTINCT md5(concat_ws('|', repoRoot, 'Test', file, coalesce(framework, 'unknown'))) AS id, repoRoot, file, coalesce(framework, 'unknown') AS framework FROM fw WHERE framework IS NOT NULL OR regexp_matches(lower(file), '\.test\.|\.spec\.')),
pk AS (SELECT DISTINCT repoRoot, manager, name, md5('Package|' || manager || '|' || name) AS id FROM (
  SELECT repoRoot, CASE WHEN j <> '' THEN 'maven' ELSE 'pip' END AS manager, CASE WHEN j <> '' THEN j WHEN p <> '' THEN p || '.' || q END AS name FROM (
   SELECT repoRoot, regexp_extract(line, '^import ([\w.]+);', 1) AS j, regexp_extract(line, '^from ([\w.]+) import (\w+)', 1) AS p, regexp_extract(line, '^from ([\w.]+) import (\w+)', 2) AS q FROM lines))
  WHERE name IS NOT NULL AND NOT regexp_matches(name, '^(java|javax|os|sys)[.]')),
api0 AS (SELECT repoRoot, file, 'provided' AS direction, a.method AS method, a.path AS route FROM (SELECT repoRoot, file, unnest(apisProvided) AS a FROM fn)
  UNION SELECT repoRoot, file, 'consumed', a.method, a.url FROM (SELECT repoRoot, file, unnest(apisUsed) AS a FROM fn)),
api AS (SELECT *, {method('method')} AS verb, md5(concat_ws('|', repoRoot, 'API', direction, {method("method")}, {path_id("route")})) AS id FROM api0 WHERE route IS NOT NULL),
tab AS (SELECT repoRoot, file, name, md5(repoRoot || '|DatabaseTable|' || name) AS id FROM (SELECT DISTINCT repoRoot, file, unnest(tablesQueried) AS name FROM fn) WHERE name IS NOT NULL),
var AS (SELECT md5(concat_ws('|', repoRoot, 'Variable', file, name, spanStart, spanEnd)) AS id, * FROM (
  SELECT DISTINCT repoRoot, file, spanStart, spanEnd, unnest(list_concat(coalesce(reads, []), coalesce(writes, []))) AS name FROM fn WHERE spanStart IS NOT NULL) WHERE name IS NOT NULL),
ents AS (SELECT id, 'File' AS type, file AS name, repoRoot, file FROM fl UNION SELECT id, 'Function', name, repoRoot, file FROM fn UNION SELECT id, 'Config', name, repoRoot, file FROM cfg
  UNION SELECT id, 'Class', name, repoRoot, file FROM cls UNION SELECT id, 'Variable', name, repoRoot, file FROM var UNION SELECT id, 'ErrorMessage', message, repoRoot, file FROM err UNION SELECT id, 'TypeDefinition', name, repoRoot, file FROM tdef
  UNION SELECT id, 'Test', file, repoRoot, file FROM tst UNION SELECT id, 'API', verb || ' ' || route, repoRoot, file FROM api UNION SELECT id, 'DatabaseTable', name, repoRoot, file FROM tab UNION SELECT id, 'Package', name, repoRoot, NULL FROM pk
  UNION SELECT id, 'Repository', name, repoRoot, NULL FROM repo UNION SELECT id, 'Developer', name, repoRoot, NULL FROM dev UNION SELECT id, 'Team', name, repoRoot, NULL FROM team UNION SELECT id, 'Commit', name, repoRoot, NULL FROM cm),
nodes AS (SELECT id, type, name, repoRoot, file FROM (SELECT *, row_number() OVER (PARTITION BY id, type ORDER BY repoRoot NULLS FIRST, file NULLS FIRST, name NULLS FIRST) AS rn FROM ents) WHERE rn = 1),
apin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file NULLS FIRST, direction, route) AS rn FROM api) WHERE rn = 1),
repo1 AS (SELECT repoRoot, id, name FROM (SELECT *, row_number() OVER (PARTITION BY repoRoot ORDER BY seq, id) AS rn FROM repo) WHERE rn = 1),
calls AS (SELECT DISTINCT f.id AS fromId, g.id AS toId FROM (SELECT id, repoRoot, unnest(calls) AS c FROM fn) f JOIN fn g ON g.repoRoot = f.repoRoot AND g.name = f.c WHERE f.id <> g.id),
provides AS (SELECT DISTINCT f.id AS fromId, a.id AS toId FROM (SELECT id, repoRoot, file, unnest(apisProvided) AS u FROM fn) f JOIN api a ON a.direction = 'provided' AND a.repoRoot = f.repoRoot AND a.file = f.file AND a.route = f.u.path AND {method("a.method")} = {method("f.u.method")}),
uses AS (SELECT DISTINCT f.id AS fromId, a.id AS toId FROM (SELECT id, repoRoot, file, unnest(apisUsed) AS u FROM fn) f JOIN api a ON a.direction = 'consumed' AND a.repoRoot = f.repoRoot AND a.file = f.file AND a.route = f.u.url),
qtab AS (SELECT DISTINCT f.id AS fromId, t.id AS toId FROM (SELECT id, repoRoot, unnest(tablesQueried) AS c FROM fn) f JOIN (SELECT DISTINCT id, repoRoot, name FROM tab) t ON t.repoRoot = f.repoRoot AND t.name = f.c),
ucfg AS (SELECT DISTINCT f.id AS fromId, t.id AS toId FROM (SELECT id, repoRoot, unnest(configsUsed) AS c FROM fn) f JOIN cfg t ON t.repoRoot = f.repoRoot AND t.name = f.c),
emits AS (SELECT DISTINCT f.id AS fromId, e.id AS toId FROM fn f JOIN err e ON e.repoRoot = f.repoRoot AND e.file = f.file AND e.line BETWEEN f.spanStart AND f.spanEnd),
vres AS (SELECT fnId, name, varId, repoRoot FROM (SELECT f.id AS fnId, v.name, v.id AS varId, f.repoRoot, (v.spanStart >= f.spanStart AND v.spanEnd <= f.spanEnd)::INT AS inside,
   max((v.spanStart >= f.spanStart AND v.spanEnd <= f.spanEnd)::INT) OVER (PARTITION BY f.id, v.name) AS best FROM fn f JOIN var v ON v.repoRoot = f.repoRoot AND v.file = f.file WHERE f.spanStart IS NOT NULL) WHERE inside = best),
dkey AS (SELECT repoRoot, seq, id, 'm:' || lower(email) AS key FROM dev UNION ALL SELECT repoRoot, seq, id, 'm:' || a FROM (SELECT repoRoot, seq, id, unnest(aliases) AS a FROM dev) UNION ALL SELECT repoRoot, seq, id, 'n:' || name FROM dev),
committed AS (SELECT toId, fromId FROM (SELECT c.id AS toId, d.id AS fromId, row_number() OVER (PARTITION BY c.id ORDER BY d.seq, d.id) rn FROM cm c JOIN dkey d ON d.repoRoot = c.repoRoot AND d.key IN ('m:' || c.authorEmail, 'n:' || c.author)) WHERE rn = 1),
dep AS (SELECT fromId, toId FROM calls UNION SELECT * FROM uses UNION SELECT * FROM provides UNION SELECT * FROM qtab UNION SELECT * FROM ucfg UNION SELECT * FROM emits)
"""

# The same with the functions that events stand for.
_K = "(props::JSON->>'$.k')::INT"
_EVENTS = f"""ev AS (SELECT md5('Function|' || event_id) AS id, 'f' || k % 8 AS name, 'user-' || user_id AS repoRoot, 'user-' || user_id AS file, event_id::INT AS spanStart, (event_id + 500)::INT AS spanEnd, 'v1' AS snapshotVersion, event_id AS seq,
  CASE WHEN event_type = 'view' THEN ['f' || (k // 8) % 8] END AS calls, CASE WHEN event_type = 'purchase' THEN [{{'method': 'GET', 'path': '/shop/' || k || '/' || event_id // 256 || '/{{item}}'}}] END AS apisProvided,
  CASE WHEN event_type = 'click' THEN [{{'method': 'GET', 'url': 'https://shop.example/shop/' || k || '/' || event_id // 256 || '/' || event_id}}] END AS apisUsed
  FROM (SELECT *, {_K} AS k FROM events) WHERE event_type = 'view' OR event_type IN ('purchase', 'click') AND k < 25),"""
_FN = BASE[BASE.index("fn AS (") : BASE.index("cfg AS (")].rstrip().rstrip(",")
BASE_EVENTS = BASE.replace(_FN + ",", f"{_EVENTS} {_FN[:-1]} UNION ALL BY NAME SELECT * FROM ev),")
