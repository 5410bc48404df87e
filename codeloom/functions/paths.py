"""Scalar functions on columns: identities, paths, names, languages, Spring method names, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages of file endings. Fixed values.
LANGUAGE_BY_ENDING = {
    "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "py": "python", "java": "java", "cs": "csharp", "cpp": "cpp", "c": "c", "h": "c", "hpp": "cpp", "go": "go", "rs": "rust", "php": "php", "rb": "ruby",
    "kt": "kotlin", "swift": "swift", "scala": "scala", "sh": "shell", "sql": "sql", "html": "html", "css": "css", "scss": "scss", "less": "less", "json": "json", "xml": "xml", "yaml": "yaml", "yml": "yaml", "md": "markdown",
}
# Operator words at the end of a derived-query field. Fixed values, longest first.
FIELD_OPERATORS = "IsNotNull|NotContaining|StartingWith|GreaterThan|EndingWith|Containing|IgnoreCase|NotLike|LessThan|NotNull|Between|IsNull|Before|After|NotIn|False|Like|True|Not|In"


def stable_id(*parts: Column) -> Column:
    """md5 of the parts joined by a bar; a null part counts as empty."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def path_id(url: Column) -> Column:
    """Path of a URL or route for identities: no scheme, host, query or fragment, one leading slash, none doubled or trailing."""
    x = F.regexp_replace(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*", "")
    x = F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace(x, r"[?#].*\z", "")), "/+", "/")
    return F.regexp_replace(x, r"(?<=.)/\z", "")


def decode_uri(x: Column) -> Column:
    """Percent escapes decoded but for those of reserved characters; malformed text stays."""
    kept = F.regexp_replace(F.regexp_replace(x, r"(?i)%(2F|3F|23|3B|2C|40|26|3D|2B|24|3A)", "%25$1"), r"\+", "%2B")
    return F.coalesce(F.try_url_decode(kept), x)


def api_path(url: Column) -> Column:
    """Path by which consumed and provided endpoints are compared; empty stays empty, null too."""
    x = F.regexp_replace(url, r"(?i)^https?://[^/]+", "")
    x = F.regexp_replace(F.regexp_replace(x, r"[?#].*\z", ""), r"\$\{[^}]*\}", "")
    x = F.regexp_replace(F.concat(F.lit("/"), x), "/+", "/")
    x = F.regexp_replace(F.regexp_replace(x, r"(?<=.)/\z", ""), r"(?i)^/api(?:-v[0-9]+)?(?:/|\z)", "/")
    x = decode_uri(x)
    return F.when(url == "", F.lit("")).otherwise(x)


def is_full_url(url: Column) -> Column:
    return url.rlike(r"(?i)^(?:https?:)?//")


def method_of(method: Column) -> Column:
    return F.upper(F.coalesce(F.nullif(method, F.lit("")), F.lit("GET")))


def match_confidence(c_url: Column, c_method: Column, c_repo: Column, p_path: Column, p_method: Column, p_repo: Column) -> Column:
    """How well a consumed URL fits a provided path: equality, containment, equal normal forms, method, repository and length, within 0 and 1."""
    slash = lambda u: F.when(u.startswith("/"), u).otherwise(F.concat(F.lit("/"), F.coalesce(u, F.lit(""))))
    score = F.when(c_url == p_path, 0.5).when(F.contains(c_url, F.coalesce(p_path, F.lit(""))), 0.3).otherwise(0.0)
    score = score + F.when(api_path(slash(c_url)) == api_path(slash(p_path)), 0.2).otherwise(0.0)
    score = score + F.when(method_of(c_method) == method_of(p_method), 0.3).otherwise(0.0)
    score = score - F.when(c_repo == p_repo, 0.2).otherwise(0.0)
    size = F.length(F.coalesce(p_path, F.lit("")))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score + F.when(size > 10, 0.1).otherwise(0.0) + F.when(size > 20, 0.1).otherwise(0.0)))


def person_name(name: Column) -> Column:
    """Trimmed, single spaces, only ASCII word characters, blanks, points and dashes, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(name), r"\s+", " "), r"[^A-Za-z0-9_\s.\-]", ""))


def file_ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)\z", 1))


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGE_BY_ENDING.items() for x in kv])
    return F.coalesce(F.try_element_at(table, file_ending(path)), F.lit("other"))


def fields_of(part: Column) -> Column:
    """Fields of a derived query's condition: up to OrderBy, split at And and Or, without one operator, a leading Is, and with a small first letter."""
    cond = F.regexp_replace(part, r"OrderBy.*\z", "")
    names = F.filter(F.split(cond, r"And|Or"), lambda x: x != "")
    bare = F.transform(names, lambda x: F.regexp_replace(F.regexp_replace(x, rf"(?:{FIELD_OPERATORS})\z", ""), r"^Is(?=.)", ""))
    return F.transform(F.filter(bare, lambda x: x != ""), lambda x: F.concat(F.lower(F.substring(x, 1, 1)), x.substr(F.lit(2), F.length(x))))


# What a derived query's name begins with, and the words that may stand before By. Fixed values.
_DERIVED = (r"^(find|read|get|query|search|stream)(?:One|First|Top|Distinct|All)?By(.+)\z", r"^(count)(?:Distinct)?By(.+)\z", r"^(exists)By(.+)\z", r"^(delete|remove)(?:All)?By(.+)\z")


def query_operation(name: Column) -> Column:
    """The verb of a derived query; save, delete, findAll of the known others; null else."""
    verbs = [F.nullif(F.regexp_extract(name, rx, 1), F.lit("")) for rx in _DERIVED]
    return F.coalesce(*verbs, F.when(name.rlike("^(?:save|persist|store|insert|update)"), "save").when(name.rlike("^(?:delete|remove)"), "delete").when(name.rlike(r"^(?:find|get|load|fetch)All\z"), "findAll"))


def query_fields(name: Column) -> Column:
    """Fields of a derived query's name; null for other names."""
    part = F.coalesce(*[F.nullif(F.regexp_extract(name, rx, 2), F.lit("")) for rx in _DERIVED])
    return F.when(part.isNotNull(), fields_of(part))


def is_http_call(callee: Column) -> Column:
    """Whether a callee's text is an HTTP client's call; routes of server frameworks are none, calls that end in a verb are."""
    route = callee.rlike(r"(?i)^(?:app|router|server|fastify|koa|hapi|restify)\.(?:get|post|put|delete|patch)\z")
    return ~route & callee.rlike(r"(?i)^(?:fetch|axios|request)\z|\.(?:get|post|put|delete|patch)\z|^(?:superagent|got|needle)\.|axios")


def method_in_name(callee: Column) -> Column:
    """The HTTP verb that a callee is or ends in, in capitals; null without one."""
    return F.nullif(F.upper(F.regexp_extract(callee, r"(?i)(?:^|\.)(get|post|put|delete|patch)\z", 1)), F.lit(""))


def server_context(text: Column) -> Column:
    low = F.lower(text)
    return low.rlike(r"\b(?:from\s+['\"](?:express|fastify|koa|hapi|restify)['\"]|require\(['\"](?:express|fastify|koa|hapi|restify)['\"]\))") | low.rlike(r"\b(?:createserver\s*\(|express\s*\(|fastify\s*\(|new\s+koa\s*\(|restify\.)")


def frontend_context(text: Column) -> Column:
    return F.lower(text).rlike(r"\bfrom\s+['\"](?:react|react-dom|next|vite|vue|@angular/core)['\"]")


def visibility(modifiers: Column) -> Column:
    """public, private, protected by what the modifiers hold, in that order; package-private else."""
    return F.when(modifiers.contains("public"), "public").when(modifiers.contains("private"), "private").when(modifiers.contains("protected"), "protected").otherwise("package-private")


def annotation(text: Column) -> Column:
    """struct(name, path, method) of an annotation's text: the last part of its name, its first quoted string, the request method it names."""
    name = F.element_at(F.split(F.regexp_extract(text, r"^@([A-Za-z0-9_.$]+)", 1), r"\."), -1)
    inner = F.regexp_extract(text, r"(?s)\((.*)\)", 1)
    path = F.when(inner.contains('"'), F.regexp_extract(inner, r'"([^"]*)"', 1))
    return F.struct(name.alias("name"), path.alias("path"), F.nullif(F.upper(F.regexp_extract(inner, r"(?i)RequestMethod\.(GET|POST|PUT|DELETE|PATCH)", 1)), F.lit("")).alias("method"))


def keywords(prompt: Column) -> Column:
    """Words of a prompt: lower case, letters, digits and _ / . -, without empties."""
    return F.filter(F.split(F.regexp_replace(F.lower(prompt), r"[^a-z0-9_/.\-\s]", " "), r"\s+"), lambda w: w != "")


def test_framework(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(low.contains("jest"), "jest").when(low.contains("mocha"), "mocha").when(low.contains("pytest"), "pytest").when(low.contains("unittest"), "unittest")
        .when(low.contains("junit"), "junit").when(low.contains("xunit"), "xunit").when(low.contains("nunit"), "nunit")
    )
