"""Spring texts: security patterns, repositories, JPQL and SQL statements, components."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Repository interfaces in the order in which they are looked for; the first that a text contains counts. Fixed values.
INTERFACES = ("JpaRepository", "CrudRepository", "PagingAndSortingRepository", "Repository", "MongoRepository", "ReactiveCrudRepository", "ReactiveMongoRepository", "ElasticsearchRepository")


def jpql_tables(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)\b(?:FROM|JOIN)\s+([A-Za-z_]\w*)"), 1))


def jpql_columns(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"\b[A-Za-z_]\w*\.([A-Za-z_]\w*)"), 1)
    return F.array_distinct(F.filter(found, lambda c: ~c.isin("class", "size", "length")))


def sql_tables(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\b(?:FROM|JOIN|UPDATE|INTO)\s+([A-Za-z_]\w*)"), 1), F.lower))


def sql_columns(text: Column) -> Column:
    """Columns of the select list and of comparisons, in lower case."""
    chosen = F.filter(F.transform(F.split(F.regexp_extract(text, r"(?is)\bSELECT\s+(.*?)\s+FROM\b", 1), ","), lambda x: F.lower(F.regexp_extract(x, r"([A-Za-z_]\w*)\s*\z", 1))), lambda x: x != "")
    compared = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)([A-Za-z_]\w*)\s*(?:=|<>|!=|>=|<=|>|<|\bLIKE\b|\bIN\b)"), 1), F.lower)
    return F.array_distinct(F.concat(chosen, compared))


def repository_interface(text: Column) -> Column:
    out = F.when(text.contains(INTERFACES[0]), INTERFACES[0])
    for i in INTERFACES[1:]:
        out = out.when(text.contains(i), i)
    return out


def repository_types(text: Column) -> Column:
    """struct(entityType, idType) of the interface's two type arguments; nulls without them."""
    rx = F.concat(repository_interface(text), F.lit(r"\s*<\s*([^,>]+)\s*,\s*([^>]+)\s*>"))
    part = lambda k: F.nullif(F.trim(F.call_function("regexp_extract", text, rx, F.lit(k))), F.lit(""))
    return F.struct(part(1).alias("entityType"), part(2).alias("idType"))


def entity_info(text: Column) -> Column:
    """struct(isEntity, tableName, schemaName) of a class's text."""
    table = F.regexp_extract(text, r"@Table\s*\([^)]*\)", 0)
    part = lambda k: F.when(text.contains("@Entity"), F.nullif(F.regexp_extract(table, rf'{k}\s*=\s*"([^"]+)"', 1), F.lit("")))
    return F.struct(text.contains("@Entity").alias("isEntity"), part("name").alias("tableName"), part("schema").alias("schemaName"))


def security_paths(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r'(?:antMatchers|mvcMatchers|requestMatchers)\s*\(\s*(?:HttpMethod\.\w+\s*,\s*)?"([^"]+)"'), 1))


# Annotations of security components. Fixed values.
SECURITY_ANNOTATIONS = ("@EnableWebSecurity", "@EnableGlobalMethodSecurity", "@EnableMethodSecurity", "@PreAuthorize", "@PostAuthorize", "@Secured", "@RolesAllowed")


def security_annotations(text: Column) -> Column:
    return F.filter(F.array(*map(F.lit, SECURITY_ANNOTATIONS)), lambda a: F.contains(text, a))


def security_component(text: Column, name: Column) -> Column:
    """Type of a security component by its class's text and name, the first rule that fits; null else."""
    return (
        F.when(text.contains("implements UserDetailsService"), "UserDetailsService")
        .when(text.contains("AuthenticationManager") & text.contains("@Bean"), "AuthenticationManager")
        .when(text.contains("extends OncePerRequestFilter") | text.contains("extends GenericFilterBean") | name.contains("Filter"), "SecurityFilter")
        .when(text.contains("EnableWebSecurity") | text.contains("@Configuration") & name.contains("Security"), "SecurityConfig")
    )


def path_matches_literal(path: Column, pattern: Column) -> Column:
    """Ant pattern as first written: ** becomes any one character and the rest of its segment."""
    rx = F.regexp_replace(F.regexp_replace(F.regexp_replace(pattern, r"\*\*", ".*"), r"\*", "[^/]*"), r"\?", ".")
    return F.rlike(path, F.concat(F.lit("^"), rx, F.lit(r"\z")))


def path_matches(path: Column, pattern: Column) -> Column:
    """Ant pattern as meant: ** spans segments, * one of them."""
    rx = F.regexp_replace(F.regexp_replace(F.regexp_replace(pattern, r"\*\*", "\u0001"), r"\*", "[^/]*"), "\u0001", ".*")
    return F.rlike(path, F.concat(F.lit("^"), rx, F.lit(r"\z")))
