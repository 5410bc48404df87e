"""Source files of repositories: globs, .gitignore rules and languages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Globs of what is scanned, and of what never is. Fixed values.
INCLUDES = ("**/*.js", "**/*.jsx", "**/*.ts", "**/*.tsx", "**/*.py", "**/*.java", "**/*.cs")
EXCLUDES = ("node_modules/**", ".git/**", "build/**", "dist/**", "out/**", "bin/**", "obj/**", "target/**", "**/*.min.*", "**/*.map", "**/.DS_Store", ".idea/**", ".vscode/**")
SCANNED = {"js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "py": "python", "java": "java", "cs": "csharp"}


def glob_pattern(glob: str) -> str:
    """A glob as an anchored regular expression: ** spans folders, * and ? do not."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def any_glob(path: Column, globs: tuple[str, ...]) -> Column:
    return path.rlike("|".join(glob_pattern(g) for g in globs)) if globs else F.lit(False)


def ignore_pattern(rule: str) -> tuple[str, bool] | None:
    """(pattern, negated) of a .gitignore line; None for blanks and comments."""
    rule = rule.strip()
    if not rule or rule.startswith("#"):
        return None
    negated = rule.startswith("!")
    rule = rule.lstrip("!")
    anchored = "/" in rule.rstrip("/")
    body = glob_pattern(rule.strip("/"))[1:-1]
    return ("^" if anchored else "^(?:.*/)?") + body + ("/.*$" if rule.endswith("/") else "(?:/.*)?$"), negated


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether the rules, in order, leave a path out; the last rule that fits decides."""
    out = F.lit(False)
    for r in rules:
        p = ignore_pattern(r)
        if p:
            out = F.when(path.rlike(p[0]), F.lit(not p[1])).otherwise(out)
    return out


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SCANNED.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)\z", 1))), F.lit("unknown"))


def _paths(spark: SparkSession, root: str, excludes: tuple[str, ...]) -> DataFrame:
    """relPath of the files below a root; folders at the root that an exclude names whole are not entered.

    The root's own entries are listed once; each folder is then walked in a task.
    """
    from pyarrow import fs

    disk, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    skipped = {g[:-3] for g in excludes if g.endswith("/**") and "*" not in g[:-3]}
    entries = [(x.path, x.type == fs.FileType.Directory) for x in disk.get_file_info(fs.FileSelector(base)) if x.base_name not in skipped]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        disk = fs.FileSystem.from_uri(root)[0] if "://" in root else fs.LocalFileSystem()
        for pdf in batches:
            for path, folder in zip(pdf["path"], pdf["folder"], strict=True):
                found = [x.path for x in disk.get_file_info(fs.FileSelector(path, recursive=True)) if x.type == fs.FileType.File] if folder else [path]
                yield pd.DataFrame({"path": found, "relPath": [f[len(base.rstrip("/")) + 1 :] for f in found]})

    return spark.createDataFrame(entries, "path string, folder boolean").repartition(max(1, min(len(entries), 1024))).mapInPandas(run, "path string, relPath string")


def _gitignore(spark: SparkSession, root: str) -> tuple[str, ...]:
    from pyarrow import fs

    disk, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    try:
        with disk.open_input_stream(f"{base.rstrip('/')}/.gitignore") as f:
            return tuple(f.read().decode("utf-8", "replace").splitlines())
    except (FileNotFoundError, IsADirectoryError, OSError):
        return ()


def scan(spark: SparkSession, root: str, includes: tuple[str, ...] = INCLUDES, excludes: tuple[str, ...] = EXCLUDES, ignore: tuple[str, ...] = (), gitignore: bool = True) -> DataFrame:
    """repoRoot, relPath, absPath, language, content of a repository's files; given lists replace the defaults.

    Paths are filtered by globs, the root's .gitignore and ``ignore`` before any content is read, and
    read where they are spread to.  Files that can't be read are left out.
    """
    rules = [*(_gitignore(spark, root) if gitignore else ()), *ignore]
    rel = F.col("relPath")
    kept = _paths(spark, root, excludes).where(any_glob(rel, includes) & ~any_glob(rel, excludes) & ~ignored(rel, rules))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        disk = fs.FileSystem.from_uri(root)[0] if "://" in root else fs.LocalFileSystem()
        for pdf in batches:
            for path, relative in zip(pdf["path"], pdf["relPath"], strict=True):
                try:
                    with disk.open_input_stream(path) as f:
                        yield pd.DataFrame({"relPath": [relative], "absPath": [path], "content": [f.read().decode("utf-8", "replace")]})
                except OSError:
                    continue

    rows = kept.repartition("relPath").mapInPandas(read, "relPath string, absPath string, content string")
    return rows.select(F.lit(root.rstrip("/")).alias("repoRoot"), "relPath", "absPath", language(F.col("relPath")).alias("language"), "content")
