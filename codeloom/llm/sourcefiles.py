"""Problems 3, 4 and 5 on whole tables: credentials, files that do not parse, functions with their documentation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .handwritten import extension

LANGUAGES = {"js": "js", "jsx": "js", "ts": "ts", "tsx": "tsx", "py": "py", "java": "java", "cs": "cs"}
TEMPLATE_SHARE = 0.002  # a description is a template if, with the error that a count of this size has, it stands over so large a share of all pairs of description and name
SURE = 1.96  # width of that error, in standard deviations
REPEATED = 3  # names from which a text is repeated at all: two may be a pair of functions


def _parsable(files: DataFrame) -> DataFrame:
    ext = extension(F.col("relPath"))
    return files.where(ext.isin(*LANGUAGES) & F.col("content").isNotNull()).select(F.col("fileId").alias("file_id"), ext.alias("ext"), "content")


# --- problem 4 -------------------------------------------------------------------------------------


def error_line(text: str, ext: str) -> int:
    """0 if the text is valid in the language of ``ext``, else the line of the first unrecoverable token."""
    from .lexers import first_error

    if not text.strip():
        return 0
    at = first_error(text, LANGUAGES[ext])
    return 0 if at < 0 else text.count("\n", 0, at) + 1


def parse_errors(files: DataFrame) -> DataFrame:
    """file_id, ext, error_line (0: valid) of each file with a known extension and non-null content.

    Each delivery is parsed where it is read, without moving its text; the narrow results of
    repeated deliveries then fall together.  Empty content is valid.  An empty table gives no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"file_id": pdf["file_id"], "ext": pdf["ext"], "error_line": [error_line(t, e) for t, e in zip(pdf["content"], pdf["ext"], strict=True)]})

    return _parsable(files).mapInPandas(run, "file_id bigint, ext string, error_line bigint").dropDuplicates(["file_id"])


def error_rates(files: DataFrame) -> DataFrame:
    """repo_root, language of the extension, files, invalid files and their rate."""
    lang = F.create_map(*[F.lit(x) for kv in {"js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "py": "python", "java": "java", "cs": "csharp"}.items() for x in kv])
    roots = files.select(F.col("fileId").alias("file_id"), F.col("repoRoot").alias("repo_root")).dropDuplicates(["file_id"])
    return (
        parse_errors(files)
        .join(roots, "file_id")
        .groupBy("repo_root", lang[F.col("ext")].alias("language"))
        .agg(F.count(F.lit(1)).alias("files"), F.sum((F.col("error_line") > 0).cast("bigint")).alias("invalid"))
        .withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
    )


# --- problem 5 -------------------------------------------------------------------------------------


def documented_functions(files: DataFrame, broken: bool = False) -> DataFrame:
    """file_id, line_no, func_name, description, says_more, valid of each documented function in a valid file, with ``broken`` in every file; one row for each function.

    The description's key is a digest of its text in lower case; ``telling`` drops the templates.
    """
    from ..session import cut

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .docs import documented, says_more

        for pdf in batches:
            rows = []
            for fid, ext, text in zip(pdf["file_id"], pdf["ext"], pdf["content"], strict=True):
                found = documented(text, LANGUAGES[ext]) if text.strip() else []
                if found:
                    valid = error_line(text, ext) == 0
                    if not valid and not broken:
                        continue
                    for line, name, head, description, _ in found:
                        key = hashlib.md5(" ".join(description.lower().split()).encode()).digest()[:8]
                        rows.append((fid, line, name, description, int.from_bytes(key, "big", signed=True), says_more(description, head), valid))
            yield pd.DataFrame(rows, columns=["file_id", "line_no", "func_name", "description", "key", "says_more", "valid"])

    out = _parsable(files).mapInPandas(run, "file_id bigint, line_no bigint, func_name string, description string, key bigint, says_more boolean, valid boolean")
    return cut(out.dropDuplicates(["file_id", "line_no", "func_name"]))


def telling(functions: DataFrame) -> DataFrame:
    """The functions whose description says more than their head and is no template of the corpus.

    Names are counted, not functions: copies of a file add none.  The share is judged by the lower end
    of its interval (Wilson's), which is the same rule for few functions and for many.
    """
    named = functions.select("key", "func_name").distinct()
    counts = named.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    n, t, z = F.col("n"), F.col("total"), F.lit(SURE)
    low = (n / t + z * z / (2 * t) - z * F.sqrt(n / t * (1 - n / t) / t + z * z / (4 * t * t))) / (1 + z * z / t)
    templates = counts.join(F.broadcast(total)).where((n >= REPEATED) & (low >= TEMPLATE_SHARE)).select("key")
    return functions.where("says_more").join(templates, "key", "left_anti")


# --- problem 3 -------------------------------------------------------------------------------------


def _credential_source(files: DataFrame, configs: DataFrame) -> DataFrame:
    f = files.where(F.col("content").isNotNull() & (F.col("content") != "")).select(
        F.lit("file").alias("record_kind"), F.col("fileId").cast("string").alias("record_id"), F.lower(F.regexp_extract(F.coalesce("relPath", F.lit("")), r"([^./\\]*)[/\\]*$", 1)).alias("label"), F.col("content").alias("text")
    )
    c = configs.where(F.col("valueSample").isNotNull() & (F.col("valueSample") != "")).select(
        F.lit("config").alias("record_kind"), F.col("id").alias("record_id"), F.coalesce("name", F.lit("")).alias("label"), F.col("valueSample").alias("text")
    )
    return f.unionByName(c)


_KEY = ["record_kind", "record_id"]


def postings(texts: DataFrame) -> DataFrame:
    """trigram, record_kind, record_id, chunk: the index of the collection, a row for each needed trigram of each chunk, once however often a text was delivered."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .secrets import bare, gram_rows, joined

        for pdf in batches:
            rows = []
            for kind, rid, text in zip(pdf["record_kind"], pdf["record_id"], pdf["text"], strict=True):
                rows.extend((grams, kind, rid, chunk) for chunk, grams in gram_rows(joined(text if kind == "file" else bare(text)[1])[0]))
            yield pd.DataFrame(rows, columns=["trigrams", "record_kind", "record_id", "chunk"])

    found = texts.mapInPandas(run, "trigrams array<int>, record_kind string, record_id string, chunk int")
    return found.select(F.explode("trigrams").alias("trigram"), *_KEY, "chunk").distinct()


def candidates(index: DataFrame) -> DataFrame:
    """record_kind, record_id, rules: the rules of which some alternative's trigrams are all in the record, by intersecting postings.

    The intersection is over the record's chunks together, so that a match may be of any length.
    """
    from .secrets import alternatives

    needs = index.sparkSession.createDataFrame(alternatives(), "rule string, alternative int, trigram int, needed int")  # as many rows as the rules' literals have trigrams
    held = index.select("trigram", *_KEY).distinct().join(F.broadcast(needs), "trigram").groupBy(*_KEY, "rule", "alternative").agg(F.count(F.lit(1)).alias("n"), F.first("needed").alias("needed"))
    return held.where("n = needed").groupBy(*_KEY).agg(F.collect_set("rule").alias("rules"))


def _with_rules(files: DataFrame, configs: DataFrame) -> DataFrame:
    """The texts that are to be verified, with the rules to run on each: files that are candidates, and configuration values, which their names may tell too."""
    from ..session import cut
    from .secrets import everywhere

    texts = _credential_source(files, configs)
    hits = candidates(cut(postings(texts)))
    rules = F.array_union(F.coalesce("rules", F.array().cast("array<string>")), F.array(*map(F.lit, everywhere())).cast("array<string>"))
    return texts.join(hits, _KEY, "left").select(*_KEY, "label", "text", rules.alias("rules")).where("record_kind = 'config' OR size(rules) > 0")


def _spans(pdf: pd.DataFrame) -> list[list[tuple[int, int, str]]]:
    from .secrets import find, in_value

    return [find(text, label, rules) if kind == "file" else in_value(text, label, rules) for kind, label, text, rules in zip(pdf["record_kind"], pdf["label"], pdf["text"], pdf["rules"], strict=True)]


def credentials(files: DataFrame, configs: DataFrame) -> DataFrame:
    """record_kind, record_id, line_no, rule of each line on which the value of a credential starts, once.

    The trigram index is a table in the checkpoint folder; texts are read again and verified where
    the index makes them candidates.  Null and empty texts give nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, r, t, spans in zip(pdf["record_kind"], pdf["record_id"], pdf["text"], _spans(pdf), strict=True):
                rows.extend((k, r, t.count("\n", 0, a) + 1 if k == "file" else 1, rule) for a, _, rule in spans)
            yield pd.DataFrame(rows, columns=["record_kind", "record_id", "line_no", "rule"])

    found = _with_rules(files, configs).mapInPandas(run, "record_kind string, record_id string, line_no bigint, rule string")
    return found.groupBy("record_kind", "record_id", "line_no").agg(F.min("rule").alias("rule"))


def redacted(files: DataFrame, configs: DataFrame) -> DataFrame:
    """record_kind, record_id, n_redacted, text of each record that holds a credential, its values replaced and all else as it was."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .secrets import redact

        for pdf in batches:
            rows = [(k, r, len(s), redact(t, s)) for k, r, t, s in zip(pdf["record_kind"], pdf["record_id"], pdf["text"], _spans(pdf), strict=True) if s]
            yield pd.DataFrame(rows, columns=["record_kind", "record_id", "n_redacted", "text"])

    return _with_rules(files, configs).mapInPandas(run, "record_kind string, record_id string, n_redacted bigint, text string").dropDuplicates(["record_kind", "record_id"])
