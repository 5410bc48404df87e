"""Queries of the training-data problems, by name: (spark, folder of the tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import abuse, entities, packing
from .handwritten import find_foreign
from .sourcefiles import credentials, documented_functions, error_rates, parse_errors, redacted, telling


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return find_foreign(table(spark, d, "file_info")).select("file_id").distinct()


def p1_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Why each file is no hand-written source."""
    return find_foreign(table(spark, d, "file_info"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return entities.pairs(entities.resolve(table(spark, d, "developer_entity")))


def p2_entities(spark: SparkSession, d: str) -> DataFrame:
    """Each record with its entity."""
    return entities.resolve(table(spark, d, "developer_entity"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials(table(spark, d, "file_info"), table(spark, d, "config_entity")).select("record_kind", "record_id", "line_no")


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Each record with a credential, its text redacted."""
    return redacted(table(spark, d, "file_info"), table(spark, d, "config_entity"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return parse_errors(table(spark, d, "file_info")).where("error_line > 0").select("file_id")


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rate of files that do not parse, by repository and language."""
    return error_rates(table(spark, d, "file_info"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return telling(documented_functions(table(spark, d, "file_info"))).select("file_id", "line_no", "func_name")


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each function with telling documentation, its description, and what an older scan says that it returns; valid is false where the file does not parse."""
    files = table(spark, d, "file_info").select(F.col("fileId").alias("file_id"), F.col("absPath")).dropDuplicates(["file_id"])
    known = (
        table(spark, d, "function_entity")
        .where(F.col("name").isNotNull())
        .groupBy(F.concat_ws("/", "repoRoot", "file").alias("absPath"), F.col("name").alias("func_name"))
        .agg(F.min("returns").alias("returns"), F.lit(True).alias("listed"))
    )
    pairs = telling(documented_functions(table(spark, d, "file_info"), broken=True)).select("file_id", "line_no", "func_name", "description", "valid")
    return (
        pairs.join(files, "file_id", "left")
        .join(known, ["absPath", "func_name"], "left")
        .select("file_id", "line_no", "func_name", "description", "returns", F.coalesce("listed", F.lit(False)).alias("listed"), "valid")
    )


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    """Each document's container, for each size of containers."""
    return packing.pack(packing.token_counts(table(spark, d, "documents")), table(spark, d, "pack_specs"))


def p6_fills(spark: SparkSession, d: str) -> DataFrame:
    """The fill of each container."""
    return packing.fills(p6_packed(spark, d), table(spark, d, "pack_specs"))


def p7_mixed(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each mix, with their repeats."""
    return packing.mix(packing.token_counts(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of each source that each mix really has."""
    return packing.shares(p7_mixed(spark, d), table(spark, d, "mix_targets"))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.score(table(spark, d, "documents"), table(spark, d, "review_labels"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).where(F.col("score") >= abuse.THRESHOLD).select("doc_id")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(_scores(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_kinds": p1_kinds,
        "p2_found": p2_found,
        "p2_entities": p2_entities,
        "p3_found": p3_found,
        "p3_redacted": p3_redacted,
        "p4_found": p4_found,
        "p4_rates": p4_rates,
        "p5_found": p5_found,
        "p5_pairs": p5_pairs,
        "p6_packed": p6_packed,
        "p6_fills": p6_fills,
        "p7_mixed": p7_mixed,
        "p7_shares": p7_shares,
        "p8_found": p8_found,
        "p8_scores": p8_scores,
        "p8_rates": p8_rates,
    }


def oracle_sql() -> dict[str, str]:
    """None: no problem of this package can be stated in SQL; tests/llm holds their brute-force checks."""
    return {}
