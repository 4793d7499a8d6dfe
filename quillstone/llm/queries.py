"""The queries ``pN_...`` of the training-data operators and the SQL that checks some of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import leaks, lookalike, mixture, near_duplicates, residue, shared_spans, splitting, sql
from . import tokens as tk


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized_sections(_read(spark, d, "ingest"))


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_records(_read(spark, d, "ingest"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.excluded(_read(spark, d, "ingest"), "row_id", ["title", "body"]).withColumnRenamed("id", "row_id")


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    out = residue.residue(_read(spark, d, "ingest"), "row_id", ["title", "body"])
    return out.filter("residue_chars = 0").select(F.col("id").alias("row_id"), "prose_chars")


def p2_residue(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(_read(spark, d, "ingest"), "row_id", ["title", "body"]).filter("residue_chars > 0").withColumnRenamed("id", "row_id")


def p3_token_budget(spark: SparkSession, d: str) -> DataFrame:
    ingest, documents = _read(spark, d, "ingest"), _read(spark, d, "documents")
    of_ingest = {
        "component": tk.regular(F.col("component")), "lang": tk.language(F.col("lang")), "doc_type": F.col("doc_type"), "host": tk.host(F.col("source_url")),
    }
    of_documents = {
        "source": tk.regular(F.col("source")), "component": tk.regular(F.col("component")), "lang": tk.language(F.col("lang")),
        "doc_type": F.col("doc_type"), "host": F.lower(F.col("site")),
    }
    a = tk.token_budget(ingest, "row_id", "body", of_ingest).withColumn("corpus", F.lit("ingest"))
    return a.unionByName(tk.token_budget(documents, "doc_id", "text", of_documents).withColumn("corpus", F.lit("documents")))


def p3_tokens(spark: SparkSession, d: str) -> DataFrame:
    a = tk.with_tokens(_read(spark, d, "ingest").select(F.lit("ingest").alias("corpus"), F.col("row_id").alias("id"), F.col("body").alias("text")), ["corpus", "id"], "text")
    b = tk.with_tokens(_read(spark, d, "documents").select(F.lit("documents").alias("corpus"), F.col("doc_id").alias("id"), "text"), ["corpus", "id"], "text")
    return a.unionByName(b)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(_read(spark, d, "ingest"), "row_id", ["title", "body"])


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_classes(_read(spark, d, "ingest"), "row_id", ["title", "body"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_rows(_read(spark, d, "ingest"), "row_id", "body")


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(_read(spark, d, "ingest"), "row_id", "body").withColumnRenamed("id", "row_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(_read(spark, d, "documents"), _read(spark, d, "eval_items"))


def p6_leak_report(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leak_report(_read(spark, d, "documents"), _read(spark, d, "eval_items"))


def p6_without_leaks(spark: SparkSession, d: str) -> DataFrame:
    out = leaks.without_leaks(_read(spark, d, "documents"), _read(spark, d, "eval_items"))
    return out.select("doc_id", "removed_chars", F.length("text").cast("long").alias("chars_left"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    documents = _read(spark, d, "documents")
    weight = mixture.completeness(documents, ["lang", "site", "component", "doc_type"])
    return mixture.sized(documents, "doc_id", "text", "source", weight)


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mixture(_sized(spark, d), _read(spark, d, "source_weights"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.shares(_sized(spark, d), _read(spark, d, "source_weights"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_spans(_read(spark, d, "documents"))


def p8_shared_parts(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_parts(_read(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return sql.texts()
