"""Corpus preparation: configured sources and pages to Markdown files with front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as hx
from ..functions import text as tx
from ..operators import chunking


def listed(spark: SparkSession, pages: list[tuple[str, str]]) -> DataFrame:
    """A fixed list of pages ``(title, url)`` as ``ordinal, title, url``, in its order and counted from 1."""
    return spark.createDataFrame([(k + 1, *p) for k, p in enumerate(pages)], "ordinal int, title string, url string")


def configured(config: DataFrame, files: DataFrame) -> DataFrame:
    """Each configured source with its file's text; ``missing`` where there is no such file, which isn't an error."""
    found = files.select("source", "text", F.lit(True).alias("found"))
    return config.join(found, "source", "left").withColumn("missing", F.col("found").isNull()).drop("found")


def page_files(pages: DataFrame, component: Column) -> DataFrame:
    """``page_id, filename, content`` of pages ``page_id, ordinal, url, title, html``; a page without a container is skipped."""
    p = pages.withColumn("inner", hx.container(F.col("html"))).filter("inner is not null")
    title = F.coalesce(hx.page_title(F.col("html")), F.col("title"), F.lit(""))
    front = {"doc_type": F.lit("technology"), "component": component, "source_url": F.col("url")}
    name = F.concat(tx.ordinal(F.col("ordinal")), F.lit("-"), tx.filename_dashed(title), F.lit(".md"))
    return p.select("page_id", name.alias("filename"), tx.front_matter(front, hx.to_markdown("inner", title)).alias("content"))


def level1_markdown(docs: DataFrame, id_col: str, body_col: str, prefix: str, url: Column | None = None) -> DataFrame:
    """``id, file_no, filename, content``: a large Markdown text as one file per level-1 heading, links taken out."""
    files = chunking.level1_files(docs, id_col, body_col)
    name = F.concat(tx.ordinal(F.col("file_no")), F.lit(f"-{prefix}-"), tx.filename_spaced(F.col("title")), F.lit(".md"))
    front = {"doc_type": F.lit("technology"), "component": F.lit(prefix), "source_url": url if url is not None else F.lit(None).cast("string")}
    return files.select("id", "file_no", name.alias("filename"), tx.front_matter(front, tx.squeeze(chunking.unlinked("content"))).alias("content"))


def counters(rows: DataFrame, ok: Column) -> DataFrame:
    """One row: how many succeeded and how many didn't."""
    return rows.agg(F.count_if(ok).alias("succeeded"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("failed"))
