"""Markdown files that arrive over time, as a stream.

An extension of the one-shot ingest: a stream only adds and replaces.  What has vanished
from the folder stays until a full sync, which alone can tell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as tx
from ..sources import documents as docs

FILE = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 10_000) -> DataFrame:
    """``source, text, modified`` of Markdown files as they appear; readme files are left out."""
    files = (
        spark.readStream.schema(FILE).format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch).load(folder)
    )
    base = folder.split("://", 1)[-1].rstrip("/") + "/"
    source = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), "^\\Q" + base + "\\E", "")
    out = files.select(source.alias("source"), tx.decoded(F.col("content")).alias("text"), F.col("modificationTime").alias("modified"))
    return out.filter(F.lower(F.element_at(F.split("source", "/"), -1)) != "readme.md")


def collect_arrivals(spark: SparkSession, folder: str, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Parses and checks every batch and writes it below ``out``: ``valid`` and ``invalid``, by batch.

    A batch that is repeated after a failure overwrites itself, so each file counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        parsed = docs.parse(batch.select("source", "text")).join(batch.select("source", "modified"), "source")
        valid, invalid = docs.validated(parsed)
        valid.drop("odd", "problem").write.mode("overwrite").parquet(f"{out}/valid/batch={number}")
        invalid.select("source", "modified", "errors").write.mode("overwrite").parquet(f"{out}/invalid/batch={number}")

    stream = arriving(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream).start()


def arrived(spark: SparkSession, out: str) -> DataFrame:
    """The last valid version of every document that has arrived."""
    d = spark.read.parquet(f"{out}/valid")
    return docs.latest(d, ["doc_id"], [F.col("modified"), F.col("batch")])
