"""Intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` names it.  A table written there survives the loss of an
executor and cuts the lineage; where the setting is missing, as in tests, a local
folder is made and set.  The tables live as long as the session's process, as results
that read them may be consumed at any time; :func:`clear` removes them earlier.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; one is made only where none is set."""
    there = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="stage-"))
        atexit.register(shutil.rmtree, _own[0], True)
    spark.conf.set("spark.checkpoint.dir", "file://" + _own[0])
    return "file://" + _own[0]


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as parquet and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_leave, spark)
    _made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Removes all tables staged by this process, whose results must have been consumed; how many there were."""
    n, jvm = len(_made), spark.sparkContext._jvm
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def _leave(spark: SparkSession) -> None:
    """At the end of the process; folders on this machine also where the session is gone."""
    left = list(_made)
    try:
        clear(spark)
    except Exception:
        for path in left:
            if path.startswith("file:"):
                shutil.rmtree(path.removeprefix("file:").replace("///", "/"), ignore_errors=True)
