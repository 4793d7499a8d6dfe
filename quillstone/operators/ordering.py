"""Positions and pages over a whole table, without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.staging import staged


#: Pages that begin within so many rows are sorted out of the table directly, later ones read from its sorted copy.
NEAR_ROWS = 10_000


def _sorted(df: DataFrame, order: list[Column]) -> tuple[DataFrame, list[tuple[int, int]]]:
    """A sorted copy with ``_part`` and ``_row``, the place in it, and how many rows stand before each part."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    local = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    local = staged(local, "sorted")
    before, total = [], 0
    for part, count in sorted((r[0], r[1]) for r in local.groupBy("_part").count().collect()):
        before.append((part, total))
        total += count
    return local, [*before, (-1, total)]


def with_position(df: DataFrame, order: list[Column], name: str = "position", first: int = 1) -> DataFrame:
    """Rows with their place in the order, from ``first``; the order must tell all rows apart.

    Range partitions are sorted and numbered each on their own, then shifted by the sizes
    of those before, which reach the driver: as many as ``spark.sql.shuffle.partitions``.
    """
    local, before = _sorted(df, order)
    shift = df.sparkSession.createDataFrame(before[:-1], "_part int, _before long")
    return local.join(shift, "_part").withColumn(name, F.col("_before") + F.col("_row") + F.lit(first)).drop("_part", "_row", "_before")


def page(df: DataFrame, order: list[Column], number: int, size: int, name: str = "row_no") -> DataFrame:
    """The rows of one page with their numbers; a page out of range gives the first one.

    An early page keeps only the rows up to its end while sorting.  A later one reads its
    rows out of the one or two parts of a sorted copy that hold them, so no task gathers
    what stands before it.
    """
    if size not in (5, 10, 20, 50):
        raise ValueError("a page has 5, 10, 20 or 50 rows")
    total = df.count()
    number = number if 1 <= number <= max(1, -(-total // size)) else 1
    start = (number - 1) * size
    if start <= NEAR_ROWS:
        rows = df.orderBy(*order).offset(start).limit(size)
        # at most 50 rows are numbered
        return rows.withColumn(name, F.row_number().over(W.orderBy(*order)) + F.lit(start))
    local, before = _sorted(df, order)
    held = [(part, at) for (part, at), (_, end) in zip(before, before[1:]) if at < start + size and end > start]
    pick = F.lit(False)
    for part, at in held:
        pick = pick | ((F.col("_part") == part) & F.col("_row").between(start - at, start + size - 1 - at))
    shift = F.coalesce(*[F.when(F.col("_part") == part, F.lit(at)) for part, at in held])
    return local.filter(pick).withColumn(name, (shift + F.col("_row") + 1).cast("int")).drop("_part", "_row")
