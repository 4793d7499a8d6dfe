"""An inverted-file index of vectors: approximate recall that reads a part of the rows.

Cell centres are fitted on a bounded sample; every row is put into its nearest cell.  A
query looks into its ``probes`` nearest cells.  Large cells are cut into slices of bounded
size, so one cell that holds a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .recall import _matrix

#: Rows the centres are fitted on, cells there are at most, rows of a cell's slice.
SAMPLE_ROWS, MOST_CELLS, SLICE_ROWS = 20_000, 4096, 20_000


def fit(
    corpus: DataFrame, cells: int | None = None, sample_rows: int = SAMPLE_ROWS, rounds: int = 8, seed: int = 0, k: int = 20, target: float = 0.97
) -> tuple[np.ndarray, int]:
    """Unit cell centres, of the commonest dimension, by spherical k-means over at most ``sample_rows`` rows, drawn by a hash of their ids.

    Also how many cells a query has to look into: the fewest with which up to 256 rows of
    the sample find ``target`` of their ``k`` nearest in the sample.
    """
    n = corpus.count()
    cells = min(MOST_CELLS, cells or max(1, round(2 * math.sqrt(n))))
    part = corpus.filter("embedding is not null").orderBy(F.xxhash64(F.lit(seed), "id")).limit(sample_rows)
    t = part.select("id", F.col("embedding").cast("array<double>").alias("embedding")).toArrow()
    if t.num_rows == 0:
        return np.zeros((0, 0)), 1
    col = t["embedding"].combine_chunks()
    import pyarrow.compute  # noqa: F401

    sizes = np.asarray(pa.compute.list_value_length(col))
    dim = int(np.bincount(sizes).argmax())  # of most rows
    m, ok = _matrix(col, dim)
    m = m[ok]
    if not len(m):
        return np.zeros((0, dim)), 1
    rng = np.random.default_rng(seed)
    centres = m[rng.choice(len(m), min(cells, len(m)), replace=False)]
    for _ in range(rounds):
        nearest = np.argmax(m @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, m)
        norm = np.linalg.norm(sums, axis=1)
        centres = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-12)[:, None], centres)
    q = m[rng.choice(len(m), min(256, len(m)), replace=False)]
    near = np.argsort(-(q @ m.T), axis=1)[:, :k]
    place = np.argsort(np.argsort(-(q @ centres.T), axis=1), axis=1)  # of each cell in a query's order
    needed = np.take_along_axis(place, np.argmax(m @ centres.T, axis=1)[near], 1)
    probes = 1 + int(np.quantile(needed, target, method="higher"))
    return centres, probes


def assigned(corpus: DataFrame, centres: np.ndarray) -> DataFrame:
    """``id, cell, embedding`` of every row that has the dimension and a norm."""

    def run(batches):
        import pyarrow.compute  # noqa: F401

        for b in batches:
            m, ok = _matrix(b.column(1), centres.shape[1])
            cell = np.argmax(m @ centres.T, axis=1).astype(np.int32)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), pa.array(cell).filter(keep), b.column(1).filter(keep)], names=["id", "cell", "embedding"])

    src = corpus.select(F.col("id").cast("long"), F.col("embedding").cast("array<double>"))
    if not centres.size:
        return src.limit(0).select("id", F.lit(0).alias("cell"), "embedding")
    return src.mapInArrow(run, "id long, cell int, embedding array<double>")


def probing(queries: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """``query_id, cell, embedding``: each query once for each of its nearest cells."""

    def run(batches):
        import pyarrow.compute  # noqa: F401

        for b in batches:
            m, ok = _matrix(b.column(1), centres.shape[1])
            near = np.argsort(-(m @ centres.T), axis=1, kind="stable")[:, :probes]
            row = np.repeat(np.flatnonzero(ok), near.shape[1])
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), pa.array(near[ok].ravel().astype(np.int32)), b.column(1).take(take)], names=["query_id", "cell", "embedding"])

    src = queries.select(F.col("query_id").cast("long"), F.col("embedding").cast("array<double>"))
    if not centres.size:
        return src.limit(0).select("query_id", F.lit(0).alias("cell"), "embedding")
    return src.mapInArrow(run, "query_id long, cell int, embedding array<double>")


def search(queries: DataFrame, rows: DataFrame, centres: np.ndarray, k: int = 20, probes: int = 16, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``query_id, id, cosine, recall_rank`` of the nearest rows within the probed cells."""
    slices = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(slice_rows)).cast("int").alias("slices"))
    left = rows.join(slices, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice"), "id", "embedding")
    right = probing(queries, centres, probes).join(slices, "cell").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select("cell", "slice", "query_id", "embedding")
    dim = int(centres.shape[1]) if centres.size else 0

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        import pyarrow.compute  # noqa: F401

        names = ["query_id", "id", "cosine"]
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        m, _ = _matrix(a["embedding"].combine_chunks(), dim)
        q, _ = _matrix(b["embedding"].combine_chunks(), dim)
        ids = a["id"].to_numpy()
        out = []
        for at in range(0, len(q), 1024):
            s = q[at : at + 1024] @ m.T
            order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
            out.append((np.repeat(b["query_id"].to_numpy()[at : at + 1024], order.shape[1]), ids[order].ravel(), np.take_along_axis(s, order, 1).ravel()))
        return pa.table([pa.array(np.concatenate([o[j] for o in out])) for j in range(3)], names=names)

    found = left.groupBy("cell", "slice").cogroup(right.groupBy("cell", "slice")).applyInArrow(best, "query_id long, id long, cosine double")
    w = W.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return found.withColumn("recall_rank", F.row_number().over(w)).filter(F.col("recall_rank") <= k)


def quality(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the part of exact neighbours that the index finds."""
    hit = exact.join(approximate.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg(F.count(F.lit(1)).alias("neighbours"), F.round(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0)), 6).alias("recall"))
