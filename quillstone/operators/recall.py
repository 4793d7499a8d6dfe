"""Nearest chunks by cosine, exactly, for many queries at once.

The queries go to the workers in blocks of bounded size; each partition multiplies its
vectors with a block and keeps its own best ``k`` per query, so the shuffle moves at most
``k`` rows per query and partition, never a row per pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Query vectors in one block; a block of 4,096 x 1,024 doubles is 32 MB.
BLOCK = 4096

# Fixed value: the instruction put before a query, not before documents, when it is embedded.
INSTRUCTION = "为这个句子生成表示以用于检索相关文章："


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in doubles; null where a norm is 0."""
    a, b = F.transform(a, lambda x: x.cast("double")), F.transform(b, lambda x: x.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def _matrix(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows in doubles, and which rows have the dimension and a norm."""
    size = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(col), 0))
    ok = size == dim
    m = np.zeros((len(col), dim))
    if ok.any():
        m[ok] = np.asarray(col.filter(pa.array(ok)).flatten(), np.float64).reshape(-1, dim)
    norm = np.sqrt((m * m).sum(axis=1))
    ok &= np.isfinite(norm) & (norm > 0)
    m[ok] /= norm[ok, None]
    m[~ok] = 0
    return m, ok


def _best(ids: np.ndarray, names: np.ndarray, q: np.ndarray, k: int):
    def run(batches):
        import pyarrow.compute  # noqa: F401

        top_s, top_i = np.full((len(names), 0), 0.0), np.zeros((len(names), 0), np.int64)
        for b in batches:
            m, ok = _matrix(b.column(1), q.shape[1])
            if not ok.any():
                continue
            i = b.column(0).to_numpy()[ok]
            s = np.hstack([top_s, q @ m[ok].T])
            i = np.hstack([top_i, np.broadcast_to(i, (len(names), len(i)))])
            order = np.lexsort((i, -s), axis=1)[:, :k]
            top_s, top_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        if top_s.shape[1]:
            owner = np.repeat(names, top_s.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(top_i.ravel()), pa.array(top_s.ravel())], names=["query_id", "id", "cosine"])

    return run


def recall(queries: DataFrame, corpus: DataFrame, k: int = 20, filters: dict[str, Column] | None = None, block: int = BLOCK) -> DataFrame:
    """``query_id, id, cosine, recall_rank`` of the ``k`` nearest rows of ``corpus (id, embedding, …)`` per query.

    ``queries`` has ``query_id, embedding`` and, with ``filters``, a ``filter`` that names
    the condition on the corpus to be met; conditions are applied before the top ``k``.
    Ties go to the least id.  Vectors that are null or of norm 0 match nothing, others only
    those of their own dimension.
    """
    parts, held = [], {}
    named = queries if "filter" in queries.columns else queries.withColumn("filter", F.lit(None).cast("string"))
    empty = corpus.sparkSession.createDataFrame([], "query_id long, id long, cosine double")

    def flush(group: tuple[str | None, int]):
        rows, (name, dims) = held.pop(group), group
        q, ok = _matrix(pa.array([v for _, v in rows], pa.list_(pa.float64())), dims)
        names = np.array([i for i, _ in rows], np.int64)[ok]
        if len(names):
            src = corpus if name is None else corpus.filter((filters or {})[name])
            src = src.select(F.col("id").cast("long"), F.col("embedding").cast("array<double>"))
            parts.append(src.mapInArrow(_best(names, names, q[ok], k), "query_id long, id long, cosine double"))

    for r in named.select("query_id", "embedding", "filter").filter("embedding is not null and size(embedding) > 0").toLocalIterator():
        group = (r[2], len(r[1]))
        held.setdefault(group, []).append((r[0], r[1]))
        if len(held[group]) >= block:
            flush(group)
    for group in list(held):
        flush(group)
    out = empty
    for p in parts:
        out = out.unionByName(p)
    w = W.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return out.withColumn("recall_rank", F.row_number().over(w)).filter(F.col("recall_rank") <= k)
