"""The two plans from end to end: a folder of Markdown into an index, and requests into answers.

Models are parameters: an embedder turns ``id, text`` into ``id, embedding``, a reranker
turns queries, recalled rows and chunks into scores.  The defaults are stand-ins without a
model; they are deterministic and say nothing about relevance.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DocumentInvalid, KnowledgeUnavailable
from ..operators import chunking, recall
from ..operators import retrieval as rt
from ..sources import documents as docs
from ..sources import index
from ..sources.staging import staged

Embedder = Callable[[DataFrame], DataFrame]
Reranker = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]
_TOKEN = re.compile(r"[a-z0-9]+|[一-龥]")


def hashed_vectors(texts: DataFrame, dim: int = 256) -> DataFrame:
    """``id, embedding``: signed feature hashing of words and ideographs, of norm 1; texts without any are all zero."""

    def run(batches):
        for b in batches:
            m = np.zeros((b.num_rows, dim))
            for i, text in enumerate(b.column(1).to_pylist()):
                for t in _TOKEN.findall((text or "").lower()):
                    h = zlib.crc32(t.encode())
                    m[i, (h >> 1) % dim] += 1 if h & 1 else -1
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, dim, dtype=np.int32)), pa.array(m.ravel().astype(np.float32)))
            yield pa.RecordBatch.from_arrays([b.column(0), flat], names=["id", "embedding"])

    return texts.select(F.col("id").cast("long"), "text").mapInArrow(run, "id long, embedding array<float>")


STAND_IN = {"name": "hashed-words", "dim": 256}


def ingest(
    spark: SparkSession, folder: str, root: str, count: chunking.Tokenizer = chunking.characters, max_tokens: int = 512, overlap_ratio: float = 0.12,
    embed: Embedder = hashed_vectors, model: dict | None = None, dry_run: bool = False,
) -> DataFrame:
    """Makes the index hold exactly what the folder holds; one row of what was done.

    All rules are checked before anything is written; the first broken ones are raised.  A
    dry run stops before the vectors: ``documents, parents, chunks, max_tokens, first_chunk``.
    """
    valid, bad = docs.validated(docs.parse(docs.scan_markdown(spark, folder)))
    valid = staged(valid.drop("odd", "problem").withColumn("row_id", F.xxhash64("source")), "valid")
    docs.raise_invalid(bad, docs.duplicate_ids(valid))
    rows = staged(chunking.chunk_rows(valid, count, max_tokens, overlap_ratio), "rows")
    chunking.raise_problems(rows)
    chunks = chunking.make_chunks(valid, rows)
    if rows.isEmpty():
        raise DocumentInvalid(f"{folder} yields no chunk")
    titles = rows.filter("chunk_index = 0").select("row_id", "title")
    project = valid.filter("doc_type <> 'technology'").join(titles, "row_id").select(*index.PARENT_COLUMNS)
    if dry_run:
        first = chunks.orderBy("source", "chunk_index").limit(1).select(F.to_json(F.struct("*")).alias("first_chunk"))
        sums = rows.agg(F.count_distinct("row_id").alias("documents"), F.count(F.lit(1)).alias("chunks"))
        n = {**sums.first().asDict(), "parents": project.count(), "first_chunk": first.first()[0]}
        return spark.createDataFrame([(n["documents"], n["parents"], n["chunks"], max_tokens, n["first_chunk"])], "documents long, parents long, chunks long, max_tokens int, first_chunk string")
    keyed = chunks.withColumn("id", F.xxhash64("chunk_id"))
    whole = index.aligned(chunks, embed(keyed.select("id", "text")).join(keyed.select("id", "chunk_id"), "id").select("chunk_id", "embedding"))
    return index.report_row(spark, index.sync(spark, root, whole, project if not project.isEmpty() else None, model or STAND_IN))


def opened(spark: SparkSession, root: str, model: dict | None) -> dict:
    """What a session needs before its first request: the index's manifest; raises where there is none, or it is of another model."""
    manifest = index.read_manifest(spark, root)
    if manifest.get("model") and manifest["model"] != model:
        raise KnowledgeUnavailable(f"the index was built with {manifest['model']}, not with {model}")
    return manifest


def search(
    spark: SparkSession, root: str, queries: DataFrame, embed: Embedder = hashed_vectors, rerank: Reranker = rt.lexical_rerank, recall_k: int = rt.RECALL,
    budget: int = rt.CONTENT_CHARS, model: dict | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Items and states of a batch of requests against the index; see :func:`retrieval.answer`.

    Raises where there is no index, or where it was built with another model than ``model``,
    by default the stand-in with its own embedder. An empty one answers with its notice.
    """
    manifest = opened(spark, root, model or (STAND_IN if embed is hashed_vectors else None))
    chunks = index.read_chunks(spark, root, vectors=True)
    good = rt.requests(queries).filter(F.size("invalid") == 0)
    prefixed = good.select(F.col("query_id").alias("id"), F.concat(F.lit(recall.INSTRUCTION), "query").alias("text"))
    vectors = embed(prefixed).select(F.col("id").alias("query_id"), "embedding").join(good.select("query_id", F.col("doc_type").alias("filter")), "query_id")
    kinds = {t: F.col("doc_type") == t for t in docs.DOC_TYPES}
    keyed = chunks.withColumn("id", F.xxhash64("chunk_id"))
    found = recall.recall(vectors, keyed, recall_k, kinds).join(keyed.select("id", "chunk_id"), "id").select("query_id", "recall_rank", "chunk_id")
    found = staged(found, "recalled")
    scored = rerank(good, found, chunks)
    if manifest.get("snapshot_id"):
        parents = index.sound_parents(spark, root, manifest["snapshot_id"])
    else:
        parents = spark.createDataFrame([], "snapshot_id string, doc_id string, doc_type string, title string, source string, body string")
    items, states = rt.answer(queries, scored, chunks.drop("embedding"), parents, budget, strict=True)
    if not manifest["chunks"]:
        empty = F.when(F.col("status") == "ok", F.array(F.lit(rt.DISCLAIMER), F.lit(rt.NOTHING_INDEXED))).otherwise(F.col("notices"))
        states = states.withColumn("notices", empty)
    return items, states
