"""The versioned index: chunks, vectors, and snapshots of full documents.

Layout below one folder: ``chunks/version=…``, ``parents/snapshot_id=…`` and
``manifest.json``, which names the version that readers see.  A run writes a new version
next to the old one and then replaces the manifest, so a failed run changes nothing and a
reader sees one version only.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IndexMissing, KnowledgeUnavailable


@dataclass
class SyncReport:
    chunks: int
    inserted: int
    updated: int
    unchanged: int
    deleted: int
    snapshot_id: str | None
    version: str


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_manifest(spark: SparkSession, root: str) -> dict:
    if not exists(spark, f"{root}/manifest.json"):
        raise IndexMissing(f"{root} holds no index; run the ingest first")
    fs, p = _fs(spark, f"{root}/manifest.json")
    stream = fs.open(p)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text)


def write_manifest(spark: SparkSession, root: str, manifest: dict) -> None:
    """Under another name first, then renamed over the old one."""
    fs, final = _fs(spark, f"{root}/manifest.json")
    _, part = _fs(spark, f"{root}/manifest-{uuid.uuid4().hex}.tmp")
    out = fs.create(part, True)
    try:
        out.write(bytearray(json.dumps(manifest, ensure_ascii=False, sort_keys=True).encode("utf-8")))
    finally:
        out.close()
    options = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    flags = spark.sparkContext._gateway.new_array(options, 1)
    flags[0] = options.OVERWRITE
    context.rename(part, final, flags)


def read_chunks(spark: SparkSession, root: str, vectors: bool = False) -> DataFrame:
    """The chunks of the current version; the vectors only on demand."""
    m = read_manifest(spark, root)
    d = spark.read.parquet(f"{root}/chunks/version={m['version']}")
    return d if vectors or "embedding" not in d.columns else d.drop("embedding")


def read_parents(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/parents")


def document_digest(d: DataFrame, columns: list[str]) -> Column:
    """The digest of one document: its columns in the given order, nulls explicit."""
    return F.sha2(F.concat_ws("", *[F.concat(F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.length(c).cast("string"), F.lit(":"), F.col(c)))) for c in columns]), 256)


def snapshot_digests(d: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """``group…, documents, digest``: a two-level hash tree over the documents of each group.

    Digests of documents are bucketed by their first three digits; a bucket's digest is
    that of its sorted document digests, the group's that of its at most 4,096 sorted
    buckets.  So no group, however large, comes together in one task.
    """
    leaf = d.select(*group, document_digest(d, columns).alias("h")).withColumn("b", F.substring("h", 1, 3))
    inner = leaf.groupBy(*group, "b").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    parts = F.array_sort(F.collect_list(F.concat("b", "h")))
    return inner.groupBy(*group).agg(F.sum("n").alias("documents"), F.sha2(F.array_join(parts, ""), 256).alias("digest"))


PARENT_COLUMNS = ["doc_id", "doc_type", "title", "source", "body"]


def sound_parents(spark: SparkSession, root: str, snapshot: str) -> DataFrame:
    """The documents of a snapshot; none where they no longer have the digest that names it."""
    parents = read_parents(spark, root).filter(F.col("snapshot_id") == snapshot)
    good = snapshot_digests(parents, ["snapshot_id"], PARENT_COLUMNS).filter("digest = snapshot_id")
    return parents.join(good.select("snapshot_id"), "snapshot_id", "left_semi")


def stale_ids(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Ids of the old version that the new one lacks."""
    return old.select(key).distinct().join(new.select(key), key, "left_anti")


def sync_states(old: DataFrame, new: DataFrame, columns: list[str], key: str = "chunk_id") -> DataFrame:
    """``key, state``: inserted, updated, unchanged or deleted. Content is compared by digest, so rows stay narrow."""
    a = old.groupBy(key).agg(F.max(document_digest(old, columns)).alias("was"))
    b = new.groupBy(key).agg(F.max(document_digest(new, columns)).alias("now"))
    state = F.when(F.col("was").isNull(), "inserted").when(F.col("now").isNull(), "deleted").when(F.col("was") == F.col("now"), "unchanged").otherwise("updated")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def sync(spark: SparkSession, root: str, chunks: DataFrame, parents: DataFrame | None = None, model: dict | None = None) -> SyncReport:
    """Makes the index hold exactly ``chunks``; parents become a snapshot named by their digest.

    ``chunks`` may hold an ``embedding`` column.  Order: snapshot, new version, manifest.
    What is left of older versions isn't read any more; :func:`prune` removes it.
    """
    snapshot = None
    if parents is not None:
        top = snapshot_digests(parents, [], PARENT_COLUMNS).collect()
        snapshot = top[0].digest if top and top[0].documents else None
        where = f"{root}/parents/snapshot_id={snapshot}"
        if snapshot and not exists(spark, f"{where}/_SUCCESS"):
            parents.select(*PARENT_COLUMNS).write.mode("overwrite").parquet(where)
    chunks = chunks.withColumn("snapshot_id", F.when(F.col("doc_type") != "technology", F.lit(snapshot)))
    old = None
    try:
        manifest = read_manifest(spark, root)
        old = read_chunks(spark, root, vectors=True)
        if model and manifest.get("model") and manifest["model"] != model:
            raise KnowledgeUnavailable("the index was built with another model; use a new folder")
    except IndexMissing:
        pass
    version = uuid.uuid4().hex
    chunks.write.parquet(f"{root}/chunks/version={version}")
    new = spark.read.parquet(f"{root}/chunks/version={version}")
    columns = [c for c in ("doc_id", "doc_type", "title", "section", "source", "text") if c in new.columns]
    states = sync_states(old if old is not None else new.limit(0), new, columns)
    n = {r.state: r["count"] for r in states.groupBy("state").count().collect()}
    total = sum(v for k, v in n.items() if k != "deleted")
    write_manifest(spark, root, {"version": version, "chunks": total, "snapshot_id": snapshot, "space": "cosine", "model": model})
    return SyncReport(total, n.get("inserted", 0), n.get("updated", 0), n.get("unchanged", 0), n.get("deleted", 0), snapshot, version)


def prune(spark: SparkSession, root: str) -> list[str]:
    """Removes versions and snapshots that the manifest doesn't name; their names.

    Not while a reader that began before the last sync may still be at work.
    """
    m, gone = read_manifest(spark, root), []
    for folder, kept in (("chunks", f"version={m['version']}"), ("parents", f"snapshot_id={m.get('snapshot_id')}")):
        fs, path = _fs(spark, f"{root}/{folder}")
        for entry in fs.listStatus(path) if fs.exists(path) else []:
            name = entry.getPath().getName()
            if "=" in name and name != kept:
                fs.delete(entry.getPath(), True)
                gone.append(f"{folder}/{name}")
    return sorted(gone)


def status(spark: SparkSession, root: str) -> DataFrame:
    """One row: whether an index is there, its size and version."""
    try:
        m = read_manifest(spark, root)
        row = ("ok", True, int(m["chunks"]), m["version"], m.get("snapshot_id"))
    except IndexMissing:
        row = ("missing", False, 0, None, None)
    return spark.createDataFrame([row], "status string, index_loaded boolean, chunks long, version string, snapshot_id string")


def report_row(spark: SparkSession, report: SyncReport) -> DataFrame:
    return spark.createDataFrame([tuple(asdict(report).values())], "chunks long, inserted long, updated long, unchanged long, deleted long, snapshot_id string, version string")


def aligned(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with their vectors, joined by id; raises if one has none."""
    out = chunks.join(vectors.select("chunk_id", "embedding"), "chunk_id", "left")
    missing = out.filter("embedding is null").limit(1).count()
    if missing:
        raise KnowledgeUnavailable("a chunk has no vector")
    return out
