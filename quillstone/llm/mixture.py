"""Mixing sources to target shares (problem 7), by Efraimidis-Spirakis sampling.

Every source has a token target.  Whole epochs of the source come first, at most
``max_repeat``; the rest is a weighted sample without replacement: each document draws
``u`` from a hash of its id, its key ``-ln(u) / weight`` is exponential with the quality
weight as rate, and documents are taken in order of their keys until the target is
reached.  The prefix sums are made in two steps, so no task sees a whole source: totals
per bucket of keys, then exact order within the one bucket of each source in which the
target falls.  Buckets are steps of the key's logarithm: keys of a rate w lie between x and
x (1 + d) with a probability of at most d / e, whatever w is, so with 512 steps an octave
no bucket holds more than 0.05 percent of a source on average.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens as tk
from ..sources.staging import staged

STEPS = 512  # buckets an octave of keys
#: Sources a weights table may name; its rows reach the driver.
MOST_SOURCES = 100_000


def completeness(df: DataFrame, columns: list[str]) -> Column:
    """A quality weight in (0, 1]: the part of the metadata that is there."""
    there = [F.when(F.trim(F.col(c).cast("string")) != "", 1.0).otherwise(0.0) for c in columns if c in df.columns]
    total = F.lit(1.0)
    for t in there:
        total = total + t
    return total / F.lit(1.0 + len(there))


def sized(df: DataFrame, id_col: str, text_col: str, source_col: str, weight: Column, path: str = tk.TOKENIZER) -> DataFrame:
    """``doc_id, source, tokens, weight``: one row per document, with the source's regular spelling.

    Null ids are out; rows that repeat an id count once.  Weights that are null or not
    positive count as the least positive one.
    """
    w = F.when(weight > 0, weight.cast("double")).otherwise(F.lit(1e-9))
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), tk.regular(F.col(source_col)).alias("source"), F.coalesce(w, F.lit(1e-9)).alias("weight"), F.col(text_col).alias("t"))
    rows = tk.with_tokens(src.filter("doc_id is not null"), ["doc_id", "source", "weight"], "t", path)
    return rows.groupBy("doc_id").agg(F.min("source").alias("source"), F.max("tokens").alias("tokens"), F.max("weight").alias("weight"))


def plan(docs: DataFrame, weights: DataFrame, total_tokens: int | None) -> list[dict]:
    """Per source of the weights table: available tokens, target, whole epochs and the rest.

    Without ``total_tokens`` the total is the largest for which every source that has
    documents reaches its share within its repeats, so the shares come out as wanted.  With
    it, a source whose repeats don't suffice gives all it may.
    """
    have = docs.filter("source is not null").groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    wanted = weights.select(tk.regular(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.coalesce(F.col("max_repeat"), F.lit(1)).cast("long").alias("most"))
    wanted = wanted.filter("source is not null").groupBy("source").agg(F.sum("share").alias("share"), F.max("most").alias("most"))
    rows = [r.asDict() for r in wanted.join(have, "source", "left").limit(MOST_SOURCES + 1).collect()]
    if len(rows) > MOST_SOURCES:
        raise ValueError("the weights table names too many sources")
    for r in rows:
        r |= {k: r[k] or 0 for k in ("tokens", "documents", "share", "most")}
        r["most"] = max(0, r["most"])
    able = [r["most"] * r["tokens"] / r["share"] for r in rows if r["share"] > 0 and r["most"] > 0 and r["tokens"] > 0]
    total = total_tokens if total_tokens is not None else int(min(able, default=0))
    for r in sorted(rows, key=lambda r: r["source"]):
        r["target"] = int(round(total * max(0.0, r["share"])))
        r["epochs"] = min(r["most"], r["target"] // r["tokens"]) if r["tokens"] else 0
        r["rest"] = r["target"] - r["epochs"] * r["tokens"] if r["epochs"] < r["most"] and r["tokens"] else 0
    return rows


def bucket(key: Column) -> Column:
    """The bucket of a positive key; buckets rise with the key."""
    return F.floor(F.log2(key) * STEPS).cast("int")


def mixture(docs: DataFrame, weights: DataFrame, total_tokens: int | None = None, seed: int = 0) -> tuple[DataFrame, list[dict]]:
    """``doc_id, source, tokens, copies`` of the selected documents, and the plan.

    ``docs`` comes from :func:`sized`.  The document at a target's edge is taken if that
    brings the total nearer to it.  Equal keys are ordered by id.
    """
    docs = staged(docs, "sized")
    rows = plan(docs, weights, total_tokens)
    spark = docs.sparkSession
    goals = spark.createDataFrame([(r["source"], int(r["epochs"]), int(r["rest"])) for r in rows], "source string, epochs long, rest long")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    keyed = docs.join(goals, "source").withColumn("key", F.greatest(-F.log(u) / F.col("weight"), F.lit(1e-300))).withColumn("bucket", bucket(F.col("key")))
    sums = keyed.filter("rest > 0").groupBy("source", "bucket").agg(F.sum("tokens").alias("n"), F.first("rest").alias("goal"))
    run = F.sum("n").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    edge = sums.withColumn("before", F.coalesce(run, F.lit(0))).filter("before < goal and before + n >= goal").select("source", F.col("bucket").alias("edge"), "before")
    keyed = keyed.join(edge, "source", "left")
    sure = keyed.withColumn("extra", F.when((F.col("rest") > 0) & (F.col("edge").isNull() | (F.col("bucket") < F.col("edge"))), 1).otherwise(0))
    sure = sure.filter(F.col("edge").isNull() | (F.col("bucket") != F.col("edge"))).select("doc_id", "source", "tokens", "epochs", "extra")
    w = W.partitionBy("source").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    near = keyed.filter(F.col("bucket") == F.col("edge")).withColumn("sofar", F.col("before") + F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    # half of the edge document must lie before the goal
    near = near.withColumn("extra", F.when(2 * F.col("sofar") + F.col("tokens") <= 2 * F.col("rest"), 1).otherwise(0)).select("doc_id", "source", "tokens", "epochs", "extra")
    out = sure.unionByName(near).withColumn("copies", F.col("epochs") + F.col("extra")).filter("copies > 0")
    return out.select("doc_id", "source", "tokens", "copies"), rows


def shares(docs: DataFrame, weights: DataFrame, total_tokens: int | None = None, seed: int = 0) -> DataFrame:
    """Per source: wanted and reached share, tokens there and taken, documents taken, and whether the repeats bind."""
    taken, rows = mixture(docs, weights, total_tokens, seed)
    spark = docs.sparkSession
    plan_ = spark.createDataFrame(
        [(r["source"], float(r["share"]), int(r["most"]), int(r["documents"]), int(r["tokens"]), int(r["target"])) for r in rows],
        "source string, target_share double, max_repeat long, documents long, tokens long, target_tokens long",
    )
    sums = taken.groupBy("source").agg(F.count(F.lit(1)).alias("documents_used"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens_used"))
    out = plan_.join(sums, "source", "left").fillna(0, ["documents_used", "tokens_used"])
    total = F.sum("tokens_used").over(W.partitionBy(F.lit(1)))
    return out.select("*", F.round(F.when(total > 0, F.col("tokens_used") / total).otherwise(0.0), 6).alias("share"), (F.col("max_repeat") * F.col("tokens") < F.col("target_tokens")).alias("bound"))
