"""Looking through an index: totals, facets, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# The filter value that means "all", and what stands for a missing value.
ALL = "全部"
UNKNOWN = "未知"
FACETS = ("doc_id", "component", "doc_type")


def filled(chunks: DataFrame) -> DataFrame:
    """Missing values replaced: names by the unknown mark, texts by empty ones, the index by 0."""
    default = {"doc_id": UNKNOWN, "component": UNKNOWN, "doc_type": UNKNOWN, "title": "", "section": "", "source": "", "source_url": ""}
    out = chunks.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in default.items() if c in chunks.columns})
    return out.withColumn("chunk_index", F.coalesce("chunk_index", F.lit(0))) if "chunk_index" in chunks.columns else out


def totals(chunks: DataFrame) -> DataFrame:
    """One row: chunks, documents, components, kinds. The distinct counts take one pass over combined partial sets."""
    c = filled(chunks)
    return c.agg(F.count(F.lit(1)).alias("chunks"), *[F.count_distinct(k).alias(f"{k}s") for k in FACETS])


def facets(chunks: DataFrame, columns: tuple[str, ...] = FACETS) -> DataFrame:
    """``facet, value, n`` of every facet, from one scan; values are pre-aggregated before the shuffle."""
    c = filled(chunks)
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("facet"), F.col(k).alias("value")) for k in columns]))
    return c.select(pairs.alias("p")).groupBy("p.facet", "p.value").agg(F.count(F.lit(1)).alias("n"))


def keyword(word: str) -> Column:
    """Whether text or id hold the stripped word, in any letter case; a blank word matches all."""
    word = word.strip().lower()
    if not word:
        return F.lit(True)
    return F.coalesce(F.lower("text").contains(word) | F.lower("chunk_id").contains(word), F.lit(False))


def filtered(chunks: DataFrame, word: str = "", doc_type: str = ALL, component: str = ALL, doc_id: str = ALL) -> DataFrame:
    """The chunks that pass all filters; equality filters reach the scan."""
    out = chunks
    for name, value in (("doc_type", doc_type), ("component", component), ("doc_id", doc_id)):
        if value != ALL:
            out = out.filter((F.col(name) == value) | F.col(name).isNull()) if value == UNKNOWN else out.filter(F.col(name) == value)
    return out.filter(keyword(word))


BROWSE_ORDER = ("doc_id", "chunk_index", "chunk_id")


def gaps(chunks: DataFrame) -> DataFrame:
    """Per document of the index: chunks, highest index, and what is missing, repeated, or without a valid index."""
    ids = chunks.select("doc_id", "chunk_id", "chunk_index").distinct()
    per = ids.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_distinct(F.when(F.col("chunk_index") >= 0, F.col("chunk_index"))).alias("indexes"),
        F.max("chunk_index").alias("top"), F.count_if(F.coalesce(F.col("chunk_index") < 0, F.lit(True))).alias("invalid"),
    )
    return per.select("doc_id", "chunks", "invalid", (F.coalesce(F.greatest("top", F.lit(-1)), F.lit(-1)) + 1 - F.col("indexes")).alias("missing"), (F.col("chunks") - F.col("invalid") - F.col("indexes")).alias("repeated"))


def over_budget(chunks: DataFrame, max_tokens: int = 512) -> DataFrame:
    """Chunks whose token count (characters and two special tokens) exceeds the limit."""
    return chunks.select("chunk_id", tx.char_tokens(F.col("text")).alias("tokens")).filter(F.col("tokens") > max_tokens)
