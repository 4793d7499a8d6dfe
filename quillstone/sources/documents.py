"""Markdown files with front matter to validated documents."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DocumentInvalid
from ..functions import text as tx

# Kinds of documents, the keys each needs, and names that metadata may not use.
DOC_TYPES = ("architecture", "runbook", "technology")
PROJECT_KEYS = ("id", "doc_type", "project", "service", "component", "deployment")
TECHNOLOGY_KEYS = ("doc_type", "component", "source_url")
RESERVED = ("doc_id", "chunk_id", "source", "title", "section", "chunk_index", "snapshot_id")
KNOWN = ("id", "doc_type", "project", "service", "component", "deployment", "source_url")


def scan_markdown(spark: SparkSession, root: str) -> DataFrame:
    """``source, text`` of all ``*.md`` files below a folder but readme files; BOM and CR are gone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    base = root.split("://", 1)[-1].rstrip("/") + "/"
    where = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), "^" + _quoted(base), "")
    out = files.select(where.alias("source"), tx.decoded(F.col("content")).alias("text"))
    return out.filter(F.lower(F.element_at(F.split("source", "/"), -1)) != "readme.md")


def _quoted(s: str) -> str:
    return "\\Q" + s + "\\E"


def _front(text: str | None) -> tuple[dict | None, dict | None, str | None]:
    """Scalars as text, their types, and what is wrong; types decide here, before they become text."""
    import yaml

    if text is None:
        return None, None, "front matter is missing"
    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError:
        return None, None, "front matter isn't valid YAML"
    if not isinstance(data, dict):
        return None, None, "front matter isn't a mapping"
    values, types = {}, {}
    for k, v in data.items():
        if not isinstance(k, str):
            return None, None, f"a key isn't a string: {k}"
        if not isinstance(v, str | int | float | bool) or isinstance(v, float) and not math.isfinite(v):
            return None, None, f"{k} must be a string, number or boolean; quote dates"
        types[k] = type(v).__name__
        values[k] = v if isinstance(v, str) else json.dumps(v)
    return values, types, None


_TEXTS = T.MapType(T.StringType(), T.StringType())
_FRONT = T.StructType([T.StructField("values", _TEXTS), T.StructField("types", _TEXTS), T.StructField("problem", T.StringType())])


@F.pandas_udf(_FRONT)
def decoded_front(front: pd.Series) -> pd.DataFrame:
    rows = [_front(x) for x in front]
    return pd.DataFrame({"values": [r[0] for r in rows], "types": [r[1] for r in rows], "problem": [r[2] for r in rows]}, dtype=object)


def parse(files: DataFrame) -> DataFrame:
    """``source, body``, the known keys, ``extra``, ``extra_types`` and ``problem`` from ``source, text``."""
    front, body = tx.front_split(F.col("text"))
    d = files.select("source", front.alias("front"), body.alias("body")).withColumn("y", decoded_front("front"))
    known = F.array(*[F.lit(k) for k in KNOWN])
    return d.select(
        "source", "body", *[F.col("y.values")[k].alias(k) for k in KNOWN],
        F.map_filter("y.values", lambda k, v: ~F.array_contains(known, k)).alias("extra"), F.map_filter("y.types", lambda k, v: ~F.array_contains(known, k)).alias("extra_types"),
        F.map_filter("y.types", lambda k, v: F.array_contains(known, k) & (v != "str")).alias("odd"), F.col("y.problem").alias("problem"),
    )


def rule_breaks(d: DataFrame) -> Column:
    """Every rule a document breaks, as an array of words; which keys it needs depends on its stored type."""
    technology = F.coalesce(F.col("doc_type") == "technology", F.lit(False))
    checks = [(k, F.when(technology, tx.blank(F.col(k)) if k in TECHNOLOGY_KEYS else F.lit(False)).otherwise(tx.blank(F.col(k)) if k in PROJECT_KEYS else F.lit(False))) for k in KNOWN]
    out = [F.when(bad, F.lit(f"missing_{k}")) for k, bad in checks]
    out.append(F.when(technology & F.col("id").isNotNull() & tx.blank(F.col("id")), F.lit("blank_id")))
    out.append(F.when(~tx.blank(F.col("doc_type")) & ~F.col("doc_type").isin(*DOC_TYPES), F.lit("unknown_doc_type")))
    out.append(F.when(technology & ~tx.blank(F.col("source_url")) & ~tx.url_ok(F.col("source_url")), F.lit("bad_source_url")))
    out.append(F.when(F.size(F.array_intersect(F.map_keys(F.coalesce("extra", F.create_map().cast("map<string,string>"))), F.array(*[F.lit(k) for k in RESERVED]))) > 0, F.lit("reserved_key")))
    if "extra_types" in d.columns:
        kinds = F.map_values(F.coalesce("extra_types", F.create_map().cast("map<string,string>")))
        out.append(F.when(F.exists(kinds, lambda t: ~t.isin("str", "int", "float", "bool")), F.lit("odd_value")))
    if "odd" in d.columns:
        out.append(F.when(F.size("odd") > 0, F.lit("not_a_string")))
    if "problem" in d.columns:
        out.append(F.when(F.col("problem").isNotNull(), F.lit("front_matter")))
    out.append(F.when(tx.blank(F.col("body")), F.lit("empty_body")))
    return F.array_compact(F.array(*out))


def with_identity(d: DataFrame) -> DataFrame:
    """``doc_id``: the stripped id, or one made from the address; and the address in normal form."""
    url = F.when(F.col("doc_type") == "technology", tx.url_normal(F.col("source_url"))).otherwise(F.col("source_url"))
    own = F.when(~tx.blank(F.col("id")), tx.strip(F.col("id")))
    return d.withColumn("doc_id", F.coalesce(own, F.when(F.col("doc_type") == "technology", tx.technology_id(F.col("source_url"))))).withColumn("source_url", url)


def validated(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid documents with their identity, and the rest with ``errors``."""
    d = d.withColumn("errors", rule_breaks(d))
    return with_identity(d.filter(F.size("errors") == 0)).drop("errors"), d.filter(F.size("errors") > 0)


def duplicate_ids(d: DataFrame) -> DataFrame:
    """``doc_id, documents`` of ids that several documents claim."""
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("documents")).filter("documents > 1")


def latest(d: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last version of each key.

    A key with a third of all rows is reduced to one row per partition before the shuffle:
    the order is folded into a struct and its maximum taken.
    """
    cols = [c for c in d.columns if c not in key]
    pick = F.max_by(F.struct(*cols), F.struct(*order))
    return d.groupBy(*key).agg(pick.alias("r")).select(*key, "r.*")


def raise_invalid(bad: DataFrame, dupes: DataFrame, most: int = 20) -> None:
    """Raises with the first errors, if there are any; nothing has been written by then."""
    found = [f"{r.source}: {', '.join(r.errors)}" for r in bad.select("source", "errors").orderBy("source").limit(most).collect()]
    found += [f"{r.doc_id}: {r.documents} documents" for r in dupes.orderBy("doc_id").limit(most).collect()]
    if found:
        raise DocumentInvalid("; ".join(found))
