"""Token counts under an existing byte-level BPE vocabulary, and their totals (problem 3).

A text is cut into pieces by the vocabulary's pattern.  Each different piece is tokenised
once per worker and weighted by how often it stands in the text: its bytes form a doubly
linked list of symbols, a priority queue holds the possible merges by rank and place, and
the symbols that survive are counted.  Counts are exact integers, so totals roll up exactly.
"""

from __future__ import annotations

import base64
import collections
import hashlib
import heapq
from functools import lru_cache
from operator import mul

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which byte-level BPE vocabularies cut text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Different pieces whose counts a worker keeps between batches.
KEPT = 400_000


@lru_cache(4)
def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: a base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def count_tokens(piece: bytes, ranks: dict[bytes, int]) -> int:
    """Symbols that are left of a piece after all merges, lowest rank first, leftmost among equals."""
    n = len(piece)
    if n < 2 or piece in ranks:
        return min(n, 1)
    before, after, end = list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))
    alive = [True] * n
    queue = []
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            queue.append((rank, i, i + 2))
    heapq.heapify(queue)
    left = n
    while queue:
        _, i, stop = heapq.heappop(queue)
        if not alive[i]:
            continue
        j = after[i]
        if j >= n or end[j] != stop:
            continue  # one of the two symbols has changed since
        alive[j] = False
        end[i], after[i] = stop, after[j]
        left -= 1
        if after[j] < n:
            before[after[j]] = i
            rank = ranks.get(piece[i : end[after[j]]])
            if rank is not None:
                heapq.heappush(queue, (rank, i, end[after[j]]))
        p = before[i]
        if p >= 0:
            rank = ranks.get(piece[p:stop])
            if rank is not None:
                heapq.heappush(queue, (rank, p, stop))
    return left


_cache: dict[str, dict[str, int]] = {}


class Counter:
    """Counts tokens of texts; keeps the counts of pieces it has seen under ``name``, which tells vocabularies and patterns apart."""

    def __init__(self, name: str, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.known = _cache.setdefault(name, {})

    def __call__(self, text: str) -> int:
        known, found = self.known, collections.Counter(self.find(text))
        try:
            return sum(map(mul, map(known.__getitem__, found), found.values()))
        except KeyError:
            pass
        if len(known) > KEPT:
            known.clear()
        for piece in found:
            if piece not in known:
                known[piece] = count_tokens(piece.encode("utf-8", "replace"), self.ranks)
        return sum(map(mul, map(known.__getitem__, found), found.values()))


def counter_for(spark, path: str = TOKENIZER, pattern: str = PATTERN):
    """A function that makes the counter on a worker; the vocabulary goes there once, as a broadcast of fixed size."""
    ranks = spark.sparkContext.broadcast(read_ranks(path))
    with open(path, "rb") as f:
        name = f"{hashlib.file_digest(f, 'sha256').hexdigest()}:{pattern}"
    return lambda: Counter(name, ranks.value, pattern)


def with_tokens(df: DataFrame, keep: list[str], text_col: str, path: str = TOKENIZER, name: str = "tokens") -> DataFrame:
    """The columns ``keep`` and the texts' token counts; null and empty texts have 0 tokens."""
    src = df.select(*keep, F.col(text_col).cast("string"))
    make = counter_for(df.sparkSession, path)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[: len(keep)]) + f"{', ' if keep else ''}`{name}` long"

    def run(batches):
        count = make()
        for b in batches:
            n = np.fromiter((count(t) if t else 0 for t in b.column(len(keep)).to_pylist()), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n)], names=[*keep, name])

    return src.mapInArrow(run, schema)


def regular(c: Column) -> Column:
    """A label in its regular spelling: no outer space, lower case, ``_`` between words."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"^[\s 　]+|[\s 　]+$", ""), r"[\s-]+", "_"))


def language(c: Column) -> Column:
    """The primary language of a tag: ``zh-CN`` and ``ZH`` are ``zh``; blank ones are null."""
    x = F.lower(F.regexp_extract(c, r"^\s*([A-Za-z]+)", 1))
    return F.when(x != "", x)


def host(c: Column) -> Column:
    """The host of an address, in lower case; null where there is none."""
    x = F.lower(F.regexp_extract(c, r"(?i)^\s*https?://(?:[^/@?#]*@)?([^/:?#\s]+)", 1))
    return F.when(x != "", x)


def token_budget(df: DataFrame, id_col: str, text_col: str, labels: dict[str, Column], path: str = TOKENIZER) -> DataFrame:
    """Totals per slice: ``dimension, value, documents, tokens``, and all of it under ``all``.

    Every label is a dimension; a null label is a slice of its own.  Counts per document
    are summed within each partition first; a slice with a third of all rows moves one row
    per partition.
    """
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), *[c.alias(f"l{k}") for k, c in enumerate(labels.values())])
    counted = with_tokens(src, [f"l{k}" for k in range(len(labels))], "t", path)
    sums = counted.groupBy(*[f"l{k}" for k in range(len(labels))]).agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"))
    cells = [F.struct(F.lit(name).alias("dimension"), F.col(f"l{k}").cast("string").alias("value")) for k, name in enumerate(labels)]
    cells.append(F.struct(F.lit("all").alias("dimension"), F.lit(None).cast("string").alias("value")))
    rows = sums.select(F.explode(F.array(*cells)).alias("s"), "documents", "tokens").select("s.*", "documents", "tokens")
    return rows.groupBy("dimension", "value").agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
