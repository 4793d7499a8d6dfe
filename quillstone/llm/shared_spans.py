"""Long exact spans shared between documents (problem 8).

The method is a sparse suffix tree, split by variable-length prefixes:

1.  Of all suffixes only landmarks go in: the position whose ``span / 2``-gram has the
    least hash among those of a window of ``span`` characters.  Equal windows pick equal
    landmarks, so every shared window holds a landmark whose gram is shared, too.
2.  The prefixes of the landmark suffixes (their grams) that stand in one document only
    are dropped after one pre-aggregated shuffle.
3.  What is left is split by prefix into groups that fit into memory.  A group with more
    than ``group_limit`` distinct contexts gets longer prefixes: the windows around the
    landmark are divided by offset, and those of a division share a longer string.  At
    the last level a prefix is a whole window and a plain aggregate decides.
4.  Every group becomes a suffix tree to the right of the landmark and one of reversed
    prefixes to its left, both as sorted order with common-prefix lengths.  Cutting both
    at complementary depths that add up to ``span`` gives the deep nodes; a node with
    leaves of two documents is a repeat.

Equal contexts are one leaf with the least and the greatest document; so a passage that
stands in a third of all documents costs one leaf per context.  No pairs are formed and
nothing is capped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import arrowtext as at
from .rolling import blocks, gram_hashes, sliding_min
from ..sources.staging import staged

BLOCK = 1 << 19


def _landmarks(cps: np.ndarray, offs: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, positions in the row and gram hashes of the landmarks of a batch."""
    gram, rows, spots, hashes = span // 2, [], [], []
    width = span - gram + 1
    for a, b in blocks(offs, BLOCK):
        start, o = int(offs[a]), offs[a : b + 1] - offs[a]
        part = cps[start : start + int(o[-1])]
        if len(part) < span:
            continue
        h = gram_hashes(part, gram)
        bits = np.uint64(max(20, int(len(h)).bit_length()))
        least = sliding_min(((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64), width)
        ends = np.repeat(o[1:], np.diff(o))[: len(least)]
        least = least[np.arange(len(least)) + span <= ends]
        if not len(least):
            continue
        spot = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        spot = spot[np.concatenate([[True], spot[1:] != spot[:-1]])]
        row = np.searchsorted(o, spot, side="right") - 1
        rows.append(row + a), spots.append(spot - o[row]), hashes.append(h[spot])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(spots), np.concatenate(hashes)


def _landmark_rows(span: int):
    def run(batches):
        for b in batches:
            row, spot, h = _landmarks(*at.codepoints(b.column(1)), span)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), b.column(0).take(pa.array(row)), pa.array(spot.astype(np.int32))], names=["h", "doc", "spot"]
            )

    return run


def _context_rows(span: int):
    """The text around each landmark in which its windows lie."""
    left = span - span // 2

    def run(batches):
        for b in batches:
            for doc, text, marks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                rows = [(m["h"], max(0, m["spot"] - left), m["spot"]) for m in marks]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int64()), pa.array([doc] * len(rows), pa.int64()), pa.array([r[2] for r in rows], pa.int32()),
                        pa.array([r[2] - r[1] for r in rows], pa.int32()), pa.array([text[r[1] : r[2] + span] for r in rows], pa.string()),
                    ],
                    names=["h", "doc", "spot", "before", "context"],
                )

    return run


def _cuts(order_lcp: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each leaf the node at which a tree is cut at ``depth``."""
    node = np.empty(len(order), np.int64)
    node[order] = np.cumsum(order_lcp < depth)
    return node


def _tree(strings: list[str], group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The leaves in sorted order by group, and each one's common prefix with the leaf before; -1 at a new group."""
    n = len(strings)
    order = np.array(sorted(range(n), key=lambda i: (group[i], strings[i])), np.int64)
    cells = np.zeros((n, width + 1), np.uint32)
    flat, offs = at.from_strings(strings)
    size = np.minimum(np.diff(offs), width)
    r = np.repeat(np.arange(n), size)
    c = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    cells[r, c] = flat[np.repeat(offs[:-1], size) + c]
    cells[np.arange(n), size] = 0xFFFFFFFF  # an end equals nothing ...
    cells = cells[order]
    lcp = np.full(n, -1, np.int64)
    differs = cells[1:] != cells[:-1]
    both_end = (cells[1:] == 0xFFFFFFFF) & (cells[:-1] == 0xFFFFFFFF)
    lcp[1:] = np.argmax(differs | both_end, axis=1)  # ... not even another end
    g = group[order]
    lcp[1:][g[1:] != g[:-1]] = -1
    return order, lcp


def _shared_offsets(group: np.ndarray, before: np.ndarray, context: list[str], low: np.ndarray, high: np.ndarray, lo: int, hi: int, span: int):
    """Leaf indices, first and last offset (characters before the landmark) of windows that two documents hold."""
    right_order, right_lcp = _tree([c[b:] for c, b in zip(context, before)], group, span)
    left_order, left_lcp = _tree([c[:b][::-1] for c, b in zip(context, before)], group, span - span // 2)
    size = np.array([len(c) for c in context]) - before
    n = len(context)
    hits = np.zeros((n, hi - lo + 3), bool)
    for off in range(lo, hi + 1):
        ok = np.flatnonzero((before >= off) & (size >= span - off))
        if not len(ok):
            continue
        node = _cuts(left_lcp, left_order, off)[ok] * (n + 1) + _cuts(right_lcp, right_order, span - off)[ok]
        by = np.argsort(node, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], node[by][1:] != node[by][:-1]]))
        many = np.minimum.reduceat(low[ok[by]], edge) < np.maximum.reduceat(high[ok[by]], edge)
        hits[ok[by], off - lo + 1] = np.repeat(many, np.diff(np.append(edge, len(by))))
    change = np.diff(hits.astype(np.int8), axis=1)
    leaf, first = np.nonzero(change == 1)
    last = np.nonzero(change == -1)[1] - 1
    return leaf, first + lo, last + lo


def _subtrees(span: int, wave: int = 20_000):
    """Rows ``(key, lo, hi, h, ck, before, context, low, high)`` sorted by key -> shared offsets of each context."""

    def solve(t: pa.Table):
        divisions = sorted({(a, b) for a, b in zip(t["lo"].to_pylist(), t["hi"].to_pylist())})
        for lo, hi in divisions:
            p = t.filter(pa.compute.and_(pa.compute.equal(t["lo"], lo), pa.compute.equal(t["hi"], hi)))
            if p.num_rows == 0:
                continue
            key = p["key"].to_pylist()
            names: dict = {}
            group = np.array([names.setdefault(k, len(names)) for k in key], np.int64)
            leaf, first, last = _shared_offsets(
                group, p["before"].to_numpy().astype(np.int64), p["context"].to_pylist(), p["low"].to_numpy(), p["high"].to_numpy(), lo, hi, span
            )
            i = pa.array(leaf)
            yield pa.RecordBatch.from_arrays(
                [p["h"].combine_chunks().take(i), p["ck"].combine_chunks().take(i), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))],
                names=["h", "ck", "first", "last"],
            )

    def run(batches):
        import pyarrow.compute  # noqa: F401

        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            if b.num_rows == 0:
                continue
            held.append(b)
            rows += b.num_rows
            if rows < wave:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            keys = t["key"]
            last = keys[-1].as_py()
            cut = t.num_rows
            while cut > 0 and keys[cut - 1].as_py() == last:
                cut -= 1
            if cut:
                yield from solve(t.slice(0, cut))
            held, rows = t.slice(cut).to_batches(), t.num_rows - cut
        if held:
            yield from solve(pa.Table.from_batches(held).combine_chunks())

    return run


def _with_keys(d: DataFrame, parts: int, span: int) -> DataFrame:
    """Each context once for each of ``parts`` divisions of its offsets, with the string its windows share as key."""
    left = span - span // 2
    edges = sorted({round(i * (left + 1) / parts) for i in range(parts + 1)})
    ranges = F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b - 1).alias("hi")) for a, b in zip(edges, edges[1:])])
    d = d.withColumn("r", F.explode(ranges)).select("*", "r.lo", "r.hi").drop("r", "key")
    inner = F.substring(F.col("context"), F.col("before") - F.col("lo") + 1, F.col("lo") + span - F.col("hi"))
    d = d.filter((F.col("before") >= F.col("lo")) & (F.length("context") - F.col("before") >= span - F.col("hi")))
    return d.withColumn("key", F.concat(F.unhex(F.md5(inner)), F.col("lo").cast("string").cast("binary")))


def shared_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 200, group_limit: int = 4096) -> DataFrame:
    """Maximal runs of shared characters: ``doc_id, span_start, span_end`` (0-based, end exclusive).

    A character is shared if it lies in ``span`` consecutive characters that another
    document holds too.  Null ids and null texts give no rows, texts shorter than ``span``
    neither; rows that repeat an id are one document, whose own repeats don't count.
    ``group_limit`` bounds what a task holds as one subtree, not what is found.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).filter(
        F.col("doc").isNotNull() & (F.length("text") >= span)
    )
    ids = docs.select("doc", F.md5("text").alias("tk"), F.length("text").alias("n"))
    copies = ids.groupBy("tk").agg(F.min("doc").alias("rep"), F.max("doc").alias("top"), F.max("n").alias("n"))
    whole = ids.join(copies.filter("rep < top").select("tk"), "tk", "left_semi").select("doc", F.lit(0).alias("a"), F.col("n").alias("b"))

    marks = staged(docs.mapInArrow(_landmark_rows(span), "h long, doc long, spot int"), "landmarks")
    several = marks.groupBy("h").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").select("h")
    mine = (
        marks.join(several, "h", "left_semi")
        .join(copies.select(F.col("rep").alias("doc")).distinct(), "doc", "left_semi")
        .groupBy("doc")
        .agg(F.collect_set(F.struct("h", "spot")).alias("marks"))
    )
    around = docs.join(mine, "doc").select("doc", "text", "marks").mapInArrow(_context_rows(span), "h long, doc long, spot int, before int, context string")
    around = staged(around.filter(F.length("context") >= span).withColumn("ck", F.unhex(F.md5(F.concat_ws("|", "before", "context")))), "contexts")

    leaves = staged(
        around.groupBy("h", "ck", "before").agg(F.first("context").alias("context"), F.min("doc").alias("low"), F.max("doc").alias("high")), "leaves"
    )
    plain = _with_keys(leaves, 1, span)
    sizes = plain.groupBy("key").count()
    hot = staged(sizes.filter(F.col("count") > group_limit).select("key"), "hot")
    ready = plain.join(sizes.filter((F.col("count") > 1) & (F.col("count") <= group_limit)).select("key"), "key", "left_semi")
    over = plain.join(F.broadcast(hot) if hot.count() < 10_000 else hot, "key", "left_semi").drop("lo", "hi")
    finer = _with_keys(over, 4, span)
    finer_sizes = finer.groupBy("key").count()
    ready = ready.unionByName(finer.join(finer_sizes.filter((F.col("count") > 1) & (F.col("count") <= group_limit)).select("key"), "key", "left_semi"))
    shape = ["key", "lo", "hi", "h", "ck", "before", "context", "low", "high"]
    deep = ready.select(*shape).repartition("key").sortWithinPartitions("key").mapInArrow(_subtrees(span), "h long, ck binary, first int, last int")

    # the longest prefixes are whole windows
    single = finer.join(finer_sizes.filter(F.col("count") > group_limit).select("key"), "key", "left_semi")
    off = F.explode(F.sequence("lo", F.least("hi", F.col("before"))))
    windows = single.withColumn("off", off).filter(F.length("context") - F.col("before") >= span - F.col("off"))
    windows = windows.select("h", "ck", "off", "low", "high", F.unhex(F.md5(F.substring(F.col("context"), F.col("before") - F.col("off") + 1, F.lit(span)))).alias("window"))
    both = windows.groupBy("window").agg(F.min("low").alias("l"), F.max("high").alias("t")).filter("l < t").select("window")
    last = windows.join(both, "window", "left_semi").select("h", "ck", F.col("off").alias("first"), F.col("off").alias("last"))
    alone = leaves.filter("low < high").select("h", "ck", F.lit(0).alias("first"), F.least(F.col("before"), F.lit(span - span // 2)).alias("last"), F.length("context").alias("n"), "before")
    alone = alone.withColumn("first", F.greatest(F.lit(0), span - (F.col("n") - F.col("before")))).filter("first <= last").select("h", "ck", "first", "last")

    found = deep.unionByName(last).unionByName(alone)
    spans = around.select("h", "ck", "doc", "spot").join(found, ["h", "ck"]).select(
        "doc", (F.col("spot") - F.col("last")).alias("a"), (F.col("spot") + span - F.col("first")).alias("b")
    )
    return merged(spans.unionByName(whole)).select(F.col("doc").alias("doc_id"), F.col("a").cast("int").alias("span_start"), F.col("b").cast("int").alias("span_end"))


def merged(spans: DataFrame) -> DataFrame:
    """Intervals ``doc, a, b`` of each document; those that overlap or touch become one."""
    spans = spans.distinct()
    w = W.partitionBy("doc").orderBy("a", "b")
    reach = F.max("b").over(w.rowsBetween(W.unboundedPreceding, -1))
    run = F.sum(F.when(reach.isNull() | (F.col("a") > reach), 1).otherwise(0)).over(w)
    return spans.withColumn("run", run).groupBy("doc", "run").agg(F.min("a").alias("a"), F.max("b").alias("b")).select("doc", "a", "b")


def shared_parts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 200, group_limit: int = 4096) -> DataFrame:
    """For every document: number of runs, shared characters and their part of the text (0 for empty or null texts)."""
    spans = shared_spans(df, id_col, text_col, span, group_limit)
    sums = spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("runs"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    all_docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.length(text_col), F.lit(0)).alias("n"))
    all_docs = all_docs.filter("doc_id is not null").groupBy("doc_id").agg(F.max("n").alias("n_chars"))
    out = all_docs.join(sums, "doc_id", "left")
    return out.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.coalesce("runs", F.lit(0)).cast("long").alias("runs"),
        F.coalesce("shared_chars", F.lit(0)).cast("long").alias("shared_chars"),
        F.round(F.coalesce(F.col("shared_chars") / F.when(F.col("n_chars") > 0, F.col("n_chars")), F.lit(0.0)), 6).alias("shared_part"),
    )
