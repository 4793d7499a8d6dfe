"""Records that nearly repeat each other, found by Golay-code fuzzy hashing (problem 5).

Each text becomes a fingerprint of ``segments`` x 23 bits, one bit per bin of a
one-permutation minhash over its distinct character runs: two texts of similarity J
differ in about (1 - J) / 2 of the bits.  Every 23-bit segment is decoded with the binary
Golay code to all codewords within distance 4 (one within 3, as the code is perfect, and
about four more), so segments with a few differing bits share a codeword.  A key joins the
codeword indices of two neighbouring segments, whatever the size of the table, so that a pair
is found in a large one as in a small one.  By the pigeonhole principle, differing bits
spread over the segments, some group has few, and the pair meets in a key.  Each key carries
64 bits of other segments: texts that meet by chance, a number that grows with the table,
fail on these within the join.  Pairs left are screened by the distance of their
fingerprints and verified exactly.

Equal texts are one class with one representative; keys, joins and verification run over
classes.  No bucket is capped, and no table is broadcast.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at
from . import lookalike as la
from .rolling import blocks, gram_hashes, mixed
from ..sources.staging import staged

# Fixed value: generator polynomial of the binary Golay code of length 23.
GOLAY = 0b101011100011
RADIUS = 4
TOGETHER = 2  # segments of a key
BLOCK = 1 << 19


@lru_cache(1)
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of all 23-bit words; per syndrome the error patterns of weight <= RADIUS and their number."""
    syndrome_of_bit = []
    for i in range(23):
        r = 1 << i
        for k in range(22, 10, -1):
            if r >> k & 1:
                r ^= GOLAY << (k - 11)
        syndrome_of_bit.append(r)
    syn = np.zeros(1, np.uint16)
    for i in range(23):
        syn = np.concatenate([syn, syn ^ np.uint16(syndrome_of_bit[i])])
    weights = np.zeros(1, np.uint8)
    for _ in range(23):
        weights = np.concatenate([weights, weights + 1])
    near = np.flatnonzero(weights <= RADIUS)
    by = near[np.argsort(syn[near], kind="stable")]
    count = np.bincount(syn[by], minlength=2048)
    patterns = np.zeros((2048, count.max()), np.uint32)
    k = np.arange(len(by)) - np.repeat(np.cumsum(count) - count, count)
    patterns[syn[by], k] = by
    return syn, patterns, count


def codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """12-bit indices of the codewords near each word, padded, and how many there are."""
    syn, patterns, count = golay_tables()
    s = syn[words]
    return ((words[:, None] ^ patterns[s]) >> 11).astype(np.int64), count[s]


def fingerprints(cps: np.ndarray, offs: np.ndarray, run: int, segments: int) -> np.ndarray:
    """A row of 23-bit words per text; texts without a run of characters get zeros."""
    bins = 23 * segments
    n = len(offs) - 1
    out = np.zeros((n, segments), np.uint32)
    for a, b in blocks(offs, BLOCK):
        o = offs[a : b + 1] - offs[a]
        part = cps[offs[a] : offs[b]]
        h = gram_hashes(part, run)
        row = np.repeat(np.arange(b - a), np.diff(o))[: len(h)]
        inside = np.arange(len(h)) + run <= o[1:][row]
        h, row = h[inside], row[inside]
        slot = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        least = np.full((b - a) * bins, 0xFFFFFFFF, np.uint32)
        np.minimum.at(least, row * bins + slot, (h & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        least = least.reshape(b - a, bins)
        empty = least == 0xFFFFFFFF
        some = ~empty.all(axis=1)
        cells = least.astype(np.uint64) | (np.arange(bins, dtype=np.uint64) << np.uint64(32))
        r, c = np.nonzero(empty & some[:, None])
        tried = 0
        while len(r):  # an empty bin takes the minimum of another bin, the same one in every text
            tried += 1
            with np.errstate(over="ignore"):
                other = (mixed(c.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(tried)) % np.uint64(bins)).astype(np.int64)
            full = ~empty[r, other]
            cells[r[full], c[full]] = least[r[full], other[full]].astype(np.uint64) | (c[full].astype(np.uint64) << np.uint64(32)) | (np.uint64(1) << np.uint64(60))
            r, c = r[~full], c[~full]
        bits = (mixed(cells) >> np.uint64(17) & np.uint64(1)).astype(np.uint32)
        words = (bits.reshape(b - a, segments, 23) << np.arange(23, dtype=np.uint32)).sum(axis=2).astype(np.uint32)
        words[~some] = 0
        out[a:b] = words
    return out


def _normal(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return la.without_space(*la.fold(cps, offs))


def _forms(least: int, run_length: int, segments: int):
    """``id, body -> id, form, print``: the form that is compared, without white space, and its fingerprint; short ones vanish."""

    def run(batches):
        for b in batches:
            c, o = _normal(*at.codepoints(b.column(1)))
            long = pa.array(np.diff(o) >= least)
            w = fingerprints(c, o, run_length, segments)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, segments, dtype=np.int32)), pa.array(w.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(long), at.to_arrow(c, o).filter(long), flat.filter(long)], names=["id", "form", "print"])

    return run


def _keys(batches):
    """``id, print -> id, key, sketch``: for each group of segments every combination of nearby codewords, and bits of the next segments."""
    for b in batches:
        if b.num_rows == 0:
            continue
        segments = len(b.column(1)[0])
        words = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, segments).astype(np.uint32)
        ids = b.column(0).to_numpy()
        for g in range(segments // TOGETHER):
            key, owner = np.full(len(ids), g, np.int64), np.arange(len(ids))
            for s in range(TOGETHER):
                index, count = codewords(words[owner, g * TOGETHER + s])
                n = count
                j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                pick = np.repeat(np.arange(len(owner)), n)
                key, owner = (key[pick] << 12) | index[pick, j], owner[pick]
            sketch = np.zeros(len(ids), np.uint64)
            for k in range(3):
                sketch |= words[:, (g * TOGETHER + TOGETHER + k) % segments].astype(np.uint64) << np.uint64(23 * k)
            yield pa.RecordBatch.from_arrays([pa.array(ids[owner]), pa.array(key), pa.array(sketch.view(np.int64)[owner])], names=["id", "key", "sketch"])


def _verified(run_length: int, similarity: float):
    """``a, b, form_a, form_b -> a, b, similarity`` for the pairs that reach it."""

    def run(batches):
        held: dict[str, np.ndarray] = {}

        def runs(s: str) -> np.ndarray:
            r = held.get(s)
            if r is None:
                if len(held) > 256:
                    held.clear()
                c, _ = at.from_strings([s])
                r = held[s] = np.unique(gram_hashes(c, run_length))
            return r

        for b in batches:
            left, right = b.column(2).to_pylist(), b.column(3).to_pylist()
            sim = np.zeros(b.num_rows)
            for i, (x, y) in enumerate(zip(left, right)):
                x, y = runs(x), runs(y)
                both = len(x) + len(y) - len(np.union1d(x, y)) if len(x) and len(y) else 0
                sim[i] = both / max(1, len(x) + len(y) - both)
            ok = pa.array(sim >= similarity)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok), pa.array(sim).filter(ok)], names=["a", "b", "similarity"])

    return run


def _merged(df: DataFrame) -> DataFrame:
    """A side of a join that sorts and merges, so that neither side goes through the driver.

    Spark guesses a staged table's size by its compressed file, and that of rows made from it by their
    width, not their number: a print's 198 keys count as one, and a text as 20 bytes.
    """
    return df.hint("merge")


def classes(df: DataFrame, id_col: str, text_col: str, least: int, run_length: int, segments: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Membership ``id, rep`` of classes of equal forms, ``id, print`` and ``id, fk`` of the representatives, and ``id, fk, form`` of all rows.

    Null ids, null texts and forms shorter than ``least`` are out; repeated rows count once.
    Where rows repeat an id with different texts, the one of least digest stands for it.
    """
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body")).filter("id is not null and body is not null")
    rows = src.mapInArrow(_forms(least, run_length, segments), "id long, form string, print array<int>")
    forms = staged(rows.withColumn("fk", F.unhex(F.md5("form"))), "forms")
    keyed = forms.groupBy("id").agg(F.min("fk").alias("fk"))
    rep = staged(keyed.groupBy("fk").agg(F.min("id").alias("rep")), "classes")
    members = keyed.join(_merged(rep), "fk").select("id", "rep")
    own = rep.select("fk", F.col("rep").alias("id"))
    prints = forms.select("id", "fk", "print").join(_merged(own), ["id", "fk"], "left_semi").groupBy("id").agg(F.first("print").alias("print"))
    return members, prints, own, forms.select("id", "fk", "form")


def near_pairs(
    df: DataFrame, id_col: str, text_col: str, run_length: int = 8, similarity: float = 0.7, least: int = 300, segments: int = 14, slack: float = 0.12, sketch_slack: float = 0.2
) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a, b, similarity`` of class representatives (a < b), and the membership ``id, rep``.

    ``slack`` is the part of differing bits beyond the expected (1 - J) / 2 that the screen lets through,
    ``sketch_slack`` the same for the 64 bits beside a key.
    """
    members, prints, own, forms = classes(df, id_col, text_col, least, run_length, segments)
    members, prints = staged(members, "members"), staged(prints, "prints")
    keys = prints.mapInArrow(_keys, "id long, key long, sketch long")
    alike = F.bit_count(F.col("x.sketch").bitwiseXOR(F.col("y.sketch"))) <= int(64 * ((1 - similarity) / 2 + sketch_slack))
    met = keys.alias("x").join(_merged(keys.alias("y")), (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & alike).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    differ = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    allowed = int(23 * segments * ((1 - similarity) / 2 + slack))
    close = (
        met.join(_merged(prints.select(F.col("id").alias("a"), F.col("print").alias("pa"))), "a")
        .join(_merged(prints.select(F.col("id").alias("b"), F.col("print").alias("pb"))), "b")
        .filter(differ <= allowed)
        .select("a", "b")
    )
    close = staged(close, "close")
    needed = close.select(F.col("a").alias("id")).unionAll(close.select(F.col("b").alias("id"))).distinct()
    needed = own.join(_merged(needed), "id", "left_semi")
    texts = staged(forms.join(_merged(needed), ["id", "fk"], "left_semi").select("id", "form").dropDuplicates(["id"]), "texts")
    pairs = (
        close.join(_merged(texts.select(F.col("id").alias("a"), F.col("form").alias("fa"))), "a")
        .join(_merged(texts.select(F.col("id").alias("b"), F.col("form").alias("fb"))), "b")
        .select("a", "b", "fa", "fb")
        .mapInArrow(_verified(run_length, similarity), "a long, b long, similarity double")
    )
    return staged(pairs, "pairs"), members


def near_duplicate_rows(df: DataFrame, id_col: str, text_col: str, **how) -> DataFrame:
    """All pairs of rows, ``row_a < row_b``: members of one class and of classes that are near."""
    pairs, members = near_pairs(df, id_col, text_col, **how)
    across = (
        pairs.join(_merged(members.select(F.col("rep").alias("a"), F.col("id").alias("x"))), "a")
        .join(_merged(members.select(F.col("rep").alias("b"), F.col("id").alias("y"))), "b")
        .select("x", "y")
    )
    several = members.groupBy("rep").count().filter("count > 1").select("rep")
    own = members.join(_merged(several), "rep", "left_semi")
    inside = own.alias("p").join(_merged(own.alias("q")), (F.col("p.rep") == F.col("q.rep")) & (F.col("p.id") < F.col("q.id"))).select(F.col("p.id").alias("x"), F.col("q.id").alias("y"))
    both = across.unionByName(inside).filter("x <> y")
    return both.select(F.least("x", "y").alias("row_a"), F.greatest("x", "y").alias("row_b")).distinct()


def components(pairs: DataFrame, members: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``id, group``: connected components over class representatives, the group named by its least id.

    Alternates linking every neighbour to the least one (large star) and shortening
    (small star); each round is a shuffle of the links, written to the shared folder.
    """
    edges = staged(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    before = None
    for _ in range(most_rounds):
        for large in (True, False):
            if large:
                both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            else:
                both = edges
            low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
            hop = both.join(_merged(low), "u")
            if large:
                hop = hop.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            else:
                hop = hop.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
            edges = hop.filter("u <> v").distinct()
        edges = staged(edges, "links")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return members.join(_merged(edges.select(F.col("u").alias("rep"), "v")), "rep", "left").select("id", "rep", F.coalesce("v", "rep").alias("group"))


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, **how) -> DataFrame:
    """One row per record: ``id, group_id, group_size, links``.

    ``links`` counts the other classes near the record's own.  Records without a
    comparable text (null, or shorter than ``least``) are groups of their own with 0 links.
    """
    pairs, members = near_pairs(df, id_col, text_col, **how)
    found = components(pairs, members)
    links = pairs.select(F.col("a").alias("rep")).unionAll(pairs.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    ids = df.select(F.col(id_col).cast("long").alias("id")).filter("id is not null").distinct()
    best = found.groupBy("id").agg(F.min("group").alias("group"), F.min("rep").alias("rep"))
    out = ids.join(_merged(best), "id", "left").join(_merged(links), "rep", "left").withColumn("group_id", F.coalesce("group", "id"))
    sizes = out.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size"))
    return out.join(_merged(sizes), "group_id").select("id", "group_id", F.col("group_size").cast("long").alias("group_size"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
