"""One form for texts that look alike (problem 4).

Texts become flat code-point arrays.  One table gather replaces every code point by its
expansion (none, one or several code points), a second pass puts combining marks in
canonical order and composes them with their bases, all on whole batches.  No string
method runs per row.

Folded: letters and digits of any width, canonical compositions, ligatures, radical and
unit signs, Cyrillic and Greek letters drawn like Latin ones, every space to U+0020,
CR LF to LF; signs without width vanish.  Kept apart: letter case, traditional forms,
punctuation and every other visible difference.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrowtext as at
from .rolling import blocks
from ..sources.staging import staged

#: Code points from here on are kept, but for tags and variation selectors.
TOP = 0x30000
BLOCK = 1 << 18

# Cyrillic and Greek letters drawn like a Latin letter.
DRAWN_ALIKE = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "У": "Y", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ӏ": "I",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "ӏ": "l", "ѵ": "v",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "γ": "y", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
}
# Simplified radical signs that have no decomposition of their own.
RADICALS = {
    "⺌": "小", "⺠": "民", "⻁": "虎", "⻄": "西", "⻅": "见", "⻆": "角", "⻉": "贝", "⻋": "车", "⻓": "长", "⻔": "门",
    "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻢": "马", "⻣": "骨", "⻤": "鬼", "⻥": "鱼",
    "⻦": "鸟", "⻨": "麦", "⻩": "黄", "⻬": "齐", "⻮": "齿", "⻰": "龙",
}
# Format signs that are drawn, around or above the digits after them.
DRAWN_FORMATS = frozenset("\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u0890\u0891\u08e2\U000110bd\U000110cd")
# Blocks whose compatibility forms count as the same letters, digits or signs.
LETTER_BLOCKS = (
    (0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A), (0xFF66, 0xFFDC),  # widths
    (0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0xFB00, 0xFB4F),  # ligatures
    (0x2E80, 0x2FD5),  # radicals
    (0x00B5, 0x00B5), (0x2103, 0x2103), (0x2109, 0x2109), (0x2126, 0x212B), (0x3250, 0x3250), (0x32CC, 0x32CF), (0x3371, 0x33DF), (0x33FF, 0x33FF),  # unit signs
)


def _folded(c: str) -> str:
    """The expansion of one code point, fully decomposed."""
    o, kind = ord(c), unicodedata.category(c)
    if c in "\n":
        return c
    if c == "\r":  # told apart from a lone one in fold()
        return c
    if kind == "Zs" or c in "\t\v\f":
        return " "
    if kind in ("Zl", "Zp") or c == "\x85":
        return "\n"
    if kind in ("Cf", "Cc") and c not in DRAWN_FORMATS or o == 0x34F or 0xFE00 <= o <= 0xFE0F or 0x180B <= o <= 0x180F:
        return ""
    if c in RADICALS:
        return RADICALS[c]
    if any(a <= o <= b for a, b in LETTER_BLOCKS):
        c = unicodedata.normalize("NFKC", c)
    return "".join(DRAWN_ALIKE.get(x, x) for x in unicodedata.normalize("NFD", c))


@lru_cache(1)
def tables() -> dict[str, np.ndarray]:
    """Expansion sizes, starts and pool; combining classes; sorted composition pairs."""
    size, start, pool = np.ones(TOP, np.uint8), np.zeros(TOP, np.int32), []
    single = np.arange(TOP, dtype=np.uint32)
    ccc = np.zeros(TOP, np.uint8)
    jamo = np.zeros(TOP, bool)
    jamo[0x1161:0x1200] = True
    left, right, whole = [], [], []
    for o in range(TOP):
        if 0x3400 <= o <= 0x9FFF or 0xD800 <= o <= 0xF8FF or o >= 0x20000 and o < 0x2F800:
            continue  # ideographs, surrogates and private use stand for themselves
        c = chr(o)
        x = _folded(c)
        if x != c:
            size[o] = len(x)
            if len(x) == 1:
                single[o] = ord(x)
            start[o] = len(pool)
            pool.extend(map(ord, x))
        ccc[o] = unicodedata.combining(c)
        d = unicodedata.decomposition(c)
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", c) == c:
            a, b = (int(v, 16) for v in d.split())
            left.append(a), right.append(b), whole.append(o)
    for syllable in range(0xAC00, 0xD7A4):
        t = (syllable - 0xAC00) % 28
        if t:
            left.append(syllable - t), right.append(0x11A7 + t)
        else:
            left.append(0x1100 + (syllable - 0xAC00) // 588), right.append(0x1161 + (syllable - 0xAC00) % 588 // 28)
        whole.append(syllable)
    special = (size != 1) | (single != np.arange(TOP)) | (ccc > 0) | jamo
    special[[13, TOP - 1]] = True
    key = (np.array(left, np.uint64) << np.uint64(21)) | np.array(right, np.uint64)
    order = np.argsort(key)
    return {
        "size": size, "start": start, "pool": np.array(pool, np.uint32), "single": single, "ccc": ccc,
        "pair": key[order], "whole": np.array(whole, np.uint32)[order], "follows": (ccc > 0) | jamo,
        "special": special,
    }


def _compose(cps: np.ndarray, offs: np.ndarray, t: dict, spots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Marks in canonical order, joined with their bases where a composed form exists; last, which code points are left.

    ``spots`` are the places of marks; runs of them are handled side by side, the k-th
    mark of every run in round k.
    """
    if not len(spots):
        return cps, offs, None
    cps = cps.copy()
    begins = np.isin(spots, offs)  # a mark that begins its text has no base
    first = np.concatenate([[True], np.diff(spots) != 1]) | begins
    run = np.cumsum(first) - 1
    base = np.maximum(spots[first] - 1, 0)[run]
    ccc = t["ccc"][cps[spots]].astype(np.int64)
    if ((ccc[1:] > 0) & (ccc[:-1] > ccc[1:]) & ~first[1:]).any():
        part = run * (len(spots) + 1) + np.cumsum(ccc == 0)  # marks don't move past a class-0 sign
        order = np.lexsort((ccc, part))
        cps[spots], ccc = cps[spots][order], ccc[order]
    starter = (t["ccc"][np.minimum(cps[base], TOP - 1)] == 0) & ~begins[first][run]
    depth = np.arange(len(spots)) - np.flatnonzero(first)[run]
    keep = np.ones(len(cps), bool)
    last, stuck = np.zeros(int(run[-1]) + 1, np.int64), np.zeros(int(run[-1]) + 1, bool)
    for k in range(int(depth.max()) + 1):
        at_k = np.flatnonzero(depth == k)
        p, b, r, c = spots[at_k], base[at_k], run[at_k], ccc[at_k]
        key = (cps[b].astype(np.uint64) << np.uint64(21)) | cps[p].astype(np.uint64)
        i = np.minimum(np.searchsorted(t["pair"], key), len(t["pair"]) - 1)
        hit = (t["pair"][i] == key) & starter[at_k] & ~stuck[r] & ((last[r] == 0) | (last[r] < c))
        cps[b[hit]] = t["whole"][i[hit]]
        keep[p[hit]] = False
        miss = ~hit
        last[r[miss]] = np.maximum(last[r[miss]], c[miss])
        stuck[r[miss]] |= c[miss] == 0
    return cps[keep], at.kept(keep, offs), keep


def _fold_block(cps: np.ndarray, offs: np.ndarray, t: dict, origin: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    beyond = len(cps) > 0 and cps.max() >= TOP
    low = np.minimum(cps, TOP - 1) if beyond else cps
    spots = np.flatnonzero(t["special"][low])
    if not len(spots):
        return cps, offs, origin
    here = low[spots]
    size = t["size"][here].astype(np.int64)
    value = t["single"][here]
    if beyond:
        high = cps[spots] >= TOP
        tag = (cps[spots] >= 0xE0000) & (cps[spots] <= 0xE0FFF)
        size = np.where(high, np.where(tag, 0, 1), size)
        value = np.where(high, cps[spots], value)
    cr = here == 13
    if cr.any():  # CR LF is one line end, a lone CR is one, too
        after = np.append(cps, 0)[spots + 1] == 10
        after &= ~np.isin(spots + 1, offs)
        size[cr & after] = 0
        value[cr] = 10
    out = cps.copy()
    out[spots] = value
    if (size != 1).any():
        full = np.ones(len(cps), np.int64)
        full[spots] = size
        ends = np.concatenate([[0], np.cumsum(full)])
        new = np.repeat(out, full)
        origin = None if origin is None else np.repeat(origin, full)
        m = size > 1
        if m.any():
            n = size[m]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            new[np.repeat(ends[spots[m]], n) + inner] = t["pool"][np.repeat(t["start"][here[m]], n) + inner]
        out, offs = new, ends[offs]
    marks = np.flatnonzero(t["follows"][np.minimum(out, TOP - 1) if beyond else out])
    out, offs, keep = _compose(out, offs, t, marks)
    return out, offs, origin if origin is None or keep is None else origin[keep]


def fold_with_origins(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The consistent form of one text, and for each code point of it the place it came from; a composed one came from its base."""
    out, _, origin = _fold_block(cps, np.array([0, len(cps)]), tables(), np.arange(len(cps)))
    return out, origin


def fold(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The consistent form of every text of a batch."""
    t = tables()
    if len(cps) == 0:
        return cps, offs
    parts, ends = [], [np.zeros(1, np.int64)]
    for a, b in blocks(offs, BLOCK):
        c, o, _ = _fold_block(cps[offs[a] : offs[b]], offs[a : b + 1] - offs[a], t)
        parts.append(c)
        ends.append(o[1:] + ends[-1][-1])
    return np.concatenate(parts), np.concatenate(ends)


@lru_cache(1)
def _alnum() -> np.ndarray:
    """Lower-case form of letters and digits, 0 for every other code point below TOP."""
    low = np.zeros(TOP, np.uint32)
    for o in range(TOP):
        if 0x3400 <= o <= 0x4DBF or 0x4E00 <= o <= 0x9FFF or 0x20000 <= o < 0x2F800:
            low[o] = o
        elif not 0xD800 <= o <= 0xF8FF and (c := chr(o)).isalnum():
            low[o] = ord(c.lower()[0])
    return low


def is_letter_or_digit(cps: np.ndarray) -> np.ndarray:
    return (cps < TOP) & (_alnum()[np.minimum(cps, TOP - 1)] > 0)


def letters_and_digits(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters and digits of a folded batch."""
    low = np.where(cps < TOP, _alnum()[np.minimum(cps, TOP - 1)], 0)
    keep = low > 0
    return low[keep].astype(np.uint32), at.kept(keep, offs)


def without_space(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A folded batch without white space."""
    keep = (cps != 32) & (cps != 10)
    return cps[keep], at.kept(keep, offs)


def fold_string(s: str) -> str:
    cps, offs = fold(*at.from_strings([s]))
    return at.text_of(cps)


def with_folded(df: DataFrame, columns: dict[str, str], keep: list[str]) -> DataFrame:
    """``keep`` plus, for each ``{column: name}``, its consistent form under ``name``.

    Nulls stay null, empty texts empty.  Columns that aren't named are dropped first, so
    extra or clashing names do no harm.
    """
    src = df.select(*keep, *columns)
    schema = T.StructType([src.schema[k] for k in keep] + [T.StructField(v, T.StringType()) for v in columns.values()])

    def run(batches):
        for b in batches:
            cols = [b.column(k) for k in range(len(keep))]
            for k in range(len(columns)):
                c = b.column(len(keep) + k)
                cps, offs = fold(*at.codepoints(c))
                cols.append(at.to_arrow(cps, offs, np.asarray(c.is_valid())))
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *columns.values()])

    return src.mapInArrow(run, schema)


def _keyed(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """``field, id, stored, form``: digests of the stored text and of its consistent form; null texts are out."""

    def run(batches):
        for b in batches:
            for k, name in enumerate(columns):
                c = b.column(1 + k)
                cps, offs = fold(*at.codepoints(c))
                form = at.to_arrow(cps, offs)
                ok = c.is_valid()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * b.num_rows).filter(ok), b.column(0).filter(ok), c.filter(ok).cast(pa.string()), form.filter(ok)],
                    names=["field", "id", "stored", "form"],
                )

    src = df.select(F.col(id_col).cast("long").alias("id"), *[F.col(c).cast("string") for c in columns]).filter("id is not null")
    rows = src.mapInArrow(run, "field string, id long, stored string, form string")
    return rows.select("field", "id", F.unhex(F.md5("stored")).alias("stored"), F.unhex(F.md5("form")).alias("form"))


def lookalike_pairs(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """``field, row_a, row_b``: rows whose values look the same but are stored with different characters.

    Rows are shuffled as digests.  Different stored strings of one form are paired first,
    then widened to their rows, so equal strings never meet each other.  Null values and
    null ids are out; empty texts equal only themselves and texts without visible signs;
    repeated rows count once; further columns are ignored.
    """
    rows = staged(_keyed(df, id_col, columns).distinct(), "looks")
    several = rows.groupBy("field", "form").agg(F.min("stored").alias("l"), F.max("stored").alias("h")).filter("l < h").select("field", "form")
    rows = rows.join(several, ["field", "form"], "left_semi")
    kinds = rows.select("field", "form", "stored").distinct()
    pairs = kinds.join(kinds.withColumnRenamed("stored", "other"), ["field", "form"]).filter("stored < other")
    out = (
        pairs.join(rows.select("field", "form", "stored", F.col("id").alias("x")), ["field", "form", "stored"])
        .join(rows.select("field", "form", F.col("stored").alias("other"), F.col("id").alias("y")), ["field", "form", "other"])
        .filter("x <> y")
    )
    return out.select("field", F.least("x", "y").alias("row_a"), F.greatest("x", "y").alias("row_b")).distinct()


def lookalike_classes(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """One row per value: ``field, row_id, class_id, stored_forms, class_rows``; the class is named by the digest of the form."""
    rows = staged(_keyed(df, id_col, columns).distinct(), "looks")
    kinds = rows.groupBy("field", "form", "stored").agg(F.count(F.lit(1)).alias("n"))
    sizes = kinds.groupBy("field", "form").agg(F.count(F.lit(1)).alias("stored_forms"), F.sum("n").cast("long").alias("class_rows"))
    return rows.join(sizes, ["field", "form"]).select("field", F.col("id").alias("row_id"), F.lower(F.hex("form")).alias("class_id"), "stored_forms", "class_rows")
