"""Placeholders, filler and error notices in place of content (problem 2).

Character n-gram models of three kinds of residue and of natural prose:

* ``filler``, ``notice`` and ``placeholder`` are fitted on the common wordings of
  :mod:`phrases`, in three languages; placeholders also on bracket shapes, in which letters
  stand for their class;
* natural prose is fitted on plain sentences of the same module and on the different
  sentences of the whole corpus, code and sentences that the wordings alone make filler or
  notices taken out, so that frequent residue and copies of a page don't become natural.

The models are of 4 characters; where an ideograph's four are unknown to both sides, its
pair decides.  A text's prose is cut into sentences.  In each, windows of a high
log-likelihood ratio localise filler and notices, and they are excluded where the windows
cover most of the sentence, cell or field and the mean ratio is high, too; so a sentence
that explains or quotes a notice stays.  A window that ends a sentence is residue if it
begins like a sentence and no word of saying stands before it.  Placeholders are localised
by a shorter window.  A record's coverage is the part of its prose in such places.

The models have a fixed number of hashed cells, whatever the size of the corpus.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at
from . import lookalike as la
from . import phrases
from .rolling import mixed
from ..sources.staging import staged

CELLS = 1 << 20
GRAM = 4
START, END = 2, 3  # code points put around each sentence
WINDOW = 16  # grams of a placeholder's window
SPAN = 8  # grams of a window of filler or notice
#: What a window, and the mean of a unit, must reach; the part of a unit in such windows; the least sum, for which a high mean stands in.
LEAST_RATIO, LEAST_COVER, LEAST_SUM = 1.3, 0.65, 20.0
#: How much higher the mean must be where natural prose is still unknown.
BEFORE = 1.0
#: How much the fixed plain sentences weigh against the corpus.
PLAIN_SHARE = 0.3
UNKNOWN = -0.75  # the most that a gram unknown to a model counts
STEP = 12  # ratios are kept as whole twelfths, a byte each
SHORT = 6
LONG = 12  # characters; what is shorter may be a term that the line explains
HELD = 1 << 22  # bytes of sentences counted at once
#: The kinds that are judged by whole sentences, and their models.
WHOLE = ((2, ("filler_en", "filler_zh", "filler_de", "lorem")), (3, ("notice_en", "notice_zh", "notice_de", "reason")))
#: Of these, the ones with pairs of ideographs.
PAIRED = ("filler_zh", "notice_zh")

_FENCED = re.compile(r"^ {0,3}(`{3,}|~{3,})[^\n]*(?:\n(?! {0,3}\1[`~]*[ \t]*$)[^\n]*)*(?:\n {0,3}\1[`~]*[ \t]*$)?", re.M)
_INDENTED = re.compile(r"^(?: {4}|\t)[^\n]*$", re.M)
_INLINE = re.compile(r"(?<!`)(`+)(?!`)[^\n]+?(?<!`)\1(?!`)")
_QUOTED = re.compile(r"“[^”\n]{0,120}”|\"[^\"\n]{0,120}\"|「[^」\n]{0,120}」|„[^“\n]{0,120}“")
_TAG = re.compile(r"</?(?:h[1-6]|hr|center|noscript|p|div|span|br|body|html|title|a|li|ul|ol)\b[^>\n]*>", re.I)
_MARKER = re.compile(r"^(?:[^\S\n]|#{1,6}(?=\s)|[>*+|-](?=\s))*(?:\d+[.)][^\S\n]+)?", re.M)
_NUMBERED = re.compile(r"(?<![A-Za-z0-9_.\-])[A-Za-z_.\-]*+\d[A-Za-z0-9_.\-]*+")
_ENDS = ("。", "！", "？", "；", "!", "?", ";", ". ", "… ")
_UNIT = re.compile(r"\s*\|\s*|：\s*|:\s+|\s+[-–—]\s+|——")
_SAYS = re.compile(
    r"(?:提示|显示|报错|报|返回|出现|看到|写着|标为|标记为|例如|比如|即|为|是|\b(?:says?|said|shows?|reads?|returns?|message|error|prints?|displays?|sees?|see|text|like|as|is|means?|called"
    r"|zeigt|meldet|meldung|lautet|steht|heißt))[\s:：,，]*$",
    re.I,
)
_SIGN = re.compile(r"[{}$#<>%@\[\]【】（）()《》]|__|xx", re.I)
_CLOSING = " .。!！…:："
#: A line between two texts of a batch; folding leaves no such sign in a text.
_BREAK = "\x01"


def sentences(texts: list[str]) -> tuple[list[str], list[int]]:
    """The sentences of the texts' prose and the text each is from; code, quoted strings and list or heading marks are left out."""
    plain = []
    for t in texts:
        if "`" in t or "~~~" in t:
            t = _INLINE.sub(" ", _FENCED.sub("", t))
        if "    " in t or "\t" in t:
            t = _INDENTED.sub("", t)
        plain.append(t)
    text = f"\n{_BREAK}\n".join(plain)
    if "<" in text:
        text = _TAG.sub("\n", text)
    text = _MARKER.sub("", _QUOTED.sub(" ", text))
    for end in _ENDS:
        text = text.replace(end, end + "\n")
    out, owner, at_ = [], [], 0
    for line in text.split("\n"):
        line = line.strip(" \t")
        if line == _BREAK:
            at_ += 1
        elif line:
            out.append(line)
            owner.append(at_)
    return out, owner


@lru_cache(1)
def _views() -> tuple[np.ndarray, np.ndarray]:
    """Two views of a code point: lower case with digits as 0, and its class."""
    top = 0x3000
    raw, shape = np.arange(top, dtype=np.uint32), np.arange(top, dtype=np.uint32)
    for o in range(top):
        c = chr(o)
        if c.isalpha():
            raw[o] = ord(c.lower()[0])
            shape[o] = ord("A") if c.isupper() else ord("a")
        if c.isdigit():
            raw[o] = shape[o] = ord("0")
    return raw, shape


def _cells(cps: np.ndarray, view: int) -> np.ndarray:
    """The model cell of every 4-gram of a view."""
    table = _views()[view]
    x = table[np.minimum(cps, len(table) - 1)]
    rest = cps >= 0x3001
    if rest.any():
        x = np.where(rest, np.uint32(0x5B57) if view else cps, x)
        if view:
            x = np.where((cps >= 0x3001) & (cps <= 0x303F) | (cps >= 0xFF00), cps, x)
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        key = x[: len(x) - 3] * np.uint64(0x9E3779B97F4A7C15)
        for k, odd in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9), (3, 0x27D4EB2F165667C5)):
            key += x[k : len(x) - 3 + k] * np.uint64(odd)
        key += np.uint64(view)
    return (mixed(key) & np.uint64(CELLS - 1)).astype(np.int64)


def _pairs(cps: np.ndarray) -> np.ndarray:
    """The model cell of the pair that begins each 4-gram; 0 where it isn't one of ideographs."""
    han = (cps >= 0x3400) & (cps <= 0x9FFF)
    out = np.zeros(max(0, len(cps) - 3), np.int64)
    at_ = np.flatnonzero(han[: len(out)] & han[1 : len(out) + 1])
    with np.errstate(over="ignore"):
        key = cps[at_].astype(np.uint64) * np.uint64(0x1F123BB5) + cps[at_ + 1].astype(np.uint64) * np.uint64(0x9E3779B1) * np.uint64(5)
    out[at_] = np.maximum(1, (mixed(key) & np.uint64(CELLS - 1)).astype(np.int64))
    return out


def masked(rows: list[str]) -> list[str]:
    """Numbers and names that hold digits as ``0``."""
    return _NUMBERED.sub("0", "\n".join(rows)).split("\n") if rows else rows


def _signed(rows: list[str]) -> list[int]:
    """The sentences that hold a sign every placeholder has."""
    find = _SIGN.search
    return [i for i, r in enumerate(rows) if find(r)]


def _flat(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sentences with their marks as code points; offsets of the grams of each."""
    text = "".join([chr(START) + r + chr(END) + "\n\n" for r in rows])  # two more, so that each sentence has a gram per character
    cps = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    offs = np.concatenate([[0], np.cumsum([len(r) + 4 for r in rows])]).astype(np.int64)
    return cps, offs


def _grams(cps: np.ndarray, offs: np.ndarray, view: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the grams that lie within a sentence and its marks, and the sentences' offsets; view 2 has the pairs."""
    cells = _pairs(cps) if view == 2 else _cells(cps, view)
    size = np.diff(offs)
    inside = np.ones(len(cps), bool)
    for k in (1, 2, 3, 4):  # grams that would reach past the end mark
        inside[offs[1:] - k - 1 if k < 4 else offs[1:] - 1] = False
    short = size - 4 < 2
    if short.any():
        inside[offs[:-1][short]] = True
    keep = inside[: len(cells)]
    return cells[keep], np.concatenate([[0], np.cumsum(inside)])[offs]


def _frequencies(rows: list[str], view: int, odd: str = "") -> np.ndarray:
    """The part of all grams in each cell; with ``odd``, of those that hold one of its signs or ``__``."""
    c, o = la.fold(*at.from_strings(rows))
    text = at.text_of(c)
    cps, offs = _flat(masked([text[a:b] for a, b in zip(o.tolist(), o[1:].tolist())]))
    cells, o = _grams(cps, offs, view)
    if odd:
        sign = np.isin(cps, [ord(x) for x in odd])
        sign[:-1] |= (cps[:-1] == ord("_")) & (cps[1:] == ord("_"))
        first = np.concatenate([offs[i] + np.arange(n) for i, n in enumerate(np.diff(o))])
        cells = cells[np.logical_or.reduce([sign[first + k] for k in range(GRAM)])]
    c = np.bincount(cells[cells > 0] if view == 2 else cells, minlength=CELLS).astype(np.float64)
    return c / max(1.0, c.sum())


@lru_cache(1)
def fitted() -> dict[str, tuple[int, np.ndarray]]:
    """The view of each model and its gram frequencies."""
    sets = phrases.notices() | phrases.fillers()
    out = {name: (0, _frequencies(rows, 0)) for name, rows in sets.items()}
    out |= {f"{name}2": (2, _frequencies(sets[name], 2)) for name in PAIRED}
    around = [("", ""), (" ", " for the"), (" ", " before a"), (" ", " / "), ("：", "，"), (" ", " 与 "), (" ", "。"), ("", ": "), (" ", " 的"), (" ", " values"), ("：", ""), ("- ", ""), ("- ", " 0"), ("", " 0")]
    named = [r.replace("WORD", w.upper()).replace("word", w) for r in phrases.SHAPES for w in ("rate", "index", "journal")]
    shapes = [a + r + b for r in named for a, b in (("", ""), ("a ", " a"), ("字", "字"), ("字 ", " 字"))]
    out["shape"] = (1, _frequencies(shapes, 1, "{}$#<>%@[]"))
    for name, rows in phrases.placeholders().items():
        out[name] = (0, _frequencies([a + r + b for r in rows for a, b in around], 0, "【】<>()[]x请在此输入填写待定补充选择"))
    return out


@lru_cache(1)
def _plain() -> list[np.ndarray]:
    """Gram frequencies of plain prose and of plain signs, by view."""
    prose = phrases.PLAIN.strip().split("\n")
    return [_frequencies(prose, 0), _frequencies(phrases.PLAIN_SIGNS, 1), _frequencies(prose, 2)]


def ratios(natural: tuple[np.ndarray, np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
    """Log-likelihood ratio of each kind against natural prose, by cell, in units of 1 / STEP; unseen grams count slightly against residue."""
    out = {}
    for kind, (view, p) in fitted().items():
        n = natural[view].astype(np.float64)
        total = natural[0 if view == 1 else view].sum()  # shapes are counted only where there is a sign
        q = np.maximum((n + 0.5) / (total + 0.5 * CELLS), PLAIN_SHARE * _plain()[view])
        floor = 2e-6
        r = np.clip(np.log((p + floor) / (q + floor)), -4.0, 6.0)
        r[p == 0] = np.minimum(r[p == 0], UNKNOWN)  # at every size of the corpus
        if view == 2:
            r = np.clip(r, -2.0, 3.0) * 0.7
            r[0] = -4.0  # no pair
        out[kind] = np.rint(r * STEP).astype(np.int8)
    out["phrase"] = np.maximum(out.pop("phrase_zh"), out.pop("phrase_en"))
    out["whole"] = np.maximum.reduce([out[name] for _, names in WHOLE for name in names])  # no less than any of them
    out["whole2"] = np.maximum.reduce([out[f"{name}2"] for name in PAIRED])
    return out


def _prose(col: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All sentences of a batch with numbers masked, the row of each, and their lengths."""
    c, o = la.fold(*at.codepoints(col))
    text, o = at.text_of(c), o.tolist()
    rows, owner = sentences([text[a:b] for a, b in zip(o, o[1:])])
    size = np.array([len(r) for r in rows], np.int64)
    return masked(rows), np.array(owner, np.int64), size


def prose(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """``id, sentences, sizes``: the sentences of all columns of each row, in the form that is judged, and their lengths as written."""

    def run(batches):
        for b in batches:
            lists, sizes = [[] for _ in range(b.num_rows)], [[] for _ in range(b.num_rows)]
            for col in b.columns[1:]:
                rows, owner, size = _prose(col)
                for r, i, n in zip(rows, owner.tolist(), size.tolist()):
                    lists[i].append(r)
                    sizes[i].append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.list_(pa.string())), pa.array(sizes, pa.list_(pa.int32()))], names=["id", "sentences", "sizes"])

    src = df.select(F.col(id_col).cast("long").alias("id"), *[F.col(c).cast("string").alias(f"c{k}") for k, c in enumerate(columns)])
    return src.filter("id is not null").mapInArrow(run, "id long, sentences array<string>, sizes array<int>")


class Limits(NamedTuple):
    """What residue must reach."""

    mean: float = LEAST_RATIO  # mean ratio of a unit, and of a window of SPAN grams in it
    cover: float = LEAST_COVER  # the part of a unit that lies in such windows
    total: float = LEAST_SUM  # the sum of a unit's ratios; less will do where every gram is known, or at a high mean
    high: float = 1.9  # that mean, for units of at least SHORT grams
    higher: float = 2.5  # and for others
    long_mean: float = 0.9  # a lower mean will do where the sum is high
    long_total: float = 50.0
    long_cover: float = 0.7
    placeholder: float = 9.0  # the sum in a placeholder's window
    ending: float = 2.0  # mean ratio of a window that ends a sentence

    def reached(self, x: np.ndarray, mean: float) -> bool:
        """Whether a unit's ratios are high enough in the mean and in sum."""
        total = mean * len(x)
        if mean >= self.mean:
            return total >= self.total or mean >= (self.high if len(x) >= SHORT else self.higher) or len(x) > 2 and x.min() > 0
        return mean >= self.long_mean and total >= self.long_total


class Grams(NamedTuple):
    """The model cells of sentences."""

    rows: list[str]
    raw: np.ndarray
    pair: np.ndarray
    at: np.ndarray  # where each sentence's grams begin

    @staticmethod
    def of(rows: list[str], view: int = 0) -> Grams:
        cps, offs = _flat(rows)
        raw, o = _grams(cps, offs, view)
        return Grams(rows, raw, _grams(cps, offs, 2)[0] if view == 0 else raw, o)

    def ratios(self, name: str, ratio: dict[str, np.ndarray], i: int) -> np.ndarray:
        """The ratios of sentence i; the pair decides where four ideographs are unknown to both sides."""
        a, b = self.at[i], self.at[i + 1]
        x, pair = ratio[name][self.raw[a:b]] / STEP, self.pair[a:b]
        if name in PAIRED:
            unknown = (x <= UNKNOWN) & (x > 2 * UNKNOWN) & (pair > 0)
            x[unknown] = ratio[f"{name}2"][pair[unknown]] / STEP
        return x

    def bound(self, ratio: dict[str, np.ndarray]) -> np.ndarray:
        """No less than the ratio of any kind, by gram, in units of 1 / STEP."""
        return np.maximum(ratio["whole"][self.raw], ratio["whole2"][self.pair])


def natural_counts(texts: DataFrame, limits: Limits = Limits()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram counts of the different sentences of all rows of :func:`prose`, for the three views; at most 3 x CELLS numbers reach the driver.

    A sentence counts once, however often it stands, and not at all where the wordings alone
    make it filler or a notice: frequent residue doesn't become natural.
    """
    nothing = np.zeros(CELLS, np.int64)
    bare = ratios((nothing, nothing, nothing))
    bare = texts.sparkSession.sparkContext.broadcast({k: v for k, v in bare.items() if k not in ("shape", "phrase")})
    limits = limits._replace(mean=limits.mean + BEFORE, long_mean=limits.mean + BEFORE, high=limits.high + BEFORE)

    def run(batches):
        total = np.zeros(3 * CELLS, np.int64)

        def add(rows: list[str]) -> None:
            g = Grams.of(rows)
            kind, score = _whole(g, bare.value, limits)
            _in_parts(g, kind, score, bare.value, limits)
            left = np.repeat(kind == 0, np.diff(g.at))
            shape = Grams.of([rows[i] for i in _signed(rows) if kind[i] == 0], 1)
            for view, cells in ((0, g.raw[left]), (1, shape.raw), (2, g.pair[left])):
                total[view * CELLS : (view + 1) * CELLS] += np.bincount(cells, minlength=CELLS)

        held, size = [], 0
        for b in batches:
            held += b.column(0).to_pylist()
            size += b.nbytes
            if size >= HELD:
                add(held)
                held, size = [], 0
        if held:
            add(held)
        total[2 * CELLS] = 0  # grams without a pair
        at_ = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at_.astype(np.int32)), pa.array(total[at_])], names=["cell", "n"])

    different = texts.select(F.explode("sentences").alias("sentence")).distinct()
    sums = different.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    t = sums.toArrow()
    out = np.zeros(3 * CELLS, np.int64)
    out[t["cell"].to_numpy()] = t["n"].to_numpy()
    return out[:CELLS], out[CELLS : 2 * CELLS], out[2 * CELLS :]


@lru_cache(1)
def _words() -> frozenset[str]:
    """The wordings that are a single Latin word, or no longer than two signs."""
    every = (r.strip(_CLOSING).lower() for rows in (phrases.notices() | phrases.fillers()).values() for r in rows)
    return frozenset(r for r in every if len(r) < 3 or " " not in r and r.isascii())


def _term(row: str) -> bool:
    """Whether a unit has no letters, or is a single Latin word or up to two signs that aren't a wording by themselves: a heading or a term, however like one it is spelled."""
    word = row.strip(_CLOSING)
    return not any(map(str.isalnum, word)) or (len(word) < 3 or word.isascii() and word.isalpha()) and word.lower() not in _words()


def _cover(x: np.ndarray, least: float) -> float:
    """The part of the grams that lies in windows whose mean ratio is at least ``least``."""
    w = min(SPAN, len(x))
    run = np.concatenate([[0.0], np.cumsum(x)])
    edge = np.zeros(len(x) + 1, np.int64)
    good = np.flatnonzero(run[w:] - run[:-w] >= least * w)
    np.add.at(edge, good, 1)
    np.add.at(edge, good + w, -1)
    return float((np.cumsum(edge)[:-1] > 0).mean())


def _whole(g: Grams, ratio: dict[str, np.ndarray], limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """For each sentence the kind of residue (0 none, 2 filler, 3 notice) that covers it, and the mean ratio."""
    n = np.diff(g.at)
    kind, score = np.zeros(len(n), np.int8), np.zeros(len(n), np.float32)
    most = np.add.reduceat(g.bound(ratio), g.at[:-1], dtype=np.int64)
    for i in np.flatnonzero(most >= (limits.long_mean * STEP - 0.001) * n):
        for k, name in ((k, name) for k, names in WHOLE for name in names):
            x = g.ratios(name, ratio, i)
            mean = x.mean()
            if mean <= score[i] or not limits.reached(x, mean) or _term(g.rows[i]):
                continue
            if _cover(x, limits.mean) >= (limits.cover if mean >= limits.mean else limits.long_cover):
                kind[i], score[i] = k, mean
    return kind, score


def _in_parts(g: Grams, kind: np.ndarray, score: np.ndarray, ratio: dict[str, np.ndarray], limits: Limits) -> None:
    """Marks the sentences, natural as a whole, of which a cell, a field or the end is filler or a notice."""
    rows, units, places = g.rows, {}, []
    for i in np.flatnonzero(kind == 0):
        r = rows[i]
        if "|" in r or ":" in r or "：" in r or "—" in r or " - " in r or " – " in r:
            parts = [u for u in (u.strip(" *_|") for u in _UNIT.split(r)) if u]
            for j, u in enumerate(parts):
                if len(u) > 1 and len(u) <= 80 and len(parts) > 1:
                    places.append((i, j, u, parts))
                    units.setdefault(u, len(units))
    if units:
        k, x = _whole(Grams.of(list(units)), ratio, limits)
        for i, j, u, parts in places:
            q = units[u]
            if k[q] == 0 or kind[i]:
                continue
            if j == 0 and any(len(v) > LONG for v in parts[1:]):  # a term and its explanation
                continue
            if k[q] == 3 and (len(u) < LONG or _SAYS.search(parts[j - 1] if j else "")):
                continue
            kind[i], score[i] = k[q], x[q]
    o, least = g.at, limits.ending
    most = np.concatenate([[0.0], np.cumsum(g.bound(ratio) / STEP - least)])
    gain = most[o[1:]] - np.minimum.reduceat(most[:-1], o[:-1])
    for i in np.flatnonzero((kind == 0) & (gain >= LONG * least - 0.001)):
        for k, name in ((k, name) for k, names in WHOLE for name in names):
            after = np.cumsum((g.ratios(name, ratio, i) - least)[::-1])[::-1]
            first = int(np.argmax(after))
            before, end = rows[i][: max(0, first - 1)], rows[i][max(0, first - 1) :]
            apart = before[-1:].isspace() or end[:1].isspace()
            end = end.strip()
            if after[first] >= LONG * least and before.strip() and apart and len(end) >= LONG and not end[0].islower() and not _SAYS.search(before.strip()):
                kind[i], score[i] = k, after[first] / (len(after) - first) + least
                break


def judge(rows: list[str], ratio: dict[str, np.ndarray], limits: Limits = Limits()) -> tuple[np.ndarray, np.ndarray]:
    """For each sentence the kind of residue (0 none, 1 placeholder, 2 filler, 3 notice) in it and the mean or window ratio."""
    g = Grams.of(rows)
    kind, score = _whole(g, ratio, limits)
    signed = np.array(_signed(rows), np.int64)
    if len(signed):
        raw, shape = (Grams.of([rows[i] for i in signed], view) for view in (0, 1))
        # a placeholder is short: what else its window holds weighs little against it
        windows = np.maximum(np.maximum(ratio["phrase"][raw.raw], ratio["shape"][shape.raw]) / STEP, -0.25)
        run = np.concatenate([[0.0], np.cumsum(windows)])
        ends = np.minimum(np.arange(len(windows)) + WINDOW, np.repeat(raw.at[1:], np.diff(raw.at)))
        best = np.maximum.reduceat(run[ends] - run[:-1], raw.at[:-1])
        hit = best >= limits.placeholder
        kind[signed[hit]], score[signed[hit]] = 1, best[hit]
    _in_parts(g, kind, score, ratio, limits)
    return kind, score


KINDS = ["", "placeholder", "filler", "notice"]


def residue(df: DataFrame, id_col: str, columns: list[str], limits: Limits = Limits(), corpus: DataFrame | None = None) -> DataFrame:
    """One row per record: ``id, placeholder, filler, notice, prose_chars, residue_chars, coverage``.

    The kinds count sentences.  ``columns`` are scored as one text; null and empty texts
    have no prose and no residue.  The natural model comes from ``corpus``, all rows of
    ``df`` by default.  Repeated rows are judged each on their own.
    """
    texts = staged(prose(df, id_col, columns), "sentences")  # read for the model and to be judged
    natural = natural_counts(texts if corpus is None else staged(prose(corpus, id_col, columns), "corpus"), limits)
    model = df.sparkSession.sparkContext.broadcast(ratios(natural))

    def run(batches):
        for b in batches:
            n = b.num_rows
            counts, covered, chars = np.zeros((n, 4), np.int64), np.zeros(n), np.zeros(n)
            size = b.column(2).flatten().to_numpy()
            if len(size):
                owner = np.repeat(np.arange(n), b.column(1).value_lengths().to_numpy())
                different = b.column(1).flatten().dictionary_encode()
                kind = judge(different.dictionary.to_pylist(), model.value, limits)[0][different.indices.to_numpy()]  # a batch's sentence is judged once
                chars += np.bincount(owner, size, minlength=n)
                np.add.at(counts, (owner, kind), 1)
                bad = kind > 0
                covered += np.bincount(owner[bad], size[bad], minlength=n)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(counts[:, k]) for k in (1, 2, 3)], pa.array(chars.astype(np.int64)), pa.array(covered.astype(np.int64))],
                names=["id", "placeholder", "filler", "notice", "prose_chars", "residue_chars"],
            )

    out = texts.mapInArrow(run, "id long, placeholder long, filler long, notice long, prose_chars long, residue_chars long")
    return out.withColumn("coverage", F.when(F.col("prose_chars") > 0, F.round(F.col("residue_chars") / F.col("prose_chars"), 6)).otherwise(F.lit(0.0)))


def excluded(df: DataFrame, id_col: str, columns: list[str], least_coverage: float = 0.0, **how) -> DataFrame:
    """Ids of records whose residue covers more than ``least_coverage`` of their prose: by default, of one unit of it."""
    return residue(df, id_col, columns, **how).filter((F.col("residue_chars") > 0) & (F.col("coverage") > least_coverage)).select("id").distinct()
