"""Held-out test items inside a corpus (problem 6), by generalised suffix automata.

All items, in the consistent form of :mod:`lookalike`, lower-cased and reduced to letters
and digits, go into suffix automata.  A token is a character of that form, as the problem
counts runs in characters.  The corpus streams through them:

* The automaton of the reversed items only tells where nothing can be: it reads a window of
  ``run`` characters backwards, and where it fails the window moves past that place, so
  most characters of a text without leaks are never read.
* Where a window holds, the text is read forwards through the other automaton, which tracks
  the longest match that ends at each character.  All results come from these matches.

The items are cut into blocks of bounded size, two automata each; several blocks are
searched in one pass over the corpus.
"""

from __future__ import annotations

import hashlib
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at
from . import lookalike as la

#: Characters of one block's automata, and blocks of one pass over the corpus.
BLOCK_CHARS = 200_000
PASS_BLOCKS = 2
GRAM = 8


class Automaton:
    """A suffix automaton of several strings.

    A state with one transition holds it in two flat arrays, others have a dictionary.  The
    places where a state's strings end, in which string and where, are a slice of two
    arrays in the order of the tree of suffix links.
    """

    def __init__(self, strings: list[str]):
        self._grow: list[dict[str, int]] = [{}]
        self.link, self.size = array("i", [-1]), array("i", [0])
        ends: list[tuple[int, int, int]] = []  # state, string, characters read
        for i, s in enumerate(strings):
            state = 0
            for n, c in enumerate(s):
                state = self._extend(state, c)
                ends.append((state, i, n + 1))
        self._place(ends)
        self.sign = [next(iter(e)) if len(e) == 1 else "" for e in self._grow]
        self.goal = array("i", [next(iter(e.values())) if len(e) == 1 else -1 for e in self._grow])
        self.many = {k: e for k, e in enumerate(self._grow) if len(e) != 1}
        del self._grow

    def _new(self, size: int, link: int, edges: dict[str, int]) -> int:
        self._grow.append(edges), self.size.append(size), self.link.append(link)
        return len(self.size) - 1

    def _split(self, p: int, q: int, c: str) -> int:
        """State q's strings no longer than those reached from p by c, as a state of their own."""
        if self.size[q] == self.size[p] + 1:
            return q
        copy = self._new(self.size[p] + 1, self.link[q], dict(self._grow[q]))
        self.link[q] = copy
        while p >= 0 and self._grow[p].get(c) == q:
            self._grow[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: str) -> int:
        q = self._grow[last].get(c)
        if q is not None:  # an earlier string already led here
            return self._split(last, q, c)
        new, p = self._new(self.size[last] + 1, 0, {}), last
        while p >= 0 and c not in self._grow[p]:
            self._grow[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self._grow[p][c], c)
        return new

    def _place(self, ends: list[tuple[int, int, int]]) -> None:
        n = len(self.size)
        order = sorted(range(1, n), key=self.size.__getitem__)
        count = array("i", bytes(4 * n))
        for state, _, _ in ends:
            count[state] += 1
        own = array("i", count)
        for state in reversed(order):
            count[self.link[state]] += count[state]
        self.first, self.count, free = array("i", bytes(4 * n)), count, array("i", bytes(4 * n))
        free[0] = own[0]
        for state in order:  # a state's own ends come first, those of the states below it after them
            up = self.link[state]
            self.first[state] = free[up]
            free[up] += count[state]
            free[state] = self.first[state] + own[state]
        self.string, self.end = np.zeros(len(ends), np.int32), np.zeros(len(ends), np.int32)
        fill = array("i", self.first)
        for state, string, end in ends:
            self.string[fill[state]], self.end[fill[state]] = string, end
            fill[state] += 1

    def step(self, state: int, c: str) -> int:
        """The state after one more character, -1 if there is none."""
        if self.sign[state] == c:
            return self.goal[state]
        edges = self.many.get(state)
        return edges.get(c, -1) if edges else -1

    def holders(self, state: int) -> list[int]:
        """The strings that hold the strings of a state."""
        a = self.first[state]
        return np.unique(self.string[a : a + self.count[state]]).tolist()

    def ends(self, state: int, string: int) -> list[int]:
        """Where in one string the strings of a state end."""
        a = self.first[state]
        part = slice(a, a + self.count[state])
        return self.end[part][self.string[part] == string].tolist()


_built: dict[str, tuple[Automaton, Automaton, set[str]]] = {}


def automata(strings: list[str]) -> tuple[Automaton, Automaton, set[str]]:
    """The automata of the strings and of the reversed ones, and the strings of ``GRAM`` characters they hold, built once per worker."""
    name = hashlib.sha256("\0".join(strings).encode()).hexdigest()
    if name not in _built:
        if len(_built) > PASS_BLOCKS:
            _built.clear()
        _built[name] = Automaton(strings), Automaton([s[::-1] for s in strings]), {s[i : i + GRAM] for s in strings for i in range(len(s) - GRAM + 1)}
    return _built[name]


def touches(text: str, back: Automaton, grams: set[str], run: int) -> bool:
    """Whether some string shares ``run`` characters with the text; ``back`` is of the reversed strings.

    Most windows without a match end with a string that isn't among ``grams``.
    """
    at_, n, gram = 0, len(text), min(GRAM, run)
    sign, goal, many, none = back.sign, back.goal, back.many, {}
    while at_ + run <= n:
        j = at_ + run
        if gram == GRAM and text[j - gram : j] not in grams:
            at_ = j - gram + 1
            continue
        state = 0
        while j > at_ and state >= 0:
            j -= 1
            c = text[j]
            state = goal[state] if sign[state] == c else many.get(state, none).get(c, -1)
        if state >= 0:
            return True
        at_ = j + 1
    return False


def matches(text: str, forward: Automaton, run: int) -> dict[int, list[tuple[int, int, int]]]:
    """Per string the maximal places ``(start, end, state)`` of the text that it matches over at least ``run`` characters."""
    link, sizes, sign, goal, many, none = forward.link, forward.size, forward.sign, forward.goal, forward.many, {}
    out: dict[int, list[tuple[int, int, int]]] = {}
    held: dict[int, list[int]] = {}
    state = size = 0
    for i, c in enumerate(text):
        after = goal[state] if sign[state] == c else many.get(state, none).get(c, -1)
        while after < 0 and state:
            state = link[state]
            size = sizes[state]
            after = goal[state] if sign[state] == c else many.get(state, none).get(c, -1)
        state, size = (after, size + 1) if after >= 0 else (0, 0)
        s, length, seen = state, size, set()
        while s > 0 and length >= run:
            if s not in held:
                held[s] = forward.holders(s)
            for k in held[s]:
                if k in seen:
                    continue
                seen.add(k)
                spans = out.setdefault(k, [])
                if spans and spans[-1][0] == i + 1 - length:
                    spans.pop()
                spans.append((i + 1 - length, i + 1, s))
            s = link[s]
            length = sizes[s]
    return out


def covered(spans: list[tuple[int, int, int]], string: int, forward: Automaton) -> int:
    """How many characters of a string lie in its matches, wherever in it these stand."""
    total = reach = 0
    for a, b in sorted((e - (b - a), e) for a, b, state in spans for e in forward.ends(state, string)):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


def _compared(col: pa.Array) -> list[str]:
    c, o = la.letters_and_digits(*la.fold(*at.codepoints(col)))
    s, o = at.text_of(c), o.tolist()
    return [s[a:b] for a, b in zip(o, o[1:])]


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int = BLOCK_CHARS) -> list[list[tuple[int, str]]]:
    """Items in their compared form, in blocks, made on the driver: test items are the fixed side, which doesn't grow with the corpus."""
    rows = items.select(F.col(id_col).cast("long"), F.col(text_col)).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    out: list[list[tuple[int, str]]] = [[]]
    size = 0
    for item, text in sorted({(r[0], r[1]) for r in rows.toLocalIterator()}):
        form = _compared(pa.array([text]))[0]
        if size and size + len(form) > block_chars:
            out.append([])
            size = 0
        out[-1].append((item, form))
        size += len(form)
    return out


def _found(blocks: list[list[tuple[int, str]]], run_length: int):
    """A function from a text in the compared form to its matches: item, its length, how much of it is covered, and the places in the text."""
    built = [([i for i, _ in block], [s for _, s in block], *automata([s for _, s in block])) for block in blocks]

    def find(text: str):
        for ids, strings, forward, back, grams in built:
            if touches(text, back, grams, run_length):
                for k, spans in matches(text, forward, run_length).items():
                    yield ids[k], len(strings[k]), covered(spans, k, forward), [(x, y) for x, y, _ in spans]

    return find


def _scan(blocks: list[list[tuple[int, str]]], run_length: int):
    """All matches of each document: ``doc_id, item_id, a, b, covered, item_chars``, the last two the same for all of a pair."""

    def run(batches):
        find = _found(blocks, run_length)
        for b in batches:
            docs = b.column(0).to_pylist()
            rows = [(doc, item, x, y, part, n) for doc, text in zip(docs, _compared(b.column(1))) for item, n, part, spans in find(text) for x, y in spans]
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "a", "b", "covered", "item_chars"])

    return run


_ROWS = "doc_id long, item_id long, a int, b int, covered int, item_chars int"


def _search(docs: DataFrame, items: DataFrame, run_length: int, doc_id: str, doc_text: str, item_id: str, item_text: str, block_chars: int) -> DataFrame:
    src = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(doc_text).alias("text")).filter("doc is not null and text is not null")
    blocks = item_blocks(items, item_id, item_text, block_chars)
    out = None
    for a in range(0, len(blocks), PASS_BLOCKS):
        part = src.mapInArrow(_scan(blocks[a : a + PASS_BLOCKS], run_length), _ROWS)
        out = part if out is None else out.unionByName(part)
    return out


def leaked_items(
    docs: DataFrame, items: DataFrame, run_length: int = 40, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id",
    item_text: str = "text", block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``doc_id, item_id``: documents and the items with which they share a run of ``run_length`` letters and digits.

    Null ids and texts are out, items shorter than ``run_length`` never match, repeated
    rows count once, an empty table gives no rows.
    """
    return _search(docs, items, run_length, doc_id, doc_text, item_id, item_text, block_chars).select("doc_id", "item_id").distinct()


def leak_report(
    docs: DataFrame, items: DataFrame, run_length: int = 40, max_length: int = 60, max_coverage: float = 0.5, doc_id: str = "doc_id",
    doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per document and leaked item: longest run, part of the item that is covered, and whether a limit is exceeded.

    Lengths count letters and digits of the compared form; the part is that of all runs
    together.  Where rows repeat a document's id, the one that covers most counts.
    """
    spans = _search(docs, items, run_length, doc_id, doc_text, item_id, item_text, block_chars)
    out = spans.groupBy("doc_id", "item_id").agg(
        F.max(F.col("b") - F.col("a")).cast("long").alias("longest_run"), F.max(F.col("covered") / F.col("item_chars")).alias("part"), F.count_distinct("a").alias("runs")
    )
    covered = F.round("part", 6)
    return out.select(
        "doc_id", "item_id", "longest_run", "runs", covered.alias("item_coverage"),
        ((F.col("longest_run") > max_length) | (covered > max_coverage)).alias("exceeds"),
    )


def _origins(text: str) -> np.ndarray:
    """For each character of the compared form the place in ``text`` it came from."""
    c, origin = la.fold_with_origins(at.from_strings([text])[0])
    return origin[la.is_letter_or_digit(c)]


def _joins(c: str) -> bool:
    """Whether a character is drawn with the one before: a mark, or a conjoining vowel or final."""
    return unicodedata.category(c)[0] == "M" or "\u1160" <= c <= "\u11ff"


def without_leaks(
    docs: DataFrame, items: DataFrame, run_length: int = 40, max_length: int = 60, max_coverage: float = 0.5, doc_id: str = "doc_id",
    doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``doc_id, text, removed_chars``: every document, without the spans that exceed a limit.

    A span goes if it is longer than ``max_length``, or if the document's spans of its item
    cover more than ``max_coverage`` of that.  Documents without such spans keep their text,
    nulls stay null, rows without an id are searched like others.  Texts aren't shuffled: each
    pass adds its spans to the row.
    """
    blocks = item_blocks(items, item_id, item_text, block_chars)
    passes = [blocks[a : a + PASS_BLOCKS] for a in range(0, len(blocks), PASS_BLOCKS)]

    def marking(part):
        def run(batches):
            find = _found(part, run_length)
            for b in batches:
                cuts = b.column(2).to_pylist()
                for i, text in enumerate(_compared(b.column(1))):
                    for _, n, share, spans in find(text):
                        cuts[i].extend(z for x, y in spans if y - x > max_length or share > max_coverage * n for z in (x, y))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cuts, pa.list_(pa.int32()))], names=["doc_id", "text", "cuts"])

        return run

    def removing(batches):
        for b in batches:
            texts, gone = [], []
            for text, cuts in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if text is None or not cuts:
                    texts.append(text), gone.append(0)
                    continue
                where, drop = _origins(text), np.zeros(len(text), bool)
                for x, y in zip(cuts[::2], cuts[1::2]):
                    end = where[y - 1] + 1
                    follower = where[y] if y < len(where) else len(text)
                    while end < follower and _joins(text[end]):  # composed with the last one
                        end += 1
                    drop[where[x] : end] = True
                texts.append("".join(c for c, d in zip(text, drop.tolist()) if not d)), gone.append(int(drop.sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(gone, pa.int64())], names=["doc_id", "text", "removed_chars"])

    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).cast("string").alias("text"), F.array().cast("array<int>").alias("cuts"))
    for part in passes:
        out = out.mapInArrow(marking(part), "doc_id long, text string, cuts array<int>")
    return out.mapInArrow(removing, "doc_id long, text string, removed_chars long")
