"""Sections above a size limit, cut at natural places with an overlap (problem 1).

Content-defined chunking: within a scope (a section, or what stands under a lower
heading) a rolling hash of the last ``WINDOW`` characters marks landmarks.  From the end of
the piece before, the first landmark beyond the minimum size is taken and moved to the
nearest natural boundary between minimum and maximum size: the end of a block, of a line
or of a sentence.  So the places depend on the text around them, and an edit changes its
own piece and neighbours only.  Without a landmark the last and strongest boundary within
the maximum serves, without a boundary the landmark or the maximum itself.

Headings come first: a section that is too large is cut at its shallowest lower heading,
recursively, and each part is a scope with its own path ``A / B``.  Code blocks and tables
stay whole where they fit; larger ones are cut between lines, tables repeat their header
and code its fences.

A piece begins with the end of the one before: as many whole blocks, lines or sentences as
the overlap holds; where not even one sentence fits, the last clauses, words or characters
of it.  Code and tables are repeated whole or not at all.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sections import HEADING, blocks, formatted, scopes, split_sections
from . import arrowtext as at
from .rolling import gram_hashes

WINDOW = 24
#: Special tokens that the token count of a text includes.
SPECIALS = 2
#: Where a sentence may be entered, best first: after a clause, after a word.
_ENTRIES = (re.compile(r"[，、：,:]\s*"), re.compile(r"\s+"))
_SENTENCE = re.compile(r"[。！？；]+[”’\")）]*\s*|[.!?;]+[”’\")]*(?:\s+|$)")


class Boundaries:
    """Natural boundaries of a scope: offsets with a strength, and the blocks that are too large to stay whole."""

    def __init__(self, text: str, room: int):
        self.text = text
        starts, n = [], 0
        for line in text.splitlines(keepends=True):
            starts.append(n)
            n += len(line)
        starts.append(len(text))
        spots: dict[int, int] = {}
        self.inside: list[tuple[int, int, str, str]] = []  # start, end, what a later piece repeats before and after
        self.prose: list[tuple[int, int]] = []
        for kind, a, b in blocks(text):
            begin, end = starts[a], starts[b]
            spots[begin] = spots[end] = 3
            if kind == "text":
                self.prose.append((begin, end))
                for k in range(a + 1, b):
                    spots.setdefault(starts[k], 2)
                for m in _SENTENCE.finditer(text, begin, end):
                    spots.setdefault(m.end(), 1)
            elif end - begin > room:
                lines = text[begin:end].splitlines()
                before = after = ""
                first = a + 1
                if kind == "table" and len("\n".join(lines[:2])) + 1 <= room // 2:
                    before, first = "\n".join(lines[:2]) + "\n", a + 2
                elif kind == "code" and not lines[0].startswith((" " * 4, "\t")) and 2 * len(lines[0]) <= room // 2:
                    mark = lines[0].strip()[0]
                    before, after = lines[0] + "\n", "\n" + mark * (len(lines[0].strip()) - len(lines[0].strip().lstrip(mark)))
                for k in range(first, b):
                    spots.setdefault(starts[k], 2)
                self.inside.append((starts[min(first, b)], end, before, after))
        self.at = np.array(sorted(spots), np.int64)
        self.strength = np.array([spots[k] for k in sorted(spots)], np.int64)

    def repeated(self, place: int) -> tuple[str, str]:
        """What a piece that begins (ends) at the place, within a large block, repeats before (after) it."""
        for a, b, before, after in self.inside:
            if a <= place < b:
                return before, after
        return "", ""

    def entry(self, place: int, first: int, overlap: int) -> int:
        """Where the piece after ``place`` begins: at most ``overlap`` before it, beyond ``first``."""
        low = max(place - overlap, first + 1)
        i = int(np.searchsorted(self.at, low))
        if i < len(self.at) and self.at[i] < place and self.text[self.at[i] : place].strip() and not self.repeated(int(self.at[i]))[0]:
            return int(self.at[i])
        last = len(self.text[:place].rstrip())
        begin = next((a for a, b in self.prose if a < last <= b), None)
        if begin is None or low >= last or begin > low:
            return place
        for entry in _ENTRIES:
            found = next((m.end() for m in entry.finditer(self.text, low, last) if m.end() < last), None)
            if found is not None:
                return found
        return low


def cut(text: str, room: int, overlap: int) -> list[tuple[int, int]]:
    """``(start, end)`` of the pieces of one scope; all texts with what they repeat are at most ``room`` long."""
    if len(text) <= room:
        return [(0, len(text))]
    marks = Boundaries(text, room)
    codes, _ = at.from_strings([text])
    hashes = gram_hashes(codes, WINDOW)
    every = max(2, room // 8)
    landmarks = np.flatnonzero(hashes % np.uint64(every) == 0) + WINDOW
    out, place = [], 0
    while place < len(text):
        begin = place
        before, _ = marks.repeated(place)
        if out and overlap and not before:
            begin = marks.entry(place, out[-1][0], overlap)
        most = min(room - len(before), len(text) - begin) + begin
        if most >= len(text):
            out.append((begin, len(text)))
            break
        least = min(place + max(1, room // 3), most)
        lo, hi = np.searchsorted(marks.at, [least, most + 1])
        here, power = marks.at[lo:hi], marks.strength[lo:hi]
        k = int(np.searchsorted(landmarks, least))
        mark = int(landmarks[k]) if k < len(landmarks) and landmarks[k] <= most else None
        if len(here):
            if mark is None:
                end = int(here[power == power.max()][-1])
            else:
                # the nearest boundary; a stronger one may be a little further off
                cost = np.abs(here - mark) * np.array([0, 4, 2, 1])[power]
                end = int(here[int(np.argmin(cost))])
        else:
            end = mark if mark is not None else most
        after = marks.repeated(end)[1]
        if after and end - begin + len(before) + len(after) > room:
            fit = marks.at[(marks.at > place) & (marks.at <= begin + room - len(before) - len(after))]
            end = int(fit[-1]) if len(fit) else max(place + 1, begin + room - len(before) - len(after))
        out.append((begin, end))
        place = end
    return out


def pieces(title: str, section: str, content: str, limit: int = 512, overlap_ratio: float = 0.12) -> list[tuple[str, str, int, int]]:
    """``(path, text, start, end)`` of the pieces of a section, with their places in it.

    Where title and path alone leave no room, the scope stays one piece above the limit.
    """
    base = len(formatted(title, "", "")) + SPECIALS

    def free(path: str) -> int:
        return limit - base - len(path)

    out = []
    for path, first, last in scopes(section, content, lambda path, part: len(part) <= free(path)):
        room, text = free(path), content[first:last]
        if room <= 0 or len(text) <= room:
            out.append((path, text, first, last))
            continue
        marks = Boundaries(text, room)
        for a, b in cut(text, room, int(room * overlap_ratio)):
            before = marks.repeated(a)[0]
            inside = next((x for x in marks.inside if x[0] <= b - 1 < x[1] and b < x[1]), None)
            after = inside[3] if inside and (before or a <= inside[0]) else ""
            piece = before + text[a:b].strip("\n") + after
            if piece.strip():
                out.append((path, piece, first + a, first + b))
    return out


def complete(content: str, places: list[tuple[int, int]]) -> bool:
    """Whether pieces at these places hold the whole content but for headings and blank lines."""
    at_ = 0
    for a, b in [*places, (len(content), len(content))]:
        if a > at_ and not all(HEADING.fullmatch(line) for line in content[at_:a].split("\n") if line.strip()):
            return False
        at_ = max(at_, b)
    return True


_SCHEMA = "row_id long, section_no int, chunk_index int, section string, oversized boolean, complete boolean, start int, end int, tokens int, within_limit boolean, piece string"


def split_records(df: DataFrame, id_col: str = "row_id", body_col: str = "body", limit: int = 512, overlap_ratio: float = 0.12) -> DataFrame:
    """All pieces of all records: ``row_id, section_no, chunk_index, section, oversized, complete, start, end, tokens, within_limit, piece``.

    ``section_no`` counts a record's non-empty sections, ``chunk_index`` its pieces, both
    from 0 without gaps; ``oversized`` tells that the piece's section exceeds the limit,
    ``complete`` that its pieces, at ``start`` to ``end`` of it, lose nothing.  Null bodies and
    bodies without a level-1 heading give no rows; repeated rows are split each on their own.
    """
    if not 0 <= overlap_ratio < 0.5:
        raise ValueError("overlap_ratio must be in [0, 0.5)")

    def run(batches):
        for b in batches:
            rows = []
            for row_id, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = split_sections(body)
                if found is None:
                    continue
                title, sections = found
                index = 0
                for no, (section, content) in enumerate(sections):
                    size = len(formatted(title, section, content)) + SPECIALS
                    got = pieces(title, section, content, limit, overlap_ratio)
                    whole = complete(content, [(a, z) for _, _, a, z in got])
                    for path, text, a, z in got:
                        tokens = len(formatted(title, path, text)) + SPECIALS
                        rows.append((row_id, no, index, path, size > limit, whole, a, z, tokens, tokens <= limit, text))
                        index += 1
            cols = list(zip(*rows)) if rows else [[]] * 11
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string()]
            names = ["row_id", "section_no", "chunk_index", "section", "oversized", "complete", "start", "end", "tokens", "within_limit", "piece"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return df.select(F.col(id_col).cast("long"), F.col(body_col).cast("string")).mapInArrow(run, _SCHEMA)


def oversized_sections(df: DataFrame, **how) -> DataFrame:
    """``row_id, section_no`` of the sections that had to be cut, and whose pieces hold all of them."""
    return split_records(df, **how).filter("oversized and complete").select("row_id", "section_no").distinct()
