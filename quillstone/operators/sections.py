"""Markdown structure: headings outside code, level-2 sections, blocks.

Plain functions on strings; the operators call them from Arrow functions, a batch at a
time, as the state of a code fence has no bounded look-back.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# The Markdown forms that are recognised, and the name of text outside any section.
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)")
HEADING = re.compile(r" {0,3}(#{1,6})\s+(.+?)\s*#*\s*")
UNTITLED_SECTION = "概述"


class FenceState:
    """Whether a line is inside a code fence; fed line by line."""

    def __init__(self) -> None:
        self.mark = ""

    def code(self, line: str) -> bool:
        """True for lines of a fenced block, its fences included."""
        m = FENCE.fullmatch(line) if line.lstrip(" ")[:1] in ("`", "~") else None
        if not self.mark:
            if m:
                self.mark = m[1]
            return bool(m)
        if m and m[1][0] == self.mark[0] and len(m[1]) >= len(self.mark) and not m[2].strip():
            self.mark = ""
        return True


def outline(lines: list[str]) -> list[tuple[int, int, str]]:
    """``(line, level, name)`` of every heading that isn't in a code fence."""
    fence, out = FenceState(), []
    for i, line in enumerate(lines):
        sign = line.lstrip(" ")[:1]
        if sign not in ("#", "`", "~"):
            continue  # such a line neither is a heading nor changes the fence
        if fence.code(line):
            continue
        if sign == "#" and (m := HEADING.fullmatch(line)):
            out.append((i, len(m[1]), m[2]))
    return out


def split_sections(body: str | None) -> tuple[str, list[tuple[str, str]]] | None:
    """The title (first level-1 heading) and the non-empty level-2 sections; None without a title.

    The title's line is taken out; text before the first level-2 heading belongs to the
    untitled section; deeper headings stay in the content; blank sections are dropped.
    """
    lines = (body or "").splitlines()
    marks = outline(lines)
    top = next((m for m in marks if m[1] == 1), None)
    if top is None:
        return None
    cuts = [(-1, UNTITLED_SECTION)] + [(i, name) for i, level, name in marks if level == 2] + [(len(lines), "")]
    out = []
    for (start, name), (end, _) in zip(cuts, cuts[1:]):
        rows = [lines[k] for k in range(start + 1, end) if k != top[0]]
        content = "\n".join(rows).strip("\n")
        if content.strip():
            out.append((name, content))
    return top[2], out


# The grammar of blocks, over lines joined by "\\n"; fixed are the forms it recognises.
_CODE_LINE = r"(?: {4}|\t)[^\S\n]*\S.*"
_RULE_LINE = r"[^\S\n]*+\|?+[^\S\n]*+:?+-++:?+[^\S\n]*+(?:\|[^\S\n]*+:?+-++:?+[^\S\n]*+)+\|?+[^\S\n]*+"
_BREAKS = r" {4}|\t| {0,3}(?:`{3}|~{3}|[-+*][^\S\n]|\d+[.)][^\S\n])"
_BLOCK = re.compile(
    r"(?P<fence>^ {0,3}(?P<mark>(?P<sign>[`~])(?P=sign){2,}).*(?:\n(?! {0,3}(?P=mark)(?P=sign)*[^\S\n]*$).*)*(?:\n.*)?)"
    rf"|(?P<code>^{_CODE_LINE}(?:(?:\n[^\S\n]*$)*\n{_CODE_LINE})*)"
    rf"|(?P<table>^(?=.*\|).*+\n{_RULE_LINE}$(?:\n(?=.*\|).*+)*)"
    rf"|(?P<text>^.*\S.*(?:\n(?!{_BREAKS}).*\S.*)*)",
    re.M,
)


def blocks(text: str) -> list[tuple[str, int, int]]:
    """``(kind, first line, end line)`` of the code, table and text blocks of a text, by one scan of a grammar.

    A fence goes on to its closing line or the end; indented code may hold blank lines but
    doesn't end with one; a table needs its rule line; a text block ends before a blank
    line, an item, a fence or an indented line.
    """
    joined = "\n".join(text.splitlines())
    out, line, seen = [], 0, 0
    for m in _BLOCK.finditer(joined):
        line += joined.count("\n", seen, m.start())
        end = line + m[0].count("\n") + 1
        out.append(("code" if m.lastgroup == "fence" else m.lastgroup, line, end))
        line, seen = end - 1, m.end()
    return out


def scopes(path: str, text: str, fits) -> list[tuple[str, int, int]]:
    """``(path, start, end)`` of the parts of a section that are cut each on their own.

    A part that ``fits(path, part)`` stays whole, as does one without a heading of level 3
    or deeper; others fall apart at their shallowest headings, whose names lengthen the
    path.  Fences never span a heading, so one outline serves all parts.
    """
    lines = text.split("\n")
    at, starts = 0, []
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    heads = [(starts[i], min(len(text), starts[i] + len(lines[i]) + 1), level, name) for i, level, name in outline(lines) if level >= 3]
    out, todo = [], [(path, 0, len(text), 0, len(heads))]
    while todo:
        name, a, b, i, j = todo.pop()
        part = text[a:b].strip("\n")
        if not part.strip():
            continue
        a += len(text[a:b]) - len(text[a:b].lstrip("\n"))
        if fits(name, part) or i == j:
            out.append((name, a, a + len(part)))
            continue
        top = min(level for _, _, level, _ in heads[i:j])
        cuts = [k for k in range(i, j) if heads[k][2] == top]
        below = [(f"{name} / {heads[k][3]}", heads[k][1], heads[n][0] if n < j else b, k + 1, n) for k, n in zip(cuts, [*cuts[1:], j])]
        todo.extend(reversed([(name, a, heads[cuts[0]][0], i, cuts[0]), *below]))
    return out


def marked_sections(df: DataFrame, id_col: str, text_col: str, pattern: str) -> DataFrame:
    """``id, section_no, first_line, lines, chars``: runs of lines that begin with one of the pattern; those before the first are section 0.

    All within the array of each text's lines, without a shuffle. Null and empty texts have no sections.
    """
    t = df.select(id_col, F.explode(F.array(tx.lines(F.col(text_col)))).alias("ls")).filter(F.size("ls") > 0)  # lines are made once, not in every expression below
    t = t.withColumn("marks", F.array_compact(F.transform("ls", lambda line, i: F.when(line.rlike(pattern), i + 1))))
    t = t.withColumn("edges", F.array_distinct(F.concat(F.array(F.lit(1)), "marks")))
    first = F.when(F.coalesce(F.get("marks", F.lit(0)), F.lit(0)) == 1, 1).otherwise(0)
    e = t.select(id_col, "ls", "edges", first.alias("first"), F.posexplode("edges").alias("k", "first_line"))
    e = e.withColumn("lines", F.coalesce(F.get("edges", F.col("k") + 1), F.size("ls") + 1) - F.col("first_line"))
    chars = F.aggregate(F.slice("ls", F.col("first_line"), F.col("lines")), F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    return e.select(id_col, (F.col("k") + F.col("first")).cast("long").alias("section_no"), "first_line", F.col("lines").cast("long").alias("lines"), chars.alias("chars"))


def block_rows(df: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """``id, block_no, kind, first_line, lines`` of the :func:`blocks` of each text; block_no counts from 0, lines from 1."""

    def run(batches):
        for b in batches:
            rows = [(i, k, kind, a + 1, z - a) for i, text in zip(*(c.to_pylist() for c in b.columns)) for k, (kind, a, z) in enumerate(blocks(text or ""))]
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["id", "block_no", "kind", "first_line", "lines"])

    return df.select(F.col(id_col).cast("long"), F.col(body_col)).mapInArrow(run, "id long, block_no int, kind string, first_line int, lines int")


def formatted(title: str, section: str, content: str) -> str:
    """The text of a chunk."""
    return f"文档标题：{title}\n章节标题：{section}\n\n{content}"
