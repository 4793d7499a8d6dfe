"""HTML pages to text and Markdown.

Flat steps are column expressions.  What needs nesting is done by one parser from the
standard library inside an Arrow function.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements and class parts that hold no content.
NOISE_TAGS = ("script", "style", "nav", "footer", "header", "aside", "button", "svg", "iframe", "form", "noscript")
NOISE_CLASSES = ("breadcrumb", "toc", "sidebar", "pagination", "feedback", "edit-page", "nav", "footer", "anchor-link")


def container(html: Column, body: bool = False) -> Column:
    """The inner HTML of the first ``article``, else ``main``, else with ``body`` the page's; null if there is none."""
    out = [F.regexp_extract(html, rf"(?is)<{t}\b[^>]*>(.*?)</{t}\s*>", 1) for t in ("article", "main", "body")[: 3 if body else 2]]
    return F.coalesce(*[F.when(x != "", x) for x in out])


def page_title(html: Column) -> Column:
    """The text of the first ``h1``; null without one."""
    x = F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1\s*>", 1)
    return F.when(x != "", F.trim(F.regexp_replace(x, "<[^>]*>", "")))


def without_noise(html: Column, tags: tuple[str, ...] = NOISE_TAGS) -> Column:
    """Without comments and flat noise elements."""
    x = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for t in tags:
        x = F.regexp_replace(x, rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>", "")
    return x


def anchors(html: Column) -> Column:
    """``href`` and text of every link, in order."""
    found = F.regexp_extract_all(html, F.lit(r'(?is)(<a\b[^>]*href="[^"]*"[^>]*>.*?</a\s*>)'), 1)
    return F.transform(
        found,
        lambda a: F.struct(
            F.regexp_extract(a, r'(?is)href="([^"]*)"', 1).alias("href"),
            F.trim(F.regexp_replace(F.regexp_extract(a, r"(?is)<a\b[^>]*>(.*?)</a\s*>", 1), "<[^>]*>", "")).alias("label"),
        ),
    )


class _Markdown(HTMLParser):
    """Headings, paragraphs, lists, tables and code as Markdown; links and images give their text only."""

    BLOCKS = {"p", "div", "section", "article", "main", "ul", "ol", "table", "tr", "blockquote", "br", "hr"}
    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[tuple[str, bool]] = []  # element, whether it is noise
        self.noise = self.pre = self.cells = 0
        self.rows = 0
        self.lists: list[list] = []

    def handle_starttag(self, tag, attrs):
        classes = dict(attrs).get("class") or ""
        bad = tag in NOISE_TAGS or any(part in classes for part in NOISE_CLASSES)
        if tag not in self.VOID:
            self.open.append((tag, bad))
            self.noise += bad
        if self.noise or bad:
            return
        if tag[0] == "h" and tag[1:].isdigit():
            self.out.append("\n\n" + "#" * int(tag[1:]) + " ")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("_")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + (f"{kind[1]}. " if kind[0] == "ol" else "* "))
        elif tag == "table":
            self.rows = 0
            self.out.append("\n\n")
        elif tag == "tr":
            self.cells = 0
            self.out.append("\n")
        elif tag in ("td", "th"):
            self.out.append("| " if not self.cells else " | ")
            self.cells += 1
        elif tag in self.BLOCKS:
            self.out.append("\n\n" if tag != "br" else "\n")

    def handle_endtag(self, tag):
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] == tag), None)
        if at is None:
            return
        quiet = self.noise > 0
        self.noise -= sum(bad for _, bad in self.open[at:])
        del self.open[at:]
        if quiet:
            return
        if tag == "pre":
            self.pre -= 1
            self.out.append("\n```\n\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("_")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.out.append("\n")
        elif tag == "tr":
            self.out.append(" |")
            self.rows += 1
            if self.rows == 1:
                self.out.append("\n|" + " --- |" * self.cells)
        elif tag in self.BLOCKS or tag[0] == "h" and tag[1:].isdigit():
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.noise:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def markdown_of(html: str | None, title: str | None = None) -> str | None:
    """A page's content as Markdown that begins with a level-1 heading (the title, where it has none)."""
    if html is None:
        return None
    p = _Markdown()
    p.feed(html)
    p.close()
    text = "".join(p.out).replace("​", "").replace("\r\n", "\n")
    text = "\n".join(without_contents([line.rstrip() for line in text.split("\n")]))
    text = re.sub(r"\n{3,}", "\n\n", text).strip()
    m = re.search(r"^#\s", text, re.M)
    if m:
        return text[m.start() :]
    return f"# {title}\n\n{text}" if title else text


def without_contents(lines: list[str], heading: str = "## 目录") -> list[str]:
    """Lines without a table of contents: its heading and the list items and blank lines under it."""
    out, skipping = [], False
    for line in lines:
        if line.strip() == heading:
            skipping = True
        elif skipping and (not line.strip() or re.match(r"\s*(?:[-*+]|\d+\.)\s", line)):
            continue
        else:
            skipping = False
            out.append(line)
    return out


@F.pandas_udf(T.StringType())
def to_markdown(html: pd.Series, title: pd.Series) -> pd.Series:
    return pd.Series([markdown_of(h, t) for h, t in zip(html, title)], dtype=object)


@F.pandas_udf(T.StringType())
def resolved(base: pd.Series, href: pd.Series) -> pd.Series:
    """A link's address relative to its page."""
    return pd.Series([None if h is None else urljoin(b or "", h) for b, h in zip(base, href)], dtype=object)


@F.pandas_udf(T.StringType())
def description_after(html: pd.Series, href: pd.Series) -> pd.Series:
    """The text of the first paragraph that follows the block of a link, before the next link."""
    out = []
    for page, link in zip(html, href):
        at = (page or "").find(f'href="{link}"')
        rest = (page or "")[at:] if at >= 0 else ""
        rest = rest[rest.find("</a>") + 4 :] if "</a>" in rest else ""
        cut = re.search(r"<a\b", rest)
        m = re.search(r"(?is)<p\b[^>]*>(.*?)</p\s*>", rest[: cut.start()] if cut else rest)
        out.append(re.sub(r"\s+", " ", re.sub("<[^>]*>", "", m[1])).strip() if m else "")
    return pd.Series(out, dtype=object)
