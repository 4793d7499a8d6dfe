"""Text functions as Spark columns.

Java's and Python's notions of white space and lines differ; the patterns here follow
the wider ones: every Unicode space and the separators U+001C to U+001F.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LINE_END = r"\r\n|[\n\x0B\f\r\x1c-\x1e\x{0085}\x{2028}\x{2029}]"
# Characters that end a sentence, kept with it.
SENTENCE_END = "。！？；.!?;"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+\\z", "")


def blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(F.length(strip(c)) == 0, F.lit(True))


def strip_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"^\n+|\n+\z", "")


def lines(c: Column) -> Column:
    """The lines of a text; a line end at the very end begins no further line, an empty text has no line."""
    parts = F.split(F.regexp_replace(c, f"(?:{LINE_END})\\z", ""), LINE_END, -1)
    return F.when(F.length(c) > 0, parts).otherwise(F.when(c.isNotNull(), F.array().cast("array<string>")))


def decoded(content: Column) -> Column:
    """UTF-8 bytes as text, without a byte-order mark and with ``\\n`` as the only line end."""
    text = F.regexp_replace(F.decode(content, "UTF-8"), "^\\x{FEFF}", "")
    return F.regexp_replace(text, r"\r\n?", "\n")


def sentences(c: Column) -> Column:
    """Cut after every sentence mark; the marks stay, blank pieces go."""
    return F.filter(F.transform(F.split(c, f"(?<=[{SENTENCE_END}])", -1), strip), lambda s: s != "")


def url_part(c: Column, part: str) -> Column:
    """A part of an address by pattern; null where it is missing. Bad addresses give nulls, never errors."""
    patterns = {
        "scheme": r"^([A-Za-z][A-Za-z0-9+.-]*)://",
        "authority": r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)",
        "path": r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)",
        "query": r"^[^?#]*(\?[^#]*)",
    }
    return F.regexp_extract(strip(c), patterns[part], 1)


def url_ok(c: Column) -> Column:
    """A complete http or https address with a host and no credentials."""
    scheme, authority = F.lower(url_part(c, "scheme")), url_part(c, "authority")
    host = F.regexp_replace(authority, r":\d*$", "")
    return F.coalesce(scheme.isin("http", "https") & (F.length(host) > 0) & ~authority.contains("@"), F.lit(False))


def url_normal(c: Column) -> Column:
    """Scheme and authority in lower case, no fragment, at least ``/`` as path; null for bad addresses."""
    path, query = url_part(c, "path"), url_part(c, "query")
    query = F.when(query == "?", "").otherwise(query)
    whole = F.concat(F.lower(url_part(c, "scheme")), F.lit("://"), F.lower(url_part(c, "authority")), F.when(path == "", "/").otherwise(path), query)
    return F.when(url_ok(c), whole)


def technology_id(url: Column) -> Column:
    """The id of a technology document that has none of its own."""
    return F.concat(F.lit("technology-"), F.sha2(url_normal(url), 256))


def squeeze(c: Column) -> Column:
    """Three and more line feeds become two."""
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


_FORBIDDEN = r'[\\/:*?"<>|\r\n\t]'


def filename_spaced(c: Column) -> Column:
    """A file name that keeps spaces: forbidden signs become ``-``, outer blanks and dashes go."""
    x = F.regexp_replace(F.regexp_replace(c, _FORBIDDEN, "-"), r"\s+", " ")
    return F.regexp_replace(x, r"^[- ]+|[- ]+\z", "")


def filename_dashed(c: Column) -> Column:
    """A file name without spaces: forbidden signs and blanks become ``-``, outer dashes go."""
    x = F.regexp_replace(F.regexp_replace(c, _FORBIDDEN, "-"), r"\s+", "-")
    return F.regexp_replace(x, r"^-+|-+\z", "")


def ordinal(c: Column, width: int = 2) -> Column:
    """A number padded with zeros, never cut."""
    s = c.cast("string")
    return F.lpad(s, F.greatest(F.lit(width), F.length(s)), F.lit("0"))


def slug(url: Column) -> Column:
    """The last part of an address's path without ``.html``."""
    return F.replace(F.element_at(F.split(url, "/"), -1), F.lit(".html"), F.lit(""))


def finite(c: Column) -> Column:
    """Not null, NaN or infinite."""
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))


def char_tokens(c: Column, specials: int = 2) -> Column:
    """The default token count: characters plus special tokens."""
    return F.length(c) + F.lit(specials)


def chunk_text(title: Column, section: Column, content: Column) -> Column:
    return F.concat(F.lit("文档标题："), title, F.lit("\n章节标题："), section, F.lit("\n\n"), content)


def front_matter(pairs: dict[str, Column], body: Column) -> Column:
    """A Markdown file with quoted scalar front matter; null values are left out."""
    rows = [F.when(v.isNotNull(), F.concat(F.lit(f'{k}: "'), F.regexp_replace(F.regexp_replace(v, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"\n'))).otherwise("") for k, v in pairs.items()]
    return F.concat(F.lit("---\n"), *rows, F.lit("---\n\n"), body)


def sorted_json(c: Column, indent: bool = False) -> Column:
    """A map of texts as JSON with its keys in order, signs beyond ASCII as they are; indented by two spaces on request."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))), {"pretty": "true"} if indent else {})


def parsed_json(c: Column, schema: str = "map<string,string>") -> Column:
    """A JSON text as a value of the schema; null where it is broken."""
    return F.from_json(c, schema)


FRONT = r"(?s)\A---\s*\n(.*?)\n---\s*(?:\n|\z)"


def front_split(c: Column) -> tuple[Column, Column]:
    """Front matter and stripped body of a file; both null where it doesn't start with front matter."""
    has = c.rlike(FRONT)
    return F.when(has, F.regexp_extract(c, FRONT, 1)), F.when(has, strip(F.regexp_replace(c, FRONT, "")))


def lexical_tokens(c: Column) -> Column:
    """The distinct words and ideographs of a text, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+|[一-龥])"), 1))


def lexical_score(a: Column, b: Column) -> Column:
    """Shared tokens divided by all tokens of two token arrays; 0 if there are none."""
    both, some = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(some > 0, both / some).otherwise(F.lit(0.0))
