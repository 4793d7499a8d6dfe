"""What DuckDB's SQL can say of the training-data queries, by plain definitions over whole tables."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from ..plans import catalog
from . import lookalike as la


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@lru_cache(1)
def _signs() -> tuple[str, str, list[tuple[str, str]]]:
    """What :func:`lookalike._folded` changes beyond decomposition: single signs and theirs, the ones that vanish last; and signs with a longer form."""
    one, gone, more = [], [], []
    for o in range(1, la.TOP):
        if 0x3400 <= o <= 0x9FFF or 0xD800 <= o <= 0xF8FF or 0x20000 <= o < 0x2F800:
            continue
        c = chr(o)
        x = la._folded(c)
        if c in "\r" or x == unicodedata.normalize("NFD", c):
            continue
        (gone if not x else one if len(unicodedata.normalize("NFC", x)) == 1 else more).append((c, unicodedata.normalize("NFC", x)))
    return "".join(a for a, _ in one) + "".join(a for a, _ in gone), "".join(b for _, b in one), more


def form(x: str) -> str:
    """The consistent form of a text: line ends, longer forms, single signs, tags, then composition."""
    signs, theirs, more = _signs()
    x = f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')"
    for a, b in more:
        x = f"replace({x}, {_quoted(a)}, {_quoted(b)})"
    return f"nfc_normalize(regexp_replace(translate({x}, {_quoted(signs)}, {_quoted(theirs)}), '[\\x{{E0000}}-\\x{{E0FFF}}]', '', 'g'))"


def _looks() -> str:
    return f"""v as (select 'title' as field, row_id, title as stored from ingest where title is not null union all select 'body', row_id, body from ingest where body is not null),
  looks as materialized (select field, row_id, stored, {form('stored')} as form from v)"""


def _near() -> str:
    return f"""f as materialized (select row_id, regexp_replace({form('body')}, '[ \\n]', '', 'g') as form from ingest where body is not null),
  cls as materialized (select form, min(row_id) as rep from f where length(form) >= 300 group by 1),
  g as materialized (select distinct rep, substring(form, i::int, 8) as gram from (select rep, form, unnest(range(1, length(form) - 6)) as i from cls)),
  n as (select rep, count(*) as n from g group by 1),
  both_ as (select x.rep as a, y.rep as b, count(*) as c from g x join g y on x.gram = y.gram and x.rep < y.rep group by 1, 2),
  pr as materialized (select a, b from both_ join n p on p.rep = a join n q on q.rep = b where c >= 0.7 * (p.n + q.n - c))"""


def _compared(x: str) -> str:
    return f"regexp_replace(lower({form(x)}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def _leaks() -> str:
    return f"""dt as (select doc_id, {_compared('text')} as t from documents where text is not null), it as (select item_id, {_compared('text')} as t from eval_items where text is not null),
  dg as (select doc_id, i, substring(t, i::int, 40) as g from (select doc_id, t, unnest(range(1, length(t) - 38)) as i from dt where length(t) >= 40)),
  ig as materialized (select item_id, n, i, substring(t, i::int, 40) as g from (select item_id, t, length(t) as n, unnest(range(1, length(t) - 38)) as i from it where length(t) >= 40)),
  hit as materialized (select doc_id, item_id, n, dg.i as d, ig.i as e from dg join ig using (g))"""


_SHARED = """w as materialized (select doc_id, i, md5(substring(text, i::int, 200)) as h from (select doc_id, text, unnest(range(1, length(text) - 198)) as i from documents where length(text) >= 200)),
  several as (select h from w group by h having min(doc_id) < max(doc_id)),
  s as (select distinct doc_id, i from w join several using (h)),
  k as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 200 then 0 else 1 end as fresh from s),
  r as (select doc_id, i, sum(fresh) over (partition by doc_id order by i rows unbounded preceding) as run from k),
  spans as (select doc_id, (min(i) - 1)::int as span_start, (max(i) + 199)::int as span_end from r group by doc_id, run)"""


def texts() -> dict[str, str]:
    return {
        "p1_found": f"with recursive {catalog.SECTIONS} select row_id, section_no from sections where length('文档标题：' || title || chr(10) || '章节标题：' || section || chr(10) || chr(10) || content) > 510",
        "p4_found": f"with {_looks()} select distinct field, least(a.row_id, b.row_id) as row_a, greatest(a.row_id, b.row_id) as row_b from looks a join looks b using (field, form) where a.stored < b.stored and a.row_id <> b.row_id",
        "p4_classes": f"""with {_looks()}, u as (select distinct field, row_id, stored, form from looks), c as (select field, form, count(distinct stored) as stored_forms, count(*) as class_rows from u group by 1, 2)
  select field, row_id, md5(form) as class_id, stored_forms, class_rows from u join c using (field, form)""",
        "p5_found": f"""with {_near()} select distinct least(x.row_id, y.row_id) as row_a, greatest(x.row_id, y.row_id) as row_b from (select a, b from pr union all select rep, rep from cls) p
  join cls c on c.rep = p.a join cls d on d.rep = p.b join f x on x.form = c.form join f y on y.form = d.form where x.row_id <> y.row_id""",
        "p5_groups": f"""with recursive {_near()}, e as (select a, b from pr union all select b, a from pr), reach as (select rep, rep as r from cls union select reach.rep, e.b from reach join e on e.a = reach.r),
  o as (select i.row_id, c.rep, coalesce(min(reach.r), i.row_id) as group_id from (select distinct row_id from ingest) i left join f using (row_id) left join cls c on c.form = f.form left join reach on reach.rep = c.rep group by 1, 2)
  select row_id, group_id, count(*) over (partition by group_id) as group_size, (select count(*) from e where e.a = o.rep) as links from o""",
        "p6_found": f"with {_leaks()} select distinct doc_id, item_id from hit",
        "p6_leak_report": f"""with {_leaks()}, k as (select *, d - e as diagonal, d - row_number() over (partition by doc_id, item_id, d - e order by d) as run from hit),
  iv as (select doc_id, item_id, n, min(d) as a, max(d) + 40 as b, min(e) as x, max(e) + 40 as y from k group by doc_id, item_id, n, diagonal, run),
  top as (select * from iv i where not exists (select 1 from iv j where j.doc_id = i.doc_id and j.item_id = i.item_id and j.a <= i.a and j.b >= i.b and (j.a, j.b) <> (i.a, i.b))),
  c as (select distinct doc_id, item_id, n, unnest(range(x, y)) as place from top), p as (select doc_id, item_id, count(*) / max(n) as part from c group by 1, 2),
  l as (select doc_id, item_id, max(b - a) as longest_run, count(distinct a) as runs from top group by 1, 2)
  select doc_id, item_id, longest_run, runs, round(part, 6) as item_coverage, longest_run > 60 or round(part, 6) > 0.5 as exceeds from l join p using (doc_id, item_id)""",
        "p8_found": f"with {_SHARED} select doc_id, span_start, span_end from spans",
        "p8_shared_parts": f"""with {_SHARED}, c as (select doc_id, count(*) as runs, sum(span_end - span_start)::bigint as shared_chars from spans group by 1), d as (select doc_id, max(coalesce(length(text), 0))::bigint as n_chars from documents group by 1)
  select doc_id, n_chars, coalesce(runs, 0) as runs, coalesce(shared_chars, 0)::bigint as shared_chars, round(case when n_chars > 0 then coalesce(shared_chars, 0) / n_chars else 0.0 end, 6) as shared_part from d left join c using (doc_id)""",
    }
