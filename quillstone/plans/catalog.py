"""Every query of the engine over the project tables, with the SQL that checks it where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import html as hx
from ..functions import text as tx
from ..operators import browse, chunking, ordering, recall, retrieval, sections, vectors
from ..sources import documents as docs
from . import pipeline, preparation
from ..sources import index
from ..sources.staging import shared_folder, staged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.strip()
        return f

    return add


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


# What the SQL texts share.
_WS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_NL = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _blank(x: str) -> str:
    return f"coalesce(length({_strip(x)}) = 0, true)"


_URL_OK = f"""coalesce(lower(regexp_extract({_strip('source_url')}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) in ('http', 'https')
  and length(regexp_replace(regexp_extract({_strip('source_url')}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), ':\\d*$', '')) > 0
  and not contains(regexp_extract({_strip('source_url')}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '@'), false)"""
_URL = f"""case when {_URL_OK} then lower(regexp_extract({_strip('source_url')}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1))
  || case when regexp_extract({_strip('source_url')}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' then '/' else regexp_extract({_strip('source_url')}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) end
  || case when regexp_extract({_strip('source_url')}, '^[^?#]*(\\?[^#]*)', 1) = '?' then '' else regexp_extract({_strip('source_url')}, '^[^?#]*(\\?[^#]*)', 1) end end"""
_TECH = "coalesce(doc_type = 'technology', false)"
_ERRORS = (
    "list_filter(["
    + ", ".join(
        f"case when case when {_TECH} then {_blank(k) if k in docs.TECHNOLOGY_KEYS else 'false'} else {_blank(k) if k in docs.PROJECT_KEYS else 'false'} end then 'missing_{k}' end"
        for k in docs.KNOWN
    )
    + f""", case when {_TECH} and id is not null and {_blank('id')} then 'blank_id' end,
  case when not {_blank('doc_type')} and doc_type not in ('architecture', 'runbook', 'technology') then 'unknown_doc_type' end,
  case when {_TECH} and not {_blank('source_url')} and not {_URL_OK} then 'bad_source_url' end,
  case when list_has_any(coalesce(map_keys(extra), []), ['doc_id', 'chunk_id', 'source', 'title', 'section', 'chunk_index', 'snapshot_id']) then 'reserved_key' end,
  case when len(list_filter(coalesce(map_values(extra_types), []), lambda t: t not in ('str', 'int', 'float', 'bool'))) > 0 then 'odd_value' end,
  case when {_blank('body')} then 'empty_body' end], lambda e: e is not null)"""
)
_VALID = f"""valid as (select *, coalesce(case when not {_blank('id')} then {_strip('id')} end, case when {_TECH} then 'technology-' || sha256({_URL}) end) as doc_id
  from ingest where len({_ERRORS}) = 0)"""
_CUR = "cur as (select * from chunks qualify row_number() over (partition by chunk_id order by indexed_at desc, chunk_row desc) = 1)"
_REQ = f"""req as (select query_id, {_strip('query')} as query, doc_type, coalesce(top_k, 3) as top_k, list_filter([
  case when coalesce(length(query) > 2000, true) or {_blank('query')} then 'query' end,
  case when doc_type is not null and doc_type not in ('architecture', 'runbook', 'technology') then 'doc_type' end,
  case when top_k is not null and top_k not between 1 and 5 then 'top_k' end], lambda e: e is not null) as invalid from queries)"""
_CAND = f"""{_CUR}, {_REQ}, cand as (select s.query_id, s.recall_rank, s.score, r.doc_type as wanted, r.top_k, s.chunk_id,
  c.doc_id, c.doc_type, c.title, c.section, c.chunk_index, c.source, c.component, c.source_url, c.snapshot_id, c.text
  from (select distinct query_id, recall_rank, chunk_id, score from scored) s join req r using (query_id) left join cur c using (chunk_id)
  where len(r.invalid) = 0 and (r.doc_type is null or c.doc_type is null or c.doc_type = r.doc_type))"""
_E = lambda c: f"coalesce(length({c}) = 0, true)"
_BAD = f"""bad as (
  select query_id, 'text' as rule, count(*) as rows from cand where chunk_id is null or chunk_id = '' or {_blank('text')} group by 1
  union all select query_id, 'identity', count(*) from cand where {_E('doc_id')} or {_E('section')} or {_E('doc_type')} group by 1
  union all select query_id, 'doc_type', count(*) from cand where doc_type not in ('architecture', 'runbook', 'technology') group by 1
  union all select query_id, 'score', count(*) from cand where score is null or isnan(score) or isinf(score) group by 1
  union all select query_id, 'technology', count(*) from cand where {_TECH} and ({_E('title')} or {_E('source')} or {_E('component')} or {_E('source_url')} or coalesce(chunk_index < 0, true)) group by 1
  union all select query_id, 'snapshot_id', count(*) from cand where not {_TECH} and coalesce(not regexp_full_match(snapshot_id, '[0-9a-f]{{64}}'), true) group by 1
  union all select query_id, 'two_types', count(*) from (select query_id, doc_id from cand group by all having count(distinct doc_type) > 1) group by 1
  union all select query_id, 'two_snapshots', count(*) from (select query_id, doc_id from cand group by all having count(distinct case when not {_TECH} then snapshot_id end) > 1) group by 1)"""
_RANKED = f"""{_CAND}, {_BAD}, good as (select * from cand where query_id not in (select query_id from bad)),
  sec as (select query_id, top_k, doc_id, doc_type, snapshot_id, section, max(score) as score from good where doc_type <> 'technology' group by all),
  full_ as (select query_id, top_k, doc_id, doc_type, snapshot_id, max(score) as score, string_agg(section, '|' order by -score, section) as sections from sec group by all),
  part as (select * from good where doc_type = 'technology' qualify row_number() over (partition by query_id, chunk_id order by score desc, recall_rank) = 1),
  both_ as (select 'full' as content_mode, query_id, top_k, doc_id, doc_type, snapshot_id, score, sections, null::varchar as chunk_id, null::varchar as content, null::varchar as title from full_
    union all select 'chunk', query_id, top_k, doc_id, doc_type, null::varchar, score, null::varchar, chunk_id, text, title from part),
  ranked as (select *, row_number() over (partition by query_id order by score desc, doc_id, coalesce(chunk_id, '')) as rank from both_ qualify rank <= top_k)"""
_ITEMS = f"""{_RANKED}, par as (select snapshot_id, doc_id, max(struct_pack(doc_type := doc_type, title := title, source := source, body := body)) as p, count(*) as n from parents group by all),
  won as (select r.*, par.n as found, par.p.doc_type as p_type, coalesce(r.title, par.p.title) as full_title, par.p.source as p_source, coalesce(r.content, par.p.body) as body_ from ranked r left join par using (snapshot_id, doc_id)),
  lost as (select distinct query_id, case when found is null then 'parent_missing' when {_E('body_')} or {_E('full_title')} or {_E('p_source')} then 'parent_incomplete' when p_type <> doc_type then 'parent_type' end as rule
    from won where content_mode = 'full' and (found is null or {_E('body_')} or {_E('full_title')} or {_E('p_source')} or p_type <> doc_type)),
  items as (select * from won where query_id not in (select query_id from lost))"""


def _marked(source: str, key: str, text: str, split: str, p: str = "") -> str:
    """Lines ``key, i, line, code, level, name`` of all texts as ``{p}hd``: a recursive walk carries the state of the code fence from line to line."""
    return rf"""{p}ls as (select {key} as key, {split} as ls from {source} where length({text}) > 0),
  {p}ln as (select key, unnest(ls) as line, generate_subscripts(ls, 1) as i from {p}ls),
  {p}fe as (select key, i, line, regexp_extract(line, '^ {{0,3}}(`{{3,}}|~{{3,}})(?s:.*)$', 1) as mark, {_blank("regexp_extract(line, '^ {0,3}(?:`{3,}|~{3,})((?s:.*))$', 1)")} as bare from {p}ln),
  {p}walk as (select distinct key, 0::bigint as i, '' as mark, '' as line, false as code from {p}ls
    union all select w.key, f.i, case when w.mark = '' then f.mark when f.mark <> '' and left(f.mark, 1) = left(w.mark, 1) and length(f.mark) >= length(w.mark) and f.bare then '' else w.mark end,
      f.line, w.mark <> '' or f.mark <> '' from {p}walk w join {p}fe f on f.key = w.key and f.i = w.i + 1),
  {p}hd as (select key, i, line, code, case when not code then length(regexp_extract(line, '^ {{0,3}}(#{{1,6}}){_WS}+(.+?){_WS}*#*{_WS}*$', 1)) else 0 end as level,
    regexp_extract(line, '^ {{0,3}}(#{{1,6}}){_WS}+(.+?){_WS}*#*{_WS}*$', 2) as name from {p}walk where i > 0)"""


_UNLINKED = r"regexp_replace(regexp_replace(line, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g')"


def _split(text: str) -> str:
    return f"string_split_regex(regexp_replace({text}, '(?:{_NL})$', ''), '{_NL}')"


SECTIONS = f"""{_marked('ingest', 'row_id', 'body', _split('body'))},
  top as (select key, min(i) as i from hd where level = 1 group by 1),
  ti as (select t.key, t.i as at, h.name as title from top t join hd h using (key, i)),
  no as (select h.key, h.i, h.line, h.level, h.name, t.title, sum(case when h.level = 2 then 1 else 0 end) over (partition by h.key order by h.i rows unbounded preceding) as n, h.i = t.at as top from hd h join ti t using (key)),
  raw as (select key, title, n, coalesce(max(case when level = 2 then name end), '概述') as section,
    regexp_replace(string_agg(case when level <> 2 and not top then line end, chr(10) order by i), '^\n+|\n+$', '', 'g') as content from no group by key, title, n),
  sections as (select key as row_id, title, (row_number() over (partition by key order by n) - 1)::int as section_no, section, content from raw where not {_blank('content')})"""


def _fit(budget: int) -> str:
    """The greedy admission as a recursive query: one rank after the other."""
    return f"""{_ITEMS}, walk as (
  select query_id, 0::bigint as rank, 0::bigint as used, '' as kept, '' as skipped from (select distinct query_id from items)
  union all
  select w.query_id, i.rank, case when w.used + length(i.body_) <= {budget} then w.used + length(i.body_) else w.used end,
    case when w.used + length(i.body_) <= {budget} then w.kept || i.rank || ',' else w.kept end,
    case when w.used + length(i.body_) <= {budget} then w.skipped else w.skipped || i.rank || ',' end
  from walk w join items i on i.query_id = w.query_id and i.rank = w.rank + 1),
  fit as (select query_id, max_by(kept, rank) as kept, max_by(skipped, rank) as skipped from walk group by 1)"""


# --- browsing ---------------------------------------------------------------


@query("""select count(*) as chunks, count(distinct coalesce(doc_id, '未知')) as doc_ids, count(distinct coalesce(component, '未知')) as components,
  count(distinct coalesce(doc_type, '未知')) as doc_types from chunks""")
def q01_collection_stats(spark, d):
    return browse.totals(read(spark, d, "chunks"))


@query("""select 'doc_id' as facet, coalesce(doc_id, '未知') as value, count(*) as n from chunks group by all
  union all select 'component', coalesce(component, '未知'), count(*) from chunks group by all
  union all select 'doc_type', coalesce(doc_type, '未知'), count(*) from chunks group by all""")
def q02_facet_values(spark, d):
    return browse.facets(read(spark, d, "chunks"))


@query("""select chunk_row, chunk_id from chunks where doc_type = 'technology' and (contains(lower(text), 'lease') or contains(lower(chunk_id), 'lease'))""")
def q03_keyword_filter(spark, d):
    return browse.filtered(read(spark, d, "chunks"), " LEASE ", doc_type="technology").select("chunk_row", "chunk_id")


@query("""select chunk_row, chunk_id, row_number() over (order by coalesce(doc_id, '未知'), coalesce(chunk_index, 0), chunk_row) as row_no from chunks where doc_type = 'runbook'
  qualify row_no between 41 and 60""")
def q04_page(spark, d):
    c = browse.filled(browse.filtered(read(spark, d, "chunks"), doc_type="runbook"))
    p = ordering.page(c, [F.col("doc_id"), F.col("chunk_index"), F.col("chunk_row")], 3, 20)
    return p.select("chunk_row", "chunk_id", F.col("row_no").cast("long").alias("row_no"))


@query("""select chunk_row, coalesce(doc_id, '未知') as doc_id, coalesce(component, '未知') as component, coalesce(doc_type, '未知') as doc_type, coalesce(title, '') as title,
  coalesce(section, '') as section, coalesce(chunk_index, 0) as chunk_index, coalesce(source, '') as source, coalesce(source_url, '') as source_url from chunks""")
def q05_default_fill(spark, d):
    return browse.filled(read(spark, d, "chunks")).select("chunk_row", "doc_id", "component", "doc_type", "title", "section", "chunk_index", "source", "source_url")


@query("select chunk_row, row_number() over (order by coalesce(doc_id, '未知'), coalesce(chunk_index, 0), chunk_row) as row_no from chunks")
def q05_positions(spark, d):
    c = browse.filled(read(spark, d, "chunks")).select("doc_id", "chunk_index", "chunk_row")
    return ordering.with_position(c, [F.col("doc_id"), F.col("chunk_index"), F.col("chunk_row")], "row_no").select("chunk_row", F.col("row_no").cast("long").alias("row_no"))


@query("""with u as (select distinct doc_id, chunk_id, chunk_index from chunks),
  p as (select doc_id, count(*) as chunks, count(distinct case when chunk_index >= 0 then chunk_index end) as idx, max(chunk_index) as top, count(*) filter (coalesce(chunk_index < 0, true)) as invalid from u group by 1)
  select doc_id, chunks, invalid, coalesce(greatest(top, -1), -1) + 1 - idx as missing, chunks - invalid - idx as repeated from p""")
def q05_index_gaps(spark, d):
    return browse.gaps(read(spark, d, "chunks"))


# --- documents --------------------------------------------------------------


@query(f"with {_VALID} select doc_id, count(*) as documents from valid group by 1 having count(*) > 1")
def q06_duplicate_ids(spark, d):
    return docs.duplicate_ids(docs.validated(read(spark, d, "ingest"))[0])


@query(f"select row_id, {_URL} as url, case when ({_URL}) is not null then 'technology-' || sha256({_URL}) end as doc_id from ingest where source_url is not null")
def q07_url_normalise(spark, d):
    u = F.col("source_url")
    return read(spark, d, "ingest").filter(u.isNotNull()).select("row_id", tx.url_normal(u).alias("url"), tx.technology_id(u).alias("doc_id"))


_PAGE = "'<html><head><style>p{}</style><script>var a=1;</script></head><body><nav>menu</nav><article><h1>' || coalesce(title, '') || '</h1><p>' || coalesce(body, '') || '</p></article><footer>end</footer></body></html>'"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Each record as the page it might have been taken from."""
    html = F.concat(
        F.lit("<html><head><style>p{}</style><script>var a=1;</script></head><body><nav>menu</nav><article><h1>"), F.coalesce("title", F.lit("")), F.lit("</h1><p>"),
        F.coalesce("body", F.lit("")), F.lit("</p></article><footer>end</footer></body></html>"),
    )
    return read(spark, d, "ingest").select("row_id", "title", html.alias("html"))


@query(rf"""with p as (select row_id, {_PAGE} as html from ingest), x as (select row_id, regexp_extract(html, '(?is)<article\b[^>]*>(.*?)</article\s*>', 1) as a, regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1) as h from p)
  select row_id, length(a)::int as chars, case when h <> '' then trim(regexp_replace(h, '<[^>]*>', '', 'g')) end as page_title from x where a <> ''""")
def q08_article_extract(spark, d):
    p = _pages(spark, d).select("row_id", hx.container(F.col("html")).alias("a"), hx.page_title(F.col("html")).alias("page_title"))
    return p.filter("a is not null").select("row_id", F.length("a").alias("chars"), "page_title")


def _noise_sql() -> str:
    x = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    for t in hx.NOISE_TAGS:
        x = rf"regexp_replace({x}, '(?is)<{t}\b[^>]*>.*?</{t}\s*>', '', 'g')"
    return f"with p as (select row_id, {_PAGE} as html from ingest) select row_id, md5({x}) as digest from p"


@query(_noise_sql())
def q09_html_noise_strip(spark, d):
    return _pages(spark, d).select("row_id", F.md5(hx.without_noise(F.col("html"))).alias("digest"))


@query(r"""with p as (select row_id, '<p><a href="' || coalesce(source_url, '#') || '">' || coalesce(title, '') || '</a> <a class="x" href="/management/' || (row_id % 997) || '.html"><b>' || coalesce(component, '') || '</b></a></p>' as html from ingest),
  a as (select row_id, unnest(regexp_extract_all(html, '(?is)(<a\b[^>]*href="[^"]*"[^>]*>.*?</a\s*>)', 1)) as a, generate_subscripts(regexp_extract_all(html, '(?is)(<a\b[^>]*href="[^"]*"[^>]*>.*?</a\s*>)', 1), 1) as pos from p),
  l as (select row_id, pos, regexp_extract(a, '(?is)href="([^"]*)"', 1) as href, trim(regexp_replace(regexp_extract(a, '(?is)<a\b[^>]*>(.*?)</a\s*>', 1), '<[^>]*>', '', 'g')) as label from a)
  select href, label, replace(split_part(href, '/', -1), '.html', '') as slug from l where contains(href, '/management/') and label <> '' qualify row_number() over (partition by href order by row_id, pos) = 1""")
def q10_link_index(spark, d):
    html = F.concat(
        F.lit('<p><a href="'), F.coalesce("source_url", F.lit("#")), F.lit('">'), F.coalesce("title", F.lit("")), F.lit('</a> <a class="x" href="/management/'),
        (F.col("row_id") % 997).cast("string"), F.lit('.html"><b>'), F.coalesce("component", F.lit("")), F.lit("</b></a></p>"),
    )
    links = read(spark, d, "ingest").select("row_id", F.posexplode(hx.anchors(html)).alias("pos", "a")).select("row_id", "pos", "a.href", "a.label")
    links = links.filter(F.col("href").contains("/management/") & (F.col("label") != ""))
    first = links.groupBy("href").agg(F.min(F.struct("row_id", "pos", "label")).alias("f"))
    return first.select("href", "f.label", tx.slug(F.col("href")).alias("slug"))


@query(rf"""select row_id, 'https://pages.example/management/' || (row_id % 997) || '.html' as url, {_strip(f"regexp_replace(regexp_replace(coalesce(component, ''), '<[^>]*>', '', 'g'), '{_WS}+', ' ', 'g')")} as description from ingest""")
def q10_link_details(spark, d):
    """Each link's address relative to its page, and the paragraph after its block."""
    href = F.concat(F.lit("../management/"), (F.col("row_id") % 997).cast("string"), F.lit(".html"))
    html = F.concat(F.lit('<div><a href="'), href, F.lit('">x</a></div><p>'), F.coalesce("component", F.lit("")), F.lit("</p>"))
    p = read(spark, d, "ingest").select("row_id", href.alias("href"), html.alias("html"))
    return p.select("row_id", hx.resolved(F.lit("https://pages.example/root/index.html"), "href").alias("url"), hx.description_after("html", "href").alias("description"))


@query(f"""with l as (select doc_id, string_split_regex(regexp_replace(text, '(?:{_NL})$', ''), '{_NL}') as ls from documents where length(text) > 0),
  e as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as line_no from l)
  select doc_id, line_no::int as line_no, line, (lead(line_no, 1, null) over (partition by doc_id order by line_no))::int as next_line from e""")
def q11_line_numbers(spark, d):
    """The next line is known within the array of a text's lines; nothing is shuffled."""
    e = read(spark, d, "documents").select("doc_id", F.explode(F.array(tx.lines(F.col("text")))).alias("ls")).select("doc_id", F.size("ls").alias("n"), F.posexplode("ls").alias("p", "line"))
    return e.select("doc_id", (F.col("p") + 1).alias("line_no"), "line", F.when(F.col("p") + 1 < F.col("n"), F.col("p") + 2).alias("next_line"))


@query(rf"""with l as (select doc_id, string_split_regex(regexp_replace(text, '(?:{_NL})$', ''), '{_NL}') as ls from documents where length(text) > 0),
  e as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as line_no from l),
  s as (select doc_id, line_no, line, sum(case when regexp_matches(line, '^ {{0,3}}#{{1,6}}[ \t]') then 1 else 0 end) over (partition by doc_id order by line_no rows unbounded preceding) as section_no from e)
  select doc_id, section_no::bigint as section_no, min(line_no)::int as first_line, count(*) as lines, sum(length(line))::bigint as chars from s group by 1, 2""")
def q12_boundary_sections(spark, d):
    """Sections are cut out of the array of a text's lines; nothing is shuffled."""
    return sections.marked_sections(read(spark, d, "documents"), "doc_id", "text", r"^ {0,3}#{1,6}[ \t]")


@query(f"""with s as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([。！？；.!?;])', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_strip('x')}), lambda x: x <> '') as s from documents)
  select doc_id, len(s)::int as sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::int as longest, md5(array_to_string(s, chr(1))) as digest from s""")
def q13_sentences(spark, d):
    s = read(spark, d, "documents").select("doc_id", tx.sentences(F.col("text")).alias("s"))
    longest = F.coalesce(F.array_max(F.transform("s", lambda x: F.length(x))), F.lit(0))
    return s.select("doc_id", F.size("s").alias("sentences"), longest.alias("longest"), F.md5(F.array_join("s", "\x01")).alias("digest"))


@query("select chunk_id, (length(text) + 2)::int as tokens from chunks where length(text) + 2 > 512")
def q14_char_budget_check(spark, d):
    return browse.over_budget(read(spark, d, "chunks"))


@query(f"""with {_CUR}, n as (select doc_id, title, section, text, row_number() over (partition by doc_id order by chunk_index nulls first, chunk_id) - 1 as i from cur)
  select doc_id || '::section::' || i as chunk_id, i::int as chunk_index, md5('文档标题：' || title || chr(10) || '章节标题：' || section || chr(10) || chr(10) || text) as digest from n""")
def q15_chunk_ids(spark, d):
    c = retrieval.current_chunks(read(spark, d, "chunks").select("chunk_id", "indexed_at", "chunk_row", "doc_id", "title", "section", "chunk_index", "text"))
    n = c.withColumn("i", F.row_number().over(W.partitionBy("doc_id").orderBy(F.asc_nulls_first("chunk_index"), "chunk_id")) - 1)
    return n.select(chunking.chunk_id(F.col("doc_id"), F.col("i")).alias("chunk_id"), F.col("i").alias("chunk_index"), F.md5(tx.chunk_text(F.col("title"), F.col("section"), F.col("text"))).alias("digest"))


# --- recall -----------------------------------------------------------------


@query("""select e.vec_id, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6) as score from embeddings e, embeddings q where q.vec_id = 0
  order by list_cosine_similarity(e.embedding::double[], q.embedding::double[]) desc, e.vec_id limit 20""")
def q16_cosine_topk(spark, d):
    e = read(spark, d, "embeddings")
    q = e.filter("vec_id = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return recall.recall(q, e.withColumnRenamed("vec_id", "id")).select(F.col("id").alias("vec_id"), F.round("cosine", 6).alias("score"))


@query("""select e.vec_id, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6) as score from embeddings e, embeddings q where q.vec_id = 0 and e.label = 1
  order by list_cosine_similarity(e.embedding::double[], q.embedding::double[]) desc, e.vec_id limit 20""")
def q17_cosine_topk_filtered(spark, d):
    e = read(spark, d, "embeddings")
    q = e.filter("vec_id = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.lit("one").alias("filter"))
    got = recall.recall(q, e.withColumnRenamed("vec_id", "id"), filters={"one": F.col("label") == 1})
    return got.select(F.col("id").alias("vec_id"), F.round("cosine", 6).alias("score"))


@query("""select q.vec_id as query_id, e.vec_id as id, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6) as score,
  row_number() over (partition by q.vec_id order by list_cosine_similarity(e.embedding::double[], q.embedding::double[]) desc, e.vec_id)::int as recall_rank
  from embeddings e, embeddings q where q.vec_id % 20 = 0 qualify recall_rank <= 20""")
def q18_batch_recall(spark, d):
    e = read(spark, d, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return recall.recall(q, e.withColumnRenamed("vec_id", "id")).select("query_id", "id", F.round("cosine", 6).alias("score"), "recall_rank")


def _ivf(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = read(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    q = e.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    centres, probes = vectors.fit(e)
    return q, e, vectors.search(q, vectors.assigned(e, centres), centres, probes=probes)


@query()
def q18_index_recall(spark, d):
    """Approximate neighbours by the inverted-file index."""
    return _ivf(spark, d)[2].select("query_id", "id", F.round("cosine", 6).alias("score"), "recall_rank")


@query()
def q18_index_quality(spark, d):
    """What part of the exact neighbours the index finds."""
    q, e, got = _ivf(spark, d)
    return vectors.quality(got, recall.recall(q, e))


@query(f"""with {_CUR}, p as (select distinct query_id, recall_rank, chunk_id from scored),
  t as (select p.query_id, p.recall_rank, p.chunk_id, list_distinct(regexp_extract_all(lower(q.query), '([a-z0-9]+|[一-龥])')) as a, list_distinct(regexp_extract_all(lower(c.text), '([a-z0-9]+|[一-龥])')) as b
    from p join queries q using (query_id) join cur c using (chunk_id))
  select query_id, recall_rank, chunk_id, round(case when len(list_distinct(list_concat(a, b))) > 0 then len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))) else 0.0 end, 6) as score from t""")
def q19_lexical_rerank(spark, d):
    c = retrieval.current_chunks(read(spark, d, "chunks").select("chunk_id", "indexed_at", "chunk_row", "text"))
    return retrieval.lexical_rerank(read(spark, d, "queries").filter("query is not null"), read(spark, d, "scored"), c)


# --- ranking ----------------------------------------------------------------


def _good(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of the requests that break no rule."""
    c = _candidates(spark, d)
    return c.join(retrieval.violations(c).select("query_id").distinct(), "query_id", "left_anti")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    reqs = retrieval.requests(read(spark, d, "queries"))
    return staged(retrieval.candidates(reqs, read(spark, d, "scored"), retrieval.current_chunks(read(spark, d, "chunks"))), "candidates")


@query(f"with {_RANKED} select query_id, doc_id, doc_type, snapshot_id, score from full_")
def q20_doc_max_score(spark, d):
    return retrieval.document_candidates(_good(spark, d)).select("query_id", "doc_id", "doc_type", "snapshot_id", "score")


@query(f"with {_RANKED} select query_id, chunk_id, recall_rank, score from part")
def q21_chunk_dedup(spark, d):
    return retrieval.chunk_candidates(_good(spark, d)).select("query_id", "chunk_id", "recall_rank", "score")


@query(f"with {_RANKED} select query_id, doc_id, sections from full_")
def q22_matched_sections(spark, d):
    return retrieval.document_candidates(_good(spark, d)).select("query_id", "doc_id", F.array_join("matched_sections", "|").alias("sections"))


@query(f"with {_RANKED} select query_id, rank::int as rank, content_mode, doc_id, chunk_id, score from ranked")
def q23_mixed_rank_topk(spark, d):
    return retrieval.ranked(_good(spark, d)).select("query_id", "rank", "content_mode", "doc_id", "chunk_id", "score")


@query(f"with {_ITEMS} select query_id, rank::int as rank, doc_id, full_title as title, length(body_)::int as chars, md5(body_) as digest from items")
def q24_parent_lookup(spark, d):
    items, lost = retrieval.with_parents(retrieval.ranked(_good(spark, d)), read(spark, d, "parents"))
    items = items.join(lost.select("query_id").distinct(), "query_id", "left_anti")
    return items.select("query_id", "rank", "doc_id", "title", F.length("content").alias("chars"), F.md5("content").alias("digest"))


@query(f"with recursive {_fit(3000)} select query_id, rtrim(kept, ',') as kept, rtrim(skipped, ',') as skipped from fit")
def q25_budget_greedy(spark, d):
    items, lost = retrieval.with_parents(retrieval.ranked(_good(spark, d)), read(spark, d, "parents"))
    fit = retrieval.admitted(items.join(lost.select("query_id").distinct(), "query_id", "left_anti"), 3000)
    return fit.select("query_id", F.array_join("kept", ",").alias("kept"), F.array_join("skipped", ",").alias("skipped"))


# --- index ------------------------------------------------------------------

_SPLIT = "timestamp '2025-04-26 00:00:00'"


@query(f"select distinct chunk_id from chunks where indexed_at < {_SPLIT} and chunk_id not in (select chunk_id from chunks where indexed_at >= {_SPLIT})")
def q26_stale_ids(spark, d):
    c, t = read(spark, d, "chunks"), F.lit("2025-04-26 00:00:00").cast("timestamp_ntz")
    return index.stale_ids(c.filter(F.col("indexed_at") < t), c.filter(F.col("indexed_at") >= t))


def _digest_sql(columns: list[str]) -> str:
    return "sha256(" + " || ".join(f"case when {c} is null then 'n' else 'v' || length({c}) || ':' || {c} end" for c in columns) + ")"


@query(f"""with a as (select chunk_id, max({_digest_sql(['title', 'section', 'text'])}) as was from chunks where indexed_at < {_SPLIT} group by 1),
  b as (select chunk_id, max({_digest_sql(['title', 'section', 'text'])}) as now_ from chunks where indexed_at >= {_SPLIT} group by 1)
  select chunk_id, case when was is null then 'inserted' when now_ is null then 'deleted' when was = now_ then 'unchanged' else 'updated' end as state from a full join b using (chunk_id)""")
def q27_sync_diff(spark, d):
    c, t = read(spark, d, "chunks"), F.lit("2025-04-26 00:00:00").cast("timestamp_ntz")
    return index.sync_states(c.filter(F.col("indexed_at") < t), c.filter(F.col("indexed_at") >= t), ["title", "section", "text"])


@query(f"with {_CAND}, {_BAD} select query_id, rule, rows from bad")
def q28_consistency_violations(spark, d):
    return retrieval.violations(_candidates(spark, d))


@query("""select row_id, '{' || array_to_string(list_transform(list_sort(map_keys(extra)), lambda k: to_json(k) || ':' || to_json(extra[k])), ',') || '}' as extra_json, len(map_keys(extra))::int as keys from ingest where extra is not null""")
def q29_sorted_json(spark, d):
    """The further metadata of each record as JSON in the order of its keys, and read back."""
    r = read(spark, d, "ingest").filter("extra is not null").select("row_id", tx.sorted_json(F.col("extra")).alias("extra_json"))
    return r.select("row_id", "extra_json", F.size(tx.parsed_json(F.col("extra_json"))).alias("keys"))


@query(f"""with leaf as (select snapshot_id, {_digest_sql(index.PARENT_COLUMNS)} as h from parents),
  inner_ as (select snapshot_id, substr(h, 1, 3) as b, count(*) as n, sha256(string_agg(h, '' order by h)) as h from leaf group by 1, 2)
  select snapshot_id, sum(n)::bigint as documents, sha256(string_agg(b || h, '' order by b || h)) as digest from inner_ group by 1""")
def q29_snapshot_digest(spark, d):
    return index.snapshot_digests(read(spark, d, "parents"), ["snapshot_id"], index.PARENT_COLUMNS)


@query(r"""with p as (select row_id, coalesce(title, '') as t, row_number() over (order by row_id) as i from ingest),
  f as (select row_id, i, regexp_replace(t, '[\\/:*?"<>|\r\n\t]', '-', 'g') as t from p)
  select row_id, lpad(i::varchar, greatest(2, length(i::varchar))::int, '0') || '-' || regexp_replace(regexp_replace(t, '\s+', ' ', 'g'), '^[- ]+|[- ]+$', '', 'g') || '.md' as spaced,
    lpad(i::varchar, greatest(2, length(i::varchar))::int, '0') || '-' || regexp_replace(regexp_replace(t, '\s+', '-', 'g'), '^-+|-+$', '', 'g') || '.md' as dashed from f""")
def q30_filenames(spark, d):
    p = ordering.with_position(read(spark, d, "ingest").select("row_id", F.coalesce("title", F.lit("")).alias("t")), [F.col("row_id")], "i")
    no = F.concat(tx.ordinal(F.col("i")), F.lit("-"))
    return p.select("row_id", F.concat(no, tx.filename_spaced(F.col("t")), F.lit(".md")).alias("spaced"), F.concat(no, tx.filename_dashed(F.col("t")), F.lit(".md")).alias("dashed"))


@query(rf"""with recursive b as (select row_id, body || chr(10) || chr(10) || '![图](a.png)' || chr(10) || '[参数](https://a.example/x) 见 `x`' as body from ingest), {_marked('b', 'row_id', 'body', "string_split(body, chr(10))")},
  j as (select key, string_agg(case when code then line else {_UNLINKED} end, chr(10) order by i) as t from hd group by 1)
  select b.row_id, md5(regexp_replace(j.t, '\n{{3,}}', chr(10) || chr(10), 'g')) as digest from b left join j on j.key = b.row_id""")
def q31_markdown_links(spark, d):
    """Bodies with links and images put in, and taken out again outside code."""
    b = read(spark, d, "ingest").select("row_id", F.concat("body", F.lit("\n\n![图](a.png)\n[参数](https://a.example/x) 见 `x`")).alias("body"))
    return b.select("row_id", F.md5(tx.squeeze(chunking.unlinked("body"))).alias("digest"))


@query(f"with recursive {SECTIONS} select row_id, title, section_no, section, content from sections")
def q32_split_sections(spark, d):
    return chunking.section_rows(read(spark, d, "ingest"), "row_id", "body").withColumnRenamed("id", "row_id")


_RULE = rf"^{_WS}*\|?{_WS}*:?-+:?{_WS}*(?:\|{_WS}*:?-+:?{_WS}*)+\|?{_WS}*$"


@query(rf"""with recursive {_marked('ingest', 'row_id', 'body', _split('body'))},
  fl as (select key, i, line, mark, bare, {_blank('line')} as empty, regexp_matches(line, '^(?:    |\t)') as indent, contains(line, '|') as pipe, coalesce(regexp_matches(lead(line) over (partition by key order by i), '{_RULE}'), false) as ruled,
    regexp_matches(line, '^ {{0,3}}(?:[-+*]|\d+[.)]){_WS}') as item from fe),
  st as (select distinct key, 0::bigint as i, '' as kind, '' as mark, false as fresh, false as own from ls
    union all select w.key, f.i,
      case when w.kind = 'fence' then case when f.mark <> '' and left(f.mark, 1) = left(w.mark, 1) and length(f.mark) >= length(w.mark) and f.bare then '' else 'fence' end
        when f.empty then case when w.kind = 'code' then 'code' else '' end
        when w.kind = 'code' and f.indent or w.kind = 'table' and f.pipe or w.kind = 'text' and f.mark = '' and not f.item and not f.indent then w.kind
        when f.mark <> '' then 'fence' when f.indent then 'code' when f.pipe and f.ruled then 'table' else 'text' end,
      case when w.kind = 'fence' then w.mark else f.mark end,
      w.kind <> 'fence' and not f.empty and not (w.kind = 'code' and f.indent or w.kind = 'table' and f.pipe or w.kind = 'text' and f.mark = '' and not f.item and not f.indent),
      w.kind = 'fence' or not f.empty
    from st w join fl f on f.key = w.key and f.i = w.i + 1),
  no as (select *, sum(case when fresh then 1 else 0 end) over (partition by key order by i rows unbounded preceding) as n from st where i > 0)
  select key as row_id, (n - 1)::int as block_no, max(case when fresh then case when kind = 'fence' then 'code' else kind end end) as kind, min(i)::int as first_line, (max(case when own then i end) - min(i) + 1)::int as lines from no where n > 0 group by key, n""")
def q32_blocks(spark, d):
    """The code, table and text blocks of each body."""
    return sections.block_rows(read(spark, d, "ingest"), "row_id", "body").withColumnRenamed("id", "row_id")


_CHUNK = "'文档标题：' || s.title || chr(10) || '章节标题：' || s.section || chr(10) || chr(10) || s.content"


@query(f"""with recursive lv as (select * from ingest qualify row_number() over (partition by source order by ingested_at desc, row_id desc) = 1), {_VALID.replace('from ingest', 'from lv')}, {SECTIONS},
  own as (select v.doc_id, v.component, s.row_id, s.section_no, s.section, {_CHUNK} as text from sections s join valid v using (row_id) where v.doc_type <> 'technology')
  select doc_id || '::section::' || section_no as chunk_id, doc_id, component, section, section_no as chunk_index, md5(text) as digest from own where row_id not in (select row_id from own where length(text) > 510)""")
def q32_project_chunks(spark, d):
    """Chunks of the valid project documents, one a section; a document with a section above the limit has none."""
    valid, _ = docs.validated(docs.latest(read(spark, d, "ingest"), ["source"], [F.col("ingested_at"), F.col("row_id")]))
    project = valid.filter(F.col("doc_type") != "technology")
    chunks = chunking.make_chunks(project, chunking.chunk_rows(project))
    return chunks.select("chunk_id", "doc_id", "component", "section", "chunk_index", F.md5("text").alias("digest"))


@query()
def q32_chunk_rows(spark, d):
    """Chunks of all valid documents as the ingest makes them; documents that break a rule carry the problem."""
    valid, _ = docs.validated(docs.latest(read(spark, d, "ingest"), ["source"], [F.col("ingested_at"), F.col("row_id")]))
    return chunking.chunk_rows(valid)


@query(rf"""with recursive {_marked('documents', 'doc_id', 'text', _split('text'))},
  no as (select key, i, line, level, name, sum(case when level = 1 then 1 else 0 end) over (partition by key order by i rows unbounded preceding) as n from hd)
  select key as doc_id, n::int as file_no, max(case when level = 1 then name end) as title, {_strip("regexp_replace(string_agg(line, chr(10) order by i), '\n{3,}', chr(10) || chr(10), 'g')")} as content from no where n > 0 group by key, n""")
def q32_level1_files(spark, d):
    return chunking.level1_files(read(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


@query(f"""select row_id, (case when id is null then 0 else 1 end + case when doc_type is null then 0 else 1 end + case when source_url is null then 0 else 1 end)::int as keys, md5({_strip('body')}) as digest from ingest where body is not null""")
def q33_front_matter(spark, d):
    f = read(spark, d, "ingest").filter("body is not null").select("row_id", tx.front_matter({"id": F.col("id"), "doc_type": F.col("doc_type"), "source_url": F.col("source_url")}, F.col("body")).alias("t"))
    front, body = tx.front_split(F.col("t"))
    return f.select("row_id", F.size(F.filter(F.split(front, "\n"), lambda x: x != "")).alias("keys"), F.md5(body).alias("digest"))


@query(f"""select source, doc_type, component, array_to_string({_ERRORS}, ',') as errors from (select * replace ({_strip("coalesce(body, '')")} as body, null::map(varchar, varchar) as extra, null::map(varchar, varchar) as extra_types) from ingest)""")
def q33_yaml_documents(spark, d):
    """Records written as files with front matter, read back, decoded and checked."""
    cols = {k: F.col(k) for k in ("id", "doc_type", "project", "service", "component", "deployment", "source_url")}
    files = read(spark, d, "ingest").select("source", tx.front_matter(cols, F.coalesce("body", F.lit(""))).alias("text"))
    p = docs.parse(files)
    return p.select("source", "doc_type", "component", F.array_join(docs.rule_breaks(p), ",").alias("errors"))


def _index(spark: SparkSession, d: str, vectors: bool = False) -> tuple[str, list[index.SyncReport]]:
    """An index in the shared folder, built from the first versions of all records and then from the last ones."""
    root = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    records, reports = read(spark, d, "ingest"), []
    for order in ([-F.col("row_id")], [F.col("ingested_at"), F.col("row_id")]):
        valid, _ = docs.validated(docs.latest(records, ["source"], order))
        valid = docs.latest(valid, ["doc_id"], order)  # two sources of one id would be an error; here one of them counts
        rows = staged(chunking.chunk_rows(valid), "rows")
        titles = rows.filter("chunk_index = 0").select("row_id", F.col("title").alias("top"))
        whole = valid.filter(F.col("doc_type") != "technology").join(titles, "row_id").select("doc_id", "doc_type", F.col("top").alias("title"), "source", "body")
        chunks = chunking.make_chunks(valid, rows)
        if vectors:
            keyed = chunks.withColumn("id", F.xxhash64("chunk_id"))
            chunks = keyed.join(pipeline.hashed_vectors(keyed.select("id", "text")), "id").drop("id")
        reports.append(index.sync(spark, root, chunks, whole))
    return root, reports


@query()
def q34_health(spark, d):
    """The state of an index built from the tables."""
    return index.status(spark, _index(spark, d)[0]).select("status", "index_loaded", "chunks", "snapshot_id")


@query()
def q34_sync_report(spark, d):
    """What the second of two syncs did."""
    return index.report_row(spark, _index(spark, d)[1][1]).drop("version")


@query(f"select row_id, array_to_string({_ERRORS}, ',') as errors from ingest")
def q35_validation(spark, d):
    r = read(spark, d, "ingest")
    return r.select("row_id", F.array_join(docs.rule_breaks(r), ",").alias("errors"))


@query(f"with {_REQ} select query_id, query, top_k::int as top_k, array_to_string(invalid, ',') as invalid from req")
def q36_requests(spark, d):
    return retrieval.requests(read(spark, d, "queries")).select("query_id", "query", "top_k", F.array_join("invalid", ",").alias("invalid"))


@query(f"""with raw as (select query_id, query, doc_type, top_k, query_id % 6 as k from queries where query is not null),
  b as (select *, case k when 0 then ['type_top_k'] when 1 then ['unknown_key'] when 2 then ['type_query'] when 3 then [] when 4 then ['json'] else ['type_top_k'] end as broken,
    case when k = 4 then null when k = 2 then '7' else query end as q, case when k = 5 then doc_type end as dt, case when k = 3 then coalesce(top_k, 3) when k = 1 then 3 end as tk from raw),
  i as (select *, list_filter([case when coalesce(length(q) > 2000, true) or {_blank('q')} then 'query' end, case when dt is not null and dt not in ('architecture', 'runbook', 'technology') then 'doc_type' end,
    case when tk is not null and tk not between 1 and 5 then 'top_k' end], lambda e: e is not null) as invalid from b)
  select query_id, {_strip('q')} as query, coalesce(tk, 3)::int as top_k, array_to_string(list_concat(broken, invalid), ',') as invalid from i""")
def q36_json_requests(spark, d):
    """Requests as JSON texts, some of which break the contract."""
    r, k = read(spark, d, "queries").filter("query is not null"), F.col("query_id") % 6
    text = {c: F.substring(F.to_json(F.struct(F.col(c).alias("x"))), 6, 1 << 30) for c in ("query", "doc_type")}
    text = {c: F.when(F.col(c).isNull(), "null").otherwise(F.regexp_replace(v, r"\}\z", "")) for c, v in text.items()}
    lit = F.lit
    request = (
        F.when(k == 0, F.concat(lit('{"query": '), text["query"], lit(', "top_k": "3"}'))).when(k == 1, F.concat(lit('{"query": '), text["query"], lit(', "top_k": 3, "limit": 1}')))
        .when(k == 2, lit('{"query": 7, "doc_type": null}')).when(k == 3, F.concat(lit('{"query": '), text["query"], lit(', "top_k": '), F.coalesce(F.col("top_k"), lit(3)).cast("string"), lit("}")))
        .when(k == 4, lit('{"query": "broken')).otherwise(F.concat(lit('{"query": '), text["query"], lit(', "doc_type": '), text["doc_type"], lit(', "top_k": 2.5}')))
    )
    got = retrieval.json_requests(r.select("query_id", request.alias("request")))
    return got.select("query_id", "query", "top_k", F.array_join("invalid", ",").alias("invalid"))


@query(f"""with recursive {_fit(16000)} select i.query_id, i.rank::int as rank, i.content_mode, i.doc_id, i.doc_type, i.full_title as title, i.score, i.sections, i.chunk_id, md5(i.body_) as digest
  from items i join fit f using (query_id) where contains(',' || f.kept, ',' || i.rank || ',')""")
def q37_search_items(spark, d):
    items, _ = _answers(spark, d)
    return items.select("query_id", "rank", "content_mode", "doc_id", "doc_type", "title", "score", F.array_join("matched_sections", "|").alias("sections"), "chunk_id", F.md5("content").alias("digest"))


def _answers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return retrieval.answer(read(spark, d, "queries"), read(spark, d, "scored"), retrieval.current_chunks(read(spark, d, "chunks")), read(spark, d, "parents"))


@query(f"""with recursive {_fit(16000)}, why as (select query_id, string_agg(rule, ',' order by rule) as reasons from (select distinct query_id, rule from bad union select query_id, rule from lost) group by 1)
  select r.query_id, case when len(r.invalid) > 0 then 'invalid' when w.reasons is not null then 'unavailable' else 'ok' end as status, coalesce(w.reasons, array_to_string(r.invalid, ',')) as reasons,
    (case when len(r.invalid) > 0 or w.reasons is not null then 0 when not exists (select 1 from cand c where c.query_id = r.query_id) then 2 else 1 + len(f.skipped) - len(replace(f.skipped, ',', '')) end)::int as notices
  from req r left join why w using (query_id) left join fit f using (query_id)""")
def q38_search_states(spark, d):
    _, states = _answers(spark, d)
    return states.select("query_id", "status", F.array_join("reasons", ",").alias("reasons"), F.size("notices").alias("notices"))


def _json(**fields: str) -> str:
    """A JSON object in which fields that are null are left out."""
    parts = " || ".join(f"case when {x} is null then '' else ',\"{name}\":' || to_json({x}) end" for name, x in fields.items())
    return f"'{{' || substr({parts}, 2) || '}}'"


_ITEM_JSON = _json(
    content_mode="i.content_mode", doc_id="i.doc_id", doc_type="i.doc_type", title="i.full_title", source="coalesce(p.source, i.p_source)", score="i.score", content="i.body_", snapshot_id="i.snapshot_id",
    matched_sections="string_split(i.sections, '|')", chunk_id="i.chunk_id", component="p.component", source_url="p.source_url", section="p.section", chunk_index="p.chunk_index",
)


@query(f"""with recursive {_fit(16000)}, why as (select query_id, string_agg(rule, ',' order by rule) as reasons from (select distinct query_id, rule from bad union select query_id, rule from lost) group by 1),
  js as (select i.query_id, i.rank, contains(',' || f.kept, ',' || i.rank || ',') as fits, coalesce(i.chunk_id, i.doc_id) as name, {_ITEM_JSON} as item from items i join fit f using (query_id) left join part p on p.query_id = i.query_id and p.chunk_id = i.chunk_id),
  ag as (select query_id, string_agg(item, ',' order by rank) filter (fits) as items, string_agg(',' || to_json('结果 ' || name || ' 超过剩余正文预算，已整条省略；可缩小查询范围或减少 top_k。'), '' order by rank) filter (not fits) as left_out from js group by 1)
  select r.query_id, case when len(r.invalid) > 0 then 'invalid' when w.reasons is not null then 'unavailable' else 'ok' end as status,
    '{{"items":[' || coalesce(ag.items, '') || '],"notices":[' || case when len(r.invalid) > 0 or w.reasons is not null then '' else to_json('{retrieval.DISCLAIMER}') ||
      case when exists (select 1 from cand c where c.query_id = r.query_id) then '' else ',' || to_json('{retrieval.NO_CANDIDATES}') end || coalesce(ag.left_out, '') end || ']}}' as response
  from req r left join why w using (query_id) left join ag using (query_id)""")
def q38_responses(spark, d):
    return retrieval.responses(*_answers(spark, d))


@query(f"""select id, row_id, md5(body) as digest from (select *, {_strip('id')} as key from ingest where not {_blank('id')}) qualify row_number() over (partition by key order by ingested_at desc, row_id desc) = 1""")
def q39_latest_version(spark, d):
    r = read(spark, d, "ingest").filter(~tx.blank(F.col("id"))).select(tx.strip(F.col("id")).alias("key"), "id", "row_id", "ingested_at", F.md5("body").alias("digest"))
    return docs.latest(r, ["key"], [F.col("ingested_at"), F.col("row_id")]).select("id", "row_id", "digest")


@query(f"""with {_VALID} select count(*) as documents, count(distinct doc_id) as doc_ids, count(*) filter (doc_type <> 'technology') as parents from valid""")
def q40_dry_run(spark, d):
    v, _ = docs.validated(read(spark, d, "ingest"))
    return v.agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("doc_id").alias("doc_ids"), F.count_if(F.col("doc_type") != "technology").alias("parents"))


@query()
def q41_page_markdown(spark, d):
    return _pages(spark, d).select("row_id", hx.to_markdown("html", "title").alias("markdown"))


@query(rf"""with recursive {_marked('documents', 'doc_id', 'text', _split('text'))},
  no as (select key, i, line, level, name, sum(case when level = 1 then 1 else 0 end) over (partition by key order by i rows unbounded preceding) as n from hd),
  fi as (select key || '/' || n as key, key as doc_id, n, max(case when level = 1 then name end) as title, {_strip("regexp_replace(string_agg(line, chr(10) order by i), '\n{3,}', chr(10) || chr(10), 'g')")} as content from no where n > 0 group by no.key, n),
  {_marked('fi', 'key', 'content', "string_split(content, chr(10))", 'f')},
  j as (select key, regexp_replace(string_agg(case when code then line else {_UNLINKED} end, chr(10) order by i), '\n{{3,}}', chr(10) || chr(10), 'g') as t from fhd group by 1)
  select doc_id, n::int as file_no, lpad(n::int::varchar, greatest(2, length(n::int::varchar))::int, '0') || '-ops-' ||
    regexp_replace(regexp_replace(regexp_replace(title, '[\\/:*?"<>|\r\n\t]', '-', 'g'), '\s+', ' ', 'g'), '^[- ]+|[- ]+$', '', 'g') || '.md' as filename,
    md5('---' || chr(10) || 'doc_type: "technology"' || chr(10) || 'component: "ops"' || chr(10) || '---' || chr(10) || chr(10) || j.t) as digest from fi join j using (key)""")
def q42_level1_markdown(spark, d):
    """Documents as one Markdown file per level-1 heading."""
    f = preparation.level1_markdown(read(spark, d, "documents"), "doc_id", "text", "ops")
    return f.select(F.col("id").alias("doc_id"), "file_no", "filename", F.md5("content").alias("digest"))


@query(f"""select count(*) filter (contains(body, 'e')) as succeeded, count(*) filter (not coalesce(contains(body, 'e'), false)) as failed from ingest""")
def q42_counters(spark, d):
    """How many records pass a check and how many don't."""
    return preparation.counters(read(spark, d, "ingest"), F.col("body").contains("e"))


@query()
def q42_page_files(spark, d):
    """Pages as Markdown files with front matter, numbered over the whole table."""
    p = ordering.with_position(_pages(spark, d), [F.col("row_id")], "ordinal")
    p = p.select(F.col("row_id").alias("page_id"), "ordinal", F.concat(F.lit("https://pages.example/"), "row_id").alias("url"), "title", "html")
    return preparation.page_files(p, F.lit("ops")).select("page_id", "filename", F.md5("content").alias("digest"))


@query()
def q43_search_index(spark, d):
    """Requests against an index built from the tables, with the stand-in models."""
    root, _ = _index(spark, d, vectors=True)
    items, _ = pipeline.search(spark, root, read(spark, d, "queries"))
    return items.select("query_id", "rank", "content_mode", "doc_id", "chunk_id", F.round("score", 6).alias("score"))
