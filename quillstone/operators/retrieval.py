"""From scored candidates to answers, for many requests at once.

A project document is one candidate with the best score of its sections, a technology
chunk is one of its own.  Both are ranked together, the first ``top_k`` are completed with
their parent document, and a character budget admits them in order.  A request with a bad
candidate, even one that wouldn't make the top, is unavailable as a whole; in a batch it
is reported with its reasons while the others are answered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import KnowledgeUnavailable, RequestInvalid
from ..functions import text as tx
from ..sources.documents import DOC_TYPES, latest
from ..sources.staging import staged

# Limits of a request and of an answer, and the notices of an answer.
TOP_K, MOST_K, QUERY_CHARS, CONTENT_CHARS, RECALL = 3, 5, 2000, 16_000, 20
DISCLAIMER = "结果为相关候选资料，不代表故障已确认；精排分数不是置信度，当前未设置相关性拒答阈值。"
NOTHING_INDEXED = "运维知识集合为空，请先入库。"
NO_CANDIDATES = "当前查询范围没有候选章节，未自动放宽过滤条件。"
SNAPSHOT = "^[0-9a-f]{64}$"


def omitted(identity: Column) -> Column:
    return F.concat(F.lit("结果 "), identity, F.lit(" 超过剩余正文预算，已整条省略；可缩小查询范围或减少 top_k。"))


def requests(queries: DataFrame) -> DataFrame:
    """``query_id, query, doc_type, top_k, invalid``: the stripped query, the default for a missing ``top_k``, and broken rules."""
    checks = {
        "query": F.coalesce(F.length("query") > QUERY_CHARS, F.lit(True)) | tx.blank(F.col("query")),
        "doc_type": F.col("doc_type").isNotNull() & ~F.col("doc_type").isin(*DOC_TYPES),
        "top_k": F.col("top_k").isNotNull() & ~F.col("top_k").between(1, MOST_K),
    }
    invalid = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]))
    return queries.select("query_id", tx.strip(F.col("query")).alias("query"), "doc_type", F.coalesce(F.col("top_k").try_cast("int"), F.lit(TOP_K)).alias("top_k"), invalid.alias("invalid"))


#: A request's keys and the types their values may have.
REQUEST = {"query": ("STRING",), "doc_type": ("STRING", "VOID"), "top_k": ("BIGINT", "VOID")}


def json_requests(raw: DataFrame) -> DataFrame:
    """``query_id, query, doc_type, top_k, invalid`` from ``query_id, request``, a JSON text each; :func:`requests` with strict types.

    Broken JSON, keys beyond :data:`REQUEST` and values of another type, ``"3"`` or ``3.0``
    for a number among them, are rules of their own.  A missing ``top_k`` takes the default,
    an explicit null breaks the contract.
    """
    v = raw.select("query_id", F.try_parse_json("request").alias("v"), F.from_json("request", "map<string,string>").alias("m"))
    kind = {k: F.schema_of_variant(F.try_variant_get("v", f"$.{k}", "variant")) for k in REQUEST}
    there = {k: F.coalesce(F.array_contains(F.map_keys("m"), k), F.lit(False)) for k in REQUEST}
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    broken = [F.when(~is_object, F.lit("json")), F.when(is_object & (F.size(F.array_except(F.map_keys("m"), F.array(*map(F.lit, REQUEST)))) > 0), F.lit("unknown_key"))]
    broken += [F.when(is_object & there[k] & ~F.coalesce(kind[k].isin(*(t for t in kinds if k != "top_k" or t != "VOID")), F.lit(False)), F.lit(f"type_{k}")) for k, kinds in REQUEST.items()]
    typed = v.select(
        "query_id", F.array_compact(F.array(*broken)).alias("broken"), F.try_variant_get("v", "$.query", "string").alias("query"),
        F.try_variant_get("v", "$.doc_type", "string").alias("doc_type"), F.when(kind["top_k"] == "BIGINT", F.try_variant_get("v", "$.top_k", "long")).alias("top_k"),
    )
    checked = requests(typed).join(typed.select("query_id", "broken"), "query_id")
    return checked.select("query_id", "query", "doc_type", "top_k", F.array_union("broken", "invalid").alias("invalid"))


def current_chunks(chunks: DataFrame) -> DataFrame:
    """One row per chunk id, the one indexed last."""
    return latest(chunks, ["chunk_id"], [F.col("indexed_at"), F.col("chunk_row")])


CANDIDATE = ["doc_id", "doc_type", "title", "section", "chunk_index", "source", "component", "source_url", "snapshot_id", "text"]


def candidates(reqs: DataFrame, scored: DataFrame, chunks: DataFrame, strict: bool = False) -> DataFrame:
    """Scored rows of valid requests with their chunk; a request's filter holds before anything is ranked.

    ``chunks`` has one row per id; one that isn't there leaves nulls, which the checks
    report, as they do scores that aren't numbers.  ``strict`` is for scores of candidates
    that were recalled under the filter: one of another kind is then a contradiction that
    the checks report, and isn't left out.
    """
    rows = scored.select("query_id", "recall_rank", "chunk_id", F.col("score").try_cast("double").alias("score")).distinct()
    good = reqs.filter(F.size("invalid") == 0).select("query_id", F.col("doc_type").alias("wanted"), "top_k")
    c = rows.join(good, "query_id").join(chunks.select("chunk_id", *CANDIDATE), "chunk_id", "left")
    return c if strict else c.filter(F.col("wanted").isNull() | F.col("doc_type").isNull() | (F.col("doc_type") == F.col("wanted")))


def _empty(name: str) -> Column:
    return F.coalesce(F.length(name) == 0, F.lit(True))


def violations(c: DataFrame) -> DataFrame:
    """``query_id, rule, rows`` of every rule that candidates of a request break."""
    technology = F.coalesce(F.col("doc_type") == "technology", F.lit(False))
    row = {
        "text": F.col("chunk_id").isNull() | _empty("chunk_id") | tx.blank(F.col("text")),
        "identity": _empty("doc_id") | _empty("section") | _empty("doc_type"),
        "doc_type": ~F.col("doc_type").isin(*DOC_TYPES),
        "filter": F.col("doc_type") != F.col("wanted"),
        "score": ~tx.finite(F.col("score")),
        "technology": technology & (_empty("title") | _empty("source") | _empty("component") | _empty("source_url") | F.coalesce(F.col("chunk_index") < 0, F.lit(True))),
        "snapshot_id": ~technology & F.coalesce(~F.col("snapshot_id").rlike(SNAPSHOT), F.lit(True)),
    }
    broken = c.select("query_id", F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in row.items()]))).alias("rule"))
    single = broken.groupBy("query_id", "rule").agg(F.count(F.lit(1)).alias("rows"))
    per = c.groupBy("query_id", "doc_id").agg(F.count_distinct("doc_type").alias("t"), F.count_distinct(F.when(~technology, F.col("snapshot_id"))).alias("s"))
    across = per.select("query_id", F.explode(F.array_compact(F.array(F.when(F.col("t") > 1, F.lit("two_types")), F.when(F.col("s") > 1, F.lit("two_snapshots"))))).alias("rule"))
    return single.unionByName(across.groupBy("query_id", "rule").agg(F.count(F.lit(1)).alias("rows")))


def document_candidates(c: DataFrame) -> DataFrame:
    """Project documents: best score and sections by falling best score, names breaking ties."""
    own = c.filter(F.col("doc_type") != "technology")
    per = own.groupBy("query_id", "top_k", "doc_id", "doc_type", "snapshot_id", "section").agg(F.max("score").alias("score"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "section"))), lambda x: x["section"])
    return per.groupBy("query_id", "top_k", "doc_id", "doc_type", "snapshot_id").agg(F.max("score").alias("score"), ordered.alias("matched_sections"))


def chunk_candidates(c: DataFrame) -> DataFrame:
    """Technology chunks: each id once, with its best score, the first recalled among equals."""
    own = c.filter(F.col("doc_type") == "technology")
    w = W.partitionBy("query_id", "chunk_id").orderBy(F.desc("score"), "recall_rank")
    return own.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def ranked(c: DataFrame) -> DataFrame:
    """Both kinds in one order by falling score, then document and chunk id; the first ``top_k`` of each request."""
    docs = document_candidates(c).withColumn("content_mode", F.lit("full"))
    parts = chunk_candidates(c).select("query_id", "top_k", "doc_id", "doc_type", "score", "chunk_id", "title", "source", "component", "source_url", "section", "chunk_index", F.col("text").alias("content"), F.lit("chunk").alias("content_mode"))
    both = docs.unionByName(parts, allowMissingColumns=True)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", F.coalesce("chunk_id", F.lit("")))
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.col("top_k"))


def with_parents(winners: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Winners completed by their full document, and ``query_id, rule`` of those whose parent is missing or incomplete.

    Parents are read for winners only: their few keys meet the parents first, so no other
    body is grouped or moved.  Where parents have an ``id``, it must be that of the document.
    """
    winners = staged(winners, "winners")  # at most top_k a request, read for their keys and to be completed
    needed = winners.filter(F.col("content_mode") == "full").select("snapshot_id", "doc_id").distinct()
    parents = parents.join(needed, ["snapshot_id", "doc_id"], "left_semi")
    own = F.col("id") if "id" in parents.columns else F.col("doc_id")
    p = parents.withColumn("p_id", own).groupBy("snapshot_id", "doc_id").agg(F.max(F.struct(F.lit(1).alias("found"), F.col("doc_type").alias("p_type"), F.col("title").alias("p_title"), F.col("source").alias("p_source"), F.col("body").alias("p_body"), "p_id")).alias("p"))
    w = winners.join(p, ["snapshot_id", "doc_id"], "left").select("*", "p.*").drop("p")
    full = F.col("content_mode") == "full"
    rule = (
        F.when(~full, F.lit(None))
        .when(F.col("found").isNull(), "parent_missing")
        .when(_empty("p_body") | _empty("p_title") | _empty("p_source"), "parent_incomplete")
        .when(F.coalesce(F.col("p_type") != F.col("doc_type"), F.lit(True)), "parent_type")
        .when(F.coalesce(F.col("p_id") != F.col("doc_id"), F.lit(True)), "parent_id")
    )
    bad = w.select("query_id", rule.alias("rule")).filter("rule is not null").distinct()
    done = w.withColumns({"title": F.coalesce("title", "p_title"), "source": F.coalesce("source", "p_source"), "content": F.coalesce("content", "p_body")})
    return done.drop("found", "p_type", "p_title", "p_source", "p_body", "p_id"), bad


def admitted(items: DataFrame, budget: int = CONTENT_CHARS) -> DataFrame:
    """``query_id, kept, skipped``: ranks that fit in order, and ranks left out; one that doesn't fit uses nothing."""
    rows = F.array_sort(F.collect_list(F.struct("rank", F.length("content").alias("n"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"), F.array().cast("array<int>").alias("skipped"))

    def step(s, x):
        fits = s["used"] + x["n"] <= budget
        return F.struct(
            F.when(fits, s["used"] + x["n"]).otherwise(s["used"]).cast("long").alias("used"),
            F.when(fits, F.concat(s["kept"], F.array(x["rank"]))).otherwise(s["kept"]).alias("kept"),
            F.when(fits, s["skipped"]).otherwise(F.concat(s["skipped"], F.array(x["rank"]))).alias("skipped"),
        )

    return items.groupBy("query_id").agg(F.aggregate(rows, start, step).alias("b")).select("query_id", "b.kept", "b.skipped")


ITEM = ["query_id", "rank", "content_mode", "doc_id", "doc_type", "title", "source", "score", "content", "snapshot_id", "matched_sections", "chunk_id", "component", "source_url", "section", "chunk_index"]


def answer(queries: DataFrame, scored: DataFrame, chunks: DataFrame, parents: DataFrame, budget: int = CONTENT_CHARS, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Items (:data:`ITEM`) of all requests, and ``query_id, status, reasons, notices`` of each.

    Status: ``invalid`` (the request breaks the contract), ``unavailable`` (candidates or
    parents do), ``ok``.
    """
    reqs = requests(queries)
    c = staged(candidates(reqs, scored, chunks, strict), "candidates")  # read by the checks, both rankings and the notices
    bad = violations(c).select("query_id", "rule")
    good = c.join(bad.select("query_id").distinct(), "query_id", "left_anti")
    items, lost = with_parents(ranked(good), parents)
    items = staged(items.join(lost.select("query_id").distinct(), "query_id", "left_anti"), "items")
    fit = admitted(items, budget)
    marked = items.join(fit, "query_id").withColumn("in", F.array_contains("kept", F.col("rank")))
    reasons = bad.unionByName(lost).groupBy("query_id").agg(F.array_sort(F.collect_set("rule")).alias("reasons"))
    left_out = marked.filter(~F.col("in")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", omitted(F.coalesce("chunk_id", "doc_id")).alias("text")))).alias("o"))
    some = c.select("query_id").distinct().withColumn("some", F.lit(True))
    s = reqs.join(reasons, "query_id", "left").join(left_out, "query_id", "left").join(some, "query_id", "left")
    none = F.array().cast("array<string>")
    state = F.when(F.size("invalid") > 0, "invalid").when(F.col("reasons").isNotNull(), "unavailable").otherwise("ok")
    notices = F.when(
        state == "ok",
        F.concat(F.array(F.lit(DISCLAIMER)), F.when(F.col("some").isNull(), F.array(F.lit(NO_CANDIDATES))).otherwise(none), F.coalesce(F.transform("o", lambda x: x["text"]), none)),
    ).otherwise(none)
    return marked.filter("in").select(*ITEM), s.select("query_id", state.alias("status"), F.coalesce("reasons", "invalid").alias("reasons"), notices.alias("notices"))


def responses(items: DataFrame, states: DataFrame) -> DataFrame:
    """``query_id, status, response``: each answer as JSON; an item's fields that its kind lacks are left out."""
    fields = [c for c in ITEM if c not in ("query_id", "rank")]
    per = items.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.struct(*fields).alias("item")))).alias("items"))
    j = states.join(per, "query_id", "left")
    body = F.struct(F.coalesce(F.transform("items", lambda x: x["item"]), F.array()).alias("items"), "notices")
    return j.select("query_id", "status", F.to_json(body).alias("response"))


def lexical_rerank(queries: DataFrame, recalled: DataFrame, chunks: DataFrame) -> DataFrame:
    """``query_id, recall_rank, chunk_id, score``: a stand-in for a model, the share of common words and ideographs.

    Tokens are made once per query and once per chunk, before they are paired.
    """
    q = queries.select("query_id", tx.lexical_tokens(F.col("query")).alias("qt"))
    c = chunks.select("chunk_id", tx.lexical_tokens(F.col("text")).alias("ct"))
    pairs = recalled.select("query_id", "recall_rank", "chunk_id").distinct()
    return pairs.join(q, "query_id").join(c, "chunk_id").select("query_id", "recall_rank", "chunk_id", F.round(tx.lexical_score(F.col("qt"), F.col("ct")), 6).alias("score"))


def search_one(queries: DataFrame, scored: DataFrame, chunks: DataFrame, parents: DataFrame, budget: int = CONTENT_CHARS) -> DataFrame:
    """The items of a single request; raises where it is invalid or can't be answered."""
    items, states = answer(queries, scored, chunks, parents, budget)
    rows = states.collect()
    for r in rows:
        if r.status == "invalid":
            raise RequestInvalid(", ".join(r.reasons))
        if r.status == "unavailable":
            raise KnowledgeUnavailable(", ".join(r.reasons))
    return items
