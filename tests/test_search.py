"""Recall, ranking, answers, browsing, pages."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.errors import KnowledgeUnavailable, RequestInvalid
from quillstone.functions import html as hx
from quillstone.operators import browse, ordering, recall, vectors
from quillstone.operators import retrieval as rt

SNAP = "a" * 64
CHUNK = "chunk_id string, doc_id string, doc_type string, title string, section string, chunk_index int, source string, component string, source_url string, snapshot_id string, text string"


def project(cid, doc, section, kind="runbook", snap=SNAP):
    return (cid, doc, kind, "T", section, 0, "s.md", "c", None, snap, "文字")


def technology(cid, text="内容", **change):
    row = dict(zip([c.split()[0] for c in CHUNK.split(", ")], (cid, "redis-tech", "technology", "Redis", "测量延迟", 0, "r.md", "redis", "https://a.example/", None, text)))
    return tuple((row | change).values())


def setup(spark, chunks, scores, doc_type=None, top_k=3, query="延迟", parents=None):
    q = spark.createDataFrame([(1, query, doc_type, top_k)], "query_id long, query string, doc_type string, top_k int")
    s = spark.createDataFrame([(1, k + 1, c, v) for k, (c, v) in enumerate(scores)], "query_id long, recall_rank int, chunk_id string, score double")
    if parents is None:
        parents = [(SNAP, "a", "runbook", "A", "a.md", "正文甲" * 3), (SNAP, "b", "architecture", "B", "b.md", "正文乙")]
    p = spark.createDataFrame(parents, "snapshot_id string, doc_id string, doc_type string, title string, source string, body string")
    return q, s, spark.createDataFrame(chunks, CHUNK), p


BASE = [project("a1", "a", "原因"), project("a2", "a", "验证"), project("b1", "b", "流程", "architecture")]


def test_documents_take_their_best_section_and_keep_the_full_body(spark):
    items = rt.search_one(*setup(spark, BASE, [("a2", 0.8), ("b1", 0.85), ("a1", 0.9)])).orderBy("rank").collect()
    assert [(r.doc_id, r.score, r.content_mode) for r in items] == [("a", 0.9, "full"), ("b", 0.85, "full")]
    assert items[0].matched_sections == ["原因", "验证"] and items[0].content == "正文甲" * 3 and items[0].title == "A"


def test_mixed_ranking(spark):
    chunks = [*BASE, technology("t1"), technology("t2")]
    items = rt.search_one(*setup(spark, chunks, [("a1", 0.9), ("b1", 0.82), ("t1", 0.88), ("t2", 0.85)])).orderBy("rank").collect()
    assert [r.score for r in items] == [0.9, 0.88, 0.85] and [r.content_mode for r in items] == ["full", "chunk", "chunk"]


def test_chunk_dedup_ties_and_budget_without_back_fill(spark):
    chunks = [technology("t1", "x" * 10), technology("t2", "y" * 100), technology("t3", "z" * 10), technology("t4", "w" * 5)]
    args = setup(spark, chunks, [("t1", 0.5), ("t1", 0.9), ("t2", 0.9), ("t3", 0.9), ("t4", 0.1)])
    items, states = rt.answer(*args, budget=50)
    assert [r.chunk_id for r in items.orderBy("rank").collect()] == ["t1", "t3"]
    s = states.first()
    assert s.status == "ok" and s.notices[0] == rt.DISCLAIMER and len(s.notices) == 2 and "t2" in s.notices[1]
    body = rt.responses(items, states).first().response
    assert '"content_mode":"chunk"' in body and "matched_sections" not in body


def test_filter_and_no_candidates(spark):
    args = setup(spark, [*BASE, technology("t1")], [("a1", 0.9), ("t1", 0.95)], doc_type="technology", top_k=1)
    assert [r.chunk_id for r in rt.search_one(*args).collect()] == ["t1"]
    args = setup(spark, BASE, [("a1", 0.9)], doc_type="technology")
    items, states = rt.answer(*args)
    assert items.count() == 0 and states.first().notices == [rt.DISCLAIMER, rt.NO_CANDIDATES]


@pytest.mark.parametrize(
    ("chunk", "score", "rule"),
    [
        (technology("t1", title=None), 0.5, "technology"), (technology("t1", source_url=""), 0.5, "technology"), (technology("t1", chunk_index=-1), 0.5, "technology"),
        (technology("t1", text=" "), 0.5, "text"), (technology("t1", section=""), 0.5, "identity"), (technology("t1", doc_type="faq"), 0.5, "doc_type"),
        (technology("t1"), float("nan"), "score"), (technology("t1"), float("inf"), "score"), (technology("t1"), None, "score"),
        (project("t1", "a", "x", snap="../../elsewhere"), 0.5, "snapshot_id"), (project("t1", "a", "x", snap="b" * 64), 0.5, "two_snapshots"),
        (project("t1", "a", "x", "architecture"), 0.5, "two_types"), (technology("other"), 0.5, "text"),
    ],
)
def test_one_bad_candidate_makes_the_request_unavailable(spark, chunk, score, rule):
    args = setup(spark, [*BASE, chunk], [("a1", 0.9), ("t1", score)], top_k=1)
    with pytest.raises(KnowledgeUnavailable, match=rule):
        rt.search_one(*args)


def test_parents_must_be_there_and_complete(spark):
    for parents, rule in (
        ([(SNAP, "b", "architecture", "B", "b.md", "x")], "parent_missing"), ([(SNAP, "a", "runbook", "A", "a.md", None)], "parent_incomplete"),
        ([(SNAP, "a", "architecture", "A", "a.md", "x")], "parent_type"),
    ):
        with pytest.raises(KnowledgeUnavailable, match=rule):
            rt.search_one(*setup(spark, BASE, [("a1", 0.9)], parents=parents))


@pytest.mark.parametrize("change", [{"query": None}, {"query": " 　"}, {"query": "x" * 2001}, {"doc_type": "faq"}, {"top_k": 0}, {"top_k": 6}])
def test_requests(spark, change):
    with pytest.raises(RequestInvalid):
        rt.search_one(*setup(spark, BASE, [("a1", 0.9)], **change))


def test_a_missing_top_k_is_three(spark):
    assert rt.requests(spark.createDataFrame([(1, " q ", None, None)], "query_id long, query string, doc_type string, top_k int")).first()[1:4] == ("q", None, 3)


@pytest.mark.parametrize("block", [3, 4096])
def test_recall_equals_brute_force(spark, block):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 8))
    v[7] = v[8]
    rows = [(i, v[i].tolist(), i % 3) for i in range(300)] + [(900, None, 0), (901, [0.0] * 8, 0), (902, [1.0], 0)]
    corpus = spark.createDataFrame(rows, "id long, embedding array<double>, label int").repartition(5)
    queries = spark.createDataFrame([(i, v[i].tolist(), "zero" if i % 40 == 0 else None) for i in range(0, 300, 20)] + [(950, [0.0] * 8, None)], "query_id long, embedding array<double>, filter string")
    got = {}
    for r in recall.recall(queries, corpus, 5, {"zero": F.col("label") == 0}, block).collect():
        got.setdefault(r.query_id, []).append((r.recall_rank, r.id))
    u = v / np.linalg.norm(v, axis=1)[:, None]
    for q in range(0, 300, 20):
        s = u @ u[q]
        pool = [i for i in range(300) if q % 40 or i % 3 == 0]
        want = sorted(pool, key=lambda i: (-round(s[i], 12), i))[:5]
        assert [i for _, i in sorted(got[q])] == want
    assert 950 not in got


def test_cosine_column(spark):
    d = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in d.select(recall.cosine(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - 0.5**0.5) < 1e-12 and got[1] is None


def test_positions_and_pages(spark):
    rows = [(random.Random(i).randint(0, 9), i) for i in range(500)]
    d = spark.createDataFrame(rows, "k int, id int").repartition(7)
    got = [r.id for r in ordering.with_position(d, [F.col("k"), F.col("id")]).orderBy("position").collect()]
    assert got == [i for _, i in sorted(rows)]
    p = ordering.page(d, [F.col("k"), F.col("id")], 50, 10).orderBy("row_no").collect()
    assert [r.row_no for r in p] == list(range(491, 501)) and [r.id for r in p] == got[490:]
    assert ordering.page(d, [F.col("k"), F.col("id")], 51, 10).first().row_no == 1
    assert ordering.page(d.limit(0), [F.col("k")], 1, 10).count() == 0
    with pytest.raises(ValueError):
        ordering.page(d, [F.col("k")], 1, 7)


def test_browsing(spark):
    rows = [("c1", "d1", "Redis 延迟", None, "technology"), ("c2", "d1", "x", "redis", None), ("C-REDIS", None, None, "redis", "runbook")]
    d = spark.createDataFrame(rows, "chunk_id string, doc_id string, text string, component string, doc_type string").withColumn("chunk_index", F.lit(None).cast("int"))
    assert tuple(browse.totals(d).first()) == (3, 2, 2, 3)
    assert {(r.facet, r.value): r.n for r in browse.facets(d).collect()}[("component", "redis")] == 2
    assert {r.chunk_id for r in browse.filtered(d, " REDIS ").collect()} == {"c1", "C-REDIS"}
    assert browse.filtered(d, "  ", component="redis").count() == 2
    assert browse.filtered(d, doc_type=browse.UNKNOWN).first().chunk_id == "c2"
    assert browse.filled(d).filter("chunk_index = 0").count() == 3


def test_html():
    page = (
        "<html><nav>menu</nav><article><h1>标题<a class='anchor-link'>#</a></h1><div class='toc'>x</div><p>第一 <b>段</b> <a href='u'>链接</a><img src='i'></p>"
        "<ul><li>一</li><li>二<ol><li>甲</li></ol></li></ul><pre>a\n  b</pre><table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td>2</td></tr></table>"
        "<script>var x;</script></article></html>"
    )
    got = hx.markdown_of(page)
    assert got.startswith("# 标题\n") and "menu" not in got and "var x" not in got and "toc" not in got
    assert "第一 **段** 链接" in got and "* 一\n* 二" in got and "1. 甲" in got and "```\na\n  b\n```" in got and "| k | v |\n| --- | --- |\n| 1 | 2 |" in got
    assert hx.markdown_of("<p>x</p>", "T") == "# T\n\nx" and hx.markdown_of(None) is None
    assert hx.without_contents(["## 目录", "* a", "", "* b", "## A", "x"]) == ["## A", "x"]


def test_html_columns(spark):
    d = spark.createDataFrame([("<main><h1> A <i>b</i></h1>z</main><a href=\"/m/x.html\">L <b>1</b></a><p>about</p>",), ("<div></div>",)], "h string")
    a = d.select(hx.container(F.col("h")), hx.page_title(F.col("h")), hx.anchors(F.col("h"))).collect()
    assert a[0][0] == "<h1> A <i>b</i></h1>z" and a[0][1] == "A b" and tuple(a[0][2][0]) == ("/m/x.html", "L 1")
    assert a[1][0] is None and a[1][1] is None
    x = d.limit(1).select(hx.description_after("h", F.lit("/m/x.html")), hx.resolved(F.lit("https://a.example/q/"), F.lit("../m"))).first()
    assert tuple(x) == ("about", "https://a.example/m")


def test_index_recall(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(12, 16))
    v = centre[rng.integers(0, 12, 3000)] + 0.6 * rng.normal(size=(3000, 16))
    rows = [(i, v[i].tolist()) for i in range(3000)] + [(9000, None), (9001, [0.0] * 16), (9002, [1.0])]
    corpus = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(4)
    queries = corpus.filter("id % 20 = 0 and id < 3000").select(F.col("id").alias("query_id"), "embedding")
    centres, probes = vectors.fit(corpus, sample_rows=1000)
    assert probes < len(centres)
    index = vectors.assigned(corpus, centres)
    assert index.count() == 3000
    got = vectors.search(queries, index, centres, probes=probes, slice_rows=50)
    assert vectors.quality(got, recall.recall(queries, corpus)).first().recall >= 0.9
    assert got.groupBy("query_id").count().filter("count <> 20").count() == 0
    whole = vectors.search(queries, index, centres, probes=len(centres))
    assert vectors.quality(whole, recall.recall(queries, corpus)).first().recall == 1.0
    nothing, _ = vectors.fit(corpus.limit(0))
    assert vectors.search(queries, vectors.assigned(corpus, nothing), nothing).count() == 0


def test_a_deep_page_comes_from_the_sorted_copy(spark, monkeypatch):
    monkeypatch.setattr(ordering, "NEAR_ROWS", 0)
    rows = [(random.Random(i).randint(0, 9), i) for i in range(500)]
    d = spark.createDataFrame(rows, "k int, id int").repartition(7)
    for number in (1, 13, 14, 25, 26):
        got = ordering.page(d, [F.col("k"), F.col("id")], number, 20).orderBy("row_no").collect()
        start = 20 * (number - 1) if number < 26 else 0
        assert [r.row_no for r in got] == list(range(start + 1, start + 21)) and [(r.k, r.id) for r in got] == sorted(rows)[start : start + 20]


def test_queries_of_several_dimensions_find_their_own(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0])], "id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.1]), (2, [1.0, 0.0, 0.2]), (3, [1.0])], "query_id long, embedding array<double>")
    assert {(r.query_id, r.id) for r in recall.recall(queries, corpus, 5).collect()} == {(1, 1), (1, 2), (2, 3)}


def test_strict_candidates_and_scores_that_are_no_numbers(spark):
    q, s, c, p = setup(spark, [*BASE, technology("t1")], [("a1", 0.9), ("t1", 0.95)], doc_type="technology", top_k=1)
    assert rt.answer(q, s, c, p, strict=True)[1].first().reasons == ["filter"]
    s = s.withColumn("score", F.when(F.col("chunk_id") == "t1", "0.95").otherwise("high"))
    assert [r.chunk_id for r in rt.search_one(q, s, c, p).collect()] == ["t1"]
    q = q.withColumn("doc_type", F.lit(None).cast("string"))
    assert rt.answer(q, s, c, p)[1].first().reasons == ["score"]


def test_a_parent_with_another_id_is_not_served(spark):
    q, s, c, p = setup(spark, BASE, [("a1", 0.9)])
    assert rt.search_one(q, s, c, p.withColumn("id", F.col("doc_id"))).count() == 1
    with pytest.raises(KnowledgeUnavailable, match="parent_id"):
        rt.search_one(q, s, c, p.withColumn("id", F.lit("other")))


@pytest.mark.parametrize(
    ("text", "invalid"),
    [
        ('{"query": "q", "top_k": 2}', []), ('{"query": "q", "doc_type": null}', []), ('{"query": "q", "top_k": "2"}', ["type_top_k"]), ('{"query": "q", "top_k": 2.0}', ["type_top_k"]),
        ('{"query": "q", "top_k": true}', ["type_top_k"]), ('{"query": "q", "top_k": null}', ["type_top_k"]), ('{"query": "q", "limit": 2}', ["unknown_key"]), ('{"query": 5}', ["type_query"]),
        ("{}", ["query"]), ('["q"]', ["json", "query"]), ("{", ["json", "query"]), (None, ["json", "query"]), ('{"query": "q", "top_k": 9}', ["top_k"]), ('{"query": "q", "doc_type": "faq"}', ["doc_type"]),
    ],
)
def test_json_requests(spark, text, invalid):
    got = rt.json_requests(spark.createDataFrame([(1, text)], "query_id long, request string")).first()
    assert got.invalid == invalid


def test_body_as_container_and_json(spark):
    from quillstone.functions import text as tx

    d = spark.createDataFrame([("<body><p>x</p></body>", {"b": "é", "a": '"'})], "h string, m map<string,string>")
    r = d.select(hx.container(F.col("h")), hx.container(F.col("h"), body=True), tx.sorted_json(F.col("m")), tx.sorted_json(F.col("m"), indent=True), tx.parsed_json(tx.sorted_json(F.col("m")))).first()
    assert r[0] is None and r[1] == "<p>x</p>" and r[2] == '{"a":"\\"","b":"é"}' and r[3].startswith('{\n  "a"') and r[4] == {"a": '"', "b": "é"}


def test_positions_of_all_partitions(spark, monkeypatch):
    monkeypatch.setattr(ordering, "MOST_PARTITIONS", 1, raising=False)
    d = spark.range(200).repartition(5)
    assert [r.position for r in ordering.with_position(d, [F.col("id")]).orderBy("id").collect()] == list(range(1, 201))
