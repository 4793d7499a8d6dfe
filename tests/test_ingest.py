"""Documents, sections, chunks and the index."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.errors import DocumentInvalid, IndexMissing
from quillstone.functions import text as tx
from quillstone.operators import chunking as ch
from quillstone.operators.sections import blocks, formatted, outline, split_sections
from quillstone.sources import documents as docs
from quillstone.sources import index

TECHNOLOGY = {"doc_type": "technology", "component": "redis", "source_url": "https://Docs.Example/a.html"}
PROJECT = {"id": "r1", "doc_type": "runbook", "project": "p", "service": "s", "component": "c", "deployment": "d"}


def file_of(meta, body="# T\n\n## A\n\ntext"):
    return "---\n" + "".join(f"{k}: {v}\n" for k, v in meta.items()) + "---\n\n" + body


def parsed(spark, files):
    return docs.parse(spark.createDataFrame(files, "source string, text string"))


def errors(spark, meta, body="# T\n\n## A\n\ntext", raw=None):
    p = parsed(spark, [("a.md", raw if raw is not None else file_of(meta, body))])
    return p.select(docs.rule_breaks(p)).first()[0]


def test_scan_reads_markdown_but_no_readme(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.md").write_bytes("﻿---\r\nid: 1\r\n---\r\n# T\r\n".encode())
    (tmp_path / "a" / "ReadMe.md").write_text("no")
    (tmp_path / "a" / "y.txt").write_text("no")
    rows = docs.scan_markdown(spark, str(tmp_path)).collect()
    assert [(r.source, r.text) for r in rows] == [("a/b/x.md", "---\nid: 1\n---\n# T\n")]


def test_valid_documents_and_their_identity(spark):
    p = parsed(spark, [("t.md", file_of({**TECHNOLOGY, "weight": 0.5, "flag": "true"})), ("r.md", file_of({**PROJECT, "id": '"  r1 "'}))])
    good, bad = docs.validated(p)
    rows = {r.source: r for r in good.collect()}
    assert bad.count() == 0
    assert rows["t.md"].source_url == "https://docs.example/a.html"
    assert rows["t.md"].doc_id.startswith("technology-") and len(rows["t.md"].doc_id) == 11 + 64
    assert rows["t.md"].extra == {"weight": "0.5", "flag": "true"} and rows["t.md"].extra_types == {"weight": "float", "flag": "bool"}
    assert rows["r.md"].doc_id == "r1" and rows["r.md"].body == "# T\n\n## A\n\ntext"


def test_same_address_but_for_the_fragment_is_a_duplicate_unless_ids_differ(spark):
    p = parsed(spark, [("a.md", file_of(TECHNOLOGY)), ("b.md", file_of({**TECHNOLOGY, "source_url": "https://docs.example/a.html#x"}))])
    good, bad = docs.validated(p)
    assert docs.duplicate_ids(good).collect()[0].documents == 2
    with pytest.raises(DocumentInvalid):
        docs.raise_invalid(bad, docs.duplicate_ids(good))
    p = parsed(spark, [("a.md", file_of({**TECHNOLOGY, "id": "x"})), ("b.md", file_of({**TECHNOLOGY, "id": "y"}))])
    assert docs.duplicate_ids(docs.validated(p)[0]).count() == 0


@pytest.mark.parametrize("value", ["null", "123", '"  "', "[]"])
def test_an_optional_id_must_be_a_filled_string(spark, value):
    assert errors(spark, {**TECHNOLOGY, "id": value})


def test_rules(spark):
    assert errors(spark, TECHNOLOGY) == []
    assert errors(spark, {**TECHNOLOGY, "source_url": "docs/a.html"}) == ["bad_source_url"]
    assert errors(spark, {**TECHNOLOGY, "source_url": "https://u:p@h.example/"}) == ["bad_source_url"]
    assert errors(spark, {k: v for k, v in PROJECT.items() if k != "service"}) == ["missing_service"]
    assert errors(spark, {**TECHNOLOGY, "component": "[redis]"})
    assert errors(spark, {**TECHNOLOGY, "since": "2024-01-01"})
    assert errors(spark, {**TECHNOLOGY, "x": ".nan"})
    assert "reserved_key" in errors(spark, {**TECHNOLOGY, "title": "x"})
    assert "unknown_doc_type" in errors(spark, {**PROJECT, "doc_type": "faq"})
    assert errors(spark, TECHNOLOGY, body=" \n　") == ["empty_body"]
    assert "front_matter" in errors(spark, {}, raw="# T\n")
    assert "front_matter" in errors(spark, {}, raw="---\n[a\n---\nx")


def test_addresses(spark):
    rows = ["HTTP://A.Example", " https://a.example/P?Q=1#f ", "https://a.example:80/x?", "ftp://a", "https://", "//a/b", "https://a@b/", None]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "u string").select(tx.url_normal(F.col("u"))).collect()]
    assert got == ["http://a.example/", "https://a.example/P?Q=1", "https://a.example:80/x", None, None, None, None, None]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.sampled_from("a \t\n\r\x0b\x1c\x1f\x85\xa0　  é"), max_size=8), min_size=30, max_size=60))
def test_strip_and_lines_equal_python(spark, rows):
    got = spark.createDataFrame([(r,) for r in rows], "t string").select(tx.strip(F.col("t")), tx.lines(F.col("t"))).collect()
    assert [g[0] for g in got] == [r.strip() for r in rows]
    assert [g[1] for g in got] == [r.splitlines() for r in rows]


def test_sections():
    body = "lead\n# Title ##\n\n````\n## not one\n```\n```` x\nstill\n`````\n## A\n\ntext\n# later\n## Empty\n\n## Learn C#\n~~~\n## x\n```\n~~~\n### sub\nz\n"
    title, got = split_sections(body)
    assert title == "Title"
    assert [s for s, _ in got] == ["概述", "A", "Learn C"]
    assert got[0][1] == "lead\n\n````\n## not one\n```\n```` x\nstill\n`````"
    assert got[1][1] == "text\n# later" and got[2][1].endswith("### sub\nz")
    assert split_sections("## A\nx") is None and split_sections(None) is None
    assert outline(["#　全角"]) == [(0, 1, "全角")]


def test_an_open_fence_swallows_the_rest():
    assert split_sections("# T\n## A\n```\n## B\n")[1] == [("A", "```\n## B")]


def test_blocks():
    text = "para\nmore\n- item\n\n    code\n\n    code2\n\n| a | b |\n|---|---|\n| 1 | 2 |\nafter\n```\nx\n\ny\n```"
    kinds = [(k, text.splitlines()[a]) for k, a, b in blocks(text)]
    assert kinds == [("text", "para"), ("text", "- item"), ("code", "    code"), ("table", "| a | b |"), ("text", "after"), ("code", "```")]


def fits(title, parts, limit):
    return all(ch.characters(formatted(title, s, t)) <= limit for s, t in parts)


def test_short_sections_stay_and_long_ones_get_paths():
    assert ch.split_section("T", "超时", "短。", max_tokens=45) == [("超时", "短。")]
    body = "先看延迟。\n### 原因\n" + "连接超时。" * 3 + "\n### 验证\n" + "再次测量。" * 3
    got = ch.split_section("T", "超时", body, max_tokens=45)
    assert [s for s, _ in got] == ["超时", "超时 / 原因", "超时 / 验证"] and fits("T", got, 45)


def test_overlap_and_budget():
    parts = [f"段落{i:02d}。" for i in range(25)]
    got = ch.split_section("T", "s", "\n\n".join(parts), max_tokens=100)
    assert len(got) > 1 and fits("T", got, 100)
    assert got[0][1].split("\n\n")[-1] == got[1][1].split("\n\n")[0]
    assert {p for _, t in got for p in t.split("\n\n")} == set(parts)
    plain = "字" * 400
    assert "".join(t for _, t in ch.split_section("T", "s", plain, max_tokens=100, overlap_ratio=0)) == plain
    with pytest.raises(ValueError):
        ch.split_section("T", "s", "x", overlap_ratio=0.5)


def test_code_and_tables():
    code = "```\necho 1\n```"
    got = ch.split_section("T", "s", "文字。" * 20 + "\n\n" + code, max_tokens=100)
    assert any(code in t for _, t in got)
    for bad in ("```\n" + "x" * 200 + "\n```", "    " + "y" * 200):
        with pytest.raises(DocumentInvalid):
            ch.split_section("T", "s", bad, max_tokens=100)
    rows = [f"| 键{i} | 值{i} |" for i in range(12)]
    got = ch.split_section("T", "s", "| a | b |\n| --- | --- |\n" + "\n".join(rows), max_tokens=110)
    assert len(got) > 1 and fits("T", got, 110) and all(t.startswith("| a | b |\n| --- | --- |") for _, t in got)
    assert [r for _, t in got for r in t.split("\n")[2:]] == rows
    with pytest.raises(DocumentInvalid):
        ch.split_section("T" * 200, "s", "x" * 100, max_tokens=100)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["一句话。", "A b c. ", "长" * 70, "\n\n", "- x\n", "| a | b |\n|---|---|\n| 1 | 2 |\n\n", "### h\n"]), min_size=1, max_size=30))
def test_every_chunk_fits(parts):
    body = "".join(parts)
    if not body.strip():
        return
    try:
        got = ch.split_section("T", "s", body, max_tokens=90)
    except DocumentInvalid as e:  # a long line right above a table is its header
        assert "table" in str(e)
    else:
        assert fits("T", got, 90)


def test_chunk_rows(spark):
    rows = [(1, "runbook", "# T\n## A\nx\n## B\ny"), (2, "runbook", "# T\n## A\n" + "z" * 600), (3, "technology", "# T\n## A\n" + "句。" * 400), (4, "technology", "no"), (5, "runbook", None)]
    got = ch.chunk_rows(spark.createDataFrame(rows, "row_id long, doc_type string, body string")).collect()
    assert [(r.chunk_index, r.section, r.content) for r in got if r.row_id == 1] == [(0, "A", "x"), (1, "B", "y")]
    assert {r.row_id for r in got if r.problem} == {2, 4, 5}
    assert [r.chunk_index for r in got if r.row_id == 3] == list(range(len([r for r in got if r.row_id == 3])))
    with pytest.raises(DocumentInvalid):
        ch.raise_problems(ch.chunk_rows(spark.createDataFrame(rows, "row_id long, doc_type string, body string")))


def built(spark, files):
    good, bad = docs.validated(parsed(spark, files))
    assert bad.count() == 0
    good = good.withColumn("row_id", F.xxhash64("source"))
    rows = ch.chunk_rows(good)
    titles = rows.filter("chunk_index = 0").select("row_id", "title")
    parents = good.filter("doc_type <> 'technology'").join(titles, "row_id").select("doc_id", "doc_type", "title", "source", "body")
    return ch.make_chunks(good, rows), parents


def test_sync(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    with pytest.raises(IndexMissing):
        index.read_manifest(spark, root)
    assert index.status(spark, root).first().status == "missing"
    both = [("t.md", file_of(TECHNOLOGY)), ("r.md", file_of(PROJECT, "# T\n## A\nx\n## B\ny"))]
    a = index.sync(spark, root, *built(spark, both))
    assert (a.chunks, a.inserted, a.deleted) == (3, 3, 0) and len(a.snapshot_id) == 64
    rows = {r.chunk_id: r for r in index.read_chunks(spark, root).collect()}
    assert rows["r1::section::0"].text == "文档标题：T\n章节标题：A\n\nx" and rows["r1::section::1"].snapshot_id == a.snapshot_id
    assert [r.snapshot_id for r in rows.values() if r.doc_type == "technology"] == [None]
    assert index.read_parents(spark, root).first().body == "# T\n## A\nx\n## B\ny"
    b = index.sync(spark, root, *built(spark, [("r.md", file_of(PROJECT, "# T\n## A\nx2"))]))
    assert (b.chunks, b.updated, b.deleted) == (1, 1, 2) and b.snapshot_id != a.snapshot_id
    c = index.sync(spark, root, *built(spark, [("t.md", file_of(TECHNOLOGY))]))
    assert c.snapshot_id is None and c.chunks == 1
    assert index.status(spark, root).first().chunks == 1


def test_a_failed_sync_changes_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    index.sync(spark, root, *built(spark, [("t.md", file_of(TECHNOLOGY))]))
    chunks, parents = built(spark, [("r.md", file_of(PROJECT))])
    with pytest.raises(Exception, match="boom"):
        index.sync(spark, root, chunks.withColumn("text", F.raise_error(F.lit("boom")).cast("string")), parents)
    assert [r.doc_type for r in index.read_chunks(spark, root).collect()] == ["technology"]


def test_snapshot_digest_heeds_content_but_not_order(spark):
    rows = [(f"d{i}", "runbook", "t", "s", None if i == 3 else f"b{i}") for i in range(50)]
    d = spark.createDataFrame(rows, "doc_id string, doc_type string, title string, source string, body string")
    one = index.snapshot_digests(d, [], index.PARENT_COLUMNS).first().digest
    assert one == index.snapshot_digests(d.repartition(7), [], index.PARENT_COLUMNS).first().digest
    assert one != index.snapshot_digests(d.fillna("n"), [], index.PARENT_COLUMNS).first().digest


def test_links_and_level1_files(spark):
    d = spark.createDataFrame([(1, "pre\n# A\n[x](u) ![i](p)\n```\n[k](v)\n# no\n```\n\n\n\n# B\nz"), (2, None)], "id long, body string")
    rows = ch.level1_files(d, "id", "body").collect()
    assert [(r.file_no, r.title) for r in rows] == [(1, "A"), (2, "B")]
    text = d.filter("id = 1").select(ch.unlinked("body")).first()[0]
    assert "\nx \n" in text and "[k](v)" in text


def test_file_names(spark):
    d = spark.createDataFrame([(' a/b: "c"  d - ', 7), ("x", 123)], "t string, n int")
    got = d.select(tx.filename_spaced(F.col("t")), tx.filename_dashed(F.col("t")), tx.ordinal(F.col("n"))).collect()
    assert tuple(got[0]) == ("a-b- -c- d", "a-b---c--d", "07") and got[1][2] == "123"


def test_the_shared_folder_is_the_session_s_and_staged_tables_go(spark):
    from pathlib import Path

    from quillstone.sources import staging

    folder = staging.shared_folder(spark)
    assert folder == staging.shared_folder(spark)
    staging.clear(spark)
    assert staging.staged(spark.range(3), "some").count() == 3
    assert [p.name for p in Path(folder.removeprefix("file://")).iterdir() if p.name.startswith("some-")]
    assert staging.clear(spark) == 1 and not [p for p in Path(folder.removeprefix("file://")).iterdir() if p.name.startswith("some-")]


def test_limits_of_a_model():
    assert ch.token_limit(512, 10**30) == 512
    with pytest.raises(ValueError):
        ch.token_limit(0, 512)


def test_a_tokenizer_file_counts_with_special_tokens():
    path = "/opt/tokenizers/word_bpe_49k.json"
    pytest.importorskip("tokenizers")
    if not __import__("os").path.exists(path):
        pytest.skip("no tokenizer file")
    count, most = ch.tokenizer_from(path, {"max_seq_length": 64, "model_max_length": 128})
    assert most == 64 and count("") == 0 and count("a b c") == 3
    got = ch.split_section("T", "s", "one two three four. " * 60, count, most)
    assert len(got) > 4 and all(count(formatted("T", path, text)) <= most for path, text in got)
