"""From a folder to an index to answers."""

import json

import pytest
from pyspark.sql import functions as F

from quillstone.errors import DocumentInvalid, IndexMissing, KnowledgeUnavailable
from quillstone.operators import retrieval as rt
from quillstone.plans import pipeline, preparation


def write(folder, name, meta, body):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("---\n" + "".join(f"{k}: {v}\n" for k, v in meta.items()) + "---\n\n" + body)


def test_folder_to_answers(spark, tmp_path):
    folder, root = tmp_path / "doc", f"file://{tmp_path}/index"
    project = {"id": "slow", "doc_type": "runbook", "project": "p", "service": "s", "component": "c", "deployment": "d"}
    write(folder, "runbooks/slow.md", project, "# 慢查询\n\n## 原因\n\n磁盘写满 disk full\n\n## 验证\n\n再次测量 latency")
    write(folder, "technology/redis.md", {"doc_type": "technology", "component": "redis", "source_url": "https://a.example/x"}, "# Redis\n\n## 延迟\n\nredis latency 测量")
    q = spark.createDataFrame([(1, "磁盘写满 disk", None, 2), (2, "redis latency", "technology", None), (3, " ", None, None)], "query_id long, query string, doc_type string, top_k int")
    with pytest.raises(IndexMissing):
        pipeline.search(spark, root, q)
    dry = pipeline.ingest(spark, str(folder), root, dry_run=True).first()
    assert (dry.documents, dry.parents, dry.chunks) == (2, 1, 3) and json.loads(dry.first_chunk)["chunk_id"] == "slow::section::0"
    report = pipeline.ingest(spark, str(folder), root).first()
    assert (report.chunks, report.inserted) == (3, 3)
    items, states = pipeline.search(spark, root, q)
    got = {(r.query_id, r.rank): r for r in items.collect()}
    assert got[(1, 1)].doc_id == "slow" and got[(1, 1)].content.startswith("# 慢查询") and got[(2, 1)].content_mode == "chunk"
    assert {r.query_id: r.status for r in states.collect()} == {1: "ok", 2: "ok", 3: "invalid"}
    write(folder, "bad.md", {"doc_type": "technology"}, "# T\n\n## A\n\nx")
    with pytest.raises(DocumentInvalid, match="missing_component"):
        pipeline.ingest(spark, str(folder), root)
    assert pipeline.search(spark, root, q)[0].count() == items.count()


def test_an_empty_folder_is_an_error(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "readme.md").write_text("x")
    with pytest.raises(DocumentInvalid):
        pipeline.ingest(spark, str(tmp_path), f"file://{tmp_path}/index")


def test_an_empty_index_says_so(spark, tmp_path):
    from quillstone.sources import index

    root = f"file://{tmp_path}/index"
    none = spark.createDataFrame([], "chunk_id string, doc_id string, doc_type string, title string, section string, chunk_index int, source string, component string, source_url string, text string, extra map<string,string>, embedding array<float>")
    index.sync(spark, root, none)
    _, states = pipeline.search(spark, root, spark.createDataFrame([(1, "q", None, 1)], "query_id long, query string, doc_type string, top_k int"))
    assert states.first().notices == [rt.DISCLAIMER, rt.NOTHING_INDEXED]


def test_files(spark):
    pages = spark.createDataFrame([(1, 7, "https://a.example/", "t", "<article><h1>A: b</h1><p>x</p></article>"), (2, 8, "u", "t", "<p>none</p>")], "page_id long, ordinal int, url string, title string, html string")
    got = preparation.page_files(pages, F.lit("redis")).collect()
    assert [(r.page_id, r.filename) for r in got] == [(1, "07-A--b.md")] and got[0].content.endswith("---\n\n# A: b\n\nx")
    docs = spark.createDataFrame([(1, "# One/two\n[a](b)\n# Zwei\ny")], "id long, body string")
    rows = preparation.level1_markdown(docs, "id", "body", "mysql").orderBy("file_no").collect()
    assert [r.filename for r in rows] == ["01-mysql-One-two.md", "02-mysql-Zwei.md"] and rows[0].content.endswith("# One/two\na")
    config = spark.createDataFrame([("a.md", 1), ("b.md", 2)], "source string, n int")
    rows = preparation.configured(config, spark.createDataFrame([("a.md", "x")], "source string, text string"))
    assert {r.source: r.missing for r in rows.collect()} == {"a.md": False, "b.md": True}
    assert tuple(preparation.counters(rows, ~F.col("missing")).first()) == (1, 1)


def test_a_damaged_snapshot_is_not_served(spark, tmp_path):
    folder, root = tmp_path / "doc", f"file://{tmp_path}/index"
    project = {"id": "slow", "doc_type": "runbook", "project": "p", "service": "s", "component": "c", "deployment": "d"}
    write(folder, "runbooks/slow.md", project, "# 慢查询\n\n## 原因\n\n磁盘写满 disk full")
    pipeline.ingest(spark, str(folder), root)
    q = spark.createDataFrame([(1, "磁盘写满 disk", None, 2)], "query_id long, query string, doc_type string, top_k int")
    assert pipeline.search(spark, root, q)[1].first().status == "ok"
    where = next((tmp_path / "index" / "parents").iterdir())
    damaged = spark.createDataFrame(spark.read.parquet(str(where)).withColumn("body", F.lit("other")).collect(), "doc_id string, doc_type string, title string, source string, body string")
    damaged.write.mode("overwrite").parquet(str(where))
    assert pipeline.search(spark, root, q)[1].first().status != "ok"


def test_an_index_of_another_model_is_not_searched(spark, tmp_path):
    folder, root = tmp_path / "doc", f"file://{tmp_path}/index"
    write(folder, "redis.md", {"doc_type": "technology", "component": "redis", "source_url": "https://a.example/x"}, "# Redis\n\n## 延迟\n\nredis latency 测量")
    pipeline.ingest(spark, str(folder), root, model={"name": "large", "dim": 256})
    q = spark.createDataFrame([(1, "redis", None, 2)], "query_id long, query string, doc_type string, top_k int")
    with pytest.raises(KnowledgeUnavailable):
        pipeline.search(spark, root, q)
    assert pipeline.search(spark, root, q, model={"name": "large", "dim": 256})[1].first().status == "ok"


def test_the_job(spark, tmp_path, capsys):
    from quillstone.__main__ import main

    folder, root = tmp_path / "doc", f"file://{tmp_path}/index"
    project = {"id": "slow", "doc_type": "runbook", "project": "p", "service": "s", "component": "c", "deployment": "d"}
    write(folder, "slow.md", project, "# 慢查询\n\n## 原因\n\n磁盘写满")
    args = ["--root", str(folder), "--index", root]
    assert main([*args, "--dry-run"], spark)["chunks"] == 1 and not (tmp_path / "index").exists()
    assert main(args, spark)["inserted"] == 1
    write(folder, "slow.md", project, "# 慢查询\n\n## 原因\n\n磁盘写满了")
    done = main([*args, "--prune"], spark)
    assert done["updated"] == 1 and len(done["pruned"]) == 2 and {p.split("/")[0] for p in done["pruned"]} == {"chunks", "parents"}
    assert len(list((tmp_path / "index" / "chunks").iterdir())) == 1 and json.loads(capsys.readouterr().out.split("}\n")[0] + "}")
    with pytest.raises(ValueError):
        main([*args, "--max-tokens", "0"], spark)


def test_pages_in_their_order(spark):
    got = preparation.listed(spark, [("甲", "https://a.example/1"), ("乙", "https://a.example/2")]).orderBy("ordinal").collect()
    assert [tuple(r) for r in got] == [(1, "甲", "https://a.example/1"), (2, "乙", "https://a.example/2")]
