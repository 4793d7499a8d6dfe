import time

from quillstone.streaming import arrivals


def md(doc_id, body):
    return f'---\nid: {doc_id}\ndoc_type: runbook\nproject: p\nservice: s\ncomponent: c\ndeployment: d\n---\n\n# T\n\n{body}\n'


def test_later_versions_replace_earlier_ones(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "ck"))
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.md").write_text(md("a", "one"))
    (tmp_path / "in" / "sub" / "b.md").write_text(md("b", "one"))
    (tmp_path / "in" / "bad.md").write_text("# no front matter")
    (tmp_path / "in" / "README.md").write_text("no")
    arrivals.collect_arrivals(spark, folder, out, checkpoint).awaitTermination()
    assert {r.doc_id: r.source for r in arrivals.arrived(spark, out).collect()} == {"a": "a.md", "b": "sub/b.md"}
    time.sleep(1.1)
    (tmp_path / "in" / "a2.md").write_text(md("a", "two"))
    arrivals.collect_arrivals(spark, folder, out, checkpoint).awaitTermination()
    got = {r.doc_id: r.body for r in arrivals.arrived(spark, out).collect()}
    assert got["a"] == "# T\n\ntwo" and got["b"] == "# T\n\none"
    assert [r.source for r in spark.read.parquet(f"{out}/invalid").collect()] == ["bad.md"]
