"""Look-alike forms, splitting, tokens and residue."""

import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.llm import arrowtext as at
from quillstone.llm import lookalike as la
from quillstone.llm import residue, splitting
from quillstone.llm import tokens as tk
from quillstone.operators.sections import formatted


def slow_form(s):
    s = s.replace("\r\n", "\n").replace("\r", "\n")
    out = []
    for c in s:
        o = ord(c)
        out.append(la._folded(c) if o < la.TOP else "" if 0xE0000 <= o <= 0xE0FFF else c)
    return unicodedata.normalize("NFC", "".join(out))


SIGNS = "ab Ａȩ́́̈eе​­　 ﬁ㎏⼀\r\n한한😀\U000e0041ΑΒµ̈́"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(SIGNS) | st.characters(codec="utf-8"), max_size=12), max_size=6))
def test_forms_equal_a_per_character_version(rows):
    c, o = la.fold(*at.from_strings(rows))
    assert at.to_arrow(c, o).to_pylist() == [slow_form(r) for r in rows]


def test_form_is_stable_and_keeps_visible_differences():
    for s in ("Ｑuartz", "café", "Kelvin K", "⼿册", "ѕсоре", "a b", "conﬁg"):
        assert la.fold_string(la.fold_string(s)) == la.fold_string(s)
    assert la.fold_string("ｑｕａｒｔｚ-４６Ｍ") == "quartz-46M"
    assert la.fold_string("Ｒück") == "Rück"
    assert la.fold_string("A") != la.fold_string("a")
    assert la.fold_string("：") != la.fold_string(":")
    assert la.fold_string("門") != la.fold_string("门")
    assert la.fold_string("\u06dd12") != la.fold_string("12") and la.fold_string("\u200f12") == "12"


def test_lookalike_pairs(spark):
    rows = [(1, "A b", None), (2, "Ａ b", "x"), (3, "A b", ""), (4, "a b", "​"), (5, None, "x"), (1, "A b", None), (None, "A　b", "x")]
    df = spark.createDataFrame(rows, "row_id long, title string, body string").withColumn("field", F.lit("clash"))
    got = {tuple(r) for r in la.lookalike_pairs(df, "row_id", ["title", "body"]).collect()}
    assert got == {("title", 1, 2), ("title", 2, 3), ("body", 3, 4)}
    assert la.lookalike_pairs(df.limit(0), "row_id", ["title"]).count() == 0
    classes = la.lookalike_classes(df, "row_id", ["title"]).collect()
    assert len(classes) == 4 and {r.stored_forms for r in classes if r.row_id in (1, 2, 3)} == {2}


BODY = "# T\n\nintro\n\n## 一\n\n" + "句子一二三四五六七八九十。" * 60 + "\n\n### 甲\n\n" + "词" * 900 + "\n\n## Short\n\nok\n\n## Empty\n\n## 表\n\n| a | b |\n| --- | --- |\n" + "".join(f"| 键{i} | {'值' * 40} |\n" for i in range(30)) + "\n## Code\n\n```sh\n" + "echo line\n" * 120 + "```\n"


def test_pieces_keep_the_limit_and_the_index_has_no_gaps(spark):
    rows = [(1, BODY), (2, None), (3, ""), (4, "no heading"), (5, "# only"), (1, BODY), (6, "# T\r\n## A\r\nx\r\n")]
    df = spark.createDataFrame(rows, "row_id long, body string").withColumn("piece", F.lit("clash"))
    got = splitting.split_records(df).collect()
    assert all(r.within_limit for r in got)
    one = [r for r in got if r.row_id == 1]
    assert sorted(r.chunk_index for r in one) == sorted(list(range(len(one) // 2)) * 2)
    assert all(r.complete for r in got)
    assert {r.section for r in one} == {"概述", "一", "一 / 甲", "Short", "表", "Code"}
    assert {(r.row_id, r.section_no) for r in splitting.oversized_sections(df).collect()} == {(1, 1), (1, 3), (1, 4)}
    assert [r.piece for r in got if r.row_id == 6] == ["x"]
    assert splitting.split_records(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        splitting.split_records(df, overlap_ratio=0.5)


def test_tables_repeat_their_header_and_keep_each_row():
    table = BODY[BODY.index("| a") : BODY.index("\n## Code")].strip("\n")
    parts = [x[1] for x in splitting.pieces("T", "表", table)]
    assert len(parts) > 2 and all(p.startswith("| a | b |\n| --- | --- |") for p in parts)
    rows = [line for p in parts for line in p.split("\n")[2:]]
    assert rows == table.split("\n")[2:]


def test_code_keeps_its_fences():
    code = BODY[BODY.index("```sh") :].strip("\n")
    parts = [x[1] for x in splitting.pieces("T", "Code", code)]
    assert all(p.startswith("```sh\n") and p.rstrip().endswith("```") for p in parts)
    assert sum(p.count("echo line") for p in parts) == 120


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["短句。", "A sentence here. ", "没有标点的一段长文字" * 6, "\n\n", "- item; ", "x" * 90, "\n"]), min_size=1, max_size=80))
def test_without_overlap_nothing_is_lost(parts):
    text = "".join(parts).strip("\n")
    if not text.strip():
        return
    got = splitting.cut(text, 200, 0)
    assert "".join(text[a:b] for a, b in got) == text
    assert all(b - a <= 200 for a, b in got)
    for path, piece, _, _ in splitting.pieces("T", "s", text, limit=230):
        assert len(formatted("T", path, piece)) + 2 <= 230


def test_an_edit_changes_neighbouring_pieces_only():
    rng = random.Random(4)
    text = "".join("".join(rng.choice("天地玄黄宇宙洪荒") for _ in range(rng.randint(8, 30))) + "。" for _ in range(300))
    a = {text[x:y] for x, y in splitting.cut(text, 400, 0)}
    edited = text[:1500] + "改动" + text[1500:]
    b = {edited[x:y] for x, y in splitting.cut(edited, 400, 0)}
    assert len(a - b) <= 4 and len(a) > 12


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["短句。", "A sentence here, with a clause. ", "没有标点的一段长文字" * 6, "\n\n", "- item; ", "word " * 30, "\n"]), min_size=30, max_size=80))
def test_pieces_overlap_by_no_more_than_asked_and_hold_everything(parts):
    text = "".join(parts).strip("\n")
    got = splitting.pieces("T", "s", text, limit=230)
    room = 230 - len(formatted("T", "s", "")) - 2
    assert splitting.complete(text, [(a, b) for _, _, a, b in got])
    shared = [x[3] - y[2] for x, y in zip(got, got[1:])]
    assert all(0 <= n <= int(room * 0.12) for n in shared)
    assert all(n > 0 or not text[x[2] : x[3]].strip() for n, x in zip(shared, got))
    assert not splitting.complete(text + "\n\nlost", [(a, b) for _, _, a, b in got])


def test_an_overlap_takes_sentences_then_clauses_then_words_then_characters():
    def shared(text):
        got = splitting.pieces("T", "s", text, limit=230)
        return [text[y[2] : x[3]] for x, y in zip(got, got[1:])]

    assert all(s == "整句完。" for s in shared("甲乙丙丁戊己庚辛壬癸" * 2 + "。整句完。" * 60) if len(s) < 8)
    assert all(s[:4] in ("many", "word", "and ") for s in shared("many words and " * 100))
    assert {len(s) for s in shared("字" * 1000)} == {int((230 - len(formatted("T", "s", "")) - 2) * 0.12)}


def test_token_counts_equal_the_library():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = tk.read_ranks(tk.TOKENIZER)
    enc = tiktoken.Encoding("own", pat_str=tk.PATTERN, mergeable_ranks=ranks, special_tokens={})
    count = tk.Counter("test", ranks)
    rng = random.Random(2)
    for _ in range(1500):
        s = "".join(rng.choice(list("ab aAb  \n\t.é中文😀123's") + ["quartz", "配置"]) for _ in range(rng.randint(0, 40)))
        assert count(s) == len(enc.encode_ordinary(s))
    assert count("a" * 3000) == len(enc.encode_ordinary("a" * 3000))


def test_token_budget_adds_up(spark):
    rows = [(1, "one two three", " Redis"), (2, None, "redis"), (3, "", None), (4, "一二三", "REDIS "), (5, "x" * 20000, "my-sql"), (5, "x" * 20000, "my-sql")]
    df = spark.createDataFrame(rows, "id long, text string, c string").withColumn("tokens", F.lit(1))
    out = {(r.dimension, r.value): (r.documents, r.tokens) for r in tk.token_budget(df, "id", "text", {"component": tk.regular(F.col("c"))}).collect()}
    count = tk.Counter("test", tk.read_ranks(tk.TOKENIZER))
    n = {i: count(t or "") for i, t, _ in rows}
    assert out[("component", "redis")] == (3, n[1] + n[4])
    assert out[("component", None)] == (1, 0)
    assert out[("component", "my_sql")] == (2, 2 * n[5])
    assert out[("all", None)] == (6, n[1] + n[4] + 2 * n[5])
    assert tk.with_tokens(df.limit(0), ["id"], "text").count() == 0


def test_counts_of_two_vocabularies_of_one_name_stay_apart(spark, tmp_path):
    import base64

    paths = []
    for folder, extra in (("a", []), ("b", [b"ab", b"abab"])):
        (tmp_path / folder).mkdir()
        tokens = [bytes([i]) for i in range(256)] + extra
        paths.append(tmp_path / folder / "same.tiktoken")
        paths[-1].write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(tokens)))
    df = spark.createDataFrame([(1, "abab")], "id long, text string").coalesce(1)
    assert [tk.with_tokens(df, ["id"], "text", str(p)).first().tokens for p in (*paths, paths[0])] == [4, 1, 4]


def test_labels(spark):
    df = spark.createDataFrame([("zh-CN", "HTTPS://A.example:80/x"), (" EN ", "ftp://b"), ("", None)], "l string, u string")
    assert [tuple(r) for r in df.select(tk.language(F.col("l")), tk.host(F.col("u"))).collect()] == [("zh", "a.example"), ("en", None), (None, None)]


NATURAL = [
    "检查 {a} 与 {b} 之间的调用：达到 {n} 时，先于磁盘写满出现。", "The pool resize on {a} cut tail latency by {n}%, but {b} kept rows pending.",
    "管理界面需要浏览器启用 JavaScript，否则 {a} 面板为空白；命令行工具不受影响。", "接口返回 404 只说明 {a} 被拒绝，页面提示“页面不存在”时应先核对路由 {b}。",
    "In a template, `{{{{word}}}}` marks a variable that rendering replaces with the value of {a}.", "将分片迁移拆成 {n} 步执行，由 {a} 确认后继续。",
]


def test_residue_is_found_and_explanations_stay(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        s = [rng.choice(NATURAL).format(a=rng.choice(["order-sync", "cedar-gate", "tundra-keeper"]), b="latch_offset", n=rng.randint(1, 999)) for _ in range(6)]
        rows.append((i, f"T{i}", "# T\n\n" + "\n\n".join(s) + "\n\n```\nimage: {{ .Values.x }}\nlorem ipsum dolor sit amet\n```\n"))
    bad = [
        "请启用 JavaScript 以继续访问本站。", "# 404 Not Found\n\nRef 12", "依赖 ${LIMIT_SLOT} 与 @@unlock@@。", "正文待补充，示例文字；", "Owner [SEAL FLOOR] / since __TRIM__",
        "Tempor lorem enim aliqua voluptate fugiat quis eiusmod velit exercitation", "服务：<在此输入灰度放量>", "l​orem іpsum dolor sіt amet elit",
    ]
    rows += [(1000 + k, None, rows[k][2] + "\n\n" + t) for k, t in enumerate(bad)]
    rows += [(2000, None, None), (2001, "", ""), (2002, "x", "```\n请启用 JavaScript 以继续访问本站。\n```"), (2003, "加载中", "正常的说明。")]
    df = spark.createDataFrame(rows, "row_id long, title string, body string").withColumn("coverage", F.lit(1))
    got = {r[0] for r in residue.excluded(df, "row_id", ["title", "body"]).collect()}
    assert got == set(range(1000, 1000 + len(bad))) | {2003}
    full = {r.id: r for r in residue.residue(df, "row_id", ["title", "body"]).collect()}
    assert full[2000].prose_chars == 0 and full[2000].coverage == 0.0 and 0 < full[1003].coverage < 0.2
    assert residue.residue(df.limit(0), "row_id", ["body"]).count() == 0


def plain_text(rng, n):
    words = "queue latch shard commit gate replica offset lease drain probe quota ledger 租约 偏移 回切 预热 磁盘 副本 水位 切换 扩容".split()
    return "\n\n".join(" ".join(rng.choice(words) for _ in range(12)) + "." for _ in range(n))


def test_a_notice_page_in_a_third_of_all_rows_is_still_residue(spark):
    rng = random.Random(6)
    pages = ["请启用 JavaScript 以继续访问本站。", "Please enable JavaScript to view this page.", "# 404 Not Found\n\nThe requested URL was not found on this server.", "页面不存在"]
    for page in pages:
        rows = [(i, plain_text(rng, 6)) for i in range(200)]
        rows += [(1000 + i, page) for i in range(100)] + [(2000 + i, plain_text(rng, 5) + "\n\n" + page) for i in range(100)]
        df = spark.createDataFrame(rows, "row_id long, body string")
        assert {r[0] for r in residue.excluded(df, "row_id", ["body"]).collect()} == {i for i, _ in rows if i >= 1000}, page
    rows = [(i, "## Zugriff\n\n" + plain_text(rng, 6)) for i in range(200)] + [(1000 + i, plain_text(rng, 5) + " at {{gate_name}} " + plain_text(rng, 1)) for i in range(100)]
    assert residue.excluded(spark.createDataFrame(rows, "row_id long, body string"), "row_id", ["body"]).count() == 100


def test_residue_in_cells_fields_and_at_the_end_of_a_line(spark):
    rng = random.Random(7)
    bad = [
        "| 容量 | TBD |", "| 容量 | 待补充 | 12 |", "负责人：待补充", "Owner: TODO", "Contact - TBD", "备注 —— 待补充", "Hinweis: Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.",
        "Deployment overview Please enable JavaScript to view this page.", "部署概览 请启用 JavaScript 以继续访问本站。", "磁盘水位 此处为占位内容，待补充。",
    ]
    good = [
        "| 502 | Bad Gateway | 上游未响应 |", "| TBD | 尚未确定，评审之后再填写数值 |",
        "缺失章节标为待补充，评审时处理。", "|TBD|尚未确定，评审之后再填写数值|", "the todo list is kept in the tracker: see there", "状态码：200",
        "With scripts disabled the main area of the panel stays blank for as long as the gate drains its shard, and then the frame of it says Please enable JavaScript to view this page.",
    ]
    rows = [(i, plain_text(rng, 6)) for i in range(200)]
    rows += [(1000 + i, plain_text(rng, 5) + "\n\n" + t) for i, t in enumerate(bad)] + [(2000 + i, plain_text(rng, 5) + "\n\n" + t) for i, t in enumerate(good)]
    rows += [(3000 + i, plain_text(rng, 5) + f"\n\n{rng.choice(['queue', 'gate', '磁盘'])} {i}: TBD") for i in range(100)]
    got = {r[0] for r in residue.excluded(spark.createDataFrame(rows, "row_id long, body string"), "row_id", ["body"]).collect()}
    assert got == {1000 + i for i in range(len(bad))} | set(range(3000, 3100))


def test_unknown_grams_weigh_alike_at_every_size():
    n = np.arange(residue.CELLS) % 40
    for times in (1, 100):
        ratio = residue.ratios((n * times, n * times, n * times))
        for kind, (view, p) in residue.fitted().items():
            if view != 2 and kind in ratio:
                assert (ratio[kind][p == 0] <= residue.UNKNOWN * residue.STEP).all()


# Wordings written apart from the grammars the models are fitted on.
UNSEEN = """
Without JavaScript this dashboard cannot render its panels.
Your settings prevent our scripts from running here.
Give us a second, the content is on its way.
We looked everywhere but that address is empty.
The article was taken offline by its owner.
Sorry, you cannot see this folder with your current role.
Sign in with your work account to open the file.
You were signed out, start a new session to go on.
Too much traffic from your side, pause for a minute.
An upstream component failed, try once more.
503 Service Temporarily Unavailable
408 Request Timeout
We are upgrading the portal, come back tonight.
Bot check: tick the box to go on.
网页脚本被您的设置拦截
页面组件载入失败，刷新试试
该地址没有任何内容
文档已被移到回收站
您的角色不能查看本文件夹
登录状态丢失，请再次登录
短时间内访问次数过多，歇会儿吧
服务正在升级，今晚恢复
Ohne JavaScript lässt sich diese Ansicht nicht laden.
Unter dieser Adresse wurde nichts gefunden.
Melden Sie sich an, damit Sie die Datei öffnen können.
Short description to follow.
Your headline here
Body copy will be supplied by marketing.
This box is still waiting for its content.
Fill me in!
FIXME explain the failover
To be announced
Ut enim ad minim veniam, quis nostrud.
本章留空，等待补全
标题占位
写点什么吧
（内容待定）
后续由平台组补写
Beispielabsatz, vor Veröffentlichung löschen.
Noch kein Inhalt vorhanden
Notify {{on_call.name}} at once
Root is ${BASE_DIR}/data
交给【负责人】确认
Send it to [insert address]
Version @@release_tag@@ only
"""


def test_wordings_that_the_models_have_not_seen(spark):
    """27 of 45 are found, and no plain sentence, as the README states."""
    rng = random.Random(8)
    unseen = UNSEEN.strip().split("\n")
    plain = [
        "Use %d and %s as format signs.", "The handler returns 404 when the shard is missing and 503 while the lease is renewed.", "When scripts are disabled the chart stays empty; the table below still works.",
        "Rate limiting answers with 429 and a Retry-After header.", "The gateway closed the connection after 30 s because the upstream was draining.", "We mark missing sections as TBD until the review is done.",
        "Replace the disk before the next drain window.", "若返回 403，先检查角色绑定再重试。", "服务不可用期间，写入会排队等待。", "登录之后，会话令牌保存三十分钟。", "Zugriff auf die Tabelle erhält nur die Betriebsgruppe.", "Permissions", "Preconditions", "访问权限与边界",
    ]
    rows = [(i, plain_text(rng, 6)) for i in range(200)] + [(1000 + i, plain_text(rng, 5) + "\n\n" + t) for i, t in enumerate(unseen)]
    rows += [(2000 + i, plain_text(rng, 5) + "\n\n" + t) for i, t in enumerate(plain)]
    got = {r[0] for r in residue.excluded(spark.createDataFrame(rows, "row_id long, body string"), "row_id", ["body"]).collect()}
    missed = [t for i, t in enumerate(unseen) if 1000 + i not in got]
    assert not {i for i in got if i < 1000 or i >= 2000}
    assert len(missed) <= 18, (len(missed), missed)
