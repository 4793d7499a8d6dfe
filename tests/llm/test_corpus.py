"""Near duplicates, leaks, mixtures and shared spans against brute force."""

import collections
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.llm import arrowtext as at
from quillstone.llm import leaks, mixture, shared_spans
from quillstone.llm import lookalike as la
from quillstone.llm import near_duplicates as nd
from quillstone.llm.rolling import gram_hashes, sliding_min

WORDS = ["租约", "偏移", "queue", "latch ", "回切", "shard_", "预热", "commit", "超时，", "重试。", "gate-", "负责人", "磁盘", "é", "😀", "7"]


def prose(rng, n):
    out = ""
    while len(out) < n:
        out += rng.choice(WORDS) + str(rng.randint(0, 9999))
    return out[:n]


def test_rolling_hashes_depend_on_the_gram_only():
    a, _ = at.from_strings(["xyzabcdefgh"])
    b, _ = at.from_strings(["--------abcdefgh"])
    assert gram_hashes(a, 8)[3] == gram_hashes(b, 8)[8]
    assert len(gram_hashes(a, 20)) == 0
    x = np.random.default_rng(1).integers(0, 1 << 60, 500).astype(np.uint64)
    for w in (1, 2, 7, 64, 101):
        assert (sliding_min(x, w) == [x[i : i + w].min() for i in range(len(x) - w + 1)]).all()


def shared_brute(rows, span):
    where = collections.defaultdict(set)
    for i, t in rows:
        for p in range(len(t) - span + 1):
            where[t[p : p + span]].add(i)
    out = set()
    for i, t in rows:
        hit = [False] * (len(t) + 1)
        for p in range(len(t) - span + 1):
            if len(where[t[p : p + span]]) > 1:
                hit[p : p + span] = [True] * span
        start = None
        for k, h in enumerate(hit):
            if h and start is None:
                start = k
            if not h and start is not None:
                out.add((i, start, k))
                start = None
    return out


@pytest.mark.parametrize("limit", [1, 3, 4096])
def test_shared_spans_equal_brute_force(spark, limit):
    rng = random.Random(9)
    licence = prose(rng, 150)
    stock = [prose(rng, rng.randint(20, 160)) for _ in range(6)]
    rows = []
    for i in range(60):
        t = prose(rng, rng.randint(0, 200))
        for _ in range(rng.randint(0, 3)):
            t += rng.choice(stock) + (prose(rng, rng.randint(0, 60)) if rng.random() < 0.7 else "")
        if i % 3 == 0:
            t = prose(rng, rng.randint(0, 90)) + licence + prose(rng, rng.randint(0, 90))
        rows.append((i, t))
    rows += [(100, rows[5][1]), (101, rows[5][1]), (102, "ab" * 300), (103, "x" + "ab" * 200), (104, ""), (105, "é" * 41), (106, "é" * 40)]
    df = spark.createDataFrame(rows + [(107, None), (None, stock[0] * 3), rows[3]], "doc_id long, text string").withColumn("h", F.lit("clash")).withColumn("spot", F.lit(1))
    got = {tuple(r) for r in shared_spans.shared_spans(df, span=40, group_limit=limit).collect()}
    assert got == shared_brute(rows, 40)
    if limit == 3:
        parts = {r.doc_id: r for r in shared_spans.shared_parts(df, span=40).collect()}
        assert parts[100].shared_part == 1.0 if len(rows[5][1]) >= 40 else True
        assert parts[104].shared_part == 0.0 and parts[107].n_chars == 0 and len(parts) == len(rows) + 1
        assert shared_spans.shared_spans(df.limit(0)).count() == 0


def test_golay_tables():
    syn, patterns, count = nd.golay_tables()
    words = np.random.default_rng(3).integers(0, 1 << 23, 400).astype(np.uint32)
    index, n = nd.codewords(words)
    for w, row, k in zip(words, index, n):
        near = set(row[:k].tolist())
        assert len(near) == k
        flipped = w
        for b in random.Random(int(w)).sample(range(23), 2):
            flipped ^= np.uint32(1 << b)
        other, m = nd.codewords(np.array([flipped], np.uint32))
        assert near & set(other[0, : m[0]].tolist()), "two differing bits share a codeword"


def runs(t):
    t = "".join(la.fold_string(t).split())
    return {t[k : k + 8] for k in range(len(t) - 7)} if len(t) >= 300 else set()


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for i in range(40):
        base = prose(rng, rng.randint(250, 900))
        rows.append((len(rows), base))
        for _ in range(rng.randint(0, 3)):
            t = list(base)
            for _ in range(rng.randint(1, 6)):
                p = rng.randrange(len(t))
                t[p : p + rng.randint(0, 12)] = list(prose(rng, rng.randint(0, 12)))
            rows.append((len(rows), "".join(t)))
    rows += [(900, rows[0][1]), (901, rows[0][1].replace("e", "е") + " "), (902, ""), (903, "short"), (904, "ab" * 5000), (905, "ab" * 5100)]
    want = set()
    sets = {i: runs(t) for i, t in rows}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j]):
                want.add((i, j))
    df = spark.createDataFrame(rows + [(906, None), (None, rows[0][1]), rows[1]], "row_id long, body string").withColumn("print", F.lit("clash")).withColumn("id", F.lit(7))
    got = {tuple(r) for r in nd.near_duplicate_rows(df, "row_id", "body").collect()}
    assert got == want
    groups = nd.near_duplicate_groups(df, "row_id", "body").collect()
    assert len(groups) == len(rows) + 1
    group = {r.id: r.group_id for r in groups}
    parent = {i: i for i in group}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in want:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert group == {i: find(i) for i in group}
    assert nd.near_duplicate_rows(df.limit(0), "row_id", "body").count() == 0
    assert nd.near_duplicate_groups(df.limit(0), "row_id", "body").count() == 0


def test_near_duplicates_send_no_table_through_the_driver(spark, monkeypatch):
    rng = random.Random(14)
    rows = [(3 * i + k, t) for i in range(20) for base in [prose(rng, 400)] for k, t in enumerate((base, base[:390], base))]
    df = spark.createDataFrame(rows, "row_id long, body string")
    plans, staged = [], nd.staged
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(nd, "staged", lambda x, name: plans.append((name, plan(x))) or staged(x, name))
    for made, n in ((nd.near_duplicate_rows(df, "row_id", "body"), 60), (nd.near_duplicate_groups(df, "row_id", "body"), 60)):
        plans.append(("result", plan(made)))
        assert made.count() == n
    assert {"close", "pairs", "members", "prints", "texts", "links", "result"} <= {name for name, _ in plans}
    assert [name for name, p in plans if "Broadcast" in p] == []


def test_components_of_a_long_chain(spark):
    n = 200
    pairs = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(500, 501)], "a long, b long")
    members = spark.createDataFrame([(i, i) for i in [*range(n + 1), 500, 501, 502]], "id long, rep long")
    got = {r.id: r.group for r in nd.components(pairs, members).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 500: 500, 501: 500, 502: 502}


def test_leaks_equal_brute_force(spark):
    rng = random.Random(13)
    items = [(i, prose(rng, rng.randint(30, 120))) for i in range(30)] + [(90, ""), (91, None), (None, "x"), (3, None)]
    text = {i: leaks._compared(pa.array([t or ""]))[0] for i, t in items if i is not None and t}
    docs = []
    for d in range(60):
        t = prose(rng, rng.randint(0, 300))
        if d % 3 == 0:
            s = items[rng.randrange(30)][1]
            a = rng.randint(0, 20)
            t += "\n" + "".join(c.upper() + ("​" if rng.random() < 0.2 else "") for c in s[a : a + rng.randint(30, 120)]) + prose(rng, 20)
        docs.append((d, t))
    docs += [(100, ""), (101, items[0][1]), (101, items[0][1])]
    grams = collections.defaultdict(set)
    for i, t in text.items():
        for k in range(len(t) - 39):
            grams[t[k : k + 40]].add(i)
    want = set()
    for d, t in docs:
        t = leaks._compared(pa.array([t]))[0]
        for k in range(len(t) - 39):
            want |= {(d, i) for i in grams.get(t[k : k + 40], ())}
    left = spark.createDataFrame(docs + [(102, None), (None, items[0][1])], "doc_id long, text string").withColumn("item_id", F.lit(5))
    right = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(5))
    for block in (100, 10**6):
        got = {tuple(r) for r in leaks.leaked_items(left, right, block_chars=block).collect()}
        assert got == want and want
    report = {(r.doc_id, r.item_id): r for r in leaks.leak_report(left, right).collect()}
    assert set(report) == want and all(40 <= r.longest_run <= len(text[r.item_id]) for r in report.values())
    clean = leaks.without_leaks(left, right, max_length=39, max_coverage=0.0)
    assert clean.count() == left.count()
    assert leaks.leaked_items(clean, right).count() == 0
    assert {r.doc_id for r in clean.filter("removed_chars > 0").collect()} == {d for d, _ in want} | {None}
    assert leaks.without_leaks(left, right, block_chars=100, max_length=39).filter("removed_chars > 0").count() == clean.filter("removed_chars > 0").count()
    assert leaks.leaked_items(left.limit(0), right).count() == 0 and leaks.leaked_items(left, right.limit(0)).count() == 0


def test_longest_matches():
    a, back, grams = leaks.automata(["abcdefgh", "xxabcdzz", "cdefghij"])
    found = leaks.matches("--abcdefghij--", a, 4)
    assert {k: [s[:2] for s in v] for k, v in found.items()} == {0: [(2, 10)], 1: [(2, 6)], 2: [(4, 12)]}
    assert leaks.touches("--abcdefghij--", back, grams, 8) and not leaks.touches("--abcdefghij--", back, grams, 9)
    assert [leaks.covered(found[k], k, a) for k in (0, 1, 2)] == [8, 4, 8]


def test_every_end_of_a_state_is_known():
    rng = random.Random(3)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) for _ in range(8)]
    a, _, _ = leaks.automata(strings)
    for n in (1, 2, 3):
        for word in {s[i : i + n] for s in strings for i in range(len(s) - n + 1)}:
            state = 0
            for c in word:
                state = a.step(state, c)
            want = {k: [i + n for i in range(len(s) - n + 1) if s[i : i + n] == word] for k, s in enumerate(strings)}
            assert a.holders(state) == [k for k, v in want.items() if v]
            assert all(sorted(a.ends(state, k)) == v for k, v in want.items())


def test_an_item_in_two_places_counts_with_both(spark):
    rng = random.Random(15)
    item, other = prose(rng, 100), prose(rng, 60)
    docs = spark.createDataFrame([(1, "start " + item[:45] + " | " + other + " | " + item[50:] + " end"), (1, "short"), (2, "start " + item[:45] + " end")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    n = len(leaks._compared(pa.array([item]))[0])
    got = {r.doc_id: r for r in leaks.leak_report(docs, items, run_length=30).collect()}
    part = sum(len(leaks._compared(pa.array([x]))[0]) for x in (item[:45], item[50:]))
    assert got[1].item_coverage == pytest.approx(part / n, abs=1e-5) and got[1].exceeds and got[1].runs == 2
    assert not got[2].exceeds
    clean = leaks.without_leaks(docs, items, run_length=30).filter("doc_id = 1 and removed_chars > 0").collect()
    assert len(clean) == 1 and clean[0].text.startswith("start ") and clean[0].text.endswith(" end") and other in clean[0].text
    assert leaks.leaked_items(clean := leaks.without_leaks(docs, items, run_length=30), items, 60).count() == 0 and clean.count() == 3


def test_mixture(spark):
    rng = random.Random(17)
    rows = [(i, "w " * rng.randint(5, 60), rng.choice(["big", "big", "big", "Big ", "small-one"]) if i % 9 else "tiny") for i in range(600)]
    rows += [(1000, None, "big"), (1001, "", "tiny"), (1002, "w", None), (None, "w", "big"), rows[4]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("tokens", F.lit(-1)).withColumn("weight", F.lit("clash"))
    weights = spark.createDataFrame([("big", 0.5, 1), ("small_one", 0.3, 2), ("tiny", 0.2, 3), ("absent", 0.1, None)], "source string, target_share double, max_repeat int")
    docs = mixture.sized(df, "doc_id", "text", "source", F.lit(1.0)).cache()
    assert docs.count() == 603
    have = {r.source: r.n for r in docs.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    taken, plan = mixture.mixture(docs, weights)
    got = taken.collect()
    assert len({r.doc_id for r in got}) == len(got)
    used = collections.Counter()
    for r in got:
        used[r.source] += r.tokens * r.copies
        assert 1 <= r.copies <= {"big": 1, "small_one": 2, "tiny": 3}[r.source]
    for r in plan:
        assert abs(used[r["source"]] - (r["target"] if r["tokens"] else 0)) <= 61
    report = {r.source: r for r in mixture.shares(docs, weights, total_tokens=10 * sum(v for k, v in have.items() if k)).collect()}
    assert report["tiny"].bound and report["tiny"].tokens_used == 3 * have["tiny"]
    assert report["absent"].documents_used == 0
    again = {tuple(r) for r in mixture.mixture(docs.repartition(7), weights)[0].collect()}
    assert again == {tuple(r) for r in got}
    assert mixture.mixture(docs.limit(0), weights)[0].count() == 0 and mixture.mixture(docs, weights.limit(0))[0].count() == 0


def test_heavier_documents_are_taken_more_often(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(10).cast("long").alias("tokens"), F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0).alias("weight"))
    weights = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeat int")
    taken = mixture.mixture(docs, weights, total_tokens=8000)[0]
    heavy = taken.filter("doc_id % 2 = 0").count()
    assert taken.count() == 800 and heavy > 560


@pytest.mark.parametrize("low, high", [(0.01, 100.0), (1e-9, 1e-9), (1.0, 1.0)])
def test_no_bucket_of_keys_is_large_whatever_the_weights(spark, low, high):
    u = (F.shiftrightunsigned(F.xxhash64("id"), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    keys = spark.range(100_000).select((-F.log(u) / F.when(F.col("id") % 2 == 0, low).otherwise(high)).alias("key"))
    top = keys.groupBy(mixture.bucket(F.col("key")).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    assert top.agg(F.max("n")).first()[0] < 200
    ends = [(r.lo, r.hi) for r in top.orderBy("b").collect()]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))



def test_recall_at_the_limit_does_not_depend_on_the_size_of_the_table(spark, monkeypatch):
    rng = random.Random(12)
    rows, want = [], set()
    for i in range(300):
        base = prose(rng, 700)
        t = list(base)
        for k in sorted(rng.sample(range(20, 680, 33), 12), reverse=True):
            t[k] = "一"
        rows += [(2 * i, base), (2 * i + 1, "".join(t))]
        x, y = runs(rows[-2][1]), runs(rows[-1][1])
        if 0.7 <= len(x & y) / len(x | y) < 0.78:
            want.add((2 * i, 2 * i + 1))
    assert len(want) > 150
    df = spark.createDataFrame(rows, "row_id long, body string")
    small = {tuple(r) for r in nd.near_duplicate_rows(df, "row_id", "body").collect()}
    monkeypatch.setattr(type(df), "count", lambda self: 20_000_000_000)
    large = {tuple(r) for r in nd.near_duplicate_rows(df, "row_id", "body").collect()}
    assert small == large and len(large & want) >= 0.93 * len(want)


def test_only_the_leaked_span_goes_where_signs_compose(spark):
    rng = random.Random(13)
    item = prose(rng, 90)
    jamo = "\u1112\u1161\u11ab\u1100\u1173\u11af"
    korean = unicodedata.normalize("NFD", "한글로쓴긴문장이여기에있으며시험문항에도그대로들어있는글이다" * 3)
    docs = spark.createDataFrame([(1, jamo + " before " + item + " after " + jamo), (2, "before " + korean + "| after")], "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, korean)], "item_id long, text string")
    got = {r.doc_id: r for r in leaks.without_leaks(docs, items).collect()}
    assert got[1].text.startswith(jamo + " before") and got[1].text.endswith("after " + jamo) and 0 < got[1].removed_chars <= len(item)
    assert got[2].text == "before | after"
