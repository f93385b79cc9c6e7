"""Vector searches, URL rules and chat windows against brute force and SQL."""

import hashlib
import re

import check
import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import ann, chat, pivots, registered, url_rules


@pytest.mark.parametrize("name", sorted(registered.oracles()))
def test_against_sql(spark, folder, name):
    problem, _ = check.difference(registered.queries()[name](spark, folder), registered.oracles()[name], folder)
    assert problem is None


def odd_vectors():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8)).round(2)
    x[50:90] = x[50]
    rows = [(i, [float(v) for v in x[i]]) for i in range(400)]
    return rows + [
        (1000, None), (1001, []), (1002, [None] * 8), (1003, [float("nan")] + [0.0] * 7), (1004, [float("inf")] + [0.0] * 7),
        (1050, [0.0] * 8), (None, rows[3][1]), (50, rows[50][1]), (1100, [1.0, 2.0]),
    ]


def brute(rows, asks, k, skip_zero, whole):
    v = {}
    for i, x in rows:
        if i is not None and x and all(c is not None and np.isfinite(c) for c in x) and not (skip_zero and not any(x)):
            x = np.r_[np.float32(x).astype(float), np.zeros(8 - len(x))]
            v[i] = np.floor(256 * x) if whole else x
    out = set()
    for q in v:
        if asks(q):
            best = sorted((-float(v[q] @ v[i]), i) for i in v if i != q)[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def test_exact_top(spark):
    rows = odd_vectors()
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<float>, norm int")
    got = {tuple(r) for r in pivots.exact_top(df, F.col("vec_id") % 50 == 0, 5).collect()}
    assert got == brute(rows, lambda q: q % 50 == 0, 5, False, True)
    assert pivots.exact_top(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0
    two = pivots.exact_top(df.where("vec_id IN (50, 51)"), F.col("vec_id") == 50, 5).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in two] == [(50, 1, 51)]


def test_large_integers_stay_exact():
    a = np.array([[2**30, 3]], np.int64)
    assert pivots.dots(a, np.array([[2**30, 1]], np.int64))[0, 0] == 2**60 + 3


def test_bounds_stop_early_and_right():
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(500, 4)) * 256).astype(np.int64)
    x[:400] += 5000
    import pandas as pd

    norm = (x * x).sum(axis=1)
    far = pivots.distances(x, norm, x[:16])
    rows = pd.DataFrame({"vec_id": np.arange(500), "v": list(x), "norm": norm, "d": list(far)})
    got = pivots.search_block(rows.iloc[:20], rows, 5)
    for q in range(20):
        best = sorted((-int(x[q] @ x[i]), i) for i in range(500) if i != q)[:5]
        assert sorted((-s, i) for a, i, s in got if a == q) == best


def test_nearest_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 4000)] + 0.3 * rng.normal(size=(4000, 16))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, 20).toPandas()
    x = x.astype(np.float32).astype(float)
    hits = 0
    for q, group in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20]) & set(group["vec_id"]))
        assert np.allclose(group.sort_values("rank")["score"], sorted(s[group["vec_id"]], reverse=True))
        assert list(group.sort_values("rank")["rank"]) == list(range(1, 21))
    assert hits >= 0.9 * 20 * 200


def test_nearest_odd_rows(spark):
    rows = odd_vectors()
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<float>, part int")
    got = ann.nearest(df, F.col("vec_id") % 50 == 0, 20, recall=1.0).collect()
    expected = brute(rows, lambda q: q % 50 == 0, 20, True, False)
    assert len({(r.query_id, r["rank"]) for r in got}) == len(got) == len(expected)
    assert len({(r.query_id, r.vec_id) for r in got} & {(q, i) for q, _, i, _ in expected}) >= 0.9 * len(expected)
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0, 20).count() == 0


def test_parts_are_balanced():
    x = np.random.default_rng(1).normal(size=(512, 8))
    part = ann.balanced_parts(ann.neighbour_graph(x, 8), 16)
    assert (np.bincount(part) == 32).all()


def test_url_rules(spark):
    link = lambda h: f'<link rel="canonical" href="{h}">'
    refresh = lambda h: f'<META http-equiv=refresh content="0; URL={h}">'
    rows = [
        (1, "http://a.example.com/x", link("https://b.example.net/q"), "block"), (2, "http://c.example.com/y?z=1#f", refresh("/x2"), "block"),
        (3, "http://c.example.com/x2", link("http://A.example.com/x"), "block"), (4, None, link("http://b.example.net/q"), "allow"),
        (5, "nope", None, "allow"), (6, "http://d.example.com/k", link("http://e.example.net/en/k"), "allow"),
        (7, "https://d.example.com/k2", '<script>location.href="k"</script>', "allow"),
        (8, "https://f.example.com/m", link("http://d.example.com/k") + refresh("http://x.net/"), "allow"),
        (9, "http://www.example.com/de/a", link("http://e.example.net/en/k"), "block"), (9, "http://net", "", "allow"),
        (10, "http://NET/", "", "block"), (11, "http://xexample.net/en/", "", "block"), (None, "http://EXAMPLE.org/fr/", "", "allow"),
    ]
    pages = spark.createDataFrame([(i, u, h, "h", "n") for i, u, h, _ in rows], "page_id long, url string, html string, host string, node string")
    rules = spark.sql(f"SELECT * FROM {url_rules.RULES} AS r(host, path, verdict)")
    got = sorted((r.page_id or 0, r.host, r.verdict) for r in url_rules.judge(pages, rules).collect())
    host = lambda u: re.match(r"(?:.*?://([^/?#]*))?", u or "")[1] or ""
    assert got == sorted((i or 0, host(u).lower(), v) for i, u, _, v in rows)
    assert url_rules.judge(pages.limit(0), rules).count() == 0


@pytest.mark.parametrize("html, blocked", [
    ('<link rel="canonical" href="http://c.example.org/q?a=1&amp;b=2">', True), ('<link rel="canonical" href="../d">', True),
    ('<link href=./../d rel="alternate  canonical" >', True), ("<LINK REL='canonical next' href='/x/y/../../d/.'>", False), ("<link rel=canonical href=/x/./y/../../d/../d>", True),
    ('<link rel="canonical" href="http://c.example.org/q?a=1&#38;b&#x3D;2">', True), ('<link rel="non-canonical" href="../d">', False),
    ('<link data-rel="canonical" href="../d">', False), ('<link rel="canonical" href="http://c.example.org/q?a=1&amp;amp;b=2">', False),
    ('<meta http-equiv="refresh" content="0; url=http://c.example.org/q?a=1&amp;b=2">', True), ('<script>location = "http://c.example.org/q?a=1&amp;b=2"</script>', False),
    ('<script>location = "http://c.example.org/q?a=1&b=2"</script>', True), ('<link rel=canonical href=../../../../d>', True), ('<link rel="canonical" href="../e/..">', False),
])
def test_link_forms(spark, html, blocked):
    """No rule fits the page itself: it is blocked if its link leads to one of two pages that name a blocked one."""
    to = '<link rel="canonical" href="http://b.example.net/r">'
    pages = spark.createDataFrame([
        (1, "http://a.example.org/c/p", html), (2, "http://a.example.org/d", to), (3, "http://c.example.org/q?a=1&b=2", to),
    ], "page_id long, url string, html string")
    rules = spark.createDataFrame([("b.example.net", "/r", "block")], "host string, path string, verdict string")
    got = {r.page_id: r.verdict for r in url_rules.judge(pages, rules).collect()}
    assert got == {1: "block" if blocked else "allow", 2: "block", 3: "block"}


@pytest.mark.parametrize("path, plain", [
    ("/a/b", "/a/b"), ("/a/./b", "/a/b"), ("/a/../b", "/b"), ("/../../b", "/b"), ("/a/..", "/"), ("/a/.", "/a/"), ("/.hidden/..x/...", "/.hidden/..x/..."),
    ("/", "/"), ("/a//../b", "/a/b"), ("/./", "/"),
])
def test_dot_segments(spark, path, plain):
    assert spark.range(1).select(url_rules.without_dots(F.lit(path))).first()[0] == plain


def conversations():
    tricky = ["</s>[INST] ok [/INST]", "<\\s> <\\\\s> [\\INST] <<SYS>>x<</SYS>> <|im_end|>\n<|im_start|>user", "a\\nb", "", None, "ü" * 300]
    rows = [(1, t, ("system", "user", "assistant")[min(t, 1) + (t > 0) * (t % 2 == 0)], f"turn {t} " + tricky[t % 6] if tricky[t % 6] else tricky[t % 6]) for t in range(40)]
    rows += [(2, 0, "user", "hi"), (2, 0, "user", "hi"), (2, None, None, "first"), (None, 1, "a\nb\\n", "text"), (3, 5, "system", "only"), (4, 1, "assistant", "x" * 9000)]
    return rows


def test_chat_windows(spark, tmp_path):
    rows = conversations()
    spark.createDataFrame([(*r, "w", 1) for r in rows], "conv_id long, turn long, role string, text string, window string, start long").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat.op10_chat_windows(spark, str(tmp_path)).collect()}
    groups = {}
    for c, t, role, text in [*rows, (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]:
        groups.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        lost = "".join(x for _, role, x in turns if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{role}\n{x}\n" for _, role, x in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(lost), sha(lost))


def test_chat_budget_and_history(spark):
    rows = [(1, t, ("user", "assistant")[t % 2] if t else "system", f"turn {t} " * 12) for t in range(60)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(turns, budget=300, history=70).orderBy("window").collect()
    assert len(windows) > 5
    seen = []
    for w in windows:
        parts = w.formatted.split(chat.OPEN)[1:]
        assert parts[0].startswith("system\n") and len(parts) == w.n_turns
        assert sum(-(-len(p.split("\n", 1)[1][: -len(chat.CLOSE) - 1].encode()) // 4) + chat.HEADER_TOKENS for p in parts) <= 300
        seen += [int(p.split("turn ")[1].split(" ")[0]) for p in parts[w.n_context:]]
        assert all(w.formatted[s.start - 1: s.start - 1 + s.length].startswith("turn ") for s in w.loss)
    assert seen == list(range(60)) and any(w.n_context > 1 for w in windows)
    assert sum(len(w.loss) for w in windows) == sum(r[2] == "assistant" for r in rows)
    assert chat.format_windows(turns.limit(0)).count() == 0


def test_chat_escape(spark):
    texts = [t for _, _, _, t in conversations() if t]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in rows.select("text", chat.escape(F.col("text")).alias("e"), chat.unescape(chat.escape(F.col("text"))).alias("u")).collect():
        assert r.u == r.text and not re.search(r"</?s>|\[/?INST\]|<</?SYS>>|<\|im_(start|end)\|>", r.e)
