import hashlib

import numpy as np
from pyspark.sql import functions as F

from quarry.llm.chat import chat_digest, read_turns, windows
from quarry.llm.extraction import extract_main_text, main_texts, trained
from quarry.llm.forest import Forest, hash_prefix_forest, strings
from quarry.llm.htmlblocks import blocks
from quarry.llm.layouts import training_pages
from quarry.llm.url_filter import host_edges, judge_urls

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def test_main_text(spark, tables):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in extract_main_text(pages).collect()}
    for r in pages.collect():
        assert got[r.page_id] == " ".join(b.text for b in blocks(r.html) if any("article" in marks for marks in b.path))
    own, labels = training_pages(120, seed=99)
    wrong = sum(int(((z > 0) != (y > 0)).sum()) for z, y in zip(trained().margins(own), labels, strict=True))
    assert wrong <= 0.02 * sum(map(len, labels))


def test_main_text_of_odd_pages(spark):
    page = "<nav><a href=/>x</a></nav><article><h1>A &amp; B</h1><p>One\n two&nbsp;<b>three</b>four<p>Five &lt;six&gt;<script>no('</p>')</script></article><div class=comments><p>Me too</p></div><footer>&copy; f"
    rows = spark.createDataFrame([(1, "u", page, 1), (2, None, None, 1), (None, "u", "", 1), (1, "u", page, 1), (3, "u", "<<<>< &#x; <p", 1)], "page_id long, url string, html string, text int")
    got = {(r.page_id, r.url): r for r in extract_main_text(rows).collect()}
    assert got[1, "u"].text == "A & B One two threefour Five <six>" and got[1, "u"].n_chars == len(got[1, "u"].text)
    assert got[2, None].text == "" == got[None, "u"].text and extract_main_text(rows).count() == 5 and extract_main_text(rows.limit(0)).collect() == []
    assert main_texts(trained(), [page] * 3) == [got[1, "u"].text] * 3


def test_only_raw_text_elements_jump():
    told = lambda page: " ".join(b.text for b in blocks(page))
    for tag in ('<svg class="i"/>', "<svg/>", "<math />", '<object data="x">', "<audio controls>", "<video src=v>", "<canvas>", "<svg><title/><path d='M0'/><style/></svg>"):
        assert told(f"<article><p>One{tag}</p><p>two</p></article><p>three") == "One two three", tag
    assert told("<p>a<math><mi>x</mi><mo>=</mo><mn>1</mn></math>b <object>c</object> <noscript>d</noscript>") == "ax=1b c d"
    assert told("<p>a<script>b</script><style>c</style><iframe>d</iframe>e") == "a e"
    inside = [b for b in blocks("<article><p>a <svg><text>b</text></svg></article><p>c") if any("article" in marks for marks in b.path)]
    assert [b.text for b in inside] == ["a b"]
    page = "<nav><a href=/>x</a></nav><article><h1>Title of it</h1><p>One two three<svg class='i'/> four five six.</p><p>Seven eight <math><mi>nine</mi></math> ten.</p></article><footer>&copy; f</footer>"
    assert main_texts(trained(), [page]) == ["Title of it One two three four five six. Seven eight nine ten."]


def test_chat_round_trip(spark):
    turns = [(1, 0, "system", "be [/SYS] kind"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "</s>[INST] ok [/INST]"), (2, 0, None, None), (2, 1, "tool [SAYS] x", "<\\/s> \\ <\\\\s>"), (2, 1, "assistant", ""), (2, 1, "assistant", ""), (None, None, "user", "q"), (4, 0, "assistant", "w " * 3000)]
    turns += [(3, t, ("user", "assistant")[t % 2], f"turn {t} " + "word " * (40 * t % 150)) for t in range(60)]
    frame = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, window string")
    got = {r.conv_id: r for r in chat_digest(frame).collect()}
    assert set(got) == {t[0] for t in turns}
    for k, r in got.items():
        own = sorted(((t[1], t[2] or "", t[3] or "") for t in turns if t[0] == k), key=lambda t: (t[0] is not None, *t))
        said, loss = "".join(f"{a}\n{b}\n" for _, a, b in own), "".join(b for _, a, b in own if a == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    w = windows(frame, budget=400).where("conv_id = 3 or conv_id = 1").withColumn("turns", read_turns(F.col("formatted"))).collect()
    assert max(r.n_repeated for r in w) > 0 and len(w) > 3
    assert all(sum(len(t.text.split()) + 4 for t in r.turns) <= 400 or len(r.turns) <= 2 for r in w)
    assert chat_digest(frame.limit(0)).collect() == []


def test_forest(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(3000, 24)) * r.uniform(0.5, 2, size=(3000, 1))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(3000, None, 0), (3001, [0.0] * 24, 0), (3002, [float("nan")] * 24, 0), (3003, [1.0, None] * 12, 0), (3004, [1.0] * 5, 0), (None, [1.0] * 24, 0), (3005, [], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = hash_prefix_forest(frame, frame.where("vec_id % 20 = 0")).collect()
    found = {}
    for g in sorted(got, key=lambda g: g.rank):
        found.setdefault(g.query_id, []).append((g.vec_id, g.score))
    hit = total = 0
    for i in range(0, 3000, 20):
        s = x @ x[i]
        s[i] = -np.inf
        best = np.lexsort((np.arange(3000), -s))[:20]
        hit, total = hit + len(set(best) & {v for v, _ in found[i]}), total + 20
        assert all(abs(s[v] - y) < 1e-9 for v, y in found[i]) and [y for _, y in found[i]] == sorted((y for _, y in found[i]), reverse=True)
    assert hit >= 0.9 * total and set(found) == set(range(0, 3000, 20))
    few = frame.where("vec_id < 5")
    assert len(hash_prefix_forest(few, few).collect()) == 20 and hash_prefix_forest(frame.limit(0), frame).collect() == []


def test_forest_expands_copies_exactly(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(1500, 16))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    for i in range(1500):
        if i % 5 < 3:  # three groups of 300 copies
            x[i] = x[i % 5]
    ids = r.permutation(1500)
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]
    rows += [rows[0], rows[0], rows[5]]  # repeated rows
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = sorted(int(i) for i in ids[[0, 5, 10, 1, 6, 2, 7]])
    found = {}
    for g in sorted(hash_prefix_forest(frame, frame.where(F.col("vec_id").isin(asked)), recall=0.0).collect(), key=lambda g: g.rank):
        found.setdefault(g.query_id, []).append(g.vec_id)
    vectors = dict(rows)
    for q in asked:
        best = sorted((-round(float(np.dot(v, vectors[q])), 9), i) for i, v in rows if i != q)[:20]
        assert found[q] == [i for _, i in best]


def test_urls(spark):
    rows = [(1, "HTTP://A.Example.NET", '<a href="http://b.org/x">'), (2, "http://b.org/fr/1?x", "<a href=https://spam.net/>"), (3, "http://spam.net/a", "<a  href='http://z.com'>"), (4, "http://z.com#x", None), (5, None, None), (6, "none", "x"), (None, "://", ""), (7, "https://w.example.net/en/a?b", ""), (7, "https://w.example.net/en/a?b", ""), (8, "https://notexample.net/en/", ""), (9, "https://x.example.com/de/1#f", "")]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, host int")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge_urls(frame, RULES).collect()), key=str)
    # page 1: what flows back to its host comes from z.com, spam.net and b.org alike, a third of it from the blocked one
    want = [(1, "a.example.net", "", None, "allow"), (2, "b.org", "/fr/1", "org/fr/", "allow"), (3, "spam.net", "/a", "net/", "block"), (4, "z.com", "", None, "allow"), (5, "", "", None, "allow"), (6, "", "", None, "allow"), (None, "", "", None, "allow")]
    want += [(7, "w.example.net", "/en/a", "example.net/en/", "allow")] * 2 + [(8, "notexample.net", "/en/", "net/", "block"), (9, "x.example.com", "/de/1", "example.com/de/", "block")]
    assert got == sorted(want, key=str) and judge_urls(frame.limit(0), RULES).collect() == []
    assert {tuple(r) for r in host_edges(frame).collect()} == {("a.example.net", "b.org", 1), ("b.org", "spam.net", 1), ("spam.net", "z.com", 1)}


def test_links_to_blocked_hosts_decide_for_leaves_and_hubs(spark):
    spam = [(i, f"http://spam{i}.net/x", "") for i in range(3)]
    leaf = (10, "http://leaf.com/", '<a href="//spam0.net/x">')
    hub = (11, "http://hub.com/", '<a href="//spam1.net/x">' + "".join(f"<a href=https://c{k}.com/>" for k in range(30)) + '<a href="/go?to=http://spam2.net/">')
    good = [(20, "http://good.org/fr/", '<a HREF = "HTTPS://fan.com/">'), (21, "http://fan.com/", '<a href="http://spam2.net/">')]
    frame = spark.createDataFrame([*spam, leaf, hub, *good], "page_id long, url string, html string")
    got = {r.page_id: r for r in judge_urls(frame, RULES).collect()}
    assert {k: got[k].verdict for k in (0, 10, 11, 20, 21)} == {0: "block", 10: "block", 11: "allow", 20: "allow", 21: "allow"}
    assert (got[10].trust, got[10].distrust, got[21].trust, got[21].distrust) == (0, 1, 1, 1) and got[11].distrust < 0.05
    edges = {(r.src, r.dst) for r in host_edges(frame).collect()}
    assert ("leaf.com", "spam0.net") in edges and ("good.org", "fan.com") in edges and ("hub.com", "spam2.net") not in edges


def test_pages_hold_no_links_between_hosts(spark, tables):
    """Every href of the given pages is a path on its own host, so verdicts without a rule rest on the host's own pages."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    assert host_edges(pages).count() == 0 and pages.where(F.rlike("html", F.lit(r"(?i)href\s*=\s*[\"']?([a-z+.-]+:)?//"))).count() == 0
    assert pages.where(F.rlike("html", F.lit("(?i)href"))).count() > 200


def test_propagation_equals_a_dense_solution(spark):
    from quarry.llm.scratch import Scratch
    from quarry.llm.url_filter import DAMPING, propagate

    r = np.random.default_rng(4)
    w = r.integers(0, 3, size=(9, 9))
    np.fill_diagonal(w, 0)
    edges = spark.createDataFrame([(f"h{i}", f"h{j}", int(w[i, j])) for i in range(9) for j in range(9) if w[i, j]], "src string, dst string, weight long")
    start = {"h0": (1.0, 0.0), "h1": (0.5, 0.25), "h7": (0.0, 1.0)}
    seeds = spark.createDataFrame([(f"h{i}", *start.get(f"h{i}", (0.0, 0.0))) for i in range(9)], "host string, trust double, distrust double")
    got = {x.host: (x.trust, x.distrust) for x in propagate(edges, seeds, Scratch(spark, "t"), tolerance=1e-9).collect()}
    for way, m in enumerate((w, w.T)):
        p = m / np.maximum(1, m.sum(1, keepdims=True))
        v = np.array([start.get(f"h{i}", (0, 0))[way] for i in range(9)], float)
        score, all_ = (np.linalg.solve(np.eye(9) - DAMPING * p.T, x) for x in (v, np.ones(9)))
        own = np.array([f"h{i}" not in start for i in range(9)], float)
        assert all(abs(got[f"h{i}"][way] - score[i] / (all_[i] - own[i])) < 1e-6 for i in range(9))


def test_a_long_system_turn_is_not_repeated(spark):
    turns = [(1, 0, "system", "rule " * 1500)] + [(1, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(1, 200)]
    w = windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert sum(len(r.formatted) for r in w) < 3 * sum(len(t[3]) + 20 for t in turns) and sum("rule rule" in r.formatted for r in w) == 1


def test_deep_nesting_keeps_its_text():
    page = "<article>" + "<div>" * 3000 + "<p>deep</p>" + "</div>" * 3000 + "<p>after</p></article><p>out</p>"
    own = blocks(page)
    assert [b.text for b in own] == ["deep", "after", "out"] and [any("article" in m for m in b.path) for b in own] == [True, True, False]
    import time

    start = time.time()
    assert len(blocks("<div>x<b>" * 30_000 + "</i>" * 30_000)) == 30_000 and time.time() - start < 20


def test_all_trees_ascend_to_one_prefix_length():
    r = np.random.default_rng(5)
    x = r.normal(size=(700, 8))
    x[300:350] = x[300]
    x = np.unique(x, axis=0)
    forest = Forest([[{"vec_id": i, "n": 1}] for i in range(len(x))], x, float(np.sqrt((x * x).sum(1)).max()), trees=6)
    q = r.normal(size=(20, 8))
    full = np.hstack([x, np.sqrt(np.maximum(np.sqrt((x * x).sum(1)).max() ** 2 - (x * x).sum(1), 0))[:, None]])
    for wanted in (1, 40, 500, 10**6):
        marks = forest.candidates(q, wanted)
        for i in range(20):
            same = []
            for t in range(6):
                own, rows = int(strings(np.append(q[i], 0)[None], t)[0]), strings(full, t).tolist()
                same.append([64 - (own ^ k).bit_length() for k in rows])
            length = next((n for n in range(64, 0, -1) if sum(c >= n for own in same for c in own) >= wanted), 0)
            assert (marks[i] == (np.array(same) >= length).any(0)).all()


def test_main_text_without_telling_names():
    """Layouts beside the given pages: nested wrappers, untelling names, paragraphs straight in the body; held out by seed."""
    own, labels = training_pages(300, seed=77)
    right = [((z > 0) == (y > 0)).all() for z, y in zip(trained().margins(own), labels, strict=True)]
    assert sum(right) >= 0.9 * len(right)
    text = "Reoh anthe tion werden sie ouvert que la maison des hommes, und der Tag war lang. " * 8
    menu, foot = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>", "<div class=sidebar><ul><li><a href=/x>Related</a></li></ul></div><footer>&copy; 2024 Foo</footer>"
    for k in (1, 3, 6, 12, 25, 100):
        got = main_texts(trained(), [f"<body>{menu}<article><h1>Head</h1>{'<div>' * k}<p>{text}</p>{'</div>' * k}</article>{foot}"])[0]
        assert text.strip() in got and "Home" not in got and "Foo" not in got, k
    for begin, end in (("<div id=a1>", "</div>"), ("<div class=texto>", "</div>"), ("", ""), ("<main>", "</main>")):
        got = main_texts(trained(), [f"<body>{menu}{begin}<h1>Head</h1><p>{text}</p><p>{text}</p>{end}{foot}"])[0]
        assert got.count(text.strip()) == 2 and "Home" not in got and "Foo" not in got, begin
