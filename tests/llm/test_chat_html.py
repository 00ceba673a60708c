import duckdb
from conftest import rows

from locusmill.llm import chat, html

TURNS = [
    (0, 0, "system", "S"), (0, 1, "user", "Hi é"), (0, 2, "assistant", "A"), (0, 3, "user", "more"), (1, 0, "system", "S"), (1, 1, "user", "Hi é"), (1, 2, "assistant", "B"),
    (2, 0, "user", "q"), (3, 0, "user", "q"), (4, 0, "user", "alone"), (6, 1, None, None), (6, None, "user", "x"), (7, 0, "user", "x"), (7, 0, "user", "x"), (None, 0, "user", "z"),
]


def test_pairs(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    out = chat.preference_pairs(df, chat.consecutive_pairs(df))
    got = {r.pair_id: r for r in out.collect()}
    assert set(got) == {0, 1, 3}
    r = got[0]
    assert r.n_prefix == 2 and r.prompt == "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nHi é<|im_end|>\n"
    assert r.chosen == "<|im_start|>assistant\nA<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n" and r.rejected == "<|im_start|>assistant\nB<|im_end|>\n"
    learned = "".join(c for c, m in zip(r.chosen, r.chosen_mask) if m == "1")
    assert learned == "A<|im_end|>" and len(r.chosen) == len(r.chosen_mask) and len(r.rejected) == len(r.rejected_mask)
    assert "".join(s.text for s in r.chosen_segments) == r.chosen
    assert got[1].n_prefix == 1 and got[1].chosen == got[1].rejected == "" and got[3].n_prefix == 1
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    cols = ["pair_id", "chosen_id", "rejected_id", "n_prefix", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask"]
    assert sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({chat.SQL})").fetchall()) == rows(out, *cols)
    none = df.where("false")
    assert chat.preference_pairs(none, chat.consecutive_pairs(none)).count() == 0


PAGE = """<!doctype html><html><head><title>T</title><style>p{{}}</style><script>var x="</p><p>no</p>";</script></head><body class="home">
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> --><div class="ad box-12">Buy</div>
<article><h1>A &amp; B</h1><p>One <b>two</b>&nbsp;three<br>four<p>Five <i>s</i>ix<div class="share">tweet</div><blockquote>q</blockquote>{more}</article>
<div id="comments"><p>first!</p></div><aside>side</aside><form><p>mail</p></form><footer>&copy;</footer></body></html>"""


def test_article_only():
    assert html.main_text(PAGE.format(more="")) == "A & B One two three four Five six q"
    assert html.main_text("") == "" and html.main_text("plain  text <b").startswith("plain text")
    assert html.main_text("<p>a<p>b<ul><li>c<li>d</ul><table><tr><td>e<td>f</table>") == "a b c d e f"
    assert html.main_text("<div style='display: none'>x</div><p hidden>y</p><p>z</p><script>") == "z"
    assert html.main_text("<p>" + "word " * 100000 + "</p>") == " ".join(["word"] * 100000)
    assert html.main_text("<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after") == "deep after"
    assert html.main_text("<article><p>a <svg>b<p>c <noscript>d<template>e</article>") == "a b c de"
    assert html.main_text("<article>x <math><mi>y</mi> = <mn>2</mn></math> <object>z</object><noscript>js</noscript></article>") == "x y = 2 z"


def composed_by_hand(pages):
    """Importance of each node of one host's tree as the docstring says, by recursion over the pages that have the node."""
    import math

    def label(p, c):
        return p.label[c] if c >= 0 else "#"

    def style(p, e):
        kids = p.children[e]
        return None if len(kids) == 1 and kids[0] < 0 else tuple(label(p, c) for c in kids)

    def importance(at, path):  # at: (page, element, or the text of a leaf)
        m = len(at)
        texts = [x if isinstance(x, str) else p.blocks[-1 - p.children[x][0]][1] if style(p, x) is None else None for p, x in at]
        if m < html.LEAST_PAGES:
            return 1.0, True
        if texts[0] is not None:
            seen = [set(html.SENTENCE.split(t)) for t in texts]
            every = set().union(*seen)
            value = 1 - sum(math.log(sum(f in s for s in seen)) for f in every) / (len(every) * math.log(m))
            out[path] = round(value, 9)
            return out[path], out[path] >= html.LOW
        by = {}
        for p, e in at:
            by.setdefault(style(p, e), []).append((p, e))
        entropy = -sum(len(v) / m * math.log(len(v) / m) for v in by.values()) / math.log(m)
        inner, high = 0.0, False
        for s, some in by.items():
            for place in range(len(s)):
                kids = [(p, c if (c := p.children[e][place]) >= 0 else p.blocks[-1 - c][1]) for p, e in some]
                v, h = importance(kids, (*path, s, place))
                inner += len(some) / m * v / len(s)
                high |= h
        part = html.GAMMA ** len(by)
        out[path] = round((1 - part) * entropy + part * inner, 9)
        return out[path], high or out[path] >= html.LOW

    out = {}
    importance([(p, 0) for p in pages], ())
    return out


def test_tree_against_recursion(spark):
    import random

    rng = random.Random(2)
    top = ["<nav><a>Home</a><p>News</p></nav>", "<nav><p>Home</p><p>{i}</p></nav>"]
    pages = [f"<body>{rng.choice(top).format(i=i % 3)}<div class=c{i}><h1>Title {i}.</h1>{'<p>Said before. New {}.</p>'.format(i) * rng.choice([1, 1, 1, 2])}</div><footer>All the same. No {i % 2}.</footer></body>" for i in range(24)]
    tree = html.site_tree(spark.createDataFrame([(f"http://a.example/{i}", p) for i, p in enumerate(pages)], "url string, html string")).collect()
    want = composed_by_hand([html.Page(p) for p in pages])
    assert sorted(round(r.importance, 6) for r in tree) == sorted(round(x, 6) for x in want.values())
    low = html.site_tree(spark.createDataFrame([(f"http://a.example/{i}", p) for i, p in enumerate(pages)], "url string, html string"), most=1).collect()
    assert {r.key for r in low} <= {r.key for r in tree}


def test_large_hosts_lose_the_same_blocks(spark, monkeypatch):
    data = [(i, f"http://a.example/{i}", f"<body><div class=top><p>Same for all</p><p>Here too</p></div><div class=k><p>Story {i} of many</p></div></body>") for i in range(9)]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    want = {i: f"Story {i} of many" for i in range(9)}
    assert {r.page_id: r.text for r in html.extract(df).collect()} == want
    assert {r.page_id: r.text for r in html.extract(df, most_nodes=0).collect()} == want
    whole = html.site_tree
    monkeypatch.setattr(html, "site_tree", lambda *a: whole(*a, most=1))
    assert {r.page_id: r.text for r in html.extract(df).collect()} == want


def test_template_goes_by_its_importance(spark):
    page = "<body><div class=top><p>Welcome to our site</p></div><div class=story><p>Story {i} {w}</p><p>and more of {i}</p></div><div class=end><p>All rights</p></div></body>"
    data = [(i, f"http://h.example/{i}", page.format(i=i, w="w" * i)) for i in range(12)] + [(100, "http://one.example/", page.format(i=1, w="w")), (101, None, "<p>n</p>"), (102, "::", None), (102, "::", None)]
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    for i in range(12):
        want = f"Story {i} {'w' * i} and more of {i}".replace("  ", " ")
        assert got[i] == (want, len(want))
    assert got[100][0].startswith("Welcome") and got[101] == ("n", 1) and got[102] == ("", 0)
    assert html.extract(spark.createDataFrame(data, "page_id long, url string, html string")).count() == len(data)
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_repeated_text_of_a_container_takes_nothing_below_it(spark):
    page = [
        "<body>Skip to content <article><p>Unique {i}</p></article></body>", "<body><article>By our staff<p>Unique {i}</p></article></body>",
        "<body><div>Share this page</div><div><p>Unique {i}</p></div></body>", "<body><div class=box>Same<div class=in>Same too<p>Unique {i}</p></div></div></body>",
    ]
    data = [(h * 10 + i, f"http://h{h}.example/{i}", p.format(i=i)) for h, p in enumerate(page) for i in range(6)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert got == {h * 10 + i: f"Unique {i}" for h in range(len(page)) for i in range(6)}


def test_copies_of_a_story_count_once(spark):
    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    marked = "<body><nav>Menu {i}</nav><div class=ad>Buy {i}</div><article><p>Story {k}</p></article><footer>Foot {i}</footer></body>"
    plain = "<body><div class=top>Go {i}</div><div class=note>All the same</div><p>{k} {long}</p></body>"
    data = [(i, f"http://a.example/{i}", marked.format(i=i, k=0 if i < 9 else i)) for i in range(10)]
    data += [(100 + i, f"http://b.example/{i}", marked.format(i=i, k=0)) for i in range(4)]
    data += [(200 + i, f"http://c.example/{i}", plain.format(i=i, k=0 if i < 40 else i, long=long)) for i in range(44)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(10)] == ["Story 0"] * 9 + ["Story 9"] and [got[100 + i] for i in range(4)] == ["Story 0"] * 4
    assert [got[200 + i] for i in range(44)] == [f"Go {i} {0 if i < 40 else i} {long}" for i in range(44)]
