import math
import random
from collections import Counter

from mailspark.llm.html_text import BANDS, NOISE, OPEN, PLAIN, STRENGTH, THRESHOLD, main_text, read_page

from .conftest import CLASHING


def frame(spark, rows, extra=""):
    width = 3 + (len(extra.split(",")) if extra else 0)
    return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], "page_id bigint, url string, html string" + (f", {extra}" if extra else ""))


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in main_text(frame(spark, rows)).collect()}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body class="ad">
<header class="site"><a href="/">Home</a></header><nav><ul><li>menu {n}</li></ul></nav>
<div class="cookie-notice">We use cookies {n}</div>
<article class="post"><header class="entry-header"><h1>Title  {n} &amp; more</h1></header>
<p>First <b>bold{n}</b> text&#33;<br>next line</p><aside>see also {n}</aside><p>Second &lt;tag&gt; {n}
<ul><li>one<li>two</ul><form><p>mail <input></p></form>
<section class="comments"><article><p>reader says {n}</p></article></section></article>
<div class="sidebar">other {n}</div><!-- <p>hidden</p> --><footer>&copy; {n}"""
WANT = "Title {n} & more\nFirst bold{n} text! next line\nSecond <tag> {n}\none\ntwo"


def test_article(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(n=i)) for i in range(30)]
    assert texts(spark, rows) == {i: WANT.format(n=i) for i in range(30)}


def test_style_tree_removes_what_repeats(spark):
    """Without any marks: the block that every page of the host repeats goes, the
    same block on a host with few pages stays."""
    def page(n):
        return f'<body><div class="x1">Welcome to the house</div><div class="x2"><p>Text number {n}</p></div><div class="x3">All rights kept</div></body>'

    rows = [(i, f"http://big.example/{i}", page(i)) for i in range(40)] + [(100 + i, f"http://small.example/{i}", page(i)) for i in range(3)]
    got = texts(spark, rows)
    assert all(got[i] == f"Text number {i}" for i in range(40))
    assert all(got[100 + i] == f"Welcome to the house\nText number {i}\nAll rights kept" for i in range(3))


def test_copies_of_an_article_are_no_template(spark):
    page = '<body><nav>m</nav><article><div class="body"><p>The same article</p></div></article></body>'
    rows = [(i, f"http://h.example/{i}", page) for i in range(50)]
    assert set(texts(spark, rows).values()) == {"The same article"}


def test_cases(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [
        (1, None, None), (2, "not a url", ""), (3, "http://h/", "plain text only"), (4, "http://h/", "<p>a<p>b"),
        (5, "HTTP://User@H:80/x", "<p>café&nbsp;&eacute; \n\t x</p>"), (6, "http://h/", "<script>x"), (7, "http://h/", "a < b > c"),
        (8, "http://h/", deep), (None, "http://h/", "<p>no id</p>"), (4, "http://h/", "<p>a<p>b"), (9, "http://h/", "<p title='unclosed>x</p><p>y</p>"),
    ]
    got = main_text(frame(spark, rows, CLASHING + ", host string, blocks string")).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    by = {r["page_id"]: r for r in got}
    assert by[1]["text"] == by[2]["text"] == by[6]["text"] == "" and by[1]["n_chars"] == 0
    assert by[3]["text"] == "plain text only" and by[4]["text"] == "a\nb" and by[None]["text"] == "no id"
    assert by[5]["text"] == "café é x" and by[5]["n_chars"] == 8 and by[8]["text"] == "deep"
    assert by[7]["text"] == "a < b > c" and "y" in by[9]["text"]
    assert main_text(frame(spark, [])).collect() == []


def test_nodes():
    blocks, inside, nodes, _ = read_page('<body><div class="a b"><p>x</p></div><div id="c">y</div></body>')
    # Number 0 is the page itself, 1 the body.
    assert blocks == ["x", "y"] and inside == [[0, 1, 2, 3], [0, 1, 4]] and {n[1] for n in nodes} == {OPEN}
    blocks, inside, nodes, article = read_page("<body>beside<nav>m</nav><article><p>x<p class=k>y</article><div>z</div></body>")
    marks = {text: nodes[places[-1]][1] for text, places in zip(blocks, inside)}
    assert marks == {"beside": NOISE, "m": NOISE, "x": PLAIN, "y": OPEN, "z": NOISE}
    assert article == read_page("<main><p>x</p></main><footer>f</footer><main><p>y</p></main>")[3]


def test_parts_of_an_article_stay_by_importance(spark):
    """Class words that can name a part of an article do not remove it; being the same on
    every page does, more surely the more pages there are."""
    parts = ["widget", "related", "search", "form", "legal", "rail", "hidden"]

    def page(n):
        inner = "".join(f'<section class="{w}"><p>{w} {n}</p></section>' for w in parts)
        return f'<body><article><h1>Same title</h1>{inner}<div class="invite">Write to us</div></article></body>'

    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(20)]
    want = {i: "\n".join(["Same title", *(f"{w} {i}" for w in parts)]) for i in range(20)}
    assert texts(spark, rows) == want
    few = texts(spark, rows[:5])
    assert all(few[i] == want[i] + "\nWrite to us" for i in range(5))


def test_importance_decides(spark):
    """Without the importance of nodes nothing is removed, marked or not."""
    rows = [(i, f"http://h.example/{i}", PAGE.format(n=i)) for i in range(12)]
    everything = {r["page_id"]: r["text"] for r in main_text(frame(spark, rows), threshold=-1).collect()}
    assert all(f"menu {i}" in t and f"other {i}" in t and f"reader says {i}" in t for i, t in everything.items())


def test_against_brute_force(spark):
    """Style trees built page by page in dictionaries give the same texts."""
    rng = random.Random(5)
    boxes = ["x1", "x2", "x3", "widget", "ad", "body"]

    def page(n):
        inner = f"<p>number {n}</p>" + "".join(
            f'<div class="{rng.choice(boxes)}"><p>{rng.choice(["same words", "two ways", f"text {rng.random()}"])}</p></div>'
            for _ in range(rng.randrange(1, 6)))
        return inner if rng.random() < 0.3 else f"<nav>menu {rng.randrange(3)}</nav>loose<article><h1>t {rng.randrange(4)}</h1>{inner}</article>"

    pages = [page(n) for n in range(110)]
    rows = [(i, f"http://h{rng.choice([0, 0, 0, 1, 2])}.example/{i}", text) for i, text in enumerate(pages + pages[:20])]
    read = {i: (url.split("/")[2], *read_page(page)) for i, url, page in rows}
    trees, seen = {}, set()
    for _, (host, _, _, nodes, article) in sorted(read.items()):
        if (host, article) in seen:
            continue
        seen.add((host, article))
        trees.setdefault(host, []).append(nodes)
    importance = {}
    for host, pages in trees.items():
        values = {}
        for key, mark, shape, content in (n for nodes in pages for n in nodes):
            values.setdefault((key, mark), []).append((shape, content))
        for (key, mark), found in values.items():
            n = len(found)
            shapes, contents = Counter(s for s, _ in found), Counter(c for _, c in found)
            evidence = 1.0
            if n > 1:
                entropy = -sum(c / n * math.log(c / n, n) for c in shapes.values())
                evidence = max(entropy, 1 - sum(math.log(c, n) for c in contents.values()) / len(contents))
            low, high = BANDS[mark]
            importance[host, key] = low + (high - low) * (n * evidence + STRENGTH) / (n + STRENGTH)
    want = {
        i: "\n".join(b for b, places in zip(blocks, inside) if all(importance[host, nodes[p][0]] >= THRESHOLD for p in places))
        for i, (host, blocks, inside, nodes, _) in read.items()}
    assert texts(spark, rows) == want
    assert any("same words" in page and "same words" not in want[i] for i, _, page in rows)
