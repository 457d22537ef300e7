"""Nested sets, selectors, cards and mined rules against Python's own HTML parser and by hand."""

import random
from html.parser import HTMLParser

from rankweave.operators import dom

PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a = "<div>";</script></head><body><!-- <p> --><div id="top" class="a list">
<div class="card big"><div class="inner"><a href="/t/1">Ann <b>B</b></a><br><img src="/i/1.jpg"/></div><p class="spec">AGE 20 T160</p></div>
<div class="card"><div><a href='/t/2'>Bea</a><p>25歳 T155 B80 W58 H82<p></div></div></div></span><a href="/t/3">Cleo</a></body></html>"""


class Tree(HTMLParser):
    """Elements by name, number and ancestors, of well-formed pages."""

    def __init__(self):
        super().__init__()
        self.open, self.rows = [], []

    def handle_starttag(self, tag, attrs):
        self.rows.append((tag, len(self.open), self.open[-1] if self.open else None))
        if tag not in dom.VOID:
            self.open.append(len(self.rows) - 1)

    def handle_endtag(self, tag):
        self.open.pop()


def page(rng, depth=0):
    tags = rng.choices(["div", "p", "ul", "br", "span"], k=rng.randint(0, 3 if depth else 5))
    return "x".join(f"<{t} class='c{rng.randint(0, 3)}'>" + ("" if t == "br" else page(rng, depth + 1) + f"</{t}>") for t in tags if depth < 6)


def test_elements_are_those_of_a_parser(spark):
    pages = [page(random.Random(i)) for i in range(25)]
    df = spark.createDataFrame([(i, f"<html>{p}</html>") for i, p in enumerate(pages)], "k long, html string")
    found = {}
    for r in dom.elements(dom.parsed(df, "k", "html"), "k").collect():
        found.setdefault(r.k, []).append(r)
    for i, p in enumerate(pages):
        tree = Tree()
        tree.feed(f"<html>{p}</html>")
        rows = sorted(found[i], key=lambda r: r.open)
        places = [r.open for r in rows]
        assert [(r.tag, r.depth, None if r.parent is None else places.index(r.parent)) for r in rows] == tree.rows


def named(spark, selector):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "no tags > here")], "k long, html string")
    pieces = dom.parsed(df, "k", "html")
    rows = dom.select(dom.elements(pieces, "k"), "k", selector).join(pieces, "k").select("open", dom.outer(dom.F.col("pieces"), dom.F.col("open"), dom.F.col("close")).alias("h"))
    return [r.h for r in sorted(rows.collect(), key=lambda r: r.open)]


def test_selectors(spark):
    assert named(spark, "a") == ['<a href="/t/1">Ann <b>B</b>', "<a href='/t/2'>Bea", '<a href="/t/3">Cleo']
    assert named(spark, "#top .card a") == named(spark, "a")[:2]
    assert named(spark, "div.card.big > p.spec") == ['<p class="spec">AGE 20 T160']
    assert named(spark, ".card > a") == [] and named(spark, "body > a") == ['<a href="/t/3">Cleo']
    assert named(spark, "img") == ['<img src="/i/1.jpg"/>'] and named(spark, "div div div") == named(spark, ".card > div")


def test_cards_are_the_elements_around_links(spark):
    df = spark.createDataFrame([(1, "https://v.example/list", PAGE)], "k long, url string, html string")
    got = {r.link: (r.name, r.age, r.height, r.bust, r.image, r.valid) for r in dom.enclosing_cards(df, "k", "url", "html").collect()}
    assert got == {"https://v.example/t/1": ("Ann B", None, None, None, "https://v.example/i/1.jpg", False), "https://v.example/t/2": ("Bea", 25, 155, 80, None, True)}
    wanted = spark.createDataFrame([(1, "https://v.example/t/2")], "k long, link string")
    assert [r.name for r in dom.enclosing_cards(df, "k", "url", "html", wanted).collect()] == ["Bea"]


def test_rules_are_mined_and_applied(spark):
    html = lambda n, a, t, c: f'<body><h1 class="who {c}">{n}</h1><div class="{c}"><span>no {a}</span><p class="spec">AGE {a} T{t}</p></div></body>'
    rows = [(i, f"N{i:02}x", 20 + i, 150 + i, "data" if i < 7 else "other") for i in range(10)]
    pages = spark.createDataFrame([(i, html(n, a, t, c)) for i, n, a, t, c in rows], "k long, html string")
    known = spark.createDataFrame([(i, f, str(v)) for i, n, a, t, _ in rows for f, v in (("name", n), ("age", a), ("height", t))] + [(1, "hip", None), (2, "hip", ""), (3, "hip", "none of it")], "k long, field string, value string")
    rules = {r.field: (r.selector, r.regex, r.votes) for r in dom.mined_rules(pages, known, "k", "html").collect()}
    assert rules == {"name": ("body > h1.who", None, 10), "age": ("div.data > span", r"(\d+)", 7), "height": ("div.data > p.spec", r"(\d+)", 7)}
    same = known.where("field <> 'age'").unionByName(known.where("field = 'age'").withColumn("value", dom.F.concat(dom.F.lit("AGE "), "value")))
    mined = {r.field: {"selector": r.selector, "regex": r.regex, "number": r.field == "height"} for r in dom.mined_rules(pages, same, "k", "html").collect()}
    assert mined["height"] == {"selector": "div.data > p.spec", "regex": r"T\s*(\d+)", "number": True}
    got = {r.k: (r.name, r.height) for r in dom.first_values(pages, "k", "html", {f: mined[f] for f in ("name", "height")}).collect()}
    assert got == {i: (n, t if c == "data" else None) for i, n, _, t, c in rows}
