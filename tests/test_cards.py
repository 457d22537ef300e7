"""Extraction from listing pages on small pieces of HTML."""

import gzip

from pyspark.sql import functions as F

from rankweave.operators import cards
from rankweave.sources import sinks


def value(spark, c, **row):
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'binary' if isinstance(v, bytes) else 'string'}" for k, v in row.items())).select(c).first()[0]


def test_resolved_links(spark):
    want = {"/x": "https://h/x", "//o/x": "https://o/x", "y": "https://h/a/y", "?q=1": "https://h/a/b?q=1", "#t": "https://h/a/b?p=2#t", "": "https://h/a/b?p=2", "http://z/": "http://z/", "mailto:a": "mailto:a"}
    rows = spark.createDataFrame([("https://h/a/b?p=2#f", k) for k in want], "base string, href string")
    assert {r.href: r.x for r in rows.select("href", cards.resolved(F.col("base"), F.col("href")).alias("x")).collect()} == want


def test_detail_links_fall_back_to_direct_children(spark):
    a = lambda h: f'<a href="{h}">{h}</a>'
    pages = [
        (1, "https://h/list/", a("/item/5") + a("https://other/item/6") + a("/list/x") + a("/item/5")),
        (2, "https://h/list", a("/list/x") + a("/list/blog") + a("/list/x/y") + a("/list?page=2") + a("/about")),
        (3, "https://h/list", ""),
        (4, None, a("/item/1")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = cards.detail_links(df, "page_id", "url", "html", [r"/item/\d+"], ["/blog"]).collect()
    assert sorted((r.page_id, r.link, r.direct) for r in got) == [(1, "https://h/item/5", False), (2, "https://h/list/x", True)]


def test_list_page_prefers_labels(spark):
    html = '<a href="#cast">cast</a><a href="/cast/">x</a><a href="https://o/">Cast</a><a href="/p"><b>Our CAST</b></a>'
    found = cards.list_page(F.lit("https://h/"), F.col("html"), ["cast"], ["/cast"])
    assert value(spark, found["link"], html=html) == "https://h/p"
    assert value(spark, found["link"], html='<a href="/cast/">x</a>') == "https://h/cast/"
    assert value(spark, found["link"], html="") is None


def test_cards_leave_out_logos_and_implausible_records(spark):
    li = '<li><a href="/1"><img src="/LOGO.png"><img data-src="a.jpg">Mei</a> AGE 20 T160</li><li><a href="/2">Old</a> AGE 90 T160</li><li>no link</li><li><a href="/3"></a>AGE 20 T160</li>'
    got = cards.cards(spark.createDataFrame([(1, "https://h/l/", li), (2, "https://h/", None)], "k long, url string, html string"), "k", "url", "html").collect()
    assert [(r.link, r.name, r.age, r.height, r.image, r.valid) for r in got] == [
        ("https://h/1", "Mei", 20, 160, "https://h/l/a.jpg", True),
        ("https://h/2", "Old", 90, 160, None, False),
        ("https://h/3", "", 20, 160, None, False),
    ]


def test_thumbnail_by_page_or_name(spark):
    html = '<a href="/1">Mei</a><a href="/2"><img src="data:x"><img src="/b.jpg"></a><a href="/3"><img src="/c.jpg">Rin</a>'
    thumb = lambda u, n: value(spark, cards.thumbnail(F.col("html"), F.lit("https://h/"), F.lit(u), F.lit(n)), html=html)
    assert thumb("https://h/2", "") == "https://h/b.jpg" and thumb("", "Rin") == "https://h/c.jpg" and thumb("", "") is None and thumb("", "Mei") is None


def test_script_literals():
    js = """var d = {items: [{name: "a ] b", 'n': 3, sub: {name: 'x'}}, {name: 'it\\'s'}, 5, []], items2: [{name: "no"}]}"""
    assert [o["name"] for o in cards.literal_objects(js, "items")] == ["a ] b", "it\\'s"] and cards.literal_objects(js, "items")[0]["n"] == "3"
    assert cards.literal_objects("items: [{a: 1}", "items") == [] and cards.literal_objects(None, "items") == []


def test_rules_with_fallback(spark):
    html = '<div id="box"><p class="a age">x 20</p><img class="i" src="/p.png"></div>'
    fields = cards.ruled_fields(F.col("html"), {"age": {"selector": "#box .age", "regex": r"y (\d+)", "fallback_regex": r"x (\d+)", "number": True}, "none": {"selector": "h1"}, "src": {"selector": "img.i", "attr": "src"}})
    row = spark.createDataFrame([(html,)], "html string").select(*[c.alias(n) for n, c in fields.items()]).first()
    assert tuple(row) == (20, None, "/p.png")


def test_charset(spark):
    of = lambda head, body: value(spark, cards.charset(F.col("head"), F.col("body")), head=head, body=body)
    assert of("text/html; charset=EUC-JP", b"") == "euc-jp"
    assert of("text/html; charset=ISO-8859-1", b"<meta charset='shift_jis'>") == "shift_jis"
    assert of(None, "é".encode()) == "utf-8" and of(None, b"\xe9") == "windows-1252"


def test_gzip_pages_and_page_cache(spark, tmp_path):
    (tmp_path / "in" / "top").mkdir(parents=True)
    with gzip.open(tmp_path / "in" / "top" / "7.html.gz", "wt", encoding="utf-8") as f:
        f.write("<p>é\n</p>")
    rows = sinks.read_gzip_pages(spark, str(tmp_path / "in"))
    assert [tuple(r) for r in rows.collect()] == [("top", "7", "<p>é\n</p>")]
    sinks.write_page_cache(rows, str(tmp_path / "out"))
    assert [r.html for r in spark.read.parquet(str(tmp_path / "out")).where("category = 'top'").collect()] == ["<p>é\n</p>"]


def test_numbers_cross_ranges(spark):
    got = sinks.numbered(spark.range(0, 100, 7), "id", width=10).orderBy("id").collect()
    assert [r.number for r in got] == list(range(1, 16))


def test_urls_like_seeds(spark):
    seeds = ["https://a.example/?castid=5", "https://a.example/?castid=7&x=1", "https://b.example/girls/1/p.html", "https://b.example/girls/2/p.html", "https://c.example/ann", "https://c.example/bea"]
    links = ["https://a.example/?castid=9", "https://a.example/?page=2", "https://a.example/girls/1", "https://b.example/girls/3/p.html", "https://b.example/girls/page/2/", "https://b.example/shop", "https://c.example/cleo", "https://c.example/blog/1", "https://c.example/schedule.html", "https://c.example/", "https://c.example/ann", "https://c.example/x.css", "https://d.example/1"]
    frame = lambda urls: spark.createDataFrame([(u,) for u in urls], "url string")
    kinds = cards.seed_patterns(frame(seeds).withColumn("site", cards.host(F.col("url"))), "site", "url")
    assert sorted(map(tuple, kinds.collect())) == [("a.example", "query", "castid"), ("b.example", "path", "/girls/"), ("c.example", "internal", "")]
    assert sorted(r.url for r in cards.urls_like_seeds(frame(seeds), frame(links), "url").collect()) == ["https://a.example/?castid=9", "https://b.example/girls/3/p.html", "https://c.example/cleo"]


def test_links_are_resolved_like_a_browser_does(spark):
    from urllib.parse import urljoin

    base = "https://a.example/x/y/z.html?q=1"
    hrefs = ["../b", "../../../../b", "./", ".", "..", "../..", "c/../d/./e?f=../g", "/p/../q", "a..b/c", "http://o.example/1/../2", "?k=../1", "d/..", "//h.example/./i"]
    df = spark.createDataFrame([(base, h) for h in hrefs], "b string, h string")
    got = {r.h: r.u for r in df.select("h", cards.resolved(F.col("b"), F.col("h")).alias("u")).collect()}
    whole = {"http://o.example/1/../2": "http://o.example/2", "//h.example/./i": "https://h.example/i"}  # these, too, as browsers do
    assert got == {h: whole.get(h) or urljoin(base, h) for h in hrefs}


def test_visible_text(spark):
    from rankweave.operators import html

    pages = {
        "<p>a &amp;lt; b</p><!-- <p>no</p> --><SCRIPT>x < y</SCRIPT >c<svg><p>d</p></svg>": "a &lt; b\nc",
        "  one\n two <b>three</b>&nbsp;<br/>&#65;&#x3042;&#x1F600; &#0; &unknown; &": "one\ntwo\nthree\nAあ😀 &#0; &unknown; &",
        "<style>never closed": "", "a < b > c": "a < b > c", "<!DOCTYPE html><?xml?>t": "t", "": "",
    }
    df = spark.createDataFrame([(h,) for h in pages] + [(None,)], "h string")
    assert {r.h: r.t for r in df.select("h", html.visible_text(F.col("h")).alias("t")).collect()} == pages | {None: ""}
