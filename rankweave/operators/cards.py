"""Links, cards and fields of listing pages, and what finds further pages.

Elements are found by patterns on the raw HTML, so an element ends at the first
closing tag of its name: selectors must name elements that hold none of their own
kind.  Only script literals, whose brackets nest, are read in Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import add, and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.functions.directory import attributes
from rankweave.functions.text import capture, to_int
from rankweave.operators.classify import id_patterns

ANCHOR = r'(?is)<a\b[^>]*?\bhref="([^"]*)"[^>]*>(.*?)</a>'
#: Words of image addresses that are no portraits, and second pages of a list.
NO_PORTRAIT = "logo|icon"
PAGED = r"[?&](?:page|p)=\d+|/page/\d+"
#: The ranges of plausible numbers.
PLAUSIBLE = {"age": (18, 60), "height": (140, 185), "bust": (60, 120), "waist": (45, 90), "hip": (60, 120)}
STATIC = r"(?i)\.(?:css|js|png|jpe?g|gif|svg|ico|webp|pdf|zip|mp4|woff2?)(?:\?.*)?$"


def origin(url: Column) -> Column:
    """Scheme and host; empty without them."""
    return F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*", 0)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    """The path without ``/`` at its end."""
    return F.regexp_replace(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")


def _folded(url: Column) -> Column:
    """A URL whose path has no ``.`` and ``..`` any more; ``..`` at the top goes."""
    start = origin(url)
    rest = F.substring(url, F.length(start) + 1, F.length(url))
    whole = F.regexp_extract(rest, "^[^?#]*", 0)
    parts = F.split(F.substring(whole, F.lit(2), F.length(whole)), "/")
    at_end = F.element_at(parts, -1).isin(".", "..")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda out, p: F.when(p == ".", out).when(p == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(p))))
    path_ = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(at_end & (F.size(kept) > 0), "/").otherwise(""))
    return F.concat(start, path_, F.substring(rest, F.length(whole) + 1, F.length(rest)))


def resolved(base: Column, href: Column) -> Column:
    """A link seen from its page, with ``.`` and ``..`` folded."""
    bare, file = F.substring_index(base, "#", 1), F.substring_index(F.substring_index(base, "#", 1), "?", 1)
    joined = (
        F.when(href.rlike("(?i)^[a-z][a-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, "^[^:]*:", 0), href))
        .when(href.startswith("/"), F.concat(origin(base), href))
        .when(href.startswith("#") | (href == ""), F.concat(bare, href))
        .when(href.startswith("?"), F.concat(file, href))
        .otherwise(F.concat(origin(base), F.coalesce(capture(F.substring(file, F.length(origin(base)) + 1, F.length(file)), "^(.*/)"), F.lit("/")), href))
    )
    return F.when(joined.rlike(r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*/(?:[^?#]*/)?\.\.?(?:[/?#]|$)"), _folded(joined)).otherwise(joined)


def plain(html: Column) -> Column:
    """Text without tags, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " "))


def anchors(html: Column) -> Column:
    """array<struct(href, inner)> of a page's links, in order."""
    hrefs, inner = F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)), F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2))
    return F.arrays_zip(hrefs.alias("href"), inner.alias("inner"))


def page_links(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """(key, pos, link, label, inner): links to the page's own host, each address once, at its first place."""
    rows = pages.select(key, F.col(url).alias("_url"), F.posexplode(anchors(F.col(html))).alias("pos", "_a"))
    rows = rows.select(key, "_url", "pos", resolved(F.col("_url"), F.col("_a.href")).alias("link"), F.col("_a.inner").alias("inner"))
    first = rows.where(host(F.col("link")) == host(F.col("_url"))).groupBy(key, "link").agg(F.min_by(F.struct("pos", "inner"), "pos").alias("_x"))
    return first.select(key, F.col("_x.pos").alias("pos"), "link", plain(F.col("_x.inner")).alias("label"), F.col("_x.inner").alias("inner"))


def list_page(url: Column, html: Column, label_words: list[str], url_words: list[str]) -> Column:
    """struct(tier, pos, link) of the link to a site's list: the first whose label holds a word,
    else the first whose address does; null without one."""
    words = lambda c, ws: F.lower(c).rlike("|".join(re.escape(w.lower()) for w in ws))

    def candidate(a: Column, i: Column) -> Column:
        link = resolved(url, a["href"])
        tier = F.when(words(plain(a["inner"]), label_words), 1).when(words(a["href"], url_words), 2)
        usable = ~a["href"].startswith("#") & (host(link) == host(url)) & tier.isNotNull()
        return F.when(usable, F.struct(tier.alias("tier"), i.alias("pos"), link.alias("link")))

    return F.array_min(F.array_compact(F.transform(anchors(html), candidate)))


def detail_links(pages: DataFrame, key: str, url: str, html: str, patterns: list[str], never: list[str]) -> DataFrame:
    """(key, link, label, direct): links to single records, by path patterns.

    A page without such links gives those right below its own path instead
    (``direct``), without the words of ``never``.  Links to the page itself and to
    further pages of the list go.
    """
    links = page_links(pages, key, url, html).join(pages.select(key, path(F.col(url)).alias("_own")), key)
    p = path(F.col("link"))
    rows = links.where((p != F.col("_own")) & ~F.col("link").rlike(PAGED)).withColumn("_hit", p.rlike("|".join(f"(?:{x})" for x in patterns)))
    below = (F.col("_own") != "") & p.startswith(F.concat("_own", F.lit("/"))) & (F.size(F.split(p, "/")) == F.size(F.split("_own", "/")) + 1) & ~F.lower(p).rlike("|".join(never))
    any_hit = rows.where("_hit").select(key).distinct().withColumn("_any", F.lit(True))
    marked = rows.withColumn("_below", below).join(any_hit, key, "left")
    return marked.where(F.col("_hit") | (F.col("_any").isNull() & F.col("_below"))).select(key, "link", "label", (~F.col("_hit")).alias("direct"))


def image_of(html: Column, base: Column) -> Column:
    """The first image's address in a piece of HTML, from src, data-src or data-lazy-src, that is no logo or icon and no inline data."""
    tags = F.regexp_extract_all(html, F.lit("(?is)<img\\b[^>]*>"), F.lit(0))
    source = lambda t: F.coalesce(*[capture(t, rf'(?is)\s{name}="([^"]+)"') for name in ("src", "data-src", "data-lazy-src")])
    usable = F.filter(F.transform(tags, source), lambda s: s.isNotNull() & ~F.lower(s).rlike(NO_PORTRAIT) & ~s.startswith("data:"))
    return F.when(F.size(usable) > 0, resolved(base, F.get(usable, F.lit(0))))


def thumbnail(html: Column, base: Column, source_url: Column, name: Column) -> Column:
    """The image inside the first link that leads to the record's page or names it; null without one."""
    leads = lambda a: F.contains(resolved(base, a["href"]), F.nullif(source_url, F.lit("")))
    names = lambda a: F.contains(plain(a["inner"]), F.nullif(name, F.lit("")))
    found = F.filter(anchors(html), lambda a: F.coalesce(leads(a), F.lit(False)) | F.coalesce(names(a), F.lit(False)))
    images = F.array_compact(F.transform(found, lambda a: image_of(a["inner"], base)))
    return F.get(images, F.lit(0))


def cards(pages: DataFrame, key: str, url: str, html: str, element: str = "li") -> DataFrame:
    """(key, link, name, age, height, bust, waist, hip, image, valid) of each ``element`` that holds a link.

    Numbers come from the card's text.  A card is valid with a name, two of age, height,
    sizes and image, no number out of range, and no other number equal to the age.
    """
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<{element}\b[^>]*>.*?</{element}>"), F.lit(0))
    rows = pages.select(key, F.col(url).alias("_url"), F.explode(found).alias("_card"))
    link, inner = F.regexp_extract("_card", ANCHOR, 1), F.regexp_extract("_card", ANCHOR, 2)
    text = plain(F.col("_card"))
    known = attributes(text)
    out = rows.where(F.col("_card").rlike(ANCHOR)).select(
        key, resolved(F.col("_url"), link).alias("link"), plain(inner).alias("name"), *[c.alias(n) for n, c in known.items()], image_of(F.col("_card"), F.col("_url")).alias("image")
    )
    return out.withColumn("valid", plausible_card())


def plausible_card() -> Column:
    """Whether a card's columns have a name, two of age, height, sizes and image, no number out of range, and no other number equal to the age."""
    counted = [F.col("age").isNotNull(), F.col("height").isNotNull(), F.coalesce("bust", "waist", "hip").isNotNull(), F.col("image").isNotNull()]
    plausible = reduce(and_, [F.coalesce(F.col(c).between(*r), F.lit(True)) for c, r in PLAUSIBLE.items()])
    mixed_up = reduce(or_, [F.coalesce(F.col("age") == F.col(c), F.lit(False)) for c in PLAUSIBLE if c != "age"])
    return (F.col("name") != "") & plausible & ~mixed_up & (reduce(add, [c.cast("int") for c in counted]) >= 2)


def _element(selector: str) -> str:
    """The pattern of ``tag``, ``.class``, ``#id`` or a tag with either: group 1 its name, 2 its content."""
    tag, kind, word = re.fullmatch(r"([A-Za-z][A-Za-z0-9]*)?(?:([.#])([\w-]+))?", selector).groups()
    need = {None: "", ".": rf'(?=[^>]*\sclass="(?:[^"]*\s)?{word}(?:\s[^"]*)?")', "#": rf'(?=[^>]*\sid="{word}")'}[kind]
    return rf"(?is)<({tag or '[a-z][a-z0-9]*'})\b{need}[^>]*>(.*?)</\1>"


def selected(html: Column, selector: str, attr: str | None = None) -> Column:
    """Text, or an attribute, of the first element that a selector names; its steps, apart by blanks, go inwards."""
    *outer, last = selector.split()
    for step in outer:
        html = capture(html, _element(step), 2)
    if attr is None:
        return F.nullif(plain(F.regexp_extract(html, _element(last), 2)), F.lit(""))
    opened = _element(last).rsplit("(.*?)", 1)[0]
    return capture(F.regexp_extract(html, opened, 0), rf'(?is)\s{attr}="([^"]*)"')


def ruled_fields(html: Column, rules: dict[str, dict]) -> dict[str, Column]:
    """A field's value by its rule: ``selector``, and if given ``attr``, ``regex``, ``fallback_regex``, ``number``."""
    out = {}
    for field, rule in rules.items():
        value = selected(html, rule["selector"], rule.get("attr"))
        tried = [capture(value, p) for p in (rule.get("regex"), rule.get("fallback_regex")) if p]
        value = F.coalesce(*tried) if tried else value
        out[field] = to_int(value) if rule.get("number") else value
    return out


_MARK = re.compile(r"""[\[\]{}]|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'""", re.S)
_PAIR = re.compile(r"""([A-Za-z_$][\w$]*|"[^"]*"|'[^']*')\s*:\s*(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|(-?[\w.]+))""", re.S)


def literal_objects(script: str | None, name: str) -> list[dict[str, str]]:
    """The objects in the array ``name: [...]`` of a script, with their plain values, the first of a name; brackets in strings don't count."""
    begin = re.search(rf"\b{re.escape(name)}\s*[:=]\s*\[", script or "")
    out, depth, opened = [], 0, 0
    for mark in _MARK.finditer(script, begin.end() - 1) if begin else ():
        if mark[0] in "[{":
            depth += 1
            opened = mark.start() if depth == 2 and mark[0] == "{" else opened
        elif mark[0] in "]}":
            depth -= 1
            if depth == 1 and mark[0] == "}":
                values: dict[str, str] = {}
                for p in _PAIR.finditer(script, opened, mark.start()):
                    values.setdefault(p[1].strip("\"'"), next(v for v in p.groups()[1:] if v is not None))
                out.append(values)
            elif depth == 0:
                return out
    return []


def script_records(rows: DataFrame, script: str, name: str) -> DataFrame:
    """One row for each object of the array in ``script``, its values in the map ``record``; an unclosed array has none."""

    @F.pandas_udf(T.ArrayType(T.MapType(T.StringType(), T.StringType())))
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for scripts in batches:
            yield scripts.map(lambda s: literal_objects(s, name))

    return rows.withColumn("record", F.explode(parse(F.col(script)))).drop(script)


def expanded_urls(seeds: DataFrame, links: DataFrame, url: str) -> DataFrame:
    """(site, url): links of a seed's site that follow what its seeds have in common, and are no seeds,
    files or further pages of a list."""
    with_site = lambda df: df.select(host(F.col(url)).alias("site"), F.col(url).alias("url")).where("site <> ''").distinct()
    known = with_site(seeds)
    patterns = id_patterns(known, "site", "url")
    fits = F.when(F.col("kind") == "query", F.regexp_extract("url", r"\?([^#]*)", 1).startswith(F.concat("value", F.lit("="))))
    fits = fits.otherwise(F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1).startswith(F.col("value")))
    new = with_site(links).where(~F.col("url").rlike(STATIC) & ~F.col("url").rlike(PAGED)).join(known, ["site", "url"], "left_anti")
    return new.join(patterns, "site").where(fits).select("site", "url")


#: Paths and files of a site that hold no records.
NO_RECORDS = [
    "/category/", "/tag/", "/author/", "/wp-admin/", "/wp-content/", "/wp-login/", "/wp-json/", "/wp-includes/", "/page/", "/feed/", "/comments/", "/trackback/", "/xmlrpc", "/sitemap", "/cdn-cgi/",
    "/cart/", "/checkout/", "/attachment/", "/reservation", "/contact", "/access", "/privacy", "/terms", "/inquiry", "/recruit", "/faq", "/blog/", "/news/", "/diary/", "/diary_detail/",
]
NO_RECORD_FILES = [
    "main.html", "rate.html", "menu.html", "price.html", "access.html", "about.html", "contact.html", "top.html", "home.html", "info.html", "system.html", "concept.html", "recruit.html", "privacy.html",
    "itemlist.html", "scheduleal.html", "scheduleall.html", "schedule.html", "reservation.html", "reserve.html", "map.html", "faq.html", "news.html", "index.html", "sitemap.html", "terms.html", "blog.html",
    "link.html", "enquete.html", "kinsi.html", "sch.html",
]


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def seed_patterns(seeds: DataFrame, site: str, url: str) -> DataFrame:
    """(site, kind, value): what links to further records of a site look like, by the addresses of known ones.

    ``query``: the first key of any seed's query.  ``path``: the longest beginning of whole
    segments that all seeds' paths share.  ``internal``: a site whose seeds have neither.
    """
    rows = seeds.select(F.col(site).alias("site"), F.col(url).alias("url")).distinct()
    queries = rows.where(query_of(F.col("url")) != "").select("site", F.lit("query").alias("kind"), F.substring_index(query_of(F.col("url")), "=", 1).alias("value")).distinct()
    paths = rows.select("site", "url", F.split(path(F.col("url")), "/").alias("parts")).where("size(parts) > 1")
    total = paths.groupBy("site").agg(F.count("*").alias("total"))
    begins = paths.select("site", F.posexplode(F.transform(F.sequence(F.lit(2), F.size("parts")), lambda k: F.array_join(F.slice("parts", 1, k), "/"))).alias("depth", "value"))
    shared = begins.groupBy("site", "value").agg(F.count("*").alias("n"), F.max("depth").alias("depth")).join(total, "site").where("n = total")
    longest = shared.groupBy("site").agg(F.max_by("value", "depth").alias("value")).select("site", F.lit("path").alias("kind"), F.concat("value", F.lit("/")).alias("value"))
    known = queries.unionByName(longest)
    others = rows.select("site").distinct().join(known, "site", "left_anti").select("site", F.lit("internal").alias("kind"), F.lit("").alias("value"))
    return known.unionByName(others)


def urls_like_seeds(seeds: DataFrame, links: DataFrame, url: str) -> DataFrame:
    """(site, url): links of a seed's site that fit one of its patterns and are no seeds, files or further pages of a list.

    On sites without a pattern every link to a path fits, but for those of ``NO_RECORDS``.
    """
    with_site = lambda df: df.select(host(F.col(url)).alias("site"), F.col(url).alias("url")).where("site <> ''").distinct()
    known = with_site(seeds)
    where, whole = F.lower(path(F.col("url"))), F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    usable = ~F.col("url").rlike(STATIC) & ~whole.rlike(r"/page/\d+(?:/|$)") & ~F.substring_index(where, "/", -1).isin(NO_RECORD_FILES)
    new = with_site(links).where(usable).join(known, ["site", "url"], "left_anti")
    nothing = reduce(or_, [where.startswith(p) for p in NO_RECORDS], where == "")
    fits = F.when(F.col("kind") == "query", query_of(F.col("url")).startswith(F.concat("value", F.lit("=")))).when(F.col("kind") == "path", whole.startswith(F.col("value"))).otherwise(~nothing)
    return new.join(seed_patterns(known, "site", "url"), "site").where(fits).select("site", "url").distinct()


def charset(content_type: Column, body: Column) -> Column:
    """A body's character set: its header, but for the default ISO-8859-1; else the meta tag in its first
    2,048 bytes; else utf-8 if it is valid as such; else windows-1252."""
    head = F.lower(F.decode(F.substring(body, 1, 2048), "ISO-8859-1"))
    from_header = capture(F.lower(content_type), r"charset=[\"']?([\w-]+)")
    guess = F.when(F.is_valid_utf8(body.cast("string")), "utf-8").otherwise("windows-1252")
    return F.coalesce(F.when(~from_header.rlike("^iso-?8859-?1$"), from_header), capture(head, r"<meta[^>]*charset=[\"']?([\w-]+)"), guess)
