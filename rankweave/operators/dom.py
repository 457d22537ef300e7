"""Elements of pages as nested sets: selectors, enclosing elements, and rules mined from known values.

A page is split at its ``<``; an element is the interval of places from its opening
tag to its closing one, which is the next that leaves its level among tags of the
same name.  Ancestor and descendant are then tests of intervals, and "inside a
match" is a running count of matches begun and ended, by sorted arrays of a page:
no page is spread over rows and shuffled.

Comments, scripts and styles go first.  A tag without an end (void ones, and those
that are never closed) is an empty element; closing tags without a beginning are
passed over.  A page is what a task holds at once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions.arrays import bind, running
from rankweave.functions.directory import attributes
from rankweave.functions.text import capture
from rankweave.operators.cards import host, image_of, plain, plausible_card, resolved

#: Elements without content.
VOID = "area base br col embed hr img input link meta source track wbr".split()
#: Fixed value: the letters of a label before a number.
LABEL = "[A-Za-z\\u3040-\\u9fff]+"
_HIDDEN = r"(?is)<!--.*?-->|<!doctype[^>]*>|<script\b.*?</script\s*>|<style\b.*?</style\s*>"


def parsed(pages: DataFrame, key: str, html: str, *keep: str) -> DataFrame:
    """(key, pieces, kept columns): each page's pieces between its ``<``."""
    return pages.select(key, F.split(F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, ""), "<").alias("pieces"), *keep)


def _marks(pieces: Column) -> Column:
    """A page's tags: array<struct(tag, open, ends, attrs, step)>."""
    tag = lambda p: F.lower(F.regexp_extract(p, "^/?([A-Za-z][A-Za-z0-9-]*)", 1))
    tags = F.filter(F.transform(pieces, lambda p, i: F.struct(tag(p).alias("tag"), i.alias("open"), p.alias("piece"))), lambda m: (m["open"] > 0) & (m["tag"] != ""))
    attrs = lambda p: F.regexp_extract(p, "(?s)^/?[A-Za-z][A-Za-z0-9-]*([^>]*)", 1)
    marks = F.transform(tags, lambda m: F.struct(m["tag"].alias("tag"), m["open"].alias("open"), m["piece"].startswith("/").alias("ends"), attrs(m["piece"]).alias("attrs")))
    step = lambda m: F.when(m["tag"].isin(VOID) | m["attrs"].rlike(r"/\s*$"), 0).when(m["ends"], -1).otherwise(1)
    return F.filter(F.transform(marks, lambda m: F.struct(m["tag"].alias("tag"), m["open"].alias("open"), m["ends"].alias("ends"), m["attrs"].alias("attrs"), step(m).alias("step"))), lambda m: ~((m["step"] == 0) & m["ends"]))


def _sums(values: Column) -> Column:
    return running(values, lambda a, b: a + b, F.lit(0).cast("bigint"))


def _closed(marks: Column) -> Column:
    """array<struct(open, close, tag, attrs)> of the elements, by place."""

    def levels(ms: Column) -> Column:  # by tag; sums over all tags differ from those of one by the same number within a tag
        level = lambda m, before: before + m["step"] + m["ends"].cast("int")
        return F.zip_with(ms, _sums(F.transform(ms, lambda m: m["step"].cast("bigint"))), lambda m, b: F.struct(m["tag"].alias("tag"), level(m, b).alias("level"), m["open"].alias("open"), m["ends"].alias("ends"), m["attrs"].alias("attrs"), m["step"].alias("step")))

    def ended(ms: Column) -> Column:
        def element(m: Column, i: Column) -> Column:
            after = F.get(ms, i + 1)
            ends = F.coalesce((m["step"] == 1) & (after["tag"] == m["tag"]) & (after["level"] == m["level"]) & after["ends"], F.lit(False))
            return F.when(~m["ends"], F.struct(m["open"].alias("open"), F.when(ends, after["open"]).otherwise(m["open"]).alias("close"), m["tag"].alias("tag"), m["attrs"].alias("attrs")))

        return F.array_compact(F.transform(ms, element))

    return F.array_sort(bind(F.array_sort(bind(F.array_sort(marks), levels)), ended))


def _around(found: Column, begins: Callable[[Column, Column], Column]) -> Column:
    """For each element, by place, how many of those that ``begins`` tells (element, number) are around it."""
    turns = F.flatten(
        F.transform(
            found,
            lambda e, i: F.when((e["close"] > e["open"]) & begins(e, i), F.array(_turn(e["open"], 0), _turn(e["open"], 1), _turn(e["close"], -1))).otherwise(F.array(_turn(e["open"], 0))),
        )
    )
    counted = lambda ts: F.zip_with(ts, _sums(F.transform(ts, lambda t: t["turn"].cast("bigint"))), lambda t, n: F.when(t["turn"] == 0, n))
    return F.array_compact(bind(F.array_sort(turns), counted))


def _turn(place: Column, turn: int) -> Column:
    return F.struct(place.alias("place"), F.lit(turn).alias("turn"))


def _placed(found: Column) -> Column:
    """Elements with depth, place of their parent and ``up``, the parent's number in the array: the last of the depth above that has begun."""

    def parents(es: Column) -> Column:
        # By depth: what may hold others, and one that asks in the depth above.
        both = F.flatten(F.transform(es, lambda e, i: F.array(_ask(e["depth"] + 1, i, e["close"] > e["open"], False), _ask(e["depth"], i, F.lit(False), True))))
        last = lambda asks: running(F.transform(asks, lambda x: F.when(x["holds"], F.shiftleft(x["level"], 32) + x["i"]).otherwise(-1)), F.greatest, F.lit(-1).cast("bigint"))
        up = lambda x, n: F.when(x["asks"], F.struct(x["i"].alias("i"), F.when(F.shiftright(n, 32) == x["level"], n.bitwiseAND(F.lit((1 << 32) - 1))).cast("int").alias("up")))
        ups = F.array_sort(F.array_compact(bind(F.array_sort(both), lambda asks: F.zip_with(asks, last(asks), up))))
        return F.zip_with(es, ups, lambda e, u: F.struct(e["open"].alias("open"), e["close"].alias("close"), F.get(es, u["up"])["open"].alias("parent"), u["up"].alias("up"), e["depth"].alias("depth"), e["tag"].alias("tag"), e["attrs"].alias("attrs")))

    deep = lambda es: F.zip_with(es, _around(es, lambda e, i: F.lit(True)), lambda e, d: F.struct(e["open"].alias("open"), e["close"].alias("close"), d.alias("depth"), e["tag"].alias("tag"), e["attrs"].alias("attrs")))
    return bind(bind(found, deep), parents)


def _ask(level: Column, i: Column, holds: Column, asks: bool) -> Column:
    return F.struct(level.alias("level"), i.alias("i"), holds.alias("holds"), F.lit(asks).alias("asks"))


def tree(pieces: Column) -> Column:
    """array<struct(open, close, parent, up, depth, tag, attrs)> of a page's elements, by place."""
    return _placed(_closed(_marks(pieces)))


def elements(pieces: DataFrame, key: str) -> DataFrame:
    """(key, open, close, parent, depth, tag, attrs) of every element; ``parent`` is the place where it opens, null at the top."""
    return pieces.select(key, F.explode(tree(F.col("pieces"))).alias("e")).select(key, *[f"e.{c}" for c in ("open", "close", "parent", "depth", "tag", "attrs")])


def _named(step: str, e: Column) -> Column:
    """Whether an element fits ``tag``, ``.class``, ``#id`` or several of them in one."""
    tag, marks = re.fullmatch(r"([A-Za-z][A-Za-z0-9-]*)?((?:[.#][\w-]+)*)", step).groups()
    fits = e["tag"] == tag.lower() if tag else F.lit(True)
    for kind, word in re.findall(r"([.#])([\w-]+)", marks):
        value = rf"(?:[^\"']*\s)?{re.escape(word)}(?:\s[^\"']*)?" if kind == "." else re.escape(word)
        fits &= e["attrs"].rlike(rf"(?is)\s{'class' if kind == '.' else 'id'}\s*=\s*[\"']{value}[\"']")
    return fits


def selected(found: Column, selector: str) -> Column:
    """The elements of a ``tree`` that a selector names: steps apart by blanks lie anywhere inside one another, by ``>`` directly."""
    steps = re.findall(r"(>)?\s*([^\s>]+)", selector)

    def within(es: Column, k: int) -> Column:
        """For each element whether it is named by the steps up to the k-th."""
        direct, step = steps[k]
        if k == 0:
            return F.transform(es, lambda e: _named(step, e))
        if direct:
            return bind(within(es, k - 1), lambda outer_: F.transform(es, lambda e: _named(step, e) & F.coalesce(F.get(outer_, e["up"]), F.lit(False))))
        return bind(within(es, k - 1), lambda outer_: F.zip_with(es, _around(es, lambda e, i: F.get(outer_, i)), lambda e, n: _named(step, e) & (n > 0)))

    return bind(found, lambda es: bind(within(es, len(steps) - 1), lambda hit: F.filter(es, lambda e, i: F.get(hit, i))))


def select(found: DataFrame, key: str, selector: str) -> DataFrame:
    """The rows of ``elements`` that a selector names."""
    pages = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("open", "close", "parent", "depth", "tag", "attrs"))).alias("es"))
    up = lambda es: F.transform(es, lambda e: e.withField("up", F.nullif(F.array_position(F.transform(es, lambda x: x["open"]), e["parent"]), F.lit(0)).cast("int") - 1))
    return pages.select(key, F.explode(selected(bind(F.col("es"), up), selector)).alias("e")).select(key, *[f"e.{c}" for c in found.columns if c != key])


def outer(pieces: Column, opened: Column, closed: Column) -> Column:
    """An element's HTML, from its own tag up to its closing one."""
    held = F.array_join(F.slice(pieces, opened + 1, F.greatest(closed - opened, F.lit(1))), "<")
    return F.concat(F.lit("<"), F.when(closed > opened, held).otherwise(F.regexp_extract(held, "(?s)^[^>]*>?", 0)))


def first_values(pages: DataFrame, key: str, html: str, rules: dict[str, dict]) -> DataFrame:
    """(key, a column for each rule): what rules find on each page, null where they find nothing.

    A rule has a ``selector``, and if given ``attr``, ``regex`` (its first group) and ``number``.
    It reads the first element that its selector names.
    """
    rows = parsed(pages, key, html).withColumn("tree", tree(F.col("pieces")))
    selectors = sorted({r["selector"] for r in rules.values()})
    first = lambda es: F.get(es, F.lit(0))
    own = [bind(first(selected(F.col("tree"), s)), lambda e: outer(F.col("pieces"), e["open"], e["close"])).alias(f"_own{i}") for i, s in enumerate(selectors)]
    rows = rows.select(key, *own)
    columns = []
    for name, rule in rules.items():
        element = F.col(f"_own{selectors.index(rule['selector'])}")
        value = capture(F.regexp_extract(element, "(?s)^<[^>]*>", 0), rf"(?is)\s{rule['attr']}\s*=\s*[\"']([^\"']*)[\"']") if rule.get("attr") else F.nullif(plain(element), F.lit(""))
        value = capture(value, rule["regex"]) if rule.get("regex") else value
        columns.append((value.try_cast("int") if rule.get("number") else value).alias(name))
    return rows.select(key, *columns)


def enclosing_cards(pages: DataFrame, key: str, url: str, html: str, links: DataFrame | None = None) -> DataFrame:
    """(key, link, name, age, height, bust, waist, hip, image, valid) from the elements around a page's links.

    A link's card is the element right around its first anchor; links right below the
    body have none.  ``links`` (key, link) names those wanted: by default all to the
    page's own host.  Validity is as for ``cards.cards``.
    """
    rows = parsed(pages, key, html, F.col(url).alias("_url")).withColumn("tree", tree(F.col("pieces")))
    link = lambda e: resolved(F.col("_url"), capture(e["attrs"], r"(?is)\shref\s*=\s*[\"']([^\"']*)[\"']"))
    anchors = F.transform(F.filter("tree", lambda e: e["tag"] == "a"), lambda e: F.struct(link(e).alias("link"), e["open"].alias("open"), e["close"].alias("close"), e["up"].alias("up")))
    wanted = F.filter(anchors, lambda a: a["link"].isNotNull() & ((host(a["link"]) == host(F.col("_url"))) if links is None else F.lit(True)))
    first = lambda found: F.filter(found, lambda a, i: (i == 0) | (F.get(found, i - 1)["link"] != a["link"]))
    rows = rows.withColumn("anchors", bind(F.array_sort(wanted), first))

    def card_of(pieces: Column, es: Column) -> Column:
        html_of = lambda e: outer(pieces, e["open"], e["close"])
        return F.transform("anchors", lambda a: F.struct(a["link"].alias("link"), plain(html_of(a)).alias("name"), bind(F.get(es, a["up"]), lambda e: F.when(~e["tag"].isin("body", "html"), html_of(e))).alias("_card")))

    rows = rows.select(key, "_url", F.explode(bind(F.col("pieces"), lambda p: bind(F.col("tree"), lambda es: card_of(p, es)))).alias("a"))
    card = rows.select(key, "a.link", "a.name", "_url", "a._card").where("_card is not null")
    card = card if links is None else card.join(links.hint("merge"), [key, "link"], "left_semi")
    known = attributes(plain(F.col("_card")))
    out = card.select(key, "link", "name", *[c.alias(n) for n, c in known.items()], image_of(F.col("_card"), F.col("_url")).alias("image"))
    return out.withColumn("valid", plausible_card())


def mined_rules(pages: DataFrame, known: DataFrame, key: str, html: str, share: float = 0.5, numbers: tuple[str, ...] = ("age", "height", "bust", "waist", "hip")) -> DataFrame:
    """(field, selector, regex, votes): how to find fields on pages, learned from pages whose values are known.

    ``known`` has (key, field, value).  A value votes for the deepest element whose own
    text holds it, the first of equals, by the tags and classes of that element and the
    one around it.  A field takes the selector of most votes, if ``share`` of its known
    pages agree.  Where fields share a selector, each reads the number after its label:
    the letters before the value on the first agreeing page.
    """
    rows = parsed(pages, key, html).withColumn("tree", tree(F.col("pieces")))
    classed = lambda e: capture(e["attrs"], r"(?is)\sclass\s*=\s*[\"']\s*([\w-]+)")
    step = lambda e: F.concat(e["tag"], F.coalesce(F.concat(F.lit("."), classed(e)), F.lit("")))
    # an element's own texts: after its tag, and after those that end right inside it
    part = lambda of, place: F.struct(of.alias("of"), place.alias("place"), F.regexp_extract(F.get("pieces", place), "(?s)^[^>]*>(.*)$", 1).alias("text"))
    parts = F.transform("tree", lambda e, i: F.array(F.when(e["close"] > e["open"], part(i, e["open"])), F.when(e["up"].isNotNull(), part(e["up"], e["close"]))))
    texts = F.filter(F.array_compact(F.flatten(parts)), lambda t: F.trim(t["text"]) != "")
    placed = lambda e, t: F.struct(F.concat_ws(" > ", step(F.get("tree", e["up"])), step(e)).alias("selector"), e["depth"].alias("depth"), e["open"].alias("open"), t["place"].alias("place"), t["text"].alias("text"))
    own = rows.select(key, F.explode(F.transform(texts, lambda t: bind(F.get("tree", t["of"]), lambda e: placed(e, t)))).alias("t")).select(key, "t.*")
    # Spark takes both sides for as small as the tables they are formed of, and would broadcast one.
    held = own.join(known.where("value is not null and value <> ''").hint("merge"), key).where(F.contains("text", F.col("value").cast("string")))
    voted = held.groupBy(key, "field").agg(F.min_by(F.struct("selector", "value", "text"), F.struct(-F.col("depth"), "open", "place")).alias("v")).select(key, "field", "v.*")
    votes = voted.groupBy("field", "selector").agg(F.count("*").alias("votes"), F.min_by(F.struct("value", "text"), key).alias("sample"))
    sizes = known.where("value is not null").groupBy("field").agg(F.countDistinct(key).alias("known"))
    best = votes.groupBy("field").agg(F.min_by(F.struct("selector", "votes", "sample"), F.struct(-F.col("votes"), "selector")).alias("b")).select("field", "b.*")
    kept = best.join(sizes, "field").where(F.col("votes") >= share * F.col("known"))
    meets = F.count("*").over(Window.partitionBy("selector"))  # a row for each field
    label = capture(F.expr("substring_index(sample.text, sample.value, 1)"), rf"({LABEL})\s*$")
    number = F.col("field").isin(*numbers)
    regex = F.when((meets > 1) & label.isNotNull(), F.concat(label, F.lit(r"\s*(\d+)"))).when(number, F.lit(r"(\d+)"))
    return kept.select("field", "selector", regex.alias("regex"), "votes")
