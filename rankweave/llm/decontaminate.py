"""Benchmark decontamination by winnowing.

All of it is DataFrame functions.  Words are maximal runs of ASCII letters and
digits and of all characters beyond ASCII, lower-cased in A-Z only.

Of every ``SPAN - GRAM + 1`` consecutive GRAM-word hashes the least is kept, in
documents and items alike, so any shared span of SPAN words shares a
fingerprint.  Document fingerprints are joined with those of the items; each hit
is extended in both directions, and what has reached SPAN words is a match.
Items shorter than SPAN words are one window each, matched by the hash of the
whole item.

The benchmark's fingerprints are counted first.  Up to ``max_listed`` of them,
they sift the documents' fingerprints where those are made, and are broadcast
for the join; beyond that, all document fingerprints go into a shuffled join.

Defined results: null and empty texts and items have no words and no hits;
equal items each count, sorted by their ids as strings; repeated document rows
are judged each for itself; a very long text is judged whole; an empty table
gives an empty one, and an empty benchmark no hits; other columns are kept, but for
the text and those named n_words, hits and items, which are replaced; items with
null ids hit like others, and all of them are one null at the end of ``items``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import bind, materialize

SPAN = 10
GRAM = 5
REACH = SPAN - GRAM
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    folded = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(folded, SEPARATORS), lambda w: w != "")


def _grams(hashes: Column, size: int) -> Column:
    """Hashes of runs of ``size`` words, by start, from a column of word hashes."""
    runs = F.transform(F.sequence(F.lit(0), F.size(hashes) - size), lambda i: F.xxhash64(F.lit(size), *[F.get(hashes, i + k) for k in range(size)]))
    return F.when(F.size(hashes) >= size, runs).otherwise(F.array().cast("array<bigint>"))


def _winnow(grams: Column) -> Column:
    """Hashes that are the least of some full window of them, with their places."""
    width = SPAN - GRAM + 1
    none = F.array().cast("array<bigint>")

    def minima(g: Column) -> Column:
        least = lambda i: F.least(*[F.get(g, i + k) for k in range(width)])
        return F.when(F.size(g) >= width, F.transform(F.sequence(F.lit(0), F.size(g) - width), least)).otherwise(none)

    def spots(g: Column, m: Column) -> Column:
        def chosen(h: Column, i: Column) -> Column:  # the least of one of the windows it stands in
            found = F.lit(False)
            for k in range(width):
                found = found | F.coalesce(F.when(i >= k, F.get(m, i - k)) == h, F.lit(False))
            return found

        return F.filter(F.transform(g, lambda h, i: F.struct(F.when(chosen(h, i), i).alias("at"), h.alias("print"))), lambda x: x["at"].isNotNull())

    return bind(grams, lambda g: bind(minima(g), lambda m: spots(g, m)))


def item_prints(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, words, size, at, print): size GRAM for winnowed items, else the item's length."""
    base = items.select(F.col(item).alias("item_id"), words(F.col(text)).alias("words")).where("size(words) > 0").withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    long = base.where(F.size("words") >= SPAN).select("item_id", "words", F.lit(GRAM).alias("size"), F.explode(_winnow(_grams(F.col("h"), GRAM))).alias("g"))
    out = long.select("item_id", "words", "size", "g.at", "g.print")
    for size in range(1, SPAN):
        short = base.where(F.size("words") == size)
        out = out.unionByName(short.select("item_id", "words", F.lit(-size).alias("size"), F.lit(0).alias("at"), F.element_at(_grams(F.col("h"), size), 1).alias("print")))
    return out


def _same_run(doc_word, item_word, reach: int) -> Column:
    """How many steps agree before the first that doesn't, at most ``reach``."""
    agree = F.array(*[F.coalesce(doc_word(k) == item_word(k), F.lit(False)) for k in range(1, reach + 1)])
    stop = F.array_position(agree, False)
    return F.when(stop > 0, stop - 1).otherwise(F.lit(reach)).cast("int")


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", max_listed: int = 100_000) -> DataFrame:
    """n_words, hits (sorted distinct spans of hit words) and items (sorted ids as strings).

    One row for each row of ``docs``, with all its columns but the text, which
    has no part in what is shuffled.
    """
    keys = [c for c in docs.columns if c not in (text, "n_words", "hits", "items")]
    prints = materialize(item_prints(items, item, item_text), "benchmark-prints")
    sizes = sorted(r.size for r in prints.select("size").distinct().collect())  # at most SPAN values
    listed = [r.print for r in prints.select("print").distinct().limit(max_listed + 1).collect()]
    few = len(listed) <= max_listed
    row = F.struct(*[F.col(f"`{c}`") for c in keys]) if keys else F.struct(F.lit(0).alias("none"))
    body = docs.select(row.alias("keys"), words(F.col(f"`{text}`")).alias("w")).withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))
    w, h, found = F.col("w"), F.col("h"), []
    for size in sizes or [GRAM]:
        spots = _winnow(_grams(h, size)) if size > 0 else F.transform(_grams(h, -size), lambda p, i: F.struct(i.alias("at"), p.alias("print")))
        if few:
            spots = F.filter(spots, lambda g: g["print"].isin(listed))
        found.append(_with_context(spots, w, size))
    rows = body.select(F.monotonically_increasing_id().alias("n"), "keys", F.size("w").cast("long").alias("n_words"), F.concat(*found).alias("spots"))
    return _match(rows, prints, few).select(*[F.col(f"keys.`{c}`").alias(c) for c in keys], "n_words", "hits", "items")


def _with_context(spots: Column, w: Column, size: int) -> Column:
    """Add to each fingerprint its size and the words that an extension may reach."""

    def around(g: Column) -> Column:
        return F.transform(F.sequence(g["at"] - REACH, g["at"] + (abs(size) + REACH - 1)), lambda i: F.when(i >= 0, F.get(w, i)))

    return F.transform(spots, lambda g: F.struct(F.lit(size).alias("size"), g["at"].alias("at"), g["print"].alias("print"), around(g).alias("around")))


def _match(rows: DataFrame, prints: DataFrame, few: bool) -> DataFrame:
    """Join fingerprints with the items', extend the hits, and gather them by row."""
    side = prints.select(*[F.col(c).alias(f"item_{c.removeprefix('item_')}") for c in prints.columns])
    side = F.broadcast(side) if few else side  # bounded by max_listed
    spots = rows.select("n", "keys", "n_words", F.explode_outer("spots").alias("g"))
    hit = spots.join(side, (F.col("g.print") == F.col("item_print")) & (F.col("g.size") == F.col("item_size")), "left")
    at, size, around = F.col("g.at"), F.abs("g.size"), F.col("g.around")
    item, item_at = F.col("item_words"), F.col("item_at")
    left = _same_run(lambda k: F.get(around, F.lit(REACH - k)), lambda k: F.when(item_at >= k, F.get(item, item_at - k)), REACH)
    right = _same_run(lambda k: F.get(around, size + (REACH + k - 1)), lambda k: F.get(item, item_at + size + (k - 1)), REACH)
    middle = F.slice(around, REACH + 1, size) == F.slice(item, item_at + 1, size)
    span = F.when(F.col("item_size") < 0, F.struct(at.alias("start"), (at + size).alias("end"))).when(left + size + right >= SPAN, F.struct((at - left).alias("start"), (at + size + right).alias("end")))
    span = F.when(F.col("item_print").isNotNull() & middle, span)
    found = hit.select("n", "keys", "n_words", span.alias("span"), F.col("item_id").cast("string").alias("item"))
    bare = F.max(F.col("span").isNotNull() & F.col("item").isNull())
    ids = F.array_sort(F.collect_set(F.when(F.col("span").isNotNull(), F.col("item"))))
    return found.groupBy("n").agg(
        F.first("keys").alias("keys"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.collect_set("span")).alias("hits"),
        F.when(bare, F.array_append(ids, F.lit(None).cast("string"))).otherwise(ids).alias("items"),
    )


def hit_words(hits: Column) -> Column:
    """How many words the sorted spans cover."""
    step = lambda acc, s: F.struct(F.greatest(acc["end"], s["end"]).alias("end"), (acc["n"] + F.greatest(s["end"] - F.greatest(acc["end"], s["start"]), F.lit(0))).alias("n"))
    return F.aggregate(hits, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step)["n"].cast("long")
