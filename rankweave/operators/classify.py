"""Classification of pages by weighted signals, votes and patterns."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two strings."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def similar_hosts(hosts: DataFrame, host: str) -> DataFrame:
    """(host, other, ratio): pairs of hosts of one top-level domain whose ratio is at least 0.7.

    A ratio of 0.7 means that 20 times the matched characters are 7 times both
    lengths or more.  That bounds the other's length, which is joined on, and the
    characters in common, in any order; only what passes both is compared.
    """
    n = F.length("host")
    rows = hosts.select(F.col(host).alias("host")).distinct().where("host <> ''").withColumn("tld", F.substring_index("host", ".", -1))
    letters = F.split("host", "")
    nth = F.transform(letters, lambda c, i: F.concat(c, F.size(F.filter(F.slice(letters, 1, i + 1), lambda x: x == c)).cast("string")))
    rows = rows.withColumn("letters", nth).withColumn("n", n)
    left = rows.withColumn("other_n", F.explode(F.sequence(F.ceil(F.col("n") * 7 / 13).cast("int"), F.floor(F.col("n") * 13 / 7).cast("int"))))
    right = rows.select(F.col("host").alias("other"), "tld", F.col("letters").alias("other_letters"), F.col("n").alias("other_n"))
    enough = 20 * F.size(F.array_intersect("letters", "other_letters")) >= 7 * (F.col("n") + F.col("other_n"))
    pairs = left.join(right, ["tld", "other_n"]).where((F.col("host") < F.col("other")) & enough)
    return pairs.select("host", "other", similarity("host", "other").alias("ratio")).where(F.col("ratio") >= F.lit(0.7))


def fingerprint(pages: DataFrame, key: str, rules: list[tuple[str, str, str, float]], threshold: float = 0.5) -> DataFrame:
    """(key, system, score): the system whose signals weigh most of its total.

    A rule is (system, column, needle, weight); rules are a short list.  Ties go
    to the system that is listed first.
    """
    systems = list(dict.fromkeys(r[0] for r in rules))
    scores = []
    for order, s in enumerate(systems):
        own = [r for r in rules if r[0] == s]
        hit = sum((F.when(F.contains(F.col(c), F.lit(n)), w).otherwise(0.0) for _, c, n, w in own), F.lit(0.0))
        scores.append(F.struct((hit / sum(r[3] for r in own)).alias("score"), F.lit(-order).alias("order"), F.lit(s).alias("system")))
    best = F.array_max(F.array(*scores))
    return pages.select(key, best["system"].alias("system"), F.round(best["score"], 6).alias("score")).where(F.col("score") >= threshold)


def majority_rules(rows: DataFrame, field: str, selector: str, share: float) -> DataFrame:
    """(field, selector, n): a field's commonest selector, if it has the share of its votes."""
    counts = rows.groupBy(field, selector).agg(F.count("*").alias("n"))
    top = F.row_number().over(Window.partitionBy(field).orderBy(F.desc("n"), selector))
    total = F.sum("n").over(Window.partitionBy(field))
    return counts.withColumn("_top", top).withColumn("_total", total).where((F.col("_top") == 1) & (F.col("n") >= share * F.col("_total"))).drop("_top", "_total")


def image_candidates(pages: DataFrame, key: str, html: str, keep: int = 5, least: int = 2) -> DataFrame:
    """(key, tag, score): image tags that look like portraits, best first.

    3 for a keyword, -5 for an excluded word, 2 for an alternative text, 2 for a
    context class, -3 for a width under 50.
    """
    tags = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit("(?i)<img[^>]*>"), F.lit(0))).alias("pos", "tag"))
    t = F.lower("tag")
    points = lambda pattern, n: F.when(t.rlike(pattern), n).otherwise(0)
    width = F.regexp_extract(t, r'width="?(\d+)', 1).try_cast("int")
    score = points("photo|portrait|image|cast", 3) + points("logo|icon|banner|sprite", -5) + points('alt="[^"]+"', 2) + points("class=\"[^\"]*(profile|member)", 2) + F.when(width < 50, -3).otherwise(0)
    ranked = tags.withColumn("score", score).where(F.col("score") >= least)
    return ranked.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "pos"))).where(F.col("_n") <= keep).select(key, "tag", "score")


def id_patterns(urls: DataFrame, site: str, url: str) -> DataFrame:
    """(site, kind, value): what a site's URLs have in common before their ids.

    A query key that every URL has, else the longest common path prefix.
    """
    rows = urls.select(site, url).distinct()
    total = rows.groupBy(site).agg(F.count("*").alias("total"))
    keys = rows.select(site, F.explode(F.array_distinct(F.regexp_extract_all(url, F.lit(r"[?&]([A-Za-z_]+)=\d"), F.lit(1)))).alias("value")).groupBy(site, "value").agg(F.count("*").alias("n"))
    path = F.regexp_extract(url, "^[a-z]+://[^/]+(/[^?#]*)", 1)
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    paths = rows.select(site, F.explode(prefixes).alias("value")).groupBy(site, "value").agg(F.count("*").alias("n"))
    every = lambda df, kind, order: df.join(total, site).where("n = total").select(site, F.struct(F.lit(order).alias("order"), F.length("value").alias("size"), F.lit(kind).alias("kind"), "value").alias("x"))
    both = every(keys, "query", 1).union(every(paths, "path", 0))
    return both.groupBy(site).agg(F.max("x").alias("x")).select(site, "x.kind", "x.value")
