"""URL filters: fixed prefix rules, then mined association rules.

URLs that no fixed rule decides are judged by rules that Spark's FP-growth
mines from labelled URLs: combinations of URL tokens whose presence implies a
verdict with enough support and confidence.  Mined rules are matched through an
inverted index from token to rules.

Defined results: a null URL, or one without ``://``, has empty host and path,
fits no rule and gets the default verdict; repeated URLs are matched once and
get the same verdict; of mined rules that match, the surest decides, then the one
of more support, then the later verdict by name; a very long URL is judged by all
of its tokens, though it takes part in mining with a few of them; an empty table
gives an empty one; other columns are kept whatever their names, but for host,
path, rule and verdict, which are replaced.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.common import materialize


#: At most so many (rule, token) rows are broadcast, about 200 bytes each there.
MAX_LISTED = 100_000


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def fixed_rule(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null.

    A rule fits its host and that host's subdomains where the path starts with
    the rule's.  ``rules`` is a short list kept by hand.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.host + r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL: host labels, path segments, query keys.

    Digits within tokens are replaced, so that page numbers fall together.
    """
    named = lambda kind, items: F.transform(F.filter(items, lambda x: x != ""), lambda x: F.concat(F.lit(kind), F.regexp_replace(x, "[0-9]+", "#")))
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    return F.array_distinct(F.concat(named("host:", F.split(host, r"\.")), named("path:", F.split(path, "/")), named("key:", keys)))


def mine_rules(labelled: DataFrame, url: str = "url", verdict: str = "verdict", min_support: float = 0.005, min_confidence: float = 0.9, max_labelled: int = 20_000, max_tokens: int = 10) -> DataFrame:
    """Association rules (rule_id, tokens, verdict, confidence, support) from labelled URLs.

    Mines at most ``max_labelled`` distinct URLs by hash order.  Tokens in fewer
    than ``min_support`` of them can be in no rule; of the others, a URL takes part
    with the ``max_tokens`` whose verdicts differ most from the common ones, as a
    URL of very many tokens would give every combination of them.  Of rules with the
    same verdict, one whose tokens contain another's with at least its confidence
    adds nothing.
    """
    rows = labelled.where(F.col(url).isNotNull() & F.col(verdict).isNotNull()).groupBy(F.col(url).alias("u")).agg(F.min(verdict).alias("v"))
    rows = materialize(rows.orderBy(F.xxhash64("u"), "u").limit(max_labelled), "url-labelled")
    total = rows.count()
    spread = rows.select("u", "v", F.explode(url_tokens(F.col("u"))).alias("token"))
    seen = spread.groupBy("token", "v").agg(F.count("*").alias("n")).join(F.broadcast(rows.groupBy("v").agg(F.count("*").alias("all"))), "v")  # a row for each verdict
    seen = seen.groupBy("token").agg(F.sum("n").alias("with"), F.collect_list(F.struct("v", "n", "all")).alias("by"))
    off = F.aggregate("by", F.lit(0.0), lambda acc, x: F.greatest(acc, F.abs(x["n"] - F.col("with") * x["all"] / F.lit(float(max(1, total))))))
    frequent = seen.where(F.col("with") >= min_support * total).select("token", (off / F.sqrt("with")).alias("tells"))
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("tells"), "token"))
    best = spread.join(frequent, "token").withColumn("place", place).where(F.col("place") <= max_tokens)  # both sides bounded by max_labelled
    items = best.groupBy("u", "v").agg(F.collect_set("token").alias("tokens")).select(F.concat("tokens", F.array(F.concat(F.lit("verdict:"), "v"))).alias("items"))
    items = materialize(items, "url-items")
    found = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence, numPartitions=8).fit(items).associationRules
    rules = found.where(F.element_at("consequent", 1).startswith("verdict:") & ~F.exists("antecedent", lambda t: t.startswith("verdict:")) & (F.col("lift") > 1)).select(
        F.array_sort("antecedent").alias("tokens"), F.substring(F.element_at("consequent", 1), 9, 1000).alias("verdict"), F.round("confidence", 9).alias("confidence"), F.round("support", 9).alias("support")
    )
    rules = materialize(rules.withColumn("rule_id", F.xxhash64("tokens", "verdict")), "url-rules-all")
    # A rule whose tokens are all in another one, of the same verdict and no less sure, implies that one.
    index = rules.select(F.col("rule_id").alias("by"), F.col("verdict"), F.col("confidence").alias("sure"), F.size("tokens").alias("need"), F.explode("tokens").alias("token"))
    inside = rules.select("rule_id", "verdict", "confidence", F.size("tokens").alias("size"), F.explode("tokens").alias("token")).join(index, ["verdict", "token"]).where("sure >= confidence and need < size")
    implied = inside.groupBy("rule_id", "by", "need").agg(F.count("*").alias("have")).where("have = need").select("rule_id").distinct()
    return materialize(rules.join(implied, "rule_id", "left_anti"), "url-rules")


def match_rules(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """(url, verdict, confidence) of the best mined rule for each distinct URL that one matches."""
    index = rules.select("rule_id", "verdict", "confidence", "support", F.size("tokens").alias("need"), F.explode("tokens").alias("token"))
    tokens = urls.where(F.col(url).isNotNull()).select(F.col(url).alias("url")).distinct().select("url", F.explode(url_tokens(F.col("url"))).alias("token"))
    hits = tokens.join(F.broadcast(index) if index.count() <= MAX_LISTED else index, "token").groupBy("url", "rule_id", "verdict", "confidence", "support", "need").agg(F.count("*").alias("have")).where("have = need")
    return hits.groupBy("url").agg(F.max(F.struct("confidence", "support", "verdict", "rule_id")).alias("best")).select("url", "best.verdict", "best.confidence")


def judge_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow", labelled: DataFrame | None = None, **mining) -> DataFrame:
    """Add host, path, rule and verdict to every row.

    Verdicts of the fixed rules are the labels for mining unless ``labelled``
    (url, verdict) is given.
    """
    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    u = F.col(f"`{url}`")
    base = pages.select(u.alias("u"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), host_of(u).alias("host"), path_of(u).alias("path"))  # in a struct no column can clash
    base = base.withColumn("fixed", fixed_rule(rules, F.col("host"), F.col("path")))
    if labelled is None:
        labelled = base.where(F.col("fixed").isNotNull()).select(F.col("u").alias("url"), F.col("fixed.verdict").alias("verdict"))
    mined = mine_rules(labelled, **mining)
    learned = match_rules(base.where(F.col("fixed").isNull()).select(F.col("u").alias("url")), mined).select(F.col("url").alias("u"), F.col("verdict").alias("learned"))
    out = base.join(learned, "u", "left")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in rest], "host", "path", F.col("fixed.rule").alias("rule"), F.coalesce("fixed.verdict", "learned", F.lit(default)).alias("verdict"))
