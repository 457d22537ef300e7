"""Quality rules: text signals and a hashed n-gram log-likelihood ratio.

All of it is DataFrame functions.  Words are maximal runs outside ASCII white
space, taken unchanged, so that case and punctuation count.

The ratio compares two multinomials over hashed word unigrams and bigrams: that
of trusted documents (labelled good) and that of the whole corpus.  A document's
score is the mean log ratio over its n-grams; every document is held against
one threshold, so the same text always gets the same verdict.

Defined results: null and empty texts have no words, score 0 and fail the base
rules; repeated rows are judged each for itself, and equal texts get equal
verdicts; a score equal to the threshold is kept; a very long text is judged by
all of its words; an empty table gives an empty one; other columns are kept, but
for those named like the columns made or on the way (``{prefix}`` before n_words,
word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept,
hashes, lines, windows, score_ratios), which are replaced; labels with null or
several values for an id count as trusted if any of them says so; without any
labels the ratio is 0 everywhere and decides nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import materialize, words_of

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
WINDOW = 8


def _repeat_words(words: Column, windows: Column) -> Column:
    """Words covered by windows that occur twice or more, from window hashes by start.

    Sorting (hash, start) pairs brings equal windows together; the starts that
    have an equal neighbour are put in order again, and covered words summed up.
    """
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(sorted_pairs: Column) -> Column:
        same = lambda i, j: F.get(sorted_pairs, i)["h"] == F.get(sorted_pairs, j)["h"]
        return F.array_sort(
            F.filter(
                F.transform(sorted_pairs, lambda p, i: F.when(F.coalesce(same(i, i + 1), F.lit(False)) | F.coalesce(F.when(i > 0, same(i, i - 1)), F.lit(False)), p["i"])),
                lambda i: i.isNotNull(),
            )
        )

    def cover(acc: Column, start: Column) -> Column:
        end = start + WINDOW
        return F.struct(end.alias("end"), (acc["n"] + end - F.greatest(start, acc["end"])).alias("n"))

    starts = F.element_at(F.transform(F.array(pairs), twice), 1)  # sorted once, then read at neighbouring places
    return F.aggregate(starts, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), cover)["n"].cast("long")


def base_signals(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and
    base_failed, each named with ``prefix``; columns of these names are replaced.

    The intermediate ``{prefix}hashes`` (one hash for each word) stays for the ratio.
    """
    p = prefix
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashes = F.transform(words_of(F.col(f"`{text}`")), lambda w: F.xxhash64(w))
    out = docs.withColumns(
        {
            f"{p}hashes": hashes,
            f"{p}lines": lines,
            f"{p}word_chars": F.length(F.translate(body, WHITE, "")).cast("long"),
            f"{p}n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
        }
    )
    h = F.col(f"{p}hashes")
    windows = F.when(
        F.size(h) >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumns(
        {
            f"{p}n_words": F.size(h).cast("long"),
            f"{p}n_dup_lines": (F.size(f"{p}lines") - F.size(F.array_distinct(f"{p}lines"))).cast("long"),
            f"{p}windows": windows,
        }
    ).drop(f"{p}lines")
    w = F.col(f"{p}windows")
    out = out.withColumn(f"{p}n_repeat_words", F.when(F.size(F.array_distinct(w)) < F.size(w), _repeat_words(h, w)).otherwise(F.lit(0).cast("long"))).drop(f"{p}windows")
    failed = (F.col(f"{p}n_words") < 20) | (100 * F.col(f"{p}n_repeat_words") > 30 * F.col(f"{p}n_words"))
    return out.withColumn(f"{p}base_failed", failed)


def ngram_buckets(hashes: Column, buckets: int) -> Column:
    """Hash buckets of the unigrams and bigrams behind an array of word hashes."""
    ones = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    twos = F.transform(hashes, lambda h, i: F.pmod(F.xxhash64(h, F.get(hashes, i + 1)), F.lit(buckets)).cast("int"))
    return F.concat(ones, twos)


class _Mean(NamedTuple):
    mean: float
    sd: float


@dataclass
class LikelihoodRatio:
    """A fitted ratio: one log ratio for each bucket, and the threshold."""

    ratios: DataFrame
    buckets: int
    threshold: float

    def with_score(self, docs: DataFrame, hashes: str, out: str, part: Column | None = None) -> DataFrame:
        """Add the mean log ratio over a document's n-grams; 0 without words.

        The ratios come as a scalar subquery, evaluated once; its column is
        folded into the score's expression and never part of a row.  ``part``
        says by which of several tables of ratios, one after another, a row is scored.
        """
        table = self.ratios.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "ratio"))), lambda x: x["ratio"]).alias("t"))
        h, t = F.col(f"`{hashes}`"), f"{out}_ratios"
        first = F.lit(0) if part is None else part * self.buckets
        total = F.aggregate(ngram_buckets(h, self.buckets), F.lit(0.0), lambda acc, i: acc + F.get(F.col(t), first + i))
        return docs.withColumn(t, table.scalar()).withColumn(out, F.when(F.size(h) > 0, total / (2 * F.size(h))).otherwise(F.lit(0.0))).drop(t)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    label: str = "quality",
    buckets: int = 1 << 16,
    max_held: int | None = None,
    max_broadcast: int = 1_000_000,
    folds: int = 10,
) -> LikelihoodRatio:
    """Count both multinomials over all documents and set the threshold.

    Trusted documents are all that are labelled 1.  A hash of their ids deals them
    into ``folds``, and each is scored by ratios that count the other folds only, so
    that none has seen it; documents labelled 0 are scored by the ratios themselves.
    These scores of all labelled documents place the threshold: halfway between the
    mean scores of both kinds (without any labelled 0, four standard deviations below
    the trusted mean; without trusted ones in two folds, nowhere).  A caller who gives
    ``max_held`` has it placed by at most so many trusted ones and twice as many others,
    in hash order.  More than ``max_broadcast`` labelled ids are joined by a shuffle.
    """
    fold = F.when(F.col("_good") == 1, F.pmod(F.xxhash64("_key", F.lit(1)), F.lit(folds))).otherwise(folds).cast("int")
    by_id = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(F.col(label)).alias("_good"))
    by_id = materialize(by_id.where("_good in (0, 1)").withColumn("_fold", fold), "quality-labels")
    near = F.broadcast if by_id.count() <= max_broadcast else lambda rows: rows
    texts = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    hashed = F.transform(words_of(F.col("_text")), lambda w: F.xxhash64(w)).alias("_h")
    flagged = texts.join(near(by_id), "_key", "left").select("_fold", hashed)
    of_folds = [f"good{k}" for k in range(folds)]
    counted = [F.count(F.when(F.col("_fold") == k, 1)).alias(c) for k, c in enumerate(of_folds)]
    counts = flagged.select("_fold", F.explode(ngram_buckets(F.col("_h"), buckets)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw"), *counted)
    counts = materialize(counts, "quality-counts")
    totals = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("raw", *of_folds)]).first()
    good = [totals[c] for c in of_folds]
    # A table of ratios for each fold, counted without it, and then the one that counts all.
    left_out = lambda cs: F.element_at(F.array(*cs, F.lit(0)), F.col("part") + 1)
    tables = docs.sparkSession.range((folds + 1) * buckets).select((F.col("id") % buckets).cast("int").alias("bucket"), F.floor(F.col("id") / buckets).cast("int").alias("part"))
    tables = tables.join(F.broadcast(counts), "bucket", "left").na.fill(0)  # as many rows as buckets
    share = lambda c, n: F.log((c + 1) / (n + buckets).cast("double"))
    in_good = share(sum(map(F.col, of_folds)) - left_out(map(F.col, of_folds)), F.lit(sum(good)) - left_out(map(F.lit, good)))
    ratio = in_good - share(F.col("raw"), F.lit(totals.raw)) if sum(good) else F.lit(0.0)
    tables = materialize(tables.select("part", "bucket", ratio.alias("ratio")), "quality-ratios")
    model = LikelihoodRatio(tables.where(F.col("part") == folds).drop("part"), buckets, float("-inf"))
    placing = by_id.where(F.col("_fold").isin(folds, *[k for k, n in enumerate(good) if n < sum(good)]))
    if max_held is not None:
        in_order = lambda rows, n: rows.orderBy(F.xxhash64("_key"), "_key").limit(n)
        placing = materialize(in_order(placing.where("_good = 1"), max_held).unionByName(in_order(placing.where("_good = 0"), 2 * max_held)), "quality-held")
    known = texts.join(near(placing), "_key").select("_good", "_fold", hashed)
    without = LikelihoodRatio(tables.select((F.col("part") * buckets + F.col("bucket")).alias("bucket"), "ratio"), buckets, float("-inf"))
    # Scores in whole billionths: their sums, unlike those of doubles, don't depend on the order of rows.
    whole = without.with_score(known, "_h", "s", F.col("_fold")).select("_good", F.round(F.col("s") * 1e9).cast("decimal(38,0)").alias("s"))
    sums = whole.groupBy("_good").agg(F.count("*").alias("n"), F.sum("s").alias("s"), F.sum((F.col("s") * F.col("s")).cast("decimal(38,0)")).alias("ss")).collect()
    scored = {r._good: _Mean(int(r.s) / r.n / 1e9, math.sqrt(max(0, r.n * int(r.ss) - int(r.s) ** 2) / (r.n * max(1, r.n - 1))) / 1e9) for r in sums}
    if 1 in scored:  # else nothing is rejected
        best = scored[1]
        model.threshold = (best.mean + scored[0].mean) / 2 if 0 in scored and scored[0].mean < best.mean else best.mean - 4 * best.sd
    return model


def judge(docs: DataFrame, model: LikelihoodRatio, text: str = "text", prefix: str = "") -> DataFrame:
    """Add the base signals, ``score`` and ``kept``."""
    p = prefix
    out = model.with_score(base_signals(docs, text, p), f"{p}hashes", f"{p}score").drop(f"{p}hashes")
    return out.withColumn(f"{p}kept", ~F.col(f"{p}base_failed") & (F.col(f"{p}score") >= F.lit(model.threshold)))
