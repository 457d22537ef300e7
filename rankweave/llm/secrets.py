"""Secret scans: three fixed patterns, and character Markov models.

All of it is DataFrame functions.  Positions are code points, ends exclusive.
The patterns give base spans.  Further spans come from two first-order
character models, one of random strings and one of ordinary identifiers: a
token is added where the log-likelihood ratio of the two outweighs the prior
odds against a secret, unless it overlaps a base span.

Defined results: null and empty texts have no spans; repeated rows are scanned
each for itself; a very long text is scanned whole, in time that grows with its
length; spans that start together stand in the order of their kinds; an empty
table gives an empty one; other columns are kept, but for those named like the
columns made or on the way (``{prefix}`` before n_assign, n_access, n_hex, base,
spans, assign_spans, access_spans, hex_spans, more), which are replaced; with no
labelled strings of one kind the models decide nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import bind, materialize, running

#: The base patterns, in the order of their kinds.  Runs that are
#: too short can't hold a long one, so minimum lengths stand in two patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_LENGTH = 8
KINDS = ["assign", "access", "hex", "markov"]

#: Tokens that the models judge: long, with a digit and a letter.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
CODES = 128
#: Transitions' worth that a character's overall frequency has in the models.
BACKING = 5.0
#: Random strings in base 64 that are made of each known secret.
DIGESTS = 8

_SPAN = "array<struct<start:int,rank:int,end:int>>"


def _matches(text: Column, pattern: str, rank: int, keep: Column | None = None) -> Column:
    """Spans of all leftmost non-overlapping matches.

    The pieces between matches and the matches themselves, added up, give the
    positions.  ``keep`` is an array of booleans, one for each match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    keep = F.transform(found, lambda _: F.lit(True)) if keep is None else keep
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("found"), keep.alias("keep"))
    steps = F.filter(F.transform(rows, lambda z: F.struct(F.length(z["gap"]).cast("long").alias("gap"), F.length(z["found"]).alias("size"), z["keep"].alias("keep"))), lambda z: z["size"].isNotNull())

    def spans(steps: Column) -> Column:
        ahead = running(F.transform(steps, lambda z: z["gap"] + z["size"]), lambda x, y: x + y, F.lit(0).cast("long"))

        def span(z: Column, before: Column) -> Column:
            start = (before + z["gap"]).cast("int")
            return F.when(z["keep"], F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + z["size"]).alias("end")))

        return F.filter(F.zip_with(steps, ahead, span), lambda s: s.isNotNull())

    return F.when(text.rlike(pattern), bind(steps, spans)).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> list[Column]:
    """Arrays of spans for assign, access and hex."""
    body = F.coalesce(text, F.lit(""))
    long_enough = F.transform(F.regexp_extract_all(body, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= ASSIGN_LENGTH)
    return [_matches(body, ASSIGN, 0, long_enough), _matches(body, ACCESS, 1), _matches(body, HEX, 2)]


def joined(spans: Column) -> Column:
    """kind:start:end of spans in order, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _codes(token: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.least(F.ascii(F.substring(token, i, F.lit(1))), F.lit(CODES - 1)))


def _steps(token: Column) -> Column:
    """Numbers of the character transitions of a token."""
    return bind(_codes(token), lambda codes: F.transform(F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0))), lambda c, i: F.get(codes, i) * CODES + c))


@dataclass
class MarkovRatio:
    """Log ratios of random strings over identifiers for each transition."""

    ratios: DataFrame
    prior_odds: float
    fitted: bool

    def with_spans(self, docs: DataFrame, text: str, base: str, out: str) -> DataFrame:
        """Add spans of tokens that the models take for secrets."""
        table = self.ratios.agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "ratio"))), lambda x: x["ratio"]).alias("t"))
        t, body = f"{out}_ratios", F.coalesce(F.col(f"`{text}`"), F.lit(""))
        found = F.regexp_extract_all(body, F.lit(TOKEN), F.lit(0))
        score = lambda w: F.aggregate(_steps(w), F.lit(0.0), lambda acc, i: acc + F.get(F.col(t), i))
        verdicts = F.transform(found, lambda w: w.rlike("[0-9]") & w.rlike("[A-Za-z]") & (score(w) > F.lit(math.log(self.prior_odds))))
        clear = lambda s: ~F.exists(F.col(f"`{base}`"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return docs.withColumn(t, table.scalar()).withColumn(out, F.filter(_matches(body, TOKEN, 3, verdicts), clear)).drop(t)


def fit(random_strings: DataFrame, identifiers: DataFrame, max_samples: int = 50_000, prior_odds: float = 1e6) -> MarkovRatio:
    """Train both models from samples with a string column ``s``.

    At most ``max_samples`` distinct strings of each kind are used, by hash
    order.  A transition's probability leans on that of its second character as if by
    ``BACKING`` more transitions; characters never seen get a count of one half.
    """
    counts = None
    for kind, rows in (("bad", random_strings), ("plain", identifiers)):
        some = rows.where("s is not null and s != ''").select("s").distinct().orderBy(F.xxhash64("s"), "s").limit(max_samples)
        steps = some.select(F.explode(_steps(F.col("s"))).alias("step")).groupBy("step").agg(F.count("*").alias("n")).select("step", F.lit(kind).alias("kind"), "n")
        counts = steps if counts is None else counts.unionByName(steps)
    counts = materialize(counts.groupBy("step").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in ("bad", "plain")]), "secret-counts")
    seen = counts.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("plain"), F.lit(0)).alias("plain")).first()
    size = 66  # about as many characters as tokens are made of
    grid = counts.sparkSession.range(CODES * CODES).select(F.col("id").cast("int").alias("step"))
    full = grid.join(F.broadcast(counts), "step", "left").na.fill(0, ["bad", "plain"])  # bounded by the grid
    full = full.withColumns({"from": F.floor(F.col("step") / CODES).cast("int"), "to": F.col("step") % CODES})
    sums = lambda by: full.groupBy(by).agg(F.sum("bad").alias(f"{by}_bad"), F.sum("plain").alias(f"{by}_plain"))
    full = full.join(F.broadcast(sums("from")), "from").join(F.broadcast(sums("to")), "to")

    def p(kind: str) -> Column:
        overall = (F.col(f"to_{kind}") + 0.5) / F.lit(seen[kind] + 0.5 * size)
        return (F.col(kind) + BACKING * overall) / (F.col(f"from_{kind}") + BACKING)

    ratios = full.select("step", F.log(p("bad") / p("plain")).alias("ratio"))
    fitted = bool(seen.bad and seen.plain)
    return MarkovRatio(materialize(ratios if fitted else ratios.withColumn("ratio", F.lit(0.0)), "secret-ratios"), prior_odds, fitted)


def labelled_samples(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Labelled strings for training: values that base patterns find in the
    documents are random strings, words of the same documents outside of such
    matches are ordinary identifiers.  As such values are mostly in lower case,
    digests of each in base 64 are random strings, too."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    holding = docs.where(body.rlike(ASSIGN) | body.rlike(ACCESS) | body.rlike(HEX)).select(body.alias("t"))
    values = F.concat(F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("t", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("t", F.lit(HEX), F.lit(0)))
    bad = holding.select(F.explode(values).alias("s")).where("length(s) >= 12 and s rlike '[0-9]'")
    bad = bad.select(F.explode(F.array("s", *[F.rtrim(F.base64(F.unhex(F.sha2(F.concat("s", F.lit(str(i))), 256))), F.lit("=")) for i in range(DIGESTS)])).alias("s"))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("t"), ASSIGN, " "), ACCESS, " "), HEX, " ")
    plain = holding.select(F.explode(F.regexp_extract_all(rest, F.lit("[A-Za-z][A-Za-z0-9_-]{5,}"), F.lit(0))).alias("s"))
    return bad, plain


def scan(docs: DataFrame, model: MarkovRatio, text: str = "text", prefix: str = "") -> DataFrame:
    """Add n_assign, n_access, n_hex, ``base`` and ``spans`` (arrays of
    start, rank of the kind, end), named with ``prefix``."""
    p = prefix
    kinds = [f"{p}{k}_spans" for k in KINDS[:3]]
    out = docs.withColumns(dict(zip(kinds, base_spans(F.col(f"`{text}`")))))
    out = out.withColumn(f"{p}base", F.concat(*kinds))
    out = model.with_spans(out, text, f"{p}base", f"{p}more")
    counts = {f"{p}n_{k}": F.size(f"{p}{k}_spans").cast("long") for k in KINDS[:3]}
    return out.withColumns(counts | {f"{p}spans": F.array_sort(F.concat(f"{p}base", f"{p}more"))}).drop(*kinds, f"{p}more")


def redact(text: Column, spans: Column, mark: str = "<secret>") -> Column:
    """The text with every span replaced by ``mark``; overlapping spans become one."""
    body = F.coalesce(text, F.lit(""))

    def done(s: Column) -> Column:
        reach = running(F.transform(s, lambda x: x["end"].cast("long")), lambda x, y: F.greatest(x, y), F.lit(0).cast("long"))

        def piece(x: Column, before: Column) -> Column:
            before = before.cast("int")
            return F.when(x["start"] >= before, F.concat(F.substring(body, before + 1, x["start"] - before), F.lit(mark))).otherwise(F.lit(""))

        return F.concat(F.array_join(F.zip_with(s, reach, piece), ""), F.substring(body, F.array_max(F.transform(s, lambda x: x["end"])) + 1, F.length(body)))

    return F.when(text.isNull() | (F.size(spans) == 0), text).otherwise(bind(F.array_sort(spans), done))
