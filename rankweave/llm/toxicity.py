"""Toxicity: a factorization machine over hashed terms.

A text's terms are its lower-cased words (letters and digits) and the beginnings
of words, so that compounds and inflections of a word are known, hashed into
buckets; a term counts once.  The machine adds up a bias, a weight for each
term, and for each pair of terms the product of their factor vectors, so that
terms that only matter together, such as an insult with a group's mention, are
learned as a pair.

It is given every bucket of at least ``min_docs`` sample texts, in sparse
vectors of length one.  Most terms are noise for it, so a bucket's value grows
with what it tells of the label in the sample (the square root of chi-square over
the texts' number, less ``NOISE``), but none is 0: terms that tell something only
together with others (`either, but not both`) keep a share of their spread.

The sample is dealt into parts by the texts' hash.  In each round, one task for
each part starts from the shared machine and takes AdaGrad steps over its texts;
then a bucket's parameters become the mean over the parts that moved them.

Defined results: null and empty texts have no terms and get the score of the
bias; a very long text counts by its distinct terms; labels that are null are not
learned from, several labels of an id, or of equal texts, count as toxic if any
of them does; repeated rows are scored each for itself, and equal texts always
get equal scores; other columns are kept, but for one named like the new column,
which is replaced; an empty table gives an empty one; without labels of both
kinds, or any bucket of enough texts, every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import bind, materialize

WORD = r"[^\p{L}\p{N}]+"


#: Lengths of the word beginnings that count as terms beside whole words.
BEGINNINGS = (4, 5, 6)
#: Chi-square that chance may give a bucket, and the share of its spread that every bucket's value has.
NOISE, SPREAD = 8.0, 0.05
#: Terms that are scored at once, in whole texts.
SCORED_TERMS = 200_000


def hashed_terms(text: Column, buckets: int) -> Column:
    """Distinct term buckets of a text, from its words and their beginnings."""
    words = F.filter(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD)), lambda w: w != "")
    bucket = lambda kind, term: F.pmod(F.xxhash64(F.lit(kind), term), F.lit(buckets)).cast("int")

    def terms(found: Column) -> Column:
        kinds = [F.transform(found, lambda w: bucket(0, w))]
        for size in BEGINNINGS:
            kinds.append(_beginnings(found, size, bucket))
        return F.array_distinct(F.concat(*kinds))

    return bind(words, terms)


def _beginnings(words: Column, size: int, bucket) -> Column:
    return F.transform(F.filter(words, lambda w: F.length(w) >= size), lambda w: bucket(size, F.substring(w, 1, size)))


def _values(known: np.ndarray, value: np.ndarray, terms: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (row, term) pairs those with known terms: row, the term's place, and its value, each row of length one."""
    at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
    held = known[at] == terms
    at, row = at[held], row[held]
    length = np.sqrt(np.bincount(row, value[at] ** 2, rows))
    return row, at, value[at] / length[row]


@dataclass
class ToxicityModel:
    """A fitted machine: the sorted buckets that it knows, their values, weights and factors; none without labels of both kinds."""

    known: np.ndarray | None
    value: np.ndarray | None
    buckets: int
    bias: float = 0.0
    weights: np.ndarray | None = None
    factors: np.ndarray | None = None

    @staticmethod
    def _scores(machine: tuple, terms: np.ndarray, ends: np.ndarray) -> np.ndarray:
        known, value, bias, weights, factors = machine
        rows = len(ends) - 1
        row, at, x = _values(known, value, terms, np.repeat(np.arange(rows), np.diff(ends)), rows)
        z = bias + np.bincount(row, x * weights[at], rows)
        for f in factors:
            xf = x * f[at]
            z += (np.bincount(row, xf, rows) ** 2 - np.bincount(row, xf**2, rows)) / 2
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def with_score(self, docs: DataFrame, text: str = "text", out: str = "score") -> DataFrame:
        """Add the probability of label 1; all columns of ``docs`` are kept."""
        if self.weights is None:
            return docs.withColumn(out, F.lit(0.0))
        shared, scores = docs.sparkSession.sparkContext.broadcast((self.known, self.value, self.bias, self.weights, self.factors)), self._scores

        @F.arrow_udf("double")
        def score(terms: pa.Array) -> pa.Array:
            ends, flat = np.concatenate(([0], np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False)))), terms.flatten().to_numpy(zero_copy_only=False)
            out, first = np.empty(len(terms)), 0
            while first < len(terms):  # some texts at a time: a batch of long ones would take much memory
                stop = max(first + 1, int(np.searchsorted(ends, ends[first] + SCORED_TERMS, side="right")) - 1)
                out[first:stop] = scores(shared.value, flat[ends[first] : ends[stop]], ends[first : stop + 1] - ends[first])
                first = stop
            return pa.array(out)

        return docs.withColumn(out, score(hashed_terms(F.col(f"`{text}`"), self.buckets)))


@dataclass
class _Step:
    """What one part's task takes from the driver and gives back: parameters, and their summed squared gradients."""

    bias: np.ndarray  # value, squares
    weights: np.ndarray  # one row of (weight, factors...) for each bucket
    squares: np.ndarray  # one row of (of the weight, of the factors) for each bucket


def _descend(start: _Step, at: np.ndarray, x: np.ndarray, ends: np.ndarray, y: np.ndarray, rng: np.random.RandomState, epochs: int, rate: float, batch: int, toxic_weight: float) -> _Step:
    """AdaGrad over texts whose terms are ``at[ends[i]:ends[i + 1]]`` with values ``x``; the factors of a bucket share one step size."""
    bias, table, squares = start.bias.astype(np.float64), start.weights.astype(np.float64), start.squares.astype(np.float64)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for first in range(0, len(order), batch):
            rows = order[first : first + batch]
            size = ends[rows + 1] - ends[rows]
            stop = np.cumsum(size)
            place = np.arange(stop[-1]) + np.repeat(ends[rows] - stop + size, size)
            buckets, which = np.unique(at[place], return_inverse=True)
            value, row = x[place], np.repeat(np.arange(len(rows)), size)
            moved = table[buckets][which] * value[:, None]
            total = lambda v: np.diff(np.concatenate((np.zeros((1, v.shape[1])), np.cumsum(v, axis=0)))[np.concatenate(([0], stop))], axis=0)
            sums = total(moved)
            z = bias[0] + sums[:, 0] + ((sums[:, 1:] ** 2).sum(axis=1) - total((moved[:, 1:] ** 2).sum(axis=1, keepdims=True))[:, 0]) / 2
            miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * np.where(y[rows] > 0, toxic_weight, 1) * 8 / len(rows)
            pull = (miss[row] * value)[:, None] * np.concatenate((np.ones((len(row), 1)), sums[row, 1:] - moved[:, 1:]), axis=1)
            slope = np.stack([np.bincount(which, pull[:, j], len(buckets)) for j in range(pull.shape[1])], axis=1) + 1e-5 * table[buckets]
            squares[buckets, 0] += slope[:, 0] ** 2
            squares[buckets, 1] += (slope[:, 1:] ** 2).mean(axis=1)
            table[buckets, 0] -= rate * slope[:, 0] / np.sqrt(squares[buckets, 0])
            table[buckets, 1:] -= rate * slope[:, 1:] / np.sqrt(squares[buckets, 1])[:, None]
            bias[1] += miss.sum() ** 2
            bias[0] -= rate * miss.sum() / np.sqrt(bias[1])
    return _Step(bias, table.astype(np.float32), squares.astype(np.float32))


def _mean(start: _Step, results: list[tuple[int, _Step]]) -> _Step:
    """The mean of the parts' machines; a bucket's over the parts that have texts with it.  Squared gradients add up, so steps shrink as if one task had seen all."""
    n = sum(w for w, _ in results)
    bias = np.array([sum(w * r.bias[0] for w, r in results) / n, start.bias[1] + sum(r.bias[1] - start.bias[1] for _, r in results)])
    moved, share, squares = np.zeros(start.weights.shape), np.zeros(len(start.weights)), np.zeros(start.squares.shape)
    for w, r in results:
        share += w * (r.squares[:, 0] > start.squares[:, 0])
        moved += w * (r.weights - start.weights)
        squares += r.squares - start.squares
    share = np.maximum(share, 1)[:, None]
    return _Step(bias, (start.weights + moved / share).astype(np.float32), (start.squares + squares).astype(np.float32))


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row for a part: its texts' labels, and the places of their terms one after the other."""
    pdf = pdf.sort_values("row", ignore_index=True)  # the same order on every attempt
    ends = np.concatenate(([0], np.cumsum([len(a) for a in pdf["at"]]))).astype(np.int64)
    return pd.DataFrame({"part": pdf["part"].iloc[:1], "ends": [ends.tobytes()], "at": [np.concatenate(list(pdf["at"])).astype(np.int32).tobytes()], "label": [pdf["label"].to_numpy(np.float64).tobytes()]})


def _trainer(shared, sent, number: int, epochs: int, rate: float, batch: int, toxic_weight: float):
    """The task of one round: packed parts to one machine each."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(len(rows)):
                part, ends, at, y = (rows.column(c)[i].as_py() for c in range(4))
                ends, at, y = np.frombuffer(ends, np.int64), np.frombuffer(at, np.int32), np.frombuffer(y)
                x = shared.value[1][at]
                x = x / np.repeat(np.sqrt(np.add.reduceat(x**2, ends[:-1])), np.diff(ends))
                out = _descend(sent.value, at, x, ends, y, np.random.RandomState(1000 * number + part), epochs, rate, batch, toxic_weight)
                moved = (out.weights - sent.value.weights).astype(np.float16)
                yield pa.RecordBatch.from_pydict({"n": [len(y)], "bias": [out.bias.tobytes()], "moved": [moved.tobytes()], "squares": [out.squares.tobytes()]})

    return train


def fit(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    label: str = "toxic",
    buckets: int = 1 << 20,
    max_labelled: int = 30_000,
    min_docs: int = 8,
    factors: int = 8,
    rounds: int = 6,
    epochs: int = 1,
    rate: float = 0.2,
    batch: int = 64,
    toxic_weight: float = 4.0,
    part_texts: int = 2_500,
    max_parts: int = 8,
) -> ToxicityModel:
    """Train on at most ``max_labelled`` labelled documents, taken by hash order of their ids.

    Equal texts count once.  A bucket must be in ``min_docs`` sample texts; those
    in all tell nothing.  A toxic text weighs ``toxic_weight`` times another one in
    the loss, so a score is a probability at odds raised by that much.

    A part has about ``part_texts`` texts, but there are ``max_parts`` at most.  Each sends
    one machine to the driver in a round: 26 bytes for each bucket known.
    """
    by_id = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg((F.max(label) > 0).cast("double").alias("label"))
    chosen = materialize(by_id.orderBy(F.xxhash64("_key"), "_key").limit(max_labelled), "toxic-labels")
    texts = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")).join(F.broadcast(chosen), "_key")  # bounded by max_labelled
    texts = texts.groupBy("_text").agg(F.max("label").alias("label")).select("label", F.xxhash64("_text").alias("row"), hashed_terms(F.col("_text"), buckets).alias("terms"))
    texts = materialize(texts, "toxic-sample")
    n = texts.agg(F.count("*").alias("all"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("bad")).first()
    if not 0 < n.bad < n.all:
        return ToxicityModel(None, None, buckets)
    terms = texts.select("label", F.explode("terms").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("label").alias("bad"))
    found = terms.where((F.col("n") >= min_docs) & (F.col("n") < n.all)).toArrow().sort_by("bucket")  # at most ``buckets`` rows
    known, docs_with, bad = (found.column(c).to_numpy() for c in ("bucket", "n", "bad"))
    if not len(known):
        return ToxicityModel(None, None, buckets)
    off = bad * (n.all - n.bad - docs_with + bad) - (docs_with - bad) * (n.bad - bad)
    chi = n.all * off**2 / (docs_with * (n.all - docs_with) * n.bad * (n.all - n.bad))
    share = docs_with / n.all
    value = np.sqrt(np.maximum(chi - NOISE, 0) / n.all) + SPREAD * np.sqrt(share * (1 - share))
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((known, value))

    @F.arrow_udf("array<int>")
    def held(terms: pa.Array) -> pa.Array:
        known, rows = shared.value[0], len(terms)
        row = np.repeat(np.arange(rows), terms.value_lengths().to_numpy(zero_copy_only=False))
        row, at, _ = _values(known, shared.value[1], terms.flatten().to_numpy(zero_copy_only=False), row, rows)
        ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=rows)))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(at.astype(np.int32)))

    parts = max(1, min(max_parts, -(-n.all // part_texts)))
    dealt = texts.select(F.pmod("row", F.lit(parts)).cast("int").alias("part"), "row", "label", held("terms").alias("at")).where("size(at) > 0")
    packed = materialize(dealt.groupBy("part").applyInPandas(_pack, "part int, ends binary, at binary, label binary"), "toxic-parts")
    rng = np.random.RandomState(11)
    drawn = np.concatenate((np.zeros((len(known), 1)), rng.normal(0, 0.1, (len(known), factors))), axis=1)
    machine = _Step(np.array([np.log(n.bad / (n.all - n.bad)), 1e-6]), drawn.astype(np.float32), np.full((len(known), 2), 1e-6, np.float32))
    for number in range(rounds):
        train = _trainer(shared, context.broadcast(machine), number, epochs, rate, batch, toxic_weight)
        done = packed.mapInArrow(train, "n long, bias binary, moved binary, squares binary").collect()  # one row for each part
        if done:
            done = [(r.n, _Step(np.frombuffer(r.bias), machine.weights + np.frombuffer(r.moved, np.float16).reshape(machine.weights.shape), np.frombuffer(r.squares, np.float32).reshape(-1, 2))) for r in done]
            machine = _mean(machine, sorted(done, key=lambda x: (x[0], x[1].bias[0])))
    table = machine.weights.astype(np.float64)
    return ToxicityModel(known, value, buckets, float(machine.bias[0]), table[:, 0].copy(), np.ascontiguousarray(table[:, 1:].T))
