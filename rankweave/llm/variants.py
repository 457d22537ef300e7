"""Spelling variants: words at distance one of each other, grouped under the commoner form.

The counted words, sorted, are cut into ranges of ``SHARD_WORDS``, and each range
becomes a compact trie: labels in breadth-first order, the place of each node's
first child, and each node's count.  Shards are broadcast in rounds, in each as
many as fit into ``ROUND_BYTES``, so that a broadcast is bounded whatever the
number of words.  In a round every word's distance-one Levenshtein automaton is
intersected with all shards of the round, depth first; a shard that holds nothing
near dies at its first labels.  What a round finds for a word is a count and its
best neighbour, not a list, and rounds are put together by one aggregation.

Forms have at least ``ratio`` times their word's count, so chains of forms are
shorter than the logarithm of the largest count and have no cycles; the last form
is found by doubling steps.

Defined results: a null or empty text has no words; a null id reads as an empty
one for the rewriting of runs; repeated rows count each; ties go to the smallest
form in code-point order; an empty table gives an empty one; other columns are
not read, so that none can clash.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.common import materialize

#: Words in a shard, and characters; a longer word has a shard of its own.
SHARD_WORDS, SHARD_CHARS = 200_000, 4_000_000
#: Bytes of shards that are broadcast at once.
ROUND_BYTES = 32_000_000
#: Words that a task takes in a round.
TASK_WORDS = 20_000
#: Fixed value: the letters of a word.
RUN = "[^A-Za-z\\u00C0-\\u00FF]+"


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", rewrite: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(word, n): lower-cased runs of letters and how often they stand in all texts.

    Only A-Z are lower-cased.  ``rewrite`` makes a word of a row's id and a run.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = F.split(F.translate(F.col(f"`{text}`"), upper, upper.lower()), RUN)
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.explode(runs).alias("run")).where("run != ''")
    word = rewrite(F.col("id"), F.col("run")) if rewrite else F.col("run")
    return rows.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


class Trie:
    """A compact trie of sorted (word, count) pairs; nodes are numbered in breadth-first order."""

    def __init__(self, labels: str, first: array, counts: array) -> None:
        self.labels, self.first, self.counts = labels, first, counts

    @staticmethod
    def build(words: list[str], counts: list[int]) -> Trie:
        """``words`` must be sorted, distinct and not empty strings."""
        labels, first, found = ["\0"], array("I"), array("Q")
        level, depth = [(0, len(words))], 0
        while level:
            below = []
            for lo, hi in level:
                first.append(len(labels))
                if lo < hi and len(words[lo]) == depth:
                    found.append(counts[lo])
                    lo += 1
                else:
                    found.append(0)
                while lo < hi:
                    c, at = words[lo][depth], lo
                    while lo < hi and words[lo][depth] == c:
                        lo += 1
                    labels.append(c)
                    below.append((at, lo))
            level, depth = below, depth + 1
        first.append(len(labels))
        return Trie("".join(labels), first, found)

    def neighbours(self, word: str) -> Iterator[tuple[str, int]]:
        """The trie's words at distance one of ``word``, each once, with their counts.

        The automaton has one state without an error, which follows the word itself, and three
        with one: a character too many, another one, or one left out.  From each node that the
        word leads to, labels that leave it open the three; as the word is left as late as it
        can be, no neighbour is met twice, and each state then allows a single label at a node.
        """
        labels, first, counts, end = self.labels, self.first, self.counts, len(word)
        find = labels.find

        def rest(node: int, i: int) -> int:
            """The node that the characters from ``i`` on lead to."""
            while i < end and node >= 0:
                node = find(word[i], first[node], first[node + 1])
                i += 1
            return node

        node, d = 0, 0
        while node >= 0:
            low, high = first[node], first[node + 1]
            if d == end:
                for child in range(low, high):
                    if counts[child]:
                        yield word + labels[child], counts[child]
                return
            here, after = word[d], word[d + 1 : d + 2]
            same = -1
            for child in range(low, high):
                c = labels[child]
                if c == here:
                    same = child
                    continue
                below, above = first[child], first[child + 1]
                if below < above:
                    to = find(here, below, above)  # one character too many
                    if to >= 0 and (to := rest(to, d + 1)) >= 0 and counts[to]:
                        yield word[:d] + c + word[d:], counts[to]
                    to = find(after, below, above) if after else child  # another character
                else:
                    to = -1 if after else child
                if to >= 0 and (to := rest(to, d + 2)) >= 0 and counts[to]:
                    yield word[:d] + c + word[d + 1 :], counts[to]
            if after != here:  # one character left out
                to = find(after, low, high) if after else node
                if to >= 0 and (to := rest(to, d + 2)) >= 0 and counts[to]:
                    yield word[:d] + word[d + 1 :], counts[to]
            node, d = same, d + 1

    def pack(self) -> tuple[str, bytes, bytes]:
        return self.labels, self.first.tobytes(), self.counts.tobytes()

    @staticmethod
    def unpack(labels: str, first: bytes, counts: bytes) -> Trie:
        return Trie(labels, array("I", first), array("Q", counts))


def trie_shards(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(shard, size, labels, first, counts): a trie for each sorted range of (word, n)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts, k, chars = [], [], 0, 0
        part = TaskContext.get().partitionId()

        def shard() -> pa.RecordBatch:
            labels, first, found = Trie.build(names, counts).pack()
            row = {"shard": f"{part}-{k}", "size": len(labels.encode()) + len(first) + len(found), "labels": labels, "first": first, "counts": found}
            return pa.RecordBatch.from_pylist([row])

        for batch in batches:
            for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                if names and (len(names) >= shard_words or chars + len(w) > SHARD_CHARS):
                    yield shard()
                    names, counts, k, chars = [], [], k + 1, 0
                names.append(w)
                counts.append(n)
                chars += len(w)
        if names:
            yield shard()

    ranges = words.select("word", "n").repartitionByRange("word").sortWithinPartitions("word")
    return ranges.mapInArrow(build, "shard string, size long, labels string, first binary, counts binary")


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(word, n_near, best): for words that have neighbours, their number and the best one.

    ``best`` is a struct (n, word): of the largest count, and of those the smallest word.
    """
    spark = words.sparkSession
    shards = materialize(trie_shards(words, shard_words), "tries")
    sizes = shards.select("shard", "size")
    # rounds by running size; a row of about 40 bytes for each shard
    total = F.sum("size").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    rounds = materialize(sizes.select("shard", F.floor((total - 1) / round_bytes).alias("turn")), "turns")
    dealt = words.select("word").repartition(max(1, math.ceil(words.count() / TASK_WORDS)))
    parts = []
    for k in [r.turn for r in rounds.select("turn").distinct().orderBy("turn").collect()]:  # one number for each round
        held = rounds.where(F.col("turn") == k).join(shards, "shard").select("labels", "first", "counts").collect()  # about round_bytes
        shared = spark.sparkContext.broadcast([tuple(r) for r in held])
        del held

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tries = [Trie.unpack(*t) for t in shared.value]
            for batch in batches:
                out: list[tuple[str, int, int, str]] = []
                for w in batch.column("word").to_pylist():
                    found = [x for t in tries for x in t.neighbours(w)]
                    if found:
                        best, n = min(found, key=lambda x: (-x[1], x[0]))
                        out.append((w, len(found), n, best))
                columns = list(zip(*out)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "n", "form"])

        part = dealt.mapInArrow(run, "word string, n_near long, n long, form string")
        parts.append(materialize(part, "near-words"))
        shared.destroy()
    if not parts:
        return spark.createDataFrame([], "word string, n_near long, best struct<n: long, word: string>")
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    best = F.min_by(F.struct("n", F.col("form").alias("word")), F.struct(-F.col("n"), "form"))
    return both.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root): where following (word, form) steps ends.  There must be no cycles."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        at = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return at


def group_variants(counts: DataFrame, min_chars: int = 5, min_count: int = 3, ratio: int = 2, shard_words: int = SHARD_WORDS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for words of (word, n) that are long and frequent enough.

    ``form`` is the near word of the largest count, if that is at least ``ratio``
    (2 or more) times the word's own; ``root`` is the last of the chain of forms.
    """
    if ratio < 2:
        raise ValueError("with a ratio under 2 forms could run in circles")
    words = materialize(counts.where((F.length("word") >= min_chars) & (F.col("n") >= min_count)), "words")
    near = near_words(words, shard_words, round_bytes)
    fits = F.col("best.n") >= ratio * F.col("n")
    judged = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.word")).alias("form"), F.when(fits, F.col("best.n")).alias("form_n"))
    judged = materialize(judged, "judged")
    roots = last_forms(judged.where("form is not null").select("word", "form"))
    return judged.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
