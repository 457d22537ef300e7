"""Substring dedup: remove words covered by word windows that occur twice or more.

The reference is the corpus itself, whose automata have no bounded size, so its
shards are not broadcast: Spark deals passages to shards, and each passage is
streamed through the one automaton that can hold its repeats.

1. Of each window's 16-word runs the least hash is its anchor, so equal windows
   have equal anchors.  Anchors are about a tenth of the words; windows whose
   anchor occurs once in the corpus cannot be repeated.
2. Consecutive windows of one anchor make a passage.  Equal passages are counted
   before they are shuffled, and dealt to shards by anchor.
3. A shard's passages become a suffix automaton whose states know how often
   their runs occur.  Passages are streamed through it for matching statistics
   (at each word, the longest run ending there that occurs twice or more), and
   maximal spans of at least a window are removed.

An anchor with very many different passages (a common phrase in ever other
surroundings) would make one shard large.  Its windows are sifted once more by
their own hash, and those left are dealt to shards by that hash, one window a
passage; results are the same, whichever way a passage takes.

What is removed depends on a text alone, so results are carried by text and
joined back to all rows with that text.

``remove_reference`` serves reference texts of bounded size: automata of
reference shards are broadcast and all documents streamed through them.

Defined results: null and empty texts have no words and lose none; texts with
fewer words than a window keep all; repeated rows count as repeats of each
other, so all of them lose their windows; a very long text is taken whole; an
empty table gives an empty one; ids are taken as long (one that is not a number
counts as null); other columns are not kept, so that none can clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import discard, materialize, text_slices
from rankweave.llm.wordhash import window_hashes, word_hashes

ANCHOR = 16
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def anchors(words: np.ndarray, window: int) -> np.ndarray:
    """For each window, by start, the start of the run that is its anchor."""
    size = min(ANCHOR, window)
    runs = window_hashes(words, size)
    width = window - size + 1
    if len(runs) < width:
        return np.zeros(0, dtype=np.int64)
    return np.lib.stride_tricks.sliding_window_view(runs, width).argmin(axis=1) + np.arange(len(runs) - width + 1)


def covered(spans: Sequence[Sequence[int]], n: int) -> np.ndarray:
    """A mask of the words that these spans (start, end) cover."""
    edge = np.zeros(n + 1, dtype=np.int32)
    bounds = np.array(spans, dtype=np.int64).reshape(-1, 2)
    np.add.at(edge, bounds[:, 0], 1)
    np.add.at(edge, bounds[:, 1], -1)
    return np.cumsum(edge[:n]) > 0


def _digest(passage: str) -> bytes:
    return hashlib.blake2b(passage.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _batch(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in columns.values()], names=list(columns))


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    body = F.col(f"`{text}`")
    return docs.select(F.xxhash64(body, F.length(body)).alias("key"), body.alias("text"))


def _meet(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join tables that both grow with the corpus: by sorting at every size, in a plan that Spark can split where keys are hot."""
    return left.join(right.hint("merge"), on, how)


def shared_passages(docs: DataFrame, window: int, text: str) -> DataFrame:
    """(key, anchor, digest, starts, passage): passages of windows whose anchor occurs twice or more.

    Each text has one row for each of its different passages, with all places where it starts.
    """
    keyed = _keyed(docs.where(F.col(f"`{text}`").isNotNull()), text)
    run_words = min(ANCHOR, window)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            keys, hashes, places = [], [], []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = word_hashes(t)
                at = np.unique(anchors(words, window))
                if len(at):
                    keys.append(np.full(len(at), key, dtype=np.int64))
                    hashes.append(window_hashes(words, run_words)[at].view(np.int64))
                    places.append(at.astype(np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hashes, keys, places)], names=["anchor", "key", "at"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            keys, runs, digests, starts, passages = [], [], [], [], []
            for key, t, shared in zip(*(batch.column(i).to_pylist() for i in range(3))):
                hashes, words = word_hashes(t), _WORDS.findall(t)
                at = anchors(hashes, window)
                edges = np.flatnonzero(np.diff(at)) + 1
                first, last = np.concatenate(([0], edges)), np.concatenate((edges, [len(at)])) + window - 1
                chosen = np.isin(at[first], np.array(shared))
                values = window_hashes(hashes, run_words)[at[first[chosen]]].view(np.int64)
                found: dict[str, list] = {}
                for a, b, value in zip(first[chosen].tolist(), last[chosen].tolist(), values.tolist()):
                    found.setdefault(" ".join(words[a:b]), [value]).append(a)
                for passage, (value, *places) in found.items():
                    keys.append(key)
                    runs.append(value)
                    digests.append(_digest(passage))
                    starts.append(places)
                    passages.append(passage)
            yield _batch({"key": (keys, pa.int64()), "anchor": (runs, pa.int64()), "digest": (digests, pa.binary()), "starts": (starts, pa.list_(pa.int32())), "passage": (passages, pa.string())})

    found = materialize(keyed.mapInArrow(find, "anchor long, key long, at int"), "anchors")
    shared = materialize(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors-shared")
    spots = _meet(found, shared, "anchor").groupBy("key").agg(F.collect_set("at").alias("at"))  # bounded by a text's length
    spots = materialize(spots, "shared-anchors")
    cuts = _meet(keyed, spots, "key").select("key", "text", "at").mapInArrow(cut, "key long, anchor long, digest binary, starts array<int>, passage string")
    passages = materialize(cuts, "passages")
    discard(found, shared, spots)
    return passages


def count_in_shards(passages: DataFrame, window: int, shard_words: int) -> DataFrame:
    """(digest, spans): for (shard, digest, passage, n), the maximal spans of each passage that occur twice or more.

    Passages of one ``shard`` value meet in one automaton; several values share one
    until it has ``shard_words`` words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: list[tuple[bytes, list[str], int]]) -> pa.RecordBatch:
            auto = SuffixAutomaton()
            for _, words, n in rows:
                auto.add(words, n)
            auto.count()
            digests, spans = [], []
            for digest, words, _ in rows:
                found = maximal_spans(auto.repeated(words), window)
                if found:
                    digests.append(digest)
                    spans.append(found)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            return _batch({"digest": (digests, pa.binary()), "spans": ([[{"start": a, "end": b} for a, b in s] for s in spans], kind)})

        rows, size, last = [], 0, None
        for batch in batches:
            for shard, digest, passage, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if size >= shard_words and shard != last:
                    yield solve(rows)
                    rows, size = [], 0
                words = passage.split(" ")
                rows.append((digest, words, n))
                size, last = size + len(words), shard
        if rows:
            yield solve(rows)

    dealt = passages.select("shard", "digest", "passage", "n").repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "digest binary, spans array<struct<start:int,end:int>>")


def repeated_spans(docs: DataFrame, window: int = 35, text: str = "text", shard_words: int = 20_000, hot_passages: int = 500) -> DataFrame:
    """(key, spans): for each text that has any, spans (start, end) of words in repeated windows.

    Anchors with more than ``hot_passages`` different passages are dealt by window.
    """
    passages = shared_passages(docs, window, text)
    counted = passages.groupBy("anchor", "digest", "passage").agg(F.sum(F.size("starts")).alias("n"))
    counted = materialize(counted, "passages-counted")
    hot = materialize(counted.groupBy("anchor").agg(F.count("*").alias("m")).where(F.col("m") > hot_passages).select("anchor"), "anchors-hot")
    solved = count_in_shards(counted.join(hot, "anchor", "left_anti").withColumnRenamed("anchor", "shard"), window, shard_words)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "passage"):
            hashes, parents, places, times = [], [], [], []
            for digest, passage, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                values = window_hashes(word_hashes(passage), window).view(np.int64)
                hashes.append(values)
                parents.extend([digest] * len(values))
                places.append(np.arange(len(values), dtype=np.int32))
                times.append(np.full(len(values), n, dtype=np.int64))
            if parents:
                columns = [pa.array(np.concatenate(hashes)), pa.array(parents, pa.binary()), pa.array(np.concatenate(places)), pa.array(np.concatenate(times))]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "parent", "at", "n"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "passage"):
            shards, digests, parts, parents, places, times = [], [], [], [], [], []
            for parent, passage, n, spots in zip(*(batch.column(i).to_pylist() for i in range(4))):
                words = passage.split(" ")
                for spot in spots:
                    part = " ".join(words[spot["at"] : spot["at"] + window])
                    shards.append(spot["shard"])
                    digests.append(_digest(part))
                    parts.append(part)
                    parents.append(parent)
                    places.append(spot["at"])
                    times.append(n)
            kinds = {"shard": (shards, pa.int64()), "digest": (digests, pa.binary()), "passage": (parts, pa.string()), "parent": (parents, pa.binary()), "at": (places, pa.int32()), "n": (times, pa.int64())}
            yield _batch(kinds)

    busy = counted.join(hot, "anchor", "left_semi").select(F.col("digest").alias("parent"), "passage", "n")
    sifted = materialize(busy.select("parent", "passage", "n").mapInArrow(windows, "shard long, parent binary, at int, n long"), "hot-windows")
    again = materialize(sifted.groupBy("shard").agg(F.sum("n").alias("n")).where("n > 1").select("shard"), "hot-windows-twice")
    spots = _meet(sifted, again, "shard").groupBy("parent").agg(F.collect_list(F.struct("shard", "at")).alias("spots"))  # a passage's windows
    parts = _meet(busy, spots, "parent").select("parent", "passage", "n", "spots")
    parts = materialize(parts.mapInArrow(cut, "shard long, digest binary, passage string, parent binary, at int, n long"), "hot-passages")
    once = parts.groupBy("shard", "digest", "passage").agg(F.sum("n").alias("n"))
    inside = count_in_shards(once, window, shard_words).select("digest")
    inside = _meet(parts, inside, "digest").groupBy("parent").agg(F.collect_list(F.struct(F.col("at").alias("start"), (F.col("at") + window).alias("end"))).alias("spans"))
    solved = materialize(solved.union(inside.select(F.col("parent").alias("digest"), "spans")), "passages-solved")

    placed = _meet(passages.select("key", "digest", "starts"), solved, "digest")
    placed = placed.select("key", F.explode("starts").alias("at"), "spans").select("key", "at", F.explode("spans").alias("s"))
    spans = placed.select("key", F.struct((F.col("at") + F.col("s.start")).alias("start"), (F.col("at") + F.col("s.end")).alias("end")).alias("s"))
    spans = materialize(spans.groupBy("key").agg(F.collect_set("s").alias("spans")), "repeated-spans")
    discard(passages, counted, hot, sifted, again, parts, solved)
    return spans


def remove_repeats(docs: DataFrame, window: int = 35, text: str = "text", key: str = "doc_id", shard_words: int = 20_000, hot_passages: int = 500) -> DataFrame:
    """(key, n_words, n_removed, kept): the text that is left, words joined by one space."""
    spans = repeated_spans(docs, window, text, shard_words, hot_passages)
    body = F.col(f"`{text}`")
    rows = docs.select(F.xxhash64(body, F.length(body)).alias("key"), F.col(f"`{key}`").cast("long").alias("id"), body.alias("text"))
    flat = spans.select("key", F.flatten(F.transform("spans", lambda s: F.array(s["start"], s["end"]))).alias("spans"))
    rows = _meet(rows, flat, "key", "left").select("id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            n_words, n_removed, kept = [], [], []
            for t, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = _WORDS.findall(t or "")
                n_words.append(len(words))
                if places and words:
                    gone = covered(places, len(words))
                    n_removed.append(int(gone.sum()))
                    kept.append(" ".join([w for w, g in zip(words, gone.tolist()) if not g]))
                else:
                    n_removed.append(0)
                    kept.append(" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(run, "id long, n_words long, n_removed long, kept string").withColumnRenamed("id", key)


def maximal_spans(sizes: Sequence[int], least: int) -> list[tuple[int, int]]:
    """Spans (start, end) that cover all runs of at least ``least`` words, from their lengths by last word."""
    out: list[tuple[int, int]] = []
    for end, n in enumerate(sizes, 1):
        if n >= least:
            start = end - n
            if out and start < out[-1][1]:
                start = min(start, out.pop()[0])
            out.append((start, end))
    return out


class SuffixAutomaton:
    """The suffix automaton of a reference shard: all runs of words of its texts."""

    def __init__(self, texts: Iterable[Sequence[str]] = ()) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.times: dict[int, int] = {}
        self.twice: list[int] = []
        for words in texts:
            self.add(words)

    def add(self, words: Sequence[str], n: int = 1) -> None:
        """Take in a text that occurs ``n`` times."""
        last = 0
        for w in words:
            last = self._extend(last, w)
            self.times[last] = self.times.get(last, 0) + n

    def count(self) -> None:
        """For each state, the length of its longest suffix that occurs twice or more."""
        times = [self.times.get(state, 0) for state in range(len(self.next))]
        shortest_first = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for state in reversed(shortest_first):
            times[self.link[state]] += times[state]
        self.twice = [0] * len(self.next)
        for state in shortest_first:
            self.twice[state] = self.length[state] if times[state] > 1 else self.twice[self.link[state]]

    def repeated(self, words: Sequence[str]) -> list[int]:
        """For each word of a text taken in, the longest run ending there that occurs twice or more."""
        state, out = 0, []
        for w in words:
            state = self.next[state][w]
            out.append(self.twice[state])
        return out

    def _extend(self, last: int, w: str) -> int:
        at = self.next[last].get(w)
        if at is not None and self.length[at] == self.length[last] + 1:
            return at
        new = -1
        if at is None:
            new = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p < 0:
                return new
        else:
            p = last
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            self.link[new] = q
            return new
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        if new < 0:
            return clone
        self.link[new] = clone
        return new

    def matching(self, words: Sequence[str]) -> list[int]:
        """For each word, the longest run ending there that the reference has."""
        state, size, out = 0, 0, []
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if w in self.next[state]:
                state, size = self.next[state][w], size + 1
            out.append(size)
        return out


def remove_reference(docs: DataFrame, reference: DataFrame, window: int = 35, text: str = "text", key: str = "doc_id", shard_words: int = 100_000, max_words: int = 400_000) -> DataFrame:
    """(key, kept): documents without words in runs of ``window`` or more that a reference text has.

    The reference is collected in shards of about ``shard_words`` words; more
    than ``max_words`` in all are refused, as a task's automata (about 1.1 KB a word) would not be small.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    size = reference.agg(F.coalesce(F.sum(F.size(F.split(body, r"\s+"))), F.lit(0)).alias("n")).first().n
    if size > max_words:
        raise ValueError(f"the reference has {size} words; at most {max_words} can be broadcast")
    shards, at = [[]], 0
    for row in reference.select(body.alias("t")).toLocalIterator():
        words = _WORDS.findall(row.t)
        if at + len(words) > shard_words and shards[-1]:
            shards.append([])
            at = 0
        shards[-1].append(words)
        at += len(words)
    shared = [docs.sparkSession.sparkContext.broadcast(s) for s in shards]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [SuffixAutomaton(s.value) for s in shared]
        for batch in text_slices(batches):
            kept = []
            for t in batch.column(1).to_pylist():
                words = _WORDS.findall(t or "")
                gone = np.zeros(len(words) + 1, dtype=np.int32)
                for end, n in chain.from_iterable(enumerate(a.matching(words)) for a in automata):
                    if n >= window:
                        gone[end + 1 - n] += 1
                        gone[end + 1] -= 1
                kept.append(" ".join(w for w, g in zip(words, np.cumsum(gone).tolist()) if not g))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string())], names=["id", "kept"])

    return docs.select(F.col(f"`{key}`").cast("long").alias("id"), body.alias("text")).mapInArrow(run, "id long, kept string").withColumnRenamed("id", key)
