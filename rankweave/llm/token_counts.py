"""Token counts of texts, without shuffling pre-tokens.

White space never belongs to a token of this vocabulary, so a text's count is
the sum over its white-space separated pieces.  Counts of pieces are looked up
in two tiers: a table of the most frequent pieces, broadcast once to every
executor, and a bounded cache in each Python worker, filled by encoding missing
pieces with the tokenizer's library in batches.

The broadcast table holds at most ``frequent`` pieces of up to ``CACHED_CHARS``
characters, a few MB: the commonest ones of ``sample_docs`` documents that are
taken by their texts' hashes from the whole table.  It only decides which tier
answers; every text is counted whole, and no count depends on it.

Defined results: a null text counts as empty (0 tokens); repeated rows are counted
each for itself, and equal texts get equal counts; a very long text is counted
whole; an empty table gives an empty one; other columns are kept, but for one
named like the new column, which is replaced.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import text_slices

#: Characters that Python, but not the tokenizer, takes as white space.
ODD_SPACE = re.compile("[\x1c-\x1f]")

#: Pieces that a worker remembers; beyond it, its cache starts anew.
CACHE_ENTRIES = 500_000
#: Longer pieces are not remembered: texts without spaces are one piece, and seldom the same twice.
CACHED_CHARS = 64


@lru_cache(maxsize=2)
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


_MISSES: dict[str, dict[str, int]] = {}


class Counter:
    """Counts texts with the two tiers."""

    def __init__(self, path: str, frequent: dict[str, int]) -> None:
        self.path, self.frequent = path, frequent
        self.misses = _MISSES.setdefault(path, {})

    def encode_sizes(self, pieces: list[str]) -> list[int]:
        return [len(e.ids) for e in _library(self.path).encode_batch_fast(pieces, add_special_tokens=False)]

    def count(self, texts: list[str | None]) -> list[int]:
        """The number of tokens of each text."""
        if len(self.misses) > CACHE_ENTRIES:
            self.misses.clear()
        first, second, out = self.frequent.get, self.misses, []
        waiting: list[tuple[int, list[str]]] = []
        for i, text in enumerate(texts):
            if not text:
                out.append(0)
                continue
            if ODD_SPACE.search(text):
                out.append(self.encode_sizes([text])[0])
                continue
            pieces = text.split()
            sizes = list(map(first, pieces))
            total = 0
            if None in sizes:
                rest = [p for p, n in zip(pieces, sizes) if n is None]
                total = sum(n for n in sizes if n is not None)
                waiting.append((i, rest))
            else:
                total = sum(sizes)
            out.append(total)
        new = list({p for _, rest in waiting for p in rest if p not in second})
        once = dict(zip(new, self.encode_sizes(new))) if new else {}
        second.update((p, n) for p, n in once.items() if len(p) <= CACHED_CHARS)
        for i, rest in waiting:
            out[i] += sum(once[p] if p in once else second[p] for p in rest)
        return out


def frequent_sizes(docs: DataFrame, path: str, text: str, frequent: int, sample_docs: int) -> dict[str, int]:
    """The first tier: sizes of the commonest pieces of documents taken by hash."""
    body = F.col(f"`{text}`")
    share = min(1.0, 4 * sample_docs / max(1, docs.count()))  # so that few texts of a task are sorted at all
    h = F.xxhash64(body)
    some = docs.where(body.isNotNull() & (h <= F.lit(int(-(2**63) + share * (2**64 - 1025))))).select(body.alias("t"), h.alias("h")).orderBy("h", "t").limit(sample_docs)
    pieces = some.select(F.explode(F.split("t", r"\s+")).alias("p")).where(f"p != '' and length(p) <= {CACHED_CHARS}")
    found = pieces.groupBy("p").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p").limit(frequent).collect()  # bounded by ``frequent``
    names = [r.p for r in found if not ODD_SPACE.search(r.p) and r.p.split() == [r.p]]
    return dict(zip(names, Counter(path, {}).encode_sizes(names))) if names else {}


def count_tokens(docs: DataFrame, path: str, text: str = "text", out: str = "n_tokens", frequent: int = 30_000, sample_docs: int = 1_000) -> DataFrame:
    """Add each text's token count as a long column named ``out``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(frequent_sizes(docs, path, text, frequent, sample_docs))
    keep = [c for c in docs.columns if c != out]
    given = docs.select(*[F.col(f"`{c}`") for c in keep])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, shared.value)
        try:
            for batch in text_slices(batches, text):
                sizes = counter.count(batch.column(batch.schema.get_field_index(text)).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64())], names=[*keep, out])
        finally:
            counter.misses.clear()  # a worker that has other work next holds none of it

    return given.mapInArrow(run, f"{fields}, `{out}` long")
