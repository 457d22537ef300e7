"""Byte-level BPE: exact encoding and decoding on Spark.

Encoding works on one pre-token at a time, by dynamic programming over its
prefixes.  For every prefix exactly one token can be the last one of the
prefix's encoding.  Candidates are the vocabulary entries that end where the
prefix ends, found by an automaton over the vocabulary; a candidate is the
right one if it starts the prefix, or if the merges would keep it apart from
the last token of what precedes it.  The back-pointers then give the ids.

Results per pre-token are kept in a bounded cache of each Python worker.

Defined results: a null text counts as empty and has no ids; special strings
inside a text become their ids, as the library does by default; repeated rows
are encoded each for itself and get equal ids; a very long text is encoded whole,
its ids in one array; an empty table gives an empty one; other columns are kept,
but for those named like a new column, which are replaced.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import text_slices

#: Fixed value: white space as the tokenizer's pattern takes it (Unicode White_Space).
SPACES = r"\t-\r \x85\xa0  -     　"
#: Fixed value: how a text is cut into pre-tokens.
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"

#: Pre-tokens that a worker remembers; beyond it, the cache starts anew.
CACHE_ENTRIES = 500_000
#: Longer pieces are not remembered: texts without spaces are one piece, and seldom the same twice.
CACHED_CHARS = 64
#: Pairs of tokens whose test a worker remembers.
PAIR_ENTRIES = 2_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class PrefixEncoder:
    """A byte-level BPE vocabulary with its encoder and decoder."""

    def __init__(self, path: str) -> None:
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_alphabet()
        raw = lambda token: bytes(to_byte[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.token_bytes: dict[int, bytes] = {i: raw(t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.merge_rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made_at: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            self.merge_rank[left, right] = rank
            if made not in self.parts:
                self.parts[made], self.made_at[made] = (left, right), rank
        self.matcher = ahocorasick.Automaton()
        for token, i in vocab.items():
            key = raw(token).decode("latin-1")
            self.matcher.add_word(key, (len(key), i))
        self.matcher.make_automaton()
        self.never = len(self.merge_rank) + 1
        self.apart: dict[int, bool] = {}
        self.edges: tuple[dict[int, list[tuple[int, int]]], ...] = ({}, {})
        self.known: dict[str, tuple[int, ...]] = {}
        self.after_space: dict[str, tuple[int, ...]] = {}
        self.tangled = re.compile(r"\s \s|\s \Z").search
        self.cut = regex.compile(PRE_TOKEN).findall
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """(token, rank of the merge that consumes it) down one edge of a token's merge tree."""
        out = self.edges[side].get(token)
        if out is None:
            out, at = [(token, self.never)], token
            while at in self.parts:
                consumed = self.made_at[at]
                at = self.parts[at][side]
                out.append((at, consumed))
            self.edges[side][token] = out
        return out

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges of two neighbouring tokens' bytes end in just these two.

        They do unless some pair of pieces that meet at the border is merged
        before either piece is consumed on its own side.  Equal ranks go from
        left to right.
        """
        rank_of, never = self.merge_rank.get, self.never
        starts = self._edge(right, 0)
        for a, a_gone in self._edge(left, 1):
            for b, b_gone in starts:
                rank = rank_of((a, b), never)
                if rank < a_gone and rank <= b_gone:
                    return False
        return True

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """The ids of one pre-token."""
        data = piece.encode("utf-8").decode("latin-1")
        last: list[int] = [-1] * len(data)
        width: list[int] = [0] * len(data)
        apart = self.apart
        for end, (size, token) in self.matcher.iter(data):
            if width[end]:
                continue
            before = end - size
            if before >= 0:
                pair = last[before] << 32 | token
                fits = apart.get(pair)
                if fits is None:
                    fits = apart[pair] = self.compatible(last[before], token)
                if not fits:
                    continue
            last[end], width[end] = token, size
        if len(apart) > PAIR_ENTRIES:
            apart.clear()
        ids, at = [], len(data) - 1
        while at >= 0:
            ids.append(last[at])
            at -= width[at]
        return tuple(reversed(ids))

    def _cut_ids(self, text: str) -> tuple[int, ...]:
        """The ids of a text without special tokens, pre-token by pre-token."""
        known, out = self.known, []
        for piece in self.cut(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.encode_piece(piece)
                if len(piece) <= CACHED_CHARS:
                    known[piece] = ids
            out += ids
        return tuple(out)

    def pieces(self, text: str) -> list[tuple[int, ...]]:
        """The ids of a text, in parts that end where pre-tokens end.

        A pre-token ends before each single space between other characters, so
        texts are first cut there, which needs no pattern; whole parts are
        then looked up.  Texts in which a space stands between white space are
        cut by the pattern alone.
        """
        out: list[tuple[int, ...]] = []
        after_space = self.after_space
        for part in self.cut_special.split(text) if self.cut_special else [text]:
            if part in self.special:
                out.append((self.special[part],))
                continue
            if self.tangled(part):
                out.append(self._cut_ids(part))
                continue
            first, *rest = part.split(" ")
            out.append(self._cut_ids(first))
            found = list(map(after_space.get, rest))
            if None in found:
                for i, ids in enumerate(found):
                    if ids is None:
                        w = rest[i]
                        ids = after_space.get(w)
                        if ids is None:
                            ids = self._cut_ids(" " + w)
                            if len(w) <= CACHED_CHARS:
                                after_space[w] = ids
                        found[i] = ids
            out += found
        for cache in (self.known, after_space):
            if len(cache) > CACHE_ENTRIES:
                cache.clear()
        return out

    def forget(self) -> None:
        """Empty the caches: a worker that is idle, or has other work next, then holds the vocabulary only."""
        for cache in (self.known, self.after_space, self.apart, *self.edges):
            cache.clear()

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.pieces(text or "")))

    def decode(self, ids) -> str:
        """The text of ids; special tokens are kept, broken UTF-8 is replaced."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> PrefixEncoder:
    """One encoder for each vocabulary and Python worker."""
    return PrefixEncoder(path)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add the token ids of a text column as array<int>.

    ``decoded`` names a further column for the ids decoded again, for a round
    trip in the same pass.  All columns of ``docs`` are kept; those that have
    the name of a new column are replaced.
    """
    keep = [c for c in docs.columns if c not in (ids, decoded)]
    given = docs.select(*[F.col(f"`{c}`") for c in keep])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema)
    schema = f"{fields}, `{ids}` array<int>" + (f", `{decoded}` string" if decoded else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        try:
            for batch in text_slices(batches, text):
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                rows = [np.fromiter(chain.from_iterable(bpe.pieces(t or "")), dtype=np.int32) for t in texts]
                columns = [*batch.columns, _lists(rows)]
                if decoded:
                    columns.append(pa.array([bpe.decode(r.tolist()) for r in rows], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, ids, *([decoded] if decoded else [])])
        finally:
            bpe.forget()

    return given.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of a column of token ids; null ids give an empty text."""
    keep = [c for c in rows.columns if c != text]
    given = rows.select(*[F.col(f"`{c}`") for c in keep])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                lists = part.column(part.schema.get_field_index(ids)).to_pylist()
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([bpe.decode(x or []) for x in lists], pa.string())], names=[*keep, text])

    return given.mapInArrow(run, f"{fields}, `{text}` string")
