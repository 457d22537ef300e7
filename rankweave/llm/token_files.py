"""Token ids in Arrow files of equal-length sequences, and readers for them.

Documents are dealt by ranges of their ids and sorted, so that files in the order
of their parts hold all documents in id order.  Each task encodes its texts, adds
the end id, and packs the ids without gaps into sequences of ``length``, which it
writes as record batches of fixed-size lists: ``ids`` (unsigned, as narrow as the
vocabulary allows) and two masks of one bit an id, ``mask`` (an id, not padding)
and ``ends`` (the last id of a document).  Only a file's last sequence is padded.
All batches but the last hold equally many sequences, so sequence i is found without
a search, and its lists are views of the mapped file, not copies.  Beside each
file stands an index, a small Arrow file of (id, start, n_tokens).

A file's name holds a random part, and the manifest, one row for each file, is
written by Spark.  What a lost or repeated task leaves is in no manifest, so
each id is read once however often tasks run.  Only the manifest, which has a
row of about 200 bytes for each file, meets in one task, for the files' offsets.

Defined results: a null text counts as empty and has the end id alone; null ids
come first; rows with equal ids are ordered by a hash of their texts and then as
they are read, each for itself; a text longer than a sequence spans several; an
empty table makes an empty manifest; other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankweave.llm.common import materialize, text_slices
from rankweave.llm.token_counts import CACHED_CHARS, _library
from rankweave.operators.shared import shared_dir

#: Pieces that a worker remembers, about 40 bytes each.
CACHE_ENTRIES = 800_000
#: Words that are encoded as one text.
WORDS = 50_000
#: Bytes of text that are encoded at a time.
SLICE = 20_000_000
#: Letters that every Unicode version knows, as a class and one by one; signs, but for the apostrophe of "it's".
LETTERS = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF"
LETTER_LIST = "".join(c for c in map(chr, range(256)) if re.match(f"[{LETTERS}]", c))
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
SIGNED_WORD = f"^[{LETTERS}]+[{re.escape(SIGNS)}]*$"
#: Bytes of ids that a task hands back at a time.
HANDED = 4_000_000
MANIFEST = "part int, path string, n_docs long, n_ids long, n_sequences long"


@lru_cache(maxsize=2)
def id_type(path: str) -> np.dtype:
    """The narrowest unsigned type for a vocabulary's ids."""
    return np.dtype("<u2" if _library(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")


@lru_cache(maxsize=2)
def _word_ends(path: str) -> np.ndarray:
    """Whether each id ends a word."""
    vocabulary = _library(path).get_vocab(with_added_tokens=True)
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
    return ends


def _stops(values: pa.Array) -> np.ndarray:
    """Where each value of a large binary array without offset ends."""
    return np.frombuffer(values.buffers()[1], np.int64, len(values) + 1)[1:]


class Encoder:
    """Ids of texts, column by column, with pieces remembered.

    White space never belongs to a token of this vocabulary, so a text's ids are those
    of the pieces between it, in order, and each different piece of a slice is looked up
    once.  A letter and a sign after it, but for an apostrophe, never share a token, and
    the tokenizer lower-cases, so that many pieces have one stem.  Stems and pieces of
    other forms are remembered; a full cache keeps those of the last slice.
    """

    def __init__(self, path: str) -> None:
        self.path, self.type = path, id_type(path)
        self.names, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def _encoded(self, texts: list[str]) -> pa.Array:
        found = _library(self.path).encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return pa.array([np.array(e.ids, self.type).tobytes() for e in found], pa.large_binary())

    def _encoded_words(self, words: list[str]) -> pa.Array:
        """Ids of words of letters, encoded as one text: a word ends with the only id of it that ends words."""
        ids = np.array(_library(self.path).encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.type)
        stops = np.flatnonzero(_word_ends(self.path)[ids]) + 1
        if len(stops) != len(words):
            return self._encoded(words)
        cuts = np.append(0, stops) * ids.itemsize
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(cuts), pa.py_buffer(ids)])

    def _known(self, stems: pa.Array, others: pa.Array) -> pa.Array:
        """Ids of different stems and of different other pieces."""
        names = pa.concat_arrays([stems, others])
        at = pc.index_in(names, value_set=self.names)
        lacking = pc.is_null(at)
        new, n = names.filter(lacking), pc.sum(lacking.slice(0, len(stems))).as_py() or 0
        words = new.slice(0, n).to_pylist()
        parts = [self._encoded_words(words[i : i + WORDS]) for i in range(0, n, WORDS)]
        learned = pa.concat_arrays([*parts, self._encoded(new.slice(n).to_pylist())])
        # what is new comes after what is known, in order
        places = pc.if_else(lacking, pc.add(pc.cumulative_sum(lacking.cast(pa.int32())), len(self.ids) - 1), at)
        out = pa.concat_arrays([self.ids, learned]).take(places)
        if len(self.ids) + len(new) > CACHE_ENTRIES:
            self.names, self.ids, new, learned = names.slice(0, 0), out.slice(0, 0), names, out
        short = pc.less_equal(pc.utf8_length(new), CACHED_CHARS)  # texts without spaces are one piece, and seldom the same twice
        self.names = pa.concat_arrays([self.names, new.filter(short)])
        self.ids = pa.concat_arrays([self.ids, learned.filter(short)])
        return out

    def _pieces(self, pieces: pa.Array) -> pa.Array:
        """Ids of different pieces."""
        signed = pc.match_substring_regex(pieces, SIGNED_WORD)
        words, others = pieces.filter(signed), pieces.filter(pc.invert(signed))
        stems = pc.ascii_lower(pc.utf8_rtrim(words, characters=SIGNS)).dictionary_encode()
        tails = pc.utf8_ltrim(words, characters=LETTER_LIST).dictionary_encode()
        known = self._known(stems.dictionary, others)
        ends = self._encoded(tails.dictionary.to_pylist())
        of_words = pc.binary_join_element_wise(known.take(stems.indices), ends.take(tails.indices), pa.scalar(b"", pa.large_binary()))
        order = np.empty(len(pieces), np.int64)
        order[np.flatnonzero(signed)] = np.arange(len(words))
        order[np.flatnonzero(pc.invert(signed))] = np.arange(len(words), len(pieces))
        return pa.concat_arrays([of_words, known.slice(len(stems.dictionary))]).take(pa.array(order))

    def encode_column(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with ``end`` after it, and how many each text has."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        pieces = split.flatten().dictionary_encode()
        stops = np.cumsum(pc.list_value_length(split).to_numpy())
        # the end follows each text's last piece as a piece of its own
        codes = np.insert(pieces.indices.to_numpy(), stops, len(pieces.dictionary))
        found = pa.concat_arrays([self._pieces(pieces.dictionary), pa.array([end], pa.large_binary())]).take(pa.array(codes))
        ends = _stops(found)[stops + np.arange(len(stops))] // self.type.itemsize
        flat = np.frombuffer(found.buffers()[2] or b"", self.type, int(ends[-1]) if len(ends) else 0)
        return flat, np.diff(ends, prepend=0)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text."""
        flat, sizes = self.encode_column(pa.array(texts, pa.string()))
        return [ids.tobytes() for ids in np.split(flat, np.cumsum(sizes)[:-1])] if texts else []


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Record batches cut and joined to about ``SLICE`` bytes: each lookup passes the whole cache once."""
    held, total = [], 0
    for rows in text_slices(batches, chars=SLICE):
        if held and total + rows.nbytes > SLICE:
            yield pa.concat_batches(held)
            held, total = [], 0
        held.append(rows)
        total += rows.nbytes
    if held:
        yield pa.concat_batches(held)


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _open(uri: str):
    """A file for random reads: mapped if it is local, so that its arrays are views."""
    fs, path = pafs.FileSystem.from_uri(uri)
    return pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)


def bits(packed: np.ndarray) -> np.ndarray:
    """A mask with one boolean for each id."""
    return np.unpackbits(packed, axis=-1, bitorder="little").view(bool)


class SequenceFile:
    """Random access to the sequences of one file."""

    def __init__(self, uri: str) -> None:
        self.reader = pa.ipc.open_file(_open(uri))
        self.length = self.reader.schema.field("ids").type.list_size
        n = self.reader.num_record_batches
        self.batch_size = self.reader.get_batch(0).num_rows if n else 1
        self.size = (n - 1) * self.batch_size + self.reader.get_batch(n - 1).num_rows if n else 0

    def __len__(self) -> int:
        return self.size

    def batch(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, mask and ends of one record batch, a row for each sequence; ``bits`` unpacks the masks."""
        rows = self.reader.get_batch(k)
        return tuple(c.flatten().to_numpy(zero_copy_only=True).reshape(-1, c.type.list_size) for c in rows.columns)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, mask and ends of sequence ``i``, without copying them."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        return tuple(x[i % self.batch_size] for x in self.batch(i // self.batch_size))


class _Writer:
    """One file of sequences and its index."""

    def __init__(self, uri: str, kind: pa.DataType, key: pa.DataType, length: int, batch: int) -> None:
        self.kind, self.length, self.wide, self.n_ids, self.n_docs, self.n_sequences = kind, length, length * batch, 0, 0, 0
        fixed = lambda item, size: pa.list_(pa.field("item", item, nullable=False), size)
        self.schema = pa.schema([("ids", fixed(kind, length)), ("mask", fixed(pa.uint8(), length // 8)), ("ends", fixed(pa.uint8(), length // 8))])
        self.index_schema = pa.schema([("id", key), ("start", pa.int64()), ("n_tokens", pa.int64())])
        fs, path = pafs.FileSystem.from_uri(uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.sinks = [fs.open_output_stream(path), fs.open_output_stream(path + ".docs")]
        self.out, self.index = (pa.ipc.new_file(s, schema) for s, schema in zip(self.sinks, (self.schema, self.index_schema)))
        self.ids, self.ends = np.empty(0, kind.to_pandas_dtype()), np.empty(0, bool)

    def add(self, keys: pa.Array, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Append the ids of documents, so many of each, with its end id."""
        stops = np.cumsum(sizes)
        ends = np.zeros(len(flat), bool)
        ends[stops - 1] = True
        self.index.write_batch(pa.record_batch([keys, pa.array(self.n_ids + stops - sizes), pa.array(sizes)], schema=self.index_schema))
        self.n_ids, self.n_docs = self.n_ids + len(flat), self.n_docs + len(sizes)
        self.ids, self.ends = np.concatenate([self.ids, flat]), np.concatenate([self.ends, ends])
        whole = len(self.ids) // self.wide * self.wide
        for at in range(0, whole, self.wide):
            self._batch(self.ids[at : at + self.wide], self.ends[at : at + self.wide])
        self.ids, self.ends = self.ids[whole:].copy(), self.ends[whole:].copy()

    def _batch(self, ids: np.ndarray, ends: np.ndarray) -> None:
        """Write whole sequences, the last one padded."""
        pad = -len(ids) % self.length
        masks = [np.packbits(np.pad(m, (0, pad)), bitorder="little") for m in (np.ones(len(ids), bool), ends)]
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(v, f.type.value_type), type=f.type) for v, f in zip((np.pad(ids, (0, pad)), *masks), self.schema)]
        self.out.write_batch(pa.record_batch(lists, schema=self.schema))
        self.n_sequences += (len(ids) + pad) // self.length

    def close(self) -> None:
        if len(self.ids):
            self._batch(self.ids, self.ends)
        for x in (self.out, self.index, *self.sinks):
            x.close()


def write_sequences(docs: DataFrame, path: str, folder: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = 1, length: int = 2048, batch: int = 256) -> DataFrame:
    """Encode, pack and write all documents; the manifest of the files, one row for each.

    ``path`` names the tokenizer, ``folder`` (a URI that all executors can write)
    the place of the files: by default a new one in the shared folder.  ``length``
    is a multiple of 8; ``batch`` sequences make a record batch.
    """
    if length % 8:
        raise ValueError("length must be a multiple of 8")
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/sequences-{uuid.uuid4().hex}"
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).withColumn("row", F.monotonically_increasing_id())
    order = ["id", F.xxhash64("text"), "row"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, file, out = TaskContext.get().partitionId(), f"{folder}/{uuid.uuid4().hex}.arrow", None
        encoder, kind = _encoder(path), id_type(path)
        end = np.array([end_id], kind).tobytes()
        for rows in _portions(batches):
            out = out or _Writer(file, pa.from_numpy_dtype(kind), rows.schema.field("id").type, length, batch)
            out.add(rows.column("id"), *encoder.encode_column(rows.column("text"), end))
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [file], "n_docs": [out.n_docs], "n_ids": [out.n_ids], "n_sequences": [out.n_sequences]})

    return materialize(rows.mapInArrow(write, MANIFEST), "manifest")


def offsets(manifest: DataFrame) -> DataFrame:
    """The manifest with ``first_id`` and ``first_sequence``: how many of them all files before hold."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"first_{name}": F.coalesce(F.sum(f"n_{name}s").over(before), F.lit(0)) for name in ("id", "sequence")}
    return manifest.withColumns(sums)


def _documents(uri: str) -> Iterator[tuple[pa.RecordBatch, Callable[[int, int], np.ndarray]]]:
    """Batches of a file's index, with a function for the ids from one place to another."""
    file, index = SequenceFile(uri), pa.ipc.open_file(_open(uri + ".docs"))
    wide = file.batch_size * file.length

    def ids(start: int, stop: int) -> np.ndarray:
        parts = [file.batch(k)[0].reshape(-1)[max(0, start - k * wide) : stop - k * wide] for k in range(start // wide, -(-stop // wide))]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    for k in range(index.num_record_batches):
        yield index.get_batch(k), ids


def read_documents(spark: SparkSession, manifest: DataFrame, key_type: str = "long") -> DataFrame:
    """(id, start, n_tokens, ids) of every document, read from the files.

    ``start`` counts the ids of all documents before it; ``ids`` are little-endian
    unsigned 32-bit integers.
    """
    files = offsets(manifest).select("path", "first_id").repartition(max(1, manifest.count()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for docs, ids in _documents(row["path"]):
                    starts, sizes = docs.column("start").to_numpy(), docs.column("n_tokens").to_numpy()
                    at = 0
                    while at < len(sizes):
                        held = max(1, int(np.searchsorted(np.cumsum(sizes[at:]) * 4, HANDED)))
                        first, last = int(starts[at]), at + min(held, len(sizes) - at)
                        # documents follow each other, so that one array holds the ids of all of them
                        cuts = np.append(starts[at:last] - first, starts[last - 1] + sizes[last - 1] - first).astype(np.int32) * 4
                        flat = ids(first, first + int(cuts[-1]) // 4).astype("<u4")
                        values = pa.BinaryArray.from_buffers(pa.binary(), last - at, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(flat)])
                        part = docs.slice(at, last - at)
                        yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(starts[at:last] + row["first_id"]), part.column("n_tokens"), values], names=["id", "start", "n_tokens", "ids"])
                        at = last

    return files.mapInArrow(read, f"id {key_type}, start long, n_tokens long, ids binary")
