"""Token files, spelling variants and the conversation trie against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rankweave.llm import conversation_trie, token_files, variants
from rankweave.llm.common import text_slices
from rankweave.llm.queries import QUERIES, rebuilt, tokenizer_path

pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
SCHEMA = "doc_id long, text string, start string, ids string, n_tokens boolean, word string, n string"
TEXTS = [
    (5, "Hello, world. It's <|endoftext|> fine"), (1, None), (2, ""), (3, "  \n\t "), (9, "word " * 3000), (4, "x" * 5000), (4, "x" * 5000), (4, "another under one id"), (None, "no id, É. é,"), (None, None),
    (7, "日本語 ﬁ İK ſ Σς\x1cx"), (8, "same"), (6, "same"),
]


@pytest.fixture()
def parts(spark):
    """Ranges stay apart, so that files and stacks cross them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "a", "b", True, "c", "d") for i, t in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def library():
    found = tokenizers.Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    found.no_truncation()
    found.no_padding()
    return found


def encoded(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


# Token files


def test_documents_come_back_whole_and_in_order(spark, docs, library, parts):
    manifest = token_files.write_sequences(docs, tokenizer_path("word_bpe_49k.json"), length=64)
    rows = sorted(token_files.read_documents(spark, manifest).collect(), key=lambda r: r.start)
    assert [r.id for r in rows] == sorted((i for i, _ in TEXTS), key=lambda i: (i is not None, i))
    at = 0
    for r in rows:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    got = Counter((r.id, bytes(r.ids)) for r in rows)
    assert got == Counter((i, np.array(encoded(library, t), "<u4").tobytes()) for i, t in TEXTS)
    assert sum(r.n_docs for r in manifest.collect()) == len(TEXTS) and sum(r.n_ids for r in manifest.collect()) == at


def test_sequences_are_found_without_copies(docs):
    manifest = token_files.write_sequences(docs.coalesce(1), tokenizer_path("word_bpe_49k.json"), length=64, batch=4).orderBy("part").collect()
    for m in manifest:
        file = token_files.SequenceFile(m.path)
        ids, mask, ends = (np.concatenate(x) for x in zip(*((i, token_files.bits(a), token_files.bits(b)) for i, a, b in (file[k] for k in range(len(file))))))
        assert len(file) == m.n_sequences and mask.sum() == m.n_ids and ends.sum() == m.n_docs and mask[: m.n_ids].all() and (ids[ends] == 1).all()
        before = pa.total_allocated_bytes()
        one, packed, _ = file[len(file) - 1]
        assert not one.flags.owndata and not packed.flags.owndata and one.shape == (64,) and packed.shape == (8,) and pa.total_allocated_bytes() - before < 64
        with pytest.raises(IndexError):
            file[len(file)]


def test_encoder_equals_the_library(library, monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_ENTRIES", 50)
    rng, letters = random.Random(1), "abcABCéÉßïÏ.,.,;'’ \n\t\x1c\u0085 ​0123ªºİKſΣσς日本ﬁ<|>́̈!?-_#"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) + (" it's,<|endoftext|>" if i % 7 == 0 else "") for i in range(3000)]
    encoder = token_files.Encoder(tokenizer_path("word_bpe_49k.json"))
    for k in range(0, len(texts), 100):
        got = [np.frombuffer(b, "<u2").tolist() for b in encoder.encode(texts[k : k + 100])]
        assert got == [e.ids for e in library.encode_batch(texts[k : k + 100], add_special_tokens=False)]


def test_words_with_signs_ask_the_library_for_stems_only(monkeypatch):
    asked, found = [], token_files._library

    class Counting:
        def __init__(self, path):
            self.library = found(path)

        def __getattr__(self, name):
            return getattr(self.library, name)

        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return self.library.encode_batch_fast(texts, **options)

    monkeypatch.setattr(token_files, "_library", Counting)
    encoder = token_files.Encoder(tokenizer_path("word_bpe_49k.json"))
    words = [a + b + c for a in "abcdefgh" for b in "aeioué" for c in "lmnrst"]
    texts = [" ".join(w + sign for w in words) for sign in ("", ".", "***", ".$$$", "?!")]
    encoder.encode([*texts, *(t.upper() for t in texts if "É" not in t.upper())])
    assert len(asked) < 10 and sum(len(t.split()) for t in asked) < len(words) + 10
    asked.clear()
    encoder.encode(texts)
    assert sum(len(t.split()) for t in asked) < 10


def test_columns_of_odd_pieces_equal_the_library(library, monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_ENTRIES", 200)
    rng = random.Random(2)
    bits = ["word", "Éa", "aé", "ÀÞ", "J", "I", "'s", "'", "’", ".", ",,", "***", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "^`~\\[]-", "1", "²", "ª", "İ", "ſ", "×÷", "\u030c", "\u0307", "\u0301", "\u00a0", "\u2003", "\u200b", "\x1c", "\x1f", "\x85", "\x00", "日本", "🙂"]
    bits += [" ", " ", " ", "\t", "\n", "\r", "\x0b", "\x0c"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(4000)] + [None, "", " \x0b", "x" * 3000, "y" * 70 + " z", "y" * 70]
    rng.shuffle(texts)
    encoder, end = token_files.Encoder(tokenizer_path("word_bpe_49k.json")), np.array([1], "<u2").tobytes()
    for kind in (pa.string(), pa.large_string()):
        for k in range(0, len(texts), 400):
            some = pa.array([None, *texts[k : k + 400]], kind).slice(1)
            flat, sizes = encoder.encode_column(some, end)
            got = [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]
            assert got == [encoded(library, t) for t in some.to_pylist()]
            assert len(encoder.names) == len(encoder.ids) and max(map(len, encoder.names.to_pylist())) <= token_files.CACHED_CHARS
    flat, sizes = encoder.encode_column(pa.array([], pa.string()), end)
    assert len(flat) == len(sizes) == 0


def test_small_batches_are_joined_and_large_ones_cut(monkeypatch):
    monkeypatch.setattr(token_files, "SLICE", 1000)
    sizes = [0, 1, 2, None, 5, 3000, 1, 400, 400, 400, 0, 999, 7] * 20
    rows = pa.record_batch({"id": pa.array(range(len(sizes))), "text": pa.array([None if n is None else "é" * (n // 2) for n in sizes])})
    given = [rows.slice(i, 3) for i in range(0, len(sizes), 3)]
    found = list(token_files._portions(iter(given)))
    assert pa.Table.from_batches(found).equals(pa.Table.from_batches(given))
    assert len(found) < len(list(text_slices(iter(given), chars=1000))) and all(b.nbytes <= 1000 or b.num_rows <= 3 for b in found)
    assert len(list(token_files._portions(rows.slice(0, 1) for _ in range(50)))) == 1
    assert list(token_files._portions(iter([]))) == []


def test_token_files_of_an_empty_table_and_of_odd_lengths(spark, docs):
    path = tokenizer_path("word_bpe_49k.json")
    manifest = token_files.write_sequences(docs.limit(0), path)
    assert manifest.count() == 0 and token_files.read_documents(spark, manifest).count() == 0
    with pytest.raises(ValueError):
        token_files.write_sequences(docs, path, length=10)


def test_registered_token_files(spark, library):
    rows = QUERIES["op11_token_files"](spark, "/root/testdata/sf0.001").collect()
    at = 0
    for r, d in zip(sorted(rows, key=lambda r: r.doc_id), sorted(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect(), key=lambda d: d.doc_id), strict=True):
        ids = encoded(library, d.text)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


# Spelling variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(counts, ratio=2):
    out = {}
    for w, n in counts.items():
        found = [x for x in counts if near(x, w)]
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        fits = best is not None and counts[best] >= ratio * n
        out[w] = (n, len(found), best if fits else None, counts[best] if fits else None)
    roots = {}
    for w in out:
        at = w
        while out[at][2]:
            at = out[at][2]
        roots[w] = at
    return {w: (*x, roots[w]) for w, x in out.items()}


def test_trie_finds_each_neighbour_once():
    rng = random.Random(2)
    for _ in range(60):
        words = sorted({"".join(rng.choice("aabé") for _ in range(rng.randint(1, 6))) for _ in range(40)})
        trie = variants.Trie.unpack(*variants.Trie.build(words, list(range(1, len(words) + 1))).pack())
        for w in [*words, "", "c", "abcab", "a" * 300]:
            assert sorted(trie.neighbours(w)) == sorted((x, words.index(x) + 1) for x in words if near(x, w))


@pytest.mark.parametrize("shard,size", [(200_000, 32_000_000), (7, 2_000), (1, 1)])
def test_variants_in_any_number_of_shards_and_rounds(spark, parts, shard, size):
    rng = random.Random(3)
    counts = {"".join(rng.choice("abcø") for _ in range(rng.randint(2, 5))): rng.choice([1, 2, 3, 4, 8, 9, 17, 40]) for _ in range(90 if shard > 1 else 12)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in variants.group_variants(df, min_chars=1, min_count=1, shard_words=shard, round_bytes=size).collect()}
    assert got == grouped(counts)


def test_word_counts_of_odd_texts(spark, docs):
    got = {r.word: r.n for r in variants.word_counts(docs).collect()}
    want = Counter()
    for _, t in TEXTS:
        want.update("".join(c.lower() if c.isascii() else c for c in w) for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""))
    assert got == want
    assert variants.group_variants(variants.word_counts(docs.limit(0))).count() == 0
    with pytest.raises(ValueError):
        variants.group_variants(variants.word_counts(docs), ratio=1)


def test_chains_of_forms_end_at_their_last(spark):
    counts = {"aaaaa": 2, "aaaab": 4, "aaabb": 8, "aabbb": 16, "abbbb": 32, "bbbbb": 64, "zzzzz": 3}
    got = {r.word: r.root for r in variants.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long"), min_count=1).collect()}
    assert got == {w: "bbbbb" if w != "zzzzz" else w for w in counts}


# Conversations

TURNS = "conv_id long, turn int, role string, text string, id string, parent string, n_convs string"


def plain_trie(convs, words):
    """Nodes of {id: tuple of turns} by enumerating prefixes; words: of a turn."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = []

    def below(p):
        kids = [below(k) for k in children.get(p, [])]
        own = (len(members[p]) - 1) * (words(p[-1]) if p else 0)
        leaves, saved = sum(k[0] for k in kids) or 1, own + sum(k[1] for k in kids)
        ends = ",".join(str(c) for c in sorted(members[p]) if convs[c] == p)
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if members:
        below(())
    return sorted(out, key=repr)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("tasks,piece", [(1, 8192), (4, 8192), (13, 2)])
def test_trie_across_tasks(spark, parts, tasks, piece):
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        rng = random.Random(6)
        convs = {i: tuple(("user", rng.choice(["a b", "c", "", "d e f"])) for _ in range(rng.randint(1, 5))) for i in range(120)}
        convs |= {i: (("user", "hot one"), ("user", "again")) for i in range(200, 260)}
        convs |= {300 + i: tuple(("user", "long") for _ in range(40 + i)) for i in range(3)}
        rows = [(c, d, r, t, "x", "y", "z") for c, turns in convs.items() for d, (r, t) in enumerate(turns)]
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, TURNS).repartition(5)
        got = conversation_trie.prefix_trie(conversation_trie.turn_arrays(df), piece)
        assert sorted((tuple(r[c] for c in NODE) for r in got.collect()), key=repr) == plain_trie(convs, lambda t: len(t[1].split()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_trie_of_odd_turns(spark):
    rows = [(1, None, None, None), (1, 2, "u", "x  y"), (1, 2, "u", "x  y"), (2, 1, "", ""), (None, 1, "u", "lost"), (3, 5, "u", "w" * 100_000)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], TURNS)
    convs = {1: (("", ""), ("u", "x  y"), ("u", "x  y")), 2: (("", ""),), 3: (("u", "w" * 100_000),)}
    got = conversation_trie.prefix_trie(conversation_trie.turn_arrays(df))
    assert sorted((tuple(r[c] for c in NODE) for r in got.collect()), key=repr) == plain_trie(convs, lambda t: len(t[1].split()))
    assert conversation_trie.prefix_trie(conversation_trie.turn_arrays(df.limit(0))).count() == 0


def test_rebuilt_conversations(spark):
    given = {c: [f"{c}.{i}" for i in range(n)] for c, n in [(0, 5), (1, 1), (2, 4), (7, 2), (19, 3), (21, 6), (25, 1), (40, 1), (41, 3), (59, 2)]}
    arrays = spark.createDataFrame([(c, [(t, 1) for t in v]) for c, v in given.items()], "conv_id long, turns array<struct<digest: string, words: int>>")
    want = {}
    for c, v in given.items():
        h = zlib.crc32(str(c).encode()) % 4
        want[c] = given.get(c - c % 20, [])[:h] + v[h:]
    assert {r.conv_id: [t.digest for t in r.turns] for r in rebuilt(arrays).collect()} == want


def test_registered_trie_in_many_tasks(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        one = QUERIES["op13_conversation_trie"](spark, "/root/testdata/sf0.01")
        spread = sorted(map(tuple, one.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert spread == sorted(map(tuple, QUERIES["op13_conversation_trie"](spark, "/root/testdata/sf0.01").collect()), key=repr)
    assert len(spread) > 100
