"""The registered queries of operators 3, 4 and 7 to 10 over the smallest tables, against plain Python."""

import hashlib
import re
import zlib
from collections import Counter

import pytest

from rankweave.llm.queries import QUERIES, tokenizer_path

pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def result(spark):
    made = {}
    return lambda name: made[name] if name in made else made.setdefault(name, QUERIES[name](spark, DATA).collect())


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def test_quality_base_columns(docs, result):
    got = {r.doc_id: r for r in result("op3_quality_rules")}
    assert got.keys() == docs.keys()
    for i, t in docs.items():
        w, r = words(t), got[i]
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        repeated = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [line for line in t.split("\n") if words(line)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(w) < 20 or 100 * len(repeated) > 30 * len(w)) and not (r.base_failed and r.kept)


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def test_url_verdicts(spark, result):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = {r.page_id: r for r in result("op4_url_filters")}
    assert got.keys() == pages.keys()
    for i, url in pages.items():
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best and best[1] + best[2])
        assert got[i].verdict in ("allow", "block") and (best is None or got[i].verdict == best[0])


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_spans(t):
    """(start, kind number, end) of the three fixed patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def test_secret_spans(docs, result):
    kinds = ("assign", "access", "hex")
    got = {r.doc_id: r for r in result("op7_secret_scan")}
    assert got.keys() == docs.keys()
    for i, t in docs.items():
        spans = base_spans(t)
        text = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(s[1] == k for s in spans) for k in range(3)]
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(got[i].spans.split(","))


def test_token_counts(docs, result):
    library = tokenizers.Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in result("op8_token_counts")}
    want = {i: (len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in docs.items()}
    assert got == {i: (b, n, n > 2048) for i, (b, n) in want.items()}


def test_toxicity_columns(docs, result):
    got = {r.doc_id: r for r in result("op9_toxicity")}
    assert got.keys() == docs.keys()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    by_text = {}
    for i, t in docs.items():
        by_text.setdefault(t, set()).add(round(got[i].score, 9))
    assert all(len(s) == 1 for s in by_text.values())  # a score depends on the text alone


def test_shards_are_even_gapless_and_keep_equal_texts(docs, result):
    rows = result("op10_sharding")
    assert sorted(r.doc_id for r in rows) == sorted(docs) and {r.law for r in rows} == {"bytes"}
    slots, bytes_of, where = {}, Counter(), {}
    for r in rows:
        t = docs[r.doc_id]
        assert (r.size, r.text_crc32, r.grown_shard) == (len(t.encode()) + 1, zlib.crc32(t.encode()), None)
        slots.setdefault(r.shard, []).append(r.slot)
        bytes_of[r.shard] += r.size
        where.setdefault(t, set()).add(r.shard)
    assert set(slots) <= set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in where.values()) and max(bytes_of.values()) - min(bytes_of.values()) <= 0.02 * sum(bytes_of.values())
