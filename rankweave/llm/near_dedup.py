"""Near-duplicate groups: MinHash candidates, Bayesian pruning, exact links.

Two documents are linked where the Jaccard similarity of their shingle sets
reaches the threshold; a group is a connected component of links.

1. Each text gets a sketch: its set's size and digest, and MinHash values.
   Documents with equal sets become one numbered representative.
2. Representatives meet in buckets of banded MinHash values.  Enough bands are
   taken that a pair at the threshold is missed with probability
   ``miss_probability`` at most.  In each bucket, the least representative is the
   centre, and all others are its star; pairs within a bucket are not listed.
3. A star's pairs with its centre are compared by batches of MinHash values.
   After each batch a pair is dropped if the posterior probability that its
   similarity reaches the threshold is under ``prune_probability``.  What is left
   is verified on the full sets.  Every representative first meets one of its
   centres; with others, it is compared only where the two are not in one
   component by then.
4. Members not linked with their centre are compared with the star's members in
   blocks of bounded size, by the same steps.  A member whose similarity to the
   centre cannot reach ``1 - 2 * (1 - threshold)`` is too far from all documents
   linked with the centre (the Jaccard distance is a metric), so it is only
   compared with members that are not known to be linked with the centre.
5. Links are closed to components by alternating minimum-neighbour steps over
   tables in the shared folder.

Tables that are no longer needed are deleted on the way; two stay, which the
result is read from.

Defined results: null texts and texts without words have an empty set, are
linked with nothing and are their own group; rows with a null id take part, and
a group of null ids only has a null component; repeated rows are one document's
rows, all with the same result; a very long text has one set like any other; an
empty table gives an empty one; ids are taken as long (one that is not a number
counts as null); other columns are not kept, so that none can clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.common import discard, materialize, text_slices
from rankweave.llm.wordhash import mix, shingles

BATCH = 25
#: At most so many rows are broadcast: ids, or pairs of two numbers, about 70 bytes each there.
MAX_LISTED = 500_000
_SKETCH = "id long, n_shingles long, digest binary, sketch binary"


def bands_needed(threshold: float, rows: int, miss_probability: float) -> int:
    """Bands of ``rows`` values, so that a pair at the threshold shares none with at most this probability."""
    return math.ceil(math.log(miss_probability) / math.log1p(-(threshold**rows)))


@lru_cache(maxsize=4)
def _hashers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.RandomState(611)
    return tuple(rng.randint(1, 2**63 - 1, size=n, dtype=np.int64).astype(np.uint64) | np.uint64(1) for _ in range(2))


def sketch(shingle_set: np.ndarray, n: int) -> np.ndarray:
    """The least values of ``n`` hash functions over a set, in 16 bits each.

    Values that differ agree in 16 bits once in 65,536 times, which can only keep a pair longer.
    """
    a, b = _hashers(n)
    least = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(shingle_set), 1024):
        part = shingle_set[start : start + 1024, None] * a
        part += b
        np.minimum(least, part.min(axis=0), out=least)
    return (least >> np.uint64(48)).astype(np.uint16)


def digest(shingle_set: np.ndarray) -> bytes:
    """Equal for equal sets: size and two independent sums of mixed values."""
    one = np.add.reduce(mix(shingle_set ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)
    two = np.add.reduce(mix(shingle_set + np.uint64(0x0123456789ABCDEF)), dtype=np.uint64)
    return np.array([len(shingle_set), one, two], dtype=np.uint64).tobytes()


def sketches(docs: DataFrame, size: int, n_hashes: int, text: str = "text", key: str = "doc_id", hashed: bool = False) -> DataFrame:
    """(id, n_shingles, digest, sketch) for each row; null digest and sketch for an empty set.

    ``hashed`` adds ``text_hash``, the text's xxhash64.
    """
    more = [F.xxhash64(F.col(f"`{text}`")).alias("text_hash")] if hashed else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            counts, digests, values = [], [], []
            for t in batch.column(1).to_pylist():
                s = shingles(t, size)
                counts.append(len(s))
                digests.append(digest(s) if len(s) else None)
                values.append(sketch(s, n_hashes).tobytes() if len(s) else None)
            names = ["id", "n_shingles", "digest", "sketch", *batch.schema.names[2:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(values, pa.binary()), *batch.columns[2:]], names=names)

    return docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"), *more).mapInArrow(run, _SKETCH + (", text_hash long" if hashed else ""))


def _sets(docs: DataFrame, size: int, text: str, key: str) -> DataFrame:
    """(id, digest, members): full shingle sets as sorted 64-bit values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sets = [shingles(t, size) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "digest", "members"])

    return docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "id long, digest binary, members binary")


@lru_cache(maxsize=64)
def fewest_matches(compared: int, threshold: float, prune_probability: float) -> int:
    """The fewest equal values among ``compared`` at which a pair stays.

    With a uniform prior, the similarity's posterior after m of n matches is
    Beta(m + 1, n - m + 1); its tail above the threshold is a binomial sum.
    """
    n = compared
    for m in range(n + 1):
        tail = sum(math.comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(m + 1))
        if tail >= prune_probability:
            return m
    return n + 1


def surviving(a: np.ndarray, b: np.ndarray, threshold: float, prune_probability: float) -> np.ndarray:
    """Which rows of two sketch matrices survive the sequential comparison."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), dtype=np.int32)
    for start in range(0, a.shape[1], BATCH):
        stop = min(start + BATCH, a.shape[1])
        matches[alive] += (a[alive, start:stop] == b[alive, start:stop]).sum(axis=1)
        alive = alive[matches[alive] >= fewest_matches(stop, threshold, prune_probability)]
    out = np.zeros(len(a), dtype=bool)
    out[alive] = True
    return out


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two full sets reach the threshold, in whole numbers."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=np.uint16).reshape(len(values), -1)


def _judge_centres(pairs: DataFrame, percent: int, prune: float) -> DataFrame:
    """Decide each (centre, member) pair: verdict Y linked, N near, F far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.slice(start, 512)
                get = lambda name, part=part: part.column(part.schema.get_field_index(name))
                a, b = _matrix(get("centre_sketch")), _matrix(get("sketch"))
                close = surviving(a, b, percent / 100, prune)
                near = surviving(a, b, max(0.0, 2 * percent / 100 - 1), prune)
                left, right = get("centre_members"), get("members")
                verdicts = []
                for i in range(len(part)):
                    if close[i] and linked(np.frombuffer(left[i].as_py(), np.uint64), np.frombuffer(right[i].as_py(), np.uint64), percent):
                        verdicts.append("Y")
                    else:
                        verdicts.append("N" if near[i] else "F")
                yield pa.RecordBatch.from_arrays([get("centre"), get("rep"), pa.array(verdicts)], names=["centre", "rep", "verdict"])

    return pairs.mapInArrow(run, "centre long, rep long, verdict string")


def _judge_blocks(pairs: DataFrame, percent: int, prune: float) -> DataFrame:
    """Links between the members of two blocks: a forest of components for each pair of blocks.

    Each block is an array of (rep, component, sketch, members); members of one
    component aren't compared, and more than one link between the same two
    components adds nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                one, two = row["one"], row["two"] or row["one"]
                left, right = np.array([m["rep"] for m in one]), np.array([m["rep"] for m in two])
                parts_a, parts_b = np.array([m["component"] for m in one]), np.array([m["component"] for m in two])
                a = np.frombuffer(b"".join(m["sketch"] for m in one), np.uint16).reshape(len(one), -1)
                b = np.frombuffer(b"".join(m["sketch"] for m in two), np.uint16).reshape(len(two), -1)
                x, y = (g.ravel() for g in np.meshgrid(np.arange(len(one)), np.arange(len(two)), indexing="ij"))
                if row["two"] is None:
                    x, y = x[left[x] < right[y]], y[left[x] < right[y]]
                apart = parts_a[x] != parts_b[y]
                x, y = x[apart], y[apart]
                alive = surviving(a[x], b[y], percent / 100, prune)
                sets_a, sets_b = [np.frombuffer(m["members"], np.uint64) for m in one], [np.frombuffer(m["members"], np.uint64) for m in two]
                root: dict[int, int] = {}

                def find(v: int, root=root) -> int:
                    while root.setdefault(v, v) != v:
                        root[v] = root[root[v]]
                        v = root[v]
                    return v

                links = []
                for p, q in zip(x[alive].tolist(), y[alive].tolist()):
                    u, v = find(int(parts_a[p])), find(int(parts_b[q]))
                    if u != v and linked(sets_a[p], sets_b[q], percent):
                        root[max(u, v)] = min(u, v)
                        links.append((int(left[p]), int(right[q])))
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in links], pa.int64()), pa.array([v for _, v in links], pa.int64())], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node of each connected component of links (a, b).

    Every round takes the least label in each node's neighbourhood and then
    the label's own label; tables go to the shared folder, so a lost executor
    costs no more than a round.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = materialize(both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    while True:
        around = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("least"))
        step = labels.join(around, "node").select("node", F.least("component", "least").alias("component"), F.col("component").alias("before"))
        step = materialize(step, "labels-step")
        up = step.select(F.col("node").alias("component"), F.col("component").alias("higher"))
        jumped = step.join(up, "component", "left").select("node", F.coalesce("higher", "component").alias("component"), "before")
        jumped = materialize(jumped, "labels")
        discard(labels, step)
        labels = jumped.select("node", "component")
        if not jumped.where("component != before").limit(1).count():
            discard(both)
            return labels


def _small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it has ``MAX_LISTED`` rows at most."""
    return F.broadcast(df) if df.limit(MAX_LISTED + 1).count() <= MAX_LISTED else df


def near_duplicates(
    docs: DataFrame,
    shingle_words: int = 5,
    percent: int = 80,
    text: str = "text",
    key: str = "doc_id",
    band_rows: int = 5,
    miss_probability: float = 1e-5,
    prune_probability: float = 1e-6,
    block: int = 64,
    hashed: bool = False,
) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row of ``docs``.

    ``percent`` is the least similarity in hundredths.  ``component_id`` is the
    least id reachable over links, and a row is kept if that is its own.
    ``hashed`` adds ``text_hash`` and ``group``, which tells components of null
    or clashing ids apart and is null for empty sets and rows without a link.
    """
    threshold = percent / 100
    bands = bands_needed(threshold, band_rows, miss_probability)
    n_hashes = -(-bands * band_rows // BATCH) * BATCH
    base = materialize(sketches(docs, shingle_words, n_hashes, text, key, hashed), "sketches")

    # Rows with equal sets are one representative.
    whole = base.where("digest is not null").groupBy("digest").agg(F.min("id").alias("least_id"), F.count("*").alias("rows"), F.min("sketch").alias("sketch"))
    reps = materialize(whole.withColumn("rep", F.monotonically_increasing_id()), "representatives")
    keys = F.array(*[F.xxhash64(F.lit(j), F.substring("sketch", 2 * band_rows * j + 1, 2 * band_rows)) for j in range(bands)])
    banded = reps.select("rep", F.explode(keys).alias("bucket"))
    centres = banded.groupBy("bucket").agg(F.min("rep").alias("centre"), F.count("*").alias("n")).where("n > 1").select("bucket", "centre")
    stars = materialize(banded.join(centres, "bucket").where("rep != centre").select("centre", "rep").distinct(), "stars")
    body = _bodies(docs, stars, reps, shingle_words, text, key)

    judged = _judge(stars.groupBy("rep").agg(F.min("centre").alias("centre")), body, percent, prune_probability)
    labels = components(judged.where("verdict = 'Y'").select(F.col("centre").alias("a"), F.col("rep").alias("b")))
    placed = _placed(stars, judged, labels)
    # Centres of other components; then, where a star has a member far from its centre, all that is not judged yet.
    for wanted in ("verdict is null and not same", "verdict is null and far"):
        far = placed.where("verdict = 'F'").select("centre").distinct().withColumn("far", F.lit(True))
        more = placed.join(far, "centre", "left").where(wanted).select("centre", "rep")
        if not more.limit(1).count():
            continue
        more = _judge(materialize(more, "star-pairs"), body, percent, prune_probability)
        judged = judged.union(more)
        links = more.where("verdict = 'Y'").select(F.col("centre").alias("a"), F.col("rep").alias("b"))
        labels = components(links.union(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        discard(placed)
        placed = _placed(stars, judged, labels)
    links = _open_links(placed, body, percent, prune_probability, block)
    if links is not None:
        labels = components(links.union(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    out = _result(base, reps, labels, key)
    discard(stars, body, judged, placed, labels, reps, *([links] if links is not None else []))
    return out


def _bodies(docs: DataFrame, stars: DataFrame, reps: DataFrame, size: int, text: str, key: str) -> DataFrame:
    """(rep, sketch, members) of the representatives that stand in some star; sets are made of the texts anew."""
    wanted = stars.select("rep").union(stars.select(F.col("centre").alias("rep"))).distinct()
    short = materialize(reps.join(_small(wanted), "rep").select("rep", "digest", "least_id", "sketch"), "wanted")
    texts = docs.select(F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{text}`").alias("text"))
    texts = texts.join(_small(short.select(F.col("least_id").alias("id")).distinct()), F.col("_id").eqNullSafe(F.col("id")), "left_semi")
    full = _sets(texts, size, "text", "_id").groupBy("digest").agg(F.max("members").alias("members"))
    body = materialize(short.join(full, "digest").select("rep", "sketch", "members"), "bodies")
    discard(short)
    return body


def _judge(pairs: DataFrame, body: DataFrame, percent: int, prune: float) -> DataFrame:
    """(centre, rep, verdict) of pairs (centre, rep)."""
    ours = body.select("rep", "sketch", "members").join(_small(pairs), "rep")
    theirs = body.join(_small(pairs.select(F.col("centre").alias("rep")).distinct()), "rep", "left_semi")
    theirs = theirs.select(F.col("rep").alias("centre"), F.col("sketch").alias("centre_sketch"), F.col("members").alias("centre_members"))
    both = ours.join(theirs, "centre").select("centre", "rep", "sketch", "members", "centre_sketch", "centre_members")
    return materialize(_judge_centres(both, percent, prune), "judged")


def _placed(stars: DataFrame, judged: DataFrame, labels: DataFrame) -> DataFrame:
    """Stars with each member's verdict, if there is one, and whether it is in the centre's component."""
    of = lambda name: labels.select(F.col("node").alias(name), F.col("component").alias(f"{name}_component"))
    out = stars.join(judged, ["centre", "rep"], "left").join(of("rep"), "rep", "left").join(of("centre"), "centre", "left")
    own = F.coalesce("rep_component", "rep")
    same = own == F.coalesce("centre_component", "centre")
    return materialize(out.select("centre", "rep", "verdict", own.alias("component"), same.alias("same")), "placed")


def _open_links(placed: DataFrame, body: DataFrame, percent: int, prune: float, block: int) -> DataFrame | None:
    """Links that stars leave open: between members not linked with their centre and others.

    Kinds of a star's members: 0 near and 1 far from the centre, both outside of
    its component; 2 in its component, by other links as far as is known; 3 linked
    with the centre.  Which kinds can still add links: 0 and 1 among themselves,
    both with 2, and 0 with 3.
    """
    kind = F.when(F.col("verdict") == "Y", 3).when(F.col("same"), 2).when(F.col("verdict") == "N", 0).otherwise(1)
    kinds = placed.select("centre", "rep", "component", kind.alias("kind"))
    sizes = kinds.groupBy("centre").agg(*[F.count_if(F.col("kind") == k).alias(f"n{k}") for k in range(4)])
    open_stars = materialize(sizes.where("n0 + n1 > 1 or (n0 > 0 and n2 + n3 > 0) or (n1 > 0 and n2 > 0)"), "open-stars")
    if not open_stars.limit(1).count():
        return None
    members = kinds.join(open_stars, "centre")
    count = F.get(F.array("n0", "n1", "n2", "n3"), F.col("kind"))
    dealt = members.where("kind < 3 or n0 > 0").select("centre", "rep", "component", "kind", F.pmod(F.xxhash64("rep"), F.ceil(count / F.lit(block))).cast("int").alias("block"))
    blocks = dealt.join(body, "rep").groupBy("centre", "kind", "block").agg(F.collect_list(F.struct("rep", "component", "sketch", "members")).alias("rows"), F.min("component").alias("least"), F.max("component").alias("most"))  # about ``block`` rows each
    blocks = materialize(blocks, "blocks")
    # Which blocks meet is settled by their numbers; the rows come by (centre, kind, block), so no star is one key.
    one = blocks.select("centre", F.col("kind").alias("kind1"), F.col("block").alias("block1"), F.col("least").alias("least1"), F.col("most").alias("most1"))
    two = blocks.select("centre", F.col("kind").alias("kind2"), F.col("block").alias("block2"), F.col("least").alias("least2"), F.col("most").alias("most2"))
    meet = "(kind1 < 2 and kind2 < 2 and (kind1 < kind2 or kind1 = kind2 and block1 <= block2)) or (kind1 < 2 and kind2 = 2) or (kind1 = 0 and kind2 = 3)"
    numbers = materialize(one.join(two, "centre").where(meet).where("least(least1, least2) < greatest(most1, most2)").drop("least1", "least2", "most1", "most2"), "block-pairs")
    itself = (F.col("kind1") == F.col("kind2")) & (F.col("block1") == F.col("block2"))
    rows = lambda n: blocks.select("centre", F.col("kind").alias(f"kind{n}"), F.col("block").alias(f"block{n}"), F.col("rows").alias(f"rows{n}"))
    pairs = numbers.join(rows(1), ["centre", "kind1", "block1"]).join(rows(2), ["centre", "kind2", "block2"])
    found = materialize(_judge_blocks(pairs.select(F.col("rows1").alias("one"), F.when(~itself, F.col("rows2")).alias("two")), percent, prune), "open-links")
    discard(open_stars, blocks, numbers)
    return found


def _result(base: DataFrame, reps: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Component ids are the least document ids: settled for representatives, then joined to all rows by the set's digest."""
    named = reps.select("rep", "digest", "least_id", "rows").join(labels, F.col("rep") == F.col("node"), "left").where("rows > 1 or component is not null")
    named = materialize(named.select("digest", "least_id", F.coalesce("component", "rep").alias("group")), "named-sets")
    least = materialize(named.groupBy("group").agg(F.min("least_id").alias("least")), "least-ids")
    groups = materialize(named.join(least, "group").select("digest", "group", "least"), "groups")
    discard(named, least)
    more = ["text_hash"] if "text_hash" in base.columns else []
    rows = base.select("id", "n_shingles", "digest", *more).join(groups, "digest", "left")
    out = rows.select(F.col("id").alias(key), "n_shingles", F.when(F.col("group").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"), *([*more, "group"] if more else []))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
