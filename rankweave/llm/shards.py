"""Sharding by Karmarkar-Karp differencing.

Rows with equal texts form a group that always stays together.  Differencing
starts from one partial partition for each group (its size in one place, nothing
in the others) and repeatedly takes the two partial partitions with the largest
spread and adds them up in opposite order, until one is left.

Groups are dealt into buckets by hash, and within a bucket into portions of a half,
a quarter and so on of it; each portion is differenced by a task of its own.  What
comes to lie in its places are items for the next round, each of which may go to
any place there; rounds of bounded fan-in follow until one is left.  As items
come in sizes that halve, there are always small ones to even out large ones.  Groups larger than ``heavy_share`` of a fair shard skip the buckets and are
items of the last round, where they can be weighed against all else.  A group
larger than a fair shard fills a place of its own, and the rest is spread evenly.

Defined results: a null text counts as empty and is one group with empty texts;
rows with a null or repeated id are placed like any other; a very long text is
one group, however large; equal sizes are told apart by the text's hash, and
slots follow id, hash and size, so a table always gives the same result (but for
the order among rows that agree in id and text); an empty table gives an empty
one; other columns are not kept, so that none can clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.common import discard, materialize


def difference(partitions: Sequence[Sequence[int]]) -> tuple[list[int], list[list[int]]]:
    """Combine partial partitions by largest differencing.

    Returns the sums of the final partition, ascending, and for each input the
    place in which each of its places ended.
    """
    if not partitions:
        return [], []
    k = len(partitions[0])
    heap, members = [], {}
    for i, sums in enumerate(partitions):
        order = sorted(range(k), key=lambda j: sums[j])
        members[i] = [[(i, j)] for j in order]
        heap.append((sums[order[0]] - sums[order[-1]], i, [sums[j] for j in order]))
    heapq.heapify(heap)
    fresh = len(partitions)
    while len(heap) > 1:
        _, a, low = heapq.heappop(heap)
        _, b, high = heapq.heappop(heap)
        joined = [(low[j] + high[k - 1 - j], j) for j in range(k)]
        joined.sort()
        parts_a, parts_b = members.pop(a), members.pop(b)
        merged = []
        for _, j in joined:
            one, two = parts_a[j], parts_b[k - 1 - j]
            if len(one) < len(two):
                one, two = two, one
            one.extend(two)
            merged.append(one)
        members[fresh] = merged
        sums = [s for s, _ in joined]
        heapq.heappush(heap, (sums[0] - sums[-1], fresh, sums))
        fresh += 1
    _, last, sums = heap[0]
    places = [[0] * k for _ in partitions]
    for place, part in enumerate(members[last]):
        for i, j in part:
            places[i][j] = place
    return sums, places


def difference_sizes(sizes: Sequence[int], k: int) -> tuple[list[int], list[int]]:
    """Differencing of single sizes: final sums, and the place of each size."""
    sums, places = difference([[int(s)] + [0] * (k - 1) for s in sizes])
    return (sums or [0] * k), [p[0] for p in places]


def group_key(text: Column) -> Column:
    """Equal texts and only they share this."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def assign(docs: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id", groups_per_bucket: int = 20_000, fan_in: int = 256, heavy_share: float = 1 / 64) -> DataFrame:
    """(key, size, text_crc32, shard, slot) for every row; shards are balanced by bytes.

    ``size`` is the text's UTF-8 bytes plus 1.  Slots number a shard's rows
    from 0 without gaps.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = materialize(
        docs.select(F.col(f"`{key}`").alias("id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.unhex(group_key(F.col(f"`{text}`"))).alias("group")),
        "shard-rows",
    )
    groups = materialize(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-groups")
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    heavy = F.col("bytes") > int(total.bytes / shards * heavy_share)
    buckets = max(1, -(-total.n // groups_per_bucket), min(64, -(-total.n // 500)))
    placed = materialize(_local(groups.where(~heavy), buckets, shards), "shard-local")
    place_of, single = _combine(placed, groups.where(heavy), shards, fan_in)
    light = placed.join(F.broadcast(place_of), ["bucket", "place"]).select("group", "shard")  # a row for each place of a bucket
    final = materialize(light.unionByName(single), "shard-of-group")
    discard(groups, placed)
    dealt = rows.join(final, "group")
    return _slots(dealt, max(64, min(1 << 16, -(-total.rows // 500_000)))).select(F.col("id").alias(key), "size", "text_crc32", "shard", "slot")


#: Portions of a bucket.
PORTIONS = 8


def _local(groups: DataFrame, buckets: int, shards: int) -> DataFrame:
    """Differencing in each portion of a bucket: (group, bucket, bytes, place), where ``bucket`` numbers portions."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("group", ignore_index=True)  # the same order on every attempt
        _, places = difference_sizes(pdf["bytes"].tolist(), shards)
        return pdf.assign(place=places)[["group", "bucket", "bytes", "place"]]

    h = F.xxhash64("group", F.lit(1))
    portion = F.least(F.bit_count(h.bitwiseXOR(h - 1)) - 1, F.lit(PORTIONS - 1))  # zeros at the hash's end
    bucket = F.pmod(F.xxhash64("group"), F.lit(buckets)).cast("int") * PORTIONS + portion
    dealt = groups.select("group", bucket.cast("int").alias("bucket"), "bytes")
    return dealt.groupBy("bucket").applyInPandas(run, "group binary, bucket int, bytes long, place int")


def _combine(placed: DataFrame, heavy: DataFrame, shards: int, fan_in: int) -> tuple[DataFrame, DataFrame]:
    """(bucket, place, shard) for each place of each bucket, and (group, shard) for each heavy group.

    Rounds that difference the places of at most ``fan_in`` buckets at a time, as
    single items, by portion until the last; the heavy groups, at most ``shards / heavy_share``, are in the last.
    """
    level = placed.groupBy(F.col("bucket").alias("node"), "place").agg(F.sum("bytes").alias("bytes"))
    level = materialize(level.select("node", "place", "bytes"), "shard-level")
    chain = level.select(F.col("node").alias("bucket"), "place", F.col("node").alias("at"), F.col("place").alias("at_place"))
    schema = "node int, place int, group binary, bytes long, parent int, to int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["node", "place", "group"], ignore_index=True)
        return pdf.assign(to=difference_sizes(pdf["bytes"].tolist(), shards)[1])

    while True:
        count = level.agg(F.coalesce(F.max("node"), F.lit(-1)).alias("n")).first().n // PORTIONS + 1
        last = count <= fan_in
        items = level.withColumn("group", F.lit(None).cast("binary"))
        if last:
            items = items.unionByName(heavy.select(F.lit(-1).alias("node"), F.lit(-1).alias("place"), "bytes", "group"))
        parent = F.lit(0) if last else (F.floor(F.col("node") / (PORTIONS * fan_in)) * PORTIONS + F.col("node") % PORTIONS).cast("int")
        done = items.select("node", "place", "group", "bytes", parent.alias("parent")).groupBy("parent").applyInPandas(run, schema)
        done = materialize(done, "shard-level")
        step = done.where("group is null").select(F.col("node").alias("at"), F.col("place").alias("at_place"), "parent", "to")
        chain = chain.join(step, ["at", "at_place"]).select("bucket", "place", F.col("parent").alias("at"), F.col("to").alias("at_place"))
        if last:
            return chain.select("bucket", "place", F.col("at_place").alias("shard")), done.where("group is not null").select("group", F.col("to").alias("shard"))
        level = done.groupBy(F.col("parent").alias("node"), F.col("to").alias("place")).agg(F.sum("bytes").alias("bytes"))


def _slots(dealt: DataFrame, chunks: int) -> DataFrame:
    """Number each shard's rows from 0: within chunks by hash, after the rows of earlier chunks."""
    dealt = materialize(dealt.withColumn("chunk", F.pmod(F.xxhash64("id", "group"), F.lit(chunks)).cast("int")), "shard-dealt")
    counts = dealt.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "chunk", before.alias("before"))  # shards x chunks rows
    number = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("id", "group", "size"))
    return dealt.withColumn("number", number).join(F.broadcast(offsets), ["shard", "chunk"]).withColumn("slot", F.col("before") + F.col("number") - 1)
