"""Connected components, and merging records that share any of several keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.operators.shared import discard, materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step of the alternating star method over (u, v) edges.

    Each node sends neighbours to the smallest of itself and its neighbours: the
    greater ones in a large step, itself and the smaller ones in a small step.
    The smallest is found by an aggregation, before any join, and edges meet it by
    a plain join on the node, which adaptive execution splits where a node is hot.
    """
    both = edges.union(edges.select("v", "u")) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = both.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that each node of an edge is connected with.

    Rounds of a large and a small star step leave, in a number of rounds that grows
    with the logarithm of the nodes, one star around each component's smallest node.
    Edges with a null end are left out, loops and repeats do no harm; an empty table
    has no nodes.
    """
    known = edges.select(F.col(f"`{a}`").alias("u"), F.col(f"`{b}`").alias("v")).where("u is not null and v is not null")
    known = materialize(known, "edges")
    now = materialize(known.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    before = mark(now)
    while True:
        wide = materialize(_stars(now, large=True), "stars")
        after = materialize(_stars(wide, large=False), "stars")
        discard(now, wide)
        now, same = after, mark(after)
        if same == before:
            break
        before = same
    nodes = known.select(F.col("u").alias("node")).union(known.select("v")).distinct()
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))


def merged_by_keys(records: DataFrame, id_: str, keys: list[str]) -> DataFrame:
    """(id, merged_into): records that share a value of any key, directly or by a chain of others, become the smallest of their ids.

    A null or empty value links nothing.  Records are linked with the smallest that
    has the value, so a value on very many records makes a star, not pairs.
    """
    edges = None
    for k in keys:
        rows = records.select(F.col(f"`{id_}`").alias("id"), F.col(f"`{k}`").alias("key")).where("key is not null and cast(key as string) <> ''")
        first = rows.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        links = rows.join(first, "key").select("id", "first").where("id <> first")
        edges = links if edges is None else edges.union(links)
    found = components(edges, "id", "first").select(F.col("node").alias(id_), F.col("component").alias("merged_into"))
    return records.select(id_).distinct().join(found, id_, "left").withColumn("merged_into", F.coalesce("merged_into", F.col(id_)))


def merge_parents(parents: DataFrame, children: DataFrame, id_: str, keys: list[str], parent: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What each record became (id, merged_into), how many became each (id, merged), and the children with their parents replaced.

    Children of no known parent stay as they are.
    """
    into = materialize(merged_by_keys(parents, id_, keys), "merged")
    kept = into.groupBy(F.col("merged_into").alias(id_)).agg(F.count("*").alias("merged"))
    moved = children.join(into.select(F.col(id_).alias("_old"), "merged_into"), F.col(parent) == F.col("_old"), "left")
    return into, kept, moved.withColumn(parent, F.coalesce("merged_into", parent)).drop("_old", "merged_into")
