"""Record linkage and identities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def identity_numbers(rows: DataFrame, name: str, out: str = "person_id", prefix: int = 4) -> DataFrame:
    """Dense ranks of names, in binary order, without sorting all rows in one task.

    Names are numbered within their first characters; what earlier beginnings
    hold is added.
    """
    names = rows.where(F.col(name).isNotNull()).select(F.col(name).alias("_name")).distinct().withColumn("_start", F.substring("_name", 1, prefix))
    inside = names.withColumn("_n", F.row_number().over(Window.partitionBy("_start").orderBy("_name")))
    starts = names.groupBy("_start").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = inside.join(starts.select("_start", before.alias("_before")), "_start").select("_name", (F.col("_before") + F.col("_n")).cast("bigint").alias(out))
    return rows.join(numbered, F.col(name) == F.col("_name"), "left").drop("_name")


def equal_pairs(rows: DataFrame, key: str, row_id: str, other: str, block: int = 2048, run: int = 64, other_run: int = 256) -> DataFrame:
    """(row_id, other): all pairs of rows with an equal key and different ids, in both orders; nulls pair with nothing.

    A hash puts a key's ids into blocks of about ``block`` (smaller ones if the key has few), and every block meets
    every block of its key, each two in some task: so a key's pairs are shared out, and what is shuffled stays far
    below them.  Pairs come from a ``run`` of ids and an ``other_run``, each id beside all of the other run: columnar
    files then see one id again and again next to a short list that repeats, and take little disk for it.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{row_id}`").alias("id")).where("key is not null and id is not null")
    size = F.count("*")
    parts = given.groupBy("key").agg(F.greatest(F.ceil(size / block), F.least(F.ceil(size / other_run), F.lit(4))).cast("int").alias("parts"))
    ids = given.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).groupBy("key", "parts", "part").agg(F.collect_list("id").alias("ids"))
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))

    def dealt(blocks: DataFrame, size: int, out: str) -> DataFrame:
        """In a fixed number of partitions, as adaptive execution would put rows of so few bytes into one; then cut into runs."""
        runs = F.transform(F.sequence(F.lit(0), F.size("ids") - 1, F.lit(size)), lambda at: F.slice("ids", at + 1, size))
        return blocks.repartition(n, "key", "i", "j").select("key", "i", "j", F.explode(runs).alias(out))

    a = dealt(ids.select("key", F.col("part").alias("i"), each.alias("j"), "ids"), run, "a")
    b = dealt(ids.select("key", each.alias("i"), F.col("part").alias("j"), "ids"), other_run, "b")
    pairs = a.join(b, ["key", "i", "j"]).select(F.explode("a").alias(row_id), "b").select(row_id, F.explode("b").alias(other))
    return pairs.where(F.col(f"`{row_id}`") != F.col(f"`{other}`"))


def waterfall(left: DataFrame, right: DataFrame, passes: list[tuple[str, list[str]]], left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id, method): the first pass that links a left row wins.

    Each pass joins on equal columns, not null, and takes the least right id;
    later passes only see left rows that no earlier pass linked.
    """
    rest, found = left, []
    for method, columns in passes:
        filled = lambda df, columns=columns: df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))
        target = filled(right).groupBy(*columns).agg(F.min(right_id).alias(right_id))
        hit = filled(rest).join(target, columns).select(left_id, right_id, F.lit(method).alias("method"))
        found.append(hit)
        rest = rest.join(hit.select(left_id), left_id, "left_anti")
    return reduce(DataFrame.unionByName, found)


def three_pass_links(left: DataFrame, right: DataFrame, left_id: str, right_id: str, grams: int = 2) -> DataFrame:
    """(left_id, right_id, method): by ``url``, else by ``domain`` and ``name``, else by ``venue`` and ``name``.

    All four are normalised columns of both sides; a null links nothing.  Venues are
    the same if their names are equal; a venue that equals none on the right goes with
    those that hold its name or that it holds (of ``grams`` characters or more).  Of several
    the least right id is taken.  Venue names meet each other once, not once for each row.
    """
    first = waterfall(left, right, [("url", ["url"]), ("domain_name", ["domain", "name"])], left_id, right_id)
    rest = left.join(first.select(left_id), left_id, "left_anti").where("venue is not null and name is not null")
    ours, theirs = (df.where("venue is not null").select(F.col("venue").alias(c), F.col("venue").alias("v")).distinct() for df, c in ((rest, "our"), (right, "their")))
    equal = ours.join(theirs, "v").select("our", "their")
    other = link_contained(ours.join(equal, "our", "left_anti"), theirs, "v", "our", "their", grams).select("our", F.col("their_linked").alias("their"))
    venues = equal.unionByName(other)
    target = right.where("name is not null").groupBy(F.col("venue").alias("their"), "name").agg(F.min(right_id).alias(right_id))
    placed = venues.join(target, "their").groupBy("our", "name").agg(F.min(right_id).alias(right_id))
    last = rest.join(placed.withColumnRenamed("our", "venue"), ["venue", "name"]).select(left_id, right_id, F.lit("venue_name").alias("method"))
    return first.unionByName(last)


def link_contained(left: DataFrame, right: DataFrame, name: str, left_id: str, right_id: str, grams: int = 2) -> DataFrame:
    """(left_id, right_id) where either name contains the other; names of ``grams`` characters or more.

    A contained name equals one of the other's substrings, of the lengths that
    contained names have, so pairs meet by equality and none is tried in vain.
    A name forms at most half its length squared of them, once for all its copies.
    """

    def rows(df: DataFrame, key: str, label: str) -> DataFrame:
        return df.where(F.length(name) >= grams).select(F.col(key).alias(label), F.col(name).alias(f"{label}_name")).distinct()

    def held(outer: DataFrame, outer_name: str, inner: DataFrame, inner_name: str) -> DataFrame:
        """Distinct names and those they hold."""
        outer, inner = outer.select(outer_name).distinct(), inner.select(inner_name).distinct()
        n = F.col(outer_name)
        lengths = inner.select(F.length(inner_name).alias("n")).distinct().agg(F.collect_list("n").alias("lengths"))  # one row
        cuts = F.flatten(F.transform(F.filter("lengths", lambda k: k <= F.length(n)), lambda k: F.transform(F.sequence(F.lit(1), F.length(n) - k + 1), lambda i: F.substring(n, i, k))))
        parts = outer.crossJoin(F.broadcast(lengths)).select(outer_name, F.explode(F.array_distinct(cuts)).alias(inner_name))
        return parts.join(inner, inner_name, "left_semi").select("a_name", "b_name")

    a, b = rows(left, left_id, "a"), rows(right, right_id, "b")
    names = held(b, "b_name", a, "a_name").union(held(a, "a_name", b, "b_name")).distinct()
    pairs = a.join(names, "a_name").join(b, "b_name").select("a", "b").distinct()
    return pairs.select(F.col("a").alias(left_id), F.col("b").alias(f"{right_id}_linked"))


def merge_duplicates(parents: DataFrame, children: DataFrame, same: str, parent_id: str) -> tuple[DataFrame, DataFrame]:
    """Keep one parent of each group, one with children before others, then the least id.

    Children move to the parent that is kept, so none is lost.  Returns the
    parents kept and the children.
    """
    has = children.select(parent_id).distinct().withColumn("_has", F.lit(1))
    ranked = parents.join(has, parent_id, "left").withColumn("_keep", F.min_by(parent_id, F.struct(F.coalesce(1 - F.col("_has"), F.lit(1)), F.col(parent_id))).over(Window.partitionBy(same)))
    mapping = ranked.select(F.col(parent_id).alias("_old"), F.when(F.col(same).isNull(), F.col(parent_id)).otherwise(F.col("_keep")).alias("_keep"))
    kept = parents.join(mapping.where("_old = _keep").select(F.col("_old").alias(parent_id)), parent_id, "left_semi")
    moved = children.join(mapping, F.col(parent_id) == F.col("_old"), "left").withColumn(parent_id, F.coalesce("_keep", parent_id)).drop("_old", "_keep")
    return kept, moved
