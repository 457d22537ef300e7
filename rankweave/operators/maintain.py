"""Snapshot merging, counters and budgets: maintenance as functions of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def budgeted_prefix(rows: DataFrame, order: str, cost: str, budget: int) -> DataFrame:
    """The first rows whose running cost (at least 1 each) stays within the budget; the first row always.

    No more rows than the budget can qualify, so only those are numbered.
    """
    first = rows.orderBy(order).limit(budget + 1)
    running = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = first.withColumn("running", F.sum(cost).over(running)).withColumn("_n", F.row_number().over(Window.orderBy(order)))
    return numbered.where((F.col("running") <= budget) | (F.col("_n") == 1)).drop("_n")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], keep_if_null: list[str]) -> DataFrame:
    """The merged table with an ``action`` for each row: inserted, updated or kept.

    A null in ``keep_if_null`` leaves the old value.  Null keys count as empty.
    """
    k = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_k{i}") for i, c in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    old = target.select(*k, F.struct(*target.columns).alias("_old"))
    new = source.select(*k, F.struct(*source.columns).alias("_new"))
    both = old.join(new, names, "full")
    value = lambda c: F.when(F.col("_new").isNull(), F.col(f"_old.{c}")).otherwise(F.coalesce(F.col(f"_new.{c}"), F.col(f"_old.{c}")) if c in keep_if_null else F.col(f"_new.{c}"))
    action = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "kept").otherwise("updated")
    return both.select(*[value(c).alias(c) for c in target.columns], action.alias("action"))


def insert_or_link(known: DataFrame, coming: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """(id, outcome, target_id) for each coming row: where its key is known, the row is linked to
    the key's smallest known id; else the key's smallest coming row is inserted, and its others
    are repeats of that.  Rows with a null key match nothing known, and repeat each other."""
    name = lambda df, to: df.select(*[F.col(k).alias(f"{to}{i}") for i, k in enumerate(keys)], F.col(id_).alias(f"{to}_id"))
    same = lambda how: reduce(lambda x, y: x & y, how)
    n = range(len(keys))
    old = name(known, "k").groupBy(*[f"k{i}" for i in n]).agg(F.min("k_id").alias("known_id"))
    first = name(coming, "f").groupBy(*[f"f{i}" for i in n]).agg(F.min("f_id").alias("first_id"))
    judged = first.join(old, same([F.col(f"f{i}") == F.col(f"k{i}") for i in n]), "left")  # keys meet once, not rows
    rows = name(coming, "c").join(judged, same([F.col(f"c{i}").eqNullSafe(F.col(f"f{i}")) for i in n]))
    outcome = F.when(F.col("known_id").isNotNull(), "linked").when(F.col("c_id") == F.col("first_id"), "inserted").otherwise("repeated")
    return rows.select(F.col("c_id").alias(id_), outcome.alias("outcome"), F.coalesce("known_id", "first_id").alias("target_id"))


def retire_missing(active: DataFrame, snapshot: DataFrame, group: str, key: str) -> DataFrame:
    """Active rows that a group's latest snapshot lacks; groups without any snapshot row are left alone."""
    seen = snapshot.select(group).distinct()
    return active.join(seen, group, "left_semi").join(snapshot.select(group, key), [group, key], "left_anti")


def fail_streak(log: DataFrame, key: str, order: list[str], success: str) -> DataFrame:
    """(key, streak): failures after each key's last success."""
    place = F.struct(*order)
    last = log.where(F.col(success)).groupBy(key).agg(F.max(place).alias("_last"))
    fails = log.where(~F.col(success)).join(last, key, "left").where(F.col("_last").isNull() | (place > F.col("_last"))).groupBy(key).agg(F.count("*").alias("streak"))
    return log.select(key).distinct().join(fails, key, "left").na.fill(0, ["streak"])


def latest_toggles(ops: DataFrame, keys: list[str], order: list[str], op: str = "op") -> DataFrame:
    """Edges whose last operation added them; an edge to itself never counts."""
    last = ops.groupBy(*keys).agg(F.max_by(op, F.struct(*order)).alias("_op"))
    out = last.where("_op = 'add'").drop("_op")
    return out.where(F.col(keys[0]) != F.col(keys[1])) if len(keys) == 2 else out


def counters(edges: DataFrame, key: str, kind: str, kinds: list[str]) -> DataFrame:
    """Counts of edges by kind."""
    return edges.groupBy(key).agg(*[F.count_if(F.col(kind) == k).alias(f"{k}_count") for k in kinds])


def fan_out(events: DataFrame, follows: DataFrame, actor: str) -> DataFrame:
    """(recipient, event_id): one message for each follower of an event's actor, but for themselves."""
    joined = events.join(follows, events[actor] == follows["followed"])
    return joined.where(F.col("follower") != F.col(actor)).select(F.col("follower").alias("recipient"), "event_id")


def expire(rows: DataFrame, as_of: str, value: str, until: str) -> DataFrame:
    """Values past their date become 0."""
    gone = F.col(until).isNotNull() & (F.col(until) < F.lit(as_of).cast("timestamp"))
    return rows.withColumn(value, F.when(gone, 0).otherwise(F.col(value)))


def spend_in_order(requests: DataFrame, credits: DataFrame, key: str, order: list[str], item: str) -> DataFrame:
    """Requests with ``granted``: a key's first so many distinct items as it has credits.

    A repeated item costs nothing and gets its first request's decision.
    """
    first = requests.groupBy(key, item).agg(F.min(F.struct(*order)).alias("_at"))
    ranked = first.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_at", item)))
    decided = ranked.join(credits, key, "left").select(key, item, (F.col("_n") <= F.coalesce("credits", F.lit(0))).alias("granted"))
    return requests.join(decided, [key, item])


def violations(rows: DataFrame, checks: dict[str, Column], unique: list[str] | None = None) -> DataFrame:
    """(rule, n): how many rows break each check, and how many key values repeat."""
    counted = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(True))).alias(n) for n, c in checks.items()])
    out = counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in checks])).alias("x")).select("x.*")
    if unique:
        repeated = rows.groupBy(*unique).count().where("count > 1").agg(F.count("*").alias("n"))
        out = out.union(repeated.select(F.lit("unique").alias("rule"), "n"))
    return out


def validated(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all checks, and the others with the names of what they break."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))
    marked = rows.withColumn("broken", broken)
    return marked.where(F.size("broken") == 0).drop("broken"), marked.where(F.size("broken") > 0)


def first_match(cases: list[tuple[Column, str]], default: str) -> Column:
    """The value of the first case that holds."""
    return reduce(lambda out, c: F.when(F.coalesce(c[0], F.lit(False)), c[1]).otherwise(out), reversed(cases), F.lit(default))


def capped_sessions(sessions: DataFrame, user: str, device: str, at: str, cap: int = 2) -> DataFrame:
    """Each user's ``cap`` latest devices; a device's later session replaces its earlier one."""
    devices = sessions.groupBy(user, device).agg(F.max(at).alias(at))
    return devices.withColumn("_n", F.row_number().over(Window.partitionBy(user).orderBy(F.desc(at), device))).where(F.col("_n") <= cap).drop("_n")
