"""Ranking, recommendation and compatibility operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.operators.shared import materialize


def js_round(c: Column) -> Column:
    """Round half up towards positive infinity."""
    return F.floor(c + 0.5).cast("bigint")


def recency(latest: Column, as_of: str) -> Column:
    """100, 70 or 40 for something within 7, 30 or 90 days, else 10."""
    now = F.lit(as_of).cast("timestamp")
    return F.when(latest >= now - F.expr("interval 7 days"), 100).when(latest >= now - F.expr("interval 30 days"), 70).when(latest >= now - F.expr("interval 90 days"), 40).otherwise(10)


def venue_stats(reviews: DataFrame, providers: DataFrame) -> DataFrame:
    """(venue_id, review_count, avg_score, latest, provider_count): scored reviews by the provider's venue."""
    scored = reviews.where("score is not null").select("provider_id", "score", "created_at")
    by_venue = scored.join(providers.select("provider_id", "venue_id"), "provider_id").groupBy("venue_id").agg(
        F.count("*").alias("review_count"), F.avg("score").cast("decimal(5,1)").alias("avg_score"), F.max("created_at").alias("latest")
    )
    counts = providers.groupBy("venue_id").agg(F.count("*").alias("provider_count"))
    return counts.join(by_venue, "venue_id", "left").na.fill(0, ["review_count"])


def scored_venues(venues: DataFrame, stats: DataFrame, reviews: DataFrame, as_of: str, prior: float = 74.0, weight: int = 5) -> DataFrame:
    """Venues with a Bayesian score and a composite rank.

    The mean over all scored reviews is the prior (``prior`` without any).
    Rank: 0.45 unrounded Bayesian score, 0.35 review count up to 30, 0.10
    provider count up to 50, 0.10 recency.
    """
    mean = reviews.agg(F.coalesce(F.avg("score"), F.lit(prior)).alias("mean")).scalar()
    joined = venues.join(stats, "venue_id", "left").na.fill(0, ["review_count", "provider_count"])
    n = F.col("review_count")
    total = F.coalesce(F.col("avg_score").cast("double"), F.lit(0.0)) * n
    raw = (weight * mean + total) / (weight + n)
    rank = raw * 0.45 + F.least(n, F.lit(30)) / 30 * 100 * 0.35 + F.least(F.col("provider_count"), F.lit(50)) / 50 * 100 * 0.10 + recency(F.col("latest"), as_of) * 0.10
    zero = F.lit(0).cast("decimal(5,1)")
    return joined.withColumns({"bayes_score": F.when(n == 0, zero).otherwise(raw.cast("decimal(5,1)")), "rank_score": F.when(n == 0, zero).otherwise(rank.cast("decimal(5,1)"))})


def top_providers(reviews: DataFrame, providers: DataFrame, limit: int = 50) -> DataFrame:
    """The best providers by rounded average (a null score counts 0); the cut comes before the lookup."""
    agg = reviews.groupBy("provider_id").agg(js_round(F.sum(F.coalesce("score", F.lit(0))) / F.count("*")).alias("avg_score"), F.count("*").alias("review_count"))
    top = agg.orderBy(F.desc("avg_score"), F.desc("review_count"), "provider_id").limit(limit)
    return top.join(providers, "provider_id")


def facet_search(reviews: DataFrame, facets: dict[str, list[int]], min_score: int | None = None) -> DataFrame:
    """Providers that have, for each facet, a review with one of its values; with their aggregates."""
    flags = [F.max(F.col(c).isin(v)).alias(f"has_{c}") for c, v in facets.items()]
    sets = [F.sort_array(F.collect_set(c)).alias(f"{c}s") for c in ("type_id", "body_id", "level_id")]
    agg = reviews.groupBy("provider_id").agg(F.count("*").alias("review_count"), js_round(F.sum(F.coalesce("score", F.lit(0))) / F.count("*")).alias("avg_score"), *sets, *flags)
    kept = agg.where(reduce(lambda a, b: a & b, [F.col(f"has_{c}") for c in facets], F.lit(True))).drop(*[f"has_{c}" for c in facets])
    return kept if min_score is None else kept.where(F.col("avg_score") >= min_score)


#: Orders of a provider search; the id settles ties.
SORTS = {
    "newest": [],
    "name": [("name", False)],
    "rating": [("avg_score", True), ("review_count", True)],
    "reviews": [("review_count", True), ("avg_score", True)],
}


def search_providers(
    providers: DataFrame,
    reviews: DataFrame,
    facets: dict[str, list[int]] | None = None,
    min_score: int | None = None,
    with_stats: bool = False,
    venues: DataFrame | None = None,
    ids: list[int] | None = None,
    keyword: str | None = None,
    sort: str = "newest",
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """A page of active providers with their review statistics.

    ``facets`` are met by any of a provider's reviews each, and all of them; ``min_score``
    is for the rounded average.  Either, or ``with_stats``, leaves only reviewed providers.
    ``venues`` (venue_id) keeps those of an area, ``keyword`` those whose name holds it in
    any case, ``_`` and ``%`` taken literally.  At most 50 rows, newest (largest id) first
    within equals.
    """
    found = providers.where("status = 'active'")
    if keyword:
        found = found.where(F.contains(F.lower("name"), F.lit(keyword.lower())))
    if ids:
        found = found.where(F.col("provider_id").isin(ids))
    if venues is not None:
        found = found.join(venues.select("venue_id").distinct(), "venue_id", "left_semi")
    filtered = bool(facets) or min_score is not None or with_stats
    if filtered or sort in ("rating", "reviews"):
        stats = facet_search(reviews, facets or {}, min_score)
        found = found.join(stats, "provider_id", "inner" if filtered else "left")
    order = [F.desc_nulls_last(c) if down else F.asc(c) for c, down in SORTS[sort]]
    return found.orderBy(*order, F.desc("provider_id")).offset(max(offset, 0)).limit(min(limit, 50))


def area_venues(venue_areas: DataFrame, areas: DataFrame, regions: DataFrame, region_slug: str, area: str | None = None) -> DataFrame:
    """(venue_id) of a region, or of its area of that name."""
    wanted = areas.join(regions.where(F.col("slug") == region_slug).select("region_id"), "region_id", "left_semi")
    wanted = wanted.where(F.col("name") == area) if area else wanted
    return venue_areas.join(wanted.select("area_id"), "area_id", "left_semi").select("venue_id").distinct()


def dominant(rows: DataFrame, key: str, category: str) -> DataFrame:
    """(key, category): the commonest category of each key, ties to the least."""
    counts = rows.where(F.col(category).isNotNull()).groupBy(key, category).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.max_by(category, F.struct("n", -F.col(category))).alias(category))


def recommend(reviews: DataFrame, member: int, limit: int = 20, neighbours: int = 50) -> DataFrame:
    """Neighbour-based recommendations for one member.

    Similarity: 0.6 of 1 - MAE/50 over shared providers plus 0.4 for the same
    dominant type; 0.3 of the latter without shared ones; over 0.15 to count.
    """
    liked = F.when(F.col("score") >= 60, F.col("score"))
    counted = reviews.where("member_id is not null").groupBy("member_id", "provider_id", "type_id").agg(
        F.count("*").alias("n"), F.max(F.struct("created_at", "review_id", "score")).alias("last"), F.sum(liked).alias("liked"), F.count(liked).alias("liked_n")
    )
    known = materialize(counted, "member-scores")  # all that follows comes from these sums, so reviews are read and dealt once
    mine = known.where(F.col("member_id") == member).groupBy("provider_id").agg(F.coalesce(F.max("last")["score"], F.lit(0)).alias("my_score"))
    met = known.where(F.col("member_id") != member).join(mine, "provider_id").groupBy("member_id", "provider_id", "my_score").agg(F.coalesce(F.max("last")["score"], F.lit(0)).alias("score"))
    shared = met.groupBy("member_id").agg(F.avg(F.abs(F.col("score") - F.col("my_score"))).alias("mae"))
    by_type = known.groupBy("member_id", "type_id").agg(F.sum("n").alias("n"))
    types = by_type.groupBy("member_id").agg(F.sum("n").alias("total"), F.max_by("type_id", F.when(F.col("type_id").isNotNull(), F.struct("n", -F.col("type_id")))).alias("type_id"))
    own = types.where(F.col("member_id") == member).select(F.col("type_id").alias("own_type"))
    overlap = F.coalesce((F.col("type_id") == F.col("own_type")).cast("int"), F.lit(0))
    others = types.where((F.col("member_id") != member) & (F.col("total") >= 2))
    people = others.join(shared, "member_id", "left").join(F.broadcast(own), F.lit(True), "left")  # one row
    sim = F.when(F.col("mae").isNotNull(), 0.6 * F.greatest(F.lit(0.0), 1 - F.col("mae") / 50) + 0.4 * overlap).otherwise(0.3 * overlap)
    near = people.withColumn("sim", sim.cast("decimal(12,6)")).where("sim > 0.15").orderBy(F.desc("sim"), "member_id").limit(neighbours).select("member_id", "sim")
    fresh = known.where("liked_n > 0").join(F.broadcast(near), "member_id").join(mine, "provider_id", "left_anti")
    agg = fresh.groupBy("provider_id").agg(F.sum(F.col("liked") * F.col("sim")).alias("up"), F.sum(F.col("liked_n") * F.col("sim")).alias("down"), F.sum("liked_n").alias("user_count"))
    scored = agg.select("provider_id", js_round((F.col("up") / F.col("down")).cast("double")).alias("predicted"), "user_count")
    return scored.orderBy(F.desc(F.round(F.col("predicted") * F.log2(F.col("user_count") + 1), 6)), "provider_id").limit(limit)


def shares(rows: DataFrame, keys: list[str], category: str, of_all: bool = False) -> DataFrame:
    """Counts and whole percentages of categories; of non-null rows, or of all rows."""
    counts = rows.groupBy(*keys, category).agg(F.count("*").alias("n"))
    window = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    total = F.sum("n" if of_all else F.when(F.col(category).isNotNull(), F.col("n"))).over(window)
    return counts.withColumn("pct", js_round(100 * F.col("n") / total)).where(F.col(category).isNotNull())


def provider_profiles(reviews: DataFrame) -> DataFrame:
    """What reviews agree on for each provider: type, body and level of most reviews (the smallest of
    equals) with their shares in percent, all levels, and the means of the four parameters.

    Reviews are counted once by (provider, type, body, level), and everything else comes from these
    counts, so that rows are shuffled once.
    """
    kinds, params = ["type_id", "body_id", "level_id"], ["p1", "p2", "p3", "p4"]
    sums = [x for p in params for x in (F.sum(p).alias(f"{p}_sum"), F.count(p).alias(f"{p}_n"))]
    counted = reviews.groupBy("provider_id", *kinds).agg(F.count("*").alias("n"), *sums)
    by_provider = Window.partitionBy("provider_id")
    for k in kinds:  # how many reviews of the provider have the value
        counted = counted.withColumn(f"{k}_n", F.sum("n").over(Window.partitionBy("provider_id", k)))
    counted = counted.withColumn("total", F.sum("n").over(by_provider))
    best = [F.min_by(F.struct(k, f"{k}_n"), F.struct(-F.col(f"{k}_n"), k)).alias(k) for k in kinds]
    means = [F.round(F.sum(f"{p}_sum") / F.sum(f"{p}_n"), 1).alias(p) for p in params]
    out = counted.groupBy("provider_id").agg(F.max("total").alias("n"), F.sort_array(F.collect_set("level_id")).alias("levels"), *best, *means)
    named = [x for k in kinds for x in (F.col(f"{k}.{k}").alias(k), js_round(100 * F.col(f"{k}.{k}_n") / F.col("n")).alias(f"{k[:-3]}_pct"))]
    return out.select("provider_id", "n", *named, "levels", *params)


def compatibility(reviews: DataFrame, member: int, providers: list[int]) -> DataFrame:
    """Compatibility of a member with providers: (provider_id, score, label).

    A member with under 3 reviews, or a provider with none, gets -1.
    """
    mine = reviews.where(F.col("member_id") == member)
    params = ["p1", "p2", "p3", "p4"]
    mean = lambda c: F.coalesce(F.avg(c), F.lit(3.0))
    me = mine.agg(F.count("*").alias("mine_n"), *[mean(p).alias(f"my_{p}") for p in params])
    theirs = reviews.where(F.col("provider_id").isin(providers))
    them = theirs.groupBy("provider_id").agg(F.count("*").alias("n"), *[mean(p).alias(p) for p in params])
    out = mine.sparkSession.createDataFrame([(p,) for p in providers], "provider_id long").join(them, "provider_id", "left").join(F.broadcast(me), F.lit(True), "left")  # one row
    for c in ("type_id", "body_id", "level_id"):
        top = dominant(theirs, "provider_id", c)
        pct = shares(mine, [], c).select(c, F.col("pct").alias(f"{c}_pct"))
        out = out.join(top.join(F.broadcast(pct), c, "left").select("provider_id", f"{c}_pct"), "provider_id", "left").na.fill(0, [f"{c}_pct"])
    distance = F.sqrt(reduce(lambda a, b: a + b, [F.pow(F.col(p) - F.col(f"my_{p}"), 2) for p in params]))
    param = F.greatest(F.lit(0), js_round(100 - distance / 8 * 100))
    score = js_round(F.round(0.35 * F.col("type_id_pct") + 0.30 * param + 0.20 * F.col("body_id_pct") + 0.15 * F.col("level_id_pct"), 9))
    final = F.when((F.col("mine_n") < 3) | F.col("n").isNull(), F.lit(-1)).otherwise(score).cast("bigint")
    label = lambda s: F.when(s >= 70, "great").when(s >= 45, "good").when(s >= 25, "fair").when(s >= 0, "low")
    return out.select("provider_id", final.alias("score")).withColumn("label", label(F.col("score")))
