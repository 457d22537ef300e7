"""Ranking, recommendation, linkage, hierarchy and maintenance queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions import text as T
from rankweave.operators import hierarchy, ledger, linkage, maintain, ranking
from rankweave.operators.ordered import floored_counters
from rankweave.plans.registry import query
from rankweave.sources.model import AS_OF, SEGMENTS, Model
from rankweave.streaming import keyed

_STATS = """, scored AS (SELECT * FROM {src} WHERE score IS NOT NULL),
 vs AS (SELECT p.venue_id, count(*) n, CAST(avg(s.score) AS DECIMAL(5,1)) avg_score, max(s.created_at) latest FROM scored s JOIN providers p USING (provider_id) GROUP BY 1),
 pc AS (SELECT venue_id, count(*) pn FROM providers GROUP BY 1),
 mean AS (SELECT coalesce(avg(score), 74) mm FROM {src})"""
_RANKED = """ SELECT venue_id, name, display_order, coalesce(n, 0) review_count,
 CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE CAST(CAST((5 * mm + CAST(avg_score AS DOUBLE) * n) / (5 + n) AS DECIMAL(5,1)) AS DOUBLE) END bayes_score,
 CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE CAST(CAST((5 * mm + CAST(avg_score AS DOUBLE) * n) / (5 + n) * 0.45::DOUBLE + least(n, 30) / 30 * 100 * 0.35::DOUBLE + least(coalesce(pn, 0), 50) / 50 * 100 * 0.10::DOUBLE
 + CASE WHEN latest >= TIMESTAMP '2001-11-05' - INTERVAL 7 DAY THEN 100 WHEN latest >= TIMESTAMP '2001-11-05' - INTERVAL 30 DAY THEN 70 WHEN latest >= TIMESTAMP '2001-11-05' - INTERVAL 90 DAY THEN 40 ELSE 10 END * 0.10::DOUBLE AS DECIMAL(5,1)) AS DOUBLE) END rank_score
 FROM (SELECT * FROM venue_areas WHERE area_id = 7) a JOIN published USING (venue_id) LEFT JOIN vs USING (venue_id) LEFT JOIN pc USING (venue_id), mean
 ORDER BY rank_score DESC, review_count DESC, display_order LIMIT 200"""


def _ranked(m: Model, area: int | None) -> DataFrame:
    reviews = m.approved_scores()
    places = m.venue_areas()
    venues = (places if area is None else places.where(F.col("area_id") == area)).join(m.published(), "venue_id")
    return ranking.scored_venues(venues, ranking.venue_stats(reviews, m.providers()), reviews, AS_OF)


_SCORES = [f"cast({c} as double) {c}" for c in ("bayes_score", "rank_score")]


@query("r01_ranked_venues", _STATS.format(src="approved") + _RANKED)
def _(m: Model) -> DataFrame:
    best = _ranked(m, area=7).orderBy(F.desc("rank_score"), F.desc("review_count"), "display_order").limit(200)
    return best.selectExpr("venue_id", "name", "display_order", "review_count", *_SCORES)


@query("r01_ranked_venues_sparse", _STATS.format(src="approved") + _RANKED.replace("SELECT venue_id", "SELECT area_id, venue_id", 1).replace(" WHERE area_id = 7", "").replace(" ORDER BY rank_score DESC, review_count DESC, display_order LIMIT 200", " QUALIFY row_number() OVER (PARTITION BY area_id ORDER BY rank_score DESC, review_count DESC, display_order) <= 200"))
def _(m: Model) -> DataFrame:
    """The best venues of every area."""
    place = F.row_number().over(Window.partitionBy("area_id").orderBy(F.desc("rank_score"), F.desc("review_count"), "display_order"))
    best = _ranked(m, area=None).withColumn("place", place).where("place <= 200")
    return best.selectExpr("area_id", "venue_id", "name", "display_order", "review_count", *_SCORES)


@query("r02_batch_stats", _STATS.format(src="approved") + " SELECT v.venue_id, coalesce(n, 0) review_count, coalesce(CAST(avg_score AS DOUBLE), 0) avg_score FROM published v LEFT JOIN vs USING (venue_id) WHERE v.venue_id IN (1, 2, 3, 5, 8, 13)")
def _(m: Model) -> DataFrame:
    stats = ranking.venue_stats(m.approved(), m.providers()).withColumn("avg_score", F.col("avg_score").cast("double"))
    wanted = m.published().where(F.col("venue_id").isin(1, 2, 3, 5, 8, 13)).select("venue_id")
    return wanted.join(stats.select("venue_id", "review_count", "avg_score"), "venue_id", "left").na.fill(0)


@query("r03_top_providers", ", t AS (SELECT provider_id, CAST(floor(sum(coalesce(score, 0)) / count(*) + 0.5) AS BIGINT) avg_score, count(*) review_count FROM approved GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 50) SELECT provider_id, avg_score, review_count, name FROM t JOIN providers USING (provider_id) WHERE status = 'active'")
def _(m: Model) -> DataFrame:
    return ranking.top_providers(m.approved(), m.providers().where("status = 'active'")).select("provider_id", "avg_score", "review_count", "name")


@query("r04_facet_search", "SELECT provider_id, count(*) review_count, CAST(floor(sum(coalesce(score, 0)) / count(*) + 0.5) AS BIGINT) avg_score FROM approved GROUP BY 1 HAVING bool_or(type_id IN (1, 2)) AND bool_or(level_id IN (2, 3)) AND avg_score >= 40 AND provider_id IN (SELECT provider_id FROM providers WHERE status = 'active')")
def _(m: Model) -> DataFrame:
    found = ranking.facet_search(m.approved(), {"type_id": [1, 2], "level_id": [2, 3]}, min_score=40)
    return found.join(m.providers().where("status = 'active'"), "provider_id", "left_semi").select("provider_id", "review_count", "avg_score")


_FOUND = ", s AS (SELECT provider_id, count(*) review_count, CAST(floor(sum(coalesce(score, 0)) / count(*) + 0.5) AS BIGINT) avg_score, bool_or(type_id IN (1, 2, 3)) a, bool_or(level_id IN (2, 3)) b FROM approved GROUP BY 1)"


@query(
    "r04_search_in_region",
    _FOUND + " SELECT provider_id, name, age, review_count, avg_score FROM providers JOIN s USING (provider_id) WHERE status = 'active' AND a AND b AND avg_score >= 40 AND contains(lower(name), 'r') AND venue_id IN (SELECT venue_id FROM venue_areas JOIN areas USING (area_id) JOIN regions r ON areas.region_id = r.region_id WHERE r.slug = 'nation_7') ORDER BY avg_score DESC, review_count DESC, provider_id DESC LIMIT 40 OFFSET 3",
)
def _(m: Model) -> DataFrame:
    """Facets, least score, region, keyword, sort and page at once."""
    venues = ranking.area_venues(m.venue_areas(), m.areas(), m.regions(), "nation_7")
    page = ranking.search_providers(m.providers(), m.approved_scores(), {"type_id": [1, 2, 3], "level_id": [2, 3]}, min_score=40, venues=venues, keyword="R", sort="rating", limit=40, offset=3)
    return page.select("provider_id", "name", "age", "review_count", "avg_score")


@query("r04_search_in_area", "SELECT provider_id, name FROM providers WHERE status = 'active' AND venue_id IN (SELECT venue_id FROM venue_areas JOIN areas USING (area_id) JOIN regions r ON areas.region_id = r.region_id WHERE r.slug = 'nation_3' AND areas.name = 'NATION_3 BUILDING') ORDER BY name, provider_id DESC LIMIT 50 OFFSET 10")
def _(m: Model) -> DataFrame:
    venues = ranking.area_venues(m.venue_areas(), m.areas(), m.regions(), "nation_3", "NATION_3 BUILDING")
    return ranking.search_providers(m.providers(), m.approved_scores(), venues=venues, sort="name", limit=500, offset=10).select("provider_id", "name")


@query("r04_newest_with_stats", _FOUND + " SELECT provider_id, review_count, avg_score FROM providers JOIN s USING (provider_id) WHERE status = 'active' ORDER BY provider_id DESC LIMIT 50")
def _(m: Model) -> DataFrame:
    return ranking.search_providers(m.providers(), m.approved_scores(), with_stats=True).select("provider_id", "review_count", "avg_score")


_RECOMMEND = """, known AS (SELECT * FROM approved WHERE member_id IS NOT NULL),
 last AS (SELECT member_id, provider_id, coalesce(score, 0) score FROM known QUALIFY row_number() OVER (PARTITION BY member_id, provider_id ORDER BY created_at DESC, review_id DESC) = 1),
 enough AS (SELECT member_id FROM known GROUP BY 1 HAVING count(*) >= 2),
 dom AS (SELECT member_id, type_id FROM (SELECT member_id, type_id, row_number() OVER (PARTITION BY member_id ORDER BY count(*) DESC, type_id) rn FROM known GROUP BY 1, 2) WHERE rn = 1),
 sh AS (SELECT b.member_id, avg(abs(b.score - a.score)) mae FROM last a JOIN last b USING (provider_id) WHERE a.member_id = 7 AND b.member_id <> 7 GROUP BY 1),
 sim AS (SELECT e.member_id, CAST(CASE WHEN mae IS NOT NULL THEN 0.6::DOUBLE * greatest(0, 1 - mae / 50) + 0.4::DOUBLE * coalesce((d.type_id = o.type_id)::INT, 0) ELSE 0.3::DOUBLE * coalesce((d.type_id = o.type_id)::INT, 0) END AS DECIMAL(12,6)) sim
  FROM enough e LEFT JOIN sh USING (member_id) LEFT JOIN dom d USING (member_id) LEFT JOIN (SELECT type_id FROM dom WHERE member_id = 7) o ON true WHERE e.member_id <> 7),
 near AS (SELECT * FROM sim WHERE sim > 0.15 ORDER BY sim DESC, member_id LIMIT 50),
 agg AS (SELECT provider_id, CAST(floor(CAST(sum(score * sim) AS DOUBLE) / CAST(sum(sim) AS DOUBLE) + 0.5) AS BIGINT) predicted, count(*) user_count FROM known JOIN near USING (member_id) WHERE score >= 60 AND provider_id NOT IN (SELECT provider_id FROM last WHERE member_id = 7) GROUP BY 1)
 SELECT * FROM agg ORDER BY round(predicted * log2(user_count + 1), 6) DESC, provider_id LIMIT 20"""


@query("r05_recommend", _RECOMMEND)
def _(m: Model) -> DataFrame:
    return ranking.recommend(m.approved(), member=7)


@query("r06_compatibility")
def _(m: Model) -> DataFrame:
    return ranking.compatibility(m.approved(), member=7, providers=[1, 2, 3, 5, 8, 13, 21])


@query("r07_preference_map", ", mine AS (SELECT * FROM approved WHERE member_id = 7) SELECT type_id, count(*) n, CAST(floor(100 * count(*) / (SELECT count(*) FROM mine) + 0.5) AS BIGINT) pct FROM mine GROUP BY 1")
def _(m: Model) -> DataFrame:
    return ranking.shares(m.approved().where("member_id = 7"), [], "type_id", of_all=True)


@query("r08_provider_profile", "SELECT provider_id, type_id, n, CAST(floor(100 * n / sum(n) OVER (PARTITION BY provider_id) + 0.5) AS BIGINT) pct FROM (SELECT provider_id, type_id, count(*) n FROM approved GROUP BY 1, 2)")
def _(m: Model) -> DataFrame:
    return ranking.shares(m.approved(), ["provider_id"], "type_id")


def _consensus(c: str) -> str:
    """The value that most reviews of a provider agree on, and their share, in SQL."""
    return f"SELECT provider_id, {c}, CAST(floor(100 * n / total + 0.5) AS BIGINT) pct FROM (SELECT provider_id, {c}, count(*) n, sum(count(*)) OVER (PARTITION BY provider_id) total FROM approved GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY provider_id ORDER BY n DESC, {c}) = 1"


@query(
    "r08_full_profile",
    f", t AS ({_consensus('type_id')}), b AS ({_consensus('body_id')}), v AS ({_consensus('level_id')}), a AS (SELECT provider_id, count(*) n, round(avg(p1), 1) p1, round(avg(p2), 1) p2, round(avg(p3), 1) p3, round(avg(p4), 1) p4, list_sort(list(DISTINCT level_id)) levels FROM approved GROUP BY 1) SELECT provider_id, n, type_id, t.pct type_pct, body_id, b.pct body_pct, level_id, v.pct level_pct, array_to_string(levels, ',') levels, p1, p2, p3, p4 FROM a JOIN t USING (provider_id) JOIN b USING (provider_id) JOIN v USING (provider_id)",
)
def _(m: Model) -> DataFrame:
    return ranking.provider_profiles(m.approved()).withColumn("levels", F.array_join(F.col("levels").cast("array<string>"), ","))


@query("r12_confidence_gate", ", c AS (SELECT user_id, s / CAST(s + 2 * f AS DOUBLE) c FROM (SELECT user_id, count(*) FILTER (event_type <> 'error') s, count(*) FILTER (event_type = 'error') f FROM events GROUP BY 1)) SELECT CASE WHEN c >= 0.7 THEN 'rules' WHEN c >= 0.4 THEN 'sample' ELSE 'relearn' END gate, count(*) n FROM c GROUP BY 1")
def _(m: Model) -> DataFrame:
    s, f = F.count_if(F.col("event_type") != "error"), F.count_if(F.col("event_type") == "error")
    c = m.table("events").groupBy("user_id").agg((s / (s + 2 * f).cast("double")).alias("c"))
    gate = F.when(F.col("c") >= 0.7, "rules").when(F.col("c") >= 0.4, "sample").otherwise("relearn")
    return c.groupBy(gate.alias("gate")).agg(F.count("*").alias("n"))


# Linkage


@query("j17_waterfall", ", l AS (SELECT provider_id, name, brand, age FROM providers WHERE provider_id % 2 = 0), r AS (SELECT provider_id other_id, name, brand, age FROM providers WHERE provider_id % 2 = 1), a AS (SELECT l.provider_id, min(r.other_id) other_id FROM l JOIN r USING (name) GROUP BY 1), b AS (SELECT l.provider_id, min(r.other_id) other_id FROM l JOIN r USING (brand, age) WHERE l.provider_id NOT IN (SELECT provider_id FROM a) GROUP BY 1) SELECT *, 'name' AS method FROM a UNION ALL SELECT *, 'brand_age' FROM b")
def _(m: Model) -> DataFrame:
    left = m.providers().where("provider_id % 2 = 0")
    right = m.providers().where("provider_id % 2 = 1").withColumnRenamed("provider_id", "other_id").select("other_id", "name", "brand", "age")
    return linkage.waterfall(left, right, [("name", ["name"]), ("brand_age", ["brand", "age"])], "provider_id", "other_id")


_TWO_LISTS = """, l AS (SELECT DISTINCT l_suppkey * 1000000 + l_partkey entry_id, CASE WHEN l_partkey % 3 = 0 THEN 'v' || l_suppkey || '.example/item/' || l_partkey END url, CASE WHEN l_suppkey % 2 = 0 THEN 'v' || l_suppkey || '.example' END AS domain,
  'Shop ' || l_suppkey || CASE WHEN l_suppkey % 5 = 0 THEN ' annex' ELSE '' END venue, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A'),
 r AS (SELECT provider_id, CASE WHEN venue_id IS NOT NULL THEN 'v' || venue_id || '.example/item/' || provider_id END url, 'v' || venue_id || '.example' AS domain, 'Shop ' || venue_id venue, name FROM providers),
 a AS (SELECT entry_id, min(provider_id) provider_id FROM l JOIN r USING (url) GROUP BY 1),
 b AS (SELECT entry_id, min(provider_id) provider_id FROM l JOIN r ON l.domain = r.domain AND l.name = r.name WHERE entry_id NOT IN (SELECT entry_id FROM a) GROUP BY 1),
 o AS (SELECT DISTINCT venue FROM l), t AS (SELECT DISTINCT venue FROM r WHERE venue IS NOT NULL),
 v AS (SELECT o.venue ours, t.venue theirs FROM o JOIN t ON o.venue = t.venue OR (o.venue NOT IN (SELECT venue FROM t) AND (contains(o.venue, t.venue) OR contains(t.venue, o.venue)))),
 c AS (SELECT entry_id, min(provider_id) provider_id FROM l JOIN v ON l.venue = v.ours JOIN r ON r.venue = v.theirs AND r.name = l.name WHERE entry_id NOT IN (SELECT entry_id FROM a UNION ALL SELECT entry_id FROM b) GROUP BY 1)
 SELECT *, 'url' AS method FROM a UNION ALL SELECT *, 'domain_name' FROM b UNION ALL SELECT *, 'venue_name' FROM c"""


@query("j17_three_pass_waterfall", _TWO_LISTS)
def _(m: Model) -> DataFrame:
    """Pending reviews' pairs as one list, providers as the other: by address, by domain and name, by venue and name."""
    lines = m.table("lineitem").where("l_returnflag = 'A'").select("l_suppkey", "l_partkey").distinct()
    left = lines.join(m.table("part").select("p_partkey", "p_name"), F.expr("l_partkey = p_partkey")).selectExpr(
        "l_suppkey * 1000000 + l_partkey entry_id",
        "case when l_partkey % 3 = 0 then concat('HTTP://www.v', l_suppkey, '.example/item/', l_partkey, '/') end raw_url",
        "case when l_suppkey % 2 = 0 then concat('https://www.v', l_suppkey, '.example') end raw_domain",
        "concat('Shop ', l_suppkey, if(l_suppkey % 5 = 0, ' annex', '')) venue",
        "p_name name",
    )
    right = m.providers().selectExpr("provider_id", "concat('https://v', venue_id, '.example/item/', provider_id) raw_url", "concat('https://v', venue_id, '.example') raw_domain", "concat('Shop ', venue_id) venue", "name")
    left, right = (df.withColumns({"url": T.normalize_url(F.col("raw_url")), "domain": T.domain(F.col("raw_domain"))}) for df in (left, right))
    return linkage.three_pass_links(left, right, "entry_id", "provider_id", grams=5)


@query("j19_containment", ", v AS (SELECT venue_id, ltrim(split_part(name, '#', 2), '0') AS name FROM venues) SELECT a.venue_id, b.venue_id other_id FROM v a, v b WHERE (contains(a.name, b.name) OR contains(b.name, a.name)) AND length(a.name) >= 1 AND length(b.name) >= 1")
def _(m: Model) -> DataFrame:
    v = m.venues().select("venue_id", F.ltrim(F.split_part("name", F.lit("#"), F.lit(2)), F.lit("0")).alias("name"))
    other = v.withColumnRenamed("venue_id", "other")
    return linkage.link_contained(v, other, "name", "venue_id", "other", grams=1).withColumnRenamed("other_linked", "other_id")


@query("d09_merge_duplicates", ", d AS (SELECT doc_id, md5(text) k FROM documents), h AS (SELECT DISTINCT doc_id FROM labels), r AS (SELECT d.doc_id, k, row_number() OVER (PARTITION BY k ORDER BY (h.doc_id IS NULL), d.doc_id) rn, first_value(d.doc_id) OVER (PARTITION BY k ORDER BY (h.doc_id IS NULL), d.doc_id) keep FROM d LEFT JOIN h ON d.doc_id = h.doc_id) SELECT keep doc_id, count(*) children FROM labels JOIN r USING (doc_id) GROUP BY 1")
def _(m: Model) -> DataFrame:
    parents = m.table("documents").select("doc_id", F.md5("text").alias("k"))
    _, children = linkage.merge_duplicates(parents, m.table("labels"), "k", "doc_id")
    return children.groupBy("doc_id").agg(F.count("*").alias("children"))


# Hierarchy


@query("h03_keyword_conflicts", ", k AS (SELECT area_id, region_id, CAST(area_id % 3 AS BIGINT) lvl, CAST(area_id % 40 AS BIGINT) kw FROM areas), w AS (SELECT *, row_number() OVER (PARTITION BY kw, region_id ORDER BY lvl, area_id) rn, count(*) OVER (PARTITION BY kw) n, min(region_id) OVER (PARTITION BY kw) lo, max(region_id) OVER (PARTITION BY kw) hi FROM k) SELECT area_id, kw, CASE WHEN n = 1 THEN 'unique' WHEN rn > 1 THEN 'absorbed' WHEN lo <> hi THEN 'cross_region' ELSE 'kept' END outcome FROM w")
def _(m: Model) -> DataFrame:
    rows = m.areas().selectExpr("area_id", "region_id", "cast(area_id % 3 as bigint) lvl", "cast(area_id % 40 as bigint) kw")
    return hierarchy.resolve_keywords(rows, "kw", "region_id", "lvl", "area_id").select("area_id", "kw", "outcome")


_AT_HOME = ", c AS (SELECT area_id, count(*) n FROM venue_areas JOIN areas a USING (area_id) JOIN venues v USING (venue_id) WHERE a.region_id = v.region_id GROUP BY 1)"


def _at_home(m: Model) -> DataFrame:
    """(area_id, n): how many of an area's venues are of its region."""
    placed = m.venue_areas().join(m.areas().select("area_id", "region_id"), "area_id")
    return placed.join(m.venues().select("venue_id", "region_id"), ["venue_id", "region_id"]).groupBy("area_id").agg(F.count("*").alias("n"))


@query("h06_count_attach", _AT_HOME + " SELECT area_id, coalesce(n, -1) n FROM areas LEFT JOIN c USING (area_id) WHERE coalesce(n, -1) < 3")
def _(m: Model) -> DataFrame:
    return m.areas().select("area_id").join(_at_home(m), "area_id", "left").na.fill(-1, ["n"]).where("n < 3")


@query("h07_two_condition_exclusion", _AT_HOME + ", q AS (SELECT CAST(c_nationkey * 5 + list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment) - 1 AS BIGINT) area_id, count(*) volume FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' AND o_orderdate >= DATE '2001-07-25' GROUP BY 1) SELECT area_id, coalesce(n, 0) n, coalesce(volume, 0) volume FROM areas LEFT JOIN c USING (area_id) LEFT JOIN q USING (area_id) WHERE NOT (coalesce(n, 0) < 3 AND coalesce(volume, 0) = 0)")
def _(m: Model) -> DataFrame:
    k = F.expr("array_position(array('%s'), c_mktsegment) - 1" % "','".join(SEGMENTS))
    asked = m.table("orders").where("o_orderpriority = '1-URGENT' and o_orderdate >= date '2001-07-25'").join(m.table("customer"), F.expr("o_custkey = c_custkey"))
    volume = asked.groupBy((F.col("c_nationkey") * 5 + k).cast("bigint").alias("area_id")).agg(F.count("*").alias("volume"))
    joined = m.areas().select("area_id").join(_at_home(m), "area_id", "left").join(volume, "area_id", "left").na.fill(0, ["n", "volume"])
    return joined.where("not (n < 3 and volume = 0)")


@query("h10_path_hierarchy", ", p AS (SELECT DISTINCT regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1), '/+$', '') path FROM pages), s AS (SELECT path, list_filter(string_split(path, '/'), lambda x: x <> '') parts FROM p) SELECT path, CAST(len(parts) AS BIGINT) depth, list_extract(parts, -1) slug, list_extract(parts, -2) parent_slug FROM s WHERE len(parts) > 0")
def _(m: Model) -> DataFrame:
    return hierarchy.path_rows(m.table("pages"), "url")


# Maintenance


@query("d01_upsert", ", t AS (SELECT venue_id, name, region_id FROM venues WHERE venue_id <= 8), s AS (SELECT venue_id, CASE WHEN venue_id % 2 = 0 THEN NULL ELSE upper(name) END AS name, region_id + 100 region_id FROM venues WHERE venue_id BETWEEN 5 AND 10) SELECT coalesce(t.venue_id, s.venue_id) venue_id, CASE WHEN s.venue_id IS NULL THEN t.name ELSE coalesce(s.name, t.name) END AS name, CASE WHEN s.venue_id IS NULL THEN t.region_id ELSE s.region_id END region_id, CASE WHEN t.venue_id IS NULL THEN 'inserted' WHEN s.venue_id IS NULL THEN 'kept' ELSE 'updated' END action FROM t FULL JOIN s ON t.venue_id = s.venue_id")
def _(m: Model) -> DataFrame:
    venues = m.venues().select("venue_id", "name", "region_id")
    source = venues.where("venue_id between 5 and 10").selectExpr("venue_id", "case when venue_id % 2 = 0 then null else upper(name) end name", "region_id + 100 region_id")
    return maintain.upsert(venues.where("venue_id <= 8"), source, ["venue_id"], keep_if_null=["name"])


_MERGED = "SELECT provider_id, member_id, max(score) score, max(venue_id) venue_id FROM reviews WHERE member_id IS NOT NULL AND status = '{}' GROUP BY 1, 2"


@query("d01_upsert_full", f", t AS ({_MERGED.format('approved')}), s AS ({_MERGED.format('pending')}) SELECT coalesce(t.provider_id, s.provider_id) provider_id, coalesce(t.member_id, s.member_id) member_id, CASE WHEN s.provider_id IS NULL THEN t.score ELSE coalesce(s.score, t.score) END score, CASE WHEN s.provider_id IS NULL THEN t.venue_id ELSE s.venue_id END venue_id, CASE WHEN t.provider_id IS NULL THEN 'inserted' WHEN s.provider_id IS NULL THEN 'kept' ELSE 'updated' END action FROM t FULL JOIN s ON t.provider_id = s.provider_id AND t.member_id = s.member_id")
def _(m: Model) -> DataFrame:
    rows = m.reviews().where("member_id is not null").groupBy("status", "provider_id", "member_id").agg(F.max("score").alias("score"), F.max("venue_id").alias("venue_id"))
    return maintain.upsert(rows.where("status = 'approved'").drop("status"), rows.where("status = 'pending'").drop("status"), ["provider_id", "member_id"], keep_if_null=["score"])


@query("d04_fail_streak", ", l AS (SELECT user_id, max((ts, event_id)) AS at FROM events WHERE event_type <> 'error' GROUP BY 1) SELECT u.user_id, count(e.event_id) streak FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN l ON l.user_id = u.user_id LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = 'error' AND (l.at IS NULL OR (e.ts, e.event_id) > l.at) GROUP BY 1")
def _(m: Model) -> DataFrame:
    log = m.table("events").withColumn("ok", F.col("event_type") != "error")
    return maintain.fail_streak(log, "user_id", ["ts", "event_id"], "ok")


@query("d05_retire_missing", ", t AS (SELECT DISTINCT venue_id, provider_id FROM approved), n AS (SELECT DISTINCT venue_id, provider_id FROM reviews WHERE status = 'rejected' AND created_at >= TIMESTAMP '1993-01-01') SELECT venue_id, provider_id FROM t WHERE venue_id IN (SELECT venue_id FROM n) AND (venue_id, provider_id) NOT IN (SELECT (venue_id, provider_id) FROM n)")
def _(m: Model) -> DataFrame:
    active = m.approved_scores().select("venue_id", "provider_id").distinct()
    latest = m.reviews().where("status = 'rejected' and created_at >= timestamp '1993-01-01'").select("venue_id", "provider_id").distinct()
    return maintain.retire_missing(active, latest, "venue_id", "provider_id").select("venue_id", "provider_id")


@query("d06_counters", "SELECT user_id, count(*) FILTER (event_type = 'view') view_count, count(*) FILTER (event_type = 'purchase') purchase_count FROM events GROUP BY 1")
def _(m: Model) -> DataFrame:
    return maintain.counters(m.table("events"), "user_id", "event_type", ["view", "purchase"])


@query(
    "d06_floored_counters",
    ", o AS (SELECT user_id, event_type, ts, event_id, CASE WHEN event_type IN ('click', 'purchase') THEN 1 WHEN event_type IN ('error', 'view') THEN -1 END d FROM events), s AS (SELECT user_id, sum(coalesce(d, 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) s, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) k FROM o) SELECT user_id, CAST(max(s) FILTER (k = 1) - least(min(s), 0) AS BIGINT) n FROM s GROUP BY 1",
)
def _(m: Model) -> DataFrame:
    change = F.when(F.col("event_type").isin("click", "purchase"), 1).when(F.col("event_type").isin("error", "view"), -1)
    return floored_counters(m.table("events").withColumn("d", change), "user_id", ["ts", "event_id"], "d")


@query("d08_fan_out", ", f AS (SELECT DISTINCT a.user_id follower, b.user_id followed FROM events a JOIN events b ON a.user_id = (b.user_id + 1) % 150 WHERE a.event_type = 'signup' AND b.event_type = 'signup') SELECT follower recipient, event_id FROM events JOIN f ON user_id = followed WHERE event_type = 'purchase' AND follower <> user_id")
def _(m: Model) -> DataFrame:
    signed = m.table("events").where("event_type = 'signup'").select("user_id").distinct()
    follows = signed.select(F.col("user_id").alias("follower")).join(signed.select(F.col("user_id").alias("followed")), F.expr("follower = (followed + 1) % 150"))
    return maintain.fan_out(m.table("events").where("event_type = 'purchase'"), follows, "user_id")


@query("d10_violations", "SELECT 'score_range' AS rule, count(*) FILTER (NOT (score BETWEEN 10 AND 90)) n FROM reviews UNION ALL SELECT 'member', count(*) FILTER (member_id IS NULL) FROM reviews UNION ALL SELECT 'unique', (SELECT count(*) FROM (SELECT provider_id, member_id FROM reviews GROUP BY 1, 2 HAVING count(*) > 1))")
def _(m: Model) -> DataFrame:
    checks = {"score_range": F.col("score").between(10, 90), "member": F.col("member_id").isNotNull()}
    return maintain.violations(m.reviews(), checks, unique=["provider_id", "member_id"])


@query("d12_first_match", "SELECT page_id, CASE WHEN url LIKE '%.html%' THEN 'file' WHEN url LIKE '%page=%' THEN 'listing' WHEN url LIKE 'http:%' THEN 'plain' ELSE 'other' END kind FROM pages")
def _(m: Model) -> DataFrame:
    u = F.col("url")
    cases = [(u.contains(".html"), "file"), (u.contains("page="), "listing"), (u.startswith("http:"), "plain")]
    return m.table("pages").select("page_id", maintain.first_match(cases, "other").alias("kind"))


@query("d14_expire", "SELECT review_id, CASE WHEN created_at + INTERVAL 7 DAY < TIMESTAMP '2001-11-05' THEN 0 ELSE p1 END credits FROM reviews")
def _(m: Model) -> DataFrame:
    rows = m.reviews().withColumn("until", F.expr("created_at + interval 7 days")).withColumnRenamed("p1", "credits")
    return maintain.expire(rows, AS_OF, "credits", "until").select("review_id", "credits")


@query("d15_spend_credits", ", r AS (SELECT user_id, event_id % 5 item, event_id, ts FROM events WHERE event_type = 'purchase'), f AS (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY min((ts, event_id)), item) n FROM r GROUP BY 1, 2) SELECT r.event_id, f.n <= r.user_id % 4 granted FROM r JOIN f USING (user_id, item)")
def _(m: Model) -> DataFrame:
    requests = m.table("events").where("event_type = 'purchase'").selectExpr("user_id", "event_id % 5 item", "event_id", "ts")
    credits = requests.select("user_id").distinct().withColumn("credits", F.col("user_id") % 4)
    return maintain.spend_in_order(requests, credits, "user_id", ["ts", "event_id"], "item").select("event_id", "granted")


_LEDGER = """, p AS (SELECT user_id, event_id, event_type, ts, CAST(json_extract(props, '$.k') AS BIGINT) k FROM events),
 o AS (SELECT user_id, event_id id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) i, k % 20 item, epoch_us(ts) t,
  CASE WHEN event_type = 'signup' THEN 'grant' WHEN event_type = 'error' THEN 'tier' WHEN event_type = 'view' AND k % 7 = 0 THEN 'keep' ELSE 'unlock' END kind,
  CASE WHEN event_type = 'signup' THEN 2 WHEN event_type = 'error' AND k < 20 THEN 1 ELSE 0 END credits FROM p),
 l AS (SELECT user_id, CAST(0 AS BIGINT) i, CAST(0 AS BIGINT) c, CAST(NULL AS BIGINT) u, false paid, CAST([] AS BIGINT[]) opened, CAST([] AS BIGINT[]) kept, CAST(NULL AS BIGINT) id, CAST(NULL AS VARCHAR) reason FROM (SELECT DISTINCT user_id FROM o)
  UNION ALL SELECT user_id, i,
   CASE WHEN kind = 'grant' THEN c + credits WHEN reason = 'expired' THEN 0 WHEN reason = 'spent' THEN c - 1 ELSE c END,
   CASE WHEN kind = 'grant' THEN t + 604800000000 WHEN reason = 'expired' THEN NULL ELSE u END,
   CASE WHEN kind = 'tier' THEN credits > 0 ELSE paid END,
   CASE WHEN reason = 'spent' AND NOT list_contains(opened, item) THEN list_append(opened, item) ELSE opened END,
   CASE WHEN kind = 'keep' AND NOT list_contains(kept, item) THEN list_append(kept, item) ELSE kept END, id, reason
  FROM (SELECT o.user_id, o.i, o.id, o.item, o.t, o.kind, o.credits, l.c, l.u, l.paid, l.opened, l.kept,
   CASE WHEN o.kind <> 'unlock' THEN NULL WHEN l.paid THEN 'tier' WHEN list_contains(l.kept, o.item) THEN 'kept' WHEN list_contains(l.opened, o.item) AND coalesce(l.u > o.t, false) THEN 'open'
    WHEN NOT coalesce(l.u >= o.t, false) THEN 'expired' WHEN l.c > 0 THEN 'spent' ELSE 'empty' END reason FROM l JOIN o ON o.user_id = l.user_id AND o.i = l.i + 1))
 SELECT user_id, id, reason NOT IN ('expired', 'empty') granted, reason, c credits FROM l WHERE reason IS NOT NULL"""


def ledger_events(events: DataFrame) -> DataFrame:
    """Events as what a ledger of credits takes: grants, tiers, items kept for good, and requests."""
    rows = events.withColumn("k", F.from_json("props", "k bigint")["k"])
    kind = F.when(F.col("event_type") == "signup", "grant").when(F.col("event_type") == "error", "tier").when((F.col("event_type") == "view") & (F.col("k") % 7 == 0), "keep").otherwise("unlock")
    credits = F.when(F.col("event_type") == "signup", 2).when((F.col("event_type") == "error") & (F.col("k") < 20), 1).otherwise(0)
    return rows.select("user_id", F.col("event_id").alias("id"), kind.alias("kind"), (F.col("k") % 20).alias("item"), credits.cast("long").alias("credits"), F.col("ts").alias("at"))


@query("d15_credit_ledger", _LEDGER)
def _(m: Model) -> DataFrame:
    rows = ledger_events(m.table("events")).withColumn("at", F.unix_micros(F.col("at").cast("timestamp")))
    return ledger.fold_in_order(rows, "user_id", ["at", "id"], ledger.Unlocks())


@query(
    "t06_expired_credits",
    ", g AS (SELECT user_id, event_id, epoch_us(ts) // 1000 ms, CAST(json_extract(props, '$.k') AS BIGINT) k FROM events WHERE event_type = 'signup'), n AS (SELECT *, CASE WHEN ms > lag(ms) OVER w + 172800000 THEN 1 ELSE 0 END new FROM g WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) run FROM n) SELECT user_id AS user, min(ms) first_ms, max(ms) + 172800000 ended_ms, CAST(sum(k) AS BIGINT) credits FROM r GROUP BY user_id, run",
)
def _(m: Model) -> DataFrame:
    grants = m.table("events").where("event_type = 'signup'").withColumn("credits", F.from_json("props", "k bigint")["k"])
    return keyed.ended_sessions(grants, "user_id", "event_id", "credits", "ts", days=2)


@query("d16_batch_increment", "SELECT venue_id, count(i) views FROM venues LEFT JOIN (VALUES (1), (2), (2), (5), (999999)) t(i) ON venue_id = i GROUP BY 1")
def _(m: Model) -> DataFrame:
    seen = m.spark.createDataFrame([([1, 2, 2, 5, 999999],)], "ids array<bigint>").select(F.explode("ids").alias("venue_id")).groupBy("venue_id").agg(F.count("*").alias("views"))
    return m.venues().select("venue_id").join(F.broadcast(seen), "venue_id", "left").na.fill(0)


@query("d17_publish_batch", ", c AS (SELECT v.venue_id, 1 + count(p.provider_id) pages FROM venues v LEFT JOIN providers p USING (venue_id) WHERE v.published_at IS NULL GROUP BY 1), t AS (SELECT *, sum(pages) OVER (ORDER BY venue_id) running, row_number() OVER (ORDER BY venue_id) rn FROM c), d AS (SELECT * FROM t WHERE running <= 200 OR rn = 1) SELECT count(*) published, CAST(coalesce(sum(pages), 0) AS BIGINT) pages, (SELECT count(*) FROM c) - count(*) remaining FROM d")
def _(m: Model) -> DataFrame:
    pages = m.venues().where("published_at is null").select("venue_id").join(m.providers(), "venue_id", "left").groupBy("venue_id").agg((1 + F.count("provider_id")).alias("pages"))
    done = maintain.budgeted_prefix(pages, "venue_id", "pages", 200)
    total = pages.agg(F.count("*").alias("n")).scalar()
    return done.agg(F.count("*").alias("published"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages")).withColumn("remaining", total - F.col("published"))


@query("d19_session_cap", "SELECT user_id, event_type, max(ts) ts FROM events GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, event_type) <= 2")
def _(m: Model) -> DataFrame:
    return maintain.capped_sessions(m.table("events").select("user_id", "event_type", "ts"), "user_id", "event_type", "ts")


@query("d20_duplicate_transactions", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) k, min(event_id) first_id, count(*) times FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING count(*) > 1")
def _(m: Model) -> DataFrame:
    rows = m.table("events").where("event_type = 'purchase'").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
    return rows.groupBy("k").agg(F.min("event_id").alias("first_id"), F.count("*").alias("times")).where("times > 1")


@query("d22_toggles", ", o AS (SELECT user_id, event_id % 7 item, event_type, ts, event_id FROM events WHERE event_type IN ('click', 'view')) SELECT user_id, item FROM o QUALIFY row_number() OVER (PARTITION BY user_id, item ORDER BY ts DESC, event_id DESC) = 1 AND event_type = 'click' AND user_id <> item")
def _(m: Model) -> DataFrame:
    ops = m.table("events").where("event_type in ('click', 'view')").selectExpr("user_id", "event_id % 7 item", "if(event_type = 'click', 'add', 'remove') op", "ts", "event_id")
    return maintain.latest_toggles(ops, ["user_id", "item"], ["ts", "event_id"])


@query("d24_validated_insert", "SELECT review_id, CASE WHEN NOT coalesce(score >= 20, false) THEN 'score' ELSE '' END || CASE WHEN member_id IS NULL THEN 'member' ELSE '' END broken FROM reviews WHERE NOT coalesce(score >= 20, false) OR member_id IS NULL")
def _(m: Model) -> DataFrame:
    _, bad = maintain.validated(m.reviews(), {"score": F.col("score") >= 20, "member": F.col("member_id").isNotNull()})
    return bad.select("review_id", F.array_join("broken", "").alias("broken"))


# Pages


@query("e01_title", "SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) title FROM pages")
def _(m: Model) -> DataFrame:
    return m.table("pages").select("page_id", F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"))


#: The shown text of the tables' pages in SQL: hidden elements and comments go, tags part runs, then entities.
_SHOWN = """, p AS (SELECT page_id, html, regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<!doctype[^>]*>|<script\\b.*?</script>|<style\\b.*?</style>', chr(10), 'g'), '</?[a-zA-Z][^>]*>', chr(10), 'g') x FROM pages),
 s AS (SELECT page_id, html, array_to_string(list_filter(list_transform(string_split(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), chr(10)), lambda v: trim(v)), lambda v: v <> ''), chr(10)) shown FROM p)"""


@query("e02_visible_text", _SHOWN + " SELECT page_id, shown AS text FROM s")
def _(m: Model) -> DataFrame:
    from rankweave.operators.html import visible_text

    return m.table("pages").select("page_id", visible_text(F.col("html")).alias("text"))


@query("e03_links", "SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<a[^>]+href=\"([^\"]+)\"', 1))) href FROM pages")
def _(m: Model) -> DataFrame:
    from rankweave.operators.html import links

    return m.table("pages").select("page_id", F.explode(links(F.col("html"))).alias("href"))


@query("e09_thin_pages", _SHOWN + """ SELECT page_id, length(shown) < 200 OR (regexp_matches(html, '(?i)<div[^>]+id="(app|root)"') AND length(shown) < 500) thin FROM s""")
def _(m: Model) -> DataFrame:
    from rankweave.operators.html import visible_text

    n = F.length(visible_text(F.col("html")))
    shell = F.col("html").rlike(r'(?i)<div[^>]+id="(app|root)"')
    return m.table("pages").select("page_id", ((n < 200) | (shell & (n < 500))).alias("thin"))


@query("e14_failure_class", "SELECT page_id, CASE WHEN html IS NULL THEN 'missing' WHEN length(html) < 200 THEN 'short' WHEN html ILIKE '%404 not found%' THEN 'gone' ELSE 'ok' END outcome FROM pages")
def _(m: Model) -> DataFrame:
    h = F.col("html")
    cases = [(h.isNull(), "missing"), (F.length(h) < 200, "short"), (h.ilike("%404 not found%"), "gone")]
    return m.table("pages").select("page_id", maintain.first_match(cases, "ok").alias("outcome"))
