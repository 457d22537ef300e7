"""Scans, filters, joins, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.operators.linkage import equal_pairs
from rankweave.operators.ranking import dominant, js_round, shares
from rankweave.operators.ordered import running_total
from rankweave.plans.registry import query
from rankweave.sources.model import Model

# Scans


@query("s01_scan_project", "SELECT area_id, region_id, name, slug FROM areas")
def _(m: Model) -> DataFrame:
    return m.areas().select("area_id", "region_id", "name", "slug")


@query("s02_scan_all", "SELECT * FROM region")
def _(m: Model) -> DataFrame:
    return m.table("region")


@query("s11_row_to_json_round_trip", "SELECT venue_id, name, region_id, is_active FROM venues")
def _(m: Model) -> DataFrame:
    rows = m.venues().select("venue_id", "name", "region_id", "is_active")
    return rows.select(F.from_json(F.to_json(F.struct("*")), rows.schema).alias("r")).select("r.*")


@query("s12_sitemap_rows", "SELECT venue_id, CAST(ceil(row_number() OVER (ORDER BY venue_id) / 25.0) AS BIGINT) file_no, '<url><loc>/venue/' || venue_id || '</loc><name>' || replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</name></url>' AS entry FROM published")
def _(m: Model) -> DataFrame:
    from rankweave.sources.sinks import sitemap_rows

    return sitemap_rows(m.published(), "venue_id", "/venue/", per_file=25)


# Filters


@query("f01_equality", "SELECT provider_id, name FROM providers WHERE status = 'active' AND brand <> 'Brand#11'")
def _(m: Model) -> DataFrame:
    return m.providers().where((F.col("status") == "active") & (F.col("brand") != "Brand#11")).select("provider_id", "name")


@query("f02_range", "SELECT review_id, score FROM reviews WHERE score BETWEEN 60 AND 80")
def _(m: Model) -> DataFrame:
    return m.reviews().where(F.col("score").between(60, 80)).select("review_id", "score")


@query("f03_in_list", "SELECT review_id, type_id FROM reviews WHERE type_id IN (2, 5, 7)")
def _(m: Model) -> DataFrame:
    return m.reviews().where(F.col("type_id").isin(2, 5, 7)).select("review_id", "type_id")


@query("f04_null_tests", "SELECT venue_id FROM venues WHERE published_at IS NOT NULL")
def _(m: Model) -> DataFrame:
    return m.venues().where(F.col("published_at").isNotNull()).select("venue_id")


@query("f05_ilike", "SELECT venue_id, name FROM venues WHERE name ILIKE '%supplier#0000000_1%'")
def _(m: Model) -> DataFrame:
    return m.venues().where(F.col("name").ilike("%supplier#0000000_1%")).select("venue_id", "name")


@query("f06_escaped_like", "SELECT page_id FROM pages WHERE contains(lower(url), 'utm_source')")
def _(m: Model) -> DataFrame:
    from rankweave.functions.text import contains_ignoring_case

    return m.table("pages").where(contains_ignoring_case(F.col("url"), "UTM_source")).select("page_id")


@query("f07_disjunction", "SELECT provider_id FROM providers WHERE name ILIKE '%1%' OR brand ILIKE '%#2%'")
def _(m: Model) -> DataFrame:
    return m.providers().where(F.col("name").ilike("%1%") | F.col("brand").ilike("%#2%")).select("provider_id")


@query("f08_placeholder_filter", "SELECT doc_id FROM documents WHERE NOT (text ILIKE '%the%' OR text ILIKE '%coming soon%' OR text ILIKE '%sample%') AND text <> '---'")
def _(m: Model) -> DataFrame:
    from rankweave.functions.text import none_of

    return m.table("documents").where(none_of(F.col("text"), ["the", "coming soon", "sample"]) & (F.col("text") != "---")).select("doc_id")


@query("f12_regex", "SELECT page_id FROM pages WHERE regexp_matches(url, '/(fr|de)/[0-9]+') AND NOT regexp_matches(url, '(?i)PAGE=')")
def _(m: Model) -> DataFrame:
    return m.table("pages").where(F.col("url").rlike("/(fr|de)/[0-9]+") & ~F.col("url").rlike("(?i)PAGE=")).select("page_id")


@query("f13_distinct_from", "SELECT review_id FROM reviews WHERE score IS DISTINCT FROM 50")
def _(m: Model) -> DataFrame:
    return m.reviews().where(~F.col("score").eqNullSafe(50)).select("review_id")


@query("f14_staleness", "SELECT venue_id, latest FROM (SELECT v.venue_id, max(r.created_at) latest FROM venues v LEFT JOIN reviews r USING (venue_id) GROUP BY 1) WHERE latest IS NULL OR latest < TIMESTAMP '2001-11-05' - INTERVAL 5 DAY")
def _(m: Model) -> DataFrame:
    latest = m.venues().join(m.reviews().groupBy("venue_id").agg(F.max("created_at").alias("latest")), "venue_id", "left")
    return latest.where(F.col("latest").isNull() | (F.col("latest") < F.expr("timestamp '2001-11-05' - interval 5 days"))).select("venue_id", "latest")


@query("f15_json_emptiness", "SELECT event_id FROM events WHERE props IS NULL OR CAST(json_extract(props, '$.k') AS INT) = 0")
def _(m: Model) -> DataFrame:
    return m.table("events").where(F.col("props").isNull() | (F.get_json_object("props", "$.k").cast("int") == 0)).select("event_id")


@query("f16_min_query_length", "SELECT doc_id, q, length(q) >= CASE WHEN regexp_matches(q, '[^\\x00-\\x7F]') THEN 2 ELSE 3 END AS runs FROM (SELECT doc_id, substr(text, 1, CAST(1 + doc_id % 4 AS INT)) q FROM documents)")
def _(m: Model) -> DataFrame:
    """Searches by the first one to four characters of each document."""
    from rankweave.functions.text import long_enough_query

    asked = m.table("documents").selectExpr("doc_id", "substr(text, 1, cast(1 + doc_id % 4 as int)) q")
    return asked.select("doc_id", "q", long_enough_query(F.col("q")).alias("runs"))


@query("f17_substring", "SELECT provider_id FROM providers WHERE contains(name, '7') OR contains(brand, '#3')")
def _(m: Model) -> DataFrame:
    return m.providers().where(F.col("name").contains("7") | F.col("brand").contains("#3")).select("provider_id")


@query("f19_self_exclusion", "SELECT venue_id FROM venues WHERE venue_id <> 5")
def _(m: Model) -> DataFrame:
    return m.venues().where("venue_id <> 5").select("venue_id")


@query("f22_secure_view", "SELECT review_id FROM reviews WHERE member_id = 7 OR status = 'approved' OR EXISTS (SELECT 1 FROM members WHERE member_id = 7 AND balance > 9000)")
def _(m: Model) -> DataFrame:
    admin = m.members().where("member_id = 7 and balance > 9000").agg((F.count("*") > 0).alias("a")).scalar()
    return m.reviews().where((F.col("member_id") == 7) | (F.col("status") == "approved") | admin).select("review_id")


@query("f23_page", "SELECT venue_id FROM venues ORDER BY venue_id LIMIT 20 OFFSET 20")
def _(m: Model) -> DataFrame:
    return m.venues().orderBy("venue_id").offset(20).limit(20).select("venue_id")


# Joins


@query("j01_left_embed", "SELECT p.provider_id, v.name venue_name FROM providers p LEFT JOIN venues v USING (venue_id)")
def _(m: Model) -> DataFrame:
    venue = m.venues().select("venue_id", F.struct("venue_id", "name").alias("venue"))
    return m.providers().join(venue, "venue_id", "left").select("provider_id", F.col("venue.name").alias("venue_name"))


@query("j02_nested_embed", "SELECT va.venue_id, va.area_id, a.name area_name, r.name region_name FROM venue_areas va LEFT JOIN areas a USING (area_id) LEFT JOIN regions r ON a.region_id = r.region_id")
def _(m: Model) -> DataFrame:
    area = m.areas().join(F.broadcast(m.regions().select("region_id", F.struct("name").alias("region"))), "region_id", "left").select("area_id", F.struct("name", "region").alias("area"))
    return m.venue_areas().join(F.broadcast(area), "area_id", "left").select("venue_id", "area_id", F.col("area.name").alias("area_name"), F.col("area.region.name").alias("region_name"))


@query("j03_semi_through_bridge", "SELECT venue_id, name FROM venues WHERE venue_id IN (SELECT venue_id FROM venue_areas JOIN areas USING (area_id) WHERE region_id = 3)")
def _(m: Model) -> DataFrame:
    inside = m.venue_areas().join(F.broadcast(m.areas().where("region_id = 3")), "area_id")
    return m.venues().join(inside, "venue_id", "left_semi").select("venue_id", "name")


@query("j04_parent_with_children", "SELECT region_id, string_agg(slug, '|' ORDER BY slug) area_slugs, count(*) n FROM areas GROUP BY 1")
def _(m: Model) -> DataFrame:
    return m.areas().groupBy("region_id").agg(F.array_join(F.sort_array(F.collect_list("slug")), "|").alias("area_slugs"), F.count("*").alias("n"))


@query("j05_join_preaggregates", "SELECT v.venue_id, coalesce(r.n, 0) review_count, coalesce(p.n, 0) provider_count FROM venues v LEFT JOIN (SELECT venue_id, count(*) n FROM approved WHERE score IS NOT NULL GROUP BY 1) r USING (venue_id) LEFT JOIN (SELECT venue_id, count(*) n FROM providers GROUP BY 1) p USING (venue_id)")
def _(m: Model) -> DataFrame:
    reviews = m.approved().where("score is not null").groupBy("venue_id").agg(F.count("*").alias("review_count"))
    providers = m.providers().groupBy("venue_id").agg(F.count("*").alias("provider_count"))
    return m.venues().select("venue_id").join(reviews, "venue_id", "left").join(providers, "venue_id", "left").na.fill(0)


@query("j06_lateral_latest", "SELECT v.venue_id, max(r.created_at) latest FROM venues v LEFT JOIN approved r USING (venue_id) GROUP BY 1")
def _(m: Model) -> DataFrame:
    return m.venues().select("venue_id").join(m.approved().groupBy("venue_id").agg(F.max("created_at").alias("latest")), "venue_id", "left")


@query("j07_not_exists", "SELECT venue_id FROM venues v WHERE NOT EXISTS (SELECT 1 FROM providers p WHERE p.venue_id = v.venue_id AND p.age > 60)")
def _(m: Model) -> DataFrame:
    return m.venues().join(m.providers().where("age > 60"), "venue_id", "left_anti").select("venue_id")


@query("j08_not_in", "SELECT member_id FROM members WHERE member_id NOT IN (SELECT member_id FROM reviews WHERE member_id IS NOT NULL)")
def _(m: Model) -> DataFrame:
    # NOT IN itself is a join that broadcasts all reviews; without nulls on the right it is an anti join,
    # but for a null on the left, which is only outside an empty list.
    found = m.reviews().where("member_id is not null").select("member_id").distinct()
    return m.members().join(found, "member_id", "left_anti").where(F.col("member_id").isNotNull() | ~found.limit(1).exists()).select("member_id")


@query("j09_left_join_zero", "SELECT a.area_id FROM areas a LEFT JOIN venue_areas va USING (area_id) GROUP BY 1 HAVING count(va.venue_id) < 40")
def _(m: Model) -> DataFrame:
    return m.areas().join(m.venue_areas(), "area_id", "left").groupBy("area_id").agg(F.count("venue_id").alias("n")).where("n < 40").select("area_id")


@query("j10_exists", "SELECT member_id FROM members m WHERE EXISTS (SELECT 1 FROM reviews r WHERE r.member_id = m.member_id AND r.score >= 98)")
def _(m: Model) -> DataFrame:
    return m.members().join(m.reviews().where("score >= 98"), "member_id", "left_semi").select("member_id")


@query("j11_update_from_aggregate", "SELECT p.provider_id, coalesce(r.n, 0) review_count, CAST(r.avg_score AS DOUBLE) avg_score FROM providers p LEFT JOIN (SELECT provider_id, count(*) n, CAST(avg(score) AS DECIMAL(5,1)) avg_score FROM approved WHERE score IS NOT NULL GROUP BY 1) r USING (provider_id)")
def _(m: Model) -> DataFrame:
    stats = m.approved().where("score is not null").groupBy("provider_id").agg(F.count("*").alias("review_count"), F.avg("score").cast("decimal(5,1)").cast("double").alias("avg_score"))
    return m.providers().select("provider_id").join(stats, "provider_id", "left").na.fill(0, ["review_count"])


@query("j12_ordered_lookup", "SELECT CAST(pos AS BIGINT) pos, venue_id, name FROM (VALUES (0, 9), (1, 3), (2, 7), (3, 1)) w(pos, id) JOIN venues ON id = venue_id ORDER BY pos")
def _(m: Model) -> DataFrame:
    wanted = m.spark.createDataFrame([(i, v) for i, v in enumerate([9, 3, 7, 1])], "pos long, venue_id long")
    return m.venues().join(F.broadcast(wanted), "venue_id").select("pos", "venue_id", "name").orderBy("pos")


@query("j13_list_join", ", l AS (SELECT a.region_id, b.name, row_number() OVER (PARTITION BY a.region_id ORDER BY b.name) - 1 pos FROM regions a JOIN regions b ON a.grp = b.grp) SELECT l.region_id, CAST(pos AS BIGINT) pos, n.region_id near_id FROM l JOIN regions n ON n.name = l.name WHERE pos < 3")
def _(m: Model) -> DataFrame:
    texts = m.regions().groupBy("grp").agg(F.array_join(F.slice(F.sort_array(F.collect_list("name")), 1, 3), "|").alias("near"))
    listed = m.regions().join(texts, "grp").select("region_id", F.posexplode(F.split("near", r"\|")).alias("pos", "name"))
    names = m.regions().select(F.col("region_id").alias("near_id"), "name")
    return listed.join(F.broadcast(names), "name").select("region_id", F.col("pos").cast("bigint").alias("pos"), "near_id")


@query("j14_ranked_then_rest", ", ranked AS (SELECT venue_id, row_number() OVER (ORDER BY n DESC, venue_id) rk FROM (SELECT venue_id, count(*) n FROM approved GROUP BY 1 ORDER BY n DESC, venue_id LIMIT 10)) SELECT venue_id, row_number() OVER (ORDER BY rk NULLS LAST, venue_id) AS rank FROM published LEFT JOIN ranked USING (venue_id)")
def _(m: Model) -> DataFrame:
    top = m.approved().groupBy("venue_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "venue_id").limit(10)
    ranked = top.withColumn("rk", F.row_number().over(Window.orderBy(F.desc("n"), "venue_id")))  # ten rows
    joined = m.published().select("venue_id").join(F.broadcast(ranked), "venue_id", "left")
    return running_total(joined, [F.asc_nulls_last("rk"), "venue_id"], number="rank").select("venue_id", "rank")


@query("j15_self_join", "SELECT a.provider_id, b.provider_id other_id FROM providers a JOIN providers b ON a.name = b.name AND a.provider_id <> b.provider_id")
def _(m: Model) -> DataFrame:
    # a name's pairs grow with the square of its providers
    return equal_pairs(m.providers(), "name", "provider_id", "other_id")


@query("j18_unambiguous_link", "SELECT name, min(provider_id) provider_id FROM providers GROUP BY name HAVING count(*) = 1")
def _(m: Model) -> DataFrame:
    return m.providers().groupBy("name").agg(F.min("provider_id").alias("provider_id"), F.count("*").alias("n")).where("n = 1").drop("n")


@query("j21_region_to_providers", "SELECT provider_id FROM providers WHERE venue_id IN (SELECT venue_id FROM venue_areas JOIN areas a USING (area_id) JOIN regions r ON a.region_id = r.region_id WHERE r.slug = 'france')")
def _(m: Model) -> DataFrame:
    areas = m.areas().join(F.broadcast(m.regions().where("slug = 'france'").select("region_id")), "region_id", "left_semi")
    venues = m.venue_areas().join(F.broadcast(areas), "area_id", "left_semi").select("venue_id")
    return m.providers().join(venues, "venue_id", "left_semi").select("provider_id")


@query("j23_coverage", ", a AS (SELECT DISTINCT venue_id FROM venue_areas WHERE area_id = 7), b AS (SELECT DISTINCT venue_id FROM approved) SELECT count(b.venue_id) covered, count(*) - count(b.venue_id) gap, round(100.0 * count(b.venue_id) / count(*), 1) pct FROM a LEFT JOIN b USING (venue_id)")
def _(m: Model) -> DataFrame:
    a, b = m.venue_areas().where("area_id = 7").select("venue_id").distinct(), m.approved().select("venue_id").distinct()
    joined = a.join(b.withColumn("hit", F.lit(1)), "venue_id", "left")
    return joined.agg(F.count("hit").alias("covered"), (F.count("*") - F.count("hit")).alias("gap"), F.round(100.0 * F.count("hit") / F.count("*"), 1).alias("pct"))


# Aggregates


@query("a01_venue_stats", "SELECT venue_id, count(*) n, CAST(CAST(avg(score) AS DECIMAL(5,1)) AS DOUBLE) avg_score, CAST(sum(score) AS BIGINT) total, max(score) best FROM approved WHERE score IS NOT NULL GROUP BY 1")
def _(m: Model) -> DataFrame:
    return m.approved().where("score is not null").groupBy("venue_id").agg(F.count("*").alias("n"), F.avg("score").cast("decimal(5,1)").cast("double").alias("avg_score"), F.sum("score").alias("total"), F.max("score").alias("best"))


@query("a02_null_as_zero", "SELECT provider_id, CAST(sum(coalesce(score, 0)) AS BIGINT) total, count(*) n FROM approved GROUP BY 1")
def _(m: Model) -> DataFrame:
    return m.approved().groupBy("provider_id").agg(F.sum(F.coalesce("score", F.lit(0))).alias("total"), F.count("*").alias("n"))


@query("a03_distinct_sets", "SELECT provider_id, count(*) n, CAST(sum(coalesce(score, 0)) AS BIGINT) total, array_to_string(list_sort(list_distinct(list(type_id))), ',') types, array_to_string(list_sort(list_distinct(list(level_id))), ',') levels FROM approved GROUP BY 1")
def _(m: Model) -> DataFrame:
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)).cast("array<string>"), ",")
    return m.approved().groupBy("provider_id").agg(F.count("*").alias("n"), F.sum(F.coalesce("score", F.lit(0))).alias("total"), joined("type_id").alias("types"), joined("level_id").alias("levels"))


@query("a04_having_rounded", "SELECT provider_id, CAST(floor(sum(coalesce(score, 0)) / count(*) + 0.5) AS BIGINT) avg_score FROM approved GROUP BY 1 HAVING floor(sum(coalesce(score, 0)) / count(*) + 0.5) >= 50")
def _(m: Model) -> DataFrame:
    return m.approved().groupBy("provider_id").agg(js_round(F.sum(F.coalesce("score", F.lit(0))) / F.count("*")).alias("avg_score")).where("avg_score >= 50")


@query("a05_having_distinct", "SELECT name, count(DISTINCT venue_id) venues FROM providers GROUP BY 1 HAVING count(DISTINCT venue_id) >= 2")
def _(m: Model) -> DataFrame:
    return m.providers().groupBy("name").agg(F.countDistinct("venue_id").alias("venues")).where("venues >= 2")


@query("a06_duplicate_groups", "SELECT md5(text) AS digest, array_to_string(list_sort(list(doc_id)), ',') ids FROM documents GROUP BY text HAVING count(*) > 1")
def _(m: Model) -> DataFrame:
    groups = m.table("documents").groupBy("text").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"), F.count("*").alias("n")).where("n > 1")
    return groups.select(F.md5("text").alias("digest"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("a07_count_filter", "SELECT count(*) n, count(*) FILTER (score IS NULL) unscored, count(DISTINCT venue_id) venues FROM reviews")
def _(m: Model) -> DataFrame:
    return m.reviews().agg(F.count("*").alias("n"), F.count_if(F.col("score").isNull()).alias("unscored"), F.countDistinct("venue_id").alias("venues"))


@query("a08_global_average", "SELECT CAST(CAST(coalesce(avg(score), 74) AS DECIMAL(5,1)) AS DOUBLE) mean FROM approved")
def _(m: Model) -> DataFrame:
    return m.approved().agg(F.coalesce(F.avg("score"), F.lit(74.0)).cast("decimal(5,1)").cast("double").alias("mean"))


_BRACKETS = [(0, 0), (1, 2), (3, 5), (6, 10), (11, 20), (21, 50), (51, 100)]


@query("a09_histogram", "SELECT CASE WHEN n <= 0 THEN '0-0' WHEN n <= 2 THEN '1-2' WHEN n <= 5 THEN '3-5' WHEN n <= 10 THEN '6-10' WHEN n <= 20 THEN '11-20' WHEN n <= 50 THEN '21-50' WHEN n <= 100 THEN '51-100' ELSE '101+' END bracket, count(*) providers FROM (SELECT provider_id, count(*) n FROM approved GROUP BY 1) GROUP BY 1")
def _(m: Model) -> DataFrame:
    bracket = F.lit("101+")
    for low, high in reversed(_BRACKETS):
        bracket = F.when(F.col("n") <= high, f"{low}-{high}").otherwise(bracket)
    return m.approved().groupBy("provider_id").agg(F.count("*").alias("n")).groupBy(bracket.alias("bracket")).agg(F.count("*").alias("providers"))


@query("a10_case_groups", "SELECT CASE WHEN published_at IS NULL THEN 'draft' WHEN is_active THEN 'live' ELSE 'closed' END state, count(*) n FROM venues GROUP BY 1 ORDER BY n DESC, state")
def _(m: Model) -> DataFrame:
    state = F.when(F.col("published_at").isNull(), "draft").when(F.col("is_active"), "live").otherwise("closed")
    return m.venues().groupBy(state.alias("state")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "state")


@query("a11_most_common", "SELECT source, count(*) n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 5")
def _(m: Model) -> DataFrame:
    return m.table("documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(5)


@query("a12_shares_of_known", "SELECT type_id, n, CAST(floor(100 * n / sum(n) OVER () + 0.5) AS BIGINT) pct FROM (SELECT type_id, count(*) n FROM approved WHERE score IS NOT NULL GROUP BY 1)")
def _(m: Model) -> DataFrame:
    return shares(m.approved().where("score is not null"), [], "type_id")


@query("a13_shares_of_all", ", x AS (SELECT CASE WHEN score IS NULL THEN NULL ELSE level_id END level_id FROM approved) SELECT level_id, count(*) n, CAST(floor(100 * count(*) / (SELECT count(*) FROM x) + 0.5) AS BIGINT) pct FROM x WHERE level_id IS NOT NULL GROUP BY 1")
def _(m: Model) -> DataFrame:
    rows = m.approved().select(F.when(F.col("score").isNotNull(), F.col("level_id")).alias("level_id"))
    return shares(rows, [], "level_id", of_all=True)


@query("a14_average_default", "SELECT member_id, CAST(round(coalesce(avg(p1), 3), 1) AS DOUBLE) p1 FROM (SELECT m.member_id, r.p1 FROM members m LEFT JOIN approved r ON m.member_id = r.member_id) GROUP BY 1")
def _(m: Model) -> DataFrame:
    joined = m.members().select("member_id").join(m.approved().select("member_id", "p1"), "member_id", "left")
    return joined.groupBy("member_id").agg(F.round(F.coalesce(F.avg("p1"), F.lit(3.0)), 1).alias("p1"))


@query("a15_dominant_type", "SELECT provider_id, type_id FROM (SELECT provider_id, type_id, row_number() OVER (PARTITION BY provider_id ORDER BY count(*) DESC, type_id) rn FROM approved GROUP BY 1, 2) WHERE rn = 1")
def _(m: Model) -> DataFrame:
    return dominant(m.approved(), "provider_id", "type_id")


@query("a16_counter_rollup", "SELECT user_id, count(*) FILTER (event_type = 'view') views, count(*) FILTER (event_type = 'click') clicks FROM events GROUP BY 1")
def _(m: Model) -> DataFrame:
    kinds = {"views": "view", "clicks": "click"}
    return m.table("events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == v).alias(k) for k, v in kinds.items()])


@query("a17_union_counts", "SELECT 'venues' AS name, count(*) n FROM venues UNION ALL SELECT 'providers', count(*) FROM providers UNION ALL SELECT 'reviews', count(*) FROM reviews")
def _(m: Model) -> DataFrame:
    out = None
    for name, rows in (("venues", m.venues()), ("providers", m.providers()), ("reviews", m.reviews())):
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("a18_counts_for_ids", "SELECT venue_id, count(p.provider_id) n FROM (SELECT * FROM venues WHERE venue_id IN (1, 2, 3)) LEFT JOIN providers p USING (venue_id) GROUP BY 1")
def _(m: Model) -> DataFrame:
    return m.venues().where(F.col("venue_id").isin(1, 2, 3)).join(m.providers(), "venue_id", "left").groupBy("venue_id").agg(F.count("provider_id").alias("n"))


@query("a19_latest_rollup", "SELECT region_id, max(created_at) latest FROM venues JOIN approved USING (venue_id) GROUP BY 1")
def _(m: Model) -> DataFrame:
    return m.approved().groupBy("venue_id").agg(F.max("created_at").alias("latest")).join(m.venues().select("venue_id", "region_id"), "venue_id").groupBy("region_id").agg(F.max("latest").alias("latest"))


@query("a20_hierarchy", "SELECT grp, string_agg(name, ',' ORDER BY region_id) region_names, count(*) n FROM regions GROUP BY 1")
def _(m: Model) -> DataFrame:
    listed = F.transform(F.sort_array(F.collect_list(F.struct("region_id", "name"))), lambda x: x["name"])
    return m.regions().groupBy("grp").agg(F.array_join(listed, ",").alias("region_names"), F.count("*").alias("n"))


@query("a21_grand_total", "SELECT CAST(sum(n) AS BIGINT) total FROM (SELECT area_id, count(*) n FROM venue_areas GROUP BY 1)")
def _(m: Model) -> DataFrame:
    return m.venue_areas().groupBy("area_id").agg(F.count("*").alias("n")).agg(F.sum("n").alias("total"))


@query("a22_quality_ratio", "SELECT lang, round(count(*) FILTER (n_chars >= 500) / count(*), 3) ratio, count(*) FILTER (n_chars >= 500) / count(*) >= 0.7 passes FROM documents GROUP BY 1")
def _(m: Model) -> DataFrame:
    ratio = F.count_if(F.col("n_chars") >= 500) / F.count("*")
    return m.table("documents").groupBy("lang").agg(F.round(ratio, 3).alias("ratio"), (ratio >= 0.7).alias("passes"))


@query("a23_match_statistics", "SELECT status, count(*) n, round(100.0 * count(*) / (SELECT count(*) FROM reviews), 1) rate FROM reviews GROUP BY 1")
def _(m: Model) -> DataFrame:
    total = m.reviews().agg(F.count("*").alias("n")).scalar()
    return m.reviews().groupBy("status").agg(F.count("*").alias("n")).withColumn("rate", F.round(100.0 * F.col("n") / total, 1))


@query("a24_confidence", "SELECT user_id, round(s / CAST(s + 2 * f AS DOUBLE), 6) confidence FROM (SELECT user_id, count(*) FILTER (event_type <> 'error') s, count(*) FILTER (event_type = 'error') f FROM events GROUP BY 1)")
def _(m: Model) -> DataFrame:
    s, f = F.count_if(F.col("event_type") != "error"), F.count_if(F.col("event_type") == "error")
    return m.table("events").groupBy("user_id").agg(F.round(s / (s + 2 * f).cast("double"), 6).alias("confidence"))


@query("a25_distinct", "SELECT DISTINCT venue_id FROM reviews")
def _(m: Model) -> DataFrame:
    return m.reviews().select("venue_id").distinct()


# Windows


@query("w02_budgeted_prefix", ", c AS (SELECT v.venue_id, 1 + count(p.provider_id) pages FROM venues v LEFT JOIN providers p USING (venue_id) GROUP BY 1), t AS (SELECT *, sum(pages) OVER (ORDER BY venue_id) running, row_number() OVER (ORDER BY venue_id) rn FROM c) SELECT venue_id, pages, CAST(running AS BIGINT) running FROM t WHERE running <= 100 OR rn = 1")
def _(m: Model) -> DataFrame:
    from rankweave.operators.maintain import budgeted_prefix

    pages = m.venues().select("venue_id").join(m.providers(), "venue_id", "left").groupBy("venue_id").agg((1 + F.count("provider_id")).alias("pages"))
    return budgeted_prefix(pages, "venue_id", "pages", 100)


@query("w03_dense_rank_ids", "SELECT provider_id, dense_rank() OVER (ORDER BY name) person_id FROM providers")
def _(m: Model) -> DataFrame:
    from rankweave.operators.linkage import identity_numbers

    return identity_numbers(m.providers(), "name").select("provider_id", "person_id")


@query("w04_top_k_per_group", "SELECT venue_id, provider_id, rn FROM (SELECT venue_id, provider_id, row_number() OVER (PARTITION BY venue_id ORDER BY n DESC, provider_id) rn FROM (SELECT p.venue_id, p.provider_id, count(r.review_id) n FROM providers p LEFT JOIN approved r USING (provider_id) GROUP BY 1, 2)) WHERE rn <= 10")
def _(m: Model) -> DataFrame:
    counts = m.approved().groupBy("provider_id").agg(F.count("*").alias("n"))
    joined = m.providers().select("venue_id", "provider_id").join(counts, "provider_id", "left").na.fill(0, ["n"])
    order = Window.partitionBy("venue_id").orderBy(F.desc("n"), "provider_id")
    return joined.withColumn("rn", F.row_number().over(order).cast("bigint")).where("rn <= 10").select("venue_id", "provider_id", "rn")


@query("w05_first_per_group", "SELECT name, min(provider_id) provider_id FROM providers GROUP BY 1")
def _(m: Model) -> DataFrame:
    return m.providers().groupBy("name").agg(F.min("provider_id").alias("provider_id"))


@query("w06_latest_per_group", "SELECT venue_id, review_id FROM approved QUALIFY row_number() OVER (PARTITION BY venue_id ORDER BY created_at DESC, review_id) = 1")
def _(m: Model) -> DataFrame:
    latest = Window.partitionBy("venue_id").orderBy(F.desc("created_at"), "review_id")
    return m.approved().withColumn("rn", F.row_number().over(latest)).where("rn = 1").select("venue_id", "review_id")


@query("w08_siblings", "SELECT region_id, area_id, (SELECT string_agg(slug, '|' ORDER BY slug) FROM (SELECT b.slug FROM areas b WHERE b.region_id = a.region_id AND b.area_id <> a.area_id ORDER BY b.slug LIMIT 5)) siblings FROM areas a")
def _(m: Model) -> DataFrame:
    listed = m.areas().withColumn("all", F.sort_array(F.collect_list(F.struct("slug", "area_id")).over(Window.partitionBy("region_id"))))
    others = F.slice(F.filter("all", lambda x: x["area_id"] != F.col("area_id")), 1, 5)
    return listed.select("region_id", "area_id", F.array_join(F.transform(others, lambda x: x["slug"]), "|").alias("siblings"))


@query("w09_duplicate_suffix", "SELECT provider_id, name || CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN '-' || row_number() OVER (PARTITION BY name ORDER BY provider_id) ELSE '' END slug FROM providers")
def _(m: Model) -> DataFrame:
    same = Window.partitionBy("name")
    suffix = F.when(F.count("*").over(same) > 1, F.concat(F.lit("-"), F.row_number().over(same.orderBy("provider_id")))).otherwise("")
    return m.providers().select("provider_id", F.concat("name", suffix).alias("slug"))


# Sorts


@query("o01_order_limit", "SELECT review_id, score FROM reviews WHERE score IS NOT NULL ORDER BY score DESC, review_id LIMIT 25")
def _(m: Model) -> DataFrame:
    return m.reviews().where("score is not null").orderBy(F.desc("score"), "review_id").limit(25).select("review_id", "score")


@query("o03_null_order", "SELECT review_id FROM reviews ORDER BY score ASC NULLS FIRST, review_id LIMIT 25")
def _(m: Model) -> DataFrame:
    return m.reviews().orderBy(F.asc_nulls_first("score"), "review_id").limit(25).select("review_id")


@query("o04_boolean_first", "SELECT v.venue_id FROM venues v LEFT JOIN (SELECT DISTINCT venue_id, true has FROM approved) r USING (venue_id) ORDER BY coalesce(has, false) DESC, venue_id LIMIT 15")
def _(m: Model) -> DataFrame:
    has = m.approved().select("venue_id").distinct().withColumn("has", F.lit(True))
    return m.venues().join(has, "venue_id", "left").orderBy(F.coalesce("has", F.lit(False)).desc(), "venue_id").limit(15).select("venue_id")


@query("o06_priority_order", "SELECT venue_id FROM venues ORDER BY CASE WHEN is_active THEN 0 WHEN published_at IS NOT NULL THEN 1 ELSE 2 END, venue_id LIMIT 30")
def _(m: Model) -> DataFrame:
    priority = F.when(F.col("is_active"), 0).when(F.col("published_at").isNotNull(), 1).otherwise(2)
    return m.venues().orderBy(priority, "venue_id").limit(30).select("venue_id")


@query("o10_priority_fill", ", n AS (SELECT p.provider_id, count(r.review_id) n FROM providers p LEFT JOIN approved r USING (provider_id) WHERE p.provider_id NOT IN (1, 2, 3) GROUP BY 1) SELECT provider_id, CAST(CASE WHEN n > 0 THEN 0 ELSE 1 END AS BIGINT) tier FROM n ORDER BY tier, n DESC, provider_id LIMIT 40")
def _(m: Model) -> DataFrame:
    counts = m.approved().groupBy("provider_id").agg(F.count("*").alias("n"))
    done = m.spark.createDataFrame([(1,), (2,), (3,)], "provider_id long")
    rows = m.providers().select("provider_id").join(F.broadcast(done), "provider_id", "left_anti").join(counts, "provider_id", "left").na.fill(0, ["n"])
    return rows.withColumn("tier", F.when(F.col("n") > 0, 0).otherwise(1).cast("bigint")).orderBy("tier", F.desc("n"), "provider_id").limit(40).select("provider_id", "tier")


@query("o11_seeded_sample", "SELECT provider_id FROM providers ORDER BY md5('7:' || provider_id), provider_id LIMIT 10")
def _(m: Model) -> DataFrame:
    return m.providers().select("provider_id").orderBy(F.md5(F.concat(F.lit("7:"), F.col("provider_id").cast("string"))), "provider_id").limit(10)


# Sets


@query("u01_union_distinct", "SELECT venue_id FROM published UNION SELECT venue_id FROM approved")
def _(m: Model) -> DataFrame:
    return m.published().select("venue_id").union(m.approved().select("venue_id")).distinct()


@query("u02_union_all", "SELECT user_id FROM events WHERE event_type = 'signup' UNION ALL SELECT user_id FROM events WHERE event_type = 'purchase'")
def _(m: Model) -> DataFrame:
    of = lambda kind: m.table("events").where(F.col("event_type") == kind).select("user_id")
    return of("signup").unionByName(of("purchase"))


@query("u04_difference", "SELECT member_id FROM members EXCEPT SELECT member_id FROM approved")
def _(m: Model) -> DataFrame:
    return m.members().select("member_id").subtract(m.approved().select("member_id"))


@query("u05_keep_first", "SELECT min(doc_id) doc_id FROM documents GROUP BY text")
def _(m: Model) -> DataFrame:
    return m.table("documents").groupBy(F.sha2("text", 256).alias("h"), F.length("text").alias("n")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
