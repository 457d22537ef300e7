"""Counts and pages, flat files, merges on several keys, moderation, neighbours: each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.operators import maintain
from rankweave.operators.html import page_title
from rankweave.plans.registry import query
from rankweave.sources import sinks
from rankweave.sources.model import Model


@query("s03_csv_rows", "SELECT doc_id, lang, source, CAST(n_chars AS VARCHAR) n_chars FROM documents")
def _(m: Model) -> DataFrame:
    """Documents' columns as CSV lines and back, every value a string first."""
    columns = ["doc_id", "lang", "source", "n_chars"]
    lines = m.table("documents").select(F.to_csv(F.struct(*[F.col(c).cast("string") for c in columns])).alias("line"))
    row = F.from_csv("line", "doc_id string, lang string, source string, n_chars string")
    return lines.select(row.alias("r")).select(F.col("r.doc_id").cast("bigint").alias("doc_id"), "r.lang", "r.source", "r.n_chars")


@query("s05_nested_results", "SELECT conv_id, CAST(turn AS BIGINT) turn, role FROM conversations")
def _(m: Model) -> DataFrame:
    """A JSON document for each conversation with its turns nested, and their rows out of it."""
    turns = m.table("conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("turn").cast("bigint").alias("turn"), "role")).alias("results"))  # bounded by a conversation
    documents = turns.select(F.to_json(F.struct("conv_id", "results")).alias("document"))
    read = F.from_json("document", "conv_id bigint, results array<struct<turn: bigint, role: string>>")
    return documents.select(read.alias("d")).select("d.conv_id", F.explode("d.results").alias("r")).select("conv_id", "r.turn", "r.role")


@query("s06_jsonl_lines", "SELECT venue_id, name, region_id FROM venues")
def _(m: Model) -> DataFrame:
    lines = m.venues().select(F.to_json(F.struct("venue_id", "name", "region_id")).alias("line"))
    return lines.select(F.from_json("line", "venue_id bigint, name string, region_id bigint").alias("r")).select("r.*")


@query("s13_count_only", "SELECT (SELECT count(*) FROM venues) venues, (SELECT count(*) FROM reviews) reviews, (SELECT count(*) FROM members) members")
def _(m: Model) -> DataFrame:
    count = lambda df, name: df.agg(F.count("*").alias(name))
    one = lambda df, name: count(df, name).scalar().alias(name)
    return m.spark.range(1).select(one(m.venues(), "venues"), one(m.reviews(), "reviews"), one(m.members(), "members"))


@query("s14_page_with_total", ", n AS (SELECT count(*) total FROM approved) SELECT review_id, score, total FROM approved, n ORDER BY score DESC NULLS LAST, review_id LIMIT 20 OFFSET 40")
def _(m: Model) -> DataFrame:
    rows = m.approved().select("review_id", "score")
    page = rows.orderBy(F.desc_nulls_last("score"), "review_id").offset(40).limit(20)
    return page.withColumn("total", rows.agg(F.count("*")).scalar())


@query("s15_load_then_validate", "SELECT 'member' \"check\", count(*) bad FROM reviews WHERE member_id IS NOT NULL AND member_id NOT IN (SELECT member_id FROM members) UNION ALL SELECT 'venue', count(*) FROM reviews WHERE venue_id NOT IN (SELECT venue_id FROM venues) UNION ALL SELECT 'score', count(*) FROM reviews WHERE score < 0 OR score > 100")
def _(m: Model) -> DataFrame:
    """Rows that break a reference or a range, counted after all of them are in."""
    rows = m.reviews().select("member_id", "venue_id", "score")
    member = rows.where("member_id is not null").join(m.members().select("member_id"), "member_id", "left_anti")
    venue = rows.join(m.venues().select("venue_id"), "venue_id", "left_anti")
    bad = lambda name, df: df.agg(F.count("*").alias("bad")).select(F.lit(name).alias("check"), "bad")
    return bad("member", member).union(bad("venue", venue)).union(bad("score", rows.where("score < 0 or score > 100")))


_BY_THREE = "SELECT provider_id, member_id, type_id, max(score) score FROM reviews WHERE member_id IS NOT NULL AND status = '{}' GROUP BY 1, 2, 3"


@query("d03_upsert_triple", f", t AS ({_BY_THREE.format('approved')}), s AS ({_BY_THREE.format('pending')}) SELECT coalesce(t.provider_id, s.provider_id) provider_id, coalesce(t.member_id, s.member_id) member_id, coalesce(t.type_id, s.type_id) type_id, coalesce(s.score, t.score) score, CASE WHEN t.provider_id IS NULL THEN 'inserted' WHEN s.provider_id IS NULL THEN 'kept' ELSE 'updated' END action FROM t FULL JOIN s ON t.provider_id = s.provider_id AND t.member_id = s.member_id AND t.type_id = s.type_id")
def _(m: Model) -> DataFrame:
    keys = ["provider_id", "member_id", "type_id"]
    rows = m.reviews().where("member_id is not null").groupBy("status", *keys).agg(F.max("score").alias("score"))
    return maintain.upsert(rows.where("status = 'approved'").drop("status"), rows.where("status = 'pending'").drop("status"), keys, keep_if_null=["score"])


@query("d13_moderation_once", ", c AS (SELECT review_id, min(member_id) member_id, min(created_at) decided_at, CASE WHEN max(score) >= 50 THEN 10 ELSE 5 END credits, count(*) decisions FROM reviews WHERE status IN ('approved', 'rejected') AND member_id IS NOT NULL GROUP BY 1 HAVING bool_or(status = 'approved')) SELECT review_id, member_id, credits, CAST(decided_at AS TIMESTAMP) + INTERVAL 7 DAY expires_at, decisions > 1 repeated FROM c")
def _(m: Model) -> DataFrame:
    """A review is decided once, however often its decision arrives: one grant, which ends after seven days."""
    decided = m.reviews().where("status in ('approved', 'rejected') and member_id is not null")
    once = decided.groupBy("review_id").agg(
        F.min("member_id").alias("member_id"), F.min("created_at").alias("at"), F.max("score").alias("score"), F.count("*").alias("n"), F.bool_or(F.col("status") == "approved").alias("granted")
    )
    expires = F.col("at").cast("timestamp_ntz") + F.expr("interval 7 days")
    return once.where("granted").select("review_id", "member_id", F.when(F.col("score") >= 50, 10).otherwise(5).alias("credits"), expires.alias("expires_at"), (F.col("n") > 1).alias("repeated"))


@query("h04_nearby_areas", ", o AS (SELECT a.area_id, b.slug, row_number() OVER (PARTITION BY a.area_id ORDER BY b.area_id) n FROM areas a JOIN areas b ON a.region_id = b.region_id AND a.area_id <> b.area_id) SELECT a.area_id, r.name group_name, coalesce(string_agg(o.slug, '|' ORDER BY o.n) FILTER (o.n <= 5), '') nearby FROM areas a JOIN regions r ON r.region_id = a.region_id LEFT JOIN o ON o.area_id = a.area_id GROUP BY 1, 2")
def _(m: Model) -> DataFrame:
    """Up to five other areas of the group, in the order of their ids; a row needs only its next six."""
    areas = m.areas().select("area_id", "region_id", "slug")
    w = Window.partitionBy("region_id").orderBy("area_id")
    placed = areas.withColumn("n", F.row_number().over(w))
    first = placed.where("n <= 6").groupBy("region_id").agg(F.array_sort(F.collect_list(F.struct("n", "area_id", "slug"))).alias("first"))
    near = F.slice(F.filter("first", lambda x: x["area_id"] != F.col("area_id")), 1, 5)
    named = m.table("nation").selectExpr("cast(n_nationkey as bigint) region_id", "n_name group_name")
    return areas.join(first, "region_id").join(named, "region_id").select("area_id", "group_name", F.array_join(F.transform(near, lambda x: x["slug"]), "|").alias("nearby"))


@query("d20_subscriptions", ", e AS (SELECT DISTINCT event_id, user_id, event_type, ts FROM events WHERE event_type IN ('purchase', 'click')) SELECT user_id, CASE arg_max(event_type, (ts, event_id)) WHEN 'purchase' THEN 'active' ELSE 'ended' END status, count(*) FILTER (event_type = 'purchase') paid, count(*) n FROM e GROUP BY 1")
def _(m: Model) -> DataFrame:
    """A transaction counts once; a customer's latest one decides whether the subscription goes on."""
    rows = m.table("events").where("event_type in ('purchase', 'click')").dropDuplicates(["event_id"])
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    return rows.groupBy("user_id").agg(F.when(last == "purchase", "active").otherwise("ended").alias("status"), F.count_if(F.col("event_type") == "purchase").alias("paid"), F.count("*").alias("n"))


@query("d23_mark_read", ", c AS (SELECT user_id, max(ts) seen FROM events WHERE event_type = 'click' GROUP BY 1) SELECT e.event_id, coalesce(e.ts <= c.seen, false) \"read\" FROM events e LEFT JOIN c USING (user_id)")
def _(m: Model) -> DataFrame:
    """All of a user's messages up to the last click are read."""
    seen = m.table("events").where("event_type = 'click'").groupBy("user_id").agg(F.max("ts").alias("seen"))
    rows = m.table("events").select("event_id", "user_id", "ts").join(seen, "user_id", "left")
    return rows.select("event_id", F.coalesce(F.col("ts") <= F.col("seen"), F.lit(False)).alias("read"))


@query("d11_ordered_guards", ", a AS (SELECT provider_id, CASE WHEN size > 40 THEN trim(name) || ' ' || brand WHEN size > 20 THEN '' ELSE trim(name) END AS name, brand, size FROM providers), b AS (SELECT provider_id, CASE WHEN name = '' THEN brand ELSE name END AS name, CASE WHEN name = '' THEN NULL ELSE size END AS size FROM a) SELECT provider_id, regexp_replace(name, ' Brand#[0-9]+$', '') AS name, coalesce(size, 0) AS size FROM b")
def _(m: Model) -> DataFrame:
    """Three updates, each seeing what the one before left, and each only where its guard holds."""
    rows = m.providers().select("provider_id", F.expr("case when size > 40 then concat(trim(name), ' ', brand) when size > 20 then '' else trim(name) end name"), "brand", "size")
    empty = F.col("name") == ""
    rows = rows.withColumns({"name": F.when(empty, F.col("brand")).otherwise(F.col("name")), "size": F.when(~empty, F.col("size"))})
    rows = rows.withColumn("name", F.regexp_replace("name", " Brand#[0-9]+$", "")).withColumn("size", F.coalesce("size", F.lit(0)))
    return rows.select("provider_id", "name", "size")


@query("h05_adopted_sources", ", s AS (SELECT 0 o, 'ranked' source, a.slug, a.region_id FROM areas a WHERE a.area_id IN (SELECT area_id FROM venue_areas WHERE display_order <= 3) UNION ALL SELECT 1, 'listed', a.slug, a.region_id FROM areas a WHERE a.region_id IN (SELECT region_id FROM published) UNION ALL SELECT 2, 'region', slug, region_id FROM regions UNION ALL SELECT 3, 'all', slug, -1 FROM areas) SELECT slug, arg_min(source, o) source, arg_min(region_id, o) region_id, string_agg(source, ',' ORDER BY o) reasons FROM s GROUP BY 1")
def _(m: Model) -> DataFrame:
    """Four sources; a slug keeps the fields of the first that has it, and the names of all."""
    areas = m.areas().select("area_id", "slug", "region_id")
    ranked = areas.join(m.venue_areas().where("display_order <= 3").select("area_id"), "area_id", "left_semi")
    listed = areas.join(m.published().select("region_id"), "region_id", "left_semi")
    parts = [("ranked", ranked), ("listed", listed), ("region", m.regions()), ("all", areas.withColumn("region_id", F.lit(-1)))]
    rows = [df.select(F.lit(i).alias("o"), F.lit(name).alias("source"), "slug", F.col("region_id").cast("bigint").alias("region_id")) for i, (name, df) in enumerate(parts)]
    every = rows[0].union(rows[1]).union(rows[2]).union(rows[3])
    best = every.groupBy("slug").agg(F.min(F.struct("o", "source", "region_id")).alias("x"), F.array_sort(F.collect_set(F.struct("o", "source"))).alias("all"))  # four at most
    return best.select("slug", "x.source", "x.region_id", F.array_join("all.source", ",").alias("reasons"))


@query("h08_keyword_batches", ", v AS (SELECT a.area_id, upper(a.name) || '  ' keyword, count(p.venue_id) volume FROM areas a LEFT JOIN venue_areas p USING (area_id) GROUP BY 1, 2) SELECT a.area_id, a.name original, lower(replace(a.name, ' ', '')) cleaned, max(v.volume) volume, CAST(a.area_id // 20 AS BIGINT) batch FROM areas a LEFT JOIN v ON lower(replace(v.keyword, ' ', '')) = lower(replace(a.name, ' ', '')) GROUP BY 1, 2, 3, 5")
def _(m: Model) -> DataFrame:
    """Volumes meet keywords by their cleaned form; batches of 20 in the order of ids."""
    clean = lambda c: F.lower(F.replace(c, F.lit(" "), F.lit("")))
    areas = m.areas().select("area_id", F.col("name").alias("original"), clean(F.col("name")).alias("cleaned"))
    counted = m.areas().join(m.venue_areas().select("area_id", "venue_id"), "area_id", "left").groupBy("area_id", "name").agg(F.count("venue_id").alias("volume"))
    volumes = counted.groupBy(clean(F.concat(F.upper("name"), F.lit("  "))).alias("cleaned")).agg(F.max("volume").alias("volume"))
    return sinks.paged(areas, "area_id", 20).join(volumes, "cleaned", "left").select("area_id", "original", "cleaned", "volume", F.col("page_no").alias("batch"))


@query("e01_titles", "SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), ''), lang) title FROM (SELECT *, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) lang FROM (SELECT page_id, CASE WHEN url LIKE '%.net/%' THEN regexp_replace(html, '(?is)<title>.*?</title>', '') ELSE html END html FROM pages))")
def _(m: Model) -> DataFrame:
    """The title, else og:title in either order of its attributes; hosts in net have the latter only."""
    lang = F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    meta = F.concat(F.lit('<meta content="'), lang, F.lit('" property="og:title">'))
    html = F.when(F.col("url").like("%.net/%"), F.regexp_replace("html", "(?is)<title>.*?</title>", meta)).otherwise(F.col("html"))
    return m.table("pages").select("page_id", page_title(html).alias("title"))
