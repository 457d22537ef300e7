"""Further queries: names and readings, fingerprints, extraction, streams' batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions import directory as D
from rankweave.functions import text as T
from rankweave.operators import cards, classify, html, maintain, ranking
from rankweave.operators.components import merge_parents
from rankweave.operators.ordered import running_total
from rankweave.plans.registry import query
from rankweave.sources.model import AS_OF, Model
from rankweave.streaming import jobs


def _formed(m: Model, *forms: str) -> DataFrame:
    """(provider_id, v or v1, v2, ...): texts of each provider's columns, by expressions that DuckDB knows, too."""
    names = ["v"] if len(forms) == 1 else [f"v{i}" for i in range(1, len(forms) + 1)]
    return m.providers().select("provider_id", *[F.expr(f).alias(n) for f, n in zip(forms, names)])


_AGENTS = "CASE provider_id % 5 WHEN 0 THEN concat('Mozilla/5.0 (', brand, ')') WHEN 1 THEN concat(name, 'Bot/2') WHEN 2 THEN '' WHEN 3 THEN concat('curl/', size) ELSE ' ' END"
_SHOPS = "CASE provider_id % 3 WHEN 0 THEN concat('東京「', name, '」本店') WHEN 1 THEN concat('東京 ', name, ' 店') ELSE name END"
_TITLES = "CASE provider_id % 4 WHEN 0 THEN concat('Home | ', split_part(name, ' ', 2)) WHEN 1 THEN concat(split_part(name, ' ', 2), ' - top') WHEN 2 THEN concat(split_part(name, ' ', 2), ' | Home') ELSE '-' END"
_HALF = "concat(translate(concat('', provider_id), '0123456789', 'ｱｲｳｴｵｶｷｸｹｺ'), 'ｶﾞｰﾊﾟ', brand)"
_PARENTS = "CASE provider_id % 3 WHEN 0 THEN concat(brand, '・', name) WHEN 1 THEN concat(brand, '（', name, '）') ELSE '広島・福山' END"
_SIDES = "CASE provider_id % 4 WHEN 0 THEN concat('東', substr(name, 1, 3), '駅') WHEN 1 THEN concat(substr(name, 1, 3), '駅') WHEN 2 THEN concat('西', name, '口') ELSE concat('新', size, '口') END"
_TAILS = "CASE provider_id % 4 WHEN 0 THEN concat(brand, '(', age, ')') WHEN 1 THEN concat(brand, '【NEW】today') WHEN 2 THEN concat(brand, ' 10:00-18:00') ELSE concat(brand, 'さん') END"
_SIGNS = "CASE provider_id % 3 WHEN 0 THEN concat('【new】', name, ' 東京店') WHEN 1 THEN concat('★', name, '★') ELSE concat('【', brand, '】') END"
_BRACKETS = "CASE provider_id % 3 WHEN 0 THEN concat(name, '（ローズ）') WHEN 1 THEN concat(name, '(リリー)') ELSE name END"
_HOURS = "CASE provider_id % 3 WHEN 0 THEN concat(10 + size % 10, ':00~24:00') WHEN 1 THEN concat('12:00〜翌', size % 10, ':30 (last 4:00)') ELSE name END"
_REPLIES = """CASE provider_id % 3 WHEN 0 THEN concat('ok ```json', chr(10), '{"n": ', size, '}', chr(10), '```') WHEN 1 THEN concat('so {"n": ', size, '} yes') ELSE name END"""
_SPECS = "CASE provider_id % 4 WHEN 0 THEN concat(age, '歳 T', 140 + size) WHEN 1 THEN concat('AGE ', age, ' ', 140 + size, 'cm') WHEN 2 THEN concat('身長 ', 140 + size) ELSE '-' END"
_READINGS = "CASE provider_id % 3 WHEN 0 THEN concat(brand, 'x') WHEN 1 THEN concat(brand, ' ', size) ELSE 'none' END"


def _values(m: Model, rows: list, schema: str = "v string") -> DataFrame:
    return m.spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)


@query("s07_delimited_lines", "SELECT review_id, CAST(0 AS INT) line_no, strftime(created_at, '%Y/%m/%d') date, score, 'text, with comma' AS text FROM reviews")
def _(m: Model) -> DataFrame:
    from rankweave.sources.sinks import parse_dated_lines

    payload = F.concat(F.date_format("created_at", "yyyy/MM/dd"), F.lit(","), F.coalesce(F.col("score").cast("string"), F.lit("-")), F.lit(",text, with comma\nbroken line"))
    return parse_dated_lines(m.reviews().select("review_id", payload.alias("payload")), "payload")


@query("f09_pattern_list", "SELECT doc_id FROM documents WHERE trim(text) = '' OR regexp_matches(trim(text), '^The|^[0-9]+$|lorem')")
def _(m: Model) -> DataFrame:
    return m.table("documents").where(D.any_pattern(F.col("text"), ["^The", "^[0-9]+$", "lorem"])).select("doc_id")


@query("f10_plausible_name", "SELECT p.provider_id FROM providers p JOIN venues v USING (venue_id) WHERE length(trim(p.name)) BETWEEN 1 AND 20 AND trim(p.name) NOT IN ('new', v.name) AND NOT contains(trim(p.name), 'staff') AND NOT (length(v.name) >= 3 AND contains(trim(p.name), v.name)) AND NOT regexp_matches(trim(p.name), 'https?:|/|^[0-9()（）\\\\s]+$')")
def _(m: Model) -> DataFrame:
    rows = m.providers().join(m.venues().select("venue_id", F.col("name").alias("venue")), "venue_id")
    return rows.where(D.plausible_name(F.col("name"), F.col("venue"), ["new"], ["staff"])).select("provider_id")


@query("f11_suspect_over_join", "SELECT p.provider_id FROM providers p JOIN venues v USING (venue_id) WHERE p.name = v.name OR regexp_matches(p.name, '(?i)part.*7$') OR p.brand IN ('Brand#11') OR p.name LIKE '%' || v.name || '%'")
def _(m: Model) -> DataFrame:
    rows = m.providers().join(m.venues().select("venue_id", F.col("name").alias("venue")), "venue_id")
    suspect = (F.col("name") == F.col("venue")) | F.col("name").rlike("(?i)part.*7$") | F.col("brand").isin("Brand#11") | F.contains("name", "venue")
    return rows.where(suspect).select("provider_id")


@query("f18_display_hygiene", "SELECT p.provider_id FROM providers p JOIN venues v USING (venue_id) WHERE length(trim(p.name)) <= 15 AND trim(p.name) <> v.name")
def _(m: Model) -> DataFrame:
    rows = m.providers().join(m.venues().select("venue_id", F.col("name").alias("venue")), "venue_id")
    return rows.where((F.length(F.trim("name")) <= 15) & (F.trim("name") != F.col("venue"))).select("provider_id")


@query("f20_same_host", "SELECT page_id FROM pages WHERE regexp_matches(url, '^https?://') AND regexp_extract(url, '^https?://([^/:?#]+)', 1) = 'ththrhe.example.com' AND NOT regexp_matches(url, '(?i)[.](css|js|png)$')")
def _(m: Model) -> DataFrame:
    return m.table("pages").where(D.same_host_page(F.col("url"), "ththrhe.example.com")).select("page_id")


@query("f21_agent_blacklist", f"SELECT provider_id, v, trim(v) = '' OR regexp_matches(v, '(?i)bot|curl|spider') blocked FROM (SELECT provider_id, {_AGENTS} v FROM providers)")
def _(m: Model) -> DataFrame:
    return _formed(m, _AGENTS).select("provider_id", "v", D.blocked_agent(F.col("v"), ["bot", "curl", "spider"]).alias("blocked"))


@query("j16_normalized_link", ", k AS (SELECT page_id, regexp_replace(split_part(split_part(lower(url), '#', 1), '?', 1), '^https?://(www\\.)?|/+$', '', 'g') k FROM pages) SELECT a.page_id, max(b.page_id) other_id FROM k a JOIN k b USING (k) WHERE a.page_id < b.page_id GROUP BY 1")
def _(m: Model) -> DataFrame:
    key = F.regexp_replace(F.substring_index(F.substring_index(F.lower("url"), "#", 1), "?", 1), r"^https?://(www\.)?|/+$", "")
    rows = m.table("pages").select("page_id", key.alias("k"))
    last = rows.groupBy("k").agg(F.max("page_id").alias("other_id"))
    return rows.join(last, "k").where("page_id < other_id").select("page_id", "other_id")


@query("j20_key_resolution", ", a AS (SELECT area_id, slug, region_id FROM areas), w AS (SELECT * FROM (VALUES ('nation_6-building', 1), ('machinery', 6), ('nowhere', 2)) t(slug, region_id)) SELECT w.slug, coalesce(min(x.area_id), min(y.area_id)) area_id FROM w LEFT JOIN a x ON x.slug = w.slug LEFT JOIN a y ON y.region_id = w.region_id AND y.slug LIKE '%' || w.slug GROUP BY 1")
def _(m: Model) -> DataFrame:
    wanted = _values(m, [("nation_6-building", 1), ("machinery", 6), ("nowhere", 2)], "slug string, region_id long")
    areas = m.areas().select("area_id", F.col("slug").alias("a_slug"), F.col("region_id").alias("a_region"))
    exact = wanted.join(areas, F.col("slug") == F.col("a_slug")).groupBy("slug").agg(F.min("area_id").alias("exact"))
    ending = wanted.join(areas, (F.col("region_id") == F.col("a_region")) & F.col("a_slug").endswith(F.col("slug"))).groupBy("slug").agg(F.min("area_id").alias("ending"))
    return wanted.select("slug").join(exact, "slug", "left").join(ending, "slug", "left").select("slug", F.coalesce("exact", "ending").alias("area_id"))


@query("j22_match_precedence", ", s AS (SELECT page_id, md5(html) h, url FROM pages WHERE page_id % 2 = 1), t AS (SELECT page_id, md5(html) h, url FROM pages WHERE page_id % 2 = 0) SELECT s.page_id, CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.url = s.url) THEN 'url' WHEN EXISTS (SELECT 1 FROM t WHERE t.h = s.h) THEN 'content' ELSE 'new' END found FROM s")
def _(m: Model) -> DataFrame:
    rows = m.table("pages").select("page_id", F.md5("html").alias("h"), "url")
    new, old = rows.where("page_id % 2 = 1"), rows.where("page_id % 2 = 0")
    by_url, by_content = (old.select(c).distinct().withColumn(f"by_{c}", F.lit(True)) for c in ("url", "h"))
    joined = new.join(by_url, "url", "left").join(by_content, "h", "left")
    return joined.select("page_id", F.when(F.col("by_url"), "url").when(F.col("by_h"), "content").otherwise("new").alias("found"))


@query("w01_running_total", "SELECT venue_id, area_id, CAST(sum(display_order) OVER (PARTITION BY area_id ORDER BY venue_id ROWS UNBOUNDED PRECEDING) AS BIGINT) running FROM venue_areas")
def _(m: Model) -> DataFrame:
    w = Window.partitionBy("area_id").orderBy("venue_id").rowsBetween(Window.unboundedPreceding, 0)
    return m.venue_areas().select("venue_id", "area_id", F.sum("display_order").over(w).alias("running"))


@query("w07_rank_assignment", "SELECT venue_id, area_id, row_number() OVER (PARTITION BY area_id ORDER BY venue_id DESC) AS rank FROM venue_areas")
def _(m: Model) -> DataFrame:
    return m.venue_areas().select("venue_id", "area_id", F.row_number().over(Window.partitionBy("area_id").orderBy(F.desc("venue_id"))).cast("bigint").alias("rank"))


_PAGES = ", c AS (SELECT v.venue_id, 1 + count(p.provider_id) pages FROM venues v LEFT JOIN (SELECT * FROM providers WHERE status = 'active') p USING (venue_id) GROUP BY 1)"


@query("w01_global_running_total", _PAGES + " SELECT venue_id, pages, CAST(sum(pages) OVER (ORDER BY venue_id) AS BIGINT) running FROM c")
def _(m: Model) -> DataFrame:
    active = m.providers().where("status = 'active'").groupBy("venue_id").agg(F.count("*").alias("n"))
    pages = m.venues().select("venue_id").join(active, "venue_id", "left").select("venue_id", (1 + F.coalesce("n", F.lit(0))).alias("pages"))
    return running_total(pages, ["venue_id"], "pages")


_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity"


@query("w01_running_quantity", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sum(l_quantity) OVER w running, row_number() OVER w number FROM lineitem WINDOW w AS (ORDER BY {_LINE} ROWS UNBOUNDED PRECEDING)")
def _(m: Model) -> DataFrame:
    order = _LINE.split(", ")
    return running_total(m.table("lineitem").select(*order), order, "l_quantity", number="number").drop("l_quantity")


@query("w07_global_rank", "SELECT provider_id, n, row_number() OVER (ORDER BY mean DESC NULLS LAST, n DESC, provider_id) AS rank FROM (SELECT provider_id, avg(score) mean, count(*) n FROM approved GROUP BY 1)")
def _(m: Model) -> DataFrame:
    rows = m.approved_scores().groupBy("provider_id").agg(F.avg("score").alias("mean"), F.count("*").alias("n"))
    return running_total(rows, [F.desc_nulls_last("mean"), F.desc("n"), "provider_id"], number="rank").select("provider_id", "n", "rank")


@query("o02_composite_order", "SELECT venue_id, n, best FROM (SELECT venue_id, count(*) n, max(score) best FROM approved GROUP BY 1) ORDER BY best DESC NULLS LAST, n DESC, venue_id LIMIT 12")
def _(m: Model) -> DataFrame:
    return m.approved().groupBy("venue_id").agg(F.count("*").alias("n"), F.max("score").alias("best")).orderBy(F.desc_nulls_last("best"), F.desc("n"), "venue_id").limit(12)


@query("o05_offset_page", "SELECT member_id FROM members ORDER BY balance DESC, member_id LIMIT 25 OFFSET 50")
def _(m: Model) -> DataFrame:
    return m.members().orderBy(F.desc("balance"), "member_id").offset(50).limit(25).select("member_id")


@query("o07_curated_order", "SELECT CAST(pos AS BIGINT) pos, area_id FROM (VALUES (0, 'nation_6-building'), (1, 'nowhere'), (2, 'nation_18-machinery')) t(pos, slug) JOIN areas USING (slug)")
def _(m: Model) -> DataFrame:
    listed = _values(m, [(0, "nation_6-building"), (1, "nowhere"), (2, "nation_18-machinery")], "pos long, slug string")
    return m.areas().join(F.broadcast(listed), "slug").select("pos", "area_id").orderBy("pos")


@query("o08_switchable_sort", "SELECT provider_id FROM (SELECT provider_id, count(*) n FROM approved GROUP BY 1) ORDER BY n DESC, provider_id LIMIT 30")
def _(m: Model) -> DataFrame:
    orders = {"newest": [F.desc("latest")], "rating": [F.desc_nulls_last("mean")], "reviews": [F.desc("n")]}
    rows = m.approved().groupBy("provider_id").agg(F.count("*").alias("n"), F.max("created_at").alias("latest"), F.avg("score").alias("mean"))
    return rows.orderBy(*orders["reviews"], "provider_id").limit(30).select("provider_id")


@query("o12_ranking_page", "SELECT provider_id, CAST(floor(sum(coalesce(score, 0)) / count(*) + 0.5) AS BIGINT) avg_score, count(*) n FROM approved GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 50")
def _(m: Model) -> DataFrame:
    agg = m.approved().groupBy("provider_id").agg(ranking.js_round(F.sum(F.coalesce("score", F.lit(0))) / F.count("*")).alias("avg_score"), F.count("*").alias("n"))
    return agg.orderBy(F.desc("avg_score"), F.desc("n"), "provider_id").limit(50)


@query("u03_facet_intersection", "SELECT provider_id FROM approved WHERE type_id = 1 INTERSECT SELECT provider_id FROM approved WHERE level_id IN (1, 2)")
def _(m: Model) -> DataFrame:
    return ranking.facet_search(m.approved(), {"type_id": [1], "level_id": [1, 2]}).select("provider_id")


@query("x09_valid_id", "SELECT review_id, CASE WHEN type_id BETWEEN 1 AND 5 THEN type_id END type_id FROM reviews")
def _(m: Model) -> DataFrame:
    return m.reviews().select("review_id", F.when(F.col("type_id").between(1, 5), F.col("type_id")).alias("type_id"))


@query("x14_effective_tier", "SELECT review_id, CASE WHEN body_id > 2 AND created_at >= TIMESTAMP '2000-01-01' THEN 'vip' ELSE 'free' END tier FROM reviews")
def _(m: Model) -> DataFrame:
    tier = F.when(F.col("body_id") > 2, "vip").otherwise("free")
    return m.reviews().select("review_id", D.effective_tier(tier, F.col("created_at"), F.expr("timestamp '2000-01-01'")).alias("tier"))


@query("x19_clean_name", f"SELECT provider_id, {_TAILS} v, brand AS name FROM providers")
def _(m: Model) -> DataFrame:
    return _formed(m, _TAILS).select("provider_id", "v", D.clean_extracted_name(F.col("v")).alias("name"))


@query("x25_display_name", f"SELECT provider_id, {_SIGNS} v, CASE WHEN provider_id % 3 < 2 THEN name ELSE concat('【', brand, '】') END AS name FROM providers")
def _(m: Model) -> DataFrame:
    return _formed(m, _SIGNS).select("provider_id", "v", D.display_name(F.col("v"), ["東京店", "大阪店"]).alias("name"))


@query("x26_core_name", f"SELECT provider_id, {_SHOPS} v, name FROM providers")
def _(m: Model) -> DataFrame:
    return _formed(m, _SHOPS).select("provider_id", "v", D.core_name(F.col("v"), ["東京", "店"]).alias("name"))


@query("x27_bracketed_reading", f"SELECT provider_id, {_BRACKETS} v, CASE provider_id % 3 WHEN 0 THEN 'ローズ' WHEN 1 THEN 'リリー' END reading FROM providers")
def _(m: Model) -> DataFrame:
    return _formed(m, _BRACKETS).select("provider_id", "v", D.bracketed_reading(F.col("v")).alias("reading"))


@query("x28_titled_reading", f"SELECT provider_id, {_TITLES} v, CASE WHEN provider_id % 4 < 3 THEN split_part(name, ' ', 2) END reading, CASE provider_id % 4 WHEN 0 THEN 'bar' WHEN 1 THEN 'dash' WHEN 2 THEN 'first' END pattern FROM providers")
def _(m: Model) -> DataFrame:
    found = D.titled_reading(F.col("v"), [("first", r"^(\w+) \|"), ("bar", r"\| (\w+)$"), ("dash", r"^(\w+) -")], ["Home"])
    return _formed(m, _TITLES).select("provider_id", "v", found["value"].alias("reading"), found["pattern"].alias("pattern"))


@query("x29_full_width_kana", f"SELECT provider_id, {_HALF} v, concat(translate(concat('', provider_id), '0123456789', 'アイウエオカキクケコ'), 'ガーパ', brand) kana FROM providers")
def _(m: Model) -> DataFrame:
    return _formed(m, _HALF).select("provider_id", "v", D.full_width_kana(F.col("v")).alias("kana"))


@query("x32_opening_hours", f"SELECT provider_id, {_HOURS} v, CASE provider_id % 3 WHEN 0 THEN concat(10 + size % 10, ':00') WHEN 1 THEN '12:00' END opens, CASE provider_id % 3 WHEN 0 THEN '24:00' WHEN 1 THEN concat(size % 10, ':30') END closes FROM providers")
def _(m: Model) -> DataFrame:
    opens, closes = D.opening_hours(F.col("v"))
    return _formed(m, _HOURS).select("provider_id", "v", opens.alias("opens"), closes.alias("closes"))


@query("x34_parent_keyword", f"SELECT provider_id, {_PARENTS} v, CASE provider_id % 3 WHEN 0 THEN CASE WHEN provider_id % 2 = 0 THEN brand ELSE concat(brand, '・', name) END WHEN 1 THEN name ELSE '広島市' END keyword FROM providers")
def _(m: Model) -> DataFrame:
    """Every second provider has no sibling in its region."""
    siblings = F.col("provider_id") % 2 + 1
    return _formed(m, _PARENTS).select("provider_id", "v", D.parent_keyword(F.col("v"), {"広島・福山": "広島市"}, siblings).alias("keyword"))


@query("x36_direction_station", f"SELECT provider_id, {_SIDES} v, provider_id % 4 IN (0, 3) OR provider_id % 4 = 2 AND length(name) <= 4 side FROM providers")
def _(m: Model) -> DataFrame:
    return _formed(m, _SIDES).select("provider_id", "v", D.direction_station(F.col("v")).alias("side"))


@query("x39_json_repair", f"SELECT provider_id, {_REPLIES} v, CASE WHEN provider_id % 3 < 2 THEN size END n FROM providers")
def _(m: Model) -> DataFrame:
    return _formed(m, _REPLIES).select("provider_id", "v", D.repaired_json(F.col("v"), "n int")["n"].alias("n"))


@query("x44_host_similarity")
def _(m: Model) -> DataFrame:
    return classify.similar_hosts(m.table("pages").select(T.domain(F.col("url")).alias("host")), "host")


@query("x51_merged_reading", f"SELECT provider_id, concat(brand, '・x') v1, {_READINGS} v2, CASE WHEN provider_id % 3 = 1 THEN concat(brand, size) ELSE concat(brand, '・x') END merged FROM providers")
def _(m: Model) -> DataFrame:
    return _formed(m, "concat(brand, '・x')", _READINGS).select("provider_id", "v1", "v2", D.merged_reading(F.col("v1"), F.col("v2"), "none").alias("merged"))


@query("x52_name_sources", "SELECT CASE WHEN provider_id % 3 = 0 THEN 'first' WHEN provider_id % 3 = 1 THEN 'second' ELSE 'rule' END source, count(*) n FROM providers GROUP BY 1")
def _(m: Model) -> DataFrame:
    third = F.col("provider_id") % 3
    named = D.first_named([("first", F.when(third == 0, F.col("name"))), ("second", F.when(third == 1, F.col("brand"))), ("rule", F.col("name"))])
    return m.providers().select(named["source"].alias("source")).groupBy("source").agg(F.count("*").alias("n"))


@query("x53_attributes", f"SELECT provider_id, {_SPECS} v, CASE WHEN provider_id % 4 < 2 THEN age END age, CASE WHEN provider_id % 4 < 3 THEN 140 + size END height FROM providers")
def _(m: Model) -> DataFrame:
    found = D.attributes(F.col("v"))
    return _formed(m, _SPECS).select("provider_id", "v", found["age"].alias("age"), found["height"].alias("height"))


@query("r09_fingerprint", ", s AS (SELECT page_id, (contains(url, 'blog.')::INT * 2.0 + contains(html, '<article')::INT * 1.5) / 3.5 blog, (contains(url, 'www.')::INT * 2.0 + contains(html, 'price')::INT * 1.0) / 3.0 shop FROM pages) SELECT page_id, CASE WHEN blog >= shop THEN 'blog' ELSE 'shop' END \"system\", CAST(round(greatest(blog, shop), 6) AS DOUBLE) score FROM s WHERE round(greatest(blog, shop), 6) >= 0.5")
def _(m: Model) -> DataFrame:
    rules = [("blog", "url", "blog.", 2.0), ("blog", "html", "<article", 1.5), ("shop", "url", "www.", 2.0), ("shop", "html", "price", 1.0)]
    return classify.fingerprint(m.table("pages"), "page_id", rules, threshold=0.5)


@query("r10_image_candidates")
def _(m: Model) -> DataFrame:
    return classify.image_candidates(m.table("pages"), "page_id", "html")


@query("r11_rule_votes", "SELECT event_type field, CAST(json_extract(props, '$.k') AS BIGINT) % 3 selector, count(*) n FROM events GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, CAST(json_extract(props, '$.k') AS BIGINT) % 3) = 1 AND n >= 0.3 * sum(n) OVER (PARTITION BY event_type)")
def _(m: Model) -> DataFrame:
    rows = m.table("events").select(F.col("event_type").alias("field"), (F.from_json("props", "k bigint")["k"] % 3).alias("selector"))
    return classify.majority_rules(rows, "field", "selector", 0.3)


@query("h01_classify_paths", "SELECT page_id, CASE WHEN regexp_matches(url, '/en/') THEN 'parent' WHEN regexp_matches(url, '/(fr|de)/') THEN 'station' ELSE 'city' END lvl FROM pages")
def _(m: Model) -> DataFrame:
    u = F.col("url")
    return m.table("pages").select("page_id", maintain.first_match([(u.rlike("/en/"), "parent"), (u.rlike("/(fr|de)/"), "station")], "city").alias("lvl"))


@query("h02_hierarchy", "SELECT r.region_id, r.slug, NULL parent_slug, EXISTS (SELECT 1 FROM areas a WHERE a.region_id = r.region_id) has_children FROM regions r UNION ALL SELECT a.area_id, a.slug, r.slug, false FROM areas a JOIN regions r ON a.region_id = r.region_id")
def _(m: Model) -> DataFrame:
    regions, areas = m.regions(), m.areas()
    parents = regions.join(areas.select("region_id").distinct().withColumn("has", F.lit(True)), "region_id", "left")
    top = parents.select("region_id", "slug", F.lit(None).cast("string").alias("parent_slug"), F.coalesce("has", F.lit(False)).alias("has_children"))
    low = areas.join(F.broadcast(regions.select("region_id", F.col("slug").alias("parent_slug"))), "region_id").select(F.col("area_id").alias("region_id"), "slug", "parent_slug", F.lit(False).alias("has_children"))
    return top.unionByName(low)


@query("h05_adoption", "SELECT slug, array_to_string(list_filter([CASE WHEN area_id % 2 = 0 THEN 'volume' END, CASE WHEN area_id % 3 = 0 THEN 'count' END], lambda x: x IS NOT NULL), ',') reasons FROM areas WHERE area_id % 2 = 0 OR area_id % 3 = 0")
def _(m: Model) -> DataFrame:
    reasons = F.concat_ws(",", F.when(F.col("area_id") % 2 == 0, "volume"), F.when(F.col("area_id") % 3 == 0, "count"))
    return m.areas().select("slug", reasons.alias("reasons")).where("reasons <> ''")


@query("h08_keyword_volume", "SELECT a.area_id, max(v.volume) volume FROM areas a LEFT JOIN (VALUES ('france building', 100), ('CHINA MACHINERY', 50)) v(keyword, volume) ON lower(v.keyword) = lower(a.name) GROUP BY 1")
def _(m: Model) -> DataFrame:
    volumes = _values(m, [("france building", 100), ("CHINA MACHINERY", 50)], "keyword string, volume int").groupBy(F.lower("keyword").alias("k")).agg(F.max("volume").alias("volume"))
    return m.areas().join(F.broadcast(volumes), F.lower("name") == F.col("k"), "left").select("area_id", "volume")


@query("h09_merge_by_url", "SELECT min(page_id) page_id, count(*) merged FROM pages GROUP BY regexp_replace(url, '[?#].*$', '')")
def _(m: Model) -> DataFrame:
    return m.table("pages").groupBy(F.regexp_replace("url", "[?#].*$", "").alias("u")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("merged")).select("page_id", "merged")


@query(
    "h09_merge_by_chained_keys",
    """, k AS (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '^(www|m)\\.', '') site, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) title, html FROM pages),
 e AS (SELECT page_id, 's' || site x FROM k WHERE site <> '' UNION ALL SELECT page_id, 't' || title FROM k WHERE title <> ''),
 f AS (SELECT e.page_id a, g.first b FROM e JOIN (SELECT x, min(page_id) AS first FROM e GROUP BY 1) g ON e.x = g.x),
 w AS (SELECT a, b FROM f UNION SELECT b, a FROM f),
 r AS (SELECT page_id a, page_id AS seen FROM k UNION SELECT r.a, w.b FROM r JOIN w ON r.seen = w.a),
 c AS (SELECT a, min(seen) page_id FROM r GROUP BY 1),
 l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a [^>]*href="([^"]*)"', 1)) href FROM pages),
 g AS (SELECT c.page_id, count(DISTINCT a) merged, count(href) links, count(DISTINCT href) targets FROM c LEFT JOIN l ON l.page_id = a GROUP BY 1)
SELECT a page_id, c.page_id merged_into, merged, links, targets FROM c JOIN g ON c.page_id = g.page_id""",
)
def _(m: Model) -> DataFrame:
    """Pages of one site or of one title, by chains of both, become one; their links move along."""
    pages = m.table("pages")
    site = F.regexp_replace(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1), r"^(www|m)\.", "")
    records = pages.select("page_id", site.alias("site"), F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"))
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('(?i)<a [^>]*href="([^"]*)"'), 1)).alias("href"))
    into, kept, moved = merge_parents(records, links, "page_id", ["site", "title"], "page_id")
    counts = moved.groupBy("page_id").agg(F.count("*").alias("links"), F.countDistinct("href").alias("targets"))
    merged = kept.join(counts, "page_id", "left").na.fill(0, ["links", "targets"]).withColumnRenamed("page_id", "merged_into")
    return into.join(merged, "merged_into").select("page_id", "merged_into", "merged", "links", "targets")


@query("h11_name_from_title", "SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '(?is)<title[^>]*>([^|<-]+)', 1)), ''), 'none') AS name FROM pages")
def _(m: Model) -> DataFrame:
    return m.table("pages").select("page_id", F.coalesce(T.capture(F.trim(F.regexp_extract("html", "(?is)<title[^>]*>([^|<-]+)", 1)), "(?s)(.+)"), F.lit("none")).alias("name"))


@query(
    "d02_insert_or_link",
    ", t AS (SELECT provider_id, member_id, min(review_id) id FROM approved WHERE member_id IS NOT NULL GROUP BY 1, 2), s AS (SELECT provider_id, member_id, review_id, min(review_id) OVER (PARTITION BY provider_id, member_id) first_id FROM reviews WHERE status = 'pending' AND member_id IS NOT NULL) SELECT review_id, CASE WHEN t.id IS NOT NULL THEN 'linked' WHEN review_id = first_id THEN 'inserted' ELSE 'repeated' END outcome, coalesce(t.id, first_id) target_id FROM s LEFT JOIN t USING (provider_id, member_id)",
)
def _(m: Model) -> DataFrame:
    rows = m.reviews().where("member_id is not null")
    keys = ["provider_id", "member_id"]
    known, coming = (rows.where(F.col("status") == s).select(*keys, "review_id") for s in ("approved", "pending"))
    return maintain.insert_or_link(known, coming, keys, "review_id")


@query("d07_recompute", "SELECT provider_id, count(*) n, CAST(CAST(avg(score) AS DECIMAL(5,1)) AS DOUBLE) avg_score FROM approved WHERE score IS NOT NULL AND provider_id IN (SELECT provider_id FROM reviews WHERE status = 'pending' AND created_at >= TIMESTAMP '1998-01-01') GROUP BY 1")
def _(m: Model) -> DataFrame:
    touched = m.reviews().where("status = 'pending' and created_at >= timestamp '1998-01-01'").select("provider_id").distinct()
    base = m.approved_scores().where("score is not null").join(touched, "provider_id", "left_semi")
    return base.groupBy("provider_id").agg(F.count("*").alias("n"), F.avg("score").cast("decimal(5,1)").cast("double").alias("avg_score"))


@query("d11_guarded_update", "SELECT provider_id, coalesce(nullif(CASE WHEN provider_id % 4 = 0 THEN '' ELSE name END, ''), brand) AS name FROM providers")
def _(m: Model) -> DataFrame:
    rows = m.providers().withColumn("name", F.when(F.col("provider_id") % 4 == 0, "").otherwise(F.col("name")))
    return rows.select("provider_id", F.when(F.col("name") == "", F.col("brand")).otherwise(F.col("name")).alias("name"))


@query("d13_moderation_credits", "SELECT member_id, CAST(sum(CASE WHEN score >= 50 THEN 10 ELSE 5 END) AS BIGINT) credits FROM (SELECT review_id, member_id, max(score) score FROM approved WHERE member_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def _(m: Model) -> DataFrame:
    granted = F.when(F.col("score") >= 50, 10).otherwise(5)
    return m.approved().where("member_id is not null").groupBy("review_id", "member_id").agg(F.max("score").alias("score")).groupBy("member_id").agg(F.sum(granted).alias("credits"))


@query("d18_defaults", "SELECT provider_id, coalesce(CASE WHEN provider_id % 2 = 0 THEN brand END, 'provider-' || provider_id) slug FROM providers")
def _(m: Model) -> DataFrame:
    return m.providers().select("provider_id", F.coalesce(F.when(F.col("provider_id") % 2 == 0, F.col("brand")), F.concat(F.lit("provider-"), "provider_id")).alias("slug"))


@query("d21_resume", "SELECT o_orderkey AS order_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N')")
def _(m: Model) -> DataFrame:
    done = m.table("lineitem").where("l_returnflag = 'N'").select("l_orderkey")
    return m.table("orders").join(done, F.expr("o_orderkey = l_orderkey"), "left_anti").select(F.col("o_orderkey").alias("order_id"))


@query("d23_status_transition", "SELECT review_id, CASE WHEN status IN ('approved', 'rejected') THEN TIMESTAMP '2001-11-05' END resolved_at FROM reviews")
def _(m: Model) -> DataFrame:
    return m.reviews().select("review_id", F.when(F.col("status").isin("approved", "rejected"), F.lit(AS_OF).cast("timestamp_ntz")).alias("resolved_at"))


@query("e04_absolute_urls", ", a AS (SELECT page_id, url, unnest(list_distinct(regexp_extract_all(html, '<a[^>]+href=\"([^\"]+)\"', 1))) href FROM pages) SELECT page_id, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || href ELSE href END link FROM a")
def _(m: Model) -> DataFrame:
    rows = m.table("pages").select("page_id", "url", F.explode(html.links(F.col("html"))).alias("href"))
    return rows.select("page_id", cards.resolved(F.col("url"), F.col("href")).alias("link"))


@query("e05_pagination", "SELECT DISTINCT page_id, CAST(regexp_extract(url, '[?&](?:page|p|pg|paged)=([0-9]+)', 1) AS BIGINT) no FROM pages WHERE regexp_matches(url, '[?&](page|p|pg|paged)=([2-9]|[1-9][0-9]+)(&|#|$)')")
def _(m: Model) -> DataFrame:
    return m.table("pages").select("page_id", html.page_number(F.col("url")).alias("no")).where("no >= 2").distinct()


@query("e07_images")
def _(m: Model) -> DataFrame:
    return m.table("pages").select("page_id", F.explode(html.image_sources(F.col("html"))).alias("src"))


@query("e08_prioritized_heading", "SELECT page_id, coalesce(nullif(h, ''), nullif(t, '')) heading, CASE WHEN h <> '' THEN 'h1' ELSE 'title' END source, CASE WHEN h <> '' THEN 0.85 ELSE 0.70 END::DOUBLE confidence FROM (SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')) h, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', '', 'g')) t FROM pages) WHERE h <> '' OR t <> ''")
def _(m: Model) -> DataFrame:
    return html.best_heading(m.table("pages"), "page_id", "html")


@query("e10_platform", "SELECT page_id, CASE WHEN contains(html, 'wp-content') THEN 'wordpress' WHEN contains(html, 'id=\"app\"') THEN 'spa' ELSE 'plain' END platform FROM pages")
def _(m: Model) -> DataFrame:
    h = F.col("html")
    return m.table("pages").select("page_id", maintain.first_match([(h.contains("wp-content"), "wordpress"), (h.contains('id="app"'), "spa")], "plain").alias("platform"))


@query("e13_record_validity", "SELECT provider_id, (age BETWEEN 18 AND 70)::INT + (size BETWEEN 1 AND 40)::INT + (brand IS NOT NULL)::INT >= 2 AND age <> size valid FROM providers")
def _(m: Model) -> DataFrame:
    enough = F.col("age").between(18, 70).cast("int") + F.col("size").between(1, 40).cast("int") + F.col("brand").isNotNull().cast("int")
    return m.providers().select("provider_id", ((enough >= 2) & (F.col("age") != F.col("size"))).alias("valid"))


@query("e15_detail_links")
def _(m: Model) -> DataFrame:
    rows = m.table("pages").select("page_id", F.explode(html.links(F.col("html"))).alias("href"))
    hit = F.col("href").rlike("/(profile|item|detail|p)/|/[0-9]+")
    marked = rows.withColumn("hit", hit).withColumn("any", F.max(hit.cast("int")).over(Window.partitionBy("page_id")))
    return marked.where(F.col("hit") | (F.col("any") == 0)).select("page_id", "href", "hit")


@query("t01_rate_limit", "SELECT user_id, ws AS start, count(*) n FROM events, range(0, 60) g(i), LATERAL (SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 23 HOUR + to_hours(CAST(i AS INT)) ws) WHERE i < 24 GROUP BY 1, 2 HAVING count(*) > 6")
def _(m: Model) -> DataFrame:
    return jobs.rate_limit_breaches(m.table("events"), "user_id", "ts", 6, "24 hours", "1 hour")


@query("t04_idempotent_webhooks", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) k, count(*) n FROM (SELECT DISTINCT event_id, props FROM events WHERE event_type = 'purchase') GROUP BY 1")
def _(m: Model) -> DataFrame:
    rows = jobs.once_per_id(m.table("events").where("event_type = 'purchase'"), "event_id", "ts")
    return rows.groupBy(F.from_json("props", "k bigint")["k"].alias("k")).agg(F.count("*").alias("n"))
