"""Scalar functions over columns of the tables and over fixed examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.functions import text as T
from rankweave.operators.ranking import js_round, recency
from rankweave.plans.registry import query
from rankweave.sources.model import AS_OF, Model


def _formed(m: Model, form: str, *keep: str) -> DataFrame:
    """(provider_id, kept columns, v): a text of each provider's columns, by an expression that DuckDB knows, too."""
    return m.providers().select("provider_id", *keep, F.expr(form).alias("v"))


def _from(form: str) -> str:
    return f"FROM (SELECT *, {form} v FROM providers) t"


_NUMBERS = "CASE provider_id % 4 WHEN 0 THEN concat('', size * 3) WHEN 1 THEN concat('-', size) WHEN 2 THEN concat('', size) ELSE name END"
_AGES = "CASE provider_id % 3 WHEN 0 THEN concat('', age - 5) WHEN 1 THEN concat('', age + 10) ELSE brand END"
_LETTERS = "CASE WHEN provider_id % 9 = 0 THEN '' ELSE substr('ABCDEFGHIJ', CAST(1 + size % 10 AS INT), 1) END"
_PEOPLE = "CASE provider_id % 3 WHEN 0 THEN concat(name, '  (new)') WHEN 1 THEN concat(' ', name, '　', brand, ' ') ELSE concat(brand, '（', size, '）') END"
_PRICES = "CASE provider_id % 4 WHEN 0 THEN concat(size, ',000円/', size + 40, '分') WHEN 1 THEN concat(size + 30, ' 分') WHEN 2 THEN concat('¥', size) ELSE concat(size * 100, '円') END"
_STATIONS = "CASE provider_id % 3 WHEN 0 THEN concat(name, '駅') WHEN 1 THEN concat(name, '駅・', brand) ELSE concat(name, '駅（', brand, '）') END"
_LISTS = "CASE provider_id % 3 WHEN 0 THEN concat(name, ', ', brand, ',,', size) WHEN 1 THEN concat(' ,', ',') ELSE brand END"
_DAYS = "CASE provider_id % 4 WHEN 0 THEN concat('20', 10 + size % 15, '/0', 1 + size % 9, '/', 10 + size % 19) WHEN 1 THEN concat('20', 10 + size % 15, '-0', 1 + size % 9, '-', 10 + size % 19) WHEN 2 THEN concat('2024-1', size % 10, '-15') ELSE name END"
_SIZES = "CASE provider_id % 3 WHEN 0 THEN concat(70 + size, '(', substr('ABCDEFG', CAST(1 + size % 7 AS INT), 1), ')-', 94 - size, '-', 72 + size) WHEN 1 THEN concat(70 + size, '-', 94 - size, '-', 72 + size) ELSE name END"
_AGED = "CASE provider_id % 3 WHEN 0 THEN concat(name, '(', age, ')') WHEN 1 THEN concat(name, '（', age, '） ') ELSE name END"
_LETTERED = "CASE provider_id % 3 WHEN 0 THEN concat(70 + size, '(D)') WHEN 1 THEN concat('', size) ELSE name END"
_FILES = "CASE provider_id % 4 WHEN 0 THEN concat('/', provider_id, '.PNG') WHEN 1 THEN concat('/', provider_id, '.jpg?x=', size) WHEN 2 THEN concat('/', provider_id) ELSE concat('/', provider_id, '.Jpg#a') END"


@query("x01_default", "SELECT venue_id, coalesce(nullif(CASE WHEN venue_id % 3 = 0 THEN '' ELSE name END, ''), 'none') shown FROM venues")
def _(m: Model) -> DataFrame:
    given = F.when(F.col("venue_id") % 3 == 0, "").otherwise(F.col("name"))
    return m.venues().select("venue_id", F.coalesce(F.nullif(given, F.lit("")), F.lit("none")).alias("shown"))


@query("x02_greatest_least", "SELECT review_id, greatest(p1, p2, score) high, least(p1, p2, score) low FROM reviews")
def _(m: Model) -> DataFrame:
    return m.reviews().select("review_id", F.greatest("p1", "p2", "score").alias("high"), F.least("p1", "p2", "score").alias("low"))


@query("x03_label_ladder", "SELECT review_id, CASE WHEN score >= 70 THEN 'great' WHEN score >= 45 THEN 'good' WHEN score >= 25 THEN 'fair' ELSE 'low' END label FROM reviews WHERE score IS NOT NULL")
def _(m: Model) -> DataFrame:
    s = F.col("score")
    label = F.when(s >= 70, "great").when(s >= 45, "good").when(s >= 25, "fair").otherwise("low")
    return m.reviews().where("score is not null").select("review_id", label.alias("label"))


@query("x04_decimal_rounding", "SELECT member_id, CAST(CAST(balance AS DECIMAL(12,1)) AS DOUBLE) balance FROM members")
def _(m: Model) -> DataFrame:
    return m.members().select("member_id", F.col("balance").cast("decimal(12,1)").cast("double").alias("balance"))


@query("x05_round_half_up", "SELECT review_id, CAST(floor(score / 4.0 + 0.5) AS BIGINT) AS quarter FROM reviews WHERE score IS NOT NULL")
def _(m: Model) -> DataFrame:
    return m.reviews().where("score is not null").select("review_id", js_round(F.col("score") / 4.0).alias("quarter"))


@query("x06_distance", "SELECT review_id, round(sqrt(pow(p1 - 3, 2) + pow(p2 - 3, 2) + pow(p3 - 3, 2) + pow(p4 - 3, 2)), 6) distance FROM reviews")
def _(m: Model) -> DataFrame:
    total = sum((F.pow(F.col(p) - 3, 2) for p in ("p1", "p2", "p3", "p4")), F.lit(0.0))
    return m.reviews().select("review_id", F.round(F.sqrt(total), 6).alias("distance"))


@query("x07_arithmetic", "SELECT provider_id, round(log2(size + 1), 6) log_size, CAST(ceil(size / 7.0) AS BIGINT) pages, abs(size - 25) off FROM providers")
def _(m: Model) -> DataFrame:
    s = F.col("size")
    return m.providers().select("provider_id", F.round(F.log2(s + 1), 6).alias("log_size"), F.ceil(s / 7.0).cast("bigint").alias("pages"), F.abs(s - 25).alias("off"))


@query("x08_clamp", "SELECT provider_id, v, CASE WHEN TRY_CAST(v AS INT) IS NOT NULL THEN least(greatest(TRY_CAST(v AS INT), 0), 100) END clamped " + _from(_NUMBERS))
def _(m: Model) -> DataFrame:
    return _formed(m, _NUMBERS).select("provider_id", "v", T.clamp(F.col("v"), 0, 100).alias("clamped"))


@query("x10_bounded_int", "SELECT provider_id, v, CASE WHEN TRY_CAST(v AS INT) BETWEEN 18 AND 70 THEN TRY_CAST(v AS INT) END bounded " + _from(_AGES))
def _(m: Model) -> DataFrame:
    return _formed(m, _AGES).select("provider_id", "v", T.bounded_int(F.col("v"), 18, 70).alias("bounded"))


@query("x11_step_bucket", "SELECT provider_id, CASE WHEN age <= 54 THEN 1 WHEN age <= 58 THEN 2 WHEN age <= 63 THEN 3 WHEN age <= 68 THEN 4 ELSE 5 END step FROM providers")
def _(m: Model) -> DataFrame:
    return m.providers().select("provider_id", T.waist_step(F.col("age")).alias("step"))


@query("x12_letter_bucket", "SELECT provider_id, v, CASE WHEN v = '' THEN NULL WHEN v >= 'H' THEN 5 WHEN v >= 'G' THEN 4 WHEN v >= 'E' THEN 3 WHEN v >= 'C' THEN 2 ELSE 1 END step " + _from(_LETTERS))
def _(m: Model) -> DataFrame:
    return _formed(m, _LETTERS).select("provider_id", "v", T.letter_step(F.col("v")).alias("step"))


@query("x13_levels", "SELECT member_id, CAST((n >= 1)::INT + (n >= 5)::INT + (n >= 10)::INT + (n >= 20)::INT + (n >= 35)::INT + (n >= 50)::INT + (n >= 75)::INT + (n >= 100)::INT + (n >= 150)::INT AS INT) AS level FROM (SELECT member_id, least(count(*), 199) n FROM reviews WHERE member_id IS NOT NULL GROUP BY 1)")
def _(m: Model) -> DataFrame:
    counts = m.reviews().where("member_id is not null").groupBy("member_id").agg(F.count("*").alias("n"))
    return counts.select("member_id", T.level(F.col("n")).alias("level"))


@query("x15_basic_text", "SELECT provider_id, upper(trim(name)) || '/' || left(lower(brand), 5) label FROM providers")
def _(m: Model) -> DataFrame:
    return m.providers().select("provider_id", F.concat(F.upper(F.trim("name")), F.lit("/"), F.left(F.lower("brand"), F.lit(5))).alias("label"))


@query("x16_regex_capture", "SELECT page_id, nullif(regexp_extract(url, '/([a-z]{2})/[0-9]+', 1), '') lang FROM pages")
def _(m: Model) -> DataFrame:
    return m.table("pages").select("page_id", T.capture(F.col("url"), "/([a-z]{2})/[0-9]+").alias("lang"))


@query("x17_replace_chain", "SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') short FROM pages")
def _(m: Model) -> DataFrame:
    return m.table("pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("short"))


@query("x18_name_and_age", "SELECT provider_id, v, trim(regexp_replace(v, '[(（][0-9]{1,2}[)）]\\s*$', '')) AS name, coalesce(TRY_CAST(nullif(regexp_extract(v, '[(（]([0-9]{1,2})[)）]\\s*$', 1), '') AS INT), 0) age " + _from(_AGED).replace("SELECT *", "SELECT provider_id"))
def _(m: Model) -> DataFrame:
    name, age = T.name_and_age(F.col("v"))
    return _formed(m, _AGED).select("provider_id", "v", name.alias("name"), age.alias("age"))


@query("x20_compound_split", "SELECT provider_id, v, TRY_CAST(nullif(regexp_extract(v, '^([0-9]+)', 1), '') AS INT) number, nullif(regexp_extract(v, '\\(([A-Z])\\)', 1), '') letter " + _from(_LETTERED))
def _(m: Model) -> DataFrame:
    number, letter = T.number_and_letter(F.col("v"))
    return _formed(m, _LETTERED).select("provider_id", "v", number.alias("number"), letter.alias("letter"))


@query("x21_normalize_url", "SELECT page_id, 'https://' || regexp_replace(split_part(split_part(u, '#', 1), '?', 1), '/+$', '') || coalesce(nullif(regexp_extract(u, '(\\?[^#]*)', 1), ''), '') normalized FROM (SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\\.', '') u FROM pages)")
def _(m: Model) -> DataFrame:
    return m.table("pages").select("page_id", T.normalize_url(F.col("url")).alias("normalized"))


@query("x22_dedup_url", "SELECT page_id, regexp_replace(regexp_replace(url_decode(split_part(url, '#', 1)), '^http://', 'https://'), '/+$', '') dedup_key FROM pages")
def _(m: Model) -> DataFrame:
    return m.table("pages").select("page_id", T.dedup_url(F.col("url")).alias("dedup_key"))


@query("x23_domain", "SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '^www\\.', '') AS domain FROM pages")
def _(m: Model) -> DataFrame:
    return m.table("pages").select("page_id", T.domain(F.col("url")).alias("domain"))


@query("x24_person_name", "SELECT provider_id, v, trim(regexp_replace(regexp_replace(v, '[(（][^)）]*[)）]', '', 'g'), '[\\s　]+', ' ', 'g')) AS name " + _from(_PEOPLE))
def _(m: Model) -> DataFrame:
    return _formed(m, _PEOPLE).select("provider_id", "v", T.person_name(F.col("v")).alias("name"))


@query("x30_has_ascii_letter", "SELECT doc_id, regexp_matches(text, '[a-zA-Z]') has FROM documents")
def _(m: Model) -> DataFrame:
    return m.table("documents").select("doc_id", F.col("text").rlike("[a-zA-Z]").alias("has"))


@query("x31_price_and_minutes", "SELECT provider_id, v, TRY_CAST(replace(nullif(regexp_extract(v, '([0-9,]+)\\s*円', 1), ''), ',', '') AS INT) price, TRY_CAST(nullif(regexp_extract(v, '([0-9]+)\\s*分', 1), '') AS INT) AS minutes " + _from(_PRICES))
def _(m: Model) -> DataFrame:
    return _formed(m, _PRICES).select("provider_id", "v", T.price(F.col("v")).alias("price"), T.minutes(F.col("v")).alias("minutes"))


@query("x33_station_keyword", "SELECT provider_id, v, regexp_replace(split_part(regexp_replace(v, '[(（][^)）]*[)）]', '', 'g'), '・', 1), '駅$', '') keyword " + _from(_STATIONS))
def _(m: Model) -> DataFrame:
    return _formed(m, _STATIONS).select("provider_id", "v", T.station_keyword(F.col("v")).alias("keyword"))


@query("x35_slug_from_path", "SELECT page_id, regexp_replace(list_extract(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '/'), -1), '\\.html$', '') slug FROM pages")
def _(m: Model) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/+$", "")
    return m.table("pages").select("page_id", F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.html$", "").alias("slug"))


@query("x37_split_filter", "SELECT provider_id, v, array_to_string(list_filter(list_transform(string_split(v, ','), lambda x: trim(x)), lambda x: x <> ''), '|') parts " + _from(_LISTS))
def _(m: Model) -> DataFrame:
    return _formed(m, _LISTS).select("provider_id", "v", F.array_join(F.filter(F.transform(F.split("v", ","), lambda x: F.trim(x)), lambda x: x != ""), "|").alias("parts"))


@query("x38_json_field", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) k FROM events")
def _(m: Model) -> DataFrame:
    return m.table("events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("x40_content_hash", "SELECT page_id, left(sha256(html), 16) digest FROM pages")
def _(m: Model) -> DataFrame:
    return m.table("pages").select("page_id", F.substring(F.sha2("html", 256), 1, 16).alias("digest"))


@query("x41_recency", "SELECT review_id, CASE WHEN created_at >= TIMESTAMP '2001-11-05' - INTERVAL 7 DAY THEN 100 WHEN created_at >= TIMESTAMP '2001-11-05' - INTERVAL 30 DAY THEN 70 WHEN created_at >= TIMESTAMP '2001-11-05' - INTERVAL 90 DAY THEN 40 ELSE 10 END recency FROM reviews")
def _(m: Model) -> DataFrame:
    return m.reviews().select("review_id", recency(F.col("created_at"), AS_OF).alias("recency"))


@query("x42_date_parse", "SELECT provider_id, v, CAST(TRY_STRPTIME(replace(trim(v), '/', '-'), '%Y-%m-%d') AS DATE) AS day " + _from(_DAYS))
def _(m: Model) -> DataFrame:
    return _formed(m, _DAYS).select("provider_id", "v", T.day_of(F.col("v")).alias("day"))


@query("x43_earliest_date", "SELECT provider_id, min(created_at) earliest FROM reviews GROUP BY 1")
def _(m: Model) -> DataFrame:
    return m.reviews().groupBy("provider_id").agg(F.min("created_at").alias("earliest"))


@query("x46_preview", "SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '…' ELSE text END preview FROM documents")
def _(m: Model) -> DataFrame:
    return m.table("documents").select("doc_id", T.preview(F.col("text"), 80).alias("preview"))


@query("x47_xml_escape", "SELECT doc_id, md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) digest FROM documents")
def _(m: Model) -> DataFrame:
    from rankweave.sources.sinks import xml_escape

    return m.table("documents").select("doc_id", F.md5(xml_escape(F.col("text"))).alias("digest"))


@query("x48_file_count", "SELECT greatest(1, CAST(ceil(count(*) / 500.0) AS BIGINT)) files FROM reviews")
def _(m: Model) -> DataFrame:
    return m.reviews().agg(F.greatest(F.lit(1), F.ceil(F.count("*") / 500.0)).cast("bigint").alias("files"))


@query("x54_three_sizes", "SELECT provider_id, v, CASE WHEN provider_id % 3 < 2 THEN 70 + size END a, CASE WHEN provider_id % 3 = 0 THEN substr('ABCDEFG', CAST(1 + size % 7 AS INT), 1) END letter, CASE WHEN provider_id % 3 < 2 THEN 94 - size END b, CASE WHEN provider_id % 3 < 2 THEN 72 + size END c " + _from(_SIZES))
def _(m: Model) -> DataFrame:
    a, letter, b, c = T.three_sizes(F.col("v"))
    return _formed(m, _SIZES).select("provider_id", "v", a.alias("a"), letter.alias("letter"), b.alias("b"), c.alias("c"))


@query("x55_media_type", "SELECT provider_id, v, CASE lower(regexp_extract(v, '\\.([A-Za-z0-9]+)(?:[?#].*)?$', 1)) WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' ELSE 'application/octet-stream' END kind " + _from(_FILES))
def _(m: Model) -> DataFrame:
    return _formed(m, _FILES).select("provider_id", "v", T.media_type(F.col("v")).alias("kind"))


@query("x56_forall", "SELECT region_id, bool_and(a.slug LIKE '%' || lower(r.name) || '%') all_named FROM areas a JOIN regions r USING (region_id) GROUP BY 1")
def _(m: Model) -> DataFrame:
    lists = m.areas().groupBy("region_id").agg(F.collect_list("slug").alias("slugs")).join(F.broadcast(m.regions()), "region_id")
    return lists.select("region_id", F.forall("slugs", lambda s: F.contains(s, F.lower("name"))).alias("all_named"))
