"""Queries that extract records from listing pages, and find further pages.

The tables' pages hold no records, so listings are made of the providers: a page
for each venue and each thousand provider ids, with a card for each of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.operators import cards, classify, dom, html
from rankweave.plans.registry import query
from rankweave.sources import sinks
from rankweave.sources.model import Model

_CARD = """concat('<li class="card"><a href="/item/', provider_id, '"><img src="/logo.png"><img class="photo" data-src="/img/', provider_id, '.jpg">', name,
 '</a><p class="spec">AGE ', age, ' T', 140 + size, ' B', 70 + size, ' W', 94 - size, ' H', 72 + size, '</p></li>')"""
_OBJECT = """concat('{id: ', provider_id, ', name: "', name, '", tags: [1, {id: 0, mark: "]"}], photo: \\'/img/', provider_id, '.jpg\\'}')"""
#: The cards' rows in SQL.
_LISTED = ", l AS (SELECT provider_id, venue_id, provider_id // 1000 part, name, age, size, 'https://v' || venue_id || '.example' site FROM providers WHERE venue_id IS NOT NULL)"
_VALID = "age <= 60 AND 140 + size <= 185 AND 94 - size BETWEEN 45 AND 90 AND 72 + size <= 120 AND age <> 94 - size"
#: A page's links in SQL; all of them begin with ``/``.
_A = '(?is)<a\\b[^>]*?\\bhref="([^"]*)"[^>]*>(.*?)</a>'
_LINKS = f""", a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '{_A}', 1)) href, unnest(regexp_extract_all(html, '{_A}', 2)) label,
 unnest(range(len(regexp_extract_all(html, '{_A}', 1)))) pos, regexp_extract(url, '^[a-z]+://[^/?#]*') site FROM pages)"""


def _common(site: str) -> str:
    """What the URLs of a site have in common, in SQL."""
    return f""", u AS (SELECT DISTINCT {site} site, url FROM pages), n AS (SELECT site, count(*) total FROM u GROUP BY 1),
 k AS (SELECT site, value, count(*) n, 'query' kind, 1 o FROM (SELECT site, url, unnest(list_distinct(regexp_extract_all(url, '[?&]([A-Za-z_]+)=[0-9]', 1))) AS value FROM u) GROUP BY 1, 2
  UNION ALL SELECT site, value, count(*), 'path', 0 FROM (SELECT site, url, unnest(list_transform(range(1, greatest(len(p), 2)), lambda i: array_to_string(p[1:i], '/') || '/')) AS value
   FROM (SELECT site, url, string_split(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1), '/') p FROM u)) GROUP BY 1, 2),
 x AS (SELECT site, kind, value FROM k JOIN n USING (site) WHERE n = total QUALIFY row_number() OVER (PARTITION BY site ORDER BY o DESC, length(value) DESC, value DESC) = 1)"""


def _listed(m: Model) -> DataFrame:
    return m.providers().where("venue_id is not null").withColumn("part", F.expr("provider_id div 1000"))


def _spread(m: Model, rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by keys in as many tasks as shuffles have: adaptive execution would leave rows that are few in bytes, but long to work on, to one or two."""
    return rows.repartition(int(m.spark.conf.get("spark.sql.shuffle.partitions")), *keys)


def listings(m: Model) -> DataFrame:
    """(venue_id, part, url, html, script): at most a thousand cards a page."""
    pieces = F.array_sort(F.collect_list(F.struct("provider_id", F.expr(_CARD).alias("card"), F.expr(_OBJECT).alias("object"))))
    pages = _listed(m).groupBy("venue_id", "part").agg(pieces.alias("p"))
    page = F.concat(F.lit('<html><body><ul class="list">'), F.array_join("p.card", ""), F.lit("</ul></body></html>"))
    script = F.concat(F.lit('var shop = {title: "[a", items: ['), F.array_join("p.object", ", "), F.lit("], more: []};"))
    return pages.select("venue_id", "part", F.concat(F.lit("https://v"), "venue_id", F.lit(".example/list")).alias("url"), page.alias("html"), script.alias("script"))


@query("s10_paged_scan", "SELECT (row_number() OVER (ORDER BY provider_id) - 1) // 1000 page_no, provider_id FROM providers")
def _(m: Model) -> DataFrame:
    return sinks.paged(m.providers().select("provider_id"), "provider_id").select("page_no", "provider_id")


@query("x45_id_pattern", _common("nullif(regexp_replace(regexp_extract(url, '(?i)^[a-z]+://([^/?#:]+)', 1), '(?i)^www[.]', ''), '')") + " SELECT site, kind, value FROM x")
def _(m: Model) -> DataFrame:
    from rankweave.functions.text import domain

    return classify.id_patterns(m.table("pages").select(domain(F.col("url")).alias("site"), "url"), "site", "url")


@query("x50_charset", ", c AS (SELECT *, CASE WHEN url LIKE 'http:%' THEN 'none' WHEN url LIKE '%.org/%' THEN 'default' ELSE 'other' END sent FROM pages) SELECT page_id, CASE sent WHEN 'other' THEN 'shift_jis' ELSE 'utf-8' END charset FROM c")
def _(m: Model) -> DataFrame:
    sent = F.when(F.col("url").like("http:%"), None).when(F.col("url").like("%.org/%"), "text/html; charset=ISO-8859-1").otherwise('text/html; charset="Shift_JIS"')
    body = F.when(F.col("url").like("%.net/%"), F.replace("html", F.lit('<meta charset="utf-8">'), F.lit(""))).otherwise(F.col("html"))
    return m.table("pages").select("page_id", cards.charset(sent, F.encode(body, "UTF-8")).alias("charset"))


@query(
    "e06_expanded_urls",
    _LINKS + _common("regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)") + """, t AS (SELECT DISTINCT regexp_extract(site, '://(.*)$', 1) site, site || href url FROM a)
 SELECT t.site, t.url FROM t JOIN x USING (site) WHERE t.url NOT IN (SELECT url FROM pages) AND NOT regexp_matches(t.url, '(?i)[.](css|js|png|jpe?g|gif|svg|ico|webp|pdf|zip|mp4|woff2?)([?].*)?$')
 AND NOT regexp_matches(t.url, '[?&](page|p)=[0-9]+|/page/[0-9]+')
 AND CASE kind WHEN 'query' THEN starts_with(regexp_extract(t.url, '[?]([^#]*)', 1), value || '=') ELSE starts_with(regexp_extract(t.url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1), value) END""",
)
def _(m: Model) -> DataFrame:
    pages = m.table("pages")
    return cards.expanded_urls(pages.select("url"), cards.page_links(pages, "page_id", "url", "html").select(F.col("link").alias("url")), "url")


#: What a site's seeds have in common, in SQL.
_SEEDED = """, u AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) site, url, regexp_extract(url, '[?]([^#]*)', 1) query, string_split(rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), '/') parts FROM pages),
 q AS (SELECT DISTINCT site, 'query' kind, split_part(query, '=', 1) AS value FROM u WHERE query <> ''),
 g AS (SELECT site, array_to_string(parts[1:k], '/') b, k FROM (SELECT site, parts, unnest(range(2, len(parts) + 1)) k FROM u)),
 n AS (SELECT site, count(*) total FROM u WHERE len(parts) > 1 GROUP BY 1),
 h AS (SELECT site, 'path' kind, arg_max(b, k) || '/' AS value FROM (SELECT site, b, max(k) k, count(*) c FROM g GROUP BY 1, 2) JOIN n USING (site) WHERE c = total GROUP BY 1),
 y AS (SELECT * FROM q UNION ALL SELECT * FROM h), x AS (SELECT * FROM y UNION ALL SELECT DISTINCT site, 'internal', '' FROM u WHERE site NOT IN (SELECT site FROM y))"""


@query("x45_seed_patterns", _SEEDED + " SELECT site, kind, value FROM x")
def _(m: Model) -> DataFrame:
    return cards.seed_patterns(m.table("pages").select(cards.host(F.col("url")).alias("site"), "url"), "site", "url")


@query(
    "e06_urls_like_seeds",
    _LINKS + _SEEDED + """, t AS (SELECT DISTINCT regexp_extract(site, '://(.*)$', 1) site, site || href url, regexp_extract(href, '^[^?#]*') p, regexp_extract(href, '[?]([^#]*)', 1) query FROM a)
 SELECT DISTINCT t.site, t.url FROM t JOIN x USING (site) WHERE t.url NOT IN (SELECT url FROM pages) AND NOT regexp_matches(t.url, '(?i)[.](css|js|png|jpe?g|gif|svg|ico|webp|pdf|zip|mp4|woff2?)([?].*)?$') AND NOT regexp_matches(p, '/page/[0-9]+(/|$)')
 AND CASE kind WHEN 'query' THEN starts_with(t.query, value || '=') WHEN 'path' THEN starts_with(p, value) ELSE rtrim(p, '/') <> '' AND NOT regexp_matches(lower(rtrim(p, '/')), '^/(xmlrpc|sitemap|reservation|contact|access|privacy|terms|inquiry|recruit|faq)') END""",
)
def _(m: Model) -> DataFrame:
    pages = m.table("pages")
    return cards.urls_like_seeds(pages.select("url"), cards.page_links(pages, "page_id", "url", "html").select(F.col("link").alias("url")), "url")


@query("e03_page_links", _LINKS + " SELECT page_id, min(pos) pos, site || href link, arg_min(trim(regexp_replace(regexp_replace(label, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), pos) AS label FROM a GROUP BY page_id, site, href")
def _(m: Model) -> DataFrame:
    """Links with same host and their labels."""
    return cards.page_links(m.table("pages"), "page_id", "url", "html").select("page_id", F.col("pos").cast("bigint").alias("pos"), "link", "label")


@query("e11_script_records", _LISTED + " SELECT venue_id, CAST(provider_id AS VARCHAR) id, name, '/img/' || provider_id || '.jpg' photo FROM l")
def _(m: Model) -> DataFrame:
    r = F.col("record")
    return cards.script_records(listings(m).select("venue_id", "script"), "script", "items").select("venue_id", r["id"].alias("id"), r["name"].alias("name"), r["photo"].alias("photo"))


@query("e12_ruled_fields", _LISTED + " SELECT venue_id, part, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS name, age, 72 + size hip, '/img/' || provider_id || '.jpg' photo FROM l QUALIFY row_number() OVER (PARTITION BY venue_id, part ORDER BY provider_id) = 1")
def _(m: Model) -> DataFrame:
    rules = {
        "name": {"selector": "ul.list .card a"},
        "age": {"selector": "p.spec", "regex": r"AGE (\d+)", "number": True},
        "hip": {"selector": ".spec", "regex": r"HIP (\d+)", "fallback_regex": r"H(\d+)", "number": True},
        "photo": {"selector": ".card img.photo", "attr": "data-src"},
    }
    return listings(m).select("venue_id", "part", *[c.alias(n) for n, c in cards.ruled_fields(F.col("html"), rules).items()])


_NESTED = """concat('<div class="row"><div class="cell"><a href="/item/', provider_id, '"><span>', name, '</span></a><div class="data"><div><img src="/icon.png"><img class="photo" data-src="/img/', provider_id,
 '.jpg"></div><p class="spec">AGE ', age, ' T', 140 + size, ' B', 70 + size, ' W', 94 - size, ' H', 72 + size, '</p></div></div><div class="foot"><p class="spec">AGE 99</p></div></div>')"""


def nested_listings(m: Model) -> DataFrame:
    """(venue_id, part, url, html): cards of nested elements of one name, up to a thousand a page."""
    cells = F.array_sort(F.collect_list(F.struct("provider_id", F.expr(_NESTED).alias("card"))))
    pages = _spread(m, _listed(m), "venue_id", "part").groupBy("venue_id", "part").agg(cells.alias("p"))
    page = F.concat(F.lit('<html><body><div><a href="/">top</a></div><div class="list">'), F.array_join("p.card", ""), F.lit("</div></body></html>"))
    return pages.select("venue_id", "part", F.concat(F.lit("https://v"), "venue_id", F.lit(".example/list")).alias("url"), page.alias("html"))


@query("e17_enclosing_cards", _LISTED + f" SELECT venue_id, part, site || '/item/' || provider_id link, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS name, age, 140 + size height, 70 + size bust, 94 - size waist, 72 + size hip, site || '/img/' || provider_id || '.jpg' image, {_VALID} valid FROM l")
def _(m: Model) -> DataFrame:
    pages = nested_listings(m).withColumn("page", F.struct("venue_id", "part"))
    found = dom.enclosing_cards(pages, "page", "url", "html")
    return found.where("link like '%/item/%'").select("page.venue_id", "page.part", *[c for c in found.columns if c != "page"])


@query("e12_nested_fields", _LISTED + " SELECT venue_id, part, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS name, age, 72 + size hip, '/img/' || provider_id || '.jpg' photo, 99 foot FROM l QUALIFY row_number() OVER (PARTITION BY venue_id, part ORDER BY provider_id) = 1")
def _(m: Model) -> DataFrame:
    pages = nested_listings(m).withColumn("page", F.struct("venue_id", "part"))
    rules = {
        "name": {"selector": "div.list div.cell > a"},
        "age": {"selector": ".row > .cell p.spec", "regex": r"AGE (\d+)", "number": True},
        "hip": {"selector": ".row > .cell p.spec", "regex": r"H(\d+)", "number": True},
        "foot": {"selector": ".row > .foot > .spec", "regex": r"(\d+)", "number": True},
        "photo": {"selector": ".data > div > img.photo", "attr": "data-src"},
    }
    found = dom.first_values(pages, "page", "html", rules)
    return found.select("page.venue_id", "page.part", *rules)


@query("e07_listing_images", _LISTED + " SELECT DISTINCT venue_id, part, '/img/' || provider_id || '.jpg' src FROM l UNION SELECT DISTINCT venue_id, part, '/icon.png' FROM l")
def _(m: Model) -> DataFrame:
    return nested_listings(m).select("venue_id", "part", F.explode(html.image_sources(F.col("html"))).alias("src"))


@query("r10_listing_portraits", _LISTED + """ SELECT venue_id, part, '<img class="photo" data-src="/img/' || provider_id || '.jpg">' tag, 3 score FROM l QUALIFY row_number() OVER (PARTITION BY venue_id, part ORDER BY provider_id) <= 5""")
def _(m: Model) -> DataFrame:
    pages = nested_listings(m).withColumn("page", F.struct("venue_id", "part"))
    return classify.image_candidates(pages, "page", "html").select("page.venue_id", "page.part", "tag", "score")


_PROFILE = """concat('<html><body><div class="top"><h1 class="', if(provider_id % 5 = 0, 'title', 'name'), '">', name, '</h1></div><div class="profile ', if(provider_id % 5 = 0, 'old', 'new'), '"><div><p class="',
 if(provider_id % 5 = 0, 'text', 'spec'), '">AGE ', age, ' T', 140 + size, ' <b>B', 70 + size, '</b></p></div></div></body></html>')"""
_SAMPLES = "(SELECT count(*) FILTER (provider_id % 5 <> 0) FROM providers WHERE provider_id % 2 = 0)"


def _profiles(m: Model) -> tuple[DataFrame, DataFrame]:
    """A page of its own for each provider, and the fields of every second one as known values."""
    rows = _spread(m, m.providers(), "provider_id")
    fields = F.explode(F.create_map(F.lit("name"), "name", F.lit("age"), F.col("age").cast("string"), F.lit("height"), (F.col("size") + 140).cast("string"), F.lit("bust"), (F.col("size") + 70).cast("string"))).alias("field", "value")
    return rows.select("provider_id", F.expr(_PROFILE).alias("html")), rows.where("provider_id % 2 = 0").select("provider_id", fields)


@query("r11_mined_rules", rf"SELECT * FROM (VALUES ('name', 'div.top > h1.name', NULL), ('age', 'div > p.spec', 'AGE\s*(\d+)'), ('height', 'div > p.spec', 'T\s*(\d+)'), ('bust', 'p.spec > b', '(\d+)')) r(field, selector, regex), (SELECT {_SAMPLES} votes)")
def _(m: Model) -> DataFrame:
    return dom.mined_rules(*_profiles(m), "provider_id", "html")


@query("r11_fields_by_mined_rules", "SELECT provider_id, CASE WHEN provider_id % 5 <> 0 THEN name END AS name, CASE WHEN provider_id % 5 <> 0 THEN age END age, CASE WHEN provider_id % 5 <> 0 THEN 140 + size END height, CASE WHEN provider_id % 5 <> 0 THEN 70 + size END bust FROM providers WHERE provider_id % 2 = 1")
def _(m: Model) -> DataFrame:
    """Rules mined from one half of the pages, applied to the other."""
    pages, known = _profiles(m)
    rules = {r.field: {"selector": r.selector, "regex": r.regex, "number": r.field != "name"} for r in dom.mined_rules(pages, known, "provider_id", "html").collect()}  # a row for each field
    return dom.first_values(pages.where("provider_id % 2 = 1"), "provider_id", "html", rules).select("provider_id", "name", "age", "height", "bust")


@query("e15_record_links", _LINKS + " SELECT DISTINCT page_id, site || href link, false direct FROM a WHERE regexp_matches(regexp_extract(href, '^[^?#]*'), '^/t[^/]*/*$') AND NOT regexp_matches(site || href, '[?&](page|p)=[0-9]+|/page/[0-9]+')")
def _(m: Model) -> DataFrame:
    found = cards.detail_links(m.table("pages"), "page_id", "url", "html", [r"^/t[^/]*$", r"/item/\d+"], ["/blog", "/news"])
    return found.select("page_id", "link", "direct")


@query("e16_list_page", _LINKS + ", c AS (SELECT page_id, pos, site || href link, CASE WHEN contains(lower(label), 'the') THEN 1 WHEN contains(lower(href), '/de') THEN 2 END tier FROM a) SELECT page_id, tier, link FROM c WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY tier, pos) = 1")
def _(m: Model) -> DataFrame:
    found = m.table("pages").select("page_id", cards.list_page(F.col("url"), F.col("html"), ["the"], ["/de"]).alias("x"))
    return found.where("x is not null").select("page_id", "x.tier", "x.link")


@query("e17_cards", _LISTED + f" SELECT venue_id, site || '/item/' || provider_id link, trim(name) AS name, age, 140 + size height, 70 + size bust, 94 - size waist, 72 + size hip, site || '/img/' || provider_id || '.jpg' image, {_VALID} valid FROM l")
def _(m: Model) -> DataFrame:
    return cards.cards(listings(m), "venue_id", "url", "html")


@query("e18_thumbnails", _LISTED + " SELECT p.provider_id, arg_min(q.site || '/img/' || q.provider_id || '.jpg', q.provider_id) image FROM l p JOIN l q USING (venue_id, part) WHERE contains(q.site || '/item/' || q.provider_id, p.site || '/item/' || p.provider_id) OR contains(trim(q.name), trim(p.name)) GROUP BY 1")
def _(m: Model) -> DataFrame:
    pages = listings(m).select("venue_id", "part", "url", "html")
    wanted = _listed(m).select("venue_id", "part", "provider_id", F.trim("name").alias("name"))
    source = F.concat(cards.origin(F.col("url")), F.lit("/item/"), F.col("provider_id"))
    return wanted.join(pages, ["venue_id", "part"]).select("provider_id", cards.thumbnail(F.col("html"), F.col("url"), source, F.col("name")).alias("image"))
