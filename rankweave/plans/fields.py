"""Text rules over whole tables, beside the fixed examples of the other modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.functions import directory as D
from rankweave.functions import text as T
from rankweave.plans.registry import query
from rankweave.sources.model import Model


@query("x18_known_age_wins", "SELECT provider_id, trim(name) AS name, CASE WHEN status = 'active' THEN age WHEN size % 2 = 0 THEN size ELSE 0 END age FROM providers")
def _(m: Model) -> DataFrame:
    """Active providers have an age of their own; of the others some have one in the name."""
    raw = F.expr("case when status = 'active' then concat(name, '(20)') when size % 2 = 0 then concat(name, '（', size, '）') else name end")
    name, age = T.name_and_age(raw, F.expr("if(status = 'active', age, 0)"))
    return m.providers().select("provider_id", name.alias("name"), age.alias("age"))


@query("x19_clean_names", "SELECT provider_id, trim(name) AS name FROM providers")
def _(m: Model) -> DataFrame:
    noisy = F.expr("concat(' ', name, array('(22)', '【NEW】today', ' 10:00-18:00', 'さん')[cast(provider_id % 4 as int)])")
    return m.providers().select("provider_id", D.clean_extracted_name(noisy).alias("name"))


@query("x20_spec_names", "SELECT provider_id, CASE WHEN status = 'active' THEN brand ELSE trim(name) END AS name, CASE WHEN status = 'active' THEN 130 + size END height, CASE WHEN status = 'active' THEN 70 + size END bust, CASE WHEN status = 'active' THEN 'G' END cup, CASE WHEN status = 'active' THEN 50 + size END waist, CASE WHEN status = 'active' THEN 72 + size END hip FROM providers")
def _(m: Model) -> DataFrame:
    joined = F.expr("if(status = 'active', concat(brand, '-', 130 + size, 'cmB.', 70 + size, '(g)W.', 50 + size, 'H.', 72 + size), trim(name))")
    fields = D.spec_name(joined)
    fields["name"] = F.regexp_replace(fields["name"], "-$", "")
    return m.providers().select("provider_id", *[c.alias(n) for n, c in fields.items()])


@query("x25_display_names", "SELECT venue_id, name FROM venues")
def _(m: Model) -> DataFrame:
    noisy = F.expr("concat(array('【new】', '★', '')[cast(venue_id % 3 as int)], name, array('東京店', '(支)', '☆')[cast(venue_id % 3 as int)])")
    return m.venues().select("venue_id", D.display_name(noisy, ["東京店", "(支)"]).alias("name"))


@query("x27_bracketed_readings", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'ローズ' WHEN 1 THEN 'リリー' END reading FROM documents")
def _(m: Model) -> DataFrame:
    titled = F.expr("concat(regexp_replace(substring(text, 1, 20), '[(（]', ''), array('（ローズ）', '(リリー)', '（x）')[cast(doc_id % 3 as int)])")
    return m.table("documents").select("doc_id", D.bracketed_reading(titled).alias("reading"))


@query("x32_reception", "SELECT venue_id, lpad(CAST(8 + venue_id % 4 AS VARCHAR), 2, '0') || ':00~翌' || CAST(venue_id % 6 AS VARCHAR) || ':30' AS hours, CASE WHEN is_active THEN CAST(venue_id % 5 AS VARCHAR) || ':00' END reception FROM venues")
def _(m: Model) -> DataFrame:
    raw = F.expr("concat(lpad(8 + venue_id % 4, 2, '0'), ':00~翌', venue_id % 6, ':30', if(is_active, concat('（受付：', venue_id % 5, ':00）'), ' '))")
    hours, reception = D.hours_and_reception(raw)
    return m.venues().select("venue_id", hours.alias("hours"), reception.alias("reception"))


@query("x39_repaired_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) k FROM events")
def _(m: Model) -> DataFrame:
    told = F.expr("if(event_id % 2 = 0, concat('Here: ```json\\n', props, '\\n``` done'), concat('So ', props, ' it is'))")
    return m.table("events").select("event_id", D.repaired_json(told, "k bigint")["k"].alias("k"))


@query("x53_attribute_texts", "SELECT provider_id, CASE provider_id % 3 WHEN 2 THEN NULL ELSE age END age, CASE provider_id % 3 WHEN 1 THEN NULL ELSE 130 + size END height, 70 + size bust, 94 - size waist, 72 + size hip FROM providers")
def _(m: Model) -> DataFrame:
    told = F.expr("concat(array(concat(age, '歳 T', 130 + size), concat('AGE ', age), concat('身長', 130 + size))[cast(provider_id % 3 as int)], ' B:', 70 + size, ' / W ', 94 - size, ' H', 72 + size)")
    return m.providers().select("provider_id", *[c.alias(n) for n, c in D.attributes(told).items()])
