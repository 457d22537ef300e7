"""Name, reading and keyword rules of directory data, as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankweave.functions.text import BLANK, capture, to_int

#: Voiced and half-voiced sound marks join with the letter before them.
HALF_WIDTH = "ｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜｦﾝｧｨｩｪｫｯｬｭｮｰ･"
FULL_WIDTH = "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワヲンァィゥェォッャュョー・"
VOICED = ("カキクケコサシスセソタチツテトハヒフヘホウ", "ガギグゲゴザジズゼゾダヂヅデドバビブベボヴ")
HALF_VOICED = ("ハヒフヘホ", "パピプペポ")


def full_width_kana(c: Column) -> Column:
    """Half-width kana in full width, with sound marks composed."""
    out = F.translate(c, HALF_WIDTH, FULL_WIDTH)
    for mark, (plain, marked) in (("ﾞ", VOICED), ("ﾟ", HALF_VOICED)):
        for a, b in zip(plain, marked):
            out = F.replace(out, F.lit(a + mark), F.lit(b))
    return out


def plausible_name(name: Column, venue: Column, exact: list[str], keywords: list[str]) -> Column:
    """1 to 20 characters, not a listed word, not the venue's name nor around it,
    without keywords, URLs and slashes, and more than digits and brackets."""
    n = F.trim(name)
    around = (F.length(venue) >= 3) & F.contains(n, venue)
    bad = n.isin(exact) | (n == venue) | around | n.rlike("https?:|/") | n.rlike(r"^[\d()（）\s]+$")
    for k in keywords:
        bad = bad | F.contains(n, F.lit(k))
    return F.length(n).between(1, 20) & ~F.coalesce(bad, F.lit(False))


def any_pattern(c: Column, patterns: list[str]) -> Column:
    """True where any pattern matches the trimmed text, or nothing is left of it."""
    return (F.trim(c) == "") | F.trim(c).rlike("|".join(f"(?:{p})" for p in patterns))


def same_host_page(url: Column, host: str) -> Column:
    """A page of the host: http(s), and no static file."""
    static = r"(?i)\.(css|js|png|jpe?g|gif|svg|ico|webp|pdf|zip|mp4|woff2?)(\?.*)?$"
    return url.rlike("^https?://") & (F.regexp_extract(url, "^https?://([^/:?#]+)", 1) == host) & ~url.rlike(static)


def blocked_agent(agent: Column, patterns: list[str]) -> Column:
    """Empty agents, and those that match a pattern in any case."""
    return F.coalesce(F.trim(agent), F.lit("")).isin("") | F.coalesce(agent.rlike("(?i)" + "|".join(patterns)), F.lit(False))


def effective_tier(tier: Column, until: Column, as_of: Column) -> Column:
    """A paid tier past its date counts as free."""
    return F.when(tier.isin("standard", "vip") & (until.isNull() | (until >= as_of)), tier).otherwise("free")


def clean_extracted_name(c: Column) -> Column:
    """Without age, bracketed tail, schedule tail and honorific."""
    steps = [(r"[(（]\d{1,2}(歳)?[)）]", ""), (r"【[^】]*】.*$", ""), (r"\s+\d{1,2}:\d{2}.*$", ""), (r"(さん|ちゃん)$", "")]
    return reduce(lambda x, s: F.trim(F.regexp_replace(x, *s)), steps, F.trim(c))


def display_name(c: Column, suffixes: list[str]) -> Column:
    """Without noise in brackets, area suffixes and edge symbols; the raw name if nothing is left."""
    ending = "|".join(re.escape(x) for x in suffixes)
    out = F.regexp_replace(F.regexp_replace(c, r"【[^】]*】|［[^］]*］|\[[^\]]*\]", ""), f"({ending})$", "")
    out = F.regexp_replace(out, r"^[\s　★☆♪・~〜-]+|[\s　★☆♪・~〜-]+$", "")
    return F.coalesce(F.nullif(out, F.lit("")), c)


def core_name(c: Column, words: list[str]) -> Column:
    """The content of brackets if any, else the name without listed words in front or at the end."""
    bare = reduce(lambda x, w: F.trim(F.regexp_replace(F.regexp_replace(x, f"^{w}", ""), f"{w}$", "")), map(re.escape, words), F.trim(c))
    return F.coalesce(capture(c, "[「『]([^」』]+)[」』]"), F.nullif(bare, F.lit("")), c)


def bracketed_reading(c: Column) -> Column:
    """Kana in full-width, else in half-width brackets."""
    return F.coalesce(capture(c, "（([ァ-ヶー・]+)）"), capture(c, r"\(([ァ-ヶー・]+)\)"))


def titled_reading(title: Column, patterns: list[tuple[str, str]], stop_words: list[str]) -> Column:
    """struct(value, pattern): the first pattern whose capture is no stop word."""
    found = F.lit(None).cast("struct<value:string,pattern:string>")
    for name, p in reversed(patterns):
        value = F.trim(capture(title, p))
        found = F.when(value.isNotNull() & ~value.isin(stop_words), F.struct(value.alias("value"), F.lit(name).alias("pattern"))).otherwise(found)
    return found


def opening_hours(c: Column) -> tuple[Column, Column]:
    """Start and end of ``10:00~24:00``."""
    p = r"(\d{1,2}:\d{2})\s*[~〜～-]\s*(?:翌)?(\d{1,2}:\d{2})"
    return capture(c, p, 1), capture(c, p, 2)


def hours_and_reception(c: Column) -> tuple[Column, Column]:
    """``12:00-5:00（受付：4:00）`` into the hours in front of the bracket and the reception in it; null without either."""
    p = r"^([^(（]+)(?:[(（]受付[：:]([^)）]+)[)）])?"
    return F.nullif(F.trim(F.regexp_extract(c, p, 1)), F.lit("")), F.trim(capture(c, p, 2))


def parent_keyword(name: Column, overrides: dict[str, str], siblings: Column) -> Column:
    """A parent area's keyword: an override, else a bracket's content, else the
    first of several names if no other parent shares the region, else the name."""
    first = F.split(name, "・")[0]
    out = F.coalesce(capture(name, "[(（]([^)）]+)[)）]"), F.when(siblings == 1, first), name)
    for k, v in overrides.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def direction_station(c: Column) -> Column:
    """Stations that only name a side of another."""
    return c.rlike("^(東|西|南|北|新).{1,4}(口|駅)$")


def repaired_json(c: Column, schema: str) -> Column:
    """JSON out of a fenced block or from the first brace to the last."""
    fenced = capture(c, r"(?s)```(?:json)?\s*(\{.*\})\s*```")
    return F.from_json(F.coalesce(fenced, capture(c, r"(?s)(\{.*\})")), schema)


def merged_reading(current: Column, extracted: Column, sentinel: str) -> Column:
    """The extracted reading unless it is the sentinel or differs from the current one by middle dots only."""
    new = F.regexp_replace(F.coalesce(F.nullif(extracted, F.lit(sentinel)), current), BLANK, "")
    same = F.translate(new, "・", "") == F.translate(current, "・", "")
    return F.when(F.coalesce(same, F.lit(False)), current).otherwise(new)


def first_named(sources: list[tuple[str, Column]]) -> Column:
    """struct(name, source) of the first source that has a name."""
    return F.coalesce(*[F.when(F.nullif(F.trim(c), F.lit("")).isNotNull(), F.struct(F.trim(c).alias("name"), F.lit(s).alias("source"))) for s, c in sources])


def spec_name(c: Column) -> dict[str, Column]:
    """``はる146cmB.90(G)W.57H.85`` into name, height, bust, cup, waist and hip; any other name stays whole."""
    joined = c.rlike(r"^\S+\d{2,3}cmB\.\d")
    of = lambda p: F.when(joined, capture(c, p))
    number = {"height": r"(\d{2,3})cm", "bust": r"B\.(\d{2,3})", "waist": r"W\.(\d{2,3})", "hip": r"H\.(\d{2,3})"}
    return {"name": F.coalesce(of(r"^(.+?)\d{2,3}cm"), c), "cup": F.upper(of(r"B\.\d{2,3}\(([A-Ma-m])\)")), **{k: to_int(of(p)) for k, p in number.items()}}


def attributes(c: Column) -> dict[str, Column]:
    """Age, height and the three sizes from free text."""
    first = lambda *ps: F.coalesce(*[to_int(capture(c, p)) for p in ps])
    body = r"\bB[:\s]*(\d{2,3})\D*?\bW[:\s]*(\d{2,3})\D*?\bH[:\s]*(\d{2,3})"
    sizes = {name: to_int(capture(c, body, i)) for i, name in enumerate(("bust", "waist", "hip"), 1)}
    return {"age": first(r"(\d{2})\s*歳", r"(?i)age\s*[:：]?\s*(\d{2})"), "height": first(r"T\s*[:：]?\s*(\d{3})", r"(\d{3})\s*cm", r"身長\s*[:：]?\s*(\d{3})"), **sizes}
