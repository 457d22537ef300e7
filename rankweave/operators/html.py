"""Extraction from HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements whose content is not shown.
HIDDEN = "script|style|noscript|template|svg|iframe"
#: Characters by name; ``&amp;`` comes last, so that nothing is decoded twice.
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "copy": "©", "reg": "®", "trade": "™", "middot": "·", "bull": "•", "hellip": "…", "ndash": "–", "mdash": "—", "laquo": "«", "raquo": "»",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "yen": "¥", "euro": "€", "pound": "£", "cent": "¢", "times": "×", "deg": "°", "para": "¶", "sect": "§", "amp": "&",
}


def unescaped(text: Column) -> Column:
    """Text with its character references decoded: numbers, and the names of ``ENTITIES``; others stay as they are."""

    def numbered(piece: Column) -> Column:
        digits = F.regexp_extract(piece, "^([xX][0-9a-fA-F]{1,6}|[0-9]{1,7});?", 1)
        code = F.when(F.lower(digits).startswith("x"), F.conv(F.substring(digits, 2, 6), 16, 10)).otherwise(digits).try_cast("int")
        sign = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        known = (digits != "") & code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(known, F.concat(sign, F.regexp_replace(piece, "^([xX][0-9a-fA-F]{1,6}|[0-9]{1,7});?", ""))).otherwise(F.concat(F.lit("&#"), piece))

    pieces = F.split(text, "&#")
    out = F.when(F.size(pieces) > 1, F.array_join(F.concat(F.slice(pieces, 1, 1), F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), numbered)), "")).otherwise(text)
    for name, sign in ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(sign))
    return out


def visible_text(html: Column) -> Column:
    """The shown text, one line for each run that is not blank; empty for null.

    Comments, declarations and hidden elements go, and tags part runs.
    """
    shown = F.regexp_replace(F.coalesce(html, F.lit("")), rf"(?is)<!--.*?(?:-->|$)|<[!?][^>]*>|<({HIDDEN})\b[^>]*>.*?(?:</\1\s*>|$)", "\n")
    runs = F.split(F.regexp_replace(shown, "</?[a-zA-Z][^>]*>", "\n"), "\n")
    lines = F.transform(runs, lambda r: F.regexp_replace(unescaped(r), r"^[\s\u00a0]+|[\s\u00a0]+$", ""))
    return F.array_join(F.filter(lines, lambda r: r != ""), "\n")


def links(html: Column) -> Column:
    """Distinct hrefs of anchors, in order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit('<a[^>]+href="([^"]+)"'), F.lit(1)))


def page_title(html: Column) -> Column:
    """The title, else the og:title; null without text in either."""
    patterns = [r"(?is)<title[^>]*>(.*?)</title>", r'(?is)<meta[^>]+property="og:title"[^>]+content="([^"]*)"', r'(?is)<meta[^>]+content="([^"]*)"[^>]+property="og:title"']
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(html, p, 1)), F.lit("")) for p in patterns])


def page_number(url: Column) -> Column:
    """The number of a listing's page, from its path or query; null without one."""
    path, key = F.regexp_extract(url, r"/page/(\d+)", 1), F.regexp_extract(url, r"[?&](?:page|p|pg|paged)=(\d+)", 1)
    return F.coalesce(path.try_cast("bigint"), key.try_cast("bigint"))


def image_sources(html: Column) -> Column:
    """Distinct image addresses from src, data-src, srcset's first, linked files and CSS backgrounds."""
    patterns = [r'(?i)<img[^>]+?\bsrc="([^"]+)"', r'(?i)\bdata-(?:src|original)="([^"]+)"', r'(?i)\bsrcset="\s*([^"\s,]+)', r'(?i)href="([^"]+\.(?:jpe?g|png|webp|gif))"', r"(?i)background(?:-image)?:\s*url\(['\"]?([^'\")]+)"]
    return F.array_distinct(F.concat(*[F.regexp_extract_all(html, F.lit(p), F.lit(1)) for p in patterns]))


def best_heading(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, heading, source, confidence): the first of h1, h2, og:title and title that has text."""
    sources = [("h1", r"(?is)<h1[^>]*>(.*?)</h1>", 0.85), ("h2", r"(?is)<h2[^>]*>(.*?)</h2>", 0.80), ("og", r'(?is)<meta[^>]+property="og:title"[^>]+content="([^"]*)"', 0.75), ("title", r"(?is)<title[^>]*>(.*?)</title>", 0.70)]
    found = []
    for name, pattern, confidence in sources:
        text = F.trim(F.regexp_replace(F.regexp_extract(html, pattern, 1), "<[^>]+>", ""))
        found.append(F.when(text != "", F.struct(text.alias("heading"), F.lit(name).alias("source"), F.lit(confidence).alias("confidence"))))
    return pages.select(key, F.coalesce(*found).alias("x")).where("x is not null").select(key, "x.*")
