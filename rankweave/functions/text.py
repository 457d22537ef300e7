"""Text functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space with the full-width space.
BLANK = r"[\s　]"


def contains_ignoring_case(c: Column, needle: str) -> Column:
    """The needle taken literally: no wildcards."""
    return F.contains(F.lower(c), F.lit(needle.lower()))


def none_of(c: Column, needles: list[str]) -> Column:
    """True where no needle occurs, in any case; null for null."""
    return reduce(lambda a, b: a & b, [~contains_ignoring_case(c, n) for n in needles])


def long_enough_query(q: Column) -> Column:
    """Two characters if any is beyond ASCII, else three."""
    return F.length(q) >= F.when(q.rlike(r"[^\x00-\x7F]"), 2).otherwise(3)


def capture(c: Column, pattern: str, group: int = 1) -> Column:
    """A regex group, null without a match."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def to_int(c: Column) -> Column:
    return c.try_cast("int")


def clamp(c: Column, low: int, high: int) -> Column:
    """Into the range; null for what is no number."""
    n = to_int(c)
    return F.when(n.isNotNull(), F.least(F.greatest(n, F.lit(low)), F.lit(high)))


def bounded_int(c: Column, low: int, high: int) -> Column:
    """Null out of range."""
    n = to_int(c)
    return F.when(n.between(low, high), n)


def waist_step(w: Column) -> Column:
    """Steps 1 to 5 at fixed limits."""
    return F.when(w <= 54, 1).when(w <= 58, 2).when(w <= 63, 3).when(w <= 68, 4).when(w > 68, 5)


def letter_step(letter: Column) -> Column:
    """A letter's step: up to B 1, D 2, F 3, G 4, else 5; null when empty."""
    c = F.upper(F.trim(letter))
    return F.when(c == "", None).when(c >= "H", 5).when(c >= "G", 4).when(c >= "E", 3).when(c >= "C", 2).when(c >= "A", 1)


#: The review counts at which levels begin.
LEVEL_STARTS = [1, 5, 10, 20, 35, 50, 75, 100, 150]


def level(n: Column) -> Column:
    """How many level starts a count (at most 199) has reached."""
    capped = F.least(n, F.lit(199))
    return reduce(lambda a, b: a + b, [(capped >= s).cast("int") for s in LEVEL_STARTS])


def name_and_age(c: Column, known: Column | None = None) -> tuple[Column, Column]:
    """``name(19)`` into name and age; a known age wins, and the age is 0 without any."""
    ages = [F.nullif(known, F.lit(0))] if known is not None else []
    return F.trim(F.regexp_replace(c, r"[(（]\d{1,2}[)）]\s*$", "")), F.coalesce(*ages, to_int(capture(c, r"[(（](\d{1,2})[)）]\s*$")), F.lit(0))


def number_and_letter(c: Column) -> tuple[Column, Column]:
    """``83(D)`` into 83 and D."""
    return to_int(capture(c, r"^(\d+)")), capture(c, r"\(([A-Z])\)")


def normalize_url(u: Column) -> Column:
    """Lower-cased, https, no ``www.``, no ``/`` at the end of the path; the query stays."""
    low = F.lower(F.trim(u))
    no_scheme = F.regexp_replace(F.regexp_replace(low, "^https?://", ""), r"^www\.", "")
    path, query = F.regexp_replace(F.substring_index(F.substring_index(no_scheme, "#", 1), "?", 1), "/+$", ""), capture(no_scheme, r"(\?[^#]*)")
    return F.concat(F.lit("https://"), path, F.coalesce(query, F.lit("")))


def dedup_url(u: Column) -> Column:
    """Without fragment, percent-decoded, https, no ``/`` at the end; case kept."""
    bare = F.replace(F.substring_index(u, "#", 1), F.lit("+"), F.lit("%2B"))
    decoded = F.coalesce(F.try_url_decode(bare), bare)
    return F.regexp_replace(F.regexp_replace(decoded, "^http://", "https://"), "/+$", "")


def domain(u: Column) -> Column:
    """The host without ``www.``; null without a host."""
    return F.regexp_replace(F.nullif(F.regexp_extract(u, r"(?i)^[a-z]+://([^/?#:]+)", 1), F.lit("")), r"(?i)^www\.", "")


def person_name(c: Column) -> Column:
    """Trimmed, blanks collapsed, brackets with content dropped."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[(（][^)）]*[)）]", ""), BLANK + "+", " "))


def price(c: Column) -> Column:
    """``16,000円`` into 16000."""
    return to_int(F.replace(capture(c, r"([\d,]+)\s*円"), F.lit(","), F.lit("")))


def minutes(c: Column) -> Column:
    return to_int(capture(c, r"(\d+)\s*分"))


def station_keyword(c: Column) -> Column:
    """The first name of a station list, without the word for station and brackets."""
    first = F.split(F.regexp_replace(c, r"[(（][^)）]*[)）]", ""), "・")[0]
    return F.regexp_replace(first, "駅$", "")


def city_keyword(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[(（][^)）]*[)）]", ""), "市$", "")


def preview(c: Column, n: int) -> Column:
    """The first characters, with an ellipsis if there are more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def three_sizes(c: Column) -> tuple[Column, Column, Column, Column]:
    """``82(D)-57-84``: three numbers and an optional letter."""
    pattern = r"(\d{2,3})\s*(?:\(([A-Z])\))?\s*-\s*(\d{2,3})\s*-\s*(\d{2,3})"
    return to_int(capture(c, pattern, 1)), capture(c, pattern, 2), to_int(capture(c, pattern, 3)), to_int(capture(c, pattern, 4))


def day_of(c: Column) -> Column:
    """``YYYY/MM/DD`` or ``YYYY-MM-DD``; null for anything else."""
    return F.try_to_timestamp(F.replace(F.trim(c), F.lit("/"), F.lit("-")), F.lit("yyyy-MM-dd")).cast("date")


def media_type(u: Column) -> Column:
    """By extension, with a default."""
    kinds = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp"}
    ext = F.lower(F.regexp_extract(u, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    out = F.lit("application/octet-stream")
    for e, k in kinds.items():
        out = F.when(ext == e, k).otherwise(out)
    return out
