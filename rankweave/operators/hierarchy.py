"""Hierarchies of areas and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve_keywords(rows: DataFrame, keyword: str, region: str, level: str, position: str) -> DataFrame:
    """Add ``outcome``: which page keeps a keyword that several want.

    Alone it is ``unique``.  Within a region the first by level and position
    stays, others are ``absorbed``; what stays is ``cross_region`` if other
    regions want the keyword too, else ``kept``.
    """
    everyone, local = Window.partitionBy(keyword), Window.partitionBy(keyword, region).orderBy(level, position)
    marked = rows.withColumns({"_n": F.count("*").over(everyone), "_low": F.min(region).over(everyone), "_high": F.max(region).over(everyone), "_rn": F.row_number().over(local)})
    outcome = F.when(F.col("_n") == 1, "unique").when(F.col("_rn") > 1, "absorbed").when(F.col("_low") != F.col("_high"), "cross_region").otherwise("kept")
    return marked.withColumn("outcome", outcome).drop("_n", "_low", "_high", "_rn")


def path_rows(pages: DataFrame, url: str) -> DataFrame:
    """(path, depth, slug, parent_slug) of each distinct URL path."""
    path = F.regexp_replace(F.regexp_extract(url, "^[a-z]+://[^/]+(/[^?#]*)", 1), "/+$", "")
    rows = pages.select(path.alias("path")).distinct().withColumn("parts", F.filter(F.split("path", "/"), lambda x: x != ""))
    return rows.where(F.size("parts") > 0).select(
        "path", F.size("parts").cast("bigint").alias("depth"), F.try_element_at("parts", F.lit(-1)).alias("slug"), F.try_element_at("parts", F.lit(-2)).alias("parent_slug")
    )
