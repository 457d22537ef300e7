"""Tables written as files in the shared folder and scanned again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.operators.ordered import byte_cuts
from rankweave.operators.shared import shared_dir
from rankweave.plans.registry import query
from rankweave.sources import sinks
from rankweave.sources.model import Model
from rankweave.sources.sqlite import SqliteSource


def _place(m: Model, name: str) -> str:
    return f"{shared_dir(m.spark)}/{name}-{uuid.uuid4().hex}"


@query("s03_csv_files", "SELECT CAST(doc_id AS VARCHAR) doc_id, nullif(text, '') AS text, lang FROM documents")
def _(m: Model) -> DataFrame:
    """Documents with their line breaks, quotes and commas, as CSV with a header and fixed columns (s04) and back."""
    path = _place(m, "csv")
    sinks.write_csv(m.table("documents"), path, ["lang", "doc_id", "text"])
    return sinks.read_csv(m.spark, path, multi_line=True)


@query("s05_json_files", "SELECT conv_id, CAST(turn AS BIGINT) turn, role, text FROM conversations")
def _(m: Model) -> DataFrame:
    path = _place(m, "json")
    sinks.write_results(m.table("conversations"), path, "conv_id", ["turn", "role", "text"])
    return sinks.read_results(m.spark, path, multi_line=False).select("conv_id", "turn", "role", "text")


@query(
    "s06_files_by_bytes",
    ", s AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) i, octet_length(encode(coalesce(text, ''))) + 1 b FROM documents), f AS (SELECT doc_id, i, b, b AS held, 1 file_no FROM s WHERE i = 1 UNION ALL SELECT s.doc_id, s.i, s.b, CASE WHEN f.held + s.b > 100000 THEN s.b ELSE f.held + s.b END, CASE WHEN f.held + s.b > 100000 THEN f.file_no + 1 ELSE f.file_no END FROM f JOIN s ON s.i = f.i + 1) SELECT doc_id, CAST(file_no AS BIGINT) file_no FROM f",
)
def _(m: Model) -> DataFrame:
    """Texts as lines, numbered into files of at most 100,000 bytes."""
    lines = m.table("documents").select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("bytes"))
    return byte_cuts(lines, ["doc_id"], "bytes", 100_000).select("doc_id", "file_no")


@query("s08_page_cache", "SELECT split_part(url, ':', 1) category, CAST(page_id AS VARCHAR) AS key, html FROM pages")
def _(m: Model) -> DataFrame:
    """Compressed pages in a folder for each category, written and scanned again.

    ``sinks.write_gzip_pages`` and ``read_gzip_pages`` keep a file for each page, for other programs' caches;
    for whole tables so many files take far too long to list and open.
    """
    path = _place(m, "pages")
    sinks.write_page_cache(m.table("pages").select(F.split_part("url", F.lit(":"), F.lit(1)).alias("category"), F.col("page_id").cast("string").alias("key"), "html"), path)
    return m.spark.read.parquet(path).select("category", "key", "html")


@query("s09_sqlite", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000")
def _(m: Model) -> DataFrame:
    """Orders written to SQLite files by all tasks, and read from them through pushed filters."""
    m.spark.dataSource.register(SqliteSource)
    m.spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    path = _place(m, "sqlite")
    if not path.startswith("file://"):
        raise ValueError("SQLite files need a mounted folder")
    path = path.removeprefix("file://")
    m.table("orders").write.format("sqlite").mode("append").save(path)
    found = m.spark.read.format("sqlite").option("partitions", 4).load(path).where("o_orderstatus = 'F' and o_totalprice >= 1000")
    return found.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
