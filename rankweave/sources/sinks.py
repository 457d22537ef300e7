"""Readers and writers for flat files, JSON documents and sitemaps."""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankweave.operators.ordered import byte_cuts


#: Quotes are doubled, as other readers of CSV expect.
_CSV = {"header": True, "quote": '"', "escape": '"', "emptyValue": "", "nullValue": ""}


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV with a header; every column a string, empty ones null.  ``multi_line``: values may hold line breaks."""
    return spark.read.options(**_CSV).csv(path, inferSchema=False, multiLine=multi_line)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with a header and a fixed column order."""
    df.select(*columns).write.mode("overwrite").options(**_CSV).csv(path)


def read_results(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Search-result documents, one row for each result; a document to a file or, without ``multi_line``, to a line."""
    docs = spark.read.json(path, multiLine=multi_line)
    return docs.select(*[c for c in docs.columns if c != "results"], F.explode("results").alias("result")).select("*", "result.*").drop("result")


def write_jsonl(df: DataFrame, path: str, rows_per_file: int) -> None:
    """JSON lines, split into files of bounded size."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).json(path)


def jsonl_files(df: DataFrame, order: list[str], max_bytes: int) -> DataFrame:
    """(order columns, line, file_no): rows as JSON lines, numbered into files of at most ``max_bytes`` each, in order."""
    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    lines = df.select(*order, line.alias("line")).withColumn("bytes", F.octet_length("line") + 1)
    return byte_cuts(lines, order, "bytes", max_bytes).drop("bytes")


def write_jsonl_by_bytes(df: DataFrame, path: str, order: list[str], max_bytes: int) -> None:
    """JSON lines in order, in files (``file_no=N``) that are filled one after the other up to ``max_bytes``."""
    files = jsonl_files(df, order, max_bytes)
    files.repartition("file_no").sortWithinPartitions("file_no", *order).select("line", "file_no").write.mode("overwrite").partitionBy("file_no").text(path)


def write_results(df: DataFrame, path: str, key: str, row: list[str]) -> None:
    """A JSON document for each key, with its rows nested as ``results``."""
    df.groupBy(key).agg(F.collect_list(F.struct(*row)).alias("results")).write.mode("overwrite").json(path)


def write_gzip_pages(df: DataFrame, path: str, category: str, key: str, html: str) -> None:
    """Pages as ``category/key.html.gz``, one file each, as ``read_gzip_pages`` finds them.

    Tasks write them under a name of their own and then rename them, so that a task
    that runs twice leaves one whole file.
    """
    given = df.select(F.col(category).cast("string").alias("c"), F.col(key).cast("string").alias("k"), F.coalesce(F.col(html), F.lit("")).alias("h"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for r in batch.to_pylist():
                folder = f"{root}/{r['c']}"
                fs.create_dir(folder, recursive=True)
                own = f"{folder}/_{uuid.uuid4().hex}"
                with fs.open_output_stream(own, compression=None) as f:
                    f.write(gzip.compress(r["h"].encode(), mtime=0))
                fs.move(own, f"{folder}/{r['k']}.html.gz")
            yield batch.slice(0, 0)

    given.mapInArrow(write, given.schema).write.format("noop").mode("overwrite").save()


def parse_dated_lines(df: DataFrame, payload: str) -> DataFrame:
    """Rows of ``date,score,text`` lines; a bad score is null, lines without text go."""
    rest = [c for c in df.columns if c != payload]
    lines = df.select(*rest, F.posexplode(F.split(payload, "\n")).alias("line_no", "line"))
    parts = F.split("line", ",", 3)
    out = lines.where(F.size(parts) == 3).select(*rest, "line_no", F.trim(parts[0]).alias("date"), F.expr("try_cast(trim(split(line, ',', 3)[1]) as int)").alias("score"), F.trim(parts[2]).alias("text"))
    return out.where("text != ''")


def xml_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def numbered(df: DataFrame, key: str, width: int = 1_000_000, out: str = "number") -> DataFrame:
    """Rows numbered from 1 in the order of a unique whole-number key.

    Keys are numbered within ranges of ``width``, and what lower ranges hold is
    added; only the ranges, one row each, meet in one task.
    """
    rows = df.withColumn("_range", F.floor(F.col(key) / width))
    inside = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_range").orderBy(key)))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = rows.groupBy("_range").agg(F.count("*").alias("_size")).select("_range", before.alias("_before"))
    return inside.join(ranges, "_range").withColumn(out, (F.col("_before") + F.col("_n")).cast("bigint")).drop("_range", "_n", "_before")


def paged(df: DataFrame, key: str, size: int = 1000) -> DataFrame:
    """Rows with ``page_no`` from 0, pages of ``size`` rows in key order."""
    return numbered(df, key).withColumn("page_no", F.floor((F.col("number") - 1) / size).cast("bigint")).drop("number")


def write_page_cache(df: DataFrame, path: str, category: str = "category") -> None:
    """Pages as gzipped Parquet, a folder for each category."""
    df.write.mode("overwrite").partitionBy(category).option("compression", "gzip").parquet(path)


def read_gzip_pages(spark: SparkSession, path: str) -> DataFrame:
    """(category, key, html) of files ``category/key.html.gz``; what is missing there has no row, so join from the left."""
    files = spark.read.text(f"{path}/*/*.html.gz", wholetext=True)
    name = F.col("_metadata.file_path")
    part = lambda i: F.regexp_extract(name, r"([^/]+)/([^/]+)\.html\.gz$", i)
    return files.select(part(1).alias("category"), part(2).alias("key"), F.col("value").alias("html"))


def sitemap_rows(df: DataFrame, key: str, base: str, per_file: int = 5000, name: str = "name") -> DataFrame:
    """(key, file_no, entry): XML fragments, numbered into files of ``per_file`` rows by key order."""
    entry = F.concat(F.lit(f"<url><loc>{base}"), F.col(key).cast("string"), F.lit("</loc><name>"), xml_escape(F.col(name)), F.lit("</name></url>"))
    return numbered(df, key).select(key, F.ceil(F.col("number") / per_file).cast("bigint").alias("file_no"), entry.alias("entry"))
