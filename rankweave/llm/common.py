"""Small helpers that the operators of this package share."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions.arrays import bind, running  # noqa: F401  (used by the operators)

#: Words of the contracts: maximal runs outside these ASCII white space characters.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``; where that is unset and Spark
    runs in this process alone, as in tests, a temporary folder of this machine is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(f"spark.checkpoint.dir is unset: executors of {master} share no folder with the driver")
        found = f"file://{tempfile.mkdtemp(prefix='rankweave-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: computed once,
    its lineage cut, and still there when executors are lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once all that was made of them is written itself."""
    for df in tables:
        session = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = session._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def where_computed(df: DataFrame, flag: str) -> DataFrame:
    """Rows whose boolean column is true, with the column computed first.

    A plain filter would be pushed below the projections that compute the flag,
    with every expression written out at each of its uses.  A filter that also
    uses a row number stays above them.
    """
    return df.withColumn("__row", F.monotonically_increasing_id()).where(F.col(f"`{flag}`") & (F.col("__row") >= 0)).drop("__row")


def words_of(text: Column) -> Column:
    """The words of a text in order; an empty array without words or text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``chars`` bytes of text.

    A batch that Spark hands over can hold very many long texts; what is built
    from it in Python would then not be bounded.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
        start, total = 0, 0
        for i, size in enumerate(itertools.chain(sizes, [None])):
            if size is None or (total and total + size > chars):
                if i > start:
                    yield batch.slice(start, i - start)
                start, total = i, 0
            total += size or 0
