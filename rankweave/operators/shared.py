"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that a cluster names in ``spark.checkpoint.dir``; in a single process without it, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(f"spark.checkpoint.dir is unset: executors of {master} share no folder with the driver")
        found = f"file://{tempfile.mkdtemp(prefix='rankweave-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", whole)  # a URI that readers outside Spark understand, too


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: computed once, its lineage cut, safe from lost executors.

    The table goes when the driver ends, or by ``discard`` before.
    """
    session = df.sparkSession
    path = f"{shared_dir(session)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = session._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(session._jsc.hadoopConfiguration()).deleteOnExit(place)
    return session.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once all that was made of them is written itself."""
    for df in tables:
        session = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = session._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)
