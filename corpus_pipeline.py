"""Corpus preparation: quality rules, near-dedup, decontamination, secrets, BPE.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir), works
on all that its predecessor kept, and returns the columns of ``documents``, but
for the last, which returns token ids.  Between stages rows are written to the
shared folder and read again.

No DuckDB SQL states MinHash groups, fitted models or BPE, so ``ORACLE_SQL`` is
None; tests hold the stages against plain Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankweave.llm.common import materialize, table
from rankweave.llm.stages import STAGES as _STAGES

STAGES = list(_STAGES)
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
