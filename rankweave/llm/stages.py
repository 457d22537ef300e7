"""Stages of a corpus pipeline: each takes and returns rows of ``documents``.

Columns that a stage adds for its own use have names with a prefix, so that
columns of the documents are never shadowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm import bpe, decontaminate, near_dedup, quality, secrets
from rankweave.llm.common import materialize, table, where_computed

OWN = "__rankweave_"
#: At most so many (id, text hash) are broadcast, about 70 bytes each there.
MAX_LISTED = 500_000


def _same_row() -> Column:
    """Whether a document's id and text are those of a listed (id, text hash)."""
    return F.col("doc_id").eqNullSafe(F.col(f"{OWN}id")) & (F.xxhash64("text") == F.col(f"{OWN}hash"))


def _without(docs: DataFrame, drop: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (id, text hash) is not in ``drop``."""
    drop = materialize(drop.distinct(), "dropped")
    drop = F.broadcast(drop) if drop.count() <= MAX_LISTED else drop
    return docs.join(drop, _same_row(), "left_anti")


def _keys(docs: DataFrame) -> DataFrame:
    return docs.select("text", F.col("doc_id").alias(f"{OWN}id"), F.xxhash64("text").alias(f"{OWN}hash"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that pass the base rules and the likelihood ratio's threshold."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return where_computed(quality.judge(docs, model, prefix=OWN), f"{OWN}kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group: the one with the least id, and of those the least text hash.

    Five-word shingles and a similarity of 0.8.  Null ids come last.  Rows are
    told apart by id and text, so a row whose id also stands on a copy stays.  A
    text without words is linked with nothing, and only its repeats with the same
    id (null is one, too) go.  Of rows with equal id and text, the one with the
    least other columns stays.
    """
    rows = near_dedup.near_duplicates(docs, shingle_words=5, percent=80, hashed=True)
    pairs = rows.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "group").agg(F.count("*").alias("n"))
    pairs = materialize(pairs, "near-rows")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "hash")
    best = materialize(pairs.where(F.col("group").isNotNull()).groupBy("group").agg(F.min(order).alias("best")), "near-best")
    stays = F.col("best").isNull() | (order == F.col("best"))
    judged = pairs.join(best, "group", "left").select(F.col("id").alias(f"{OWN}id"), F.col("hash").alias(f"{OWN}hash"), "n", stays.alias("stays"))
    judged = materialize(judged, "near-verdicts")
    kept = _without(docs, judged.where("not stays or n > 1").select(f"{OWN}id", f"{OWN}hash"))
    repeated = judged.where("stays and n > 1").select(f"{OWN}id", f"{OWN}hash")
    if not repeated.limit(1).count():
        return kept
    repeated = F.broadcast(repeated) if repeated.count() <= MAX_LISTED else repeated
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = docs.join(repeated, _same_row()).groupBy(f"{OWN}id", f"{OWN}hash").agg(F.min(row).alias(f"{OWN}row"))
    return kept.unionByName(one.select(f"{OWN}row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage."""
    leaks = decontaminate.find_leaks(_keys(docs), table(spark, sf_dir, "benchmark"))
    return _without(docs, leaks.where(F.size("hits") > 0).select(f"{OWN}id", f"{OWN}hash"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in texts by a mark, and count characters anew where that was done."""
    model = secrets.fit(*secrets.labelled_samples(docs))
    found = secrets.scan(docs, model, prefix=OWN)
    clean = found.withColumn(f"{OWN}text", secrets.redact(F.col("text"), F.col(f"{OWN}spans")))
    changed = F.size(f"{OWN}spans") > 0
    new = {"text": F.col(f"{OWN}text"), "n_chars": F.when(changed, F.length(f"{OWN}text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return clean.select(*[new[c].alias(c) if new.get(c) is not None else F.col(f"`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding them."""
    import public_tokenizers

    coded = bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), ids="ids", decoded="decoded")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("bpe", encode),
]
