"""From raw documents to a training mix: each stage applies one operator of
``driftpool.llm`` to all that its predecessor kept.

Stages take ``(spark, docs, sf_dir)`` and return a DataFrame; all but the last
return the columns of ``docs``. ``run`` applies them to ``documents``, each stage
written as Parquet to the cluster's shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftpool.llm import decontam, langid, linededup, mixing, simhash
from driftpool.llm.common import cut, forget, held_out, table

#: no SQL for n-gram filters, SimHash and alignment: tests hold the stages against brute force
ORACLE_SQL = None


def _columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter (null ones too) and those of which hardly any
    n-gram belongs to the predicted language."""
    learned = langid.fit(docs.where(~held_out()))
    found = langid.identify(docs, learned)
    return _columns(found.where((F.col("lang_pred") != langid.UNKNOWN)
                                & (F.col("score") >= langid.MIN_SCORE)), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes boilerplate lines of a source out of its texts; no document goes."""
    kept = _columns(linededup.drop_boilerplate(docs, "source"), docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves the document with the smallest id of every near-duplicate group."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a passage that aligns with a benchmark item."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as they are drawn, with output shard and pass."""
    return mixing.mix(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontaminate", decontaminate), ("mix", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
