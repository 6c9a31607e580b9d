"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes to the shared
folder as Parquet and reads back for the next stage.  Nulls, empty tables and repeated rows follow
the operators' own rules; columns beyond those of documents are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.llm.common import read_table, remainder, written
from docgrid.llm.minhash import near_duplicates
from docgrid.llm.mixing import training_order
from docgrid.llm.packing import pack_in_order
from docgrid.llm.quality import THRESHOLD, fit, stats_column, training_rows
from docgrid.llm.secrets import redact

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled ones whose remainder is not 2.

    Null and empty texts are judged by all-zero statistics; null ids and repeated rows each by their
    text; without labels every score is 0.5 and all rows go; an empty table gives no rows.
    """
    stats = written(docs.select(*COLUMNS, (remainder("doc_id", 4) == 2).alias("held_out"), stats_column("text").alias("stats")), "quality-stage")
    model = fit(training_rows(stats.select("doc_id", "held_out", "stats"), read_table(spark, sf_dir, "labels"), "doc_id"))
    return stats.filter(model.score(F.col("stats")) >= THRESHOLD).select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, similarity 0.8): the one with the least id.

    Of rows repeated under one id one stays: the least by text, lang, source and n_chars, nulls first.
    Rows with a null id all stay, and so do null and empty texts; an empty table gives no rows.
    """
    docs = docs.select(*COLUMNS)
    kept = near_duplicates(docs, words=5, percent=80).filter("kept and doc_id is not null").select(F.col("doc_id").alias("__id"))
    stay = docs.filter("doc_id is not null").join(kept.hint("merge"), F.col("doc_id") == F.col("__id"), "left_semi")
    stay = stay.groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("__row")).select("doc_id", "__row.*")
    return stay.unionByName(docs.filter("doc_id is null"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark and n_chars brought up to date where that changed the text.

    Null and empty texts stay as they are; null ids and repeated rows are treated like any other; an
    empty table gives no rows.
    """
    clean = docs.withColumn("__clean", redact("text"))
    changed = ~F.col("__clean").eqNullSafe(F.col("text"))
    return clean.withColumn("n_chars", F.when(changed, F.length("__clean").cast("long")).otherwise(F.col("n_chars"))).withColumn("text", F.col("__clean")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (0 to 3 times), with the training position of each take.

    Null and empty texts have no words and are never taken; a null source is a source of its own; rows
    repeated under one id, or without one, have takes of their own; an empty table gives no rows.
    """
    return training_order(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of 2048 tokens, whose ids rise with the training position.

    Null and empty texts make a piece of the end id alone; null ids and repeated rows are packed like
    any other; ties in position go by id, piece and content; an empty table gives no rows.
    """
    return pack_in_order(docs, "position")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", dedup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: SQL can express neither the classifier nor the packing; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
