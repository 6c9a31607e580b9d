"""Queries of the library's own operators and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.plans import io_queries, profile_queries, selection_queries, table_queries, text_queries  # noqa: F401  they fill the tables below
from docgrid.plans.text_queries import ORACLES, QUERIES, parsed


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    """How many documents of each format pass their checks, and how confident the reading is."""
    return parsed(spark, sf_dir).groupBy("document_type", "checksum_pass").agg(F.count("*").alias("documents"), F.avg("confidence").alias("confidence"))


__all__ = ["ORACLES", "QUERIES", "entry"]
