"""Upkeep of large stored tables: a change reads and rewrites the partitions that it touches, and joins without moving the rest.

A table is kept as Spark's own partitioned and bucketed Parquet.  ``part`` is a hash of the key: it says which
partitions a set of keys can touch.  Buckets are a hash of the same key: a join or grouping by it needs no exchange
of the table, only of the changes.  Changes replace whole partitions (dynamic overwrite): they are written aside
first and moved in place at commit, so a lost executor repeats its tasks only, and a job that fails changes nothing.
One writer at a time; a reader in the moment of the commit may see some partitions before and some after.

Rows with a null key share one partition and are never matched by a change, repeated rows stay as they are.  A column
``part_of_key`` in the rows is refused.  An empty set of changes rewrites nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrid.operators import review, store

PART = "part_of_key"


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("int").alias(PART)


def _dealt(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Rows of one bucket of one part in one task, so that each is one file whatever the number of tasks."""
    return df.repartition(F.col(PART), F.pmod(F.hash(F.col(key)), F.lit(buckets)))


def create(df: DataFrame, name: str, key: str, path: str, parts: int = 64, buckets: int = 8) -> None:
    """Store df as table ``name`` below ``path``, in parts x buckets files.

    At 100 TB take parts and buckets so that one file is some hundreds of MB (a thousand each); a change of k keys
    then reads and writes k of the parts at most.  With at least as many buckets as shuffle partitions a join by the key
    moves only the changes; with fewer, Spark moves the touched rows too, for more tasks.  Key and ``parts`` are kept with the table, where changes read them.
    """
    if PART in df.columns:
        raise ValueError(f"column {PART} belongs to the stored table")
    writer = _dealt(df.withColumn(PART, _part(key, parts)), key, buckets).write.format("parquet").partitionBy(PART).bucketBy(buckets, key)
    writer.option("path", path).option("partitionOverwriteMode", "dynamic").saveAsTable(name)
    df.sparkSession.sql(f"alter table {name} set tblproperties ('upkeep.key' = '{key}', 'upkeep.parts' = '{parts}', 'upkeep.buckets' = '{buckets}')")


def read(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name).drop(PART)


def _files(spark: SparkSession, name: str, parts: list[int]) -> set[str]:
    return set(spark.table(name).filter(F.col(PART).isin(parts)).inputFiles())


def change(spark: SparkSession, name: str, keys: DataFrame, apply: Callable[[DataFrame], DataFrame]) -> list[int]:
    """Replace the partitions that hold ``keys`` (its column named as the table's key) by apply(their rows); returns them.

    Only the numbers of the touched partitions reach the driver, ``parts`` of them at most.  apply must leave the rows
    of other keys as they are; rows that it adds must have one of ``keys``.  An overwrite replaces only partitions that
    have rows, so one whose files are still there afterwards has lost all its rows, and is dropped.
    """
    known = {r.key: r.value for r in spark.sql(f"show tblproperties {name}").collect()}
    key, parts = known["upkeep.key"], int(known["upkeep.parts"])
    touched = sorted(r[0] for r in keys.filter(F.col(key).isNotNull()).select(_part(key, parts)).distinct().collect())
    if not touched:
        return []
    table = spark.table(name)
    out = apply(table.filter(F.col(PART).isin(touched)).drop(PART)).select(*[c for c in table.columns if c != PART])
    before = _files(spark, name, touched)
    out, buckets = out.withColumn(PART, _part(key, parts)), int(known["upkeep.buckets"])
    if buckets < int(spark.conf.get("spark.sql.shuffle.partitions")):
        out = _dealt(out, key, buckets)  # rows come by shuffle partitions, each of which would write files for all buckets
    out.write.insertInto(name, overwrite=True)
    spark.catalog.refreshTable(name)
    emptied = {re.search(rf"{PART}=(\d+)", f)[1] for f in _files(spark, name, touched) & before}
    for p in emptied:
        spark.sql(f"alter table {name} drop if exists partition ({PART} = {p})")
    return touched


def upsert(spark: SparkSession, name: str, updates: DataFrame, key: str, order: str, policy: str = "replace") -> list[int]:
    """``store.upsert`` on a stored table; updates without a key are passed over, for no partition is theirs."""
    updates = updates.filter(F.col(key).isNotNull())
    return change(spark, name, updates, lambda rows: store.upsert(rows, updates, key, order, policy))


def replace_children(spark: SparkSession, name: str, new: DataFrame, parent: str = "label_item_id", touched: DataFrame | None = None) -> list[int]:
    """``store.replace_children`` on lines stored by their parent; new lines must have a parent among the touched ones."""
    keys = (new if touched is None else touched).select(parent)
    return change(spark, name, keys, lambda rows: store.replace_children(rows, new.select(*rows.columns), parent, keys))


def apply_decisions(spark: SparkSession, name: str, decisions: DataFrame) -> list[int]:
    """``review.apply_decisions`` on items stored by source_key (with reviewed_at and updated_at); what decides nothing touches nothing."""
    valid = decisions.filter(F.col("decision").isin("approved", "rejected"))

    def decided(rows: DataFrame) -> DataFrame:
        # an item without a new decision keeps the time of its last one
        return review.apply_decisions(rows.withColumnRenamed("reviewed_at", "__was"), valid)[0].withColumn("reviewed_at", F.coalesce("reviewed_at", "__was"))

    return change(spark, name, valid, decided)


def apply_corrections(spark: SparkSession, name: str, corrections: DataFrame) -> list[int]:
    """``review.apply_corrections`` on items stored by source_key, with yolo_label and note; other items keep theirs."""

    def corrected(rows: DataFrame) -> DataFrame:
        out, _ = review.apply_corrections(rows.withColumnsRenamed({"yolo_label": "__label", "note": "__note"}), corrections)
        return out.withColumns({"yolo_label": F.coalesce(F.when(F.col("note").isNotNull(), F.col("yolo_label")), "__label"), "note": F.coalesce("note", "__note")})

    return change(spark, name, corrections, corrected)
