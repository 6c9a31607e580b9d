"""Continuous parsing and continuous review decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from docgrid.operators.parse import mrz_confidence, parse_mrz


def parse_stream(lines: DataFrame, as_of_year: int) -> DataFrame:
    """The table parser on a stream of documents (lines array<string>, ocr_confidence, detector_confidence); stateless."""
    out = parse_mrz(lines, "lines", as_of_year)
    return out.withColumn("confidence", mrz_confidence("found", "ocr_confidence", "detector_confidence", "format_score"))


#: Keyed state lives in the engine's RocksDB store, whose size is not bound by an executor's heap; a batch saves its changes only.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def latest_decisions(decisions: DataFrame, key: str) -> DataFrame:
    """The newest approved or rejected decision of each key by (ts, event_id), as an aggregation that also runs on streams.

    A late decision does not beat a newer one, and one that comes again changes nothing.  Null keys and other words are no decisions.
    """
    rest = [c for c in decisions.columns if c != key]
    valid = decisions.filter(F.col("decision").isin("approved", "rejected") & F.col(key).isNotNull())
    return valid.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("ts", "event_id")).alias("__s")).select(key, "__s.*")


def decision_stream(decisions: DataFrame, key: str, path: str, checkpoint: str) -> StreamingQuery:
    """Start keeping the newest decision of each key of a stream, until what is there has been read.

    Each batch hands on only the keys that it saw, as a part of its own below ``path``; a batch that is run
    again after a failure writes that part anew.
    """
    spark = decisions.sparkSession

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        return latest_decisions(decisions, key).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def current_decisions(spark: SparkSession, path: str, schema: StructType, key: str) -> DataFrame:
    """What ``decision_stream`` has handed on below path: of each key the last part's row; no rows before its first batch."""
    parts = spark.read.schema(StructType([*schema, StructField("batch", LongType())])).parquet(path)
    rest = [c for c in schema.names if c != key]
    return parts.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("__s")).select(key, "__s.*")
