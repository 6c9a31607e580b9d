"""What the operators share: tables, the shared folder and word hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word in every contract: anything but a blank and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, as in tests."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    own = getattr(spark, "_docgrid_dir", None)
    if own is None:
        own = spark._docgrid_dir = tempfile.mkdtemp(prefix="spark-docgrid-")
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docgrid/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and later joins know its size."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._docgrid_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a written table that nothing reads any more."""
    path = getattr(df, "_docgrid_path", None)
    if path:
        jvm, hadoop = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(hadoop).delete(where, True)


#: A key is hot with more than HOT_ROWS rows and one in HOT of all rows, so there are at most HOT hot keys.
HOT, HOT_ROWS = 1000, 64


def _split(rows: DataFrame, table: DataFrame, on: list[str], hot: DataFrame, how: str) -> DataFrame:
    """rows joined with table, those with one of the ``hot`` keys (HOT of them or a few times that) by broadcast, the others by merge.

    The hashes of the hot keys go into the filters of both sides, so no join has to find them.
    """
    if any(rows.schema[c].dataType != table.schema[c].dataType for c in on):
        raise ValueError("keys of one type are needed, as they meet by hash")
    key = F.xxhash64(*on)
    keys = [r[0] for r in hot.select(key).collect()]
    if not keys:
        return rows.join(table.hint("merge"), on, how)
    is_hot = key.isin(keys)
    return rows.filter(is_hot).join(F.broadcast(table.filter(is_hot)), on, how).unionByName(rows.filter(~is_hot).join(table.filter(~is_hot).hint("merge"), on, how))


def skew_join(rows: DataFrame, table: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """rows (a written table) joined with a table that has one row a key, where any key may hold most rows.

    The entries of the HOT hottest keys at most are broadcast, the others merged; ``how`` is inner or left.
    """
    on = [on] if isinstance(on, str) else on
    hot = rows.groupBy(*on).agg(F.count("*").alias("__n")).filter(F.col("__n") > max(HOT_ROWS, rows.count() // HOT))
    return _split(rows, table, on, hot, how)


def counted_join(rows: DataFrame, table: DataFrame, on: str | list[str], count: str, total: int) -> DataFrame:
    """rows joined with a written table of one row a key that knows how many rows of ``total`` its key has (``count``).

    The HOT hottest keys at most are broadcast, the others merged.
    """
    return _split(rows, table, [on] if isinstance(on, str) else on, table.filter(F.col(count) > max(HOT_ROWS, total // HOT)), "inner")


def remainder(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def ascii_words(text: str | None) -> list[bytes]:
    """UTF-8 words of a text, A-Z lowered; bytes.split cuts at exactly the blanks of WORD."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    x = np.asarray(x, np.uint64).copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))
