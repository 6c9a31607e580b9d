"""A stored order of a table: ranges cut at quantiles of the key, the place inside each, and totals of ranges in front.

The cut goes by rows, not by values, so sparse keys and wide gaps cost nothing.  Spark's range partitioning samples
its bounds, which another run may cut elsewhere: the index is therefore written once (``keep``) and read from there.
What lies before or after a range comes from one row an index that holds RANGES totals at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of an index at most: the bound on what is joined by broadcast.  Beyond RANGES x ``rows`` ranges become longer.
RANGES = 4096
Keep = Callable[[DataFrame], DataFrame]


def order_index(df: DataFrame, key: str, keep: Keep, rows: int = 1_000_000) -> DataFrame:
    """df, stored, with its range (__range, rising with the key) and place inside (__i, from 1).

    Rows with equal keys are in one range and in any order; null keys come first.
    """
    n = max(1, min(RANGES, -(-df.count() // rows)))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return keep(df.repartitionByRange(n, key).sortWithinPartitions(key).select("*", F.spark_partition_id().alias("__range"), place.alias("__i")))


def _carried(totals: Column, field: str, kind: str, merge: Callable[[Column, Column], Column]) -> Column:
    """For each element of totals what merge gives of the field over all elements in front of it; null for the first."""
    zero = F.expr(f"struct(cast(null as {kind}) as now, cast(array() as array<{kind}>) as out)")
    step = lambda a, x: F.struct(merge(a["now"], x[field]).alias("now"), F.concat(a["out"], F.array(a["now"])).alias("out"))
    return F.aggregate(totals, zero, step, lambda a: a["out"])


def _totals(index: DataFrame, **values: Column) -> DataFrame:
    """One row with the totals of all ranges in order."""
    each = index.groupBy("__range").agg(*[v.alias(c) for c, v in values.items()])
    return each.agg(F.array_sort(F.collect_list(F.struct("__range", *values))).alias("s"))


def positions(index: DataFrame) -> DataFrame:
    """An index with the 1-based place in the whole order as position."""
    s = F.col("s")
    one = _totals(index, n=F.count("*")).select(F.arrays_zip(s.getField("__range").alias("r"), _carried(s, "n", "bigint", lambda a, x: F.coalesce(a, F.lit(0)) + x).alias("b")).alias("z"))
    before = one.select(F.explode("z").alias("z")).select(F.col("z.r").alias("__range"), F.coalesce("z.b", F.lit(0)).alias("__before"))
    return index.join(F.broadcast(before), "__range").withColumn("position", F.col("__i") + F.col("__before")).drop("__range", "__i", "__before")


def paging(index: DataFrame) -> DataFrame:
    """(id, next_id, previous_id) of an index of (id, ok, p): candidates are ok, the next one is pending (p) as well.

    After the last pending item the first one follows.  Both windows run forwards over one range: what comes next
    is what came before in falling order.
    """
    kind, s = index.schema["id"].dataType.simpleString(), F.col("s")
    pend, any_ = F.when(F.col("ok") & F.col("p"), F.col("id")), F.when(F.col("ok"), F.col("id"))
    one = _totals(index, lo=F.min(pend), hi=F.max(any_))
    after = F.reverse(_carried(F.reverse(s), "lo", kind, F.least))
    one = one.select(F.array_min(s.getField("lo")).alias("first"), F.arrays_zip(s.getField("__range").alias("r"), after.alias("a"), _carried(s, "hi", kind, F.greatest).alias("b")).alias("z"))
    edges = one.select("first", F.explode("z").alias("z")).select(F.col("z.r").alias("__range"), F.col("z.a").alias("after"), F.col("z.b").alias("before"), "first")
    own = Window.partitionBy("__range")
    passed = lambda c, order: F.last(c, ignorenulls=True).over(own.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    out = index.withColumns({"n": passed(pend, F.desc("__i")), "b": passed(any_, F.asc("__i"))}).join(F.broadcast(edges), "__range")
    return out.select("id", F.coalesce("n", "after", "first").alias("next_id"), F.coalesce("b", "before").alias("previous_id"))
