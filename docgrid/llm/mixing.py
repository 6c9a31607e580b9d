"""Mixing sources to target weights with a time-varying curriculum; DataFrame functions only.

Each source follows a piecewise-linear weight schedule over training time 0..1.  The integral of
the schedule is the source's weight in the mix, and the inverse of the integrated schedule turns
"how many of the source's words came before" into a training position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrid.llm.common import WORD, read_table, written

#: One schedule: knots (time, weight), times from 0 to 1.
Schedule = Sequence[tuple[float, float]]
#: Schedules dealt to the sources in order; their integrals are 5, 2 and 1.
SCHEDULES: tuple[Schedule, ...] = (((0.0, 5.0), (1.0, 5.0)), ((0.0, 1.0), (1.0, 3.0)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)))
MAX_REPEATS = 3
#: Hex digits of the order hash that form a bucket: running sums are per source and bucket, so no source is one task.
BUCKET_DIGITS = 3


def integral(schedule: Schedule) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))


def time_at(share: Column, schedule: Schedule) -> Column:
    """Training time at which the given share (0..1) of a source's demand has been served."""
    total, before, out = integral(schedule), 0.0, None
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        area = (t1 - t0) * (w0 + w1) / 2
        need, slope = share * total - before, (w1 - w0) / (t1 - t0)
        at = t0 + 2 * need / (w0 + F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * slope * need)))
        out = F.when(share * total <= before + area, at) if out is None else out.when(share * total <= before + area, at)
        before += area
    return F.least(F.lit(1.0), F.coalesce(out, F.lit(1.0)))


def source_targets(sized: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(src, source, source_size, slot, target) per source of (src, source, size).

    Sources in code-point order, null last, take the schedules in turn and share the sum of all
    sizes by weight.  A target stops at max_repeats times its source's size and the excess goes to
    the others by weight: with sources sorted by size per weight, the level at which the rest share
    is the largest of the levels got by capping the first 0, 1, 2, ... sources.
    """
    weight = F.element_at(F.array(*[F.lit(float(integral(s))) for s in schedules]), (F.col("slot") + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "place")
    return (
        sized.groupBy("src", "source").agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(by_name))
        .withColumn("slot", (F.col("place") - 1) % len(schedules))
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(by_name.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("level", F.max((F.col("total") - F.col("before")) / F.col("left")).over(by_name.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .select("src", "source", "source_size", "slot", F.least("cap", F.col("level") * F.col("weight")).alias("target"))
    )


def curriculum(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    schedules: Sequence[Schedule] = SCHEDULES,
    max_repeats: int = MAX_REPEATS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per input row: id_col, the columns named in keep, source, size, source_size, target, n_takes, positions.

    ``size`` is the number of words.  A source's documents stand in the order of md5(id); all are
    taken floor(target / source_size) times, and once more while the running size, taken to the
    document's middle, is within the rest.  ``positions`` has the training time (0..1) of each take.
    Null text and empty text have size 0 and are never taken; a null source is a source of its own,
    last in order; a null id hashes as empty text; repeated rows count as often as they stand, each
    with takes of its own; an empty table gives no rows.  Other columns are not read.
    """
    sized = docs.select(
        *(F.col(c).alias(f"__keep_{i}") for i, c in enumerate(keep)),
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("h"),
    ).withColumn("src", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    sized = written(sized.withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS)), "sizes")
    targets = source_targets(sized, schedules, max_repeats)
    by_bucket = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sized.groupBy("src", "bucket").agg(F.sum("size").alias("in_bucket"))
        .withColumn("offset", F.coalesce(F.sum("in_bucket").over(by_bucket), F.lit(0)))
        .join(targets.drop("source").hint("merge"), "src")
        .select("src", "bucket", "offset", "source_size", "slot", "target")
    )
    inside = Window.partitionBy("src", "bucket").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        sized.withColumn("cum", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets.hint("merge"), ["src", "bucket"])
        .withColumn("cum", F.col("cum") + F.col("offset"))
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
        .withColumn("n_takes", F.when(F.col("size") > 0, F.col("passes") + (F.col("cum") * 2 + F.col("size") <= F.col("rest") * 2).cast("long")).otherwise(F.lit(0)).cast("int"))
    )

    def position(k: Column) -> Column:
        share = F.least(F.lit(1.0), (F.col("cum") + F.col("size") / 2 + k * F.col("source_size")) / F.col("target"))
        out = None
        for slot, s in enumerate(schedules):
            out = F.when(F.col("slot") == slot, time_at(share, s)) if out is None else out.when(F.col("slot") == slot, time_at(share, s))
        return out

    takes = F.when(F.col("n_takes") > 0, F.transform(F.sequence(F.lit(0), F.col("n_takes") - 1), position)).otherwise(F.array().cast("array<double>"))
    kept = [F.col(f"__keep_{i}").alias(c) for i, c in enumerate(keep)]
    return placed.select(F.col("id").alias(id_col), *kept, "source", "size", "source_size", "target", "n_takes", takes.alias("positions"))


def training_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", schedules: Sequence[Schedule] = SCHEDULES, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The rows of docs as often as their mix takes them, range-sorted by training position, with that position.

    Takes find their row by a 128-bit hash of all its columns, so rows that share an id, or have none, keep
    their own takes; of equal rows one stands for all of them.  Ties go by id_col.
    """
    columns = docs.columns
    parts = [*(F.col(c).isNull() for c in columns), *(F.col(c) for c in columns)]
    keyed = docs.withColumns({"__k1": F.xxhash64(*parts), "__k2": F.xxhash64(F.lit(1), *parts)})
    mixed = curriculum(keyed, id_col, text_col, source_col, schedules, max_repeats, keep=("__k1", "__k2"))
    takes = mixed.select("__k1", "__k2", F.explode("positions").alias("position"))
    out = keyed.dropDuplicates(["__k1", "__k2"]).join(takes.hint("merge"), ["__k1", "__k2"])
    return out.repartitionByRange("position", "__k1").sortWithinPartitions("position", id_col, "__k1").select(*columns, "position")


def numbered(docs: DataFrame, name: str = "numbered") -> DataFrame:
    """docs written with a row number in the column ``row``."""
    return written(docs.withColumn("row", F.monotonically_increasing_id()), name)


def ordered_takes(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(row, id_col, take, position, place): the takes of a mix with a row number, range-sorted by position and written.

    ``place`` counts the takes from 0 along the whole order.
    """
    takes = mixed.select("row", F.col(id_col), F.posexplode("positions").alias("take", "position"))
    takes = takes.repartitionByRange("position", "row", "take").sortWithinPartitions("position", "row", "take")
    # ids of one partition count its rows in order, and later ranges have higher partitions
    takes = written(takes.withColumn("n", F.monotonically_increasing_id()), "training-order").withColumn("part", F.shiftright("n", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    parts = takes.groupBy("part").agg(F.count("*").alias("in_part")).select("part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("base"))
    place = F.col("n") - F.shiftleft("part", 33) + F.col("base")
    return takes.join(F.broadcast(parts), "part").select("row", id_col, "take", "position", place.alias("place"))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """Contract: words taken of every document, counted in the written training order; with its first and last position."""
    mixed = numbered(curriculum(read_table(spark, sf_dir, "documents")), "mix")
    took = ordered_takes(mixed).groupBy("row").agg(F.count("position").alias("n"), F.min("position").alias("first_position"), F.max("position").alias("last_position"))
    taken = (F.col("size") * F.coalesce("n", F.lit(0))).cast("long").alias("taken")
    return mixed.join(took.hint("merge"), "row", "left").select("doc_id", "size", "source_size", "target", taken, "first_position", "last_position")


def training_order_query(spark, sf_dir: str) -> DataFrame:
    """Every take with its training position; ``place`` is its rank in the range-sorted order."""
    return ordered_takes(numbered(curriculum(read_table(spark, sf_dir, "documents")), "mix")).select("doc_id", "take", "position", "place")


_SQL = r"""
with d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size, md5(coalesce(cast(doc_id as varchar), '')) as h
  from documents
), s as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source asc nulls last) as place from d group by source
), w as (
  select *, case (place - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight, source_size * 3.0::double as cap from s
), l as (
  select *, coalesce(sum(cap) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0) as before,
    sum(weight) over (order by cap / weight, place rows between current row and unbounded following) as left_w, (select sum(source_size)::double from s) as total
  from w
), t as (
  select source, source_size, (place - 1) % 3 as slot, least(cap, (select max((total - before) / left_w) from l) * weight) as target from l
), p as (
  select d.doc_id, d.size, t.source_size, t.target, t.slot, row_number() over () as row,
    coalesce(cast(sum(d.size) over (partition by d.source order by d.h, d.doc_id, d.size rows between unbounded preceding and 1 preceding) as bigint), 0) as cum,
    case when t.source_size > 0 then cast(floor(t.target / t.source_size) as bigint) else 0 end as passes
  from d join t on d.source is not distinct from t.source
), k as (
  select *, case when size > 0 then passes + (case when cum * 2 + size <= (target - passes * source_size) * 2 then 1 else 0 end) else 0 end as n_takes from p
), x as (
  select row, r.take, slot, least(1.0::double, (cum + size / 2.0::double + r.take * source_size) / target) as share from k join range(4) r(take) on r.take < n_takes
), y as (
  select row, take, least(1.0::double, case slot when 0 then share
    when 1 then 4 * share / (1 + sqrt(1 + 8 * share)) else 2 * share / (1.5::double + sqrt(greatest(0.0::double, 2.25::double - 2 * share))) end) as position
  from x
)
"""
OP7_SQL = (
    _SQL
    + """
select doc_id, size, source_size, target, cast(size * n_takes as bigint) as taken, first_position, last_position
from k left join (select row, min(position) as first_position, max(position) as last_position from y group by row) using (row)
"""
)
#: Every take with its position; the place is compared by brute force, as the last bit of a position may differ between engines.
ORDER_SQL = _SQL + "select doc_id, cast(take as int) as take, position from y join k using (row)"
