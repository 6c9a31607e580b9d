"""Repeatable sampling, splits and orders by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrid.functions.base import C, col

#: How many training items each rotation may take by default.
TRAIN_LIMITS = {90: 3000, 270: 3000, 180: 1800}


def fraction(key: C, seed: str) -> Column:
    """A number in 0..1 from the first eight hex digits of md5(seed:key); the same in every engine."""
    h = F.md5(F.concat(F.lit(seed + ":"), col(key).cast("string")).cast("binary"))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / float(1 << 32)


def assign_split(key: C, val: float, test: float, seed: str) -> Column:
    f = fraction(key, seed)
    return F.when(F.lit(test > 0) & (f < test), "test").when(f < test + val, "val").otherwise("train")


#: Size of a quantile sketch, and the share of ranks by which its quantiles may be off, with room.
SKETCH, RANK_ERROR = 4096, 0.004


def cut_off(df: DataFrame, levels: list[Column], n: int, room: int = 4) -> Column:
    """A condition that holds for the n first rows by the levels (numbers without nulls, least first) and for few others.

    Each pass counts the rows under the cut so far and sketches their quantiles (mergeable sketches, so
    a task hands on one of them) to lower the cut, until at most ``room`` * n rows and a sketch's worth
    are left.  A cut that would leave fewer than n is taken back, so the condition is exact whatever the
    sketch tells.  Where one value holds many rows the next level cuts among them; rows equal in all
    levels stay together.
    """
    before, tied, need = F.lit(False), F.lit(True), n
    for v in levels:
        cut, sound = None, None
        while True:
            under = tied if cut is None else tied & (v <= cut)
            r = df.filter(under).select(v.alias("v")).agg(F.count("v").alias("n"), F.max("v").alias("top"), F.kll_sketch_agg_bigint("v", SKETCH).alias("s")).first()
            if cut is not None and r["n"] < need:
                return before | (tied if sound is None else tied & (v <= sound))
            rank = need / max(r["n"], 1) + RANK_ERROR
            if r["n"] <= room * need + SKETCH or rank > 0.5:
                return before | under
            # the rank must be a constant, so the sketch (some 100 KB) is asked in a query of one row
            at = df.sparkSession.sql("select 1").select(F.kll_sketch_get_quantile_bigint(F.lit(r["s"]), F.lit(rank))).first()[0]
            if at >= r["top"]:  # most rows have this one value
                break
            cut, sound = at, cut
        top = r["top"]
        less = df.filter(tied & (v < top)).count()
        if less >= need:
            return before | (tied & (v < top))
        before, tied, need = before | (tied & (v < top)), tied & (v == top), need - less
    return before | tied


def _moment(df: DataFrame, name: str) -> Column | None:
    """A time or whole number as a bigint of the same order, nulls least; None for other types."""
    kind = df.schema[name].dataType.simpleString()
    c = F.col(name)
    if kind in ("tinyint", "smallint", "int", "bigint"):
        n = c.cast("bigint")
    elif kind == "date":
        n = F.unix_date(c).cast("bigint")
    elif kind == "timestamp":
        n = F.unix_micros(c)
    elif kind == "timestamp_ntz":
        n = (F.unix_date(c.cast("date")).cast("bigint") * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60) * 1_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
    else:
        return None
    return F.coalesce(n, F.lit(-(1 << 63)))


def ordered_limit(df: DataFrame, order_by: str, n: int, created: str, key: str, seed: str = "0") -> DataFrame:
    """newest, oldest or random (by hash) first; n = 0 keeps all.  Ties go by key.

    With a limit only rows under a cut-off reach the sort, so a task hands on few rows however many the
    table has; cutting reads the columns of the order two or three times.  Times that are null are the
    oldest.  Rows equal in order and key, as repeated ones, stand in any order; an order by other types
    than times and whole numbers is left to the sort alone.
    """
    order = {"newest": [F.desc_nulls_last(created), F.desc(key)], "oldest": [F.asc_nulls_first(created), F.asc(key)], "random": [fraction(key, seed), F.asc(key)]}[order_by]
    if n <= 0:
        return df.orderBy(*order)
    first = F.coalesce((fraction(key, seed) * float(1 << 32)).cast("bigint"), F.lit(-1).cast("bigint")) if order_by == "random" else _moment(df, created)
    levels = [first, _moment(df, key)] if first is not None else []
    levels = [v for v in levels if v is not None]
    if order_by == "newest":
        levels = [F.bitwise_not(v) for v in levels]  # falls as v rises, without overflow
    return (df.filter(cut_off(df, levels, n)) if levels else df).orderBy(*order).limit(n)


def augmentation_plan(items: DataFrame, key: str, seed: str, train_limits: dict[int, int] | None = None, val_limits: dict[int, int] | None = None) -> DataFrame:
    """Items of split train and val by rotation, in hash order, up to a limit each (val: all by default).

    Ranks are counted in 4096 stretches of the hash, so no task ranks a whole split; stretches beyond a
    limit are left out before they are ranked.  Items without a split are in no plan, an item that
    stands twice is planned twice, an empty table gives no rows.
    """
    train = TRAIN_LIMITS if train_limits is None else train_limits
    val = {a: 0 for a in (90, 180, 270)} if val_limits is None else val_limits
    options = [(a, "train", n) for a, n in train.items() if n > 0] + [(a, "val", n if val_limits is not None else 0) for a, n in val.items() if val_limits is None or n > 0]
    if not options:
        return items.withColumn("angle", F.lit(0)).filter("false")
    angles = F.array(*[F.struct(F.lit(a).alias("angle"), F.lit(s).alias("of"), F.lit(n).alias("n")) for a, s, n in options])
    df = items.withColumn("__o", F.explode(angles)).filter(F.lower("split") == F.col("__o.of")).withColumn("angle", F.col("__o.angle"))
    df = df.withColumn("__f", fraction(F.concat(F.col(key).cast("string"), F.lit("/"), F.col("angle").cast("string")), seed)).withColumns({"__s": F.lower("split"), "__b": F.floor(F.col("__f") * 4096)})
    own = ["__s", "angle", "__b"]
    before = F.coalesce(F.sum("__c").over(Window.partitionBy("__s", "angle").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretches = df.groupBy(*own).agg(F.count("*").alias("__c")).select(*own, before.alias("__before"))  # 4096 for a split and angle at most
    inside = (F.col("__o.n") == 0) | (F.col("__before") < F.col("__o.n"))
    df = df.join(F.broadcast(stretches), own).filter(inside).withColumn("rank", (F.col("__before") + F.row_number().over(Window.partitionBy(*own).orderBy("__f", key))).cast("int"))
    return df.filter((F.col("__o.n") == 0) | (F.col("rank") <= F.col("__o.n"))).drop("__o", "__f", "__s", "__b", "__before")
