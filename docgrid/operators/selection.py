"""Choosing the best of many: text lines, candidates, attempts, rotations and variants.

Every operator partitions by the image or item key, which has few rows a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrid.functions.geometry import bounds, unrotate_points
from docgrid.functions.text import mrz_likeness, mrz_normalize
from docgrid.operators.parse import candidate_score, fallback_trigger, once, parse_mrz, repair_lines

#: Line lengths of the formats, longest first.
TARGET_LENGTHS = (44, 36, 30)


def ocr_row_features(df: DataFrame) -> DataFrame:
    """Adds normalized, likeness, x1..y2, centres, sizes and ratios; rows without text or polygon go.

    df: text, polygon array<struct<x, y>>, image_width, image_height.
    """
    df = once(df.filter(F.size("polygon") > 0), "normalized", mrz_normalize("text")).filter(F.length("normalized") > 0)
    df = once(df, "__b", F.struct(mrz_likeness("text", "normalized").alias("likeness"), bounds("polygon").alias("b"))).select("*", "__b.likeness", "__b.b.*").drop("__b")
    return df.withColumns({
        "width": F.greatest(F.lit(1.0), F.col("x2") - F.col("x1")), "height": F.greatest(F.lit(1.0), F.col("y2") - F.col("y1")), "x_center": (F.col("x1") + F.col("x2")) / 2, "y_center": (F.col("y1") + F.col("y2")) / 2,
    }).withColumns({"bottom_bias": F.col("y_center") / F.greatest(F.lit(1), "image_height"), "width_ratio": F.col("width") / F.greatest(F.lit(1), "image_width")})


def corrected_rows(df: DataFrame, angle: str) -> DataFrame:
    """Polygons of a corrected image brought back to the original before features are taken."""
    return df.withColumn("polygon", unrotate_points("polygon", angle, "image_width", "image_height"))


def choose_lines(rows: DataFrame, key: str, order: str, text: str = "text", score: str = "ocr_score", y: str = "y_pos") -> DataFrame:
    """(key, lines, ocr_score): the lines of an OCR result that look most like an MRZ.

    Rows of 12 or more normalised characters and likeness 0.48 or more, by length and quality.  For each
    target length the first three within ten characters, if at least two; the target with the best mean
    quality wins, earlier targets on ties; without any, the first three.  Lines stand by y; the score is
    their mean OCR score within 0..1.  Keys without such rows are left out.  Likeness and quality are told
    to nine places, as equal ones may differ in their last bits.
    """
    df = once(rows.select(key, F.col(order).alias("pos"), F.col(text).alias("raw"), F.col(score).alias("s"), F.col(y).alias("y")), "line", mrz_normalize("raw")).filter(F.length("line") >= 12)
    df = once(df, "like", mrz_likeness("raw", "line")).filter(F.round("like", 9) >= 0.48).select(key, "pos", "line", "s", "y", F.length("line").alias("n"), (F.col("s") + F.col("like")).alias("q"))
    # an image has few rows, so the rest is a fold over its list
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("a"), (-F.round("q", 9)).alias("b"), "pos", "n", "q", "s", "y", "line")))
    df = df.groupBy(key).agg(ranked.alias("rows"))
    mean = lambda a, f: F.aggregate(a, F.lit(0.0), lambda t, x: t + x[f]) / F.size(a)

    def option(prio: int, target: int) -> Column:
        near = F.filter("rows", lambda x: F.abs(x["n"] - target) <= 10) if target else F.col("rows")
        first = F.slice(near, 1, 3)
        told = F.struct(F.lit(int(not target)).alias("last"), (-F.round(mean(first, "q"), 9)).alias("mean"), F.lit(prio).alias("prio"), mean(first, "s").alias("s"), F.transform(F.array_sort(F.transform(first, lambda x, i: F.struct(x["y"], i, x["line"]))), lambda x: x["line"]).alias("lines"))
        return F.when(F.size(near) >= (2 if target else 1), told)

    best = F.array_min(F.array_compact(F.array(*(option(i, t) for i, t in enumerate((*TARGET_LENGTHS, 0))))))
    return df.select(key, best.alias("b")).select(key, "b.lines", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("b.s"))).alias("ocr_score"))


def top_candidates(df: DataFrame, key: str, n: int = 4, shape: str = "morphology", shape_n: int = 3) -> DataFrame:
    """The best three of the shape source and all others, without repeated (box, source), then the best n by score.

    The rows are dealt once, to a number of tasks that Spark does not lower, for a task holds what it sorts: by score a
    running count of the shape's rows is their rank.
    """
    df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    tie = ("x", "y", "w", "h", "source")
    rest = [c for c in df.columns if c not in (key, *tie, "score")]
    by_score = Window.partitionBy(key).orderBy(F.desc("score"), *tie)
    so_far = F.count_if(F.col("source") == shape).over(by_score.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("__r", so_far).filter((F.col("source") != shape) | (F.col("__r") <= shape_n)).drop("__r")
    kept = [F.max_by(F.struct(*rest), F.struct("score")).alias("__rest")] if rest else []
    df = df.groupBy(key, *tie).agg(F.max("score").alias("score"), *kept).select(key, *tie, "score", *(["__rest.*"] if rest else []))
    return df.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= n)


def best_variant(df: DataFrame, key: list[str], order: str = "variant") -> DataFrame:
    """Of image variants in order: a later one replaces the choice when it has as many lines and as good a score.

    The rule compares two measures at once, so it is a walk over each key's few variants.
    """
    rows = df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("v"), F.col("n_lines").cast("int").alias("n_lines"), F.col("ocr_score").alias("ocr_score")))).alias("a"))
    kind = "struct<v:int,n_lines:int,ocr_score:double>"
    start = F.struct(F.lit(None).cast("int").alias("v"), F.lit(0).alias("n_lines"), F.lit(0.0).alias("ocr_score")).cast(kind)
    walk = F.aggregate(F.col("a").cast(f"array<{kind}>"), start, lambda s, x: F.when((x["n_lines"] >= s["n_lines"]) & (x["ocr_score"] >= s["ocr_score"]), x).otherwise(s))
    return rows.select(*key, walk.alias("b"), F.size("a").alias("passes")).select(*key, F.col("b.v").alias(order), "b.n_lines", "b.ocr_score", "passes")


def best_attempt(df: DataFrame, key: str, rank: str = "candidate_rank") -> DataFrame:
    """Attempts in order until one has two lines, OCR 0.82 and detector 0.65; the best of those tried, with sums."""
    good = ((F.col("n_lines") >= 2) & (F.col("ocr_score") >= 0.82) & (F.col("detector_score") >= 0.65)).cast("int")
    before = F.max(good).over(Window.partitionBy(key).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1))
    tried = df.withColumn("__done", F.coalesce(before, F.lit(0))).filter("__done = 0")
    best = F.struct("n_lines", (F.col("ocr_score") + F.col("detector_score")).alias("q"), (-F.col(rank)).alias("first"), "ocr_score", "detector_score")
    out = tried.groupBy(key).agg(F.max(best).alias("b"), F.sum("latency_ms").alias("latency_ms"), F.sum("passes").alias("passes"), F.count("*").alias("evaluated"))
    return out.select(key, (-F.col("b.first")).alias(rank), "b.n_lines", "b.ocr_score", "b.detector_score", "latency_ms", "passes", "evaluated")


def best_rotation(df: DataFrame, key: str, least: float = 0.85) -> DataFrame:
    """Keep 0 degrees when its confidence reaches ``least``; else the highest confidence, earlier angles on ties."""
    own = Window.partitionBy(key)
    zero = F.max(F.when(F.col("angle") == 0, F.col("confidence"))).over(own)
    df = df.withColumn("__zero", zero).filter((F.col("angle") == 0) | F.col("__zero").isNull() | (F.col("__zero") < least))
    df = df.withColumns({"rank": F.row_number().over(own.orderBy(F.desc("confidence"), "angle")), "tried_rotations": F.col("__zero").isNull() | (F.col("__zero") < least)})
    return df.filter("rank = 1").drop("rank", "__zero")


def _loose(min_likeness: float, min_length: int) -> Column:
    return (F.length("normalized") >= min_length) & (F.col("likeness") >= min_likeness) & (F.col("width_ratio") >= 0.25)


def _row() -> Column:
    """What the score of a run takes from a row."""
    quality = F.col("ocr_score") * 0.30 + F.col("likeness") * 0.45 + F.least(F.lit(1.0), F.length("normalized") / 36) * 0.25
    return F.struct("x1", "y1", "x2", "y2", "height", quality.alias("q"))


def _best_run() -> Column:
    """Box and score of the better run of rows that begins here, of a and b or of a, b and c; null without b."""

    def run(names: str) -> Column:
        n, part = len(names), lambda f: [F.col(f"{c}.{f}") for c in names]
        mean = lambda f: sum(part(f)[1:], part(f)[0]) / n
        (x1, y1), (x2, y2) = (F.least(*part(f)) for f in ("x1", "y1")), (F.greatest(*part(f)) for f in ("x2", "y2"))
        penalty = F.greatest(F.lit(0.0), (y2 - y1) / F.greatest(F.lit(1.0), mean("height")) - n * 2.6) * 0.08
        score = mean("q") + (x2 - x1) / F.greatest(F.lit(1), "image_width") * 0.20 + (y1 + y2) / 2 / F.greatest(F.lit(1), "image_height") * 0.18 - penalty
        # equal scores may differ in their last bits
        told = F.struct((-F.round(score, 9)).alias("r"), F.lit(n).alias("n"), "start", score.alias("score"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), "image_width", "image_height")
        return F.when(F.col(names[0]).isNotNull() & F.col(names[-1]).isNotNull(), told)

    return F.least(run("ab"), run("abc"))


def find_mrz_group(rows: DataFrame, key: str, order: str, min_likeness: float = 0.48, min_length: int = 24) -> DataFrame:
    """(key, n, start, score, x1..y2): the best run of two or three rows next to each other by y.

    rows: as ocr_row_features gives them.  The first of equal scores wins: two rows before three, then upper ones.
    """
    by_y = Window.partitionBy(key).orderBy("y_center", order)
    df = rows.filter(_loose(min_likeness, min_length)).select(key, order, "y_center", "image_width", "image_height", _row().alias("a"))
    df = df.withColumns({"start": F.row_number().over(by_y), "b": F.lead("a").over(by_y), "c": F.lead("a", 2).over(by_y)})
    best = df.groupBy(key).agg(F.min(_best_run()).alias("b")).filter("b is not null")
    return best.select(key, "b.n", "b.start", "b.image_width", "b.image_height", "b.x1", "b.y1", "b.x2", "b.y2", "b.score")


def select_line_rows(rows: DataFrame, key: str, order: str, min_likeness: float = 0.35, min_length: int = 20) -> DataFrame:
    """Rows of each key by tiers: (1) the best group, (2) else the upper three loose candidates.

    Keys with neither come back with tier 3 and no row: their lines are cut from the profile (band split).
    The rows are dealt by key and sorted once; candidates stand before other rows, which only tell of their key.
    """
    on = F.coalesce(_loose(min_likeness, min_length), F.lit(False))
    own = lambda c: F.when(on, c)
    df = rows.select(key, (~on).alias("__off"), own(F.col(order)).alias(order), own(F.col("normalized")).alias("normalized"), own(F.col("y_center")).alias("y_center"), "image_width", "image_height", own(_row()).alias("a"))
    by_y = Window.partitionBy(key).orderBy("__off", "y_center", order)
    df = df.withColumns({"start": F.row_number().over(by_y), "b": F.lead("a").over(by_y), "c": F.lead("a", 2).over(by_y)})
    df = df.withColumn("__run", _best_run()).withColumn("__best", F.min("__run").over(Window.partitionBy(key)))
    first, last = F.col("__best.start"), F.col("__best.start") + F.col("__best.n") - 1
    tier = F.when(F.col("__best").isNotNull(), 1).when(~F.col("__off"), 2).otherwise(3)
    df = df.withColumn("tier", tier).filter(((F.col("tier") == 1) & F.col("start").between(first, last)) | ((F.col("tier") == 2) & (F.col("start") <= 3)) | ((F.col("tier") == 3) & (F.col("start") == 1)))
    index = F.when(F.col("tier") == 1, F.col("start") - first + 1).when(F.col("tier") == 2, F.col("start"))
    return df.select(key, "tier", index.alias("line_index"), order, "normalized")


def best_line_text(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """(key, text, ocr_score): the row with the highest (likeness, length, score), the first on ties."""
    rows = once(rows, "__n", mrz_normalize("text")).filter("__n <> ''")
    best = F.max(F.struct(mrz_likeness("__n", "__n").alias("l"), F.length("__n").alias("n"), F.col("ocr_score"), (-F.col(order)).alias("o"), F.col("__n").alias("text")))
    return rows.groupBy(*key).agg(best.alias("b")).select(*key, "b.text", "b.ocr_score")


def resolve_variants(df: DataFrame, key: str, as_of_year: int, max_candidates: int = 4) -> DataFrame:
    """Fallback cascade over line variants: base, repair, other variants (each with repair), enhanced.

    df: key, stage (0 base, 1 others, 2 enhanced), position, name, enhanced_of, lines, ocr_confidence,
    detector_confidence.  A repair counts only when its checks pass and its score rises.  Others are
    looked at when the base fails, the first max_candidates with two lines; an enhanced variant when
    what is selected still fails, and only the one made from it.  The first of equal scores stays.
    The variants are dealt by key once; a repair is parsed beside its variant, and only where that fails, and
    the cascade is a choice within a key's short list.
    """
    df = df.filter(F.col(key).isNotNull() & ((F.col("stage") != 1) | (F.size("lines") >= 2)))
    # a number of tasks that Spark does not lower: few bytes make much work here
    df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    df = df.withColumn("__r", F.row_number().over(Window.partitionBy(key, "stage").orderBy("position"))).filter((F.col("stage") != 1) | (F.col("__r") <= max_candidates))
    own = [key, "stage", "position", "name", "enhanced_of", "ocr_confidence"]

    def told(lines: str, parsed: DataFrame, carried: list[str], name: str) -> DataFrame:
        """Lines, verdict and score of a parse as one column, made once for the uses above it."""
        parts = F.struct(F.col(lines).alias("lines"), "document_type", "checksum_pass", candidate_score(parsed, lines).alias("score"), fallback_trigger(F.size(lines), "found", "checksum_pass").alias("trigger"))
        return once(parsed, name, parts).select(*carried, name)

    df = once(repair_lines(df), "__fix", F.struct("repaired", "corrections")).select(*own, "lines", "__fix")
    df = told("lines", parse_mrz(df, "lines", as_of_year), [*own, "__fix"], "raw")
    df = df.withColumn("repaired", F.when(F.col("raw.trigger").isNotNull() & (F.col("__fix.corrections") > 0), F.col("__fix.repaired")))
    df = told("repaired", parse_mrz(df, "repaired", as_of_year), [*own, "__fix", "raw"], "fixed")
    use = F.coalesce(F.col("fixed.checksum_pass") & (F.col("fixed.score") > F.col("raw.score")), F.lit(False))
    suffix = F.when(F.col("stage") == 0, "checksum-text-correction").otherwise(F.concat("name", F.lit("-text-correction")))
    s = F.when(use, F.col("fixed")).otherwise(F.col("raw"))
    row = F.struct(s["score"].alias("score"), (-F.col("stage")).alias("s"), (-F.col("position")).alias("p"), F.when(use, suffix).otherwise(F.col("name")).alias("name"), "enhanced_of", s["lines"].alias("lines"), s["document_type"].alias("document_type"), s["checksum_pass"].alias("ok"), F.when(use, F.col("__fix.corrections")).otherwise(F.lit(0)).alias("corrections"))
    first_trigger = F.max(F.when(F.col("stage") == 0, F.coalesce("raw.trigger", F.lit(""))))
    df = df.groupBy(key).agg(F.collect_list(row).alias("all"), F.nullif(F.coalesce(first_trigger, F.lit("missing-lines")), F.lit("")).alias("trigger"))
    base = F.exists("all", lambda x: (x["s"] == 0) & x["ok"])
    df = once(df, "early", F.array_max(F.filter("all", lambda x: (x["s"] == 0) | ((x["s"] == -1) & ~base)))).filter("early is not null")
    early = F.col("early")
    # the last of several enhanced variants of one name
    late = F.filter("all", lambda x: (x["s"] == -2) & ~early["ok"] & (x["enhanced_of"] == early["name"]) & (x["score"] > early["score"]))
    df = once(df, "b", F.coalesce(F.array_max(F.transform(late, lambda x: F.struct((-x["p"]).alias("p"), x.alias("row"))))["row"], early))
    out = df.select(key, F.col("b.name").alias("selected_variant"), "b.lines", "b.document_type", F.col("b.ok").alias("checksum_pass"), "b.corrections", "trigger")
    return out.withColumn("used_fallback", F.col("selected_variant") != "fast-projection")
