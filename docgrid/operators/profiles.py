"""Lines of text from row profiles, component tables and segments.

A profile is one array an image, in a table (img_id, v): the value of each row from the top.  What is found
in it stays beside it as arrays, so a chain of operators is expressions over one row and needs no join;
``as_arrays`` makes such a table from rows (img_id, y, v), ``band_rows`` gives the bands as rows again.
Bands have y1, y2 (exclusive, except that a band open at the bottom ends at height - 1) and score, their
mean value.  Empty profiles have no bands, and a null image is an image like any other.

Tables of components and segments are grouped by image; images with a null key have no row where they are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "img_id"
BANDS = "array<struct<y1:int,y2:int,score:double>>"


def _half_even(c: Column) -> Column:
    return F.rint(c).cast("int")


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def as_arrays(profile: DataFrame) -> DataFrame:
    """(img_id, v) of rows (img_id, y, v): of a place that stands twice the highest value counts, places without a row and null values are 0."""
    # sort_array compares values natively, array_sort by an interpreted function; no element is null
    rows = F.sort_array(F.collect_list(F.struct("y", (-F.coalesce("v", F.lit(0.0))).alias("w"))))
    df = profile.filter("y is not null").groupBy(KEY).agg(rows.alias("a"))
    # after the sort a place's first row has its highest value
    df = df.select(KEY, F.filter("a", lambda x, i: (i == 0) | (x["y"] != F.get("a", i - 1)["y"])).alias("a"))
    height = F.element_at("a", -1)["y"] + 1
    at = lambda y: F.coalesce(F.get(F.filter("a", lambda x: x["y"] == y), F.lit(0))["w"], F.lit(0.0))
    dense = F.when(F.size("a") == height, F.transform("a", lambda x: -x["w"])).otherwise(F.transform(F.sequence(F.lit(0), height - 1), lambda y: -at(y)))
    return df.select(KEY, F.transform(dense, lambda x: x + 0.0).alias("v"))


def band_rows(images: DataFrame) -> DataFrame:
    """(img_id, y1, y2, score) of a table with ``bands``."""
    # an outer explode: for an inner one Spark infers a filter that computes the bands once more below
    return images.select(KEY, F.inline_outer("bands")).filter("y1 is not null")


def numbered(images: DataFrame, values: Column | str, at: str, value: str) -> DataFrame:
    """(img_id, at, value) for each of an array's values, at from 0; by an outer explode as in band_rows."""
    return images.select(KEY, F.posexplode_outer(values).alias(at, value)).filter(F.col(at).isNotNull())


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, x: t + x)


def _mean(v: Column, y1: Column, y2: Column) -> Column:
    return _sum(F.slice(v, y1 + 1, y2 - y1)) / (y2 - y1)


def _band(v: Column, y1: Column, y2: Column) -> Column:
    return F.struct(y1.cast("int").alias("y1"), y2.cast("int").alias("y2"), _mean(v, y1, y2).alias("score"))


def _lowest(v: Column, lo: Column, hi: Column) -> Column:
    """Place of the least value within lo..hi (inclusive), the first of equal ones."""
    return F.array_min(F.transform(F.sequence(lo.cast("int"), hi.cast("int")), lambda y: F.struct(F.get(v, y).alias("v"), y.alias("y"))))["y"]


def _active(v: Column, least: Column, strict: bool = False) -> Column:
    """Places whose value reaches (or passes) a threshold."""
    told = F.transform(v, lambda x, i: F.when((x > least) if strict else (x >= least), i))
    return F.filter(told, lambda i: i.isNotNull())


def profile_bands(images: DataFrame, ratio: float = 0.12, min_height: int = 6) -> DataFrame:
    """Adds bands: runs of rows with at least ratio times the image's highest value, min_height or taller."""
    v = F.col("v")

    def found(on: Column) -> Column:
        first = F.filter(on, lambda y, i: (i == 0) | (F.get(on, i - 1) != y - 1))
        last = F.filter(on, lambda y, i: (i == F.size(on) - 1) | (F.get(on, i + 1) != y + 1))
        runs = F.filter(F.transform(F.arrays_zip(first.alias("a"), last.alias("b")), lambda x: F.struct(x["a"].alias("y1"), (x["b"] + 1).alias("end"))), lambda x: x["end"] - x["y1"] >= min_height)
        end = lambda x: F.when(x["end"] == F.size(v), x["end"] - 1).otherwise(x["end"])
        return F.transform(runs, lambda x: F.struct(x["y1"].alias("y1"), end(x).alias("y2"), _mean(v, x["y1"], x["end"]).alias("score")))

    most = F.coalesce(F.array_max(v), F.lit(0.0))
    bands = _let(_let(most * ratio, lambda least: _active(v, least)), found)
    return images.withColumn("bands", F.when(most > 0, bands.cast(BANDS)).otherwise(_none(BANDS)))


def _sorted(bands: Column | str, *keys) -> Column:
    """Bands in the order of the keys (functions of a band)."""
    keyed = F.transform(bands, lambda x: F.struct(*(k(x).alias(f"k{i}") for i, k in enumerate(keys)), x.alias("b")))
    return F.transform(F.sort_array(keyed), lambda x: x["b"])


def top_bands(images: DataFrame, expected: int = 2) -> DataFrame:
    """Keeps the strongest bands by score times height, from the top."""
    best = F.slice(_sorted("bands", lambda x: -x["score"] * (x["y2"] - x["y1"]), lambda x: x["y1"]), 1, expected)
    return images.withColumn("bands", F.sort_array(best))


def split_wide_bands(images: DataFrame, expected: int = 2, min_height: int = 6) -> DataFrame:
    """While an image has too few bands, its tallest is cut at the lowest value of its middle 30-70 %.

    Each round adds one band at most, so there are expected - 1 rounds; a band under three times
    min_height, or without a place to cut, ends it.
    """
    v = F.col("v")

    def cut(bands: Column) -> Column:
        def at(t: Column) -> Column:
            h = t["y2"] - t["y1"]
            lo, hi = F.greatest(t["y1"] + min_height, t["y1"] + F.floor(h * 0.3)), F.least(t["y2"] - min_height, t["y1"] + F.floor(h * 0.7))
            parts = lambda y: F.concat(F.filter(bands, lambda x: x["y1"] != t["y1"]), F.array(_band(v, t["y1"], y), _band(v, y, t["y2"])))
            return F.when((h >= 3 * min_height) & (hi > lo), _let(_lowest(v, lo, F.greatest(lo, hi - 1)), parts).cast(BANDS)).otherwise(bands)

        tallest = F.get(_sorted(bands, lambda x: x["y1"] - x["y2"], lambda x: x["y1"]), F.lit(0))
        return F.when((F.size(bands) > 0) & (F.size(bands) < expected), _let(tallest, at)).otherwise(bands)

    if expected < 2:
        return images
    return images.withColumn("bands", F.aggregate(F.sequence(F.lit(2), F.lit(expected)), F.col("bands").cast(BANDS), lambda b, _: cut(b)))


def force_bands(images: DataFrame, expected: int = 2, min_height: int = 6) -> DataFrame:
    """Images with too few bands get equal slices of their active extent (over 3 % of the highest), if it is tall enough."""
    v = F.col("v")

    def slices(on: Column) -> Column:
        top, bottom = F.get(on, F.lit(0)), F.element_at(on, -1) + 1
        step = F.greatest(F.lit(min_height), _half_even((bottom - top) / expected))
        cut = lambda i: F.struct((top + i * step).alias("y1"), F.when(i == expected - 1, bottom).otherwise(F.least(bottom, top + (i + 1) * step)).alias("y2"))
        parts = F.filter(F.transform(F.sequence(F.lit(0), F.lit(expected - 1)), cut), lambda x: x["y2"] - x["y1"] >= min_height)
        forced = _let(parts, lambda p: F.when(F.size(p) >= expected, F.transform(p, lambda x: _band(v, x["y1"], x["y2"])).cast(BANDS)))
        return F.when(F.size(on) > 0, F.when(bottom - top >= min_height * expected, forced))

    least = F.greatest(F.lit(1.0), F.coalesce(F.array_max(v), F.lit(0.0)) * 0.03)
    forced = _let(_let(least, lambda t: _active(v, t, strict=True)), slices)
    return images.withColumn("bands", F.when(F.size("bands") < expected, F.coalesce(forced, "bands")).otherwise(F.col("bands")))


def _separators(v: Column, bands: Column | str) -> Column:
    """The lowest row between the middles of each band and the next."""
    mids = F.transform(bands, lambda x: _half_even((x["y1"] + x["y2"]) / 2))
    between = lambda m: F.transform(F.slice(m, F.lit(2), F.greatest(F.size(m) - 1, F.lit(0))), lambda d, i: _lowest(v, F.least(F.get(m, i), d), F.greatest(F.get(m, i), d)))
    return _let(mids, between)


def separators(images: DataFrame) -> DataFrame:
    """(img_id, band, separator): the lowest row between the middles of a band and the next."""
    return numbered(images, _separators(F.col("v"), F.sort_array("bands")), "band", "separator").withColumn("band", F.col("band") + 1)


def line_bounds(images: DataFrame, pad_ratio: float = 0.06, ratio: float = 0.05) -> DataFrame:
    """(img_id, band, top, bottom) of each line: active rows between separators, padded."""
    v, h = F.col("v"), F.size("v")
    pad = F.greatest(F.lit(2), _half_even(h * pad_ratio))

    def bound(lo: Column, hi: Column) -> Column:
        part = F.slice(v, lo + 1, hi - lo)
        most = F.array_max(part)
        on = F.when(most > 0, _let(F.greatest(F.lit(1.0), most * ratio), lambda t: _active(part, t))).otherwise(_none("array<int>"))
        told = lambda a: F.when(F.size(a) > 0, F.struct(F.greatest(lo, lo + F.get(a, F.lit(0)) - pad).alias("top"), F.least(hi, lo + F.element_at(a, -1) + pad + 1).alias("bottom"))).otherwise(F.struct(lo.alias("top"), hi.alias("bottom")))
        return _let(on, told)

    def bounds(seps: Column) -> Column:
        lo = lambda i: F.when(i == 0, 0).otherwise(F.get(seps, i - 1))
        hi = lambda i: F.greatest(lo(i) + 1, F.least(h, F.coalesce(F.get(seps, i), h)))
        span = F.transform("bands", lambda _, i: F.struct(lo(i).alias("lo"), hi(i).alias("hi")))
        return F.transform(span, lambda x: bound(x["lo"], x["hi"]))

    lines = numbered(images.withColumn("bands", F.sort_array("bands")), _let(_separators(v, "bands"), bounds), "band", "b")
    return lines.select(KEY, (F.col("band") + 1).alias("band"), "b.top", "b.bottom")


def component_lines(parts: DataFrame, expected: int = 2) -> DataFrame:
    """(img_id, y1, y2, score): lines of components, or no row where there are too few.

    Components of fitting size, by vertical middle; one starts a new group when it is further from the
    running mean of the group than max(10, 1.4 times the median height).  The mean moves with each
    member, so it is a walk over the image's sorted components.
    """
    ok = parts.filter(F.col("w").between(2, F.least(F.lit(70), "image_width")) & F.col("h").between(6, F.least(F.lit(70), "image_height")) & (F.col("area") >= 8))
    g = ok.groupBy(KEY).agg(F.count("*").alias("n"), F.median("h").alias("mh"), F.first("image_width").alias("iw"), F.first("image_height").alias("ih"), F.array_sort(F.collect_list(F.struct(F.col("cy").cast("double").alias("cy"), "comp_id", F.col("x").cast("double").alias("x1"), F.col("y").cast("double").alias("y1"), (F.col("x") + F.col("w")).cast("double").alias("x2"), (F.col("y") + F.col("h")).cast("double").alias("y2"), F.col("area").cast("double").alias("area")))).alias("a")).filter(F.col("n") >= expected * 5)
    limit = F.greatest(F.lit(10.0), F.col("mh") * 1.4)
    kind = "struct<sum:double,n:int,g:int,out:array<int>>"
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(0).alias("g"), F.array().cast("array<int>").alias("out")).cast(kind)

    def step(s: Column, x: Column) -> Column:
        new = (s["n"] == 0) | (F.abs(x["cy"] - s["sum"] / s["n"]) > limit)
        g_ = F.when(new, s["g"] + 1).otherwise(s["g"])
        return F.struct(F.when(new, x["cy"]).otherwise(s["sum"] + x["cy"]).alias("sum"), F.when(new, F.lit(1)).otherwise(s["n"] + 1).alias("n"), g_.alias("g"), F.concat(s["out"], F.array(g_)).alias("out")).cast(kind)

    g = g.withColumn("gs", F.aggregate("a", start, step)["out"])
    rows = g.select(KEY, "iw", "ih", F.explode(F.arrays_zip("a", "gs")).alias("z")).select(KEY, "iw", "ih", "z.gs", "z.a.*")
    lines = rows.groupBy(KEY, "gs", "iw", "ih").agg(F.count("*").alias("n"), (F.max("x2") - F.min("x1")).alias("span"), F.greatest(F.lit(0), _half_even(F.min("y1"))).alias("y1"), F.least(F.first("ih") - 1, _half_even(F.max("y2"))).alias("y2"), F.sum("area").alias("area")).filter((F.col("n") >= 3) & (F.col("span") >= F.col("iw") * 0.2))
    own = Window.partitionBy(KEY)
    s = F.col("span") * F.col("n") + F.col("area")
    lines = lines.withColumns({"s": s, "c": F.count("*").over(own)}).filter(F.col("c") >= expected).withColumn("r", F.row_number().over(own.orderBy(F.desc("s"), "y1"))).filter(F.col("r") <= expected)
    return lines.select(KEY, "y1", "y2", (F.col("s") / F.greatest(F.lit(1), F.col("y2") - F.col("y1"))).alias("score"))


def component_skew(parts: DataFrame, cap: float = 15.0) -> DataFrame:
    """(img_id, angle): slope of component middles in degrees; null with fewer than eight or beyond the cap."""
    ok = parts.filter(F.col("w").between(3, 45) & F.col("h").between(6, 55) & (F.col("area") >= 10))
    a = F.degrees(F.atan(F.regr_slope("cy", "cx")))
    return ok.groupBy(KEY).agg(F.count("*").alias("n"), a.alias("angle")).select(KEY, F.when((F.col("n") >= 8) & (F.abs("angle") <= cap), F.col("angle")).alias("angle"))


def segment_skew(segments: DataFrame, cap: float = 15.0) -> DataFrame:
    """(img_id, angle): median angle of at least three long, flat segments, else null."""
    a = F.degrees(F.atan2(F.col("sy2") - F.col("sy1"), F.col("sx2") - F.col("sx1")))
    ok = segments.withColumn("a", a).withColumn("ok", (F.abs(F.col("sx2") - F.col("sx1")) >= 30) & (F.abs("a") <= cap))
    return ok.groupBy(KEY).agg(F.when(F.count_if("ok") >= 3, F.median(F.when(F.col("ok"), F.col("a")))).alias("angle"))


def min_area_angle(width: Column, height: Column, angle: Column) -> Column:
    """Angle of a rectangle, turned to its long side and into -45..45."""
    a = F.when(width < height, angle + 90).otherwise(angle)
    a = F.when(a > 45, a - 90).otherwise(a)
    return F.when(a < -45, a + 90).otherwise(a)


def choose_skew(images: DataFrame, segments: DataFrame, boxes: DataFrame, parts: DataFrame, cap: float = 15.0) -> DataFrame:
    """(img_id, angle, skew_from): segments, else the widest box, else components, else 0.

    boxes: img_id, w, h, rect_w, rect_h, rect_angle, image_width, image_height.
    """
    big = (F.col("w") >= F.col("image_width") * 0.25) & (F.col("h") >= 3) & ~((F.col("w") > F.col("image_width") * 0.95) & (F.col("h") > F.col("image_height") * 0.7))
    b = boxes.filter(big).withColumn("a", min_area_angle(F.col("rect_w"), F.col("rect_h"), F.col("rect_angle"))).filter(F.abs("a") <= cap)
    b = b.groupBy(KEY).agg(F.max(F.struct((F.col("w") * F.col("h") * F.col("w") / F.greatest(F.lit(1), "h")).alias("s"), "a")).alias("m")).select(KEY, F.col("m.a").alias("__b"))
    df = images.select(KEY).distinct().join(segment_skew(segments, cap).withColumnRenamed("angle", "__s"), KEY, "left").join(b, KEY, "left").join(component_skew(parts, cap).withColumnRenamed("angle", "__c"), KEY, "left")
    return df.select(KEY, F.coalesce("__s", "__b", "__c", F.lit(0.0)).alias("angle"), F.when(F.col("__s").isNotNull(), "segments").when(F.col("__b").isNotNull(), "box").when(F.col("__c").isNotNull(), "components").otherwise("none").alias("skew_from"))


def trim_bounds(images: DataFrame, pad_ratio: float = 0.02, ratio: float = 0.08) -> DataFrame:
    """(img_id, left, right): horizontal extent of eight or more components, else of the column profile, else all.

    images: img_id, image_width, image_height, parts (array of x, w, h, area) and columns (array of x, v).  A
    trim under a quarter of the width is not used.
    """
    w = F.col("image_width")
    pad = F.greatest(F.lit(6), _half_even(w * pad_ratio))
    fits = lambda c: c["w"].between(2, F.least(F.lit(70), w)) & c["h"].between(6, F.least(F.lit(70), F.col("image_height"))) & (c["area"] >= 8)
    least = F.greatest(F.lit(255.0), F.array_max(F.transform("columns", lambda c: c["v"])) * ratio)
    df = images.select(KEY, "image_width", F.filter("parts", fits).alias("ok"), F.transform(_let(least, lambda t: F.filter("columns", lambda c: c["v"] >= t)), lambda c: c["x"]).alias("on"))
    span = lambda lo, hi: F.struct(F.greatest(F.lit(0), lo - pad).alias("left"), F.least(w, hi + pad).alias("right"))
    wide = lambda s: F.when(s["right"] - s["left"] >= w * 0.25, s)
    of_parts = F.when(F.size("ok") >= 8, span(F.array_min(F.transform("ok", lambda c: c["x"])), F.array_max(F.transform("ok", lambda c: c["x"] + c["w"]))))
    of_columns = F.when(F.size("on") > 0, span(F.array_min("on"), F.array_max("on") + 1))
    s = F.coalesce(wide(of_parts), wide(of_columns), F.struct(F.lit(0).alias("left"), w.alias("right")))
    return df.select(KEY, s.alias("s")).select(KEY, "s.*")


def fixed_split(images: DataFrame, overlap_ratio: float = 0.10, pad_ratio: float = 0.05) -> DataFrame:
    """(img_id, line, top, bottom): two lines cut at the lowest row near the middle of the active extent."""
    v, h = F.col("v"), F.size("v")
    pad = F.greatest(F.lit(2), _half_even(h * pad_ratio))
    on = _let(F.greatest(F.lit(1.0), F.array_max(v) * 0.03), lambda t: _active(v, t))

    def lines(e: Column) -> Column:
        top, bottom = e["top"], e["bottom"]
        tall = F.greatest(F.lit(2), bottom - top)
        mid, radius, over = _half_even((top + bottom) / 2), F.greatest(F.lit(2), _half_even(tall * 0.16)), F.greatest(F.lit(2), _half_even(tall * overlap_ratio))
        lo, hi = F.greatest(top + 1, mid - radius), F.least(bottom - 1, mid + radius)
        at = F.when(hi > lo, _lowest(v, lo, F.greatest(lo, hi - 1))).otherwise(mid)
        one = lambda n, a, b: F.struct(F.lit(n).alias("line"), a.alias("top"), b.alias("bottom"))
        return _let(at, lambda y: F.array(one(1, F.greatest(F.lit(0), top - pad), F.least(h, y + over)), one(2, F.greatest(F.lit(0), y - over), F.least(h, bottom + pad))))

    extent = _let(on, lambda a: F.when(F.size(a) > 0, F.struct(F.get(a, F.lit(0)).alias("top"), (F.element_at(a, -1) + 1).alias("bottom"))).otherwise(F.struct(F.lit(0).alias("top"), h.alias("bottom"))))
    return images.filter(h >= 4).select(KEY, F.explode_outer(_let(extent, lines)).alias("t")).select(KEY, "t.*").filter("bottom > top")


def orientation_vote(glyphs: DataFrame, min_components: int = 6, min_delta: float = 0.5, least: float = 0.08) -> DataFrame:
    """(img_id, score_0, score_180, count_0, rotate): whether filler glyphs say that a crop is upside down.

    glyphs: img_id, comp_id, width, height, local_x, local_y, one row a pixel.  Turning a glyph mirrors
    its means, so its score changes sign.
    """
    y, h = F.col("local_y"), F.col("height")
    band = lambda cond: (F.avg(F.when(cond, F.col("local_x"))), F.count_if(cond))
    (t, nt), (m, nm), (b, nb) = band(y <= h * 0.35), band((y > h * 0.35) & (y < h * 0.65)), band(y >= h * 0.65)
    g = glyphs.groupBy(KEY, "comp_id", "width", "height").agg(t.alias("t"), nt.alias("nt"), m.alias("m"), nm.alias("nm"), b.alias("b"), nb.alias("nb"))
    g = g.filter((F.col("nt") >= 2) & (F.col("nm") >= 2) & (F.col("nb") >= 2) & (F.abs(F.col("t") - F.col("b")) <= F.col("width") * 0.4))
    g = g.withColumn("s", ((F.col("t") + F.col("b")) / 2 - F.col("m")) / F.greatest(F.lit(1), "width")).filter(F.abs("s") >= least)
    out = g.groupBy(KEY).agg(F.sum("s").alias("score_0"), (-F.sum("s")).alias("score_180"), F.count("*").alias("count_0"))
    return out.withColumn("rotate", (F.col("count_0") >= min_components) & (F.col("score_180") > 0) & (F.col("score_180") > F.col("score_0") + min_delta))


def vertical_turn(width: Column, height: Column, ratio: float = 1.15, clockwise: bool = True) -> Column:
    """Degrees by which a tall crop is turned."""
    return F.when(height > width * ratio, 90 if clockwise else 270).otherwise(0)


def region_candidates(boxes: DataFrame, key: str = "image_id") -> DataFrame:
    """Contour boxes that may hold an MRZ with their score, and two bands at the bottom of each image."""
    w, h, iw, ih = F.col("w"), F.col("h"), F.col("image_width"), F.col("image_height")
    ok = (w * h >= iw * ih * 0.008) & (w / F.greatest(F.lit(1), h) >= 3) & (w >= iw * 0.35)
    score = F.least(F.lit(0.95), 0.45 + 0.25 * F.least(w / F.greatest(F.lit(1), h) / 10, F.lit(1.0)) + 0.30 * F.col("y") / F.greatest(F.lit(1), ih))
    shapes = boxes.filter(ok).select(key, "x", "y", "w", "h", score.alias("score"), F.lit("morphology").alias("source"))
    bands = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(s).alias("s")) for f, s in ((0.34, 0.66), (0.46, 0.69))])
    images = boxes.select(key, "image_width", "image_height").distinct().withColumn("b", F.explode(bands))
    top = F.floor(ih * (1 - F.col("b.f"))).cast("int")
    return shapes.unionByName(images.select(key, F.lit(0).alias("x"), top.alias("y"), iw.alias("w"), (ih - top).alias("h"), F.col("b.s").alias("score"), F.lit("bottom_band").alias("source")))
