"""Boxes, polygons and detection labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docgrid.functions.base import C, col


def box(x1: C, y1: C, x2: C, y2: C) -> Column:
    return F.struct(col(x1).cast("double").alias("x1"), col(y1).cast("double").alias("y1"), col(x2).cast("double").alias("x2"), col(y2).cast("double").alias("y2"))


def box_points(x1: C, y1: C, x2: C, y2: C) -> Column:
    """The four corners as a polygon."""
    p = lambda x, y: F.struct(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))
    return F.array(p(x1, y1), p(x2, y1), p(x2, y2), p(x1, y2))


def _clamp(v: Column, hi: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(v, hi.cast("double")))


def bounds(points: C) -> Column:
    p = col(points)
    xs, ys = F.transform(p, lambda q: q["x"]), F.transform(p, lambda q: q["y"])
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def unrotate_points(points: C, angle: C, width: C, height: C) -> Column:
    """Polygon of an image corrected by ``angle`` in the original's pixels (last pixel is size - 1)."""
    a, w, h = col(angle), col(width) - 1, col(height) - 1

    def one(q: Column) -> Column:
        x = F.when(a == 180, w - q["x"]).when(a == 90, w - q["y"]).when(a == 270, q["y"])
        y = F.when(a == 180, h - q["y"]).when(a == 90, q["x"]).when(a == 270, h - q["x"])
        turn = a.isin(90, 180, 270)
        return F.struct(F.when(turn, _clamp(x, w)).otherwise(q["x"]).alias("x"), F.when(turn, _clamp(y, h)).otherwise(q["y"]).alias("y"))

    return F.transform(col(points), one)


def unrotate_bbox(b: C, angle: C, width: C, height: C) -> Column:
    """Box found in a rotated image, in the original image; rounded to two places."""
    b, a, w, h = col(b), col(angle), col(width), col(height)
    x1 = F.when(a == 90, w - b["y2"]).when(a == 180, w - b["x2"]).when(a == 270, b["y1"]).otherwise(b["x1"])
    x2 = F.when(a == 90, w - b["y1"]).when(a == 180, w - b["x1"]).when(a == 270, b["y2"]).otherwise(b["x2"])
    y1 = F.when(a == 90, b["x1"]).when(a == 180, h - b["y2"]).when(a == 270, h - b["x2"]).otherwise(b["y1"])
    y2 = F.when(a == 90, b["x2"]).when(a == 180, h - b["y1"]).when(a == 270, h - b["x1"]).otherwise(b["y2"])
    r = lambda v, hi: F.round(_clamp(v, hi), 2)
    return box(r(x1, w), r(y1, h), r(x2, w), r(y2, h))


def clamp_bbox(b: C, width: C, height: C) -> Column:
    """Corners in order and inside the image, two places; null when a side is under four pixels."""
    b, w, h = col(b), col(width), col(height)
    x1, x2 = _clamp(F.least(b["x1"], b["x2"]), w), _clamp(F.greatest(b["x1"], b["x2"]), w)
    y1, y2 = _clamp(F.least(b["y1"], b["y2"]), h), _clamp(F.greatest(b["y1"], b["y2"]), h)
    return F.when((x2 - x1 >= 4) & (y2 - y1 >= 4), box(F.round(x1, 2), F.round(y1, 2), F.round(x2, 2), F.round(y2, 2)))


def bbox_percent(b: C, width: C, height: C) -> Column:
    b, w, h = col(b), col(width), col(height)
    p = lambda v, full: F.round(v / full * 100, 4)
    return F.struct(p(b["x1"], w).alias("left"), p(b["y1"], h).alias("top"), p(b["x2"] - b["x1"], w).alias("width"), p(b["y2"] - b["y1"], h).alias("height"))


def crop_box(b: C, width: C, height: C, ratio: float, least: int = 2) -> Column:
    """Padded pixel box: corners sorted, padded by max(least, ratio * side), rounded half to even, clamped."""
    b, w, h = col(b), col(width), col(height)
    x1, x2, y1, y2 = F.least(b["x1"], b["x2"]), F.greatest(b["x1"], b["x2"]), F.least(b["y1"], b["y2"]), F.greatest(b["y1"], b["y2"])
    px, py = F.greatest(F.lit(float(least)), (x2 - x1) * ratio), F.greatest(F.lit(float(least)), (y2 - y1) * ratio)
    i = lambda v, hi: F.least(F.greatest(F.rint(v).cast("int"), F.lit(0)), hi.cast("int"))
    return F.struct(i(x1 - px, w).alias("x1"), i(y1 - py, h).alias("y1"), i(x2 + px, w).alias("x2"), i(y2 + py, h).alias("y2"))


def pad_box(x: C, y: C, w: C, h: C, width: C, height: C, pad: int) -> Column:
    """Fixed padding of an (x, y, w, h) box, clamped to the image."""
    return F.struct(F.greatest(F.lit(0), col(x) - pad).alias("x1"), F.greatest(F.lit(0), col(y) - pad).alias("y1"), F.least(col(width), col(x) + col(w) + pad).alias("x2"), F.least(col(height), col(y) + col(h) + pad).alias("y2"))


def padded_union_box(x1: C, y1: C, x2: C, y2: C, width: C, height: C, ratio: float = 0.012) -> Column:
    """A union box padded by a share of the image, clamped to the last pixel."""
    w, h = col(width), col(height)
    return box(F.greatest(F.lit(0.0), col(x1) - w * ratio), F.greatest(F.lit(0.0), col(y1) - h * ratio), F.least(w - 1.0, col(x2) + w * ratio), F.least(h - 1.0, col(y2) + h * ratio))


def line_box_full(line: C, crop: C) -> Column:
    """A line's box in its crop as a box in the whole image."""
    b, c = col(line), col(crop)
    return box(b["x1"] + c["x1"], b["y1"] + c["y1"], b["x2"] + c["x1"], b["y2"] + c["y1"])


def bbox_to_center(b: C, width: C, height: C) -> Column:
    """struct(class_id, xc, yc, w, h) in shares of the image."""
    b, w, h = col(b), col(width), col(height)
    return F.struct(F.lit(0).alias("class_id"), ((b["x1"] + b["x2"]) / 2 / w).alias("xc"), ((b["y1"] + b["y2"]) / 2 / h).alias("yc"), ((b["x2"] - b["x1"]) / w).alias("w"), ((b["y2"] - b["y1"]) / h).alias("h"))


def format_label(label: C) -> Column:
    """Label text with shares clamped to 0..1 and six decimals."""
    v = col(label)
    s = lambda f: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v[f]))
    return F.when(v.isNotNull(), F.format_string("%d %.6f %.6f %.6f %.6f", v["class_id"], s("xc"), s("yc"), s("w"), s("h")))


def bbox_to_label(b: C, width: C, height: C) -> Column:
    v = bbox_to_center(b, width, height)
    return F.when(col(b).isNotNull(), F.format_string("%d %.6f %.6f %.6f %.6f", v["class_id"], v["xc"], v["yc"], v["w"], v["h"]))


def parse_label(text: C) -> Column:
    """Label struct from text, null unless it has five numbers."""
    p = F.split(F.trim(col(text)), r"\s+")
    n = lambda i: F.get(p, F.lit(i)).try_cast("double")
    good = (F.size(p) == 5) & n(0).isNotNull() & n(1).isNotNull() & n(2).isNotNull() & n(3).isNotNull() & n(4).isNotNull()
    return F.when(good, F.struct(n(0).cast("int").alias("class_id"), n(1).alias("xc"), n(2).alias("yc"), n(3).alias("w"), n(4).alias("h")))


def rotate_label(label: C, angle: C) -> Column:
    """A label after turning the image by 90 (counter-clockwise), 180 or 270 degrees; null for other angles."""
    v, a = col(label), col(angle)
    turn = a.isin(90, 270)
    xc = F.when(a == 90, v["yc"]).when(a == 180, 1 - v["xc"]).otherwise(1 - v["yc"])
    yc = F.when(a == 90, 1 - v["xc"]).when(a == 180, 1 - v["yc"]).otherwise(v["xc"])
    return F.when(v.isNotNull() & a.isin(90, 180, 270), F.struct(v["class_id"].alias("class_id"), xc.alias("xc"), yc.alias("yc"), F.when(turn, v["h"]).otherwise(v["w"]).alias("w"), F.when(turn, v["w"]).otherwise(v["h"]).alias("h")))


def label_to_bbox(label: C, width: C, height: C) -> Column:
    v, w, h = col(label), col(width), col(height)
    r = lambda c, half, full, sign: F.round(_clamp(v[c] * full + sign * v[half] * full / 2, full), 2)
    return F.when(v.isNotNull(), box(r("xc", "w", w, -1), r("yc", "h", h, -1), r("xc", "w", w, 1), r("yc", "h", h, 1)))


def valid_bbox(a: C) -> Column:
    """A list of four numbers as a box; anything else is null."""
    v = col(a)
    n = lambda i: F.get(v, F.lit(i)).try_cast("double")
    return F.when((F.size(v) == 4) & n(0).isNotNull() & n(1).isNotNull() & n(2).isNotNull() & n(3).isNotNull(), box(n(0), n(1), n(2), n(3)))
