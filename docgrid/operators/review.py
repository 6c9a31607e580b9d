"""Review of labels and lines: statistics, decisions, corrections and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrid.functions.geometry import bbox_percent, bbox_to_label, box, clamp_bbox
from docgrid.functions.text import json_lines, mrz_normalize, resolve_under
from docgrid.operators.order_index import Keep, order_index, paging, positions

STATES = ("pending", "approved", "rejected")


def _n(cond: Column, name: str) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False))).alias(name)


def label_stats(items: DataFrame) -> DataFrame:
    """One row: labeled items by review state (a null state counts in the total only), and those without a zone; repeated rows count."""
    own = F.col("status") == "labeled"
    return items.agg(_n(own, "total"), *[_n(own & (F.col("review_status") == s), s) for s in STATES], _n(F.col("status") == "no_mrz", "no_mrz"))


def line_stats(lines: DataFrame) -> DataFrame:
    """One row: lines by review state; a null state counts in the total only, repeated rows count, an empty table gives zeros."""
    return lines.agg(F.count("*").alias("total"), *[_n(F.col("review_status") == s, s) for s in STATES])


def group_stats(lines: DataFrame, key: str = "label_item_id") -> DataFrame:
    """Groups with a pending line, wholly approved ones, and those with a rejected line; states overlap."""
    g = lines.groupBy(key).agg(*[_n(F.col("review_status") == s, s) for s in STATES])
    return g.agg(F.count("*").alias("total"), _n(F.col("pending") > 0, "pending"), _n((F.col("pending") == 0) & (F.col("rejected") == 0) & (F.col("approved") > 0), "approved"), _n(F.col("rejected") > 0, "rejected"))


def label_position(items: DataFrame, keep: Keep, key: str = "id", rows: int = 1_000_000) -> DataFrame:
    """1-based place of each labeled item by key, from a stored order index of about ``rows`` rows a range (``keep`` stores it)."""
    return positions(order_index(items.filter("status = 'labeled'"), key, keep, rows))


def review_items(items: DataFrame, base: str, keep: Keep) -> DataFrame:
    """Items with a box as a reviewer sees them: defaults, box in percent, decoded lines and position."""
    b = box("bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2")
    placed = label_position(items, keep).filter("bbox_x1 is not null and bbox_y1 is not null and bbox_x2 is not null and bbox_y2 is not null")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return placed.select("id", F.coalesce("source_key", F.lit("")).alias("key"), resolve_under("source_key", base).alias("source"), F.coalesce("split", F.lit("")).alias("split"), b.alias("bbox"), bbox_percent(b, "image_width", "image_height").alias("percent"), json_lines("mrz_lines_json").alias("lines"), zero("mrz_score"), zero("ocr_ms"), F.coalesce("review_status", F.lit("")).alias("review_status"), "position")


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by order."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__s")).select(key, "__s.*")


def _rejected_name(c: str, kind: str) -> Column:
    """Where a rejected artefact goes: review/rejected/<kind>/<split>/<name>."""
    return F.concat(F.lit(f"review/rejected/{kind}/"), F.coalesce("split", F.lit("unknown")), F.lit("/"), F.regexp_extract(c, r"([^/]*)$", 1))


def apply_decisions(items: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, history, unknown) after the latest approved/rejected decision of each source_key.

    Other decision words are no decisions.  Rejection moves the names of image and label below
    review/rejected, approval clears them there and gives an item without a name its old one back.
    reviewed_at and updated_at are the decision's time.  history has every valid decision on a known key, in no order; unknown the keys
    that no item has.
    """
    valid = decisions.filter(F.col("decision").isin("approved", "rejected"))
    last = latest(valid.select("source_key", "decision", "ts", "event_id"), "source_key", ["ts", "event_id"]).withColumnsRenamed({"decision": "__d", "ts": "__ts", "event_id": "__e"})
    out = items.join(last, "source_key", "left")
    d = F.col("__d")
    new = {"review_status": F.coalesce(d, "review_status"), "reviewed_at": F.col("__ts"), "updated_at": F.coalesce("__ts", "updated_at")}
    for kind in ("image", "label"):
        name, rejected = f"{kind}_file_name", f"rejected_{kind}_file_name"
        moved = F.when(F.col(name).isNotNull(), _rejected_name(name, f"{kind}s"))
        new[rejected] = F.when(d == "approved", None).when(d == "rejected", F.coalesce(moved, rejected)).otherwise(F.col(rejected))
        new[name] = F.when((d == "approved") & F.col(name).isNull(), F.regexp_extract(rejected, r"([^/]*)$", 1)).otherwise(F.col(name))
    out = out.withColumns(new).drop("__d", "__ts", "__e")
    keys = items.select("source_key", F.col("id").alias("label_item_id"))
    history = valid.join(keys, "source_key").select("label_item_id", "source_key", "decision", F.col("ts").alias("reviewed_at"), "event_id")
    return out, history, valid.select("source_key").distinct().join(keys, "source_key", "left_anti")


def apply_line_decisions(lines: DataFrame, decisions: DataFrame) -> DataFrame:
    """Lines after their latest approved or rejected decision (other words are none): final text as given (normalised), else on approval the normalised or raw text, else as before."""
    valid = decisions.filter(F.col("decision").isin("approved", "rejected"))
    last = latest(valid.select("line_id", "decision", "final_text", "ts", "event_id"), "line_id", ["ts", "event_id"]).select(F.col("line_id").alias("id"), F.col("decision").alias("__d"), F.nullif(mrz_normalize("final_text"), F.lit("")).alias("__t"))
    fallback = F.when(F.col("__d") == "approved", F.coalesce(F.nullif(F.col("normalized_text"), F.lit("")), mrz_normalize(F.coalesce("ocr_text", F.lit("")))))
    out = lines.join(last, "id", "left")
    return out.withColumns({"final_text": F.when(F.col("__d").isNotNull(), F.coalesce("__t", fallback, "final_text")).otherwise(F.col("final_text")), "review_status": F.coalesce("__d", "review_status")}).drop("__d", "__t")


def refused_decisions(decisions: DataFrame) -> DataFrame:
    """(decision, n): words that are no decision, null among them, and how often they came."""
    return decisions.filter(~F.coalesce(F.col("decision").isin("approved", "rejected"), F.lit(False))).groupBy("decision").agg(F.count("*").alias("n"))


def approve_rotation(items: DataFrame, angle: int) -> DataFrame:
    """Pending labeled items whose key ends in two characters and rotN become approved (the rule is a LIKE pattern)."""
    hit = (F.col("status") == "labeled") & (F.col("review_status") == "pending") & F.col("source_key").like(f"%__rot{angle}")
    return items.withColumn("review_status", F.when(hit, "approved").otherwise(F.col("review_status")))


def apply_corrections(items: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, rejects) after the latest usable box of each key: clamped, new label, approved, restored."""
    c = corrections.join(items.select("source_key", "image_width", "image_height"), "source_key").withColumn("__b", clamp_bbox(box("x1", "y1", "x2", "y2"), "image_width", "image_height"))
    rejects = c.filter("__b is null").select("event_id", "source_key")
    last = latest(c.filter("__b is not null").select("source_key", "__b", "ts", "event_id"), "source_key", ["ts", "event_id"]).select("source_key", "__b")
    out = items.join(last, "source_key", "left")
    hit = F.col("__b").isNotNull()
    new = {f"bbox_{k}": F.coalesce(F.col(f"__b.{k}"), F.col(f"bbox_{k}")) for k in ("x1", "y1", "x2", "y2")}
    out = out.withColumns({**new, "yolo_label": bbox_to_label("__b", "image_width", "image_height"), "review_status": F.when(hit, "approved").otherwise(F.col("review_status")), "rejected_image_file_name": F.when(hit, None).otherwise(F.col("rejected_image_file_name")), "note": F.when(hit, "corrected_box")})
    return out.drop("__b"), rejects


def _queue(items: DataFrame, pending: bool) -> DataFrame:
    df = items.filter("status = 'labeled' and image_file_name is not null and label_file_name is not null")
    return df.filter("review_status = 'pending'") if pending else df


def next_item(items: DataFrame, after: int) -> DataFrame:
    """The first pending item after the key, else the first of all; at most one row."""
    return _queue(items, True).orderBy((F.col("id") <= after).cast("int"), "id").limit(1)


def previous_item(items: DataFrame, before: int) -> DataFrame:
    """The last reviewable item before the key, of any state; 0 means from the end."""
    df = _queue(items, False)
    return (df.filter(F.col("id") < before) if before > 0 else df).orderBy(F.desc("id")).limit(1)


def with_files(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Items with the names of image and label set to null where the catalogue (path) does not list them."""
    names = catalog.select("path").distinct()
    for c in ("image_file_name", "label_file_name"):
        items = items.join(names.withColumnRenamed("path", "__p").hint("merge"), F.col(c) == F.col("__p"), "left").withColumn(c, F.col("__p")).drop("__p")
    return items


def neighbours(items: DataFrame, keep: Keep, catalog: DataFrame | None = None, rows: int = 1_000_000) -> DataFrame:
    """(id, next_id, previous_id) for every labeled item: the paging of all rows at once.

    With a catalogue of files (path), items whose image or label it lacks are skipped like those without a name.
    A stored order index (``keep`` stores it) cuts ranges of about ``rows`` rows, so no task holds all rows.  After
    the last pending item the first one follows.
    """
    items = items.filter("status = 'labeled'")
    items = items if catalog is None else with_files(items, catalog)
    df = items.select("id", (F.col("image_file_name").isNotNull() & F.col("label_file_name").isNotNull()).alias("ok"), (F.col("review_status") == "pending").alias("p"))
    return paging(order_index(df if catalog is None else keep(df), "id", keep, rows))


def next_group(lines: DataFrame, after: int) -> DataFrame:
    """The first item after the key with a pending line, else the first of all; at most one row (id)."""
    return lines.filter("review_status = 'pending' and label_item_id > 0").select(F.col("label_item_id").alias("id")).distinct().orderBy((F.col("id") <= after).cast("int"), "id").limit(1)


def previous_group(lines: DataFrame, before: int) -> DataFrame:
    """The last item before the key that has lines, of any state; 0 or less means from the end."""
    df = lines.filter(F.col("label_item_id") < before) if before > 0 else lines
    return df.select(F.col("label_item_id").alias("id")).distinct().orderBy(F.desc("id")).limit(1)


def group_neighbours(lines: DataFrame, keep: Keep, rows: int = 1_000_000) -> DataFrame:
    """(id, next_id, previous_id) for every item with lines: the next one with a pending line (after the last the first), and the one before."""
    groups = lines.groupBy(F.col("label_item_id").alias("id")).agg(F.max(F.coalesce(F.col("review_status") == "pending", F.lit(False))).alias("p"))
    return paging(order_index(keep(groups.select("id", F.lit(True).alias("ok"), "p")), "id", keep, rows))
