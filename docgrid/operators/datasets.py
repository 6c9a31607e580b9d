"""Making data sets: which records are usable, what is exported, and how items fan out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.functions.geometry import format_label, label_to_bbox, parse_label, rotate_label
from docgrid.functions.text import augmented_name, json_lines, mrz_normalize

#: Image fields of a record by class, and classes of PDF fields.
IMAGE_LABELS = {"passport": "passport_image", "face": "face_image"}
PDF_CLASSES = {"evisa": "FileEVisa", "dispatch": "FilePath"}


def _filled(c: str):
    return F.trim(F.coalesce(F.col(c), F.lit(""))) != ""


def usable(df: DataFrame, min_point: float = 90) -> DataFrame:
    """Records with both lines, both scores above min_point and an image."""
    score = lambda c: F.coalesce(F.col(c).try_cast("double") > min_point, F.lit(False))
    return df.filter(_filled("line_one") & _filled("line_two") & score("point_one") & score("point_two") & _filled("passport_image"))


def has_fields(df: DataFrame, require_both: bool, fields: tuple[str, str] = ("passport_image", "face_image")) -> DataFrame:
    a, b = _filled(fields[0]), _filled(fields[1])
    return df.filter(a & b if require_both else a | b)


def pdf_candidates(visas: DataFrame, dispatches: DataFrame) -> DataFrame:
    """(label, field, id, payload) of records whose field names or holds a PDF."""
    pick = lambda df, label, c: df.select(F.lit(label).alias("label"), F.lit(PDF_CLASSES[label]).alias("field"), "id", F.col(c).alias("payload")).filter(F.lower("payload").contains(".pdf") | F.startswith(F.lower("payload"), F.lit("data:application/pdf")))
    return pick(visas, "evisa", "file_evisa").unionByName(pick(dispatches, "dispatch", "file_path"))


def pending_extraction(items: DataFrame, done: DataFrame | None = None, force: bool = False, include_augmented: bool = False, split: str | None = None) -> DataFrame:
    """Approved, complete items, not augmented ones and not those already done, unless asked for."""
    df = items.filter("status = 'labeled' and review_status = 'approved' and image_file_name is not null and bbox_x1 is not null and bbox_y1 is not null and bbox_x2 is not null and bbox_y2 is not null")
    if not include_augmented:
        df = df.filter(~(F.col("source_key").like("%__rot90") | F.col("source_key").like("%__rot180") | F.col("source_key").like("%__rot270")))
    if split:
        df = df.filter(F.col("split") == split)
    return df if force or done is None else df.join(done.select("id"), "id", "left_anti")


def exportable_lines(lines: DataFrame, split: str | None = None, limit: int = 0) -> DataFrame:
    """Approved lines with a text: final, else normalised, else raw (normalised); ordered by item, line and id."""
    text = F.coalesce("final_text", "normalized_text", mrz_normalize("ocr_text"))
    df = lines.filter("review_status = 'approved'").withColumn("text", text).filter(F.trim("text") != "")
    df = (df.filter(F.col("split") == split) if split else df).orderBy("label_item_id", "line_index", "id")
    return df.limit(limit) if limit > 0 else df


def manifest_counts(df: DataFrame) -> DataFrame:
    """Counts by split and label, with subtotals (null) and the grand total."""
    return df.rollup("split", "label").agg(F.count("*").alias("n"))


def plan_counts(plan: DataFrame) -> DataFrame:
    """Planned items by split and angle; null splits are a group, repeated rows count, an empty plan gives no rows."""
    return plan.groupBy("split", "angle").agg(F.count("*").alias("n"))


def run_summary(processed: DataFrame, skipped: DataFrame) -> DataFrame:
    """Items by status, skipped ones included."""
    return processed.select("status").unionByName(skipped.select(F.lit("skipped").alias("status"))).groupBy("status").agg(F.count("*").alias("n"))


def explode_fields(df: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """One row per record and filled image field: id, label, payload."""
    labels = labels or IMAGE_LABELS
    options = F.array(*[F.struct(F.lit(k).alias("label"), F.col(c).alias("payload")) for k, c in labels.items()])
    return df.select("id", F.explode(options).alias("o")).select("id", "o.*").filter(_filled("payload"))


def delete_fields(df: DataFrame, fields: list[str], field: str = "field") -> DataFrame:
    return df.filter(~F.coalesce(F.col(field).isin(fields), F.lit(False))) if fields else df


def augment_labels(plan: DataFrame) -> DataFrame:
    """Planned (item, angle) rows with the turned label, box, size and names; unreadable labels give null parts.

    plan: source_key, image_file_name, yolo_label, image_width, image_height, angle.
    """
    turn = F.col("angle").isin(90, 270)
    df = plan.withColumns({"__l": rotate_label(parse_label("yolo_label"), "angle"), "new_width": F.when(turn, F.col("image_height")).otherwise(F.col("image_width")), "new_height": F.when(turn, F.col("image_width")).otherwise(F.col("image_height"))})
    df = df.withColumns({"new_label": format_label("__l"), "new_bbox": label_to_bbox("__l", "new_width", "new_height"), "new_key": F.concat("source_key", F.lit("__rot"), F.col("angle").cast("string")), "new_image": augmented_name("image_file_name", "angle")})
    return df.drop("__l")


def assign_line_text(lines: DataFrame, items: DataFrame, source: str, other: DataFrame | None = None) -> DataFrame:
    """Text of cut lines by position, from a chosen source, with a note of where it came from.

    parent: the item's JSON lines; crop or transaction: rows (label_item_id, line_index, text) in other;
    line: the line's own OCR; none: no text.
    """
    if source == "none":
        return lines.withColumns({"assigned": F.lit(""), "note": F.lit("ocr_skipped")})
    if source == "line":
        return lines.withColumns({"assigned": mrz_normalize(F.coalesce("ocr_text", F.lit(""))), "note": F.lit(None).cast("string")})
    if source == "parent":
        other = items.select(F.col("id").alias("label_item_id"), F.posexplode(json_lines("mrz_lines_json")).alias("i", "text")).select("label_item_id", (F.col("i") + 1).alias("line_index"), "text")
    notes = {"parent": ("text_from_parent_mrz_lines_json", "parent_text_missing"), "crop": ("text_from_paddle_mrz_crop", "paddle_crop_text_missing"), "transaction": ("text_from_transaction", "transaction_text_missing")}[source]
    texts = other.select("label_item_id", "line_index", F.col("text").alias("__t"))
    out = lines.join(texts.hint("merge"), ["label_item_id", "line_index"], "left")
    return out.withColumns({"assigned": F.coalesce("__t", F.lit("")), "note": F.when(F.col("__t").isNotNull(), notes[0]).otherwise(notes[1])}).drop("__t")
