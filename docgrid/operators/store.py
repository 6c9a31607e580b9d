"""Table upkeep by whole-table joins: skips, upserts, children, presence and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.operators.review import latest


def unprocessed(files: DataFrame, manifest: DataFrame, force: bool = False, keys: tuple[str, ...] = ("path", "length", "modified")) -> DataFrame:
    """Files not in the manifest with the same fingerprint and a terminal status (labeled or no_mrz)."""
    return files if force else files.join(manifest.filter(F.col("status").isin("labeled", "no_mrz")).select(*keys), list(keys), "left_anti")


#: How an upsert treats review_status: take the update's, keep the old when the update has none, force a value, or reset.
POLICIES = ("manifest", "source", "augment", "replace")


def upsert(target: DataFrame, updates: DataFrame, key: str, order: str, policy: str = "replace") -> DataFrame:
    """target with updates applied by key; of several updates of one key the last by order counts.

    manifest: a null review_status keeps the old one, or is pending for new rows.  source: review_status
    becomes approved.  augment: it becomes pending.  replace: it is the update's.  Other columns of an
    update replace the old ones.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    rest = [c for c in target.columns if c != key]
    new = latest(updates.select(key, *rest, order) if order not in rest else updates.select(key, *rest), key, [order])
    new = new.select(key, F.struct(*rest).alias("__n"))
    both = target.select(key, F.struct(*rest).alias("__o")).join(new, key, "full_outer")
    hit, out = F.col("__n").isNotNull(), {}
    for c in rest:
        value = F.col(f"__n.{c}")
        if c == "review_status":
            value = {"manifest": F.coalesce(value, F.col(f"__o.{c}"), F.lit("pending")), "source": F.lit("approved"), "augment": F.lit("pending"), "replace": value}[policy]
        out[c] = F.when(hit, value).otherwise(F.col(f"__o.{c}"))
    return both.select(key, *[v.alias(c) for c, v in out.items()])


def replace_children(lines: DataFrame, new: DataFrame, parent: str = "label_item_id", touched: DataFrame | None = None) -> DataFrame:
    """Lines without those of the touched parents (default: the parents of new), plus new."""
    keys = (new if touched is None else touched).select(parent).distinct()
    return lines.join(keys, parent, "left_anti").unionByName(new)


def line_counts(lines: DataFrame, parent: str = "label_item_id") -> DataFrame:
    return lines.groupBy(parent).agg(F.count("*").alias("n_lines"))


def mark_parents(items: DataFrame, lines: DataFrame, errors: DataFrame, as_of, key: str = "id", parent: str = "label_item_id") -> DataFrame:
    """Adds extract_status (error, done, no_lines), extract_count, extract_error and extracted_at from children and errors."""
    counts = line_counts(lines, parent).withColumnRenamed(parent, key)
    out = items.join(counts, key, "left").join(errors.select(key, F.col("error").alias("extract_error")), key, "left")
    n = F.coalesce("n_lines", F.lit(0))
    return out.withColumns({"extract_status": F.when(F.col("extract_error").isNotNull(), "error").when(n > 0, "done").otherwise("no_lines"), "extract_count": F.when(F.col("extract_error").isNotNull(), 0).otherwise(n), "extracted_at": F.lit(as_of).cast("timestamp")}).drop("n_lines")


def split_by_presence(rows: DataFrame, catalog: DataFrame, path: str, second: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(present, missing): rows whose file is in the catalogue, the second path being tried where the first is not.

    present has the path found as found_path.
    """
    names = catalog.select(F.col("path").alias("__p")).distinct()
    out = rows.join(names, F.col(path) == F.col("__p"), "left").withColumnRenamed("__p", "found_path")
    if second:
        out = out.join(names, F.col(second) == F.col("__p"), "left").withColumn("found_path", F.coalesce("found_path", "__p")).drop("__p")
    return out.filter("found_path is not null"), out.filter("found_path is null").drop("found_path")


def without_children(items: DataFrame, lines: DataFrame, key: str = "id", parent: str = "label_item_id") -> DataFrame:
    return items.join(lines.select(F.col(parent).alias(key)), key, "left_anti")


def audit(items: DataFrame, lines: DataFrame, max_text: int = 12) -> DataFrame:
    """(table, rule, key): rows that break a domain, a length, uniqueness or a parent's existence."""
    tell = lambda df, table, rule, key: df.select(F.lit(table).alias("table"), F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))
    bad = lambda c, *ok: ~F.coalesce(F.col(c).isin(*ok), F.lit(False))
    parts = [
        tell(items.filter(bad("status", "labeled", "no_mrz", "error")), "items", "status", "id"),
        tell(items.filter(bad("review_status", "pending", "approved", "rejected")), "items", "review_status", "id"),
        tell(items.groupBy("source_key").count().filter("count > 1"), "items", "unique source_key", "source_key"),
        tell(lines.filter(bad("review_status", "pending", "approved", "rejected")), "lines", "review_status", "id"),
        tell(lines.filter(F.length("ocr_text") > max_text), "lines", "ocr_text length", "id"),
        tell(lines.groupBy("label_item_id", "line_index").count().filter("count > 1").select(F.concat_ws("/", "label_item_id", "line_index").alias("k")), "lines", "unique line", "k"),
        tell(lines.join(items.select(F.col("id").alias("label_item_id")), "label_item_id", "left_anti"), "lines", "parent", "id"),
    ]
    return reduce(DataFrame.unionByName, parts)
