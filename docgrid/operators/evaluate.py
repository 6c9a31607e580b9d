"""Predictions against stored truth: per-line matches, statistics and report pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrid.functions.text import full_name, mrz_normalize

_COUNTED = {"match": "matched", "mismatch": "mismatched", "error": "errors", "fallback": "fallback"}
FILTERS = ("all", "match", "mismatch", "error", "fallback")


def _match(mode: str) -> Column:
    """Predicate of a filter; an unknown one keeps all."""
    failed = F.col("error_message").isNotNull()
    return {"match": F.col("is_match"), "mismatch": ~F.col("is_match") & ~failed, "error": failed, "fallback": F.col("used_fallback")}.get(mode, F.lit(True))


def eval_filter(df: DataFrame, mode: str) -> DataFrame:
    return df.filter(_match(mode))


def eval_stats(df: DataFrame) -> DataFrame:
    """All counts in one scan; errors are not mismatches here."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(_match(m)).alias(n) for m, n in _COUNTED.items()])


def eval_run_totals(df: DataFrame, matched: str = "loose_match") -> DataFrame:
    """Totals of a run: whatever does not match, errors included, is a mismatch."""
    return df.agg(F.count("*").alias("inserted"), F.count_if(F.col(matched)).alias("matched"), F.count_if(~F.col(matched)).alias("mismatched"), F.count_if("used_fallback").alias("fallback"), F.count_if(F.col("error_message").isNotNull()).alias("errors"))


def eval_page(df: DataFrame, mode: str, limit: int = 50, offset: int = 0, key: str = "id") -> DataFrame:
    """One row: the filtered total, the statistics of all rows, and the page as an array, newest first.

    limit within 1..200, offset from 0; a page beyond the end is an empty array and keeps its totals.
    """
    own = eval_filter(df, mode)
    totals = df.agg(F.count("*").alias("total"), F.count_if(_match(mode)).alias("total_filtered"), *[F.count_if(_match(m)).alias(n) for m, n in _COUNTED.items()])
    page = own.orderBy(F.desc(key)).offset(max(0, offset)).limit(min(200, max(1, limit or 50)))
    items = page.agg(F.reverse(F.array_sort(F.collect_list(F.struct(key, *[c for c in df.columns if c != key])))).alias("items"))
    return totals.crossJoin(F.broadcast(items))  # one row each


def evaluate(source: DataFrame, predictions: DataFrame, key: str = "id", on: str | None = None) -> DataFrame:
    """Truth lines against predicted ones, exact after normalising, with parsed fields and an error rule.

    source: key, line_one, line_two.  predictions: key, p_lines, fields, checksum_pass, used_fallback,
    fallback_reason, region_found, error.  An empty truth line never matches; loose_match lets it.
    Where predictions belong to something that several keys share, ``on`` names that column of both.
    """
    t = lambda c: F.coalesce(mrz_normalize(c), F.lit(""))
    df = source.join(predictions, on or key, "left").withColumns({"source_one": t("line_one"), "source_two": t("line_two"), "predicted_one": t(F.get("p_lines", F.lit(0))), "predicted_two": t(F.get("p_lines", F.lit(1)))})
    same = lambda a, b: F.col(a) == F.col(b)
    one, two = same("source_one", "predicted_one") & (F.col("source_one") != ""), same("source_two", "predicted_two") & (F.col("source_two") != "")
    error = F.coalesce(F.nullif("error", F.lit("")), F.when(~F.coalesce("region_found", F.lit(False)), "YOLO did not find MRZ"))
    return df.select(key, "source_one", "source_two", F.nullif("predicted_one", F.lit("")).alias("predicted_one"), F.nullif("predicted_two", F.lit("")).alias("predicted_two"), one.alias("is_line_one_match"), two.alias("is_line_two_match"), (one & two).alias("is_match"), (same("source_one", "predicted_one") & same("source_two", "predicted_two")).alias("loose_match"), F.coalesce("checksum_pass", F.lit(False)).alias("checksum_pass"), F.col("fields.document_number").alias("parsed_number"), full_name("fields.surname", "fields.given_names").alias("parsed_name"), F.coalesce("used_fallback", F.lit(False)).alias("used_fallback"), "fallback_reason", error.alias("error_message"))
