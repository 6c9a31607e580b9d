"""Bulk parsing of MRZ lines: format dispatch, fields, checks and confidence, all as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrid.functions.base import C, col
from docgrid.functions.text import mrz_check, mrz_clean, mrz_date, mrz_names, mrz_normalize_lines, repair_numeric

#: Widths of a line by format.
WIDTHS = {"TD3": 44, "MRV-A": 44, "MRV-B": 36, "TD1": 30}
FIELDS = ("document_code", "issuing_country", "surname", "given_names", "document_number", "nationality", "birth_date", "sex", "expiry_date", "optional_data")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that costs too much to be computed again for every use of it.

    Spark does not move expressions or filters below an explode, so the value is made once a row.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def mrz_dispatch(lines: C) -> Column:
    """struct(format, l1, l2, l3) from normalised lines, or null.

    Three lines of 27 to 33 characters (among at least three lines) make TD1.  Else the first two of 30
    or more: up to 38 characters MRV-B, longer ones MRV-A when the first starts with V, TD3 otherwise.
    """
    a = col(lines)
    small = F.filter(a, lambda x: F.length(x).between(27, 33))
    wide = F.filter(a, lambda x: F.length(x) >= 30)
    td1 = (F.size(a) >= 3) & (F.size(small) >= 3)
    short = F.greatest(F.length(F.get(wide, F.lit(0))), F.length(F.get(wide, F.lit(1)))) <= 38
    fmt = F.when(td1, "TD1").when(F.size(wide) < 2, None).when(short, "MRV-B").when(F.startswith(F.get(wide, F.lit(0)), F.lit("V")), "MRV-A").otherwise("TD3")
    own = F.when(td1, small).otherwise(wide)
    pick = lambda i: F.get(own, F.lit(i))
    return F.when(fmt.isNotNull(), F.struct(fmt.alias("format"), pick(0).alias("l1"), pick(1).alias("l2"), F.when(td1, pick(2)).alias("l3")))


def _fit(c: Column, fmt: Column) -> Column:
    width = F.when(fmt == "TD1", WIDTHS["TD1"]).when(fmt == "MRV-B", WIDTHS["MRV-B"]).otherwise(44)
    return F.rpad(c, width, F.lit("<"))


def parse_lines(df: DataFrame, fmt: str, l1: str, l2: str, l3: str, as_of_year: int) -> DataFrame:
    """Adds fields, checks, checks_passed, checksum_pass and format_score for lines of a known format."""
    f, td1 = F.col(fmt), F.col(fmt) == "TD1"
    df = df.withColumns({l1: _fit(F.col(l1), f), l2: _fit(F.col(l2), f), l3: F.when(td1, _fit(F.col(l3), f))})
    a, b, c = F.col(l1), F.col(l2), F.col(l3)
    at = lambda x, s, e: F.substring(x, s + 1, e - s)
    either = lambda x, y: F.when(td1, x).otherwise(y)
    number, birth, expiry = either(at(a, 5, 14), at(b, 0, 9)), either(at(b, 0, 6), at(b, 13, 19)), either(at(b, 8, 14), at(b, 21, 27))
    df = df.withColumn("__n", mrz_names(either(c, F.substring(a, 6, 44))))
    composite = either(F.concat(at(a, 5, 30), at(b, 0, 7), at(b, 8, 15), at(b, 18, 29)), F.concat(at(b, 0, 10), at(b, 13, 20), at(b, 21, 43)))
    item = lambda name, payload, actual: F.struct(F.lit(name).alias("name"), payload.alias("payload"), actual.alias("actual"))
    items = F.array(item("document_number", number, either(at(a, 14, 15), at(b, 9, 10))), item("birth_date", birth, either(at(b, 6, 7), at(b, 19, 20))), item("expiry_date", expiry, either(at(b, 14, 15), at(b, 27, 28))))
    last = F.array(item("composite", composite, either(at(b, 29, 30), at(b, 43, 44))))
    items = F.when(f.isin("TD1", "TD3"), F.concat(items, last)).otherwise(items)
    fields = F.struct(
        at(a, 0, 2).alias("document_code"), at(a, 2, 5).alias("issuing_country"), F.col("__n.surname").alias("surname"), F.col("__n.given_names").alias("given_names"), mrz_clean(number).alias("document_number"),
        either(at(b, 15, 18), at(b, 10, 13)).alias("nationality"), mrz_date(birth, as_of_year).alias("birth_date"), mrz_clean(either(at(b, 7, 8), at(b, 20, 21))).alias("sex"), mrz_date(expiry, as_of_year).alias("expiry_date"),
        mrz_clean(F.when(td1, F.concat(at(a, 15, 30), at(b, 18, 29))).when(f == "TD3", at(b, 28, 43)).otherwise(at(b, 28, 44))).alias("optional_data"),
    )
    known = f.isNotNull()
    df = df.withColumns({"fields": F.when(known, fields), "checks": F.when(known, F.transform(items, lambda x: mrz_check(x["name"], x["payload"], x["actual"])))}).drop("__n")
    return mrz_score(df)


def mrz_score(df: DataFrame, checks: str = "checks") -> DataFrame:
    """Adds checks_passed, checksum_pass and format_score; without checks 0, false and null."""
    c = F.col(checks)
    passed = F.coalesce(F.size(F.filter(c, lambda x: x["passed"])), F.lit(0))
    return df.withColumn("checks_passed", F.when(c.isNull(), 0).otherwise(passed)).withColumns({
        "checksum_pass": F.coalesce(F.forall(c, lambda x: x["passed"]), F.lit(False)),
        "format_score": F.when(c.isNotNull(), F.round(0.45 + 0.55 * F.col("checks_passed") / F.greatest(F.lit(1), F.size(c)), 4)),
    })


def parse_mrz(df: DataFrame, lines_col: str, as_of_year: int) -> DataFrame:
    """Parse a table with a column of raw lines: adds found, document_type, l1..l3, fields, checks and scores.

    Null or too few lines give found = false and null parts.
    """
    df = once(df, "__a", mrz_normalize_lines(F.coalesce(F.col(lines_col), F.array().cast("array<string>"))))
    df = once(df, "__d", mrz_dispatch("__a")).drop("__a")
    df = df.withColumns({"found": F.col("__d").isNotNull(), "document_type": F.col("__d.format"), "l1": F.col("__d.l1"), "l2": F.col("__d.l2"), "l3": F.col("__d.l3")}).drop("__d")
    return parse_lines(df, "document_type", "l1", "l2", "l3", as_of_year)


def mrz_confidence(found: C, ocr: C, detector: C, format_score: C) -> Column:
    base = 0.45 * col(ocr) + 0.20 * col(detector)
    return F.round(F.when(col(found), F.least(F.lit(0.999), base + 0.35 * col(format_score))).otherwise(base), 4)


def collect_lines(rows: DataFrame, key: str, index: str = "line_index", text: str = "ocr_text", score: str = "ocr_confidence", accepted: str = "ocr_accepted") -> DataFrame:
    """One row per key: accepted lines in order and their mean confidence (0 without any)."""
    own = F.col(accepted)
    return rows.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.when(own, F.struct(index, F.coalesce(text, F.lit("")).alias("t"))))), lambda x: x["t"]).alias("lines"),
        F.coalesce(F.avg(F.when(own, F.col(score))), F.lit(0.0)).alias("ocr_confidence"),
    )


def ocr_parse(rows: DataFrame, key: str, as_of_year: int, detector: str = "detector_confidence") -> DataFrame:
    """Collect the accepted lines of each key, parse them and fuse the confidences."""
    lines = collect_lines(rows, key).join(rows.groupBy(key).agg(F.max(detector).alias(detector)), key)
    out = parse_mrz(lines, "lines", as_of_year)
    return out.withColumn("confidence", mrz_confidence("found", "ocr_confidence", detector, "format_score"))


def candidate_score(df: DataFrame, lines: str = "lines") -> Column:
    """Ordered struct: checksum passes, checks passed, found, minus length error, mean confidence."""
    a = F.col(lines)
    target = F.when((F.size(a) > 0) & (F.array_max(F.transform(a, lambda x: F.length(x))) <= 38), 36).otherwise(44)
    first = F.slice(a, 1, 2)
    error = F.aggregate(first, F.lit(0), lambda s, x: s + F.abs(F.length(x) - target)) + F.when(F.size(first) < 2, target * (2 - F.size(first))).otherwise(0)
    return F.struct(F.col("checksum_pass").cast("int").alias("pass"), F.col("checks_passed").alias("passed"), F.col("found").cast("int").alias("found"), (-error).alias("fit"), F.col("ocr_confidence").alias("mean"))


def fallback_trigger(n_lines: C, found: C, checksum_pass: C) -> Column:
    return F.when(F.coalesce(col(n_lines), F.lit(0)) < 2, "missing-lines").when(~col(found), "parse-failed").when(~col(checksum_pass), "checksum-failed")


def repair_lines(df: DataFrame, lines: str = "lines") -> DataFrame:
    """Adds repaired (the lines with the second one repaired) and corrections."""
    a = F.col(lines)
    fix = repair_numeric(F.get(a, F.lit(1)), F.size(a))
    df = df.withColumn("__r", fix)
    return df.withColumns({"repaired": F.transform(a, lambda x, i: F.when(i == 1, F.col("__r.text")).otherwise(x)), "corrections": F.coalesce(F.col("__r.corrections"), F.lit(0))}).drop("__r")


def compact_payload(df: DataFrame, key: str) -> DataFrame:
    """The read payload of each key with defaults, scores rounded to six places, and an error by precedence.

    df: key, found, document_type, checksum_pass, confidence, detector_confidence, ocr_confidence,
    line_rows array<struct<line_index, text, confidence, accepted>>, ocr_error, crop_error, region_found.
    """
    six = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)), 6).alias(c)
    rows = F.transform(F.coalesce("line_rows", F.array().cast(df.schema["line_rows"].dataType)), lambda x, i: F.struct(F.coalesce(F.nullif(x["line_index"], F.lit(0)), i + 1).alias("line_index"), F.coalesce(x["text"], F.lit("")).alias("text"), F.round(F.coalesce(x["confidence"], F.lit(0.0)), 6).alias("confidence"), F.coalesce(x["accepted"], F.lit(False)).alias("accepted")))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    error = F.coalesce(blank("ocr_error"), blank("crop_error"), F.when(~F.coalesce("region_found", F.lit(False)), "MRZ region was not detected"))
    return df.select(key, F.coalesce("found", F.lit(False)).alias("found"), "document_type", F.coalesce("checksum_pass", F.lit(False)).alias("checksum_pass"), six("confidence"), six("detector_confidence"), six("ocr_confidence"), rows.alias("lines"), error.alias("error"))
