"""Column functions on MRZ text: cleaning, check digits, dates, names, scores, paths, payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docgrid.functions.base import C, col

#: Fixed values of the domain: check-digit weights, and digits that letters are mistaken for.
WEIGHTS = (7, 3, 1)
LOOKALIKES = {"O": "0", "Q": "0", "D": "0", "I": "1", "L": "1", "Z": "2", "S": "5", "G": "6", "B": "8"}
#: 0-based places of the second line that hold digits, from and to (exclusive).
NUMERIC_RUNS = ((9, 10), (13, 20), (21, 28), (43, 44))
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII that counts as zero in a check digit.
_OTHER = "".join(c for c in map(chr, range(128)) if not c.isdigit() and c not in _LETTERS)
#: What normalising drops in its one pass: ASCII, and the signs beyond it that European texts use (Latin, Greek, Cyrillic, punctuation, currency).
_BEYOND = "".join(map(chr, (*range(0x80, 0x250), *range(0x370, 0x530), *range(0x2000, 0x2070), *range(0x20A0, 0x20D0))))
_DROPPED = "".join(c for c in map(chr, range(128)) if not c.isalnum() and c not in "<>") + "".join(c for c in _BEYOND if c not in "«‹")


def mrz_normalize(c: C) -> Column:
    """Upper case, look-alike fillers to '<', and nothing but A-Z, 0-9 and '<'; null stays null.

    The pass that puts the fillers drops what European texts have besides, so only where it leaves more than ASCII (rare
    signs) the costly pattern is needed.  The pass is made once a row.
    """
    ours = F.translate(F.upper(col(c)), "«‹>" + _DROPPED, "<<<")
    return F.transform(F.array(ours), lambda x: F.when(F.octet_length(x) == F.length(x), x).otherwise(F.regexp_replace(x, "[^A-Z0-9<]+", "")))[0]


def mrz_normalize_lines(lines: C, least: int = 20) -> Column:
    return F.filter(F.transform(col(lines), mrz_normalize), lambda x: F.length(x) >= least)


def mrz_check_digit(c: C) -> Column:
    """Check digit as text.  Only values modulo ten matter, so letters become their last digit first."""
    c = col(c)
    ours = F.translate(c, _LETTERS + _OTHER, "".join(str((10 + i) % 10) for i in range(26)) + "0" * len(_OTHER))
    digits = F.when(F.octet_length(c) == F.length(c), ours).otherwise(F.regexp_replace(ours, "[^0-9]", "0"))
    weight = F.array(*map(F.lit, WEIGHTS))
    terms = F.transform(F.filter(F.split(digits, ""), lambda x: x != ""), lambda x, i: x.cast("int") * F.get(weight, i % 3))
    return (F.aggregate(terms, F.lit(0), lambda a, b: a + b) % 10).cast("string")


def mrz_check(name: C | str, payload: C, actual: C) -> Column:
    expected = mrz_check_digit(payload)
    return F.struct(F.lit(name).alias("name"), expected.alias("expected"), col(actual).alias("actual"), (col(actual) == expected).alias("passed"))


def mrz_date(c: C, as_of_year: int) -> Column:
    """YYMMDD to a date; years up to ten after as_of are of this century.  Anything else is null."""
    c = col(c)
    century = F.when(F.substring(c, 1, 2).cast("int") <= as_of_year % 100 + 10, "20").otherwise("19")
    return F.when(c.rlike("^[0-9]{6}$"), F.try_to_date(F.when(c.rlike("^[0-9]{6}$"), F.concat(century, c)), "yyyyMMdd"))


def mrz_clean(c: C) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.translate(col(c), "<", " "), r"\s+", " ")), F.lit(""))


def mrz_names(c: C) -> Column:
    """surname and given_names: before and after the first '<<'."""
    c = col(c)
    at = F.instr(c, "<<")
    return F.struct(mrz_clean(F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(c)).alias("surname"), mrz_clean(F.when(at > 0, F.substring(c, at + 2, F.length(c)))).alias("given_names"))


def full_name(surname: C, given: C) -> Column:
    part = lambda c: F.nullif(F.trim(col(c)), F.lit(""))
    return F.nullif(F.concat_ws(" ", part(surname), part(given)), F.lit(""))


def mrz_likeness(c: C, normalized: C | None = None) -> Column:
    """How much a raw text looks like an MRZ line, from charset, length, filler and digit shares.

    ``normalized`` is the normalised text where a table has it; else it is made once a row.
    """
    raw = col(c)
    if normalized is None:
        return F.transform(F.array(mrz_normalize(raw)), lambda n: mrz_likeness(raw, n))[0]
    text = col(normalized)
    n = F.length(text)
    fill = n - F.length(F.replace(text, F.lit("<"), F.lit("")))
    share = n / F.greatest(F.lit(1), F.length(F.replace(raw, F.lit(" "), F.lit(""))))
    digits = text.rlike("[0-9]")
    score = 0.45 * share + 0.30 * F.least(F.lit(1.0), n / 30) + 0.15 * F.least(F.lit(1.0), fill / F.greatest(F.lit(1), n) * 4) + 0.10 * F.when(digits, 1.0).otherwise(0.65)
    return F.when(n > 0, score).otherwise(0.0)


def repair_numeric(line_two: C, n_lines: C | int = 2) -> Column:
    """struct(text, corrections): digits put for look-alike letters where the second line must have digits.

    Lines shorter than 28, and documents of fewer than two lines, stay as they are.
    """
    c = col(line_two)
    go = (F.length(c) >= 28) & (col(n_lines) >= 2)
    src, dst = "".join(LOOKALIKES), "".join(LOOKALIKES.values())
    cut = lambda a, b: F.substring(c, a + 1, b - a)
    ends = (0, *(b for _, b in NUMERIC_RUNS))
    fixed = F.concat(*(x for (a, b), end in zip(NUMERIC_RUNS, ends) for x in (cut(end, a), F.translate(cut(a, b), src, dst))), cut(ends[-1], 1 << 30))
    picked = F.concat(*(cut(a, b) for a, b in NUMERIC_RUNS))
    count = F.length(picked) - F.length(F.translate(picked, src, ""))
    return F.struct(F.when(go, fixed).otherwise(c).alias("text"), F.when(go, count).otherwise(F.lit(0)).alias("corrections"))


def point_to_float(c: C) -> Column:
    return col(c).try_cast("double")


def point_to_score(c: C) -> Column:
    """A percent or a fraction as a fraction; text that is no number gives 0."""
    p = F.coalesce(point_to_float(c), F.lit(0.0))
    return F.when(p > 1, p / 100).otherwise(p)


def json_lines(c: C) -> Column:
    """A JSON list of texts as normalised, non-empty lines; bad JSON and other values give none."""
    c = col(c)
    parsed = F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>"))
    return F.filter(F.transform(F.coalesce(parsed, F.array().cast("array<string>")), lambda x: mrz_normalize(F.coalesce(x, F.lit("")))), lambda x: x != "")


def right_angle(*cs: C) -> Column:
    """The first of the values that is 90, 180 or 270 after rounding (modulo 360), else 0."""
    out = []
    for c in cs:
        a = F.pmod(F.rint(col(c).try_cast("double")), F.lit(360.0)).try_cast("int")
        out.append(F.when(a.isin(90, 180, 270), a))
    return F.coalesce(*out, F.lit(0))


def canonical_status(c: C) -> Column:
    s = F.lower(F.trim(col(c)))
    return F.when(s.isin("labeled", "no_mrz", "error"), s).otherwise("error")


def canonical_review_status(c: C) -> Column:
    s = F.lower(F.trim(col(c)))
    return F.when(s.isin("pending", "approved", "rejected"), s)


def parse_ts(c: C) -> Column:
    c = F.trim(col(c))
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")))


def base_name(c: C) -> Column:
    return F.regexp_extract(col(c), r"([^/]*)$", 1)


def relative_or_name(c: C, base: str) -> Column:
    """The path below base, else its last part; back-slashes become slashes."""
    p, base = F.translate(col(c), "\\", "/"), base.rstrip("/") + "/"
    return F.when(F.startswith(p, F.lit(base)), F.substring(p, len(base) + 1, 1 << 20)).otherwise(base_name(p))


def resolve_under(c: C, base: str) -> Column:
    """Absolute paths as they are, others below base; null and blank give null."""
    p = F.nullif(F.trim(F.translate(col(c), "\\", "/")), F.lit(""))
    return F.when(F.startswith(p, F.lit("/")) | p.rlike("^[A-Za-z]:/"), p).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), p))


def source_key(prefix: str, ident: C) -> Column:
    return F.concat(F.lit(prefix + ":"), col(ident).cast("string"))


def safe_stem(ident: C, index: C, width: int = 8) -> Column:
    return F.concat(F.lpad(col(ident).cast("string"), width, "0"), F.lit("_line"), col(index).cast("string"))


def augmented_name(path: C, angle: C) -> Column:
    """stem__rotN.ext; a name without an extension gets .jpg."""
    p = col(path)
    ext = F.regexp_extract(base_name(p), r"(\.[^.]*)$", 1)
    return F.concat(F.substring(p, F.lit(1), F.length(p) - F.length(ext)), F.lit("__rot"), col(angle).cast("string"), F.when(ext == "", ".jpg").otherwise(ext))


def content_hash(c: C) -> Column:
    return F.sha2(col(c).cast("binary"), 256)


def stable_name(path: C) -> Column:
    """stem_<ten hex digits of sha1(path)>.ext"""
    p = col(path)
    ext = F.regexp_extract(base_name(p), r"(\.[^.]*)$", 1)
    stem = F.regexp_replace(base_name(p), r"\.[^.]*$", "")
    return F.concat(stem, F.lit("_"), F.substring(F.sha1(p.cast("binary")), 1, 10), F.lower(ext))


def decode_payload(c: C, least: int = 300) -> Column:
    """struct(kind, content): data-url, base64 (strict, at least ``least`` characters), path, or none.

    The alphabet and padding are checked before decoding, as Spark's decoder is lenient.
    """
    t = F.nullif(F.trim(col(c)), F.lit(""))
    body = F.when(F.startswith(F.lower(t), F.lit("data:")) & t.contains(","), F.substring_index(t, ",", -1)).otherwise(t)
    strict = body.rlike("^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    kind = F.when(t.isNull(), "none").when(F.startswith(F.lower(t), F.lit("data:")) & strict, "data-url").when((F.length(t) >= least) & strict, "base64").when((F.length(t) >= least) | F.startswith(F.lower(t), F.lit("data:")), "invalid").otherwise("path")
    return F.struct(kind.alias("kind"), F.when(kind.isin("data-url", "base64"), F.try_to_binary(F.when(strict, body), F.lit("base64"))).alias("content"))


def is_pdf(content: C) -> Column:
    return F.coalesce(F.startswith(F.hex(col(content)), F.lit("25504446")), F.lit(False))
