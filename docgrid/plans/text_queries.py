"""Queries of the text functions, the parser and the geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.functions import decode, geometry, text
from docgrid.operators import parse
from docgrid.plans.fixtures import ALPHABET, frame, oracle

AS_OF = 2024
QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return f

    return put


# ---- DuckDB text of the oracles


def dnorm(x: str) -> str:
    return f"regexp_replace(translate(upper(replace({x}, 'ß', 'ss')), '«‹>', '<<<'), '[^A-Z0-9<]', '', 'g')"


def ddigit(x: str) -> str:
    return f"cast(coalesce(list_sum(list_transform(generate_series(1, length({x})), lambda i: greatest(instr('{ALPHABET}', substr({x}, i, 1)) - 1, 0) * [7, 3, 1][(i - 1) % 3 + 1])), 0) % 10 as varchar)"


def dclean(x: str) -> str:
    return f"nullif(trim(regexp_replace(replace({x}, '<', ' '), '\\s+', ' ', 'g')), '')"


def ddate(x: str) -> str:
    return f"case when regexp_full_match({x}, '[0-9]{{{{6}}}}') then try_cast(case when cast(substr({x}, 1, 2) as int) <= 34 then '20' else '19' end || substr({x}, 1, 2) || '-' || substr({x}, 3, 2) || '-' || substr({x}, 5, 2) as date) end".replace("{{", "{").replace("}}", "}")


def dlikeness(x: str) -> str:
    n = dnorm(x)
    return f"case when length({n}) = 0 then 0e0 else 45e-2 * length({n}) / greatest(1, length(replace({x}, ' ', ''))) + 30e-2 * least(1e0, length({n}) / 30) + 15e-2 * least(1e0, 4 * (length({n}) - length(replace({n}, '<', ''))) / length({n})) + 10e-2 * case when regexp_matches({n}, '[0-9]') then 1e0 else 65e-2 end end"


#: From raw(doc_id, lines, ocr, det) to parsed(doc_id, fmt, a, b, c, fields, checks, passed, n, score).
PARSE = f"""
n as (select doc_id, ocr, det, list_filter(list_transform(lines, lambda x: {dnorm("x")}), lambda x: length(x) >= 20) as ns from raw),
d as (select *, list_filter(ns, lambda x: length(x) between 27 and 33) as sm, list_filter(ns, lambda x: length(x) >= 30) as wd from n),
f as (select *, case when len(ns) >= 3 and len(sm) >= 3 then 'TD1' when len(wd) < 2 then null when greatest(length(wd[1]), length(wd[2])) <= 38 then 'MRV-B' when starts_with(wd[1], 'V') then 'MRV-A' else 'TD3' end as fmt from d),
g as (select *, case fmt when 'TD1' then 30 when 'MRV-B' then 36 else 44 end as w, case when fmt = 'TD1' then sm else wd end as own from f),
h as (select *, case when fmt is not null then rpad(own[1], w, '<') end as a, case when fmt is not null then rpad(own[2], w, '<') end as b, case when fmt = 'TD1' then rpad(own[3], 30, '<') end as c from g),
p as (select *, case when fmt = 'TD1' then substr(a, 6, 9) else substr(b, 1, 9) end as num, case when fmt = 'TD1' then substr(b, 1, 6) else substr(b, 14, 6) end as bir, case when fmt = 'TD1' then substr(b, 9, 6) else substr(b, 22, 6) end as ex,
  case when fmt = 'TD1' then substr(a, 15, 1) else substr(b, 10, 1) end as cnum, case when fmt = 'TD1' then substr(b, 7, 1) else substr(b, 20, 1) end as cbir, case when fmt = 'TD1' then substr(b, 15, 1) else substr(b, 28, 1) end as cex,
  case when fmt = 'TD1' then substr(a, 6, 25) || substr(b, 1, 7) || substr(b, 9, 7) || substr(b, 19, 11) else substr(b, 1, 10) || substr(b, 14, 7) || substr(b, 22, 22) end as comp, case when fmt = 'TD1' then substr(b, 30, 1) else substr(b, 44, 1) end as ccomp,
  case when fmt = 'TD1' then c else substr(a, 6) end as nm from h),
q as (select *, {ddigit("num")} as e1, {ddigit("bir")} as e2, {ddigit("ex")} as e3, {ddigit("comp")} as e4, instr(nm, '<<') as cut from p),
parsed as (select doc_id, ocr, det, fmt, a, b, c, own, case when fmt in ('TD1', 'TD3') then 4 else 3 end as n, cast(e1 = cnum as int) + cast(e2 = cbir as int) + cast(e3 = cex as int) + case when fmt in ('TD1', 'TD3') then cast(e4 = ccomp as int) else 0 end as passed,
  substr(a, 1, 2) as document_code, substr(a, 3, 3) as issuing_country, case when cut > 0 then {dclean("substr(nm, 1, cut - 1)")} else {dclean("nm")} end as surname, case when cut > 0 then {dclean("substr(nm, cut + 2)")} end as given_names, {dclean("num")} as document_number,
  case when fmt = 'TD1' then substr(b, 16, 3) else substr(b, 11, 3) end as nationality, {ddate("bir")} as birth_date, {dclean("case when fmt = 'TD1' then substr(b, 8, 1) else substr(b, 21, 1) end")} as sex, {ddate("ex")} as expiry_date,
  {dclean("case fmt when 'TD1' then substr(a, 16, 15) || substr(b, 19, 11) when 'TD3' then substr(b, 29, 15) else substr(b, 29) end")} as optional_data,
  'document_number:' || e1 || ':' || cnum || ';birth_date:' || e2 || ':' || cbir || ';expiry_date:' || e3 || ':' || cex || case when fmt in ('TD1', 'TD3') then ';composite:' || e4 || ':' || ccomp else '' end as checks from q)"""
RAW = """raw as (select doc_id, coalesce(list(coalesce(ocr_text, '') order by line_index) filter (where ocr_accepted), []) as lines, coalesce(avg(ocr_confidence) filter (where ocr_accepted), 0) as ocr, max(detector_confidence) as det from {mrz_lines} group by doc_id)"""
PASS = "coalesce(passed = n, false)"
SCORE = "round(45e-2 + 55e-2 * passed / n, 4)"
CONF = f"round(case when fmt is null then 45e-2 * ocr + 20e-2 * det else least(999e-3, 45e-2 * ocr + 20e-2 * det + 35e-2 * {SCORE}) end, 4)"
FIELDS = ", ".join(parse.FIELDS)


def parsed(spark, d) -> DataFrame:
    return parse.ocr_parse(frame(spark, d, "mrz_lines"), "doc_id", AS_OF)


def flat(df: DataFrame) -> DataFrame:
    checks = F.array_join(F.transform("checks", lambda x: F.concat_ws(":", x["name"], x["expected"], x["actual"])), ";")
    return df.select("doc_id", "document_type", "l1", "l2", "l3", "fields.*", checks.alias("checks"), "checks_passed")


FLAT_SQL = f"with {RAW}, {PARSE} select doc_id, fmt as document_type, a as l1, b as l2, c as l3, {FIELDS}, checks, coalesce(passed, 0) as checks_passed from parsed"


@query("T1_normalize", f"select doc_id, {dnorm('text')} as normalized from {{documents}}")
def t1(spark, d):
    return frame(spark, d, "documents").select("doc_id", text.mrz_normalize("text").alias("normalized"))


@query("T2_normalize_lines", f"select doc_id, list_filter(list(x order by line_index), lambda v: length(v) >= 20) as lines from (select doc_id, line_index, {dnorm('ocr_text')} as x from {{mrz_lines}}) t group by doc_id")
def t2(spark, d):
    lines = frame(spark, d, "mrz_lines").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_index", "ocr_text"))), lambda x: x["ocr_text"]).alias("raw"))
    return lines.select("doc_id", text.mrz_normalize_lines("raw").alias("lines"))


@query("T3_check_digit", f"select doc_id, {ddigit('document_number')} as number_digit, {ddigit('names')} as names_digit, {ddigit('body')} as body_digit from {{mrz_clean}}")
def t3(spark, d):
    return frame(spark, d, "mrz_clean").select("doc_id", *[text.mrz_check_digit(c).alias(n) for c, n in (("document_number", "number_digit"), ("names", "names_digit"), ("body", "body_digit"))])


@query("T4_check", f"select doc_id, 'document_number' as name, {ddigit('substr(l2, 1, 9)')} as expected, substr(l2, 10, 1) as actual, {ddigit('substr(l2, 1, 9)')} = substr(l2, 10, 1) as passed from {{mrz_two}}")
def t4(spark, d):
    lines = frame(spark, d, "mrz_two")
    return lines.select("doc_id", text.mrz_check("document_number", F.substring("l2", 1, 9), F.substring("l2", 10, 1)).alias("c")).select("doc_id", "c.*")


_DATES = "select doc_id, case doc_id % 6 when 0 then '990230' when 1 then 'A90101' when 2 then '341231' when 3 then '350101' when 4 then '' else b end as v from {mrz_codes}"


@query("T5_date", f"select doc_id, {ddate('v')} as value from ({_DATES}) t")
def t5(spark, d):
    df = frame(spark, d, "mrz_codes").withColumn("v", F.expr("case doc_id % 6 when 0 then '990230' when 1 then 'A90101' when 2 then '341231' when 3 then '350101' when 4 then '' else b end"))
    return df.select("doc_id", text.mrz_date("v", AS_OF).alias("value"))


@query("T6_clean", f"select doc_id, {dclean('l1')} as a, {dclean('substr(l1, 30, 3)')} as b from {{mrz_two}}")
def t6(spark, d):
    return frame(spark, d, "mrz_two").select("doc_id", text.mrz_clean("l1").alias("a"), text.mrz_clean(F.substring("l1", 30, 3)).alias("b"))


@query("T7_names", f"select doc_id, case when instr(v, '<<') > 0 then {dclean(chr(115) + 'ubstr(v, 1, instr(v, ' + chr(39) + '<<' + chr(39) + ') - 1)')} else {dclean('v')} end as surname, case when instr(v, '<<') > 0 then {dclean('substr(v, instr(v, ' + chr(39) + '<<' + chr(39) + ') + 2)')} end as given_names from (select doc_id, case when doc_id % 5 = 0 then surname else names || '<<X<' end as v from {{mrz_clean}}) t")
def t7(spark, d):
    v = F.when(F.col("doc_id") % 5 == 0, F.col("surname")).otherwise(F.concat("names", F.lit("<<X<")))
    return frame(spark, d, "mrz_clean").select("doc_id", text.mrz_names(v).alias("n")).select("doc_id", "n.*")


for _id, _fmt in (("T8_td3", "TD3"), ("T9_mrv_a", "MRV-A"), ("T10_mrv_b", "MRV-B"), ("T11_td1", "TD1")):
    query(_id, f"{FLAT_SQL} where fmt = '{_fmt}'")(lambda spark, d, fmt=_fmt: flat(parsed(spark, d)).filter(F.col("document_type") == fmt))


@query("T12_parse", FLAT_SQL)
def t12(spark, d):
    return flat(parsed(spark, d))


@query("T13_score", f"with {RAW}, {PARSE} select doc_id, coalesce(passed, 0) as checks_passed, {PASS} as checksum_pass, case when fmt is not null then {SCORE} end as format_score from parsed")
def t13(spark, d):
    return parsed(spark, d).select("doc_id", "checks_passed", "checksum_pass", "format_score")


@query("T14_confidence", f"with {RAW}, {PARSE} select doc_id, fmt is not null as found, {CONF} as confidence from parsed")
def t14(spark, d):
    return parsed(spark, d).select("doc_id", "found", "confidence")


@query("T15_full_name", f"with {RAW}, {PARSE} select doc_id, nullif(trim(coalesce(surname, '') || ' ' || coalesce(given_names, '')), '') as full_name from parsed")
def t15(spark, d):
    return parsed(spark, d).select("doc_id", text.full_name("fields.surname", "fields.given_names").alias("full_name"))


@query("T16_likeness", f"select image_id, row_id, {dlikeness('text')} as likeness from {{ocr_boxes}}")
def t16(spark, d):
    rows = parse.once(frame(spark, d, "ocr_boxes").select("image_id", "row_id", "text"), "normalized", text.mrz_normalize("text"))
    return rows.select("image_id", "row_id", text.mrz_likeness("text", "normalized").alias("likeness"))


_FIX = "translate({0}, 'OQDILZSGB', '000112568')"
_PARTS = "substr(l2, 10, 1) || substr(l2, 14, 7) || substr(l2, 22, 7) || substr(l2, 44, 1)"


@query("T17_repair", f"select doc_id, case when length(l2) >= 28 then substr(l2, 1, 9) || {_FIX.format('substr(l2, 10, 1)')} || substr(l2, 11, 3) || {_FIX.format('substr(l2, 14, 7)')} || substr(l2, 21, 1) || {_FIX.format('substr(l2, 22, 7)')} || substr(l2, 29, 15) || {_FIX.format('substr(l2, 44, 1)')} || substr(l2, 45) else l2 end as text, case when length(l2) >= 28 then length(regexp_replace({_PARTS}, '[^OQDILZSGB]', '', 'g')) else 0 end as corrections from (select doc_id, {dnorm('ocr_text')} as l2 from {{mrz_lines}} where line_index = 2) t")
def t17(spark, d):
    df = frame(spark, d, "mrz_lines").filter("line_index = 2").withColumn("l2", text.mrz_normalize("ocr_text"))
    return df.select("doc_id", text.repair_numeric("l2").alias("r")).select("doc_id", "r.*")


_RAWN = f"list_transform(lines, lambda x: {dnorm('x')})"
_TARGET = "case when len(lines) > 0 and list_max(list_transform(lines, lambda x: length(x))) <= 38 then 36 else 44 end"


@query("T18_candidate_score", f"with {RAW}, {PARSE}, t as (select raw.doc_id, lines, passed, n, fmt, raw.ocr, {_TARGET} as target from raw join parsed using (doc_id)) select doc_id, cast({PASS} as int) as pass, coalesce(passed, 0) as passed, cast(fmt is not null as int) as found, -(coalesce(list_sum(list_transform(lines[1:2], lambda x: abs(length(x) - target))), 0) + target * greatest(0, 2 - len(lines))) as fit, ocr as mean from t")
def t18(spark, d):
    return parsed(spark, d).select("doc_id", parse.candidate_score(parsed(spark, d)).alias("s")).select("doc_id", "s.*")


@query("T19_trigger", f"with {RAW}, {PARSE} select doc_id, case when len(lines) < 2 then 'missing-lines' when fmt is null then 'parse-failed' when not {PASS} then 'checksum-failed' end as fallback from raw join parsed using (doc_id)")
def t19(spark, d):
    return parsed(spark, d).select("doc_id", parse.fallback_trigger(F.size("lines"), "found", "checksum_pass").alias("fallback"))


@query("T20_ocr_parse", f"with {RAW}, {PARSE} select doc_id, len(lines) as n_lines, raw.ocr as ocr_confidence, fmt as document_type, document_number, {PASS} as checksum_pass, {CONF.replace('ocr', 'raw.ocr').replace('det', 'raw.det')} as confidence from raw join parsed using (doc_id)")
def t20(spark, d):
    return parsed(spark, d).select("doc_id", F.size("lines").alias("n_lines"), "ocr_confidence", "document_type", "fields.document_number", "checksum_pass", "confidence")


@query("T21_points", "select id, try_cast(point_one as double) as p1, case when coalesce(try_cast(point_one as double), 0) > 1 then try_cast(point_one as double) / 100 else coalesce(try_cast(point_one as double), 0) end as s1, case when coalesce(try_cast(point_two as double), 0) > 1 then try_cast(point_two as double) / 100 else coalesce(try_cast(point_two as double), 0) end as s2 from {visa_records}")
def t21(spark, d):
    return frame(spark, d, "visa_records").select("id", text.point_to_float("point_one").alias("p1"), text.point_to_score("point_one").alias("s1"), text.point_to_score("point_two").alias("s2"))


_SIGNS = ALPHABET + "<"
# a step every four components, each of 38 classes (the blank and 37 signs), wrapping at the vector's end: every component is read
_STEPS = "select vec_id, i, list_transform(generate_series(0, 37), lambda k: cast(embedding[((i - 1) * 4 + k) % len(embedding) + 1] as double)) as r from (select vec_id, embedding, unnest(generate_series(1, (len(embedding) + 3) // 4)) as i from {embeddings}) u"
_SOFT = "list_transform(r, lambda x: exp(x - list_max(r)) / list_sum(list_transform(r, lambda y: exp(y - list_max(r)))))"


def _logits(spark, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    n = F.size("embedding")
    step = lambda i: F.transform(F.sequence(F.lit(0), F.lit(len(_SIGNS))), lambda k: F.get(e, (i * 4 + k) % n))
    return frame(spark, d, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 4).cast("int")), step).alias("logits"))


@query("T22_ctc_decode", f"with s as ({_STEPS}), p as (select vec_id, i, list_position(r, list_max(r)) - 1 as k, list_max({_SOFT}) as p from s), m as (select *, lag(k) over (partition by vec_id order by i) as before from p) select vec_id, coalesce(string_agg(substr('{_SIGNS}', k, 1), '' order by i) filter (where k <> 0 and k is distinct from before), '') as text, coalesce(avg(p) filter (where k <> 0 and k is distinct from before), 0) as score from m group by vec_id")
def t22(spark, d):
    return _logits(spark, d).select("vec_id", decode.ctc_decode("logits", _SIGNS).alias("c")).select("vec_id", "c.*")


@query("T23_softmax", f"with s as ({_STEPS}), p as (select vec_id, i, case when list_min(r) >= 0 and abs(list_sum(r) - 1) <= 1e-3 then r else {_SOFT} end as p from s) select vec_id, cast(i as int) as step, cast(k as int) as class, p[k + 1] as p from p, range(38) c(k)")
def t23(spark, d):
    steps = _logits(spark, d).select("vec_id", F.posexplode("logits").alias("step", "r"))
    return steps.select("vec_id", (F.col("step") + 1).alias("step"), F.posexplode(decode.softmax("r")).alias("class", "p"))


@query("T24_json_lines", f"select id, case when json_valid(mrz_lines_json) and json_type(mrz_lines_json) = 'ARRAY' then list_filter(list_transform(cast(json(mrz_lines_json) as varchar[]), lambda x: {dnorm('x')}), lambda x: x <> '') else [] end as lines from {{label_items}}")
def t24(spark, d):
    return frame(spark, d, "label_items").select("id", text.json_lines("mrz_lines_json").alias("lines"))


@query("T25_right_angle", "select image_id, row_id, case when angle % 360 in (90, 180, 270) then angle else 0 end as one, case when angle in (90, 180, 270) then angle when row_id = 1 then 270 else 0 end as nested from {ocr_boxes}")
def t25(spark, d):
    df = frame(spark, d, "ocr_boxes")
    other = F.when(F.col("row_id") == 1, F.lit("-90.2")).otherwise(F.lit("x"))
    return df.select("image_id", "row_id", text.right_angle(F.col("angle").cast("string")).alias("one"), text.right_angle("angle", other).alias("nested"))


# ---- sources' column functions

_PAY = "case when t is null then 'none' when starts_with(lower(t), 'data:') and ok then 'data-url' when length(t) >= 300 and ok then 'base64' when length(t) >= 300 or starts_with(lower(t), 'data:') then 'invalid' else 'path' end"


@query("S8_decode_payload", f"with a as (select id, nullif(trim(passport_image), '') as t from {{visa_records}}), b as (select *, case when starts_with(lower(t), 'data:') and contains(t, ',') then split_part(t, ',', -1) else t end as body from a), c as (select *, regexp_full_match(body, '([A-Za-z0-9+/]{{4}})*([A-Za-z0-9+/]{{2}}==|[A-Za-z0-9+/]{{3}}=)?') as ok from b) select id, {_PAY} as kind, case when {_PAY} in ('data-url', 'base64') then octet_length(from_base64(body)) end as n_bytes, false as pdf from c".replace("{{", "{").replace("}}", "}").replace("{4}", "{4}"))
def s8(spark, d):
    df = frame(spark, d, "visa_records").select("id", text.decode_payload("passport_image").alias("p"))
    return df.select("id", "p.kind", F.octet_length("p.content").cast("long").alias("n_bytes"), text.is_pdf("p.content").alias("pdf"))


@query("S9_content_hash", "select doc_id, sha256(text) as content, 'doc' || doc_id || '_' || substr(sha1('in/doc' || doc_id || '.JPG'), 1, 10) || '.jpg' as name from {documents}")
def s9(spark, d):
    path = F.concat(F.lit("in/doc"), F.col("doc_id").cast("string"), F.lit(".JPG"))
    return frame(spark, d, "documents").select("doc_id", text.content_hash("text").alias("content"), text.stable_name(path).alias("name"))


@query("P9_status", "select id, case when status in ('labeled', 'no_mrz', 'error') then status else 'error' end as status, case when review_status in ('pending', 'approved', 'rejected') and id % 3 <> 0 then review_status end as review, case id % 3 when 0 then strptime(strftime(updated_at, '%Y-%m-%d'), '%Y-%m-%d') when 1 then updated_at end as stamp from {label_items}")
def p9(spark, d):
    df = frame(spark, d, "label_items")
    raw = F.expr("case id % 3 when 0 then date_format(updated_at, 'yyyy-MM-dd') when 1 then date_format(updated_at, \"yyyy-MM-dd'T'HH:mm:ss\") else 'soon' end")
    review = F.when(F.col("id") % 3 == 0, "later").otherwise(F.upper("review_status"))
    return df.select("id", text.canonical_status(F.concat(F.lit(" "), F.upper("status"))).alias("status"), text.canonical_review_status(review).alias("review"), text.parse_ts(raw).alias("stamp"))


@query("P10_paths", "select id, case when id % 2 = 0 then image_file_name else regexp_extract(image_file_name, '[^/]*$') end as relative, case when image_file_name is null then null when id % 3 = 0 then '/' || image_file_name else 'base/' || image_file_name end as resolved from {label_items}")
def p10(spark, d):
    df = frame(spark, d, "label_items")
    path = F.when(F.col("id") % 2 == 0, F.concat(F.lit("base\\"), "image_file_name")).otherwise(F.concat(F.lit("other/"), "image_file_name"))
    own = F.when(F.col("id") % 3 == 0, F.concat(F.lit("/"), "image_file_name")).otherwise(F.col("image_file_name"))
    return df.select("id", text.relative_or_name(path, "base").alias("relative"), text.resolve_under(own, "base/").alias("resolved"))


@query("P11_names", "select id, 'visa:' || id as source_key, lpad(cast(id as varchar), 8, '0') || '_line2' as stem, 'images/' || id || '__rot90.jpg' as augmented, 'scan/' || id || '__rot180.jpg' as plain from {label_items} where image_file_name is not null")
def p11(spark, d):
    df = frame(spark, d, "label_items").filter("image_file_name is not null")
    return df.select("id", text.source_key("visa", "id").alias("source_key"), text.safe_stem("id", F.lit(2)).alias("stem"), text.augmented_name("image_file_name", F.lit(90)).alias("augmented"), text.augmented_name(F.concat(F.lit("scan/"), F.col("id").cast("string")), F.lit(180)).alias("plain"))


@query("P12_bbox_columns", "select id, case when id % 4 < 2 then bbox_x1 end as x1, case when id % 4 < 2 then bbox_y1 end as y1, case when id % 4 < 2 then bbox_x2 end as x2, case when id % 4 < 2 then bbox_y2 end as y2 from {label_items}")
def p12(spark, d):
    four = F.array(*[F.col(c).cast("string") for c in ("bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2")])
    a = F.when(F.col("id") % 4 == 2, F.slice(four, 1, 3)).when(F.col("id") % 4 == 3, F.concat(F.slice(four, 1, 3), F.array(F.lit("x")))).otherwise(four)
    return frame(spark, d, "label_items").select("id", geometry.valid_bbox(a).alias("b")).select("id", "b.*")


# ---- geometry

def _b():
    return geometry.box("x1", "y1", "x2", "y2")


def _item():
    return geometry.box("bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2")


def ocr_features(spark, d) -> DataFrame:
    from docgrid.operators.selection import ocr_row_features

    df = frame(spark, d, "ocr_boxes").withColumn("polygon", geometry.box_points("x1", "y1", "x2", "y2"))
    return ocr_row_features(df.drop("x1", "y1", "x2", "y2"))


@query("G1_row_features", f"select image_id, row_id, {dnorm('text')} as normalized, {dlikeness('text')} as likeness, x1, y1, x2, y2, (y1 + y2) / 2 as y_center, (x1 + x2) / 2 as x_center, greatest(1, x2 - x1) as width, greatest(1, y2 - y1) as height, (y1 + y2) / 2 / 800 as bottom_bias, greatest(1, x2 - x1) / 1000 as width_ratio from {{ocr_boxes}} where length({dnorm('text')}) > 0")
def g1(spark, d):
    return ocr_features(spark, d).select("image_id", "row_id", "normalized", "likeness", "x1", "y1", "x2", "y2", "y_center", "x_center", "width", "height", "bottom_bias", "width_ratio")


@query("G2_union_box", "select image_id, greatest(0, min(x1) - 12) as x1, greatest(0, min(y1) - 96e-1) as y1, least(999, max(x2) + 12) as x2, least(799, max(y2) + 96e-1) as y2 from {ocr_boxes} group by image_id")
def g2(spark, d):
    u = frame(spark, d, "ocr_boxes").groupBy("image_id").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    return u.select("image_id", geometry.padded_union_box("x1", "y1", "x2", "y2", F.lit(1000), F.lit(800)).alias("b")).select("image_id", "b.*")


_LABEL = "printf('0 %.6f %.6f %.6f %.6f', (bbox_x1 + bbox_x2) / 2 / 640, (bbox_y1 + bbox_y2) / 2 / 480, (bbox_x2 - bbox_x1) / 640, (bbox_y2 - bbox_y1) / 480)"
_V = "(bbox_x1 + bbox_x2) / 1280 as xc, (bbox_y1 + bbox_y2) / 960 as yc, (bbox_x2 - bbox_x1) / 640 as w, (bbox_y2 - bbox_y1) / 480 as h"


@query("G3_bbox_to_label", f"select id, xc, yc, w, h from (select id, {_V} from {{label_items}} where bbox_x1 is not null) t")
def g3(spark, d):
    text_label = geometry.bbox_to_label(_item(), "image_width", "image_height")
    df = frame(spark, d, "label_items").filter("bbox_x1 is not null").select("id", geometry.bbox_to_center(_item(), "image_width", "image_height").alias("v"), geometry.parse_label(text_label).alias("t"))
    close = F.abs(F.col("t.xc") - F.col("v.xc")) <= 1e-6
    return df.filter(close).select("id", "v.xc", "v.yc", "v.w", "v.h")


@query("G4_parse_label", "select id, case when id % 5 = 4 then null else 0 end as class_id, case when id % 5 = 4 then null when id % 5 = 3 then 2e0 else 25e-2 end as xc, case when id % 5 = 4 then null when id % 5 = 3 then '0 1.000000 0.500000 0.125000 0.000000' else '0 0.250000 0.500000 0.125000 0.000000' end as again from {label_items}")
def g4(spark, d):
    t = F.expr("case id % 5 when 4 then '0 0.25 0.5 0.125' when 3 then '0 2 0.5 0.125 -1' else ' 0 0.25  0.5 0.125 0 ' end")
    df = frame(spark, d, "label_items").select("id", geometry.parse_label(t).alias("v"))
    return df.select("id", "v.class_id", "v.xc", geometry.format_label("v").alias("again"))


@query("G5_rotate_label", f"select id, a as angle, case a when 90 then yc when 180 then 1 - xc else 1 - yc end as rx, case a when 90 then 1 - xc when 180 then 1 - yc else xc end as ry, case a when 180 then w else h end as rw, case a when 180 then h else w end as rh from (select id, {_V} from {{label_items}} where bbox_x1 is not null) t, (values (90), (180), (270)) r(a)")
def g5(spark, d):
    v = geometry.bbox_to_center(_item(), "image_width", "image_height")
    df = frame(spark, d, "label_items").filter("bbox_x1 is not null").select("id", v.alias("v")).withColumn("angle", F.explode(F.array(F.lit(90), F.lit(180), F.lit(270))))
    return df.select("id", "angle", geometry.rotate_label("v", "angle").alias("r")).select("id", "angle", F.col("r.xc").alias("rx"), F.col("r.yc").alias("ry"), F.col("r.w").alias("rw"), F.col("r.h").alias("rh"))


@query("G6_label_to_bbox", "select id, bbox_x1 as x1, least(bbox_y1, 480) as y1, bbox_x2 as x2, least(bbox_y2, 480) as y2 from {label_items} where bbox_x1 is not null")
def g6(spark, d):
    v = geometry.bbox_to_center(_item(), "image_width", "image_height")
    df = frame(spark, d, "label_items").filter("bbox_x1 is not null").select("id", v.alias("v"), "image_width", "image_height")
    return df.select("id", geometry.label_to_bbox("v", "image_width", "image_height").alias("b")).select("id", "b.*")


_CL = "greatest(0, least({0}, {1}))"
_CLAMP = f"select event_id, {_CL.format('least(x1, x2)', 640)} as a, {_CL.format('least(y1, y2)', 480)} as b, {_CL.format('greatest(x1, x2)', 640)} as c, {_CL.format('greatest(y1, y2)', 480)} as d from {{corrections}}"


@query("G7_clamp_bbox", f"select event_id, case when ok then a end as x1, case when ok then b end as y1, case when ok then c end as x2, case when ok then d end as y2 from (select *, c - a >= 4 and d - b >= 4 as ok from ({_CLAMP}) t) u")
def g7(spark, d):
    return frame(spark, d, "corrections").select("event_id", geometry.clamp_bbox(_b(), F.lit(640), F.lit(480)).alias("b")).select("event_id", "b.*")


@query("G8_bbox_percent", 'select id, round(bbox_x1 / 640 * 100, 4) as "left", round(bbox_y1 / 480 * 100, 4) as top, round((bbox_x2 - bbox_x1) / 640 * 100, 4) as width, round((bbox_y2 - bbox_y1) / 480 * 100, 4) as height from {label_items}')
def g8(spark, d):
    return frame(spark, d, "label_items").select("id", geometry.bbox_percent(_item(), "image_width", "image_height").alias("p")).select("id", "p.*")


_PX, _PY = "greatest(2e0, abs(x2 - x1) * 5e-2)", "greatest(2e0, abs(y2 - y1) * 5e-2)"
_IN = "cast(least(greatest(round_even({0}, 0), 0), {1}) as int)"


@query("G9_crop_box", f"select event_id, {_IN.format(f'least(x1, x2) - {_PX}', 640)} as x1, {_IN.format(f'least(y1, y2) - {_PY}', 480)} as y1, {_IN.format(f'greatest(x1, x2) + {_PX}', 640)} as x2, {_IN.format(f'greatest(y1, y2) + {_PY}', 480)} as y2 from {{corrections}}")
def g9(spark, d):
    return frame(spark, d, "corrections").select("event_id", geometry.crop_box(_b(), F.lit(640), F.lit(480), 0.05).alias("b")).select("event_id", "b.*")


_R = "round(greatest(0, least({0}, {1})), 2)"
_UN = ", ".join(
    f"case angle when 90 then {_R.format(a, b)} when 180 then {_R.format(c, b)} when 270 then {_R.format(e, b)} else {_R.format(f, b)} end as {f}"
    for f, b, a, c, e in (("x1", "width", "width - y2", "width - x2", "y1"), ("y1", "height", "x1", "height - y2", "height - x2"), ("x2", "width", "width - y1", "width - x1", "y2"), ("y2", "height", "x2", "height - y1", "height - x1"))
)


@query("G10_unrotate_bbox", f"select image_id, angle, {_UN} from {{detections}}")
def g10(spark, d):
    return frame(spark, d, "detections").select("image_id", "angle", geometry.unrotate_bbox(_b(), "angle", "width", "height").alias("b")).select("image_id", "angle", "b.*")


@query("G11_unrotate_points", "select image_id, row_id, case a when 90 then greatest(0, least(999 - y1, 999)) when 180 then greatest(0, least(999 - x1, 999)) when 270 then greatest(0, least(y1, 999)) else x1 end as px, case a when 90 then greatest(0, least(x1, 799)) when 180 then greatest(0, least(799 - y1, 799)) when 270 then greatest(0, least(799 - x1, 799)) else y1 end as py, 4 as n from (select *, case when angle in (90, 180, 270) then angle else 0 end as a from {ocr_boxes}) t")
def g11(spark, d):
    pts = geometry.unrotate_points(geometry.box_points("x1", "y1", "x2", "y2"), text.right_angle("angle"), "image_width", "image_height")
    return frame(spark, d, "ocr_boxes").select("image_id", "row_id", pts.alias("p")).select("image_id", "row_id", F.get("p", F.lit(0))["x"].alias("px"), F.get("p", F.lit(0))["y"].alias("py"), F.size("p").alias("n"))


@query("G12_line_box", f"select image_id, angle, x1 + {_IN.format(f'least(x1, x2) - {_PX}', 'width')} as lx1, y1 + {_IN.format(f'least(y1, y2) - {_PY}', 'height')} as ly1 from {{detections}}")
def g12(spark, d):
    df = frame(spark, d, "detections").withColumn("crop", geometry.crop_box(_b(), "width", "height", 0.05))
    return df.select("image_id", "angle", geometry.line_box_full(_b(), "crop").alias("b")).select("image_id", "angle", F.col("b.x1").alias("lx1"), F.col("b.y1").alias("ly1"))
