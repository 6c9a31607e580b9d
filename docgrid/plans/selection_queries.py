"""Queries of the selection operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from docgrid.operators import parse, selection
from docgrid.plans.fixtures import frame
from docgrid.plans.text_queries import _FIX, _PARTS, _TARGET, AS_OF, PARSE, PASS, dlikeness, dnorm, ocr_features, parsed, query

_ROWS = f"r as (select image_id, row_id, {dnorm('text')} as line, ocr_score as s, ocr_score + {dlikeness('text')} as q, {dlikeness('text')} as lk, y1 as y from {{ocr_boxes}}), a as (select *, row_number() over (partition by image_id order by length(line) desc, round(q, 9) desc, row_id) as rk from r where length(line) >= 12 and round(lk, 9) >= 48e-2)"


@query("W1_choose_lines", f"""with {_ROWS}, o as (select a.*, prio, target, count(*) over (partition by image_id, prio) as n, row_number() over (partition by image_id, prio order by rk) as rn from a, (values (0, 44), (1, 36), (2, 30), (3, 0)) t(prio, target) where target = 0 or abs(length(line) - target) <= 10),
  g as (select image_id, prio, avg(q) as mean, avg(s) as s, list(line order by y, rk) as lines from o where rn <= 3 and (target = 0 or n >= 2) group by image_id, prio)
  select image_id, lines, least(1, greatest(0, s)) as ocr_score from g qualify row_number() over (partition by image_id order by prio = 3, round(mean, 9) desc, prio) = 1""")
def w1(spark, d):
    return selection.choose_lines(frame(spark, d, "ocr_boxes"), "image_id", "row_id", y="y1")


@query("W2_top_candidates", """with a as (select *, row_number() over (partition by image_id, source order by score desc, x, y, w, h) as r from {candidates}), b as (select distinct image_id, x, y, w, h, source, max(score) over (partition by image_id, x, y, w, h, source) as score from a where source <> 'morphology' or r <= 3)
  select *, row_number() over (partition by image_id order by score desc, x, y, w, h, source) as rank from b qualify rank <= 4""")
def w2(spark, d):
    return selection.top_candidates(frame(spark, d, "candidates").drop("image_width", "image_height"), "image_id")


_GOOD = "n_lines >= 2 and ocr_score >= 82e-2 and detector_score >= 65e-2"


@query("W3_best_attempt", f"""with a as (select *, coalesce(max(case when {_GOOD} then 1 else 0 end) over (partition by image_id, variant order by candidate_rank rows between unbounded preceding and 1 preceding), 0) as done from {{attempts}}), b as (select *, sum(latency_ms) over w as lat, sum(passes) over w as pas, count(*) over w as ev, row_number() over (partition by image_id, variant order by n_lines desc, ocr_score + detector_score desc, candidate_rank) as r from a where done = 0 window w as (partition by image_id, variant))
  select image_id || '/' || variant as image, candidate_rank, n_lines, ocr_score, detector_score, lat as latency_ms, pas as passes, ev as evaluated from b where r = 1""")
def w3(spark, d):
    """Every variant of an image is a row of attempts of its own."""
    return selection.best_attempt(frame(spark, d, "attempts").withColumn("image", F.concat_ws("/", "image_id", "variant")), "image")


@query("W4_best_variant", """with recursive v as (select image_id, candidate_rank, variant, n_lines, ocr_score from {attempts}), w(image_id, candidate_rank, i, variant, n_lines, ocr_score) as (
    select distinct image_id, candidate_rank, 0, cast(null as int), 0, 0e0 from v
    union all select w.image_id, w.candidate_rank, i + 1, case when v.n_lines >= w.n_lines and v.ocr_score >= w.ocr_score then v.variant else w.variant end, case when v.n_lines >= w.n_lines and v.ocr_score >= w.ocr_score then v.n_lines else w.n_lines end, case when v.n_lines >= w.n_lines and v.ocr_score >= w.ocr_score then v.ocr_score else w.ocr_score end
    from w join v on v.image_id = w.image_id and v.candidate_rank = w.candidate_rank and v.variant = w.i + 1)
  select image_id, candidate_rank, variant, n_lines, ocr_score, i as passes from w qualify row_number() over (partition by image_id, candidate_rank order by i desc) = 1""")
def w4(spark, d):
    return selection.best_variant(frame(spark, d, "attempts"), ["image_id", "candidate_rank"])


@query("W5_best_rotation", "select image_id, angle, confidence, coalesce(zero < 85e-2, true) as tried_rotations from (select *, max(case when angle = 0 then confidence end) over (partition by image_id) as zero from {detections}) t where angle = 0 or coalesce(zero, 0) < 85e-2 qualify row_number() over (partition by image_id order by confidence desc, angle) = 1")
def w5(spark, d):
    return selection.best_rotation(frame(spark, d, "detections"), "image_id").select("image_id", "angle", "confidence", "tried_rotations")


def _group(like: str, length: int) -> str:
    return f"""f as (select image_id, row_id, {dnorm('text')} as nm, {dlikeness('text')} as lk, ocr_score, x1, y1, x2, y2, (y1 + y2) / 2 as yc, greatest(1, y2 - y1) as hh from {{ocr_boxes}}),
  c as (select *, row_number() over (partition by image_id order by yc, row_id) as start, ocr_score * 30e-2 + lk * 45e-2 + least(1, length(nm) / 36) * 25e-2 as q from f where length(nm) >= {length} and lk >= {like} and greatest(1, x2 - x1) / 1000 >= 25e-2),
  u as (select a.image_id, n, a.start, count(*) as k, avg(b.q) as q, avg(b.hh) as h, min(b.x1) as x1, min(b.y1) as y1, max(b.x2) as x2, max(b.y2) as y2 from c a join (values (2), (3)) t(n) on true join c b on b.image_id = a.image_id and b.start between a.start and a.start + n - 1 group by a.image_id, n, a.start having count(*) = n),
  best as (select image_id, n, start, x1, y1, x2, y2, q + (x2 - x1) / 1000 * 20e-2 + (y1 + y2) / 2 / 800 * 18e-2 - greatest(0, (y2 - y1) / greatest(1, h) - n * 26e-1) * 8e-2 as score from u qualify row_number() over (partition by image_id order by round(score, 9) desc, n, start) = 1)"""


@query("W6_mrz_group", f"with {_group('48e-2', 24)} select * from best")
def w6(spark, d):
    return selection.find_mrz_group(ocr_features(spark, d), "image_id", "row_id").drop("image_width", "image_height")


@query("W7_line_rows", f"""with {_group('35e-2', 20)}, p as (select c.image_id, case when n is not null then 1 else 2 end as tier, row_id, c.start, nm from c left join best using (image_id) where case when n is not null then c.start between best.start and best.start + n - 1 else c.start <= 3 end)
  select image_id, coalesce(tier, 3) as tier, case when tier is not null then row_number() over (partition by image_id order by p.start) end as line_index, row_id, nm as normalized from (select distinct image_id from {{ocr_boxes}} where length({dnorm('text')}) > 0) k left join p using (image_id)""")
def w7(spark, d):
    return selection.select_line_rows(ocr_features(spark, d), "image_id", "row_id")


@query("W8_best_line_text", f"select image_id, nm as text, ocr_score from (select image_id, row_id, {dnorm('text')} as nm, ocr_score from {{ocr_boxes}}) t where nm <> '' qualify row_number() over (partition by image_id order by {dlikeness('nm')} desc, length(nm) desc, ocr_score desc, row_id) = 1")
def w8(spark, d):
    return selection.best_line_text(frame(spark, d, "ocr_boxes"), ["image_id"], "row_id")


def _variants(spark, d):
    lines = F.filter(F.array("l1", "l2"), lambda x: x != "")
    return frame(spark, d, "variants").select("doc_id", "stage", "position", "name", "enhanced_of", lines.alias("lines"), "ocr_confidence", F.lit(0.8).alias("detector_confidence"))


_REPAIRED = f"substr(l2, 1, 9) || {_FIX.format('substr(l2, 10, 1)')} || substr(l2, 11, 3) || {_FIX.format('substr(l2, 14, 7)')} || substr(l2, 21, 1) || {_FIX.format('substr(l2, 22, 7)')} || substr(l2, 29, 15) || {_FIX.format('substr(l2, 44, 1)')} || substr(l2, 45)"


@query("W9_resolve_variants", f"""with v as (select doc_id, stage, position, name, enhanced_of, list_filter([l1, l2], lambda x: x <> '') as lines, ocr_confidence from {{variants}}),
  u as (select *, coalesce(lines[2], '') as l2 from v where stage <> 1 or len(lines) >= 2 qualify stage <> 1 or row_number() over (partition by doc_id, stage order by position) <= 4),
  w as (select *, case when length(l2) >= 28 then length(regexp_replace({_PARTS}, '[^OQDILZSGB]', '', 'g')) else 0 end as corrections from u),
  o as materialized (select row_number() over (order by doc_id, stage, position, fix) as cid, * from (select * exclude (l2, corrections), 0 as corrections, 0 as fix from w union all by name select * exclude (l2, corrections, lines), [lines[1], {_REPAIRED}] as lines, corrections, 1 as fix from w where corrections > 0)),
  raw as (select cid as doc_id, lines, ocr_confidence as ocr, 0.8 as det from o), {PARSE},
  s as materialized (select o.*, fmt, {PASS} as ok, case when len(lines) < 2 then 'missing-lines' when fmt is null then 'parse-failed' when not {PASS} then 'checksum-failed' end as trigger,
    row(cast({PASS} as int), coalesce(passed, 0), cast(fmt is not null as int), -(coalesce(list_sum(list_transform(lines[1:2], lambda x: abs(length(x) - {_TARGET}))), 0) + {_TARGET} * greatest(0, 2 - len(lines))), ocr_confidence) as score from o join parsed on parsed.doc_id = o.cid),
  fx as (select x.* replace (case when x.stage = 0 then 'checksum-text-correction' else x.name || '-text-correction' end as name) from s x join s y on x.doc_id = y.doc_id and x.stage = y.stage and x.position = y.position and x.fix = 1 and y.fix = 0 where x.ok and y.trigger is not null and x.score > y.score),
  b as (select * from (select * from s where fix = 0 union all select * from fx) t qualify row_number() over (partition by doc_id, stage, position order by fix desc) = 1),
  t as (select doc_id, nullif(coalesce(max(case when stage = 0 then coalesce(trigger, '') end), 'missing-lines'), '') as trigger from s where fix = 0 group by doc_id),
  e as (select * from (select *, coalesce(max(case when stage = 0 then ok end) over (partition by doc_id), false) as base from b) z where stage = 0 or (stage = 1 and not base) qualify row_number() over (partition by doc_id order by score desc, stage, position) = 1),
  late as (select b.* from e join b on b.doc_id = e.doc_id and b.stage = 2 and not e.ok and b.enhanced_of = e.name and b.score > e.score qualify row_number() over (partition by b.doc_id order by b.position desc) = 1)
  select e.doc_id, coalesce(l.name, e.name) as selected_variant, coalesce(l.lines, e.lines) as lines, coalesce(l.fmt, e.fmt) as document_type, coalesce(l.ok, e.ok) as checksum_pass, coalesce(l.corrections, e.corrections) as corrections, t.trigger, coalesce(l.name, e.name) <> 'fast-projection' as used_fallback
  from e left join late l on l.doc_id = e.doc_id join t on t.doc_id = e.doc_id""")
def w9(spark, d):
    return selection.resolve_variants(_variants(spark, d), "doc_id", AS_OF)


@query("P8_compact_payload", f"""with s as (select doc_id, list({{'line_index': line_index, 'text': ocr_text, 'confidence': round(ocr_confidence, 6), 'accepted': ocr_accepted}} order by line_index) as rows, raw_n from (select *, 0 as raw_n from {{mrz_lines}}) t group by doc_id, raw_n),
  raw as (select doc_id, coalesce(list(ocr_text order by line_index) filter (where ocr_accepted), []) as lines, coalesce(avg(ocr_confidence) filter (where ocr_accepted), 0) as ocr, max(detector_confidence) as det from {{mrz_lines}} group by doc_id), {PARSE}
  select doc_id, fmt is not null as found, fmt as document_type, {PASS} as checksum_pass, round(det, 6) as detector_confidence, round(ocr, 6) as ocr_confidence, list_transform(rows, lambda x: coalesce(nullif(x.line_index, 0), 1) || ':' || x.text || ':' || x.accepted) as lines,
    case when fmt is null then 'OCR lines could not be parsed as MRZ' when doc_id % 5 = 0 then 'crop' when doc_id % 7 = 0 then 'MRZ region was not detected' end as error from parsed join s using (doc_id)""".replace("{{'", "{'").replace("}}", "}"))
def p8(spark, d):
    rows = frame(spark, d, "mrz_lines").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_index", F.col("ocr_text").alias("text"), F.col("ocr_confidence").alias("confidence"), F.col("ocr_accepted").alias("accepted")))).alias("line_rows"))
    df = parsed(spark, d).join(rows, "doc_id").withColumns({"ocr_error": F.when(~F.col("found"), "OCR lines could not be parsed as MRZ"), "crop_error": F.expr("case when doc_id % 5 = 0 then 'crop' else '' end"), "region_found": F.expr("case when doc_id % 7 = 0 then null else true end")})
    out = parse.compact_payload(df, "doc_id").drop("confidence")
    return out.withColumn("lines", F.transform("lines", lambda x: F.concat_ws(":", x["line_index"].cast("string"), x["text"], x["accepted"].cast("string"))))
