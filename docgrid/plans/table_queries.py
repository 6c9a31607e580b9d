"""Queries of review, store, evaluation, data sets and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from docgrid.functions import geometry
from docgrid.operators import datasets, evaluate, review, sampling, store, upkeep
from docgrid.plans.fixtures import folder, frame, kept
from docgrid.plans.text_queries import PARSE, PASS, dnorm, parsed, query

_items = lambda spark, d: frame(spark, d, "label_items")
_lines = lambda spark, d: frame(spark, d, "ocr_lines")
_FULL = "bbox_x1 is not null"
_FRAC = "cast('0x' || substr(md5('{seed}:' || {key}), 1, 8) as bigint) / 4294967296"


def frac(key: str, seed: str) -> str:
    return _FRAC.format(key=key, seed=seed)


# ---- filters


@query("P1_usable", "select id from {visa_records} where trim(coalesce(line_one, '')) <> '' and trim(coalesce(line_two, '')) <> '' and try_cast(point_one as double) > 90 and try_cast(point_two as double) > 90 and trim(coalesce(passport_image, '')) <> ''")
def p1(spark, d):
    return datasets.usable(frame(spark, d, "visa_records")).select("id")


@query("P2_has_fields", "select id, trim(coalesce(passport_image, '')) <> '' and face_image is not null as both_fields from {visa_records} where trim(coalesce(passport_image, '')) <> '' or face_image is not null")
def p2(spark, d):
    df = frame(spark, d, "visa_records").select("id", "passport_image", "face_image")
    both = datasets.has_fields(df, True).select("id", F.lit(True).alias("b"))
    return datasets.has_fields(df, False).join(both, "id", "left").select("id", F.coalesce("b", F.lit(False)).alias("both_fields"))


@query("P3_pdf_candidates", "select 'evisa' as label, 'FileEVisa' as field, id, file_evisa as payload from {visa_records} where lower(file_evisa) like '%.pdf%' or lower(file_evisa) like 'data:application/pdf%' union all select 'dispatch', 'FilePath', id, file_path from {dispatches} where lower(file_path) like '%.pdf%'")
def p3(spark, d):
    return datasets.pdf_candidates(frame(spark, d, "visa_records"), frame(spark, d, "dispatches"))


@query("P4_pending_extraction", f"select id from {{label_items}} where status = 'labeled' and review_status = 'approved' and image_file_name is not null and {_FULL} and not regexp_matches(source_key, '..rot(90|180|270)$') and id % 6 <> 0")
def p4(spark, d):
    return datasets.pending_extraction(_items(spark, d), _items(spark, d).filter("id % 6 = 0")).select("id")


@query("P5_exportable_lines", f"select id, coalesce(final_text, normalized_text, {dnorm('ocr_text')}) as text, row_number() over (order by label_item_id, line_index, id) as place from {{ocr_lines}} where review_status = 'approved' and trim(coalesce(final_text, normalized_text, {dnorm('ocr_text')}, '')) <> ''")
def p5(spark, d):
    lines = datasets.exportable_lines(_lines(spark, d))
    # the place in the order, by a stored index of it
    rows = lines.withColumn("status", F.lit("labeled")).withColumn("at", F.col("label_item_id") * 1000 + F.col("line_index"))
    return review.label_position(rows, kept(spark), "at").select("id", "text", F.col("position").alias("place"))


@query("P6_eval_filter", "select m as mode, id from {eval_items}, (values ('all'), ('match'), ('mismatch'), ('error'), ('fallback'), ('odd')) t(m) where case m when 'match' then is_match when 'mismatch' then not is_match and error_message is null when 'error' then error_message is not null when 'fallback' then used_fallback else true end")
def p6(spark, d):
    df, out = frame(spark, d, "eval_items"), None
    for m in (*evaluate.FILTERS, "odd"):
        part = evaluate.eval_filter(df, m).select(F.lit(m).alias("mode"), "id")
        out = part if out is None else out.unionByName(part)
    return out


_POS = "(select id, row_number() over (order by id) as position from {label_items} where status = 'labeled')"
_JSON = f"case when json_valid(mrz_lines_json) and json_type(mrz_lines_json) = 'ARRAY' then list_filter(list_transform(cast(json(mrz_lines_json) as varchar[]), lambda x: {dnorm('x')}), lambda x: x <> '') else [] end"


@query("P7_review_items", f"select i.id, source_key as key, 'base/' || source_key as source, coalesce(split, '') as split, round(bbox_x1 / 640 * 100, 4) as pct_left, {_JSON} as lines, mrz_score, ocr_ms, review_status, position from {{label_items}} i join {_POS} p on p.id = i.id where {_FULL}")
def p7(spark, d):
    return review.review_items(_items(spark, d), "base", kept(spark)).withColumn("pct_left", F.col("percent.left")).drop("bbox", "percent")


# ---- statistics

_CI = "count(*) filter (where {0}) as {1}"
_STATES = ", ".join(_CI.format(f"review_status = '{s}'", s) for s in review.STATES)


@query("A1_label_stats", f"select {_CI.format(chr(115) + 'tatus = ' + chr(39) + 'labeled' + chr(39), 'total')}, count(*) filter (where status = 'labeled' and review_status = 'pending') as pending, count(*) filter (where status = 'labeled' and review_status = 'approved') as approved, count(*) filter (where status = 'labeled' and review_status = 'rejected') as rejected, count(*) filter (where status = 'no_mrz') as no_mrz from {{label_items}}")
def a1(spark, d):
    return review.label_stats(_items(spark, d))


@query("A2_line_stats", f"select count(*) as total, {_STATES} from {{ocr_lines}}")
def a2(spark, d):
    return review.line_stats(_lines(spark, d))


@query("A3_group_stats", f"with g as (select label_item_id, {_STATES} from {{ocr_lines}} group by label_item_id) select count(*) as total, count(*) filter (where pending > 0) as pending, count(*) filter (where pending = 0 and rejected = 0 and approved > 0) as approved, count(*) filter (where rejected > 0) as rejected from g")
def a3(spark, d):
    return review.group_stats(_lines(spark, d))


@query("A4_eval_stats", "select count(*) as total, count(*) filter (where is_match) as matched, count(*) filter (where not is_match and error_message is null) as mismatched, count(*) filter (where error_message is not null) as errors, count(*) filter (where used_fallback) as fallback from {eval_items}")
def a4(spark, d):
    return evaluate.eval_stats(frame(spark, d, "eval_items"))


@query("A5_eval_run_totals", "select count(*) as inserted, count(*) filter (where loose_match) as matched, count(*) filter (where not loose_match) as mismatched, count(*) filter (where used_fallback) as fallback, count(*) filter (where error_message is not null) as errors from {eval_items}")
def a5(spark, d):
    return evaluate.eval_run_totals(frame(spark, d, "eval_items"))


@query("A6_manifest_counts", "select split, label, count(*) as n from {image_items} group by rollup (split, label)")
def a6(spark, d):
    return datasets.manifest_counts(frame(spark, d, "image_items"))


_PLAN = f"select id, split, angle, row_number() over (partition by split, angle order by {frac(chr(105) + 'd || ' + chr(39) + '/' + chr(39) + ' || angle', 's')}, id) as rank, n from {{label_items}}, (values (90, 'train', 300), (270, 'train', 300), (180, 'train', 100), (90, 'val', 0), (180, 'val', 0), (270, 'val', 0)) t(angle, w, n) where split = w"
_LIMITS = {90: 300, 270: 300, 180: 100}


@query("A7_plan_counts", f"select split, angle, count(*) as n from ({_PLAN}) t where n = 0 or rank <= n group by split, angle")
def a7(spark, d):
    return datasets.plan_counts(sampling.augmentation_plan(_items(spark, d), "id", "s", _LIMITS))


@query("A8_run_summary", "select case when id % 4 = 0 then 'skipped' else status end as status, count(*) as n from {label_items} group by 1")
def a8(spark, d):
    return datasets.run_summary(_items(spark, d).filter("id % 4 <> 0"), _items(spark, d).filter("id % 4 = 0"))


@query("A9_line_counts", "select label_item_id, count(*) as n_lines from {ocr_lines} group by label_item_id")
def a9(spark, d):
    return store.line_counts(_lines(spark, d))


@query("A10_label_position", "select * from " + _POS + " t")
def a10(spark, d):
    return review.label_position(_items(spark, d), kept(spark)).select("id", "position")


# ---- samples, pages


@query("W10_augmentation_plan", f"select id, split, angle, rank from ({_PLAN}) t where n = 0 or rank <= n")
def w10(spark, d):
    return sampling.augmentation_plan(_items(spark, d), "id", "s", _LIMITS).select("id", "split", "angle", "rank")


_Q = "status = 'labeled' and image_file_name is not null and label_file_name is not null"


@query("W11_paging", f"with l as (select id, {_Q} as ok, review_status = 'pending' as p from {{label_items}} where status = 'labeled') select id, coalesce(min(case when ok and p then id end) over (order by id rows between 1 following and unbounded following), (select min(id) from l where ok and p)) as next_id, max(case when ok then id end) over (order by id rows between unbounded preceding and 1 preceding) as previous_id from l")
def w11(spark, d):
    return review.neighbours(_items(spark, d), kept(spark))


_FILES = "c as (select path from {file_catalog} union select label_file_name from {label_items} where id % 19 <> 0)"


@query("W11_present_paging", f"with {_FILES}, l as (select i.id, c1.path is not null and c2.path is not null as ok, review_status = 'pending' as p from {{label_items}} i left join c c1 on c1.path = image_file_name left join c c2 on c2.path = label_file_name where status = 'labeled') select id, coalesce(min(case when ok and p then id end) over (order by id rows between 1 following and unbounded following), (select min(id) from l where ok and p)) as next_id, max(case when ok then id end) over (order by id rows between unbounded preceding and 1 preceding) as previous_id from l")
def w11e(spark, d):
    """Paging that skips items whose image or label is not in the catalogue of files."""
    catalog = frame(spark, d, "file_catalog").select("path").union(_items(spark, d).filter("id % 19 <> 0").select("label_file_name"))
    return review.neighbours(_items(spark, d), kept(spark), catalog)


@query("W11_group_paging", "with g as (select label_item_id as id, bool_or(review_status = 'pending') as p from {ocr_lines} group by 1) select id, coalesce(min(case when p then id end) over (order by id rows between 1 following and unbounded following), (select min(id) from g where p)) as next_id, lag(id) over (order by id) as previous_id from g")
def w11c(spark, d):
    return review.group_neighbours(_lines(spark, d), kept(spark))


@query("W11_next_previous_group", "select 'next' as kind, (select label_item_id from {ocr_lines} where review_status = 'pending' order by label_item_id <= 700, label_item_id limit 1) as id union all select 'previous', (select max(label_item_id) from {ocr_lines} where label_item_id < 700) union all select 'last', (select max(label_item_id) from {ocr_lines})")
def w11d(spark, d):
    one = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id")
    i = _lines(spark, d)
    return one(review.next_group(i, 700), "next").unionByName(one(review.previous_group(i, 700), "previous")).unionByName(one(review.previous_group(i, 0), "last"))


@query("W11_next_previous", f"select 'next' as kind, (select id from {{label_items}} where {_Q} and review_status = 'pending' order by id <= 700, id limit 1) as id union all select 'previous', (select max(id) from {{label_items}} where {_Q} and id < 700) union all select 'last', (select max(id) from {{label_items}} where {_Q})")
def w11b(spark, d):
    one = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id")
    i = _items(spark, d)
    return one(review.next_item(i, 700), "next").unionByName(one(review.previous_item(i, 700), "previous")).unionByName(one(review.previous_item(i, 0), "last"))


_WRONG = "not is_match and error_message is null"
_TOTALS = f"select count(*) as total, count(*) filter ({_WRONG}) as total_filtered, count(*) filter (is_match) as matched, count(*) filter ({_WRONG}) as mismatched, count(*) filter (error_message is not null) as errors, count(*) filter (used_fallback) as fallback from {{eval_items}}"


@query("W12_eval_page", f"with t as ({_TOTALS}), p as (select id from {{eval_items}} where {_WRONG} order by id desc limit 200 offset 30) select 'near' as page, t.*, (select list(id order by id desc) from p) as ids from t union all select 'beyond', t.*, [] from t")
def w12(spark, d):
    """A page, and one far beyond the end, which has the totals as well."""
    page = lambda name, offset: evaluate.eval_page(frame(spark, d, "eval_items"), "mismatch", 500, offset).withColumns({"page": F.lit(name), "ids": F.transform("items", lambda x: x["id"])}).drop("items")
    return page("near", 30).unionByName(page("beyond", 2_000_000_000))


@query("W13_ordered_limit", f"(select 'newest' as kind, id from {{visa_records}} order by created desc, id desc limit 100) union all (select 'oldest', id from {{visa_records}} order by created, id limit 100) union all (select 'random', id from {{visa_records}} order by {frac('id', '7')}, id limit 100)")
def w13(spark, d):
    v = frame(spark, d, "visa_records")
    parts = [sampling.ordered_limit(v, o, 100, "created", "id", "7").select(F.lit(o).alias("kind"), "id") for o in ("newest", "oldest", "random")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_FIRST = "select l_orderkey * 8 + l_linenumber as id, l_shipdate as shipped from {lineitem}"


@query("W13_first_rows", f"(select 'newest' as kind, id from ({_FIRST}) t order by shipped desc, id desc limit 1000) union all (select 'oldest', id from ({_FIRST}) t order by shipped, id limit 1000) union all (select 'random', id from ({_FIRST}) t order by {frac('id', '7')}, id limit 1000)")
def w13_first(spark, d):
    """The thousand first of all order lines, many of one day."""
    v = frame(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").alias("shipped"))
    parts = [sampling.ordered_limit(v, o, 1000, "shipped", "id", "7").select(F.lit(o).alias("kind"), "id") for o in ("newest", "oldest", "random")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("W14_assign_split", f"select doc_id, case when f < 5e-2 then 'test' when f < 20e-2 then 'val' else 'train' end as split from (select doc_id, {frac('doc_id', 'set')} as f from {{documents}}) t")
def w14(spark, d):
    return frame(spark, d, "documents").select("doc_id", sampling.assign_split("doc_id", 0.15, 0.05, "set").alias("split"))


# ---- store


@query("J1_unprocessed", "select path from {file_catalog} f where not exists (select 1 from {label_items} i where i.image_file_name = f.path and i.fingerprint_size = f.length and i.updated_at = f.updated_at and i.status in ('labeled', 'no_mrz'))")
def j1(spark, d):
    files = frame(spark, d, "file_catalog").withColumnRenamed("updated_at", "modified")
    manifest = _items(spark, d).select(F.col("image_file_name").alias("path"), F.col("fingerprint_size").alias("length"), F.col("updated_at").alias("modified"), "status")
    return store.unprocessed(files, manifest).select("path")


_J2 = """with u as (select id + 200 as id, mrz_score + 1 as mrz_score, case when id % 2 = 0 then null else 'rejected' end as review_status, ocr_ms as version from {label_items} where id % 3 = 0 union all select id + 200, 9e0, null, 1000 from {label_items} where id % 9 = 0), l as (select * from u qualify row_number() over (partition by id order by version desc) = 1), t as (select id, mrz_score, review_status, 0 as version from {label_items})
  select p as policy, coalesce(t.id, l.id) as id, coalesce(l.mrz_score, t.mrz_score) as mrz_score, case when l.id is null then t.review_status else case p when 'manifest' then coalesce(l.review_status, t.review_status, 'pending') when 'source' then 'approved' when 'augment' then 'pending' else l.review_status end end as review_status from t full join l on t.id = l.id, (values ('manifest'), ('source'), ('augment'), ('replace')) v(p)"""


def _updates(spark, d):
    u = _items(spark, d).filter("id % 3 = 0").selectExpr("id + 200 as id", "mrz_score + 1 as mrz_score", "case when id % 2 = 0 then null else 'rejected' end as review_status", "ocr_ms as version")
    return u.unionByName(_items(spark, d).filter("id % 9 = 0").selectExpr("id + 200 as id", "cast(9 as double) as mrz_score", "cast(null as string) as review_status", "1000 as version"))


@query("J2_upsert", _J2)
def j2(spark, d):
    t = _items(spark, d).selectExpr("id", "mrz_score", "review_status", "0 as version")
    u = _updates(spark, d)
    parts = [store.upsert(t, u, "id", "version", p).select(F.lit(p).alias("policy"), "id", "mrz_score", "review_status") for p in store.POLICIES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_J3 = "select id, label_item_id, ocr_text from {ocr_lines} where label_item_id % 5 <> 0 union all select id, label_item_id, 'NEW' from {ocr_lines} where label_item_id % 5 = 0 and line_index = 1"


@query("J3_replace_children", _J3)
def j3(spark, d):
    lines = _lines(spark, d).select("id", "label_item_id", "ocr_text")
    new = _lines(spark, d).filter("label_item_id % 5 = 0 and line_index = 1").select("id", "label_item_id", F.lit("NEW").alias("ocr_text"))
    return store.replace_children(lines, new, touched=lines.filter("label_item_id % 5 = 0"))


@query("J4_mark_parents", "select i.id, case when i.id % 17 = 0 then 'error' when n > 0 then 'done' else 'no_lines' end as extract_status, case when i.id % 17 = 0 then 0 else coalesce(n, 0) end as extract_count, case when i.id % 17 = 0 then 'bad' end as extract_error from {label_items} i left join (select label_item_id, count(*) as n from {ocr_lines} group by 1) c on c.label_item_id = i.id")
def j4(spark, d):
    errors = _items(spark, d).filter("id % 17 = 0").select("id", F.lit("bad").alias("error"))
    return store.mark_parents(_items(spark, d).select("id"), _lines(spark, d), errors, "2024-01-01").drop("extracted_at")


_LAST = "select * from (select * from {decisions} where decision in ('approved', 'rejected')) t qualify row_number() over (partition by source_key order by ts desc, event_id desc) = 1"


_J5 = f"with l as ({_LAST}) select i.id, coalesce(l.decision, review_status) as review_status, case when l.decision = 'approved' then null when l.decision = 'rejected' and image_file_name is not null then 'review/rejected/images/' || coalesce(split, 'unknown') || '/' || i.id || '.jpg' else rejected_image_file_name end as rejected_image_file_name, case when l.decision = 'approved' then null when l.decision = 'rejected' and label_file_name is not null then 'review/rejected/labels/' || coalesce(split, 'unknown') || '/' || i.id || '.txt' else rejected_label_file_name end as rejected_label_file_name, case when l.decision = 'approved' and image_file_name is null then regexp_extract(rejected_image_file_name, '[^/]*$') else image_file_name end as image_file_name, case when l.decision = 'approved' and label_file_name is null then regexp_extract(rejected_label_file_name, '[^/]*$') else label_file_name end as label_file_name, l.ts as reviewed_at, cast(coalesce(l.ts, i.updated_at) as timestamp) as updated_at from {{label_items}} i left join l on l.source_key = i.source_key"


@query("J5_apply_decisions", _J5)
def j5(spark, d):
    out, _, _ = review.apply_decisions(_items(spark, d), frame(spark, d, "decisions"))
    return out.select("id", "review_status", "rejected_image_file_name", "rejected_label_file_name", "image_file_name", "label_file_name", "reviewed_at", F.col("updated_at").cast("timestamp").alias("updated_at"))


@query("J5_history", "select 'history' as kind, d.source_key, d.event_id from {decisions} d join {label_items} i on i.source_key = d.source_key where decision in ('approved', 'rejected') union all select distinct 'unknown', source_key, -1 from {decisions} where decision in ('approved', 'rejected') and source_key not in (select source_key from {label_items})")
def j5b(spark, d):
    _, history, unknown = review.apply_decisions(_items(spark, d), frame(spark, d, "decisions"))
    return history.select(F.lit("history").alias("kind"), "source_key", "event_id").unionByName(unknown.select(F.lit("unknown").alias("kind"), "source_key", F.lit(-1).cast("long").alias("event_id")))


_J6 = f"with l as (select * from {{line_decisions}} where decision in ('approved', 'rejected') qualify row_number() over (partition by line_id order by ts desc, event_id desc) = 1) select o.id, coalesce(l.decision, review_status) as review_status, case when l.line_id is null then o.final_text else coalesce(nullif({dnorm('l.final_text')}, ''), case when l.decision = 'approved' then coalesce(nullif(normalized_text, ''), {dnorm(chr(99) + 'oalesce(ocr_text, ' + chr(39) + chr(39) + ')')}) end, o.final_text) end as final_text from {{ocr_lines}} o left join l on l.line_id = o.id"


@query("J6_line_decisions", _J6)
def j6(spark, d):
    return review.apply_line_decisions(_lines(spark, d), frame(spark, d, "line_decisions")).select("id", "review_status", "final_text")


@query("J6_refused_decisions", "select decision, count(*) as n from {line_decisions} where decision not in ('approved', 'rejected') group by decision")
def j6b(spark, d):
    return review.refused_decisions(frame(spark, d, "line_decisions"))


@query("J7_approve_rotation", "select id, case when status = 'labeled' and review_status = 'pending' and regexp_matches(source_key, '..rot90$') then 'approved' else review_status end as review_status from {label_items}")
def j7(spark, d):
    return review.approve_rotation(_items(spark, d), 90).select("id", "review_status")


_CC = "select *, greatest(0, least(x1, x2, 640)) as a, greatest(0, least(y1, y2, 480)) as b, greatest(0, least(greatest(x1, x2), 640)) as c, greatest(0, least(greatest(y1, y2), 480)) as e from {corrections}"


_J8 = f"with c as ({_CC}), l as (select * from c where c - a >= 4 and e - b >= 4 qualify row_number() over (partition by source_key order by ts desc, event_id desc) = 1) select i.id, case when l.source_key is not null then 'approved' else review_status end as review_status, coalesce(l.a, bbox_x1) as bbox_x1, coalesce(l.e, bbox_y2) as bbox_y2, case when l.source_key is not null then 'corrected_box' end as note, case when l.source_key is null then rejected_image_file_name end as rejected_image_file_name from {{label_items}} i left join l on l.source_key = i.source_key"


@query("J8_apply_corrections", _J8)
def j8(spark, d):
    out, _ = review.apply_corrections(_items(spark, d), frame(spark, d, "corrections"))
    return out.select("id", "review_status", "bbox_x1", "bbox_y2", "note", "rejected_image_file_name")


# ---- the same on stored tables: only touched partitions are read and written


def _stored_table(spark, df, key: str) -> str:
    """A new table of the session's catalogue below the shared folder."""
    path = folder(spark, "table")
    name = "docgrid_" + path[-32:]
    upkeep.create(df, name, key, path, 16, 8)
    return name


@query("J2_stored_upsert", f"select id, mrz_score, review_status from ({_J2}) x where policy = 'manifest'")
def j2b(spark, d):
    t = _stored_table(spark, _items(spark, d).selectExpr("id", "mrz_score", "review_status", "0 as version"), "id")
    upkeep.upsert(spark, t, _updates(spark, d), "id", "version", "manifest")
    return upkeep.read(spark, t).drop("version")


@query("J3_stored_children", _J3)
def j3b(spark, d):
    lines = _lines(spark, d).select("id", "label_item_id", "ocr_text")
    t = _stored_table(spark, lines, "label_item_id")
    new = _lines(spark, d).filter("label_item_id % 5 = 0 and line_index = 1").select("id", "label_item_id", F.lit("NEW").alias("ocr_text"))
    upkeep.replace_children(spark, t, new, touched=lines.filter("label_item_id % 5 = 0"))
    return upkeep.read(spark, t)


@query("J5_stored_decisions", _J5)
def j5c(spark, d):
    items = _items(spark, d).select("id", "source_key", "split", "review_status", "image_file_name", "label_file_name", "rejected_image_file_name", "rejected_label_file_name", F.col("updated_at").cast("timestamp").alias("updated_at"))
    t = _stored_table(spark, items.withColumn("reviewed_at", F.lit(None).cast("timestamp")), "source_key")
    upkeep.apply_decisions(spark, t, frame(spark, d, "decisions"))
    return upkeep.read(spark, t).drop("source_key", "split")


@query("J8_stored_corrections", _J8)
def j8b(spark, d):
    none = F.lit(None).cast("string")
    t = _stored_table(spark, _items(spark, d).withColumns({"yolo_label": none, "note": none}), "source_key")
    upkeep.apply_corrections(spark, t, frame(spark, d, "corrections"))
    return upkeep.read(spark, t).select("id", "review_status", "bbox_x1", "bbox_y2", "note", "rejected_image_file_name")


@query("J9_presence", "select i.id, case when a.path is not null then image_file_name else rejected_image_file_name end as found_path from (select *, 'images/' || (id + 1) || '.jpg' as second from {label_items}) i left join {file_catalog} a on a.path = i.image_file_name where a.path is not null union all select id, null from {label_items} where image_file_name is null or image_file_name not in (select path from {file_catalog})")
def j9(spark, d):
    present, missing = store.split_by_presence(_items(spark, d).select("id", "image_file_name", "rejected_image_file_name"), frame(spark, d, "file_catalog"), "image_file_name", "rejected_image_file_name")
    return present.select("id", "found_path").unionByName(missing.select("id", F.lit(None).cast("string").alias("found_path")))


@query("J10_evaluate", f"""with raw as (select doc_id, coalesce(list(ocr_text order by line_index) filter (where ocr_accepted), []) as lines, coalesce(avg(ocr_confidence) filter (where ocr_accepted), 0) as ocr, max(detector_confidence) as det from {{mrz_lines}} group by doc_id), {PARSE},
  s as (select v.id, {dnorm("coalesce(line_one, '')")} as a1, {dnorm("coalesce(line_two, '')")} as a2, {dnorm("coalesce(lines[1], '')")} as b1, {dnorm("coalesce(lines[2], '')")} as b2, p.* from {{visa_records}} v left join raw r on r.doc_id = v.doc_id left join parsed p on p.doc_id = v.doc_id)
  select id, a1 = b1 and a1 <> '' as one, a2 = b2 and a2 <> '' as two, a1 = b1 and a1 <> '' and a2 = b2 and a2 <> '' as is_match, a1 = b1 and a2 = b2 as loose_match, {PASS} as checksum_pass, document_number as parsed_number, nullif(trim(coalesce(surname, '') || ' ' || coalesce(given_names, '')), '') as parsed_name, case when fmt is null then 'YOLO did not find MRZ' end as error_message from s""")
def j10(spark, d):
    p = parsed(spark, d).select("doc_id", F.col("lines").alias("p_lines"), F.when(F.col("found"), F.col("fields")).alias("fields"), "checksum_pass", F.lit(False).alias("used_fallback"), F.lit(None).cast("string").alias("fallback_reason"), F.col("found").alias("region_found"), F.lit(None).cast("string").alias("error"))
    v = frame(spark, d, "visa_records").select("id", "doc_id", "line_one", "line_two")
    out = evaluate.evaluate(v, p, on="doc_id")
    return out.select("id", F.col("is_line_one_match").alias("one"), F.col("is_line_two_match").alias("two"), "is_match", "loose_match", "checksum_pass", "parsed_number", "parsed_name", "error_message")


@query("J11_assign_line_text", f"select o.id, coalesce(({_JSON})[line_index], '') as assigned, case when len({_JSON}) >= line_index then 'text_from_parent_mrz_lines_json' else 'parent_text_missing' end as note from {{ocr_lines}} o left join {{label_items}} i on i.id = o.label_item_id")
def j11(spark, d):
    return datasets.assign_line_text(_lines(spark, d), _items(spark, d), "parent").select("id", "assigned", "note")


@query("J12_without_children", "select id from {label_items} where id not in (select label_item_id from {ocr_lines})")
def j12(spark, d):
    return store.without_children(_items(spark, d).select("id"), _lines(spark, d))


@query("J13_explode_fields", "select id, 'passport' as label, passport_image as payload from {visa_records} where trim(coalesce(passport_image, '')) <> '' union all select id, 'face', face_image from {visa_records} where face_image is not null")
def j13(spark, d):
    return datasets.explode_fields(frame(spark, d, "visa_records"))


_V = "(bbox_x1 + bbox_x2) / 1280 as xc, (bbox_y1 + bbox_y2) / 960 as yc"


@query("J14_augment_labels", f"select id, angle, source_key || '__rot' || angle as new_key, case angle when 180 then 640 else 480 end as new_width, 'images/' || id || '__rot' || angle || '.jpg' as new_image, cast(floor(case angle when 90 then yc when 180 then 1 - xc else 1 - yc end * 1000 + 123e-4) as bigint) as xc from (select *, {_V} from {{label_items}} where {_FULL} and image_file_name is not null) t, (values (90), (180), (270)) a(angle)")
def j14(spark, d):
    b = geometry.box("bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2")
    plan = _items(spark, d).filter("bbox_x1 is not null and image_file_name is not null").withColumn("yolo_label", geometry.bbox_to_label(b, "image_width", "image_height")).withColumn("angle", F.explode(F.array(F.lit(90), F.lit(180), F.lit(270))))
    out = datasets.augment_labels(plan)
    return out.select("id", "angle", "new_key", "new_width", "new_image", F.floor(geometry.parse_label("new_label")["xc"] * 1000 + 0.0123).alias("xc"))


@query("J15_delete_fields", "select id, field from {image_items} where field <> 'FaceImage'")
def j15(spark, d):
    return datasets.delete_fields(frame(spark, d, "image_items"), ["FaceImage"]).select("id", "field")


@query("J16_audit", "select 'lines' as \"table\", 'ocr_text length' as rule, cast(id as varchar) as key from {ocr_lines} where length(ocr_text) > 7 union all select 'lines', 'parent', cast(id as varchar) from {ocr_lines} where label_item_id not in (select id from {label_items} where id % 3 <> 0) union all select 'lines', 'review_status', cast(id as varchar) from {ocr_lines} where review_status = 'pending' and id % 2 = 0 union all select 'lines', 'unique line', label_item_id || '/' || line_index from {ocr_lines} where id % 5 = 0 union all select 'items', 'status', cast(id as varchar) from {label_items} where id % 3 <> 0 and id % 7 = 0")
def j16(spark, d):
    items = _items(spark, d).filter("id % 3 <> 0").withColumn("status", F.expr("case when id % 7 = 0 then null else status end"))
    lines = _lines(spark, d).withColumn("review_status", F.expr("case when review_status = 'pending' and id % 2 = 0 then 'odd' else review_status end")).select("id", "label_item_id", "line_index", "review_status", "ocr_text")
    doubled = lines.unionByName(lines.filter("id % 5 = 0").withColumns({"id": F.lit(None).cast("long"), "ocr_text": F.lit(""), "review_status": F.lit("approved")}).filter("label_item_id % 3 <> 0 or true"))
    out = store.audit(items, doubled, 7)
    return out.filter(F.col("key").isNotNull())
