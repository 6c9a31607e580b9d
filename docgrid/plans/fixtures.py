"""Input tables of the queries, derived from the given ones by SQL that Spark and DuckDB both run.

A text names other fixtures and given tables in braces.  Only this text is shared by a query and its
oracle; what the operators compute is written separately on each side.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _digit(text: str, n: int) -> str:
    """Check digit of the first n characters, as text."""
    terms = " + ".join(f"{(7, 3, 1)[i % 3]} * greatest(instr('{ALPHABET}', substr({text}, {i + 1}, 1)) - 1, 0)" for i in range(n))
    return f"cast(({terms}) % 10 as string)"


def _ymd(d: str) -> str:
    return " || ".join(f"lpad(cast({part}({d}) % 100 as string), 2, '0')" for part in ("year", "month", "day"))


FIXTURES: dict[str, str] = {
    # the truth about each document
    "mrz_docs": """
        select c_custkey as doc_id, case c_custkey % 4 when 0 then 'TD3' when 1 then 'MRV-A' when 2 then 'MRV-B' else 'TD1' end as format,
          case c_custkey % 4 when 0 then 'P<' when 3 then 'I<' else 'V<' end as document_code,
          substr(translate(n_name || '<<', '0123456789_', 'ABCDEFGHIJ<'), 1, 2) || chr(cast(65 + n_nationkey % 26 as int)) as issuing_country,
          translate(substr(c_name, 10), '0123456789', 'ABCDEFGHIJ') as surname, c_mktsegment as given_names,
          upper(substr(md5(cast(c_custkey as string)), 1, 9)) as document_number,
          date '1950-01-01' + cast(c_custkey * 37 % 18000 as int) as birth_date, date '2024-01-01' + cast(c_custkey * 11 % 3000 as int) as expiry_date,
          case c_custkey % 3 when 0 then 'M' when 1 then 'F' else '<' end as sex, c_custkey % 10 as defect
        from {customer} join {nation} on c_nationkey = n_nationkey""",
    "mrz_parts": f"""
        select *, {_digit("document_number", 9)} as dc, {_ymd("birth_date")} as b, {_ymd("expiry_date")} as e from {{mrz_docs}}""",
    "mrz_codes": f"""
        select *, {_digit("b", 6)} as bc, {_digit("e", 6)} as ec from {{mrz_parts}}""",
    "mrz_clean": f"""
        select *, document_code || issuing_country as head, surname || '<<' || given_names as names,
          document_number || dc || issuing_country || b || bc || sex || e || ec as body,
          {_digit("(document_number || dc || b || bc || e || ec || '<<<<<<<<<<<<<<<')", 39)} as composite3,
          {_digit("(document_number || dc || '<<<<<<<<<<<<<<<' || b || bc || e || ec || '<<<<<<<<<<<')", 50)} as composite1
        from {{mrz_codes}}""",
    "mrz_two": """
        select doc_id, format, defect, case when format = 'TD1' then rpad(head || document_number || dc, 30, '<') else rpad(head || names, case when format = 'MRV-B' then 36 else 44 end, '<') end as l1,
          case format when 'TD1' then rpad(b || bc || sex || e || ec || issuing_country, 29, '<') || composite1 when 'TD3' then rpad(body, 43, '<') || composite3 when 'MRV-A' then rpad(body, 44, '<') else rpad(body, 36, '<') end as l2,
          case when format = 'TD1' then rpad(names, 30, '<') end as l3
        from {mrz_clean}""",
    # what a reader saw, with defects by doc_id % 10
    "mrz_lines": """
        select doc_id, line_index, ocr_text, cast(doc_id * 7 % 40 + 60 as double) / 101 as ocr_confidence, doc_id % 29 <> 0 or line_index <> 2 as ocr_accepted, cast(doc_id % 50 + 50 as double) / 100 as detector_confidence
        from (
          select doc_id, 1 as line_index, case defect when 2 then lower(replace(l1, '<<', '«‹')) when 5 then l1 || '<<' else l1 end as ocr_text from {mrz_two}
          union all
          select doc_id, 2, case defect when 0 then translate(substr(l2, 1, 20), '058', 'OSB') || substr(l2, 21) when 1 then substr(l2, 1, 9) || '7' || substr(l2, 11)
            when 2 then replace(l2, '<<', '> <') when 4 then case when format = 'TD1' then '990230' || substr(l2, 7) else substr(l2, 1, 13) || '990230' || substr(l2, 20) end else l2 end
          from {mrz_two} where defect <> 3
          union all
          select doc_id, 3, l3 from {mrz_two} where format = 'TD1'
          union all
          select doc_id, 0, 'REPUBLIC OF EXAMPLE ' || cast(doc_id as string) from {mrz_two} where defect = 6
        ) x""",
    # lines of one document read from several cuts of the image
    "variants": """
        select doc_id, 0 as stage, 0 as position, 'fast-projection' as name, cast(null as string) as enhanced_of, l1, case doc_id % 4 when 0 then l2 when 1 then translate(l2, '0158', 'OISB') when 2 then substr(l2, 1, 9) || 'X' || substr(l2, 11) else '' end as l2, cast(doc_id % 40 + 60 as double) / 100 as ocr_confidence from {mrz_two}
        union all select doc_id, 1, 1, 'fixed-split', null, substr(l1, 1, 34), l2, cast(5e-1 as double) from {mrz_two} where doc_id % 3 = 0
        union all select doc_id, 1, 2, 'no-deskew', null, l1, substr(l2, 1, 9) || '?' || substr(l2, 11), cast(6e-1 as double) from {mrz_two} where doc_id % 5 <> 0
        union all select doc_id, 2, 0, 'fast-projection-enhanced', 'fast-projection', l1, l2, cast(7e-1 as double) from {mrz_two}
        union all select doc_id, 2, 1, 'no-deskew-enhanced', 'no-deskew', l1, l2, cast(7e-1 as double) from {mrz_two}""",
    # text boxes of an image: every document's whole text, four slices a page, and below it on the first page the lines of the document of that number
    "ocr_boxes": """
        select doc_id * 100000 as image_id, line_index as row_id, ocr_text as text, ocr_confidence as ocr_score, cast(40 + doc_id % 9 as double) as x1, cast(600 + 40 * line_index - doc_id % 5 as double) as y1,
          cast(900 - doc_id % 250 as double) as x2, cast(626 + 40 * line_index as double) as y2, 1000 as image_width, 800 as image_height, case doc_id % 8 when 1 then 90 when 2 then 180 when 3 then 270 when 4 then 45 else 0 end as angle
        from {mrz_lines} where doc_id % 7 <> 0
        union all
        select doc_id * 100000 + n div 4, cast(10 + n % 4 as int), substr(text, cast(1 + 60 * n as int), 60), case when doc_id % 11 = 0 then cast(80 as double) / 100 else cast(doc_id * n % 100 as double) / 100 end,
          cast(50 + 50 * (n % 4) as double), cast(60 + 60 * (n % 4) as double), cast(50 * (n % 4) + 350 + doc_id % 300 as double), cast(84 + 60 * (n % 4) as double), 1000, 800, 0
        from (select doc_id, text, SERIES((length(text) + 59) div 60 - 1) as n from {documents} where length(text) > 0) d""",
    "label_items": """
        select o_orderkey as id, 'scan/' || cast(o_orderkey as string) || case when o_orderkey % 9 = 0 then case o_orderkey % 4 when 0 then '__rot90' when 1 then '__rot180' when 2 then '__rot270' else '' end when o_orderkey % 50 = 1 then 'XYrot90' else '' end as source_key,
          case when o_orderkey % 10 = 9 then 'error' when o_orderkey % 10 = 8 then 'no_mrz' else 'labeled' end as status,
          case o_orderstatus when 'P' then 'pending' when 'F' then 'approved' else 'rejected' end as review_status,
          case o_orderkey % 12 when 0 then 'val' when 1 then 'test' when 2 then null else 'train' end as split,
          case when o_orderkey % 31 <> 0 then 'images/' || cast(o_orderkey as string) || '.jpg' end as image_file_name, case when o_orderkey % 37 <> 0 then 'labels/' || cast(o_orderkey as string) || '.txt' end as label_file_name,
          case when o_orderstatus = 'O' then 'review/rejected/' || cast(o_orderkey as string) || '.jpg' end as rejected_image_file_name,
          case when o_orderstatus = 'O' and o_orderkey % 37 <> 0 then 'review/rejected/' || cast(o_orderkey as string) || '.txt' end as rejected_label_file_name,
          case when o_orderkey % 23 <> 0 then cast(o_orderkey % 90 + 5 as double) end as bbox_x1, case when o_orderkey % 23 <> 0 then cast(o_orderkey % 70 + 300 as double) end as bbox_y1,
          case when o_orderkey % 23 <> 0 then cast(o_orderkey % 90 + 405 as double) end as bbox_x2, case when o_orderkey % 23 <> 0 then cast(o_orderkey % 70 + 380 as double) end as bbox_y2,
          640 as image_width, 480 as image_height, case when o_orderkey % 41 = 0 then '["broken' when o_orderkey % 43 = 0 then chr(123) || '"a": 1' || chr(125) else '["p<utoab c", "", "' || cast(o_orderkey as string) || '<<x"]' end as mrz_lines_json,
          o_totalprice / 600000 as mrz_score, cast(o_orderkey % 900 as int) as ocr_ms, o_orderdate as updated_at, o_orderkey % 5000 as fingerprint_size
        from {orders}""",
    "ocr_lines": """
        select l_orderkey * 10 + l_linenumber as id, l_orderkey as label_item_id, l_linenumber as line_index,
          case l_returnflag when 'A' then 'approved' when 'R' then 'rejected' else 'pending' end as review_status,
          case when l_suppkey % 13 = 0 then null else 'p<' || cast(l_partkey as string) || '>x' end as ocr_text, case when l_suppkey % 5 = 0 then null else 'P<' || cast(l_partkey as string) || '<X' end as normalized_text,
          case when l_suppkey % 7 = 0 then ' ' when l_suppkey % 7 = 1 then 'FINAL' || cast(l_suppkey as string) end as final_text, l_discount * 10 as ocr_score, l_tax * 10 as mrz_likeness, case l_linestatus when 'F' then 'train' else 'val' end as split
        from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) as copy from {lineitem}) x where copy = 1""",
    "decisions": """
        select event_id, ts, 'scan/' || cast(event_id * 7 % (select max(o_orderkey) + 50 from {orders}) as string) as source_key, case event_type when 'purchase' then 'approved' when 'error' then 'rejected' else event_type end as decision from {events}""",
    "line_decisions": """
        select event_id, ts, event_id * 13 % (select max(o_orderkey) + 50 from {orders}) * 10 + 1 + event_id % 3 as line_id, case event_type when 'purchase' then 'approved' when 'error' then 'rejected' else event_type end as decision, case when event_id % 4 = 0 then 'corr ' || cast(event_id as string) || '>' end as final_text
        from {events}""",
    "corrections": """
        select event_id, ts, 'scan/' || cast(event_id * 7 % (select max(o_orderkey) + 50 from {orders}) as string) as source_key, cast(event_id % 640 as double) as x1, cast(event_id % 300 as double) as y1,
          cast(event_id * 3 % 700 - 20 as double) as x2, cast(event_id % 300 + event_id % 60 as double) as y2 from {events} where event_type = 'click'""",
    "detections": """
        select image_id, angle, max(x1) as x1, max(y1) as y1, max(x2) as x2, max(y2) as y2, max(confidence) as confidence, max(width) as width, max(height) as height
        from (select l_orderkey as image_id, cast(90 * (l_linenumber % 4) as int) as angle, l_quantity as x1, l_quantity + 10 as y1, l_quantity + 200 as x2, l_quantity + 60 as y2,
          least(l_discount * 6 + l_tax * 5, 99e-2) as confidence, cast(600 as int) as width, cast(400 as int) as height from {lineitem}) x group by image_id, angle""",
    "candidates": """
        select l_orderkey as image_id, cast(l_partkey % 50 as int) as x, cast(l_suppkey % 30 as int) as y, cast(300 + l_partkey % 200 as int) as w, cast(40 + l_suppkey % 20 as int) as h,
          case when l_linenumber % 3 = 0 then 'bottom_band' else 'morphology' end as source, cast(l_partkey * 31 % 997 as double) / 1000 as score, 500 as image_width, 400 as image_height from {lineitem}""",
    "attempts": """
        select l_orderkey as image_id, l_linenumber as candidate_rank, cast(l_partkey % 4 as int) as n_lines, l_discount * 10 as ocr_score, cast(l_suppkey % 100 as double) / 100 as detector_score, cast(l_quantity as int) as latency_ms, 2 as passes,
          cast(row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_extendedprice, l_quantity) as int) as variant from {lineitem}""",
    "visa_records": """
        select o_orderkey as id, 'G' || cast(o_orderkey as string) as guid, o_orderdate as created, c_name as passport_no,
          case when o_orderkey % 6 = 0 then null when o_orderkey % 6 = 1 then '  ' when o_orderkey % 6 = 2 then 'data:image/jpeg;base64,' || repeat('QUJD', 90) when o_orderkey % 6 = 3 then repeat('QUJD', 130) when o_orderkey % 6 = 4 then 'files/p' || cast(o_orderkey as string) || '.jpg' else repeat('QU?D', 100) end as passport_image,
          case when o_orderkey % 4 = 0 then null else 'files/f' || cast(o_orderkey as string) || '.jpg' end as face_image,
          case when o_orderkey % 5 = 0 then null when o_orderkey % 5 = 1 then 'visa/' || cast(o_orderkey as string) || '.PDF' when o_orderkey % 5 = 2 then 'data:application/pdf;base64,JVBERi0xLjQ=' else 'visa/' || cast(o_orderkey as string) || '.png' end as file_evisa,
          m1.ocr_text as line_one, m2.ocr_text as line_two, case when o_orderkey % 17 = 0 then 'n/a' when o_orderkey % 5 = 0 then '0.97' else cast(80 + o_orderkey % 20 as string) || '.5' end as point_one, case when o_orderkey % 19 = 0 then null else cast(85 + o_orderkey % 15 as string) end as point_two, o_custkey as doc_id
        from {orders} join {customer} on o_custkey = c_custkey
          left join (select doc_id, ocr_text from {mrz_lines} where line_index = 1) m1 on m1.doc_id = o_custkey left join (select doc_id, ocr_text from {mrz_lines} where line_index = 2) m2 on m2.doc_id = o_custkey""",
    "dispatches": "select c_custkey as id, case when c_custkey % 2 = 0 then 'out/' || cast(c_custkey as string) || '.pdf' else 'out/x.doc' end as file_path from {customer}",
    "eval_items": """
        select o_orderkey as id, o_orderkey % 3 = 0 as is_match, case when o_orderkey % 7 = 0 then 'no region' end as error_message, o_orderkey % 5 = 0 as used_fallback, o_orderkey % 4 = 0 as loose_match from {orders}""",
    "image_items": """
        select o_orderkey as id, case o_orderkey % 3 when 0 then 'passport' when 1 then 'face' else 'other' end as label, case o_orderkey % 3 when 0 then 'FullPassportImage' when 1 then 'FaceImage' else 'FileEVisa' end as field,
          case when o_orderkey % 10 = 0 then 'test' when o_orderkey % 10 < 3 then 'val' else 'train' end as split, case when o_orderkey % 15 = 0 then 'error' else 'ok' end as status, 'images/' || cast(o_orderkey as string) || '.jpg' as file_name from {orders}""",
    "file_catalog": """
        select image_file_name as path, fingerprint_size + case when id % 17 = 0 then 1 else 0 end as length, updated_at from {label_items} where image_file_name is not null and id % 13 <> 0""",
    # a row profile of 60 values: two humps with a valley, one wide hump, or nothing
    "profile": """
        select p_partkey as img_id, cast(n.y as int) as y, cast(case when p_partkey % 11 = 0 then 0 when p_partkey % 3 = 2 then case when n.y between 8 and 50 then 100 + n.y % 7 * 5 - case when n.y between 26 and 31 then 60 else 0 end else 0 end
          when n.y between 6 + p_partkey % 5 and 20 + p_partkey % 3 or n.y between 33 and 46 + p_partkey % 14 then 90 + (n.y * 13 + p_partkey) % 17 else n.y % 4 end as double) as v
        from (select p_partkey, SERIES(59) as y from {part}) n""",
    "parts": """
        select l_orderkey as img_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as comp_id, cast(l_partkey % 500 as int) as x, cast(case when l_linenumber % 2 = 0 then 20 else 60 end + l_suppkey % 6 as int) as y,
          cast(2 + l_partkey % 44 as int) as w, cast(5 + l_suppkey % 30 as int) as h, cast(l_quantity * 4 as int) as area, 600 as image_width, 120 as image_height,
          cast(l_partkey % 500 as double) + 5 as cx, cast(case when l_linenumber % 2 = 0 then 20 else 60 end + l_suppkey % 6 as double) + cast(l_partkey % 500 as double) / 20 as cy from {lineitem}""",
    "segments": """
        select l_suppkey as img_id, cast(l_partkey % 300 as int) as sx1, cast(l_linenumber * 10 as int) as sy1, cast(l_partkey % 300 + l_quantity * 6 as int) as sx2, cast(l_linenumber * 10 + l_quantity - 20 as int) as sy2 from {lineitem}""",
    "glyphs": """
        select l_orderkey as img_id, l_linenumber as comp_id, cast(10 as int) as width, cast(20 as int) as height, cast(l_partkey % 10 as double) as local_x, cast(l_suppkey % 20 as int) as local_y from {lineitem}""",
}

#: Fixtures with long expressions are written once a session and read back, as the stored tables they stand for:
#: else each query analyses them anew, and Spark pushes its filters into them and inlines those expressions.
STORED = ("mrz_parts", "mrz_codes", "mrz_clean", "mrz_two", "mrz_lines", "variants")
#: What Spark reads in place of a text, with the same rows: slices of a text are cut in one pass over it, as substr
#: walks from the start for each of them and a row a slice would carry the whole text.
SPARK_TEXT = {
    "ocr_boxes": FIXTURES["ocr_boxes"]
    .replace("substr(text, cast(1 + 60 * n as int), 60)", "slice")
    .replace("select doc_id, text, SERIES((length(text) + 59) div 60 - 1) as n from", "select doc_id, posexplode(regexp_extract_all(text, '(?s).{1,60}', 0)) as (n, slice) from"),
}
#: Tables of few bytes whose rows make much work here: they are dealt to all tasks by key before it, else one task reads them and does it all.
DEALT = {("mrz_docs", "customer"): "c_custkey", ("profile", "part"): "p_partkey"}
_STORED: dict[tuple[str, str, str], str] = {}
_NAME = re.compile(r"\{([A-Za-z_]\w*)\}")
#: SERIES(n) in a text makes a row for each of 0..n; the only function whose name differs between the engines.
_SERIES = re.compile(r"SERIES\((.*?)\)(?= as )")


def folder(spark: SparkSession, name: str) -> str:
    """A new place below the shared folder of the session; a temporary one only in local mode, where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        root = tempfile.mkdtemp(prefix="spark-docgrid-")
    return f"{root.rstrip('/')}/docgrid/{name}-{uuid.uuid4().hex}"


def tasks(spark: SparkSession) -> int:
    """A number of tasks that Spark does not lower for small tables."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a fixture built from them."""
    if name not in FIXTURES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    known = _STORED.get((spark.sparkContext.applicationId, sf_dir, name))
    if known:
        return spark.read.parquet(known)
    text = SPARK_TEXT.get(name, FIXTURES[name])
    views = {n: f"fixture_{n}_{zlib.crc32(sf_dir.encode()):08x}" for n in set(_NAME.findall(text))}
    for n, view in list(views.items()):  # dropping a view would also drop what is kept, so they stay
        df = frame(spark, sf_dir, n)
        if (name, n) in DEALT:
            views[n] = view = f"{view}_dealt"
            df = df.repartition(tasks(spark), DEALT[name, n])
        df.createOrReplaceTempView(view)
    df = spark.sql(_SERIES.sub(r"explode(sequence(0, \1))", _NAME.sub(lambda m: views[m[1]], text)))
    return stored(spark, sf_dir, name, lambda: df) if name in STORED else df


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that is written once a session, at first use."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = folder(spark, name)
        build().write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def kept(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """Writes a middle result of one call and reads it back; nothing of it serves a later call."""

    def keep(df: DataFrame) -> DataFrame:
        path = folder(spark, "middle")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep


def oracle(sql: str) -> str:
    """DuckDB SQL with the fixtures that it names (in braces) put before it."""
    order: list[str] = []

    def need(text: str) -> None:
        for n in _NAME.findall(text):
            if n in FIXTURES and n not in order:
                need(FIXTURES[n])
                order.append(n)

    need(sql)
    plain = lambda s: _SERIES.sub(r"unnest(generate_series(0, \1))", _NAME.sub(r"\1", s)).replace(" div ", " // ")
    sql = plain(sql).strip()
    lead = "with recursive" if sql[:14].lower() == "with recursive" else "with"
    ctes = ", ".join(f"{n} as ({plain(FIXTURES[n])})" for n in order)
    if not ctes:
        return sql
    return f"{lead} {ctes}, {sql[len(lead) :].lstrip()}" if sql[:5].lower() == "with " else f"with {ctes} {sql}"
