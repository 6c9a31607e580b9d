"""Queries that write, read back and stream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.functions import geometry
from docgrid.operators import parse, review
from docgrid.plans.fixtures import folder, frame, tasks
from docgrid.plans.table_queries import _J5, _J6
from docgrid.plans.text_queries import AS_OF, CONF, PARSE, PASS, RAW, dnorm, query
from docgrid.sources import files
from docgrid.streaming.streams import current_decisions, decision_stream, parse_stream


#: Items of a manifest, about: their number grows with the table, so that a map and its file stay small.
MANIFEST_ITEMS = 2000


_FILES = "select doc_id // 100 as b, cast(sum(strlen(coalesce(text, '')) + 1) as bigint) as length from {documents} group by all"


def _text_files(spark, d) -> DataFrame:
    """Whole texts to be written as one file a hundred documents: they stand in for images, as the catalogue goes by name, size and time only."""
    b = F.floor(F.col("doc_id") / 100)
    return frame(spark, d, "documents").select((b % 7).alias("k"), b.alias("b"), F.coalesce("text", F.lit("")).alias("value")).repartition("b")


def _put(rows: DataFrame, root: str) -> None:
    rows.write.mode("append").partitionBy("k", "b").option("lineSep", "\n").text(root)


_folder_name = lambda: F.regexp_extract("path", r"(k=\d+/b=\d+)/[^/]*$", 1).alias("folder")


@query("S1_image_catalog", f"select 'k=' || b % 7 || '/b=' || b as folder, length from ({_FILES}) t where b % 7 <> 3")
def s1(spark, d):
    root = folder(spark, "catalog")
    _put(_text_files(spark, d), root)
    return files.image_catalog(spark, root, ("k=3",), ("txt",)).select(_folder_name(), "length")


@query("S1_catalog_increment", f"select 'k=' || b % 7 || '/b=' || b as folder, length, 'new' as state, cast(1 + b % 2 as int) as run from ({_FILES}) t")
def s1_increment(spark, d):
    """Three runs over a growing folder: each tells the files that came since the one before, the last none."""
    root, catalog = folder(spark, "growing"), folder(spark, "catalog")
    rows = _text_files(spark, d)
    _put(rows.filter("b % 2 = 0"), root)
    one = files.catalog_increment(spark, root, catalog, 1, (), ("txt",))
    _put(rows.filter("b % 2 = 1"), root)
    two, three = (files.catalog_increment(spark, root, catalog, r, (), ("txt",)) for r in (2, 3))
    return one.union(two).union(three).select(_folder_name(), "length", "state", "run")


@query("S2_read_manifest", "select source_key, status, case when id % 5 = 0 then null else review_status end as review_status, mrz_score as score, case when id % 7 = 0 then null else strptime('2024-01-02 03:04:05', '%Y-%m-%d %H:%M:%S') end as processed_at from {label_items}")
def s2(spark, d):
    path = folder(spark, "manifest")
    item = F.struct("status", F.when(F.col("id") % 5 == 0, "?").otherwise(F.col("review_status")).alias("review_status"), "split", F.col("mrz_score").alias("score"), F.when(F.col("id") % 7 == 0, "soon").otherwise("2024-01-02T03:04:05").alias("processed_at"))
    items = frame(spark, d, "label_items")
    manifests = max(1, -(-items.count() // MANIFEST_ITEMS))
    doc = items.groupBy(F.pmod(F.xxhash64("source_key"), F.lit(manifests)).alias("part")).agg(F.map_from_entries(F.collect_list(F.struct("source_key", item))).alias("items"))
    doc.select(F.lit(1).alias("version"), F.lit("x").alias("ocr_engine"), "items").write.option("maxRecordsPerFile", 1).json(path)  # a multi-line reader takes one document a file
    return files.read_manifest(spark, path).select("source_key", "status", "review_status", "score", "processed_at")


@query("S3_source_records", "select id from {visa_records} where trim(coalesce(line_one, '')) <> '' and trim(coalesce(line_two, '')) <> '' and try_cast(point_one as double) > 85 and try_cast(point_two as double) > 85 and trim(coalesce(passport_image, '')) <> ''")
def s3(spark, d):
    return files.source_records(frame(spark, d, "visa_records"), 85, "newest").select("id")


_TEXT = f"coalesce(final_text, normalized_text, {dnorm('ocr_text')})"


@query(
    "S4_export_lines",
    f"with x as (select id, split, {_TEXT} as t from {{ocr_lines}} where review_status = 'approved' and trim(coalesce({_TEXT}, '')) <> '') "
    "select 'plan' as kind, split, null as id, count(*) || '/' || sum(length(t)) as value from x group by split union all select k, split, id, t from x, (values ('jsonl'), ('csv'), ('labels')) v(k) "
    "union all select 'charset', 'all', null, c from (select unnest(string_split('ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789<', '')) as c) y",
)
def s4(spark, d):
    """Every line of every exported file, as it is read back."""
    path = folder(spark, "lines")
    plan = files.export_line_dataset(frame(spark, d, "ocr_lines"), path).select("split", F.lit(None).cast("long").alias("id"), F.concat_ws("/", F.col("n").cast("string"), F.col("characters").cast("string")).alias("value"))
    labels = spark.read.text(f"{path}/labels").select("split", F.expr("substr(value, 1, instr(value, '\t') - 1)").cast("long").alias("id"), F.expr("substr(value, instr(value, '\t') + 1)").alias("value"))
    parts = {"plan": plan, "labels": labels, "charset": spark.read.text(f"{path}/charset").select(F.lit("all").alias("split"), F.lit(None).cast("long").alias("id"), "value")}
    parts["jsonl"] = spark.read.json(f"{path}/jsonl").select("split", F.col("id").cast("long").alias("id"), F.col("text").alias("value"))
    parts["csv"] = spark.read.csv(f"{path}/csv", **files.CSV).select("split", F.col("id").cast("long").alias("id"), F.col("text").alias("value"))
    return reduce(DataFrame.unionByName, [p.select(F.lit(kind).alias("kind"), "split", "id", "value") for kind, p in parts.items()])


@query("S5_export_manifest", "select id, label, field, split from {image_items}")
def s5(spark, d):
    path = folder(spark, "images")
    files.export_image_manifest(frame(spark, d, "image_items"), path)
    return spark.read.csv(f"{path}/by_split", header=True).select(F.col("id").cast("long").alias("id"), "label", "field", "split")


@query("S6_run_log", "select source_key, case when id % 3 = 0 then 'done2' when id % 2 = 0 then 'done1' else status end as status from {label_items}")
def s6(spark, d):
    log = folder(spark, "log")
    old = frame(spark, d, "label_items").select("id", "source_key", "status", F.lit(0).alias("at"))
    a = old.filter("id % 2 = 0").withColumns({"status": F.lit("done1"), "at": F.lit(1)}).drop("id")
    b = old.filter("id % 3 = 0").withColumns({"status": F.lit("done2"), "at": F.lit(2)}).drop("id")
    files.append_run_log(spark, a, log, old.drop("id"))
    return files.append_run_log(spark, b, log, old.drop("id")).select("source_key", "status")


@query("S7_detection_labels", "select 'im' || id as name, coalesce(split, 'train') as split, 0 as class_id, bbox_x1 as x1, bbox_y1 as y1, bbox_x2 as x2, bbox_y2 as y2 from {label_items} where bbox_x1 is not null")
def s7(spark, d):
    """The boxes that the written labels stand for: whole pixels again, as six decimals hold them."""
    path = folder(spark, "labels")
    b = geometry.box("bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2")
    rows = frame(spark, d, "label_items").select(F.concat(F.lit("im"), F.col("id").cast("string")).alias("name"), "split", F.when(F.col("bbox_x1").isNotNull(), geometry.bbox_to_label(b, "image_width", "image_height")).alias("label"))
    files.write_detection_labels(rows, path)
    back = spark.read.text(path).select("split", F.split("value", "\t").alias("p")).select(F.get("p", F.lit(0)).alias("name"), "split", geometry.parse_label(F.get("p", F.lit(1))).alias("label"))
    back = back.withColumn("box", geometry.label_to_bbox("label", F.lit(640), F.lit(480)))
    return back.select("name", "split", "label.class_id", *[F.round(F.col(f"box.{c}"), 0).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("ST1_parse_stream", f"with {RAW}, {PARSE} select doc_id, fmt as document_type, {PASS} as checksum_pass, {CONF} as confidence from parsed")
def st1(spark, d):
    path = folder(spark, "stream")
    rows = frame(spark, d, "mrz_lines")
    docs = parse.collect_lines(rows, "doc_id").join(rows.groupBy("doc_id").agg(F.max("detector_confidence").alias("detector_confidence")), "doc_id")
    n = tasks(spark)  # three batches, each of many files, so that all cores have work
    docs.repartition(n).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", str(-(-n // 3))).parquet(f"{path}/in")
    q = parse_stream(stream, AS_OF).select("doc_id", "document_type", "checksum_pass", "confidence").writeStream.format("parquet").option("checkpointLocation", f"{path}/at").trigger(availableNow=True).start(f"{path}/out")
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query("ST2_decision_stream", f"select 'item' as kind, id, review_status, rejected_label_file_name as detail from ({_J5}) t union all select 'line', id, review_status, final_text from ({_J6}) t".replace("{{", "{").replace("}}", "}"))
def st2(spark, d):
    """Label and line tables after a stream of decisions, whose newest came first."""
    path = folder(spark, "decisions")

    def applied(name: str, key: str) -> DataFrame:
        rows = frame(spark, d, name)
        rows.repartitionByRange(3, F.desc("event_id")).write.parquet(f"{path}/{name}/in")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", "1").parquet(f"{path}/{name}/in")
        decision_stream(stream, key, f"{path}/{name}/out", f"{path}/{name}/at").awaitTermination()
        return current_decisions(spark, f"{path}/{name}/out", rows.schema, key)

    items = review.apply_decisions(frame(spark, d, "label_items"), applied("decisions", "source_key"))[0]
    lines = review.apply_line_decisions(frame(spark, d, "ocr_lines"), applied("line_decisions", "line_id"))
    out = items.select(F.lit("item").alias("kind"), "id", "review_status", F.col("rejected_label_file_name").alias("detail"))
    return out.union(lines.select(F.lit("line"), "id", "review_status", "final_text"))
