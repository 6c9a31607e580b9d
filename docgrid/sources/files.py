"""Reading catalogues, manifests and records; writing data sets, manifests, logs and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgrid.functions.text import canonical_review_status, canonical_status, parse_ts
from docgrid.operators.datasets import exportable_lines, manifest_counts, usable
from docgrid.operators.sampling import ordered_limit
from docgrid.operators.store import upsert

#: Image file extensions, and the blank-free character set of the lines.
EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff")
CHARSET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789<"
ITEM = T.StructType([T.StructField(n, t) for n, t in (("status", T.StringType()), ("review_status", T.StringType()), ("split", T.StringType()), ("score", T.DoubleType()), ("bbox", T.ArrayType(T.DoubleType())), ("lines", T.ArrayType(T.StringType())), ("processed_at", T.StringType()), ("error", T.StringType()))])
#: Options of CSV on both ways: quotes are doubled and blanks at the ends of a value stay.
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
MANIFEST = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("ocr_engine", T.StringType()), T.StructField("items", T.MapType(T.StringType(), ITEM))])


def image_catalog(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, length, modified) of image files below root, without excluded folder names; contents are not read.

    Files of no bytes hold no image and are left out, as Spark does not read them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    files = files.filter(F.lower("path").rlike(r"\.(" + "|".join(extensions) + ")$"))
    for name in exclude:
        files = files.filter(~F.col("path").contains(f"/{name}/"))
    return files


def catalog_increment(spark: SparkSession, root: str, catalog: str, run: int, exclude: tuple[str, ...] = (), extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Add to a stored catalogue the image files that it does not hold as they are now; returns them: path, length, modified, state, run.

    A file is known by path, length and time of change: state is "new" for a path never seen and
    "changed" for one that stands there otherwise.  Files that vanished stay in the catalogue.  Each run
    is one partition, overwritten when the same run is repeated, so a run that failed may be started
    again; a run without news adds nothing and gives no rows.
    """
    found = image_catalog(spark, root, exclude, extensions)
    known = spark.createDataFrame([], "path string, length long, modified timestamp, state string, run int")
    where = spark._jvm.org.apache.hadoop.fs.Path(catalog)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        known = spark.read.schema(known.schema).parquet(catalog)
    last = known.filter(F.col("run") != run).groupBy("path").agg(F.max_by(F.struct("length", "modified"), "run").alias("seen"))
    fresh = found.join(last, "path", "left").filter(F.col("seen").isNull() | (F.col("seen") != F.struct("length", "modified")))
    fresh = fresh.select("path", "length", "modified", F.when(F.col("seen").isNull(), "new").otherwise("changed").alias("state"))
    target = f"{catalog}/run={run}"
    fresh.write.mode("overwrite").parquet(target)
    return spark.read.schema(fresh.schema).parquet(target).withColumn("run", F.lit(run))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per item of processed manifests (JSON maps by key), with canonical states and a timestamp."""
    df = spark.read.schema(MANIFEST).option("multiLine", "true").json(path).select("version", "ocr_engine", F.explode("items").alias("source_key", "i")).select("version", "ocr_engine", "source_key", "i.*")
    return df.withColumns({"status": canonical_status("status"), "review_status": canonical_review_status("review_status"), "processed_at": parse_ts("processed_at")})


def source_records(df: DataFrame, min_point: float = 90, order_by: str = "newest", limit: int = 0, seed: str = "0") -> DataFrame:
    """Usable visa records, ordered and limited; over JDBC the predicates on plain columns are pushed to the store."""
    return ordered_limit(usable(df, min_point), order_by, limit, "created", "id", seed)


def export_line_dataset(lines: DataFrame, path: str, preserve_split: bool = True, dry_run: bool = False) -> DataFrame:
    """Approved lines as JSON lines, CSV, label texts and the charset below path; returns the plan (split, n, characters).

    A dry run writes nothing.
    """
    df = exportable_lines(lines).select("id", "label_item_id", "line_index", F.coalesce("split", F.lit("train")).alias("split"), "text")
    counted = lambda df: df.groupBy("split").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("characters"))
    if dry_run:
        return counted(df)
    part = ["split"] if preserve_split else []
    df.write.partitionBy(*part).json(f"{path}/jsonl")
    df = df.sparkSession.read.schema(df.schema).json(f"{path}/jsonl")  # selected and sorted once
    plan = counted(df)
    for kind, out in (("csv", df), ("labels", df.select("split", F.concat_ws("\t", F.col("id").cast("string"), "text").alias("value")))):
        out = out if preserve_split or kind != "labels" else out.drop("split")
        writer = out.write.partitionBy(*part)
        {"csv": lambda p, w=writer: w.csv(p, **CSV), "labels": writer.text}[kind](f"{path}/{kind}")
    df.sparkSession.createDataFrame([(c,) for c in CHARSET], "value string").coalesce(1).write.text(f"{path}/charset")
    return plan


def export_image_manifest(df: DataFrame, path: str) -> DataFrame:
    """The manifest as a whole and by split, ordered by split, label, id and field; returns the counts."""
    order = ["split", "label", "id", "field"]
    df.orderBy(*order).write.csv(f"{path}/all", **CSV)
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("split").csv(f"{path}/by_split", **CSV)
    return manifest_counts(df)


def append_run_log(spark: SparkSession, items: DataFrame, log: str, old: DataFrame, key: str = "source_key", order: str = "at") -> DataFrame:
    """Append processed items to a JSON-lines log and merge the whole log into a manifest: the last entry of a key counts."""
    items.write.mode("append").json(log)
    return upsert(old, spark.read.schema(items.schema).json(log), key, order)


def write_detection_labels(df: DataFrame, path: str) -> None:
    """One line per labelled image, 'name<TAB>label', by split."""
    rows = df.filter("label is not null").select(F.coalesce("split", F.lit("train")).alias("split"), F.concat_ws("\t", "name", "label").alias("value"))
    rows.write.partitionBy("split").text(path)
