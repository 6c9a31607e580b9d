"""First rows of large and tied tables, and catalogues that grow."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from docgrid.operators import sampling
from docgrid.sources import files

DAY = datetime.date(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    """60,000 rows, a third of them of one day, some without a day or a key."""
    n = F.col("id")
    day = F.when(n % 3 == 0, F.lit(40)).when(n % 1000 == 1, F.lit(None)).otherwise(n * 7919 % 700)
    key = F.when(n % 5000 == 2, F.lit(None)).otherwise(n * 31 % 60000)
    return spark.range(60000).select(F.date_add(F.lit(DAY), day.cast("int")).alias("created"), key.alias("key"), F.lit("x").alias("v"), F.lit(1).alias("n"))


def brute(table, order_by, n):
    low = datetime.date.min
    if order_by == "random":
        raise ValueError(order_by)
    by = lambda r: (r.created or low, -1 if r.key is None else r.key)
    return [(r.created, r.key) for r in sorted(table, key=by, reverse=order_by == "newest")[:n]]


@pytest.mark.parametrize("order_by", ["newest", "oldest"])
@pytest.mark.parametrize("n", [1, 37, 1000, 5000, 70000])
def test_first_rows_are_those_of_a_full_sort(rows, order_by, n):
    got = [(r.created, r.key) for r in sampling.ordered_limit(rows, order_by, n, "created", "key").collect()]
    assert got == brute(rows.collect(), order_by, n)


def test_hash_order_is_that_of_a_full_sort(rows):
    want = rows.filter("key is not null").withColumn("f", sampling.fraction("key", "s")).orderBy("f", "key").limit(500).select("key").collect()
    assert sampling.ordered_limit(rows.filter("key is not null"), "random", 500, "created", "key", "s").select("key").collect() == want


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz"])
def test_few_rows_reach_the_sort(rows, kind):
    """Nine tenths of all rows are of the newest day: the key cuts among them."""
    hot = rows.withColumn("created", F.when(F.col("key") % 10 > 0, F.lit(datetime.date(2030, 1, 1))).otherwise(F.col("created")).cast(kind))
    levels = [F.bitwise_not(sampling._moment(hot, c)) for c in ("created", "key")]
    kept = hot.filter(sampling.cut_off(hot, levels, 100)).count()
    assert 100 <= kept <= 400 + sampling.SKETCH
    got = [r.key for r in sampling.ordered_limit(hot, "newest", 100, "created", "key").collect()]
    assert got == sorted((r.key for r in hot.filter("key % 10 > 0").collect()), reverse=True)[:100]


def test_rows_equal_in_every_level_stay(spark):
    same = spark.range(30000).select(F.lit(DAY).alias("created"), F.lit(1).alias("key"))
    assert sampling.ordered_limit(same, "oldest", 10, "created", "key").count() == 10
    assert sampling.ordered_limit(same.filter("key > 1"), "oldest", 10, "created", "key").count() == 0


def test_text_orders_are_left_to_the_sort(spark):
    t = spark.createDataFrame([("b", "x"), ("a", "y"), (None, "z"), ("b", "w")], "created string, key string")
    assert [r.key for r in sampling.ordered_limit(t, "newest", 2, "created", "key").collect()] == ["x", "w"]


def test_a_catalogue_tells_new_and_changed_files(spark, tmp_path):
    root, catalog = tmp_path / "in", str(tmp_path / "catalog")
    (root / "skip").mkdir(parents=True)

    def put(name, text, at):
        (root / name).write_text(text)
        os.utime(root / name, (at, at))

    def run(n):
        return sorted((r.path.rsplit("/", 1)[1], r.length, r.state) for r in files.catalog_increment(spark, str(root), catalog, n, ("skip",)).collect())

    put("a.jpg", "one", 1000), put("b.PNG", "1", 1000), put("empty.jpg", "", 1000), put("c.txt", "no image", 1000), put("skip/d.jpg", "x", 1000)
    assert run(1) == [("a.jpg", 3, "new"), ("b.PNG", 1, "new")]
    assert run(1) == [("a.jpg", 3, "new"), ("b.PNG", 1, "new")]  # a repeated run is the same run
    assert run(2) == []
    put("a.jpg", "two", 2000), put("e.tif", "12345", 500)
    assert run(3) == [("a.jpg", 3, "changed"), ("e.tif", 5, "new")]
    (root / "b.PNG").unlink()
    assert run(4) == []
    assert spark.read.parquet(catalog).count() == 4


def test_csv_keeps_blanks_and_quotes(spark, tmp_path):
    odd = [' a ', 'say "x"', "back\\slash", "a,b", "\\\"", "line"]
    t = spark.createDataFrame([(i, 1, 0, "train", "approved", v, None, v) for i, v in enumerate(odd)], "id long, label_item_id long, line_index int, split string, review_status string, final_text string, normalized_text string, ocr_text string")
    files.export_line_dataset(t, str(tmp_path / "out"))
    got = spark.read.csv(str(tmp_path / "out/csv"), **files.CSV).select("id", "text").collect()
    assert {int(r.id): r.text for r in got} == dict(enumerate(odd))
