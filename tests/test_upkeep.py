"""Stored tables: what a change reads and rewrites; the order index over sparse, equal and missing keys."""

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docgrid.operators import order_index, review, store, upkeep

KIND = "id long, x string, review_status string, version int"


def files(path):
    return {str(f): f.stat().st_mtime_ns for f in Path(path).glob("*/*.parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    """A table of 4000 rows, one without a key and one twice, in 16 parts of 4 buckets."""
    name = "t_" + re.sub(r"\W", "_", tmp_path.name)
    df = spark.range(3998).selectExpr("id", "'a' as x", "'pending' as review_status", "0 as version").unionByName(spark.createDataFrame([(None, "n", None, 0), (7, "again", None, 0)], KIND))
    upkeep.create(df, name, "id", f"{tmp_path}/table", 16, 4)
    yield name, df, f"{tmp_path}/table"
    spark.sql(f"drop table {name}")


def test_a_small_update_writes_its_own_files_only(spark, table):
    name, df, path = table
    before = files(path)
    u = spark.createDataFrame([(5, "u", "approved", 1), (5, "w", None, 2), (90000, "new", None, 1)], KIND)
    touched = upkeep.upsert(spark, name, u, "id", "version", "manifest")
    after = files(path)
    same = [f for f in before if after.get(f) == before[f]]
    assert len(before) == 64 and len(touched) <= 2 and len(same) == 64 - 4 * len(touched)
    assert all(int(re.search(r"part_of_key=(\d+)", f)[1]) in touched for f in set(before) - set(same))
    assert rows(upkeep.read(spark, name)) == rows(store.upsert(df, u, "id", "version", "manifest"))


def test_the_stored_side_is_not_exchanged(spark, table):
    name, _, _ = table
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = store.upsert(upkeep.read(spark, name), spark.createDataFrame([(5, "u", None, 1)], KIND), "id", "version")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "FullOuter" in plan and plan.count("Exchange") == 1 and "Bucketed: true" in plan
    assert "FileScan" not in plan[plan.index("Exchange") :]  # the one exchange has the updates below it


def test_nothing_to_change_touches_nothing(spark, table):
    name, df, path = table
    before = files(path)
    for u in (spark.createDataFrame([], KIND), spark.createDataFrame([(None, "u", None, 1)], KIND)):
        assert upkeep.upsert(spark, name, u, "id", "version") == []
    assert files(path) == before and rows(upkeep.read(spark, name)) == rows(df)


def test_changes_follow_each_other(spark, table):
    name, df, _ = table
    want = df
    for k in range(3):
        u = spark.createDataFrame([(k * 11, f"u{k}", None, k + 1), (50000 + k, "n", None, 1)], KIND)
        upkeep.upsert(spark, name, u, "id", "version", "augment")
        want = store.upsert(want, u, "id", "version", "augment")
    assert rows(upkeep.read(spark, name)) == rows(want)


def test_parts_that_lose_all_rows_are_dropped_and_can_come_back(spark, tmp_path):
    name, kind = "t_emptied", "id long, label_item_id long, ocr_text string"
    df = spark.createDataFrame([(k, k // 2, "t") for k in range(12)], kind)
    upkeep.create(df, name, "label_item_id", f"{tmp_path}/lines", 64, 2)
    all_parents, none = df.select("label_item_id").filter("label_item_id < 5"), spark.createDataFrame([], kind)
    upkeep.replace_children(spark, name, none, touched=all_parents)
    assert rows(upkeep.read(spark, name)) == [(10, 5, "t"), (11, 5, "t")]
    new = spark.createDataFrame([(100, 3, "NEW")], kind)
    upkeep.replace_children(spark, name, new)
    assert rows(upkeep.read(spark, name)) == [(10, 5, "t"), (100, 3, "NEW"), (11, 5, "t")]
    spark.sql(f"drop table {name}")


def test_decisions_and_corrections_keep_what_they_do_not_name(spark, tmp_path):
    kind = "id int, source_key string, split string, review_status string, image_file_name string, label_file_name string, rejected_image_file_name string, rejected_label_file_name string, updated_at long, reviewed_at long, image_width int, image_height int, bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double, yolo_label string, note string"
    item = lambda i, at: (i, f"s{i}", "train", "pending", f"i/{i}.jpg", f"l/{i}.txt", None, None, 1, at, 640, 480, 1.0, 2.0, 30.0, 40.0, f"old{i}", "mine")
    upkeep.create(spark.createDataFrame([item(i, 9 if i == 2 else None) for i in range(6)], kind), "t_items", "source_key", f"{tmp_path}/items", 2, 2)
    d = spark.createDataFrame([("s1", "rejected", 50, 1), ("s1", "view", 60, 2), ("gone", "approved", 50, 3), (None, "approved", 50, 4)], "source_key string, decision string, ts long, event_id long")
    assert upkeep.apply_decisions(spark, "t_items", d)
    got = {r.id: r for r in upkeep.read(spark, "t_items").collect()}
    assert len(got) == 6 and (got[1].review_status, got[1].rejected_image_file_name, got[1].reviewed_at) == ("rejected", "review/rejected/images/train/1.jpg", 50)
    assert (got[2].review_status, got[2].reviewed_at) == ("pending", 9)
    c = spark.createDataFrame([("s1", 1, 70, 5.0, 5.0, 100.0, 100.0), ("s3", 2, 70, 5.0, 5.0, 6.0, 6.0)], "source_key string, event_id long, ts long, x1 double, y1 double, x2 double, y2 double")
    upkeep.apply_corrections(spark, "t_items", c)
    got = {r.id: r for r in upkeep.read(spark, "t_items").collect()}
    assert (got[1].bbox_x1, got[1].review_status, got[1].note, got[1].reviewed_at) == (5.0, "approved", "corrected_box", 50) and got[1].yolo_label != "old1"
    assert all((got[i].yolo_label, got[i].note, got[i].bbox_x1) == (f"old{i}", "mine", 1.0) for i in (0, 2, 3, 4, 5))
    spark.sql("drop table t_items")


def test_a_clashing_column_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="part_of_key"):
        upkeep.create(spark.range(1).withColumn("part_of_key", F.lit(1)), "t_clash", "id", str(tmp_path))


@pytest.mark.parametrize("per_range", [1, 3, 1000])
def test_places_and_neighbours_of_sparse_ids(spark, keep, per_range):
    rng = random.Random(4)
    ids = sorted({rng.randrange(40) for _ in range(25)} | {10**9 * k for k in range(1, 9)} | {-(10**12), 10**15})
    state = {i: (rng.random() < 0.6, rng.choice(["pending", "approved", None])) for i in ids}
    kind = "id long, status string, image_file_name string, label_file_name string, review_status string"
    given = [(i, "labeled", "i" if ok else None, "l", s) for i, (ok, s) in state.items()] + [(3 * 10**9 + 1, "error", "i", "l", "pending")]
    items = spark.createDataFrame(given, kind).repartition(5)
    assert {r.id: r.position for r in review.label_position(items, keep, rows=per_range).collect()} == {i: k + 1 for k, i in enumerate(ids)}
    ok, wait = [i for i in ids if state[i][0]], [i for i in ids if state[i] == (True, "pending")]
    want = {i: (next((j for j in wait if j > i), wait[0]), max((j for j in ok if j < i), default=None)) for i in ids}
    assert {r.id: (r.next_id, r.previous_id) for r in review.neighbours(items, keep, rows=per_range).collect()} == want
    assert review.label_position(items.limit(0), keep).count() == review.neighbours(items.limit(0), keep).count() == 0


def test_equal_and_missing_keys_have_places(spark, keep):
    df = spark.createDataFrame([(k,) for k in [None, None, 4, 4, 4, 9]], "id long").repartition(3)
    got = sorted((r.position, r.id) for r in order_index.positions(order_index.order_index(df, "id", keep, 2)).collect())
    assert got == [(1, None), (2, None), (3, 4), (4, 4), (5, 4), (6, 9)]


def test_no_window_over_all_rows(spark, keep):
    kind = "id long, status string, image_file_name string, label_file_name string, review_status string"
    items = spark.createDataFrame([(1, "labeled", "i", "l", "pending")], kind)
    for df in (review.label_position(items, keep), review.neighbours(items, keep)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert all("[__range" in line for line in plan.splitlines() if "Window" in line)


def test_files_do_not_grow_with_shuffle_partitions(spark, tmp_path):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    try:
        df = spark.range(500).selectExpr("id", "'a' as x", "cast(null as string) as review_status", "0 as version")
        upkeep.create(df, "t_files", "id", f"{tmp_path}/t", 4, 3)
        upkeep.upsert(spark, "t_files", df.withColumn("x", F.lit("b")), "id", "version")
        assert len(files(f"{tmp_path}/t")) == 12 and upkeep.read(spark, "t_files").filter("x = 'b'").count() == 500
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.sql("drop table if exists t_files")
