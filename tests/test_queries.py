"""Every query of the library's own operators against its SQL, and properties of the operators."""

import datetime
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docgrid.functions import geometry, text
from docgrid.operators import parse, review, sampling, store
from docgrid.plans import io_queries, registry
from docgrid.plans.fixtures import frame


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(name, spark, duck, sf_dir, same):
    same(registry.QUERIES[name](spark, sf_dir), duck, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(name, spark, sf_dir):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark, sf_dir):
    rows = registry.entry(spark, sf_dir).collect()
    assert {r.document_type for r in rows} >= {"TD3", "MRV-A", "MRV-B", "TD1"}


def test_parser_returns_what_was_encoded(spark, sf_dir):
    """Documents without a defect come back as the generator made them."""
    truth = frame(spark, sf_dir, "mrz_docs").filter("defect >= 7 and doc_id % 29 <> 0").collect()
    got = {r.doc_id: r for r in registry.parsed(spark, sf_dir).collect()}
    assert len(truth) > 20
    for t in truth:
        r, f = got[t.doc_id], got[t.doc_id].fields
        assert (r.document_type, r.checksum_pass, f.document_number, f.surname, f.given_names) == (t.format, True, t.document_number, t.surname, t.given_names)
        assert f.sex == (None if t.sex == "<" else t.sex) and f.expiry_date == t.expiry_date
        assert f.birth_date.strftime("%m%d") == t.birth_date.strftime("%m%d")


def column(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f("v").alias("x")).first()[0]


@pytest.mark.parametrize("value, want", [("990230", None), ("340101", datetime.date(2034, 1, 1)), ("350101", datetime.date(1935, 1, 1)), ("ab0101", None), ("", None), (None, None)])
def test_dates(spark, value, want):
    assert column(spark, value, lambda c: text.mrz_date(c, 2024)) == want


def test_normalising_twice_changes_nothing(spark, sf_dir):
    n = text.mrz_normalize("text")
    assert frame(spark, sf_dir, "documents").filter(text.mrz_normalize(n) != n).count() == 0


def test_a_changed_character_flips_its_check(spark):
    df = spark.createDataFrame([("L898902C3", "L898902C4"), ("A<<<<<<<<", "K<<<<<<<<")], "a string, b string").select(text.mrz_check_digit("a").alias("a"), text.mrz_check_digit("b").alias("b"))
    rows = df.collect()
    assert rows[0].a == "6" and rows[0].a != rows[0].b
    assert rows[1].a == rows[1].b  # values that differ by ten weigh the same


def test_four_quarter_turns_are_none(spark):
    label = "0 0.200000 0.300000 0.100000 0.050000"
    now = label
    for _ in range(4):
        turned = geometry.rotate_label(geometry.parse_label("v"), F.lit(90))
        now = spark.createDataFrame([(now,)], "v string").select(turned.alias("r")).select(geometry.format_label("r")).first()[0]
    assert now == label


def test_upsert_twice_is_once(spark):
    t = spark.createDataFrame([(1, "a", "pending", 0), (2, "b", None, 0)], "id int, x string, review_status string, version int")
    u = spark.createDataFrame([(2, "c", "approved", 1), (2, "d", None, 2), (3, "e", None, 1)], t.schema)
    once = store.upsert(t, u, "id", "version", "manifest")
    assert sorted(map(tuple, once.collect())) == [(1, "a", "pending", 0), (2, "d", "pending", 2), (3, "e", "pending", 1)]
    assert sorted(map(tuple, store.upsert(once, u, "id", "version", "manifest").collect())) == sorted(map(tuple, once.collect()))


def test_results_do_not_depend_on_partitions(spark, sf_dir):
    items = frame(spark, sf_dir, "label_items")
    want = {tuple(r) for r in sampling.augmentation_plan(items, "id", "s").select("id", "angle", "rank").collect()}
    for n in (1, 7):
        assert {tuple(r) for r in sampling.augmentation_plan(items.repartition(n), "id", "s").select("id", "angle", "rank").collect()} == want


def test_line_decision_keeps_text_when_rejected(spark):
    lines = spark.createDataFrame([(1, "p<a", None, None, "pending"), (2, "q", "Q<", "OLD", "pending")], "id int, ocr_text string, normalized_text string, final_text string, review_status string")
    d = spark.createDataFrame([(1, "approved", None, 1, 1), (2, "rejected", None, 1, 2)], "line_id int, decision string, final_text string, ts int, event_id int")
    got = {r.id: (r.final_text, r.review_status) for r in review.apply_line_decisions(lines, d).collect()}
    assert got == {1: ("P<A", "approved"), 2: ("OLD", "rejected")}


def test_empty_input(spark):
    df = parse.parse_mrz(spark.createDataFrame([], "id int, lines array<string>"), "lines", 2024)
    assert df.count() == 0
    one = parse.parse_mrz(spark.createDataFrame([(1, None)], "id int, lines array<string>"), "lines", 2024).first()
    assert (one.found, one.checksum_pass, one.checks_passed) == (False, False, 0)


def test_parse_plan_is_native(spark, sf_dir):
    plan = registry.QUERIES["T12_parse"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_manifests_stay_small(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(io_queries, "MANIFEST_ITEMS", 100, raising=False)
    monkeypatch.setattr(io_queries, "folder", lambda *a: f"{tmp_path}/m")
    assert registry.QUERIES["S2_read_manifest"](spark, sf_dir).count() == frame(spark, sf_dir, "label_items").count() > 1000
    sizes = [r.n for r in spark.read.schema(io_queries.files.MANIFEST).json(f"{tmp_path}/m").select(F.size("items").alias("n")).collect()]
    assert max(sizes) < 200 and len(sizes) == len(list((tmp_path / "m").glob("*.json")))


def test_the_rest_imports_without_the_training_data_operators(tmp_path):
    root = Path(registry.__file__).resolve().parents[2]
    shutil.copytree(root / "docgrid", tmp_path / "docgrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "bench.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    say = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONDONTWRITEBYTECODE": "1"}
    for gone in (None, "corpus_pipeline.py"):
        if gone:
            (tmp_path / gone).unlink(missing_ok=True)
        out = subprocess.run([sys.executable, "-c", say], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
        assert out.stdout.split()[-2:] == [str(len(registry.QUERIES)), str(len(registry.ORACLES))], out.stderr
