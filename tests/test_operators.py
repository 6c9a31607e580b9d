"""Profiles by hand, decisions on streams, pages and presence."""

import random

import pytest
from pyspark.sql import functions as F

from docgrid.operators import evaluate, profiles, review
from docgrid.streaming.streams import current_decisions, decision_stream


def bands(v, ratio=0.12, least=6):
    out, m, y = [], max(v, default=0), 0
    while m > 0 and y < len(v):
        if v[y] < m * ratio:
            y += 1
            continue
        e = y
        while e < len(v) and v[e] >= m * ratio:
            e += 1
        if e - y >= least:
            out.append((y, e - 1 if e == len(v) else e, sum(v[y:e]) / (e - y)))
        y = e
    return out


def split(v, bs, expected, least=6):
    for _ in range(expected - 1):
        if not bs or len(bs) >= expected:
            break
        a, b, _ = t = min(bs, key=lambda x: (x[0] - x[1], x[0]))
        lo, hi = max(a + least, a + int((b - a) * 0.3)), min(b - least, a + int((b - a) * 0.7))
        if b - a < 3 * least or hi <= lo:
            break
        cut = min(range(lo, hi), key=lambda y: (v[y], y))
        bs = [x for x in bs if x is not t] + [(p, q, sum(v[p:q]) / (q - p)) for p, q in ((a, cut), (cut, b))]
    return bs


@pytest.fixture(scope="module")
def shapes():
    rng = random.Random(5)
    out = {}
    for i in range(60):
        n = rng.choice([1, 5, 30, 90, 200])
        base = [0.0] * n
        for _ in range(rng.randrange(4)):
            a, b, h = rng.randrange(n), rng.randrange(n + 1), rng.randrange(1, 200)
            for y in range(min(a, b), max(a, b)):
                base[y] = float(h + rng.randrange(20))
        out[i] = base
    return out


@pytest.fixture(scope="module")
def images(spark, shapes):
    rows = [(i, y, v) for i, vs in shapes.items() for y, v in enumerate(vs)]
    return profiles.as_arrays(spark.createDataFrame(rows, "img_id long, y int, v double").repartition(5))


def found(df):
    out = {}
    for r in profiles.band_rows(df).collect():
        out.setdefault(r.img_id, []).append((r.y1, r.y2, round(r.score, 9)))
    return {i: sorted(b) for i, b in out.items()}


def exact(d):
    return {i: sorted((a, b, round(s, 9)) for a, b, s in x) for i, x in d.items() if x}


def test_bands_by_hand(shapes, images):
    assert found(profiles.profile_bands(images)) == exact({i: bands(v) for i, v in shapes.items()})


@pytest.mark.parametrize("expected", [1, 2, 3, 5])
def test_splits_by_hand(expected, shapes, images):
    got = found(profiles.split_wide_bands(profiles.profile_bands(images), expected))
    assert got == exact({i: split(v, bands(v), expected) for i, v in shapes.items()})


def test_odd_profiles(spark):
    rows = [(1, 0, 5.0), (1, 2, None), (1, 2, 3.0), (1, 2, 4.0), (None, 1, 7.0), (2, None, 1.0)]
    got = {r.img_id: r.v for r in profiles.as_arrays(spark.createDataFrame(rows, "img_id int, y int, v double")).collect()}
    assert got == {1: [5.0, 0.0, 4.0], None: [0.0, 7.0]}
    none = profiles.profile_bands(profiles.as_arrays(spark.createDataFrame([], "img_id int, y int, v double")))
    for f in (profiles.band_rows, profiles.separators, profiles.line_bounds, profiles.fixed_split):
        assert f(none).count() == 0


def test_profile_chain_has_one_exchange_and_no_join(images):
    df = profiles.line_bounds(profiles.top_bands(profiles.force_bands(profiles.split_wide_bands(profiles.profile_bands(images)))))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") <= 2  # one of them is this table's own repartition


DECISION = "event_id long, ts long, source_key string, decision string"


def test_stream_restarts_and_late_decisions(spark, tmp_path):
    """State outlives a stop: a decision that comes after a restart, but is older, changes nothing; a batch hands on its own keys only."""
    given, out, at = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/at"

    def feed(*rows):
        spark.createDataFrame(rows, DECISION).coalesce(1).write.mode("append").parquet(given)
        decision_stream(spark.readStream.schema(DECISION).parquet(given), "source_key", out, at).awaitTermination()
        now = current_decisions(spark, out, spark.createDataFrame([], DECISION).schema, "source_key")
        return {r.source_key: (r.decision, r.ts) for r in now.collect()}

    assert feed((1, 10, "a", "approved"), (2, 11, "b", "rejected"), (3, 9, None, "approved"), (4, 20, "a", "view")) == {"a": ("approved", 10), "b": ("rejected", 11)}
    assert feed((5, 5, "a", "rejected"), (6, 11, "b", "approved")) == {"a": ("approved", 10), "b": ("approved", 11)}
    assert feed((7, 30, "c", "approved"), (7, 30, "c", "approved")) == {"a": ("approved", 10), "b": ("approved", 11), "c": ("approved", 30)}
    last = max(spark.read.parquet(out).select("batch").distinct().collect())[0]
    assert {r.source_key for r in spark.read.parquet(out).filter(F.col("batch") == last).collect()} <= {"c"}


def test_words_that_are_no_line_decision(spark):
    lines = spark.createDataFrame([(1, "p<a", None, None, "pending")], "id int, ocr_text string, normalized_text string, final_text string, review_status string")
    d = spark.createDataFrame([(1, "view", "X", 2, 2), (1, None, "Y", 3, 3), (1, "approved", None, 1, 1), (1, "view", None, 4, 4)], "line_id int, decision string, final_text string, ts int, event_id int")
    assert [(r.final_text, r.review_status) for r in review.apply_line_decisions(lines, d).collect()] == [("P<A", "approved")]
    assert sorted(map(tuple, review.refused_decisions(d).collect()), key=str) == [("view", 2), (None, 1)]


def test_a_page_beyond_the_end_keeps_its_totals(spark):
    kind = "id int, is_match boolean, error_message string, used_fallback boolean"
    df = spark.createDataFrame([(i, i % 2 == 0, None, False) for i in range(9)], kind)
    for offset, ids in ((0, [7, 5]), (3, [1]), (4, []), (99, [])):
        r = evaluate.eval_page(df, "mismatch", 2, offset).first()
        assert ([x.id for x in r["items"]], r.total_filtered, r.total, r.matched) == (ids, 4, 9, 5)
    r = evaluate.eval_page(df.limit(0), "all").first()
    assert (r["items"], r.total_filtered, r.total) == ([], 0, 0)


def test_paging_skips_what_has_no_file(spark, keep):
    kind = "id long, status string, image_file_name string, label_file_name string, review_status string"
    items = spark.createDataFrame([(k, "labeled", f"i{k}", f"l{k}", "pending") for k in (1, 5, 10**9, 10**10)] + [(7, "labeled", None, "l7", "pending")], kind)
    files = spark.createDataFrame([(f"{c}{k}",) for k in (1, 5, 10**10) for c in "il" if (c, k) != ("l", 5)] + [("i1",)], "path string")
    got = {r.id: (r.next_id, r.previous_id) for r in review.neighbours(items, keep, files, 2).collect()}
    assert got == {1: (10**10, None), 5: (10**10, 1), 7: (10**10, 1), 10**9: (10**10, 1), 10**10: (1, 1)}
