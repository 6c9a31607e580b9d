"""Each stage of the pipeline against plain Python on what the stage before kept, and on odd rows."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_pairs import brute_components
from test_text_ops import check_packing, encoded
from tokenizers import Tokenizer

import corpus_pipeline
from docgrid.llm import mixing, quality, secrets, tokens
from docgrid.llm.common import read_table, written


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    out = [("documents", read_table(spark, sf_dir, "documents"))]
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, written(stage(spark, out[-1][1], sf_dir), f"test-{name}").cache()))
    return dict(out)


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_quality_stage(spark, sf_dir, stages):
    before, after = rows_of(stages["documents"]), rows_of(stages["quality"])
    good = {r.doc_id for r in quality.op10_quality(spark, sf_dir).collect() if r.score >= 0.7}
    assert set(after) == good and 0 < len(after) < len(before)
    assert all(tuple(after[i]) == tuple(before[i]) for i in after)


def test_near_duplicates_stage(stages):
    before, after = rows_of(stages["quality"]), rows_of(stages["near_duplicates"])
    _, comp = brute_components({i: r.text for i, r in before.items()}, 5, 80)
    assert set(after) == {i for i, c in comp.items() if i == c} and len(after) < len(before)
    assert all(tuple(after[i]) == tuple(before[i]) for i in after)


def test_secrets_stage(stages):
    before, after = rows_of(stages["near_duplicates"]), rows_of(stages["secrets"])
    assert set(before) == set(after)
    changed = 0
    for i, r in before.items():
        hidden = [0] * len(r.text)
        for _, s, e in secrets.find_spans(r.text):
            hidden[s:e] = [1] * (e - s)
        changed += any(hidden)
        kept = "".join(c for c, h in zip(r.text, hidden) if not h)
        assert after[i].text.replace("[SECRET]", "") == kept.replace("[SECRET]", "")
        assert after[i].n_chars == (len(after[i].text) if any(hidden) else r.n_chars)
        assert not [x for x in secrets.find_spans(after[i].text) if x[0] != "random"]
    assert changed


def test_mixing_stage(stages):
    before, rows = rows_of(stages["secrets"]), stages["mixing"].collect()
    times, words = Counter(r.doc_id for r in rows), defaultdict(int)
    assert set(times) <= set(before) and max(times.values()) <= 3
    assert all(tuple(r)[:5] == tuple(before[r.doc_id]) for r in rows)
    for i, n in times.items():
        words[before[i].source] += n * len(before[i].text.split())
    targets = {r.source: r.target for r in mixing.curriculum(stages["secrets"]).select("source", "target").distinct().collect()}
    longest = max(len(r.text.split()) for r in before.values())
    assert all(abs(words[s] - t) <= longest for s, t in targets.items())
    assert all(0 <= r.position <= 1 for r in rows)


def test_packing_stage(stages):
    mixed, rows = stages["mixing"].collect(), stages["packing"].collect()
    n = check_packing(rows)
    library = Tokenizer.from_file(tokens.TOKENIZER)
    size = {r.doc_id: len(encoded(library, r.text)) + 1 for r in mixed}
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.length
    takes = Counter(r.doc_id for r in mixed)
    assert total == {i: size[i] * k for i, k in takes.items()}
    assert n <= 1.05 * sum(total.values()) / 2048 + 2
    at = sorted((r.position, r.doc_id) for r in mixed)
    place = {d: np.mean([k for k, (_, e) in enumerate(at) if e == d]) for d in takes}
    by = sorted(rows, key=lambda r: r.sequence_id)
    half = len(by) // 2
    assert np.mean([place[r.doc_id] for r in by[:half]]) <= np.mean([place[r.doc_id] for r in by[half:]]) + len(at) / 4


def test_run_is_the_stages(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == stages["packing"].columns
    assert got.agg(F.sum("length")).first()[0] == stages["packing"].agg(F.sum("length")).first()[0]


def test_odd_rows_in_every_stage(spark, sf_dir, odd_docs, no_docs):
    more = odd_docs.withColumn("position", F.lit("clash")).withColumn("row", F.lit("clash")).withColumn("text2", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        docs = more
        if name == "packing":
            docs = odd_docs.select(*corpus_pipeline.COLUMNS, F.lit(0.5).alias("position"))
        out = stage(spark, docs, sf_dir).collect()
        empty = stage(spark, no_docs.withColumn("position", F.lit(0.5)), sf_dir)
        assert empty.count() == 0, name
        if name == "packing":
            assert sum(r.piece == 0 for r in out) == odd_docs.count()
            check_packing(out)
            continue
        assert empty.columns[:5] == list(corpus_pipeline.COLUMNS)
        n = Counter(r.doc_id for r in out)
        if name == "near_duplicates":
            assert n == {i: 1 for i in (None, 1, 3, 4, 5, 6, 7, 8)}
        if name == "secrets":
            assert sorted(map(str, out)) == sorted(map(str, odd_docs.select(*corpus_pipeline.COLUMNS).collect()))
        if name == "mixing":
            assert not set(n) & {3, 4, 5} and max(n.values()) <= 6


def test_differing_rows_of_one_id_give_one(spark, sf_dir):
    rows = [(1, "b text of its own", "en", "s", 17), (1, "a text of its own", "en", "s", 17), (2, "other words here", "en", "s", 16)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for n in (1, 3):
        got = corpus_pipeline.dedup_stage(spark, df.repartition(n), sf_dir).collect()
        assert sorted(map(tuple, got)) == [rows[1], rows[2]]
