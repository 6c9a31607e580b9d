"""Near duplicates, neighbours and the language model against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docgrid.llm import common, components, context_tree, minhash, near_vectors, nearest


def union_find(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# ---- components and cells


@pytest.mark.parametrize("links", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(5, 4), (4, 5), (9, 7), (7, 8), (8, 9), (3, 3)]])
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    nodes = {x for p in links if p[0] != p[1] for x in p}
    assert {r.id: r.component for r in components.components(df).collect()} == union_find(nodes, [p for p in links if p[0] != p[1]])


def test_sorted_groups_across_batches():
    import pyarrow as pa

    keys = np.repeat([1, 2, 3, 5, 8], [3, 1, 7, 2, 4])
    for size in (1, 2, 3, 5, 17):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + size]), pa.array(np.arange(len(keys))[i : i + size])], ["k", "v"]) for i in range(0, len(keys), size)]
        got = [t.column(1).to_pylist()[s:e] for t, edges in components.sorted_groups(iter(batches), 1, 2) for s, e in edges.tolist()]
        assert got == [[0, 1, 2], [4, 5, 6, 7, 8, 9, 10], [11, 12], [13, 14, 15, 16]]
    assert list(zip(*(x.tolist() for x in components.pairs_within(np.array([[0, 3], [4, 6]]))))) == [(0, 1), (0, 2), (1, 2), (4, 5)]


# ---- MinHash


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_components(texts, k, percent):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    ids, links = sorted(sets), []
    by = defaultdict(list)
    for i in ids:
        for s in sets[i]:
            by[s].append(i)
    common_n = Counter((a, b) for own in by.values() for x, a in enumerate(own) for b in own[x + 1 :])
    for (a, b), c in common_n.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            links.append((a, b))
    return {i: len(s) for i, s in sets.items()}, union_find(ids, links)


def test_minhash_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sizes, comp = brute_components(texts, 3, 85)
    got = {r.doc_id: r for r in minhash.op3_minhash(spark, sf_dir).collect()}
    assert {i: r.n_shingles for i, r in got.items()} == sizes
    assert {i: r.component_id for i, r in got.items()} == comp
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_minhash_chains_and_large_groups(spark, monkeypatch):
    """Chains whose ends are far apart, a group of near copies, and small blocks, so that round two has work."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(4000)]
    texts, n = {}, 0
    for _ in range(12):
        doc = rng.choice(words, 60).tolist()
        for _ in range(10):
            texts[n], n = " ".join(doc), n + 1
            doc[int(rng.integers(60))] = str(rng.choice(words))
    base = rng.choice(words, 80).tolist()
    for _ in range(120):
        doc = list(base)
        doc[int(rng.integers(80))] = str(rng.choice(words))
        texts[n], n = " ".join(doc), n + 1
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "STAR", 5)
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    sizes, comp = brute_components(texts, 3, 85)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, words=3, percent=85).collect()}
    assert len(set(comp.values())) > 12 and got == comp


def test_minhash_odd_rows(odd_docs, no_docs):
    got = {r.doc_id: r for r in minhash.near_duplicates(odd_docs).collect()}
    assert len(got) == 9 and got[None].kept and got[None].component_id is None
    assert (got[1].component_id, got[2].component_id, got[2].kept) == (1, 1, False)
    assert [got[i].n_shingles for i in (3, 4, 5, 6)] == [0, 0, 0, 1]
    assert minhash.near_duplicates(no_docs).count() == 0


def test_estimate_is_close(spark):
    a = minhash.shingle_set(" ".join(f"x{i}" for i in range(400)), 3)
    b = minhash.shingle_set(" ".join(f"x{i}" if i % 40 else "z" for i in range(400)), 3)
    real = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    rows = [tuple(minhash.packed_bits(minhash.minima(x)).tolist() for x in (a, b))]
    got = spark.createDataFrame(rows, "a array<long>, b array<long>").select(minhash.estimate(F.col("a"), F.col("b"))).first()[0]
    assert abs(got - real) < 0.15


# ---- vectors


def vectors(seed=0, n=300, dim=16, copies=4):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim)).astype(np.float32)
    rows = []
    for i in range(n):
        for c in range(copies if i % 5 == 0 else 1):
            v = base[i] + (rng.standard_normal(dim) * 0.12 * (c % 3)).astype(np.float32)
            rows.append([len(rows), v.tolist(), int(i % 3)])
    rows[7][1], rows[8][1], rows[9][2], rows[10][1], rows[11][1], rows[12][1] = None, [0.0] * dim, None, [float("nan")] * dim, [None] * dim, []
    return rows


VEC = "vec_id long, embedding array<float>, label int"


def brute_links(rows, cosine):
    links = []
    ok = [r for r in rows if r[1] and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    x = np.array([r[1] for r in ok], np.float32).astype(float)
    c = x @ x.T / np.sqrt((x * x).sum(1)[:, None] * (x * x).sum(1))
    for i in range(len(ok)):
        links += [(ok[i][0], ok[j][0]) for j in np.flatnonzero(c[i] >= cosine) if j > i and ok[i][2] == ok[j][2]]
    return links


@pytest.mark.parametrize("block", [4, 1024])
def test_vector_links(spark, block):
    rows = vectors() + [[9000 + i, vectors()[0][1], 0] for i in range(30)]
    links = brute_links(rows, 0.93)
    n = Counter(x for p in links for x in p)
    comp = union_find([r[0] for r in rows], links)
    got = near_vectors.vector_links(spark.createDataFrame(rows, VEC), block=block).collect()
    assert len(got) == len(rows) and len(links) > 300
    assert {r.vec_id: r.n_links for r in got} == {r[0]: n[r[0]] for r in rows}
    assert {r.vec_id: r.component_id for r in got} == comp
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert near_vectors.vector_links(spark.createDataFrame([], VEC)).count() == 0


def test_vector_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    links = brute_links(rows, 0.93)
    got = near_vectors.op1_near_vectors(spark, sf_dir).collect()
    n = Counter(x for p in links for x in p)
    assert {r.vec_id: r.n_links for r in got} == {r[0]: n[r[0]] for r in rows}
    comp = union_find([r[0] for r in rows], links)
    assert {r.vec_id: (r.component_id, r.kept) for r in got} == {i: (c, i == c) for i, c in comp.items()}


def brute_nearest(rows, queries, k):
    ok = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    x = np.array([r[1] for r in ok], np.float32).astype(float)
    out = {}
    for r in ok:
        if r[0] in queries:
            d = np.sqrt(((x - np.array(r[1], np.float32).astype(float)) ** 2).sum(1))
            out[r[0]] = sorted((v, o[0]) for v, o in zip(d.tolist(), ok) if o[0] != r[0])[:k]
    return out


def test_exact_search(spark):
    rows = vectors(1, 400) + [[9000 + i, vectors(1)[3][1], 0] for i in range(20)]
    df = spark.createDataFrame(rows, VEC)
    want = brute_nearest(rows, {r[0] for r in rows if r[0] % 9 == 0}, 5)
    got = defaultdict(list)
    for r in nearest.nearest(df, df.filter("vec_id % 9 = 0"), 5, factor=1.0, shard_bytes=150 * 16 * 8, query_block=8, blocks_per_tree=2).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    assert set(got) == set(want)
    for q in want:
        assert [v for _, v in got[q]] == [v for _, v in want[q]]
        assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in want[q]], abs=0, rel=1e-12)
    few = spark.createDataFrame(rows[:4], VEC)
    assert nearest.nearest(few, few, 10).count() == 12
    assert nearest.nearest(few.limit(0), few.limit(0), 10).count() == 0


def test_nearest_query_recall(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = brute_nearest(rows, {r[0] for r in rows if r[0] % 100 == 0}, 10)
    got = nearest.op5_nearest(spark, sf_dir).collect()
    hits = sum((r.query_id, r.vec_id) in {(q, v) for q, x in want.items() for _, v in x} for r in got)
    assert len(got) == sum(map(len, want.values())) and hits >= 0.9 * len(got)


def test_recall_follows_the_factor(spark):
    """Clustered vectors over several shards: factor one is exact, larger ones leave out more and more."""
    rng = np.random.default_rng(4)
    middle = rng.standard_normal((40, 8)) * 4
    x = (middle[rng.integers(0, 40, 6000)] + rng.standard_normal((6000, 8))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").cache()
    want = brute_nearest(rows, {i for i in range(0, 6000, 100)}, 10)
    best = {(q, v) for q, near in want.items() for _, v in near}
    recall = {}
    for factor in (1.0, nearest.FACTOR, 6.0):
        got = nearest.nearest(df, df.filter("vec_id % 100 = 0"), factor=factor, shard_bytes=1500 * 8 * 8).collect()
        recall[factor] = len(best & {(r.query_id, r.vec_id) for r in got}) / len(best)
    assert recall[1.0] == 1.0 and recall[nearest.FACTOR] >= 0.95 and recall[6.0] < 0.99, recall


def test_nearest_odd_rows(spark):
    rows = [(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 2), (1, [0.0, 5.0], 2), (2, [1.0, 0.0], 3), (2, [1.0, 0.0], 3), (3, [2.0, 0.0], 4), (4, [1.0, 0.0, 0.0], 5), (5, [], 6), (6, None, 7), (7, [0.0, 0.0], 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = [tuple(r) for r in nearest.nearest(df, df, 10).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 2, pytest.approx(math.sqrt(26))), (1, 2, 3, pytest.approx(math.sqrt(29))), (2, 1, 3, 1.0), (2, 2, 1, pytest.approx(math.sqrt(26))), (3, 1, 2, 1.0), (3, 2, 1, pytest.approx(math.sqrt(29)))]


def test_vector_links_odd_rows(spark):
    big, tiny = 1e300, 1e-300
    rows = [(None, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [big, 0.0], 1), (3, [tiny, tiny / 10], 1), (4, [1.0, 0.0], None), (5, [float("inf"), 0.0], 1), (6, [1.0, 0.0, 0.0], 1), (7, [1.0, 0.0], 2)]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, embedding array<double>, label int, kept string, n_links int")
    got = near_vectors.vector_links(df).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"vec_id", "n_links", "component_id", "kept"}
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(None, 0, None, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), *((i, 0, i, True) for i in (4, 5, 6, 7))}


def test_hash_shape_keeps_the_recall():
    for n in (2, 300, 10**5, 10**9):
        tables, k = near_vectors.hash_shape(n, 0.93)
        assert (1 - near_vectors.meeting(math.sqrt(0.14)) ** k) ** tables <= near_vectors.MISS
    small, large = near_vectors.hash_shape(10**3, 0.93), near_vectors.hash_shape(10**8, 0.93)
    assert small[1] < large[1] and small[0] < large[0]


def test_hot_keys_join_like_others(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = common.written(spark.createDataFrame([(1, i) for i in range(20)] + [(2, 0), (3, 0), (None, 0)], "k int, v int"), "rows")
    table = spark.createDataFrame([(1, "a"), (2, "b"), (9, "c")], "k int, w string")
    for how in ("inner", "left"):
        assert sorted(map(str, common.skew_join(rows, table, "k", how).collect())) == sorted(map(str, rows.join(table, "k", how).collect()))


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    links = [(0, i) for i in range(1, 40)] + [(99, i) for i in range(30, 60)] + [(70, 71)]
    nodes = {x for p in links for x in p}
    assert {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()} == union_find(nodes, links)


# ---- context tree


def direct_model(train):
    """Context-tree weighting node by node, by its definition."""
    counts = defaultdict(lambda: [0, 0])
    for text in train:
        raw = bytes([0xFE]) * context_tree.DEPTH + text.encode().lower() + b"\xff"
        for i in range(context_tree.DEPTH, len(raw)):
            for d in range(context_tree.DEPTH + 1):
                p = 1
                for k in range(7, -1, -1):
                    bit = raw[i] >> k & 1
                    counts[raw[i - d : i], p][bit] += 1
                    p = p << 1 | bit
    children = defaultdict(list)
    for ctx, p in counts:
        if ctx:
            children[ctx[1:], p].append((ctx, p))
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    memo = {}

    def weight(node):
        if node not in memo:
            own = kt(*counts[node])
            if len(node[0]) == context_tree.DEPTH:
                memo[node] = own
            else:
                memo[node] = np.logaddexp(own, sum(map(weight, children[node]))) - math.log(2)
        return memo[node]

    def bit_probability(past, p, bit, d=0):
        node = (past[len(past) - d :], p)
        if node not in counts:
            return 0.5 if d == 0 else None
        a = counts[node]
        own = (a[bit] + 0.5) / (sum(a) + 1)
        deeper = bit_probability(past, p, bit, d + 1) if d < context_tree.DEPTH else None
        if deeper is None:
            return own
        stop = math.exp(kt(*a) - math.log(2) - weight(node))
        return stop * own + (1 - stop) * deeper

    def score(text):
        raw, total = bytes([0xFE]) * context_tree.DEPTH + text.encode().lower() + b"\xff", 0.0
        for i in range(context_tree.DEPTH, len(raw)):
            p = 1
            for k in range(7, -1, -1):
                bit = raw[i] >> k & 1
                total += math.log10(bit_probability(raw[i - context_tree.DEPTH : i], p, bit))
                p = p << 1 | bit
        return total

    return score


def base_model(train):
    toks = lambda t: [*common.ascii_words(t), None]
    c = Counter(w for t in train for w in toks(t))
    n, v = sum(c.values()), len(c)
    return lambda t: (len(toks(t)), sum(w in c for w in toks(t)), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks(t))), n


@pytest.mark.parametrize("head", [1, 40, 1 << 20])
def test_context_tree_by_definition(spark, head):
    texts = ["the cat sat on the mat", "The Cat sat", "a dog äöü sat on a log", "", None, "the the the the", "zebra & cat 😀", "the dog sat on the cat", "\n"]
    rows = [(i, t, i % 3 != 2) for i, t in enumerate(texts)]
    got = context_tree.score_texts(spark.createDataFrame(rows, "doc_id long, text string, train boolean"), head=head).collect()
    assert len(got) == len(texts)
    train = [t or "" for _, t, own in rows if own]
    model, (base, n) = direct_model(train), base_model(train)
    for r in got:
        t = texts[r.doc_id] or ""
        assert r.score == pytest.approx(model(t), rel=1e-9)
        assert (r.n_tokens, r.n_known) == base(t)[:2] and r.train_tokens == n
        assert r.base_score == pytest.approx(base(t)[2], rel=1e-9)
        assert r.n_bytes == len(t.encode()) + 1 and r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / r.n_bytes)


def test_context_tree_query(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    base, n = base_model([t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2])
    got = context_tree.op8_context_tree(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (*base(texts[r.doc_id])[:2], n)
        assert r.base_score == pytest.approx(base(texts[r.doc_id])[2], rel=1e-9)
    # far below a byte drawn blindly; the word base only pays for a word, not for its letters
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.45 * math.log10(1 / 256) * sum(len(texts[r.doc_id].encode()) + 1 for r in held)


def test_words_that_only_held_out_texts_use(spark):
    """Every held-out text has one word that training lacks, and one that it has once: both leave the join, scores stay."""
    rows = [(i, f"zzz rare w{i % 50} w{i % 7}" if i % 3 else f"u{i}a u{i}b u{i}c w{i % 7}" + " rare" * (i == 0), i % 3 == 0) for i in range(600)]
    learnt = {w for _, text, own in rows if own for w in text.split()}
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    counts = context_tree.count_table(docs, "text", "train")
    key = lambda w: int(np.uint64(xxhash.xxh64_intdigest(w)).view(np.int64))
    hot = {tuple(r) for r in context_tree.hot_held(counts, 50).collect()}
    assert len(hot) <= 50 and {(context_tree.WORDS, key(w)) for w in (b"zzz", b"rare")} <= hot
    assert context_tree.hot_held(counts, 1).count() <= 1  # many keys are as frequent as the first
    wide, narrow = ({r.doc_id: r for r in context_tree.score_texts(docs, head=h).collect()} for h in (1 << 20, 400))
    for i, text, _ in rows:
        a, b = wide[i], narrow[i]
        assert (a.n_tokens, a.n_known, a.n_bytes) == (b.n_tokens, b.n_known, b.n_bytes)
        assert a.n_known == 1 + sum(w in learnt for w in text.split())
        assert (a.score, a.base_score) == (pytest.approx(b.score), pytest.approx(b.base_score))


def test_context_tree_odd_rows(spark, odd_docs, no_docs):
    assert context_tree.score_texts(odd_docs.withColumn("train", F.lit(True))).count() == odd_docs.count()
    none = context_tree.score_texts(odd_docs.withColumn("train", F.lit(False))).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in none)
    assert [r.score for r in none if r.doc_id == 3] == [pytest.approx(8 * math.log10(0.5))]
    assert context_tree.score_texts(no_docs.withColumn("train", F.lit(True))).count() == 0


@pytest.mark.parametrize("chunk", [1, 1 << 15])
def test_probabilities_sum_to_one(spark, chunk):
    seen = np.concatenate([k for t in (b"abab", b"abc", b"abcabcabd") for k in context_tree.grams_of(t)])
    u, n = np.unique(seen, return_counts=True)
    every = np.concatenate([(c << np.uint64(8)) | np.arange(256, dtype=np.uint64) for c in np.unique(u >> np.uint64(8))])
    keys = np.union1d(u, every)
    rows = [(int(k), int(n[u == k].sum())) for k in keys]
    got = context_tree.gram_table(spark.createDataFrame(rows, "key long, n long"), chunk).collect()
    assert len(got) == len(keys)
    total = defaultdict(float)
    for r in got:
        total[r.key >> 8] += 10**r.logp
    assert all(p == pytest.approx(1.0) for p in total.values())


def test_a_text_in_steps_gives_the_same_keys(monkeypatch):
    raw = context_tree._raw("some Words here, \t and a" + "very" * 40 + " long one\n ünï " * 5)
    want = [np.concatenate(list(f(raw))).tolist() for f in (context_tree.words_of, context_tree.grams_of)]
    assert len(want[0]) == len(raw.split()) + 1 and len(want[1]) == len(raw) + 1
    for step in (1, 7, 64):
        monkeypatch.setattr(context_tree, "STEP", step)
        assert [np.concatenate(list(f(raw))).tolist() for f in (context_tree.words_of, context_tree.grams_of)] == want


def test_counter_hands_on_what_it_holds():
    c = context_tree._Counter()
    rng = np.random.default_rng(1)
    every = [rng.integers(0, 1 << 62, 1 << 18, dtype=np.uint64) for _ in range(24)]
    most = 0
    for k in every:
        c.add(k, True)
        most = max(most, c.n + sum(len(x) for x, _ in c.parts))
        if c.kept > context_tree.KEEP:
            c.take()
    assert most <= context_tree.STEP + 2 * context_tree.KEEP + (1 << 19)


def test_scores_over_a_shuffled_input_keep_their_rows(spark):
    rows = [(i, f"text number {i} " * (i % 5 + 1), i % 3 != 0) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    want = {r.doc_id: r.score for r in context_tree.score_texts(df).collect()}
    got = {r.doc_id: r.score for r in context_tree.score_texts(df.repartition(7)).collect()}
    assert got == {i: pytest.approx(s, rel=1e-9) for i, s in want.items()}


def test_vectors_in_one_hot_bucket(spark, monkeypatch):
    """Nearly all vectors fall into the same buckets, whose rows are split off and meet their cell sizes by broadcast."""
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    rng = np.random.default_rng(3)
    near = rng.standard_normal(16) + 0.02 * rng.standard_normal((150, 16))
    far = rng.standard_normal((30, 16))
    rows = [(i, 1, [float(x) for x in v]) for i, v in enumerate([*near, *far])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.vector_links(spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>"), block=32).collect()}
    unit = np.array([r[2] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.93) & ~np.eye(len(rows), dtype=bool)
    assert {i: got[i][0] for i in got} == {i: int(links[i].sum()) for i in range(len(rows))}
    assert {got[i][1] for i in range(150)} == {0}
