"""Conversation repair, the Merkle manifest and decontamination: SQL parity, brute force and odd rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from docgrid.llm import decontamination, merkle, registry, repair

NEW = ["op11_repair", "op12_merkle", "op13_decontamination"]


@pytest.mark.parametrize("name", NEW)
def test_query_equals_sql(name, spark, duck, sf_dir, same):
    same(registry.QUERIES[name](spark, sf_dir), duck, registry.ORACLES[name])


# ---- conversations

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
TURN = (2, 2, 3, 2)


def cheapest(turns):
    """(cost, audit, repaired) of (role, text, must go, truncated) by a table over all nodes."""
    best = {(0, 0): (0, "", ())}
    for i in range(len(turns) + 1):
        for _ in range(3):  # at most two turns are inserted at a place
            for q in range(4):
                if (i, q) in best:
                    c, a, r = best[i, q]
                    new = (c + 2, a + "I", (*r, ("user" if TURN[q] == 2 else "assistant", "")))
                    if (i, TURN[q]) not in best or new[:2] < best[i, TURN[q]][:2]:
                        best[i, TURN[q]] = new
        if i == len(turns):
            break
        role, text, gone, cut = turns[i]
        for q in range(4):
            if (i, q) not in best:
                continue
            c, a, r = best[i, q]
            arcs = [(q, c + 3, "D", r)]
            if not gone:
                if (q, role[:1]) in NEXT:
                    arcs.append((NEXT[q, role[:1]], c + cut, "K", (*r, (role, text))))
                arcs.append((TURN[q], c + 2 + cut, "R", (*r, ("user" if TURN[q] == 2 else "assistant", text))))
            for p, cost, letter, said in arcs:
                new = (cost, a + letter, said)
                if (i + 1, p) not in best or new[:2] < best[i + 1, p][:2]:
                    best[i + 1, p] = new
    return min((best[len(turns), q] for q in (0, 3) if (len(turns), q) in best), key=lambda x: x[:2])


def expected(rows):
    """Result row of one conversation's (turn, role, text)."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    seen, turns, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            count[fault] += 1
        turns.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
    at = [t for t, _, _ in rows if t is not None]
    gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, said = cheapest(turns)
    return (gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in said).encode()).hexdigest()), said


def conversations(seed, n, longest):
    rng, out = random.Random(seed), {}
    for c in range(n):
        rows = []
        for t in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice(["Yes.", "No!", "and then", "  ", None, "", f"line {rng.randrange(9)}?", "Ünïcödé 漢字"])
            rows.append((None if rng.random() < 0.05 else t + rng.randrange(2), role, text))
        out[c] = rows
    return out


CONV = "conv_id long, turn long, role string, text string, g string, at long, fault int, edits string"


def conv_frame(spark, convs):
    return spark.createDataFrame([(c, *r, "x", 1, 2, "y") for c, rows in convs.items() for r in rows], CONV).repartition(3)


@pytest.mark.parametrize("bits, longest", [(8, 12), (2, 12), (1, 30), (3, 60)])
def test_repair_is_the_least_of_the_cheapest(bits, longest, spark):
    convs = conversations(bits * 100 + longest, 60, longest)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repairs(conv_frame(spark, convs), chunk_bits=bits).collect()}
    assert got == {c: expected(rows)[0] for c, rows in convs.items()}


def test_repaired_turns_are_well_formed(spark):
    convs = conversations(7, 40, 20)
    said = {}
    for r in repair.repaired_turns(conv_frame(spark, convs), chunk_bits=2).orderBy("conv_id", "place").collect():
        said.setdefault(r.conv_id, []).append((r.role, r.text))
    for c, rows in convs.items():
        assert tuple(said.get(c, ())) == expected(rows)[1]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in said.get(c, ())))


def test_odd_conversations(spark):
    same_turn = [(5, "user", "Again.")] * 300  # one conversation of equal rows
    convs = {None: [(0, "user", "Hi."), (1, "assistant", "Ho.")], 1: same_turn, 2: [(None, None, None)], 3: [(0, "user", "w " * 50000)], -1: [(10**12, "user", "a."), (0, "assistant", "b.")]}
    got = {r.conv_id: tuple(r)[1:] for r in repair.repairs(conv_frame(spark, convs), chunk_bits=4).collect()}
    assert got == {c: expected(rows)[0] for c, rows in convs.items()}
    none = spark.createDataFrame([], CONV)
    assert repair.repairs(none).count() == 0 and repair.repaired_turns(none).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in range(3)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    k = {(r.conv_id, r.turn): r.k for r in df.select("conv_id", "turn", (F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20).alias("k")).collect()}
    got = {}
    for r in repair.damaged(df).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text))
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        one = {1: (role, ""), 2: (role, text.translate(dict.fromkeys(map(ord, ".!?")))), 4: ("user", text)}.get(k[c, t], (role, text))
        assert got.get((c, t), []) == [] if k[c, t] == 0 else got[c, t] == [one] * (2 if k[c, t] == 3 else 1)


# ---- Merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """(top, siblings of each leaf level by level as (left, right))."""
    nodes, paths, place = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(nodes) > 1:
        for k, p in enumerate(place):
            run = nodes[p // 8 * 8 : p // 8 * 8 + 8]
            paths[k].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
        nodes = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        place = [p // 8 for p in place]
    return nodes[0], paths


def proofs(rows):
    """Result rows (sorted) of (doc_id, source, lang, n_chars, text)."""
    leaf = lambda r: h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in r))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], leaf(r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    sub = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        sub[g] = tree([x[1] for x in groups[g]])
    root, over = tree([sub[g][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for (i, x), path in zip(groups[g], sub[g][1]):
            path = path + over[k]
            out.append((i, x, sub[g][0], root, h(*(a + b for a, b in path)), root, True))
    return sorted(map(repr, out))


@pytest.mark.parametrize("n, langs", [(1, 1), (8, 1), (9, 1), (200, 3), (700, 70), (5000, 2)])
def test_merkle_by_hand(n, langs, spark):
    rng = random.Random(n)
    rows = [(rng.choice([i, i, None, 3]), rng.choice(["a", None]), rng.choice([None, "", *(f"l{k}é" for k in range(langs))]) if langs > 1 else "x", rng.choice([i, None]), rng.choice([None, "", f"Text {i}", "漢字"])) for i in range(n)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, t long")
    got = merkle.manifest(df.repartition(5)).drop("siblings")
    assert sorted(repr(tuple(r)) for r in got.collect()) == proofs(rows)


def test_merkle_tampering(spark, odd_docs, no_docs):
    docs = odd_docs.unionByName(odd_docs.withColumn("doc_id", F.col("doc_id") + 100))
    altered = {"text": F.when(F.col("doc_id") == 1, F.lit("other")).otherwise(F.col("text"))}
    got = merkle.manifest(docs, altered=altered).collect()
    assert len(got) == docs.count() and {r.doc_id for r in got if not r.verified} == {1}
    assert len({r.root for r in got}) == 1 and all((r.folded_root == r.root) == r.verified for r in got)
    assert merkle.manifest(no_docs).count() == 0
    with pytest.raises(ValueError):
        merkle.manifest(docs, group_col="doc_id")


# ---- decontamination


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def leaks(docs, items, window=10):
    wins = {}
    for i, text in items:
        w = words(text)
        m = min(len(w), window)
        for s in range(len(w) - m + 1) if m else ():
            wins.setdefault(tuple(w[s : s + m]), set()).add("" if i is None else str(i))
    out = []
    for d, text in docs:
        w, hit, ids = words(text), set(), set()
        for m in {len(x) for x in wins}:
            for s in range(len(w) - m + 1):
                own = wins.get(tuple(w[s : s + m]))
                if own:
                    hit |= set(range(s, s + m))
                    ids |= own
        out.append((d, len(w), len(hit), len(ids), h(",".join(sorted(ids))), bool(hit)))
    return sorted(map(repr, out))


def leak_rows(df):
    return sorted(repr(tuple(r)) for r in df.drop("spans").collect())


@pytest.mark.parametrize("window, small", [(10, 10**6), (10, 0), (3, 10**6), (1, 0)])
def test_leaks_by_hand(window, small, spark, monkeypatch):
    monkeypatch.setattr(decontamination, "SMALL", small)
    rng = random.Random(window)
    text = lambda n: " ".join(rng.choice(["a", "b", "Ünï", "C3", "the"]) + rng.choice(["", ",", "--", "\x00"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 5, 9, 10, 11, 30]))) for i in range(12)] + [(3, text(12)), (None, text(12)), (50, None)]
    docs = []
    for i in range(120):
        t = text(rng.randrange(40))
        if rng.random() < 0.5:
            t += " " + (rng.choice(items)[1] or "").upper().replace("Ü", "Ü") + "; " + text(rng.randrange(5))
        docs.append((rng.choice([i, None, 7]), t if rng.random() < 0.95 else None))
    d = spark.createDataFrame([(*r, 1, "q") for r in docs], "doc_id long, text string, words long, m string")
    it = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, hash long")
    assert leak_rows(decontamination.contamination(d, it, window=window)) == leaks(docs, items, window)


def test_leaks_in_odd_texts(spark, odd_docs, no_docs):
    item = "one very long text many words in one very long text many words"
    items = spark.createDataFrame([(1, item), (2, item), (3, "WORD")], "item_id long, text string")
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert leak_rows(decontamination.contamination(odd_docs, items)) == leaks(docs, [(1, item), (2, item), (3, "WORD")])
    assert decontamination.contamination(no_docs, items).count() == 0
    clean = decontamination.contamination(odd_docs, items.limit(0)).collect()
    assert len(clean) == len(docs) and not any(r.contaminated or r.n_hit for r in clean)


def test_spans_are_merged(spark):
    item = " ".join(f"w{k}" for k in range(14))
    docs = spark.createDataFrame([(1, f"x y {item} z {item}")], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    r = decontamination.contamination(docs, items).first()
    assert [tuple(x) for x in r.spans] == [(2, 16), (17, 31)] and r.n_hit == 28


def test_winnowing_keeps_a_hash_of_every_span(spark):
    for m in range(1, 13):
        k, w = decontamination.span(m)
        assert k >= 1 and w >= 1 and k + w - 1 == m


def test_native_plan(spark, sf_dir):
    plan = registry.QUERIES["op13_decontamination"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
