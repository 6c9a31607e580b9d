"""Near-duplicate documents by b-bit MinHash.

Documents with the same shingle set fall together first.  Bands of minima name candidate buckets;
the low bits of the minima, packed into longs, estimate the similarity (corrected for chance
matches) by bit counts; pairs that may pass are confirmed on their full sets.

Round one compares each member of a bucket with the bucket's least member, so a group of any size
costs one pair a member.  Round two looks only at buckets whose members are not in one component
yet, and compares members of different components, in blocks, handing on only links that join them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrid.llm.common import ascii_words, counted_join, mix, read_table, skew_join, written
from docgrid.llm.components import components, components_sql, sorted_groups

HASHES, BITS, ROWS_PER_BAND = 128, 2, 5
BANDS = HASHES // ROWS_PER_BAND
#: Standard deviations below the threshold at which an estimate still goes to the exact check.
SLACK = 4.5
#: Members of a bucket compared in one block; members of one centre checked in one task.
BLOCK, STAR = 512, 512
_PER_LONG = 64 // BITS
_LOW = 0x5555555555555555
_rng = np.random.default_rng(20240101)
_A = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_PRIME = np.uint64(0x100000001B3)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle of all its words."""
    w = ascii_words(text)
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    k = min(words, len(w))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = out * _PRIME ^ h[j : len(h) - k + 1 + j]
        out = mix(out)
    return np.unique(out)


def minima(hashes: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(out, (hashes[at : at + 2048, None] * _A + _B).min(0), out=out)
    return out


def packed_bits(minimum: np.ndarray) -> np.ndarray:
    """Low bits of the (mixed) minima, _PER_LONG to a long."""
    low = (mix(minimum) & np.uint64((1 << BITS) - 1)).reshape(-1, _PER_LONG)
    return (low << (np.arange(_PER_LONG, dtype=np.uint64) * np.uint64(BITS))).sum(1, dtype=np.uint64).view(np.int64)


def band_keys(minimum: np.ndarray) -> np.ndarray:
    rows = minimum[: BANDS * ROWS_PER_BAND].reshape(BANDS, ROWS_PER_BAND)
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS_PER_BAND):
        key = mix(key * _PRIME ^ rows[:, j])
    return key.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, n, k1, k2, sig, bands): set size, a 128-bit digest of the set, packed bits and band keys (null without words)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, k1, k2, sig, bands = [], [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingle_set(t, words)
                n.append(len(s))
                if len(s):
                    raw, m = s.tobytes(), minima(s)
                    k1.append(xxhash.xxh64_intdigest(raw, 1) - (1 << 63))
                    k2.append(xxhash.xxh64_intdigest(raw, 2) - (1 << 63))
                    sig.append(packed_bits(m))
                    bands.append(band_keys(m))
                else:
                    for c in (k1, k2, sig, bands):
                        c.append(None)
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in (n, k1, k2)), pa.array(sig, lists), pa.array(bands, lists)], ["id", "n", "k1", "k2", "sig", "bands"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(sign, f"id {kind}, n long, k1 long, k2 long, sig array<long>, bands array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures: matches above those that chance gives."""
    wrong = F.lit(0)
    for i in range(HASHES // _PER_LONG):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        wrong = wrong + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_LOW)))
    chance = 2.0**-BITS
    return ((1 - wrong / HASHES) - chance) / (1 - chance)


def least_estimate(similarity: float) -> float:
    chance = 2.0**-BITS
    p = chance + (1 - chance) * similarity
    return similarity - SLACK * (p * (1 - p) / HASHES) ** 0.5 / (1 - chance)


def confirmed(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """Of pairs (a, b) those with 100 * |A & B| >= percent * |A | B| on the full sets.

    The texts of a centre ``a`` and of at most about STAR of its ``b`` meet in one group; the group is
    read as a stream that keeps the centre's set only.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).alias("parts"))
    cell = skew_join(pairs, parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b")
    need = cell.select("a", "part", F.lit(1).alias("side"), F.col("b").alias("id")).union(cell.select("a", "part", F.lit(0), "a").distinct())
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(need.hint("merge"), "id").select("a", "part", "side", "id", "text").repartition("a", "part").sortWithinPartitions("a", "part", "side", "id")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets = None, []
        for b in batches:
            out: tuple[list, list] = ([], [])
            a, part, side, ids, text = (b.column(k).to_pylist() for k in range(5))
            for i in range(len(a)):
                if (a[i], part[i]) != now:
                    now, sets = (a[i], part[i]), []
                s = shingle_set(text[i], words)
                if side[i] == 0:
                    sets.append(s)
                elif any(100 * (c := len(np.intersect1d(s, x, assume_unique=True))) >= percent * (len(s) + len(x) - c) and c for x in sets):
                    out[0].append(a[i])
                    out[1].append(ids[i])
            yield pa.RecordBatch.from_arrays([pa.array(x, b.schema.field(0).type) for x in out], ["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return rows.mapInArrow(check, f"a {kind}, b {kind}")


def _alike(sig: np.ndarray, bands: np.ndarray, comp: np.ndarray, place: int, i: int, s: int, e: int, least: float) -> np.ndarray:
    """Rows of s..e in another component than row i whose estimate may pass and which meet it in this band first."""
    chance = 2.0**-BITS
    x = sig[i] ^ sig[s:e]
    wrong = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(_LOW)).sum(1)
    good = s + np.flatnonzero((((1 - wrong / HASHES) - chance) / (1 - chance) >= least) & (comp[s:e] != comp[i]))
    return good[(bands[good] == bands[i]).argmax(1) == place] if len(good) else good


def _columns(t: pa.Table) -> tuple[np.ndarray, ...]:
    """key, id, comp, other, sig, bands of a table of cells."""
    wide = [t.column(k).combine_chunks().values.to_numpy().reshape(len(t), -1) for k in (6, 7)]
    return *(t.column(k).to_numpy() for k in (0, 3, 4, 5)), wide[0].view(np.uint64), wide[1]


def _cross_links(docs: DataFrame, mixed: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """Links (a, b) between different components that share a bucket, confirmed on the full sets.

    mixed: key, id, comp, main (the component of the bucket's centre), sig, bands.  Members of the main
    component are compared with the others only.  Blocks of BLOCK members make the cells, so a bucket
    of any size is many bounded tasks.  A first pass keeps the rows of each cell that are in a pair
    whose estimate may pass; the second adds their texts and tells the links that join components, so
    neither makes a list of pairs.  A pair is looked at in the first band that it shares.
    """
    least = least_estimate(percent / 100)
    other = (F.col("comp") != F.col("main")).cast("int")
    sizes = mixed.groupBy("key").agg(F.ceil(F.sum(other) / BLOCK).alias("no"), F.ceil(F.sum(1 - other) / BLOCK).alias("nm"), F.count("*").alias("n"))
    rows = counted_join(mixed, written(sizes, "cells"), "key", "n", mixed.count()).withColumn("other", other).withColumn("h", F.xxhash64("id"))
    span = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    own = F.pmod("h", F.col("no"))
    # a cell is (key, i, j): i a block of others, j a block of others (>= i), or of the main component as -1 - j
    cells = F.when(
        F.col("other") == 1,
        F.concat(
            F.transform(span(F.col("no")), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"))),
            F.when(F.col("nm") > 0, F.transform(span(F.col("nm")), lambda j: F.struct(own.alias("i"), (-1 - j).alias("j")))).otherwise(F.array().cast("array<struct<i:bigint,j:bigint>>")),
        ),
    ).otherwise(F.transform(span(F.col("no")), lambda i: F.struct(i.alias("i"), (-1 - F.pmod("h", F.col("nm"))).alias("j"))))
    names = ["key", "i", "j", "id", "comp", "other", "sig", "bands"]
    rows = rows.select("key", F.explode(cells).alias("cell"), "other", "id", "comp", "sig", "bands").select("key", "cell.i", "cell.j", *names[3:])

    def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, edges in sorted_groups(batches, 3, 2):
            key, _, comp, other, sig, bands = _columns(t)
            use = np.zeros(len(t), bool)
            for s, e in edges.tolist():
                for i in range(s, e):
                    if other[i] and len(j := _alike(sig, bands, comp, int((bands[i] == key[i]).argmax()), i, s, e, least)):
                        use[i] = use[j] = True
            yield from t.filter(pa.array(use)).to_batches()

    kind = "key long, i long, j long, id long, comp long, other int, sig array<long>, bands array<long>"
    rows = written(rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(promising, kind), "promising")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(texts.hint("merge"), "id").select(*names, "text").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, edges in sorted_groups(batches, 3, 2):
            key, ids, comp, other, sig, bands = _columns(t)
            text, a, b = t.column(8), [], []
            for s, e in edges.tolist():
                sets: dict[int, np.ndarray] = {}
                now = comp[s:e].copy()  # components as the links found here join them
                for i in range(s, e):
                    if not other[i]:
                        continue
                    for j in _alike(sig, bands, comp, int((bands[i] == key[i]).argmax()), i, s, e, least).tolist():
                        if now[i - s] == now[j - s]:
                            continue
                        for k in (i, j):
                            if k not in sets:
                                sets[k] = shingle_set(text[k].as_py(), words)
                        x, y = sets[i], sets[j]
                        c = len(np.intersect1d(x, y, assume_unique=True))
                        if c and 100 * c >= percent * (len(x) + len(y) - c):
                            a.append(ids[i])
                            b.append(ids[j])
                            now[now == now[j - s]] = now[i - s]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b)], ["a", "b"])

    return rows.mapInArrow(check, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per id (a long): id_col, n_shingles, component_id, kept.

    Documents are linked when 100 * |A & B| >= percent * |A | B| for their sets of word shingles;
    component_id is the least id reachable by links, and kept marks it.  Null, empty and blank texts
    have no shingles and no links.  Rows repeated under one id give one row: the largest set size and
    the least component of them.  Rows with a null id are compared with nothing and come back as they
    are, component null and kept.  An empty table gives no rows; other columns are not read.
    """
    known = docs.filter(F.col(id_col).isNotNull())
    sigs = written(signatures(known, id_col, text_col, words), "signatures")
    least = least_estimate(percent / 100)
    reps = written(sigs.filter("k1 is not null").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "sets")
    members = reps.select("id", F.explode("bands").alias("key"))
    centres = written(members.groupBy("key").agg(F.min("id").alias("centre"), F.count("*").alias("n")).filter("n > 1"), "centres")
    shared = written(counted_join(members, centres, "key", "n", BANDS * reps.count()).drop("n"), "buckets")
    bits = reps.select("id", "sig", "bands")
    pairs = written(shared.filter("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct(), "candidates")
    pairs = skew_join(pairs, bits.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(bits.select(F.col("id").alias("b"), F.col("sig").alias("sb")).hint("merge"), "b")
    pairs = written(pairs.filter(estimate(F.col("sa"), F.col("sb")) >= least).select("a", "b"), "pairs")
    links = written(confirmed(known, pairs, id_col, text_col, words, percent), "confirmed")
    comps = written(components(links), "components")

    placed = shared.join(comps.hint("merge"), "id", "left").select("key", "id", "centre", F.coalesce("component", "id").alias("comp"))
    placed = written(placed, "placed")
    main = placed.filter("id = centre").select("key", F.col("comp").alias("main"))
    split = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    mixed = written(placed.join(split.join(main.hint("merge"), "key").hint("merge"), "key").join(bits.hint("merge"), "id").select("key", "id", "comp", "main", "sig", "bands"), "mixed")
    if not mixed.isEmpty():
        more = written(_cross_links(known, mixed, id_col, text_col, words, percent), "confirmed")
        if not more.isEmpty():
            comps = written(components(links.union(more)), "components")

    own = reps.select("k1", "k2", "id").join(comps.hint("merge"), "id", "left").select("k1", "k2", F.coalesce("component", "id").alias("component"))
    out = sigs.select("id", "n", "k1", "k2")
    out = skew_join(out.filter("k1 is not null"), own, ["k1", "k2"]).select("id", "n", "component").union(out.filter("k1 is null").select("id", "n", F.col("id")))
    out = out.groupBy("id").agg(F.max("n").alias("n_shingles"), F.least(F.min("component"), F.col("id")).alias("component_id"))
    out = out.select(F.col("id").alias(id_col), "n_shingles", "component_id", (F.col("component_id") == F.col("id")).alias("kept"))
    unknown = docs.filter(F.col(id_col).isNull()).select(F.col(id_col), F.lit(None).cast("long").alias("n_shingles"), F.col(id_col).alias("component_id"), F.lit(True).alias("kept"))
    return out.union(unknown)


def op3_minhash(spark, sf_dir: str) -> DataFrame:
    """Contract: three-word shingles, similarity 0.85."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), words=3, percent=85)


OP3_SQL = f"""
with w as (
  select doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents
), g as (
  select id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')] else [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)] end) as s from w
), u as (select id, len(s) as n, unnest(s) as h from g), l as (
  select x.id as a, y.id as b from u x join u y on x.h = y.h and x.id <> y.id and 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
  group by x.id, y.id, x.n, y.n having 100 * count(*) >= 85 * (x.n + y.n - count(*))
), n as (select id from g), c as ({components_sql("n", "l")})
select id as doc_id, len(s) as n_shingles, component as component_id, component = id as kept from g join c using (id)
"""
