"""Benchmark decontamination by winnowing; DataFrame functions only.

Of every ``window - k + 1`` consecutive k-grams the least hash is kept, so a span of ``window`` words that
a document shares with an item has the same kept hash on both sides.  Kept hashes of a document are
probed against a bitmap of the items' ones while its row is read; only the spans around a hit are
extended to whole windows, which then meet the items' windows as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrid.llm.common import discard, read_table, skew_join, written

WINDOW = 10
#: Bits of the bitmap per kept hash of the items, and its largest size in longs (2 MB).  A fuller bitmap lets more
#: spans through to the join, which decides alone.
BITS_PER_HASH, MOST_LONGS = 1024, 1 << 18
#: Windows of the items up to which they are broadcast (about 100 bytes each); beyond it they are merged.
SMALL = 200_000
_ALPHA = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: What parts words: every ASCII character but digits and letters.
_GAPS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words_of(c: str) -> Column:
    """Words of a text, A-Z lowered; null has none.  Gaps become blanks first, as a split at one character needs no pattern."""
    plain = F.translate(F.col(c), _ALPHA + _GAPS, _ALPHA.lower() + " " * len(_GAPS))
    return F.coalesce(F.array_remove(F.split(plain, " "), ""), F.array().cast("array<string>"))


def span(m: int) -> tuple[int, int]:
    """(k, w) of the winnowing that keeps a hash of every shared span of m words: w k-grams of k words make m words."""
    k = (m + 1) // 2
    return k, m - k + 1


def _run(a: Column | str, i: Column, n: int) -> list[Column]:
    # elements are taken one by one, as slice() copies its whole array each time
    return [F.get(a, i + j) for j in range(n)]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once; a column of it would be put into the body's inner functions, once a word."""
    return F.transform(F.array(value), body)[0]


def _kept(m: int) -> Column:
    """For every start of m words the least hash of the k-grams from there on."""
    k, w = span(m)
    grams = lambda h: F.transform(h, lambda _, i: F.xxhash64(*_run(h, i, k)))
    least = lambda g: F.transform(g, lambda x, i: F.least(*_run(g, i, w)) if w > 1 else x)
    kept = _let(F.transform("words", lambda x: F.xxhash64(x)), lambda h: _let(grams(h), least))
    # what begins within the last m - 1 words has no m words
    return F.when(F.size("words") >= m, F.slice(kept, F.lit(1), F.size("words") - (m - 1))).otherwise(F.array().cast("array<long>"))


def _text(start: Column, m: int) -> Column:
    return F.concat_ws(" ", *_run("words", start, m))


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Written (m, win, hash, item): distinct windows of m words of each item, as text, with their kept hash."""
    rows = written(items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(text_col).alias("words")).filter("size(words) > 0"), "items")
    lengths = [r[0] for r in rows.select(F.least(F.size("words"), F.lit(window)).alias("m")).distinct().collect()]  # ``window`` values at most
    out = None
    for m in sorted(lengths):
        own = rows.filter(F.least(F.size("words"), F.lit(window)) == m)
        own = own.select("item", "words", F.posexplode(_kept(m)).alias("start", "hash")).select(F.lit(m).alias("m"), _text(F.col("start"), m).alias("win"), "hash", "item")
        out = own if out is None else out.unionByName(own)
    if out is None:
        out = rows.select(F.lit(window).alias("m"), F.lit("").alias("win"), F.lit(0).cast("long").alias("hash"), "item").limit(0)
    return written(out.distinct(), "item-windows")


def _bitmap(hashes: DataFrame, longs: int) -> Column:
    """One array of longs with a bit set for each hash, as a scalar subquery."""
    bits = hashes.select(_place(F.col("hash"), longs).alias("i"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("hash").bitwiseAND(63).cast("int")).alias("b"))
    all_longs = hashes.sparkSession.range(longs).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("b"))
    whole = bits.unionByName(all_longs).groupBy("i").agg(F.bit_or("b").alias("b"))
    # ``longs`` rows, at most MOST_LONGS
    return whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "b"))), lambda x: x["b"]).alias("bitmap")).scalar()


def _place(h: Column, longs: int) -> Column:
    return F.shiftrightunsigned(h, 6).bitwiseAND(longs - 1)


def _near(m: int, longs: int) -> Column:
    """(start, m, win) of the spans whose kept hash is in the bitmap."""
    bit = lambda x: F.call_function("shiftright", F.get(F.col(f"bits_{m}"), _place(x, longs)), x.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
    kind = "array<struct<start:int,m:int,win:string>>"
    told = lambda kept, hits: F.filter(F.transform(kept, lambda x, i: F.when(F.array_contains(hits, x), F.struct(i.alias("start"), F.lit(m).alias("m"), _text(i, m).alias("win")))), lambda x: x.isNotNull())
    # a document has far fewer kept hashes than spans, and mostly none of them is in the bitmap
    return _let(_kept(m), lambda kept: _let(F.filter(F.array_distinct(kept), bit), lambda hits: F.when(F.size(hits) > 0, told(kept, hits)).otherwise(F.array().cast(kind))))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    A window is ``window`` consecutive words of an item, or a shorter item as a whole.  Words of a document
    inside any occurrence of a window are hit; spans lists them as merged (start, end) word places, end
    exclusive.  n_items counts the ids of items with an occurring window, items_sha256 hashes those ids, sorted as
    strings and joined by commas.

    Null, empty and word-less texts have no words and no hits; such items have no windows.  Rows repeated
    under an id, and null ids, are rows of their own; items repeated under an id are one item with the
    windows of all, a null item id is written as empty text.  Without items no row is hit; an empty table
    gives no rows.  Other columns are not read.
    """
    windows = item_windows(items, item_id, item_text, window)
    counts = {r[0]: r[1] for r in windows.groupBy("m").agg(F.countDistinct("hash")).collect()}  # ``window`` rows at most
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words_of(text_col).alias("words"))
    found = F.array().cast("array<struct<start:int,m:int,win:string>>")
    for m, n in sorted(counts.items()):
        longs = min(MOST_LONGS, 1 << max(4, (BITS_PER_HASH * n // 64 - 1).bit_length()))
        bitmap = _bitmap(windows.filter(F.col("m") == m).select("hash"), longs)
        rows = rows.withColumn(f"bits_{m}", bitmap).withColumn(f"near_{m}", _near(m, longs))
    found = F.concat(found, *(F.col(f"near_{m}") for m in sorted(counts)))
    rows = written(rows.select("row", "id", F.size("words").cast("long").alias("n_words"), found.alias("found")), "decontamination")
    known = written(windows.groupBy("m", "win").agg(F.count("*").alias("n")), "windows")
    spans = rows.select("row", F.explode("found").alias("x")).select("row", "x.start", "x.m", "x.win")
    small = windows.count() <= SMALL
    hits = written(spans.join(F.broadcast(known), ["m", "win"]) if small else skew_join(written(spans, "spans"), known, ["m", "win"]), "hits")
    # spans merge in order: (end so far, list)
    pieces = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("m")).alias("end"))))
    kind = "array<struct<start:int,end:int>>"
    last = lambda a: F.element_at(a, -1)
    joined = lambda a, x: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["end"] >= x["start"]), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], x["end"]).alias("end"))))).otherwise(F.concat(a, F.array(x)))
    covered = hits.groupBy("row").agg(pieces.alias("pieces")).select("row", F.aggregate("pieces", F.array().cast(kind), joined).alias("spans"))
    which = hits.select("row", "m", "win").distinct()
    owners = windows.select("m", "win", "item")
    pairs = which.join(F.broadcast(owners) if small else owners.hint("merge"), ["m", "win"]).select("row", "item").distinct()
    named = pairs.groupBy("row").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("ids"))
    out = rows.select("row", "id", "n_words").join(covered.join(named.hint("merge"), "row").hint("merge"), "row", "left")
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]), F.lit(0).cast("long"))
    out = out.select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce("ids", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        F.col("ids").isNotNull().alias("contaminated"), F.coalesce("spans", F.array().cast(kind)).alias("spans"),
    )
    return out


def op13_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contract: ten-word windows of all benchmark items in all documents."""
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("spans")


_W = rf"regexp_extract_all(translate(coalesce(text, ''), '{_ALPHA}', '{_ALPHA.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
with i as (select coalesce(cast(item_id as varchar), '') as item, {_W} as w from benchmark
), v as (
  select distinct item, least(len(w), 10) as m, unnest([array_to_string(w[s + 1:s + least(len(w), 10)], ' ') for s in range(len(w) - least(len(w), 10) + 1)]) as win from i where len(w) > 0
), d as (select doc_id, row_number() over () as row, {_W} as w from documents
), p as (
  select row, s, m, array_to_string(w[s + 1:s + m], ' ') as win from (select row, w, m, unnest(range(greatest(len(w) - m + 1, 0))) as s from d, (select distinct m from v))
), h as (select p.row, p.s, p.m, v.item from p join v on p.m = v.m and p.win = v.win
), c as (select row, count(distinct x) as n_hit from (select row, unnest(range(s, s + m)) as x from h) group by row
), n as (select row, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct row, item from h) group by row)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, ids is not null as contaminated
from d left join c using (row) left join n using (row)
"""
