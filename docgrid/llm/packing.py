"""Best-fit packing of documents into sequences with several capacities.

A bin has residual tokens, documents and attention cost (the sum of squared lengths).  Pieces go,
longest first, to the open bin that holds them under every capacity and is best by the rule:
"norm" takes the least weighted norm of what would remain, "dot" the largest weighted dot product
of need and residual.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.llm.common import read_table, written
from docgrid.llm.tokens import TOKENIZER, encoder

SEQUENCE = 2048
END_ID = 0
#: Documents in a sequence at most, and its attention cost at most: as many as tokens and one full piece, so that neither costs a sequence unless set lower.
MAX_DOCS, MAX_COST = SEQUENCE, SEQUENCE * SEQUENCE
WEIGHTS = (1.0, 0.01, 0.01)
#: Pieces that one task packs together; groups are dealt by hash, so each is a fair sample of the lengths.
GROUP = 8192


def pack(lengths: np.ndarray, tokens: int = SEQUENCE, docs: int = MAX_DOCS, cost: int = MAX_COST, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in the bin) of each length; lengths must fit into an empty bin."""
    caps = np.array([tokens, docs, cost], float)
    w = np.array(weights) / (caps if rule == "dot" else caps * caps) / (caps if rule == "dot" else 1.0)
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left = np.zeros((3, 1024))  # residuals of the open bins
    names = np.zeros(1024, np.int64)
    n = made = 0
    for i in np.argsort(-lengths, kind="stable"):
        size = float(lengths[i])
        need = np.array([size, 1.0, size * size])
        best = -1
        if n:
            rest = left[:, :n] - need[:, None]
            fits = (rest >= 0).all(0)
            score = -(w @ (left[:, :n] * need[:, None])) if rule == "dot" else w @ (rest * rest)
            score[~fits] = np.inf
            best = int(score.argmin())
            if not fits[best]:
                best = -1
        if best < 0:
            if n == left.shape[1]:
                left, names = np.concatenate([left, np.zeros_like(left)], 1), np.concatenate([names, np.zeros_like(names)])
            best, n = n, n + 1
            left[:, best], names[best] = caps, made
            made += 1
        where[i], offset[i] = names[best], tokens - left[0, best]
        left[:, best] -= need
        if left[0, best] < 1 or left[1, best] < 1 or left[2, best] < 1:  # full
            n -= 1
            left[:, best], names[best] = left[:, n], names[n]
    return where, offset


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID, size: int = SEQUENCE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, the columns named in keep): documents with their end id, longer ones cut into full pieces after a first rest."""
    end = np.array([end_id], "<u4").tobytes()
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer).with_added
        for b in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for i, t in enumerate(b.column(1).to_pylist()):
                ids = ids_of(t) + end
                n = len(ids) // 4
                edges = [0, *range((n - 1) % size + 1, n + 1, size)]
                rows += [(i, k, s, e - s, zlib.crc32(ids[4 * s : 4 * e])) for k, (s, e) in enumerate(zip(edges, edges[1:]))]
            at, k, s, n, crc = np.array(rows, np.int64).reshape(-1, 5).T
            kept = [c.take(pa.array(at)) for c in b.columns[2:]]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(k.astype(np.int32)), *map(pa.array, (s, n, crc)), *kept], [id_col, "piece", "start", "length", "ids_crc32", *keep])

    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col(id_col), F.col(text_col).alias("text"), *keep).mapInArrow(cut, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long{kept}")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID, size: int = SEQUENCE, max_docs: int | None = None, max_cost: int | None = None, group: int = GROUP, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts make a piece of the end id alone; null ids and repeated rows are packed like
    any other; an empty table gives no rows.  A full piece is a sequence of its own; the others are
    packed in groups of about ``group`` pieces, so at most a few sequences a group stay partly empty.
    max_docs and max_cost bound the documents and the sum of squared lengths of a sequence (size and
    size * size unless given); a piece that costs more by itself is a sequence of its own.  Texts of any
    length are cut into pieces; among equally good sequences the first in the group's list is taken.
    Other columns are not read, so their names cannot clash.
    """
    max_docs, max_cost = max_docs or size, max_cost or size * size
    rows = written(pieces(docs, id_col, text_col, tokenizer, end_id, size), "pieces").withColumn("row", F.monotonically_increasing_id())
    single = (F.col("length") >= size) | (F.col("length") * F.col("length") > max_cost)
    full, open_ = rows.filter(single), rows.filter(~single)
    groups = max(1, -(-open_.count() // group))
    kind = docs.schema[id_col].dataType.simpleString()

    def fill(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("ids_crc32", "ascending"), ("row", "ascending")])
        where, offset = pack(t["length"].to_numpy(), size, max_docs, max_cost, weights, rule)
        own = pa.array((key[0].as_py() << 32) + where)
        return t.select([id_col, "piece", "start", "length", "ids_crc32"]).append_column("sequence_id", own).append_column("offset", pa.array(offset))

    packed = open_.withColumn("group", F.pmod(F.xxhash64("row", "ids_crc32"), F.lit(groups))).groupBy("group").applyInArrow(fill, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    alone = full.select(id_col, "piece", "start", "length", "ids_crc32", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)


def pack_in_order(docs: DataFrame, order_col: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID, size: int = SEQUENCE, max_docs: int | None = None, max_cost: int | None = None, group: int = GROUP, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> DataFrame:
    """pack_documents with the order of order_col kept: the same columns, and sequence ids that rise with it.

    Pieces stand by order_col (nulls first), then id and place in the document; stretches of ``group``
    of them are packed together, so a sequence never holds pieces of two stretches, and every sequence
    of a stretch has a lower id than those of the next.  In a stretch sequences follow their first piece.
    Nulls, repeated rows, empty tables and capacities are as in pack_documents.
    """
    max_docs, max_cost = max_docs or size, max_cost or size * size
    rows = written(pieces(docs, id_col, text_col, tokenizer, end_id, size, (order_col,)), "pieces")
    parts = max(1, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // group)))
    order = [order_col, id_col, "piece", "ids_crc32"]
    columns = [id_col, "piece", "start", "length", "ids_crc32"]

    def stretch(t: pa.Table, first: int) -> tuple[pa.Table, int]:
        lengths = t["length"].to_numpy()
        open_ = np.flatnonzero((lengths < size) & (lengths * lengths <= max_cost))
        where, offset = np.arange(len(lengths)), np.zeros(len(lengths), np.int64)
        if len(open_):
            bins, offset[open_] = pack(lengths[open_], size, max_docs, max_cost, weights, rule)
            start = np.full(bins.max() + 1, len(lengths))
            np.minimum.at(start, bins, open_)
            where[open_] = start[bins]  # a sequence goes by the place of its first piece
        names, where = np.unique(where, return_inverse=True)
        return t.select(columns).append_column("sequence_id", pa.array(first + where.astype(np.int64))).append_column("offset", pa.array(offset)), first + len(names)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, n = TaskContext.get().partitionId() << 40, [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            while n >= group:
                t = pa.Table.from_batches(held)
                out, first = stretch(t.slice(0, group), first)
                yield from out.combine_chunks().to_batches()
                held, n = t.slice(group).to_batches(), n - group
        if n:
            yield from stretch(pa.Table.from_batches(held), first)[0].combine_chunks().to_batches()

    kind = docs.schema[id_col].dataType.simpleString()
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return ranged.mapInArrow(fill, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """Contract: all documents in sequences of 2048 tokens."""
    return pack_documents(read_table(spark, sf_dir, "documents"))
