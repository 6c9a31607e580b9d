"""Near-duplicate vectors by Euclidean p-stable hashing.

A table hashes a normalised vector by several Gaussian projections, shifted and cut into steps of
WIDTH; vectors of one label that fall together in any table are compared by exact cosine.  The numbers
of tables and projections follow from the size of the largest label, at a fixed chance of missing a
pair at the threshold, so work grows as a power of about 1.2 of a label.  A pair is counted in the
first table where it meets, so no list of pairs is needed: each comparison task hands on link counts
and a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, exp, log, log1p, pi, sqrt
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrid.llm.common import counted_join, mix, read_table, skew_join, written
from docgrid.llm.components import components, components_sql, pairs_within, sorted_groups

WIDTH = 3.0
#: Chance that all tables miss a pair at the threshold; a nearer pair is missed less often.
MISS = 0.001
#: Comparisons that cost as much as a row of one table.
ROW_COST = 100
#: Vectors of a bucket in a block; larger buckets become cells of two blocks.
BLOCK = 1024
SMALL = 48


def valid_vector(vec: str | Column) -> Column:
    """Not null, not zero, and every component finite and not null."""
    v = F.col(vec) if isinstance(vec, str) else vec
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & F.coalesce(F.forall(v, fine), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def meeting(distance: float, width: float = WIDTH) -> float:
    """Chance that one projection puts two points of that distance into the same step."""
    u = width / distance
    return 1 - 2 * NormalDist().cdf(-u) - 2 / (sqrt(2 * pi) * u) * (1 - exp(-u * u / 2))


def hash_shape(n: int, cosine: float, width: float = WIDTH, miss: float = MISS) -> tuple[int, int]:
    """(tables, projections a table) with the least work for n unrelated unit vectors of one label."""
    near, far = meeting(sqrt(max(1e-6, 2 - 2 * cosine)), width), meeting(sqrt(2), width)
    tables = {k: ceil(log(miss) / log1p(-(near**k))) for k in range(2, 65)}
    best = min(tables, key=lambda k: tables[k] * (ROW_COST * n + n * n / 2 * far**k))
    return tables[best], best


@lru_cache(maxsize=8)
def _projections(dim: int, tables: int, per_table: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([dim, tables, per_table])
    return rng.standard_normal((dim, tables * per_table)), rng.uniform(0, width, tables * per_table)


def codes(unit: np.ndarray, tables: int, per_table: int, width: float) -> np.ndarray:
    """Signed 32-bit bucket codes, one column a table."""
    a, b = _projections(unit.shape[1], tables, per_table, width)
    step = np.floor((unit @ a + b) / width).astype(np.int64).astype(np.uint64).reshape(len(unit), tables, per_table)
    h = np.zeros((len(unit), tables), np.uint64)
    for k in range(per_table):
        h = mix(h * np.uint64(0x100000001B3) + step[:, :, k])
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def local_forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For n nodes and links (i, j), the least node of each node's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def vector_links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.93, tables: int | None = None, per_table: int | None = None, width: float = WIDTH, block: int = BLOCK) -> DataFrame:
    """One row per vector: id_col, n_links, component_id, kept.

    Links join vectors of equal, not null label and equal length with cosine (double precision) at
    least ``cosine``; n_links counts the other vectors linked directly, component_id is the least id
    reachable.  Null, zero, empty and non-finite vectors and those without label or id link with
    nothing; a null id has a null component and is kept.  Rows that repeat an id with the same vector
    and label count once in n_links, and each comes back; ids are else taken as unique.  Components of
    any finite magnitude count, as a vector is scaled by a power of two first.  Other columns are not
    read, so their names cannot clash.  An empty table gives no rows.

    tables and per_table follow from the rows of the largest label (hash_shape) unless given.
    """
    v = F.col(vec_col)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("vec"), (F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & valid_vector(v)).alias("ok"))
    rows = rows.withColumn("v1", F.when(F.col("ok"), F.xxhash64("label", "vec"))).withColumn("v2", F.when(F.col("ok"), F.xxhash64(F.lit(1), "label", "vec")))
    if not (tables and per_table):
        largest = rows.filter("ok").groupBy("label").count().agg(F.max("count")).first()[0] or 1
        tables, per_table = hash_shape(largest, cosine, width)
    # copies first: one row a distinct vector, with the number of its ids
    single = rows.filter("ok").groupBy("id", "v1", "v2").agg(F.first("label").alias("label"), F.first("vec").alias("vec"))
    distinct = single.groupBy("v1", "v2").agg(F.min("id").alias("id"), F.count("*").alias("w"), F.xxhash64(F.first("label"), F.size(F.first("vec"))).alias("lab"), F.first("vec").cast("array<double>").alias("vec"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(5)
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            out = np.zeros((b.num_rows, tables), np.int32)
            for dim in np.unique(np.diff(ends)):
                own = np.flatnonzero(np.diff(ends) == dim)
                x = values[ends[own][:, None] + np.arange(dim)]
                x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
                out[own] = codes(x / np.sqrt((x * x).sum(1, keepdims=True)), tables, per_table, width)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), tables).cast(pa.list_(pa.int32()))], [*b.schema.names, "codes"])

    reps = written(distinct.mapInArrow(hashed, "v1 long, v2 long, id long, w long, lab long, vec array<double>, codes array<int>"), "vectors")
    narrow = reps.select("id", "lab", F.posexplode("codes").alias("t", "code")).select("id", "lab", (F.col("t") * F.lit(1 << 32) + F.col("code").cast("long").bitwiseAND(0xFFFFFFFF)).alias("key"))
    sizes = narrow.groupBy("lab", "key").agg(F.count("*").alias("n")).filter("n > 1").select("lab", "key", "n", F.ceil(F.col("n") / block).alias("blocks"))
    sizes = written(sizes, "cell-sizes")
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    cells = counted_join(narrow, sizes, ["lab", "key"], "n", tables * reps.count()).select("lab", "key", "id", own.alias("own"), F.explode(cells).alias("c")).select("lab", "key", "c.i", "c.j", "id", "own")
    wide = cells.join(reps.select("id", "w", "vec", "codes").hint("merge"), "id").select("lab", "key", "i", "j", "id", "own", "w", "vec", "codes")
    wide = wide.repartition("lab", "key", "i", "j").sortWithinPartitions("lab", "key", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, edges in sorted_groups(batches, 4, 2):
            key, bi, bj, ids, block_of, w = (t.column(k).to_numpy() for k in (1, 2, 3, 4, 5, 6))
            lists, code = t.column(7).combine_chunks(), t.column(8).combine_chunks().values.to_numpy().reshape(len(t), tables)
            start = lists.offsets.to_numpy()
            values, start = lists.values.to_numpy()[start[0] : start[-1]], start - start[0]
            power = np.frexp(np.maximum.reduceat(np.abs(values), start[:-1]))[1]  # no vector is empty
            values = np.ldexp(values, -np.repeat(power, np.diff(start)))  # exact, and squares neither overflow nor vanish
            n, found = edges[:, 1] - edges[:, 0], []
            small = edges[n <= SMALL]
            for at in range(0, len(small), 4096):  # many small groups at once
                i, j = pairs_within(small[at : at + 4096])
                found += [(i[at2 : at2 + 65536], j[at2 : at2 + 65536]) for at2 in range(0, len(i), 65536)]
            for s, e in edges[n > SMALL].tolist():
                x = values[start[s] : start[e]].reshape(e - s, -1)
                x = x / np.sqrt((x * x).sum(1, keepdims=True))
                for r in range(0, e - s, 512):
                    i, j = np.nonzero(x[r : r + 512] @ x.T >= cosine - 1e-6)
                    i = i + r
                    found.append((s + i[i < j], s + j[i < j]))
            links: list[tuple[np.ndarray, np.ndarray]] = []
            for i, j in found:
                good = (bi[i] == bj[i]) | (block_of[i] != block_of[j])  # a cell of two blocks compares across only
                i, j = i[good], j[good]
                for dim in np.unique((start[i + 1] - start[i])):
                    a, b = i[start[i + 1] - start[i] == dim], j[start[i + 1] - start[i] == dim]
                    x, y = values[start[a][:, None] + np.arange(dim)], values[start[b][:, None] + np.arange(dim)]
                    dot, xx, yy = (np.einsum("ij,ij->i", p, q) for p, q in ((x, y), (x, x), (y, y)))
                    near = dot / np.sqrt(xx * yy) >= cosine
                    a, b = a[near], b[near]
                    met = (code[a] == code[b]).argmax(1) == key[a] >> 32  # here first
                    links.append((a[met], b[met]))
            a = np.concatenate([x for x, _ in links]) if links else np.zeros(0, np.int64)
            b = np.concatenate([x for _, x in links]) if links else np.zeros(0, np.int64)
            count = np.zeros(len(t), np.int64)
            np.add.at(count, a, w[b])
            np.add.at(count, b, w[a])
            root = local_forest(len(t), a, b)
            use = count > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[use]), pa.array(count[use]), pa.array(ids[root][use])], ["id", "n", "root"])

    told = written(wide.mapInArrow(compare, "id long, n long, root long"), "vector-links")
    counts = told.groupBy("id").agg(F.sum("n").alias("n"))
    comps = written(components(told.select(F.col("id").alias("a"), F.col("root").alias("b"))), "components")
    by_rep = reps.select("v1", "v2", F.col("id").alias("rep"), "w").join(counts.withColumnRenamed("id", "rep").hint("merge"), "rep", "left").join(comps.withColumnRenamed("id", "rep").hint("merge"), "rep", "left")
    by_rep = by_rep.select("v1", "v2", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    keys = written(rows.select("id", "v1", "v2"), "keys")
    none = keys.filter("v1 is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = skew_join(keys.filter("v1 is not null"), by_rep, ["v1", "v2"], "left").select("id", "n_links", "component_id").union(none)
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col(id_col), F.lit(True)))


def op1_near_vectors(spark, sf_dir: str) -> DataFrame:
    """Contract: links of equal label with cosine 0.93 or more."""
    return vector_links(read_table(spark, sf_dir, "embeddings"))


OP1_SQL = f"""
with v as (
  select vec_id as id, label, embedding::double[] as e from embeddings
  where label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), l as (
  select x.id as a, y.id as b from v x join v y on x.label = y.label and x.id <> y.id and len(x.e) = len(y.e) where list_cosine_similarity(x.e, y.e) >= 0.93
), n as (select vec_id as id from embeddings), c as ({components_sql("n", "l")}), k as (select a as id, count(*) as n_links from l group by a)
select id as vec_id, coalesce(n_links, 0) as n_links, component as component_id, component = id as kept from c left join k using (id)
"""
