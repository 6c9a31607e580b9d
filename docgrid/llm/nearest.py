"""Nearest neighbours with a vantage-point tree per shard.

A shard's tree is a row of a table: the vectors in tree order and, per node, its range, its outer child,
the largest distance inside and the least outside.  A block of queries walks a tree together.  By
the triangle inequality a side cannot hold anything nearer than the gap between the query's distance
to the vantage point and that side; it is left out when factor * gap exceeds the distance of the k-th
nearest so far.  Factor one is exact search, larger factors leave out more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgrid.llm.common import read_table, written
from docgrid.llm.near_vectors import valid_vector

#: Bytes of a shard's vectors, points of a leaf, queries of a block, and blocks that one copy of a tree serves.
SHARD_BYTES, LEAF, QUERY_BLOCK, BLOCKS_PER_TREE = 4 << 20, 128, 256, 64
FACTOR = 1.5


def build(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, nodes, gaps): nodes are (start, end, outer) in preorder, outer the place of the outer child or -1 for a leaf; gaps (inner max, outer min)."""
    order, nodes, gaps = np.arange(len(x)), [], []

    def grow(s: int, e: int) -> None:
        if e - s <= leaf:
            nodes.append((s, e, -1))
            gaps.append((0.0, 0.0))
            return
        part = order[s:e]
        d = np.sqrt(((x[part] - x[part].mean(0)) ** 2).sum(1))
        pick = int(d.argmax())  # far from the middle: distances from there spread most
        part[[0, pick]] = part[[pick, 0]]
        d = np.sqrt(((x[part[1:]] - x[part[0]]) ** 2).sum(1))
        by = np.argsort(d, kind="stable")
        order[s + 1 : e], d = part[1:][by], d[by]
        half = len(d) // 2
        at = len(nodes)
        nodes.append((s, e, -1))
        gaps.append((float(d[half - 1]), float(d[half])))
        grow(s + 1, s + 1 + half)
        nodes[at] = (s, e, len(nodes))
        grow(s + 1 + half, e)

    grow(0, len(x))
    return order, np.array(nodes, np.int64), np.array(gaps)


class Search:
    """A block of queries in one tree: after run(), dist and ids hold the k best per query (inf and -1 where there are fewer)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, nodes: np.ndarray, gaps: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, factor: float):
        self.own, self.x, self.nodes, self.gaps, self.qid, self.q, self.k, self.factor = ids, x, nodes, gaps, query_ids, q, k, factor
        self.dist, self.ids = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        self.xx, self.qq = (x * x).sum(1), (q * q).sum(1)

    def offer(self, act: np.ndarray, s: int, e: int) -> None:
        """Points s..e are candidates of the active queries; those that may count are measured exactly."""
        about = self.qq[act][:, None] + self.xx[s:e] - 2 * self.q[act] @ self.x[s:e].T
        scale = 1e-9 * (self.qq[act][:, None] + self.xx[s:e] + 1e-300)
        i, j = np.nonzero((about - scale <= self.dist[act, -1][:, None] ** 2) & (self.own[s:e] != self.qid[act][:, None]))
        if not len(i):
            return
        d = np.full((len(act), e - s), np.inf)
        d[i, j] = np.sqrt(((self.q[act[i]] - self.x[s + j]) ** 2).sum(1))
        d = np.concatenate([self.dist[act], d], 1)
        ids = np.concatenate([self.ids[act], np.broadcast_to(self.own[s:e], (len(act), e - s))], 1)
        best = np.lexsort((ids, d), axis=-1)[:, : self.k]
        self.dist[act], self.ids[act] = np.take_along_axis(d, best, 1), np.take_along_axis(ids, best, 1)

    def visit(self, at: int, act: np.ndarray) -> None:
        if not len(act):
            return
        s, e, outer = self.nodes[at].tolist()
        if outer < 0:
            self.offer(act, s, e)
            return
        self.offer(act, s, s + 1)
        inner = at + 1
        d = np.sqrt(((self.q[act] - self.x[s]) ** 2).sum(1))
        most, least = self.gaps[at]
        near = d <= (most + least) / 2
        self.visit(inner, act[near])
        self.visit(outer, act[~near])
        slack = 1e-12 * (1 + d)
        self.visit(outer, act[near & (self.factor * (least - d) - slack <= self.dist[act, -1])])
        self.visit(inner, act[~near & (self.factor * (d - most) - slack <= self.dist[act, -1])])

    def run(self) -> None:
        self.visit(0, np.arange(len(self.q)))


def _points(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, dim, vec) of the valid vectors; of rows repeated under one id the least vector."""
    rows = vectors.filter(F.col(id_col).isNotNull() & valid_vector(vec_col)).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return rows.groupBy("id").agg(F.min("vec").alias("vec")).select("id", F.size("vec").alias("dim"), "vec")


def tree_index(points: DataFrame, sizes: DataFrame, leaf: int = LEAF) -> DataFrame:
    """One row per shard: dim, shard, ids, x, nodes, gaps, of points (id, dim, vec).  Every point is in; sizes: (dim, shards)."""

    def grow(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        x = t["vec"].combine_chunks().values.to_numpy().reshape(len(t), -1)
        order, nodes, gaps = build(x, leaf)
        lists = [t["id"].to_numpy()[order], x[order].ravel(), nodes.ravel(), gaps.ravel()]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), *(pa.array([v]) for v in lists)], ["dim", "shard", "ids", "x", "nodes", "gaps"])

    dealt = points.join(F.broadcast(sizes), "dim").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")))
    return dealt.groupBy("dim", "shard").applyInArrow(grow, "dim int, shard long, ids array<long>, x array<double>, nodes array<long>, gaps array<double>")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", factor: float = FACTOR, shard_bytes: int = SHARD_BYTES, query_block: int = QUERY_BLOCK, blocks_per_tree: int = BLOCKS_PER_TREE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest vectors of each query other than its own id.

    Euclidean distance in double precision, ties to the smaller id.  Null, zero, empty and non-finite
    vectors and null ids take no part, as query or candidate; vectors meet those of their own length.
    Of rows repeated under one id the least vector (by its components in order) counts, once.  With
    fewer than k candidates all are told; empty tables give no rows.  Other columns are not read, so
    their names cannot clash.

    Shards hold about shard_bytes of vectors.  A tree goes once to each task that has its share of
    blocks_per_tree blocks of queries, which are read as a stream behind it.
    """
    points = written(_points(vectors, id_col, vec_col), "points")
    # a row per vector length: no more than the longest vector has components
    sizes = written(points.groupBy("dim").agg(F.count("*").alias("n")).select("dim", F.ceil(F.col("n") * F.col("dim") * 8 / shard_bytes).alias("shards")), "shards")
    trees = written(tree_index(points, sizes), "trees")
    ask = written(_points(queries, id_col, vec_col), "queries")
    blocks = max(1, -(-ask.count() // query_block))
    parts = -(-blocks // blocks_per_tree)
    asked = ask.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy("dim", "block").agg(F.sort_array(F.collect_list(F.struct("id", "vec"))).alias("q"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    asked = asked.join(F.broadcast(sizes), "dim").select("dim", every(F.col("shards")).alias("shard"), (F.col("block") % parts).alias("part"), F.col("q.id").alias("qid"), F.flatten("q.vec").alias("q"))
    trees = trees.select("dim", "shard", every(F.lit(parts).cast("long")).alias("part"), "ids", "x", "nodes", "gaps")
    rows = trees.unionByName(asked, allowMissingColumns=True).withColumn("is_block", F.col("qid").isNotNull())
    # as many tasks as there are trees to send, but not more than four times the usual number
    tasks = min(4 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts * (sizes.agg(F.sum("shards")).first()[0] or 1))
    rows = rows.repartition(tasks, "dim", "shard", "part").sortWithinPartitions("dim", "shard", "part", "is_block").select("dim", "ids", "x", "nodes", "gaps", "qid", "q")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: tuple[np.ndarray, ...] = ()
        for b in batches:
            for r in range(b.num_rows):
                dim = b.column(0)[r].as_py()
                ids, x, nodes, gaps, qid, q = (b.column(c)[r].values for c in range(1, 7))
                if qid is None:
                    tree = ids.to_numpy(), x.to_numpy().reshape(-1, dim).copy(), nodes.to_numpy().reshape(-1, 3), gaps.to_numpy().reshape(-1, 2)
                    continue
                s = Search(*tree, qid.to_numpy(), q.to_numpy().reshape(-1, dim), k, factor)
                s.run()
                i, j = np.nonzero(np.isfinite(s.dist))
                yield pa.RecordBatch.from_arrays([pa.array(s.qid[i]), pa.array(s.ids[i, j]), pa.array(s.dist[i, j])], ["query_id", "vec_id", "score"])

    found = rows.mapInArrow(search, "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest(spark, sf_dir: str) -> DataFrame:
    """Contract: ten nearest of every vector whose id is divisible by 100."""
    vectors = read_table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


#: The exact answer; on tables of one shard the search leaves nothing out that belongs to it.
OP5_SQL = """
with v as (
  select vec_id, embedding::double[] as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), d as (
  select q.vec_id as query_id, c.vec_id, list_distance(q.e, c.e) as score from v q join v c on c.vec_id <> q.vec_id and len(c.e) = len(q.e) where q.vec_id % 100 = 0
)
select query_id, cast(rank as int) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score, vec_id) as rank from d) where rank <= 10
"""
