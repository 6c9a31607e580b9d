"""Connected components of links, and cells that compare large groups block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.llm.common import HOT, HOT_ROWS, discard, written


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """edges (u, v) with m of least (u, m, n) by u; hubs, a thousandth of all edges each, are not one task.

    n counts edges of u, and all n sum to 2 * total at most, so HOT hubs at most are broadcast.
    """
    limit = max(HOT_ROWS, 2 * total // HOT)
    hubs = F.broadcast(least.filter(F.col("n") > limit))
    return edges.join(hubs, "u").unionByName(edges.join(hubs, "u", "left_anti").join(least.filter(F.col("n") <= limit).hint("merge"), "u"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every node hands the least of its neighbourhood to its larger neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _with_least(both.filter(F.col("v") > F.col("u")), least, total).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Every node hands the least of its smaller neighbours to those neighbours and takes it itself."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_least(down, least, total).filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) of every id in links (a, b): component is the least id that can be reached.

    Alternates large and small stars until the edges stay as they are; each round is written to the
    shared folder, so a lost executor costs at most a round.
    """
    # the first step sees each link once
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    for _ in range(max_rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        before, old = state, edges
        stars = written(_large_star(edges, state[0]), "stars")
        edges = written(_small_star(stars, state[0]), "links")
        discard(stars)
        discard(old)
    raise RuntimeError("components did not settle")


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int, least: int = 1) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From rows sorted by their first columns (longs), tables of whole groups and the groups' edges.

    A table holds every group that ended in the batches read so far; only groups of at least ``least``
    rows are told.
    """
    held: list[pa.RecordBatch] = []

    def told(t: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray]]:
        cols = [t.column(k).to_numpy() for k in range(keys)]
        change = np.zeros(len(t), bool)
        change[0] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        ends = np.r_[starts[1:], len(t)]
        big = ends - starts >= least
        yield t, np.stack([starts[big], ends[big]], 1)

    for b in batches:
        if not b.num_rows:
            continue
        last = [b.column(k)[b.num_rows - 1].as_py() for k in range(keys)]
        same = np.ones(b.num_rows, bool)
        for k, v in enumerate(last):
            same &= b.column(k).to_numpy(zero_copy_only=False) == v
        cut = int(np.argmax(same))  # where the group that may go on begins
        if cut == 0 and held and all(held[-1].column(k)[held[-1].num_rows - 1].as_py() == v for k, v in enumerate(last)):
            held.append(b)
            continue
        done = pa.Table.from_batches([*held, b.slice(0, cut)]) if held or cut else None
        if done is not None and len(done):
            yield from told(done.combine_chunks())
        held = [b.slice(cut)]
    if held:
        yield from told(pa.Table.from_batches(held).combine_chunks())


def pairs_within(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs i < j inside each [start, end)."""
    start, n = edges[:, 0], edges[:, 1] - edges[:, 0]
    rows = np.repeat(start, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    more = np.repeat(edges[:, 1], n) - rows - 1
    i = np.repeat(rows, more)
    j = i + 1 + (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more))
    return i, j


def components_sql(nodes: str, links: str) -> str:
    """SQL for (id, component): the least id reachable, from tables of nodes (id) and of links (a, b) in both directions."""
    return f"""select id, min(far) as component from (
    with recursive reach(id, far) as (select id, id from {nodes} union select r.id, l.b from reach r join {links} l on l.a = r.far) select * from reach) group by id"""
