"""Merkle manifest of a data set, with a proof for every row by pointer jumping.

Leaves hash the rows; eight neighbours give a node, per language up to a subroot and over the
languages up to the root.  Every node above the leaves holds the siblings it meets on the way to
an ancestor.  A self-join hands each node its ancestor's own segment, so the distance doubles and
a tree of height h needs log2(h) rounds; leaves then take the segment of the node above them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrid.llm.common import discard, read_table, written

FAN = 8
#: Digits of the fan-out that share a copy of their ancestor in a self-join: at most 8^3 rows a key.
BLOCK = FAN**3
#: Rows of a table with one row a run and partition up to which it is broadcast (about 10 MB); beyond it is merged.
SMALL = 100_000
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_ALPHA = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _h(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def record_hash(values: dict[str, Column]) -> Column:
    """Leaf of a record: each value as '-' if null, else its UTF-8 byte count, ':' and itself."""
    text = [v.cast("string") for v in values.values()]
    return _h(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text))


def _ranked(leaves: DataFrame) -> DataFrame:
    """Written leaves (g, id, leaf, other, row) with rank (from 0 in their group g), n (the group's size) and t (the group's number).

    Rows are range-sorted by group and id, so a group of any size is many tasks; a row's rank is its place
    in its partition behind what earlier partitions hold of its group.
    """
    order = ["g", F.col("id").asc_nulls_first(), "leaf", "row"]
    # ids of one partition count its rows in order, and later ranges have higher partitions
    rows = written(leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "leaves").withColumn("part", F.shiftright("at", 33))
    runs = rows.groupBy("g", "part").agg(F.min("at").alias("lo"), F.count("*").alias("c"))
    own = Window.partitionBy("g")
    runs = runs.withColumns({"before": F.coalesce(F.sum("c").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("c").over(own)})
    runs = written(runs, "runs")
    groups = _numbered(runs.select("g").distinct())
    runs = written(runs.join(groups.hint("merge"), "g").select("g", "part", "lo", "before", "n", "t"), "runs")
    runs = F.broadcast(runs) if runs.count() <= SMALL else runs.hint("merge")
    return rows.join(runs, ["g", "part"]).select("t", (F.col("at") - F.col("lo") + F.col("before")).alias("rank"), "n", "id", "leaf", "other")


def _numbered(groups: DataFrame) -> DataFrame:
    """(g, t): groups numbered from 0 in their order, by ranges."""
    rows = written(groups.repartitionByRange("g").sortWithinPartitions("g").withColumn("at", F.monotonically_increasing_id()), "groups").withColumn("part", F.shiftright("at", 33))
    sizes = rows.groupBy("part").agg(F.count("*").alias("c"))
    # one row a partition
    sizes = sizes.select("part", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(sizes), "part").select("g", (F.col("at") - F.shiftleft("part", 33) + F.col("base")).alias("t"))


def _parents(nodes: DataFrame, name: str) -> DataFrame:
    """Written (t, i, n, kids) one level above nodes (t, i, n, hash) of trees that go on; n counts the nodes of the new level."""
    kids = F.array_sort(F.collect_list(F.struct("i", "hash")))
    up = nodes.groupBy("t", F.floor(F.col("i") / FAN).alias("up"), "n").agg(kids.alias("kids"))
    return written(up.select("t", F.col("up").alias("i"), F.ceil(F.col("n") / FAN).alias("n"), "kids"), name)


def _hash(kids: Column) -> Column:
    return _h(F.array_join(F.transform(kids, lambda x: x["hash"]), ""))


def _around(kids: Column, at: Column) -> list[Column]:
    """Texts of the siblings left and right of place ``at`` (from 0), in order."""
    name = lambda x: x["hash"]
    return [F.array_join(F.transform(F.slice(kids, F.lit(1), at), name), "").alias("left"), F.array_join(F.transform(F.slice(kids, at + 2, F.lit(FAN)), name), "").alias("right")]


def _levels(first: DataFrame, height: int, tree: str) -> tuple[DataFrame, DataFrame]:
    """(tops, links) of trees over first (t, i, n, hash), built level by level.

    tops: (t, level, hash) of each tree's last node.  links: (t, level, i, pl, pi, left, right), one per
    node below it, with the place of its parent.
    """
    nodes, tops, links = first, [], []
    for level in range(1, height + 1):
        tops.append(nodes.filter("n = 1").select("t", F.lit(level).alias("level"), "hash"))
        if level == height:
            break
        up = _parents(nodes.filter("n > 1"), f"{tree}-level")
        links.append(
            up.select("t", "i", "kids", F.posexplode("kids").alias("at", "kid"))
            .select("t", F.lit(level).alias("level"), F.col("kid.i").alias("i"), F.lit(level + 1).alias("pl"), F.col("i").alias("pi"), *_around(F.col("kids"), F.col("at")))
        )
        nodes = up.select("t", "i", "n", _hash(F.col("kids")).alias("hash"))
    out_tops, out_links = tops[0], None
    for x in tops[1:]:
        out_tops = out_tops.unionByName(x)
    for x in links:
        out_links = x if out_links is None else out_links.unionByName(x)
    if out_links is None:
        out_links = first.limit(0).select("t", F.lit(1).alias("level"), "i", F.lit(1).alias("pl"), F.col("i").alias("pi"), F.col("hash").alias("left"), F.col("hash").alias("right"))
    return out_tops, out_links


def _height(n: int) -> int:
    """Levels from runs of leaves (1) up to a single node."""
    h, n = 1, -(-n // FAN)
    while n > 1:
        h, n = h + 1, -(-n // FAN)
    return h


_KEY = ["t", "level", "i"]


def _jump(nodes: DataFrame) -> DataFrame:
    """Every node that has not reached the root takes its ancestor's segment and ancestor: the distance doubles.

    An ancestor at distance d has up to 8^d nodes below it, so it is copied once to each block of BLOCK of
    them before they meet.
    """
    going = nodes.filter("root is null").withColumn("block", F.floor(F.col("i") / BLOCK))
    need = going.select("at", "al", "ai", F.col("t").alias("bt"), F.col("level").alias("bl"), "block").distinct()
    upper = nodes.select(F.col("t").alias("at"), F.col("level").alias("al"), F.col("i").alias("ai"), F.struct("at", "al", "ai").alias("up"), F.col("seg").alias("more"), F.col("subroot").alias("usub"), F.col("root").alias("uroot"))
    copies = need.join(upper.hint("merge"), ["at", "al", "ai"])
    met = going.join(copies.select(F.col("bt").alias("t"), F.col("bl").alias("level"), "block", "at", "al", "ai", "up", "more", "usub", "uroot").hint("merge"), ["at", "al", "ai", "t", "level", "block"])
    moved = met.select(*_KEY, F.col("up.at").alias("at"), F.col("up.al").alias("al"), F.col("up.ai").alias("ai"), F.concat("seg", "more").alias("seg"), F.coalesce("subroot", "usub").alias("subroot"), F.col("uroot").alias("root"))
    return moved.unionByName(nodes.filter("root is not null"))


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", group_col: str = "lang", altered: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of docs: id_col, leaf, subroot, root, siblings, proof_sha256, folded_root, verified.

    columns are hashed in order.  ``altered`` gives columns of a later state of the rows (default: none):
    folded_root is what the proof makes of that state, verified whether it is the root.  siblings has the
    (left, right) digests level by level, those in the run of leaves first.

    A null value is hashed as '-', so null and empty text differ; a null group is a group of its own, first in
    order, and null ids stand first in it.  Rows repeated under an id are leaves of their own, ordered by
    their leaf; equal rows have equal leaves, and their proofs belong to their places.  An empty table gives no rows; other columns are
    not read.
    """
    if docs.schema[group_col].dataType.simpleString() != "string":
        raise ValueError("the group must be a string, which is ordered bytewise")
    now = {c: F.col(c) for c in columns}
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("s"), F.col(group_col)), F.lit("n")).alias("g"), F.col(id_col).alias("id"),
        F.unhex(record_hash(now)).alias("leaf"), F.unhex(record_hash(now | (altered or {}))).alias("other"), F.monotonically_increasing_id().alias("row"),
    )
    ranked = _ranked(written(leaves, "hashes"))
    text = lambda c: F.lower(F.hex(c))
    leaf = F.struct("rank", text("leaf").alias("hash"), "id", text("other").alias("other"))
    runs = ranked.groupBy("t", F.floor(F.col("rank") / FAN).alias("i"), "n").agg(F.array_sort(F.collect_list(leaf)).alias("kids"))
    runs = written(runs, "runs")
    # a lone leaf is its group's subroot as it is
    first = runs.select("t", "i", F.ceil(F.col("n") / FAN).alias("n"), F.when(F.col("n") == 1, F.col("kids")[0]["hash"]).otherwise(_hash(F.col("kids"))).alias("hash"))
    size = runs.agg(F.max("n"), F.max("t")).first()
    height, groups = _height(size[0] or 1), (size[1] or 0) + 1
    tops, links = _levels(first, height, "group")
    tops = written(tops, "subroots")
    # the subroots are the leaves of one more tree, of number -1: its level 1 is made of them
    over = tops.select(F.lit(-1).cast("long").alias("t"), F.col("t").alias("i"), F.lit(groups).cast("long").alias("n"), "hash")
    if groups > 1:
        top = _parents(over, "top-level")
        ends, above = _levels(top.select("t", "i", "n", _hash(F.col("kids")).alias("hash")), _height(groups), "top")
        into = top.select("i", "kids", F.posexplode("kids").alias("at", "kid")).select(F.col("kid.i").alias("t"), F.col("i").alias("pi"), F.col("kid.hash").alias("subroot"), *_around(F.col("kids"), F.col("at")))
        into = into.join(tops.select("t", "level").hint("merge"), "t")
    else:
        ends, above, into = tops, None, None
    none = F.lit(None).cast("string")
    one = F.array(F.struct("left", "right")).alias("seg")
    nodes = links.select(*_KEY, F.col("t").alias("at"), F.col("pl").alias("al"), F.col("pi").alias("ai"), one, none.alias("subroot"), none.alias("root"))
    end_t = F.lit(-1).cast("long") if groups > 1 else F.col("t")
    empty = F.array().cast("array<struct<left:string,right:string>>")
    nothing = [F.lit(None).cast(k).alias(c) for c, k in (("at", "long"), ("al", "int"), ("ai", "long"))]
    nodes = nodes.unionByName(ends.select(end_t.alias("t"), "level", F.lit(0).cast("long").alias("i"), *nothing, empty.alias("seg"), (F.col("hash") if groups == 1 else none).alias("subroot"), F.col("hash").alias("root")))
    if groups > 1:
        far = F.lit(-1).cast("long")
        nodes = nodes.unionByName(into.select("t", "level", F.lit(0).cast("long").alias("i"), far.alias("at"), F.lit(1).alias("al"), F.col("pi").alias("ai"), one, "subroot", none.alias("root")))
        nodes = nodes.unionByName(above.select(*_KEY, far.alias("at"), F.col("pl").alias("al"), F.col("pi").alias("ai"), one, none.alias("subroot"), none.alias("root")))
    nodes = written(nodes, "segments")
    for _ in range((height + (_height(groups) if groups > 1 else 0)).bit_length()):
        old, nodes = nodes, written(_jump(nodes), "segments")
        discard(old)
        if nodes.filter("root is null").isEmpty():
            break
    paths = nodes.filter("level = 1 and t >= 0").select("t", "i", "seg", "subroot", "root")
    met = runs.join(paths.hint("merge"), ["t", "i"]).select("n", "kids", "seg", "subroot", "root", F.posexplode("kids").alias("at", "kid"))
    left, right = _around(F.col("kids"), F.col("at"))
    rows = met.select("n", F.col("kid.id").alias("id"), F.col("kid.hash").alias("leaf"), F.col("kid.other").alias("other"), "subroot", "root", F.when(F.col("n") > 1, F.concat(F.array(F.struct(left, right)), "seg")).otherwise(F.col("seg")).alias("siblings"))
    folded = F.aggregate("siblings", F.col("other"), lambda acc, x: _h(x["left"], acc, x["right"]))
    proof = _h(F.array_join(F.transform("siblings", lambda x: F.concat(x["left"], x["right"])), ""))
    rows = rows.select(F.col("id").alias(id_col), "leaf", "subroot", "root", "siblings", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    """Contract: proofs of all documents; every third by crc32 of its id is tampered with by lower-casing A-Z (a null id is left alone)."""
    docs = read_table(spark, sf_dir, "documents")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    altered = {"text": F.when(hit, F.translate("text", _ALPHA, _ALPHA.lower())).otherwise(F.col("text"))}
    return manifest(docs, altered=altered).drop("siblings")


#: crc32 of an ASCII text column {0}, as DuckDB has no such function: bitwise, reversed polynomial 0xEDB88320.
CRC_SQL = """xor(list_reduce(list_concat([4294967295], list_transform(string_split({0}, ''), lambda ch: cast(ascii(ch) as bigint))),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [cast(k as bigint) for k in range(8)]), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)), 4294967295)"""
_F = "coalesce(strlen(cast({0} as varchar)) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_F.format(c) for c in COLUMNS[:4]) + " || " + _F.format("{0}") + ")"
OP12_SQL = f"""
with recursive d as (
  select *, case when {CRC_SQL.format("cast(doc_id as varchar)")} % 3 = 0 then translate(text, '{_ALPHA}', '{_ALPHA.lower()}') else text end as later from documents
), e as (
  select doc_id, {_LEAF.format("text")} as leaf, {_LEAF.format("later")} as other, dense_rank() over (order by lang nulls first) - 1 as t,
    row_number() over (partition by lang order by doc_id nulls first) - 1 as rank, count(*) over (partition by lang) as n
  from d
), a as (
  select t, 0 as l, rank as i, n, leaf as h from e
  union all select t, l + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' order by i)) from a where n > 1 group by t, l, i // 8, n
), s as (select t, l as top, h from a where n = 1), b as (
  select 0 as l, t as i, (select count(*) from s) as n, h from s
  union all select l + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' order by i)) from b where n > 1 group by l, i // 8, n
), x as (
  select x.t, x.l, x.i, coalesce(string_agg(y.h, '' order by y.i) filter (y.i < x.i), '') as lh, coalesce(string_agg(y.h, '' order by y.i) filter (y.i > x.i), '') as rh
  from a x join a y on x.t = y.t and x.l = y.l and x.i // 8 = y.i // 8 where x.n > 1 group by x.t, x.l, x.i
), z as (
  select x.l, x.i, coalesce(string_agg(y.h, '' order by y.i) filter (y.i < x.i), '') as lh, coalesce(string_agg(y.h, '' order by y.i) filter (y.i > x.i), '') as rh
  from b x join b y on x.l = y.l and x.i // 8 = y.i // 8 where x.n > 1 group by x.l, x.i
), p as (
  select doc_id, leaf, e.t, 0 as l, rank as i, s.top, s.h as subroot, other as f, '' as proof, false as up from e join s on e.t = s.t
  union all
  select doc_id, leaf, p.t, case when p.up or p.l < p.top then p.l + 1 else 0 end, case when p.up or p.l < p.top then p.i // 8 else p.t end, top, subroot,
    case when p.up then sha256(z.lh || f || z.rh) when p.l < p.top then sha256(x.lh || f || x.rh) else f end,
    proof || case when p.up then z.lh || z.rh when p.l < p.top then x.lh || x.rh else '' end, p.up or p.l = p.top
  from p left join x on x.t = p.t and x.l = p.l and x.i = p.i and not p.up left join z on z.l = p.l and z.i = p.i and p.up
  where not p.up or p.l < (select max(l) from b)
), r as (select h as root, l as high from b where n = 1)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, f as folded_root, f = root as verified from p, r where p.up and p.l = r.high
"""
