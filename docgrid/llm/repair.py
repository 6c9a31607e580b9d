"""Conversation structure repair by the auction algorithm for shortest paths.

A conversation's turns and what the roles so far allow make a lattice of nodes (turn, state) whose arcs
are edits with small integer costs.  Node prices start below the cost to the end; a path grows along
the cheapest arc while its node's price equals that arc's cost plus the next node's price, else the
price is raised to it and the path steps back.  At the end the path's arcs are tight under the
prices, which are exact along it, and as it always takes the ASCII-least of equal arcs, it is the
least of the cheapest edit sequences.

Long conversations are cut into chunks: auctions give each chunk's costs between states, a stream
over the chunks turns them into the cost behind each chunk, and auctions with those costs behind
them trace the chunks apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrid.llm.common import read_table, written
from docgrid.llm.merkle import CRC_SQL

#: Turns in a chunk, as a power of two.
CHUNK_BITS = 8
#: States: nothing yet, after the system turn, after a user's, after an assistant's turn.
_MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The state that an inserted or reroled turn leads to.
_TURN = (2, 2, 3, 2)
_REROLE, _DELETE, _INSERT, _TRUNCATED = 2, 3, 2, 1
#: Cost behind the last turn: only an empty conversation and one that ends with the assistant are whole.
_END = (0, None, None, 0)
_BLANKS = " \t\n\x0b\x0c\r"
_FAR = 1 << 60


def _arcs(codes: str, exits: tuple, last: bool, states: tuple[int, ...]) -> list[list[tuple[int, int, str]]]:
    """(next node, cost, letter) of node 4 * turn + state, by letter; the sink is the last node.

    codes has a sign for each turn: s, u, a, or o for other roles, upper case if truncated, x if it has to go.
    Turns may be inserted before each turn of the chunk, and behind the last one of a conversation.
    """
    n = len(codes)
    sink, out = 4 * (n + 1), [[] for _ in range(4 * (n + 1) + 1)]
    for i, code in enumerate(codes):
        extra = _TRUNCATED if code.isupper() else 0
        for q in states:
            arcs = [(4 * (i + 1) + q, _DELETE, "D")]
            if _TURN[q] in states:
                arcs.append((4 * i + _TURN[q], _INSERT, "I"))
            if code != "x":
                to = _MOVES.get((q, code.lower()))
                if to in states:
                    arcs.append((4 * (i + 1) + to, extra, "K"))
                if _TURN[q] in states:
                    arcs.append((4 * (i + 1) + _TURN[q], _REROLE + extra, "R"))
            out[4 * i + q] = arcs
    for q in states:
        if exits[q] is not None:
            out[4 * n + q].append((sink, exits[q], ""))
        if last and _TURN[q] in states:
            out[4 * n + q].append((4 * n + _TURN[q], _INSERT, "I"))
    return out


def _prices(codes: str, exits: tuple) -> list[int]:
    """First prices: what every turn costs at least, from each node on."""
    least = {"x": 3, "o": 2, "O": 3}
    rest = min(x for x in exits if x is not None)
    out = [rest] * (4 * (len(codes) + 1)) + [0]
    for i in range(len(codes) - 1, -1, -1):
        rest += least.get(codes[i], int(codes[i].isupper()))
        out[4 * i : 4 * i + 4] = [rest] * 4
    return out


def _auction(arcs: list, price: list[int], origin: int) -> list[tuple[int, str]] | None:
    """(node, letter) of the least cheapest path from origin to the last node; None if there is none.

    Prices stay for further origins.
    """
    sink, path, letters = len(arcs) - 1, [origin], []
    while path[-1] != sink:
        at = path[-1]
        best, to, letter = _FAR, -1, ""
        for j, cost, a in arcs[at]:
            if cost + price[j] < best:
                best, to, letter = cost + price[j], j, a
        if price[at] < best:
            price[at] = best
            if len(path) > 1:
                path.pop()
                letters.pop()
            elif best >= _FAR:
                return None
        elif best >= _FAR:
            return None
        else:
            path.append(to)
            letters.append(letter)
    return list(zip(path[1:], letters))


@lru_cache(maxsize=4096)
def _traces(codes: str, exits: tuple, last: bool, origins: tuple[int, ...] = (0, 1, 2, 3)) -> tuple[tuple[str, int, int], ...]:
    """(edits, exit state, cost) from each entry state, the cost behind the chunk included."""
    arcs, price, out = _arcs(codes, exits, last, (0, 1, 2, 3)), _prices(codes, exits), []
    for q in origins:
        path = _auction(arcs, price, q)
        out.append(("".join(a for _, a in path), (path[-2][0] if len(path) > 1 else q) % 4, price[q]))
    return tuple(out)


def _costs(codes: str) -> list[int | None]:
    """Least cost from each entry state to each exit state of a chunk, row by row."""
    out: list[int | None] = [None] * 16
    # a state is never left for an earlier one, and nothing leads back to the first two
    for to, states in ((0, (0,)), (1, (0, 1)), (2, (0, 1, 2, 3)), (3, (0, 1, 2, 3))):
        exits = tuple(0 if q == to else None for q in range(4))
        arcs, price = _arcs(codes, exits, False, states), _prices(codes, exits)
        for q in states:
            if (to != 1 or q == 1 or "s" in codes.lower()) and _auction(arcs, price, q) is not None:
                out[4 * q + to] = price[q]
    return out


def _fault(text: Column, seen: Column) -> Column:
    """1 blank, 2 duplicate, 3 truncated, 0 none."""
    bare = F.rtrim(text, F.lit(_BLANKS))
    return F.when(bare == "", 1).when(seen, 2).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), 3).otherwise(0)


def _placed(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Written (g, conv, turn, role, text, at): turns range-sorted by conversation, turn, role and text; ``at`` rises with the order."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.coalesce(F.concat(F.lit("c"), F.col(conv).cast("string")), F.lit("n")).alias("g"), F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), plain(role).alias("role"), plain(text).alias("text"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "turns")
    order = ["g", F.col("turn").asc_nulls_first(), "role", "text", "row"]  # the last one deals out equal rows
    return written(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("row").withColumn("at", F.monotonically_increasing_id()), "turns")


def _judged(placed: DataFrame) -> DataFrame:
    """Adds fault; a turn is seen before unless it is the first of its role and text in its conversation."""
    same = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    first = placed.select("g", same.alias("same"), "at").groupBy("g", "same").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    return written(placed.join(first.hint("merge"), "at", "left").withColumn("fault", _fault(F.col("text"), F.col("first").isNull())).drop("first"), "turns")


def _streamed(df: DataFrame, keys: list, f, kind: str) -> DataFrame:
    """df hashed by conversation and sorted by keys, read as a stream by f."""
    return df.repartition("g").sortWithinPartitions(*keys).mapInArrow(f, kind)


def _behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lo, codes, last, exits) from (g, chunk, lo, codes, last, costs), last chunks first: what it costs behind each chunk."""
    group, cost = None, None
    for b in batches:
        out = []
        for g, _, lo, codes, last, costs in zip(*(c.to_pylist() for c in b.columns)):
            if g != group:
                group, exits, cost = g, list(_END), costs[:4]
            else:
                exits = cost
                cost = [min(costs[4 * q + t] + exits[t] for t in range(4) if costs[4 * q + t] is not None) for q in range(4)]
            out.append((g, lo, codes, last, exits))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int64())))] if out else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int64()))], ["g", "lo", "codes", "last", "exits"])


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lo, edits) from (g, lo, traces) in order: each chunk is entered as the one before is left."""
    group, q = None, 0
    for b in batches:
        out: tuple[list, list] = ([], [])
        for g, lo, edits, ends in zip(*(c.to_pylist() for c in b.columns)):
            group, q = g, 0 if g != group else q
            out[0].append(lo)
            out[1].append(edits[q])
            q = ends[q]
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string())], ["lo", "edits"])


def _single(codes: pd.Series) -> pd.Series:
    return pd.Series([_traces(c, _END, True, (0,))[0][0] for c in codes])


def _chunk_costs(codes: pd.Series, last: pd.Series) -> pd.Series:
    return pd.Series([[x[2] for x in _traces(c, _END, True)] if end else _costs(c) for c, end in zip(codes, last)])


def _chunk_traces(codes: pd.Series, last: pd.Series, exits: pd.Series) -> pd.DataFrame:
    all_ = [_traces(c, tuple(None if pd.isna(x) else int(x) for x in e), bool(end)) for c, end, e in zip(codes, last, exits)]
    return pd.DataFrame({"edits": [[x[0] for x in t] for t in all_], "ends": [[x[1] for x in t] for t in all_]})


def _edits(judged: DataFrame, chunk_bits: int) -> DataFrame:
    """Written (at, edits): the edits of each chunk at its first turn."""
    initial = F.substring("role", 1, 1)
    sign = F.when(F.col("fault").isin(1, 2), "x").otherwise(F.when(initial.isin("s", "u", "a"), initial).otherwise("o"))
    code = F.struct("at", F.when(F.col("fault") == 3, F.upper(sign)).otherwise(sign).alias("c"))
    chunks = judged.groupBy("g", F.shiftright("at", chunk_bits).alias("chunk")).agg(F.min("at").alias("lo"), F.array_join(F.transform(F.array_sort(F.collect_list(code)), lambda x: x["c"]), "").alias("codes"))
    chunks = written(chunks, "chunks")
    ends = chunks.groupBy("g").agg(F.max("chunk").alias("end"), F.count("*").alias("n"))
    chunks = written(chunks.join(ends.hint("merge"), "g").select("g", "chunk", "lo", "codes", (F.col("chunk") == F.col("end")).alias("last"), "n"), "chunks")
    out = chunks.filter("n = 1").select(F.col("lo").alias("at"), F.pandas_udf(_single, "string")("codes").alias("edits"))
    parts = chunks.filter("n > 1")
    if not parts.isEmpty():
        costs = written(parts.select("g", "chunk", "lo", "codes", "last", F.pandas_udf(_chunk_costs, "array<long>")("codes", "last").alias("costs")), "chunk-costs")
        behind = _streamed(costs, ["g", F.desc("chunk")], _behind, "g string, lo long, codes string, last boolean, exits array<long>")
        traced = written(behind.select("g", "lo", F.pandas_udf(_chunk_traces, "edits array<string>, ends array<int>")("codes", "last", "exits").alias("t")).select("g", "lo", "t.edits", "t.ends"), "chunk-traces")
        out = out.unionByName(_streamed(traced, ["g", "lo"], _chosen, "lo long, edits string").withColumnRenamed("lo", "at"))
    return written(out, "edits")


class _Told:
    """What is known of a conversation while its turns pass; the repaired text goes into a running hash."""

    __slots__ = ("audit", "blank", "conv", "cost", "dup", "edits", "hash", "hi", "illegal", "lo", "place", "state", "trunc", "turns", "was")

    def __init__(self, conv):
        self.conv, self.hash = conv, hashlib.sha256()
        self.audit, self.edits, self.state, self.place, self.cost = [], iter(()), 0, 0, 0
        self.lo = self.hi = self.was = None
        self.turns = self.blank = self.dup = self.trunc = self.illegal = 0

    def say(self, role: str, text: str) -> tuple:
        self.hash.update(f"{chr(10) if self.place else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.place += 1
        return self.conv, self.place - 1, role, text

    def _turn(self) -> str:
        self.state = _TURN[self.state]
        return "user" if self.state == 2 else "assistant"

    def add(self, turn, role: str, text: str, fault: int, edits: str | None) -> Iterator[tuple]:
        """Repaired turns up to this one."""
        if edits is not None:
            yield from self.rest()
            self.audit.append(edits)
            self.edits = iter(edits)
        if turn is not None and turn != self.hi:
            self.turns, self.lo, self.hi = self.turns + 1, turn if self.lo is None else self.lo, turn
        self.blank, self.dup, self.trunc = self.blank + (fault == 1), self.dup + (fault == 2), self.trunc + (fault == 3)
        self.illegal += self.was is not None and self.was + role[:1] not in ("su", "ua", "au")
        self.was = role[:1]
        for a in self.edits:
            self.cost += {"K": 0, "R": _REROLE, "D": _DELETE, "I": _INSERT}[a] + _TRUNCATED * (fault == 3 and a in "KR")
            if a == "K":
                self.state = _MOVES[self.state, role[:1]]
                yield self.say(role, text)
            elif a == "R":
                yield self.say(self._turn(), text)
            elif a == "I":
                yield self.say(self._turn(), "")
                continue
            break

    def rest(self) -> Iterator[tuple]:
        """Turns inserted behind the last one."""
        for _ in self.edits:
            self.cost += _INSERT
            yield self.say(self._turn(), "")

    def row(self) -> tuple:
        gaps = 0 if self.lo is None else self.hi - self.lo + 1 - self.turns
        return self.conv, gaps, self.blank, self.dup, self.trunc, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def _walk(batches: Iterator[pa.RecordBatch], turns: bool) -> Iterator[pa.RecordBatch]:
    """Conversations, or their repaired turns, from turns in order; text is held for one batch only."""
    now, group, kind = None, None, None

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        names = ["conv", "place", "role", "text"] if turns else ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        types = [kind, *([pa.int64(), pa.string(), pa.string()] if turns else [pa.int64()] * 6 + [pa.string()] * 2)]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    for b in batches:
        kind, out = b.schema.field(1).type, []
        for g, conv, turn, role, text, fault, edits in zip(*(c.to_pylist() for c in b.columns)):
            if g != group:
                if now is not None:
                    said = list(now.rest())
                    out += said if turns else [now.row()]
                group, now = g, _Told(conv)
            for x in now.add(turn, role, text, fault, edits):
                if turns:
                    out.append(x)
        if out:
            yield batch(out)
    if now is not None:
        said = list(now.rest())
        if said or not turns:
            yield batch(said if turns else [now.row()])


def _solved(turns: DataFrame, conv: str, turn: str, role: str, text: str, chunk_bits: int, out_turns: bool) -> DataFrame:
    judged = _judged(_placed(turns, conv, turn, role, text))
    rows = judged.join(_edits(judged, chunk_bits).hint("merge"), "at", "left")
    kind = turns.schema[conv].dataType.simpleString()
    kind = f"conv {kind}, place long, role string, text string" if out_turns else f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    rows = rows.repartition("g").sortWithinPartitions("g", "at").select("g", "conv", "turn", "role", "text", "fault", "edits")
    return rows.mapInArrow(lambda x: _walk(x, out_turns), kind).withColumnRenamed("conv", conv)


def repairs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """One row per conversation of turns: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A conversation's turns stand by turn (nulls first), role and text.  audit spells the cheapest edits (Keep,
    Rerole, Delete, Insert) that leave an optional system turn and pairs of user and assistant, or nothing;
    of equally cheap ones the ASCII-least.

    Null roles and texts count as one space, so such a text is blank; null turns make no gaps; a null
    conversation is one like any other; equal rows are duplicates of the first; an empty table gives no
    rows; other columns are not read.  A conversation of any length is solved in chunks by many tasks;
    only its running hash and counts are one stream, as the hash of one text cannot be split.
    """
    return _solved(turns, conv, turn, role, text, chunk_bits, False)


def repaired_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """(conv, place from 0, role, text): the turns as ``repairs`` leaves them; its docstring holds for odd rows."""
    return _solved(turns, conv, turn, role, text, chunk_bits, True)


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with turns dropped, emptied, cut off, repeated or given to the user, by a hash of their place."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), k.alias("k")).filter("k <> 0")
    rows = rows.withColumns({"text": F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")), "role": F.when(F.col("k") == 4, "user").otherwise(F.col("role"))})
    return rows.withColumn("copy", F.explode(F.when(F.col("k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("k", "copy")


def op11_repair(spark, sf_dir: str) -> DataFrame:
    """Contract: all conversations, damaged and repaired; one whose turns all went has zeros."""
    turns = read_table(spark, sf_dir, "conversations")
    key = lambda df: df.withColumn("__g", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")))
    told = key(repairs(damaged(turns))).drop("conv_id")
    ids = key(turns.select("conv_id").distinct())
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return ids.join(told.hint("merge"), "__g", "left").select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


_TRIM = "rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
OP11_SQL = f"""
with recursive k as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {CRC_SQL.format("(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '))")} % 20 as k from conversations
), d as (
  select conv_id, turn, case k when 4 then 'user' else role end as role, case k when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(range(case k when 3 then 2 else 1 end)) as copy from k where k <> 0
), r as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from d
), f as (
  select *, case when {_TRIM} = '' then 1 when row_number() over (partition by conv_id, role, text order by i) > 1 then 2 when right({_TRIM}, 1) not in ('.', '!', '?') then 3 else 0 end as fault,
    lag(role[1]) over (partition by conv_id order by i) || role[1] as pair, row_number() over (order by conv_id, i) - i as g from r
), n as (
  select conv_id, g, max(i) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated,
    count(*) filter (pair not in ('su', 'ua', 'au')) as illegal from f group by conv_id, g
), ins(q, ins, p, c) as (values (0, '', 0, 0), (0, 'I', 2, 2), (0, 'II', 3, 4), (1, '', 1, 0), (1, 'I', 2, 2), (1, 'II', 3, 4), (2, '', 2, 0), (2, 'I', 3, 2), (3, '', 3, 0), (3, 'I', 2, 2)
), op(q, a, p, c, role) as (
  values (0, 'D', 0, 3, ''), (1, 'D', 1, 3, ''), (2, 'D', 2, 3, ''), (3, 'D', 3, 3, ''), (0, 'K', 1, 0, 's'), (0, 'K', 2, 0, 'u'), (1, 'K', 2, 0, 'u'), (2, 'K', 3, 0, 'a'), (3, 'K', 2, 0, 'u'),
    (0, 'R', 2, 2, ''), (1, 'R', 2, 2, ''), (2, 'R', 3, 2, ''), (3, 'R', 2, 2, '')
), s as (
  select g, cast(0 as bigint) as i, 0 as q, '00000000' as best from n
  union all
  select s.g, s.i + 1, op.p, min(lpad(cast(cast(s.best[:8] as int) + ins.c + op.c + case when fault = 3 and a <> 'D' then 1 else 0 end as varchar), 8, '0') || s.best[9:] || ins.ins || op.a)
  from s join f on f.g = s.g and f.i = s.i + 1 join ins on ins.q = s.q join op on op.q = ins.p
  where (op.a = 'D' or fault not in (1, 2)) and (op.role = '' or op.role = f.role[1]) group by s.g, s.i + 1, op.p
), z as (
  select s.g, min(lpad(cast(cast(best[:8] as int) + ins.c as varchar), 8, '0') || best[9:] || ins.ins) as best from s join n on n.g = s.g and n.n = s.i join ins on ins.q = s.q and ins.p in (0, 3) group by s.g
), a as (select g, best[9:] as audit, unnest(range(1, len(best) - 7)) as x from z
), b as (select g, x, audit[x] as a, len(replace(audit[:x], 'I', '')) as i from a
), c as (
  select b.g, b.x, b.a, f.role, f.text, row_number() over (partition by b.g order by b.x) as e, first_value(b.a = 'K' and f.role[1] = 's') over (partition by b.g order by b.x) as lead_s
  from b left join f on f.g = b.g and f.i = b.i and b.a <> 'I' where b.a <> 'D'
), o as (
  select g, string_agg(case when a = 'K' then role when (e - case when lead_s then 1 else 0 end) % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, ''), chr(10) order by x) as said from c group by g
), t as (
  select n.*, cast(best[:8] as bigint) as cost, best[9:] as audit, sha256(coalesce(said, '')) as repaired_sha256 from n join z using (g) left join o using (g)
)
select i.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost,
  coalesce(audit, '') as audit, coalesce(repaired_sha256, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) i left join t on t.conv_id is not distinct from i.conv_id
"""
