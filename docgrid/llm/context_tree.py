"""Language-model scores by context-tree weighting over bytes.

Bytes are coded bit by bit; the node of a bit is (previous d bytes, bits so far), d = 0..DEPTH.  A
node has a Krichevsky-Trofimov estimate from its counts, and its weighted probability is the even
mixture of that estimate and the product of its children's.  After training, a bit's probability is
the posterior mixture along its path, ended at the deepest node that was seen.

The probability of a byte depends on its DEPTH + 1 bytes (a gram) only, so the model is a table from
grams to log probabilities.  Grams that share their last SPLIT context bytes (65536 at most) are worked
on together; the nodes of smaller depth are tables of their own, summed upwards level by level and
handed down again, each node to at most 256 below it.  Texts read the most frequent grams and words
from a table of at most HEAD entries; the rest is joined.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.llm.common import HOT_ROWS, mix, read_table, remainder, written

DEPTH, SPLIT = 5, 4
#: Most frequent grams and words that are sent to every worker; a bound on that memory, not on the model.
HEAD = 1 << 20
#: Byte values that UTF-8 never has: what stands before a text, and its end.
BEFORE, END = 0xFE, 0xFF
#: Bytes or keys that are worked on at once, distinct keys a counting task holds, and grams of one step of the model.
STEP, KEEP, CHUNK = 1 << 19, 1 << 20, 1 << 15
PER_TASK = 200_000
#: Kinds of keys; HELD on top marks the counts of texts that are not learnt from.
WORDS, GRAMS, HELD = 0, 1, 2
#: Key of the end token; a word's key is the hash of its bytes, and no word is empty.
END_KEY = xxhash.xxh64_intdigest(b"")
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_U = np.uint64


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def grams_of(raw: bytes) -> Iterator[np.ndarray]:
    """Keys of the bytes and the end: the DEPTH bytes before and the byte itself."""
    yield from _keys(bytes([BEFORE]) * DEPTH + raw + bytes([END]))


def _keys(raw: bytes) -> Iterator[np.ndarray]:
    b = np.frombuffer(raw, np.uint8)
    for at in range(0, len(b) - DEPTH, STEP):
        c = b[at : at + STEP + DEPTH].astype(_U)
        n = len(c) - DEPTH
        key = c[:n].copy()
        for d in range(1, DEPTH + 1):
            key = (key << _U(8)) | c[d : d + n]
        yield key


def words_of(raw: bytes) -> Iterator[np.ndarray]:
    """Keys of the words and the end, a stretch of the text at a time."""
    at = 0
    while at < len(raw):
        cut = _BLANK.search(raw, at + STEP)
        end = cut.start() if cut else len(raw)
        w = raw[at:end].split()
        yield np.fromiter(map(xxhash.xxh64_intdigest, w), _U, len(w))
        at = end
    yield np.array([END_KEY], _U)


class _Counter:
    """Sums counts by key in sorted arrays; about STEP raw and twice KEEP sorted keys at most."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.raw: list[tuple[np.ndarray, bool]] = []
        self.n = self.kept = 0

    def add(self, keys: np.ndarray, counts: bool) -> None:
        self.raw.append((keys, counts))
        self.n += len(keys)
        if self.n > STEP:
            self.fold()

    def fold(self) -> None:
        for own in (True, False):
            if some := [k for k, c in self.raw if c is own]:
                keys, n = np.unique(np.concatenate(some), return_counts=True)
                self.parts.append((keys, n if own else np.zeros(len(n), np.int64)))
        self.raw, self.n = [], 0
        if sum(len(k) for k, _ in self.parts) > max(KEEP // 2, 2 * self.kept):
            self.parts = [self.merged()]
            self.kept = len(self.parts[0][0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        keys, n = np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts])
        by = np.argsort(keys, kind="stable")
        keys, n = keys[by], n[by]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[first], np.add.reduceat(n, first)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.fold()
        out = self.merged()
        self.parts, self.kept = [], 0
        return out


def count_table(docs: DataFrame, text_col: str, train_col: str) -> DataFrame:
    """(kind, key, n): training counts of words and grams; grams that only other texts have come with n = 0.

    The counts of those other texts are told under kind + HELD.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = tuple(_Counter() for _ in range(4))

        def told(kind: int) -> Iterator[pa.RecordBatch]:
            keys, n = sums[kind].take()
            for at in range(0, len(keys), 1 << 17):
                k = keys[at : at + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(n[at : at + (1 << 17)])], ["kind", "key", "n"])

        for b in batches:
            for t, own in zip(b.column(0), b.column(1)):
                raw, own = _raw(t.as_py()), own.as_py()
                for kind, of in ((WORDS, words_of), (GRAMS, grams_of)):
                    for keys in of(raw):
                        if own or kind == GRAMS:
                            sums[kind].add(keys, own)
                        if not own:
                            sums[kind + HELD].add(keys, True)
                        for to in (kind, kind + HELD):
                            if sums[to].kept > KEEP:  # bounded memory, whatever the size of the split or the text
                                yield from told(to)
        for kind in range(4):
            yield from told(kind)

    rows = docs.select(F.col(text_col), F.coalesce(F.col(train_col), F.lit(False))).mapInArrow(count, "kind int, key long, n long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"))


# ---- the model


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series eight steps up, brought down by the recurrence."""
    y, down = x + 8.0, np.zeros_like(x)
    for k in range(8):
        down += np.log(x + k)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - (1 / 360 - 1 / (1260 * y * y)) / (y * y)) / y - down


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimator gives to n0 zeros and n1 ones."""
    out = log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)
    return np.where(n0 + n1 > 0, out, 0.0)


def weighted(kt: np.ndarray, below: np.ndarray) -> np.ndarray:
    return np.logaddexp(kt, below) - np.log(2.0)


class _Level:
    """Nodes of one depth: counts, estimates, weights; inverse leads from the deeper items to nodes."""

    def __init__(self, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None):
        self.keys, self.inverse = np.unique(keys, return_inverse=True)
        total = lambda v: np.bincount(self.inverse, v, len(self.keys))
        self.n0, self.n1 = total(n0), total(n1)
        self.kt = log_kt(self.n0, self.n1)
        self.log = self.kt if below is None else weighted(self.kt, total(below))


def bit_items(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each gram and each of its byte's bits: node key (context, bits so far), bit, and counts of 0 and 1."""
    context, byte = keys >> _U(8), keys & _U(255)
    level = np.arange(8, dtype=_U)
    prefix = (_U(1) << level) | (byte[:, None] >> (_U(8) - level))
    bit = ((byte[:, None] >> (_U(7) - level)) & _U(1)).astype(np.int64).ravel()
    node = ((context[:, None] << _U(8)) | prefix).ravel()
    each = np.repeat(n.astype(float), 8)
    return node, bit, np.where(bit == 0, each, 0.0), np.where(bit == 1, each, 0.0)


def levels_to(node: np.ndarray, n0: np.ndarray, n1: np.ndarray, deepest: int, shallow: int) -> list[_Level]:
    """Levels from the deepest to the shallow depth; node keys have ``deepest`` context bytes."""
    out, keys, below = [], node, None
    for d in range(deepest, shallow - 1, -1):
        keys = keys & _U((1 << (8 * d + 8)) - 1)
        out.append(_Level(keys, n0, n1, below))
        keys, n0, n1, below = out[-1].keys, out[-1].n0, out[-1].n1, out[-1].log
    return out


def _mask(depth: int) -> int:
    """Bits of a node key that name ``depth`` context bytes and the bits so far."""
    return (1 << (8 * depth + 8)) - 1


class Path:
    """Nodes of depth SPLIT - 1, sorted: the chance of a 0 if the path ends there, and what a deeper chance is scaled by and added to."""

    def __init__(self, keys: np.ndarray, ends: np.ndarray, add: np.ndarray, scale: np.ndarray):
        by = np.argsort(keys)
        self.keys, self.ends, self.add, self.scale = keys[by], ends[by], add[by], scale[by]


def gram_log10(keys: np.ndarray, n: np.ndarray, path: Path) -> np.ndarray:
    """log10 of each gram's byte probability; the grams hold all that share their last SPLIT context bytes."""
    node, bit, n0, n1 = bit_items(keys, n)
    at = np.searchsorted(path.keys, node & _U(_mask(SPLIT - 1)))
    one = bit == 1
    ends, add, scale = path.ends[at], path.add[at], path.scale[at]
    ends, add = np.where(one, 1 - ends, ends), np.where(one, 1 - scale - add, add)
    levels, place, places = levels_to(node, n0, n1, DEPTH, SPLIT), np.arange(len(node)), []
    for lv in levels:
        place = lv.inverse[place]
        places.append(place)
    for lv, at in zip(reversed(levels), reversed(places)):
        a, b = lv.n0[at], lv.n1[at]
        kt, stop, seen = (np.where(one, b, a) + 0.5) / (a + b + 1.0), np.exp(lv.kt[at] - np.log(2.0) - lv.log[at]), a + b > 0
        ends, add, scale = np.where(seen, add + scale * kt, ends), np.where(seen, add + scale * stop * kt, ends), np.where(seen, scale * (1 - stop), 0.0)
    return np.log10(ends).reshape(-1, 8).sum(1)


def _cuts(context: np.ndarray, least: int) -> int:
    """Where the last group of equal contexts begins, if at least ``least`` rows are held, else 0."""
    return int(np.argmax(context == context[-1])) if len(context) >= least else 0


def _chunks(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and counts of whole groups of SPLIT context bytes, about ``chunk`` grams or one group at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, need = 0, chunk
    for b in batches:
        for at in range(0, b.num_rows, chunk):
            c = b.slice(at, chunk)
            held.append((c.column(0).to_numpy().view(_U), c.column(1).to_numpy()))
            size += c.num_rows
            if size >= need:
                keys, n = (np.concatenate(x) for x in zip(*held))
                cut = _cuts((keys >> _U(8)) & _U((1 << 8 * SPLIT) - 1), need)
                if cut:
                    yield keys[:cut], n[:cut]
                held, size = [(keys[cut:], n[cut:])], len(keys) - cut
                need = chunk if cut else max(chunk, 2 * size)
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a node's log estimate and log weight to (node, n0, n1, below)."""
    for b in batches:
        n0, n1, below = (b.column(k).to_numpy() for k in (1, 2, 3))
        kt = log_kt(n0, n1)
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(kt), pa.array(weighted(kt, below))], ["node", "n0", "n1", "kt", "log"])


def shallow_path(sums: DataFrame) -> DataFrame:
    """(node, ends, add, scale) of depth SPLIT - 1, from the sums (node, n0, n1, below) over the nodes below them."""
    levels, level = [], sums
    for d in range(SPLIT - 1, -1, -1):
        node = F.col("node").bitwiseAND(F.lit(_mask(d)))
        level = level.groupBy(node.alias("node")).agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "below")))
        levels.append(written(level.mapInArrow(_weigh, "node long, n0 double, n1 double, kt double, log double"), "nodes"))
        level = levels[-1].withColumnRenamed("log", "below")
    out = None
    for d, lv in enumerate(reversed(levels)):
        if out is None:
            rows = lv.withColumns({"ends": F.lit(0.5), "add": F.lit(0.0), "scale": F.lit(1.0)})
        else:  # a node has 256 nodes below it at most
            rows = lv.withColumn("up", F.col("node").bitwiseAND(F.lit(_mask(d - 1)))).join(out.withColumnRenamed("node", "up").hint("merge"), "up")
        kt, stop, seen = (F.col("n0") + 0.5) / (F.col("n0") + F.col("n1") + 1.0), F.exp(F.col("kt") - float(np.log(2.0)) - F.col("log")), F.col("n0") + F.col("n1") > 0
        out = rows.select(
            "node",
            F.when(seen, F.col("add") + F.col("scale") * kt).otherwise(F.col("ends")).alias("ends"),
            F.when(seen, F.col("add") + F.col("scale") * stop * kt).otherwise(F.col("ends")).alias("add"),
            F.when(seen, F.col("scale") * (1 - stop)).otherwise(0.0).alias("scale"),
        )
    return out


def gram_table(grams: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(key, n, logp) of grams (key, n), dealt by their last SPLIT - 1 context bytes and read as a stream."""
    parts = max(int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-grams.count() // PER_TASK))
    context = F.shiftright("key", 8)
    few, many = (context.bitwiseAND(F.lit((1 << 8 * k) - 1)) for k in (SPLIT - 1, SPLIT))
    rows = grams.select(few.alias("few"), many.alias("many"), "key", "n")
    dealt = rows.repartition(parts, "few").sortWithinPartitions("few", "many").select("key", "n")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in _chunks(batches, chunk):
            node, _, n0, n1 = bit_items(keys, n)
            low = levels_to(node, n0, n1, DEPTH, SPLIT)[-1]
            up, inverse = np.unique(low.keys & _U(_mask(SPLIT - 1)), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(up.view(np.int64)), *(pa.array(np.bincount(inverse, v, len(up))) for v in (low.n0, low.n1, low.log))], ["node", "n0", "n1", "below"])

    path = shallow_path(dealt.mapInArrow(sums, "node long, n0 double, n1 double, below double"))
    path = path.select(F.shiftright("node", 8).alias("few"), F.lit(-1).cast("long").alias("many"), F.col("node").alias("key"), F.lit(None).cast("long").alias("n"), "ends", "add", "scale")
    none = F.lit(None).cast("double")
    both = rows.select("*", none.alias("ends"), none.alias("add"), none.alias("scale")).union(path)
    both = both.repartition(parts, "few").sortWithinPartitions("few", "many").select("key", "n", "ends", "add", "scale")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: list[tuple[np.ndarray, ...]] = []

        def split() -> Iterator[pa.RecordBatch]:
            """The grams; nodes are put aside as they come, before the grams that need them."""
            for b in batches:
                is_node = b.column(1).is_null()
                own = b.filter(is_node)
                nodes.append((own.column(0).to_numpy().view(_U), *(own.column(k).to_numpy() for k in (2, 3, 4))))
                yield b.filter(pc.invert(is_node)).select(["key", "n"])

        for keys, n in _chunks(split(), chunk):
            known = Path(*(np.concatenate(x) for x in zip(*nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n), pa.array(gram_log10(keys, n, known))], ["key", "n", "logp"])
            later = known.keys >> _U(8) >= (keys[-1] >> _U(8)) & _U((1 << 8 * (SPLIT - 1)) - 1)  # contexts come in ascending order
            nodes[:] = [(known.keys[later], known.ends[later], known.add[later], known.scale[later])]

    return both.mapInArrow(score, "key long, n long, logp double")


# ---- scoring


class Lookup:
    """An open-addressing table from 64-bit keys to floats, half full at most."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (2 * len(keys) - 1).bit_length())
        self.keys, self.values, self.used = np.zeros(1 << self.bits, _U), np.zeros(1 << self.bits), np.zeros(1 << self.bits, bool)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            s = slot[left]
            free = ~self.used[s]
            first = np.zeros(len(left), bool)
            first[np.unique(s, return_index=True)[1]] = True
            put = free & first
            self.used[s[put]] = True
            self.keys[s[put]], self.values[s[put]] = keys[left[put]], values[left[put]]
            left = left[~put]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> _U(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found); 0 where not found."""
        slot = self._slot(keys)
        found = (self.keys[slot] == keys) & self.used[slot]
        out = np.where(found, self.values[slot], 0.0)
        left = np.flatnonzero(~found & self.used[slot])
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            hit = (self.keys[slot] == keys[left]) & self.used[slot]
            out[left[hit]], found[left[hit]] = self.values[slot[hit]], True
            go = ~hit & self.used[slot]
            left, slot = left[go], slot[go]
        return out, found


def head_count(table: DataFrame, most: int) -> int:
    """The least count such that at most ``most`` rows of the table have it or more."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    sizes = table.filter("n > 0").groupBy(step.alias("s")).count().orderBy(F.desc("s")).collect()
    total, least = 0, None
    for r in sizes:
        total += r["count"]
        if total > most:
            break
        least = r["s"]
    return 1 << 62 if least is None else int(np.ceil(2 ** (least / 16) - 1e-9))


def hot_held(counts: DataFrame, most: int) -> DataFrame:
    """(kind, key) of the keys that the texts not learnt from use most, ``most`` of them at most.

    Training may hardly know them, so they are in no head by its counts; of any other key such texts
    use no more than one in ``most`` of all their keys, or HOT_ROWS.
    """
    held = counts.filter(F.col("kind") >= HELD).select((F.col("kind") - HELD).alias("kind"), "key", "n")
    return held.filter(F.col("n") > max(HOT_ROWS, head_count(held, most) - 1)).select("kind", "key")


class Heads:
    """The most frequent words and grams with their values; a worker that reads them builds its tables once and drops them with the broadcast."""

    def __init__(self, words: tuple[np.ndarray, np.ndarray], grams: tuple[np.ndarray, np.ndarray]):
        self.pairs, self.built = (words, grams), None

    def tables(self) -> tuple[Lookup, ...]:
        if self.built is None:
            self.built, self.pairs = tuple(Lookup(*p) for p in self.pairs), ()
        return self.built


def _head(tables: tuple[pa.Table, ...], col: str, value: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, values) of the tables; of a key that stands in several the first."""
    keys, at = np.unique(np.concatenate([t["key"].to_numpy() for t in tables]), return_index=True)
    return keys.view(_U), value(np.concatenate([t[col].to_numpy() for t in tables])[at])


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_col: str = "train", head: int = HEAD) -> DataFrame:
    """One row per input row: id_col, train_col, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Learns from the rows where train_col is true.  ``score`` is the model's log10 probability of the
    lower-cased (A-Z) text's bytes and its end, n_bytes their number and bits_per_byte the code length;
    ``base_score`` is that of its words and its end under add-one word counts.  Null and empty texts
    have the end only; a text of any length is read in steps.  Ids may be null or repeat, each row is
    scored by itself.  With nothing to learn from, counts are zero and every bit has probability one
    half; an empty table gives no rows.  Other columns are not read, so their names cannot clash.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(train_col), F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    counts = written(count_table(docs, "text", "train"), "counts")
    words = counts.filter(F.col("kind") == WORDS).select("key", "n")
    grams = written(gram_table(counts.filter(F.col("kind") == GRAMS)), "grams")
    size = words.agg(F.sum("n"), F.count("*")).first()
    total, distinct = int(size[0] or 0), int(size[1])
    word_from, gram_from = head_count(words, head), head_count(grams, head)
    top_words, top_grams = words.filter(F.col("n") >= word_from).toArrow(), grams.filter(F.col("n") >= gram_from).select("key", "logp").toArrow()
    hot = written(hot_held(counts, max(1, head // 8)), "hot")
    hot_words, hot_grams = (F.broadcast(hot.filter(F.col("kind") == k).select("key")) for k in (WORDS, GRAMS))  # an eighth of ``head`` at most
    more_words = hot_words.join(words.filter(F.col("n") < word_from).join(hot_words, "key").select("key", "n").hint("merge"), "key", "left").select("key", F.coalesce("n", F.lit(0).cast("long")).alias("n")).toArrow()
    more_grams = grams.filter(F.col("n") < gram_from).join(hot_grams, "key").select("key", "logp").toArrow()
    word_head = _head((top_words, more_words), "n", lambda n: np.log10(n + 1.0))
    gram_head = _head((top_grams, more_grams), "logp", lambda p: p)
    heads = spark.sparkContext.broadcast(Heads(word_head, gram_head))  # at most nine eighths of ``head`` entries each
    del top_words, top_grams, more_words, more_grams, word_head, gram_head

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = heads.value.tables()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                c = b.slice(at, 500)
                row = c.column(0).to_numpy()
                n, size, known, base, score = (np.zeros(len(row)) for _ in range(5))
                rest: list[list[np.ndarray]] = [[], [], [], []]
                held: tuple[list, list] = ([], [])
                wait = [0, 0]

                def look(kind: int) -> None:
                    if not held[kind]:
                        return
                    keys, of = np.concatenate([k for k, _ in held[kind]]), np.repeat([o for _, o in held[kind]], [len(k) for k, _ in held[kind]])
                    held[kind].clear()
                    wait[kind] = 0
                    v, found = tables[kind].get(keys)
                    sums = base if kind == WORDS else score
                    sums += np.bincount(of, v, len(sums))
                    if kind == WORDS:
                        known[:] += np.bincount(of, v > 0, len(known))  # a word that training lacks has the value 0
                    k, o = keys[~found], of[~found]
                    if len(k):  # the rest, once per text and key
                        by = np.lexsort((k, o))
                        k, o = k[by], o[by]
                        first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (o[1:] != o[:-1])])
                        times = np.diff(np.r_[first, len(k)])
                        for x, y in zip(rest, (np.full(len(first), kind, np.int32), k[first].view(np.int64), row[o[first]], times)):
                            x.append(y)

                for i, t in enumerate(c.column(3)):
                    raw = _raw(t.as_py())
                    size[i] = len(raw) + 1
                    for kind, of in ((WORDS, words_of), (GRAMS, grams_of)):
                        for keys in of(raw):
                            held[kind].append((keys, i))
                            wait[kind] += len(keys)
                            n[i] += len(keys) if kind == WORDS else 0
                            if wait[kind] > STEP:
                                look(kind)
                look(WORDS)
                look(GRAMS)
                kind, key, to, times = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in rest)
                own, more = len(row), np.zeros(len(key))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.r_[np.full(own, 2, np.int32), kind.astype(np.int32)]), pa.array(np.r_[row, key]), pa.array(np.r_[row, to]), pa.array(np.r_[np.zeros(own, np.int64), times]),
                        *(pa.array(np.r_[x, more]) for x in (known, base, score, n, size)), *(pa.concat_arrays([x, pa.nulls(len(key), x.type)]) for x in (c.column(1), c.column(2))),
                    ],
                    ["kind", "key", "row", "times", "known", "base", "score", "n_tokens", "n_bytes", "id", "train"],
                )

    id_type = docs.schema["id"].dataType.simpleString()
    # the row number is made and used in one job; id and train travel with it
    items = docs.select(F.monotonically_increasing_id().alias("row"), "id", "train", "text").mapInArrow(read, f"kind int, key long, row long, times long, known double, base double, score double, n_tokens double, n_bytes double, id {id_type}, train boolean")
    rare = words.filter(F.col("n") < word_from).select(F.lit(WORDS).alias("kind"), "key", F.log10(F.col("n") + 1.0).alias("value"))
    rare = rare.union(grams.filter(F.col("n") < gram_from).select(F.lit(GRAMS).alias("kind"), "key", F.col("logp").alias("value")))
    items = items.join(rare.hint("merge"), ["kind", "key"], "left")
    add = F.coalesce(F.col("value"), F.lit(0.0)) * F.col("times")
    sums = items.groupBy("row").agg(
        F.first("id", ignorenulls=True).alias("id"),
        F.first("train", ignorenulls=True).alias("train"),
        F.sum("n_tokens").cast("long").alias("n_tokens"),
        F.sum("n_bytes").cast("long").alias("n_bytes"),
        F.sum(F.col("known") + F.when((F.col("kind") == WORDS) & F.col("value").isNotNull(), F.col("times")).otherwise(F.lit(0))).cast("long").alias("n_known"),
        F.sum(F.col("base") + F.when(F.col("kind") == WORDS, add).otherwise(F.lit(0.0))).alias("base"),
        F.sum(F.col("score") + F.when(F.col("kind") == GRAMS, add).otherwise(F.lit(0.0))).alias("score"),
    )
    base = F.col("base") - F.col("n_tokens") * float(np.log10(total + distinct + 1))
    bits = -F.col("score") * float(np.log2(10)) / F.col("n_bytes")
    return sums.select(F.col("id").alias(id_col), F.col("train").alias(train_col), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "n_bytes", bits.alias("bits_per_byte"))


def op8_context_tree(spark, sf_dir: str) -> DataFrame:
    """Contract: scores of all documents, learnt from those whose remainder is not 2; with the code length per byte."""
    docs = read_table(spark, sf_dir, "documents").withColumn("train", remainder("doc_id", 7) != 2)
    out = score_texts(docs)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")
