"""Token ids of whole texts, and a token table in ORC.

A tokenizer with byte-level pre-tokens never merges across the blank before a word, so a text is cut
there and the ids of a word are looked up; words not met yet go through the tokenizers library.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docgrid.llm.common import new_path, read_table, written

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
#: Words and pre-tokens that a worker keeps, of so many characters at most; beyond that it starts afresh.
KEPT_WORDS, KEPT_CHARS = 1_300_000, 64
#: A blank is a safe cut before a non-blank; where blanks meet, only the last one is.
_RUN_OF_BLANKS = re.compile(r" (?!\S)")
_CUT = re.compile(r" (?=\S)")
#: How a line end is named among the bytes.
_LINE_END = "\u010a"
#: A word of letters and then signs; an apostrophe may begin a pre-token of letters, so it is left out.
_PLAIN = re.compile(r"([^\W\d_]*)([!-&(-/:-@\[-`{-~]*)")


def _byte_names() -> dict[int, str]:
    """The visible character that stands for each byte: itself where printable, else the next from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Pieces(dict):
    """Pre-token -> its ids as little-endian uint32 bytes."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.model = tokenizer.model

    def ids(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        out = self.ids(piece)
        if len(piece) <= KEPT_CHARS:
            self[piece] = out
        return out


class _Words(dict):
    """Word -> ids of lead + word."""

    def __init__(self, tokenizer: Tokenizer, pieces: _Pieces, lead: str, bare: _Words | None = None):
        super().__init__()
        self.bare = self if bare is None else bare
        self.split, self.pieces, self.lead = tokenizer.pre_tokenizer.pre_tokenize_str, pieces, lead
        self.names = _byte_names()
        self.named_lead = lead.translate(self.names)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        if "\n" in word:
            lines = word.split("\n")
            if all(p and not p[0].isspace() and not p[-1].isspace() for p in lines):  # a lone line end is a pre-token
                return self[lines[0]] + b"".join([self.pieces[_LINE_END] + self.bare[p] for p in lines[1:]])
        if word.isalpha():
            out = self.pieces.ids(self.named_lead + (word if word.isascii() else word.encode().decode("latin-1").translate(self.names)))
        else:
            plain = _PLAIN.fullmatch(word)
            if plain and plain[1].isalpha():
                out = self[plain[1]] + self.pieces[plain[2]]
            else:
                out = b"".join([self.pieces[p] for p, _ in self.split(self.lead + word)])
        if len(word) <= KEPT_CHARS:
            self[word] = out
        return out


class Encoder:
    """Whole text -> ids as bytes: a call takes special strings as ordinary text; ``with_added`` equals encode(text, add_special_tokens=False)."""

    def __init__(self, path: str):
        assert array("I").itemsize == 4 and sys.byteorder == "little", "ids are kept as little-endian 32-bit integers"
        tokenizer = Tokenizer.from_file(path)
        if tokenizer.normalizer is not None or "ByteLevel" not in str(tokenizer.pre_tokenizer) or "add_prefix_space=False" not in str(tokenizer.pre_tokenizer):
            raise ValueError("a byte-level tokenizer without normalizer and prefix space is needed")
        pieces = _Pieces(tokenizer)
        self.first = _Words(tokenizer, pieces, "")
        self.later = _Words(tokenizer, pieces, " ", self.first)
        added = tokenizer.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("added tokens must not look at what stands around them")
        self.added = {t.content: array("I", [i]).tobytes() for i, t in added.items()}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split  # the longest of those that begin at one place

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        words = _CUT.split(text) if _RUN_OF_BLANKS.search(text) else text.split(" ")
        return self.first[words[0]] + b"".join(map(self.later.__getitem__, words[1:]))

    def with_added(self, text: str | None) -> bytes:
        """The same with the tokenizer's added tokens, such as <|endoftext|>, told from the text around them."""
        if not text or not any(t in text for t in self.added):
            return self(text)
        return b"".join([self.added[p] if i % 2 else self(p) for i, p in enumerate(self.split_added(text))])


@lru_cache(maxsize=2)
def encoder(path: str = TOKENIZER) -> Encoder:
    return Encoder(path)


def write_token_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID, stripe_mb: int = 32) -> None:
    """Write ORC files with rows (id_col, seq, ids): all documents in ascending id order.

    File part-N holds the N-th range of ids, seq is the row's place in its file, ids the integer
    run-length coded tokens, as the tokenizer's encode gives them, with the end id.  Row indexes and a Bloom filter on the id let a reader
    skip stripes; stripes are read in parallel.  Null and empty texts have the end id only; null ids
    come first; rows repeated under one id stand together, by text; texts of any length make one row;
    an empty table gives a table without rows.  Other columns are not read; id_col must not be one of
    the table's own names (file, seq, ids).
    """
    if id_col in ("file", "seq", "ids"):
        raise ValueError(f"a token table has a column {id_col} of its own")
    ordered = docs.select(F.col(id_col), F.col(text_col).alias("text")).repartitionByRange(id_col).sortWithinPartitions(id_col, "text")
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, seq = encoder(tokenizer).with_added, 0
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                c = b.slice(at, 2000)
                ids = [ids_of(t) + end for t in c.column(1).to_pylist()]
                offsets = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array(np.arange(seq, seq + len(ids), dtype=np.int64)), pa.ListArray.from_arrays(pa.array(offsets), values)], [id_col, "seq", "ids"])
                seq += len(ids)

    kind = docs.schema[id_col].dataType.simpleString()
    options = {"orc.compress": "LZ4", "orc.stripe.size": str(stripe_mb << 20), "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.bloom.filter.columns": id_col, "orc.bloom.filter.fpp": "0.01"}
    ordered.mapInArrow(encode, f"`{id_col}` {kind}, seq long, ids array<int>").write.options(**options).orc(path)


def read_token_table(spark: SparkSession, path: str, ids: list[int] | None = None, id_col: str = "doc_id") -> DataFrame:
    """(file, id_col, seq, ids) of a token table; given ids reach the files as a pushed filter."""
    df = spark.read.orc(path).withColumn("file", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int"))
    return df if ids is None else df.filter(F.col(id_col).isin(ids))


def token_digests(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) per row of a whole token table."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            ends, raw = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], ["file", id_col, "seq", "n_tokens", "ids_crc32"])

    kind = tokens.schema[id_col].dataType.simpleString()
    rows = written(tokens.select("file", id_col, "seq", "ids").mapInArrow(digest, f"file int, `{id_col}` {kind}, seq long, n_tokens long, ids_crc32 long"), "token-digests")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(files.hint("merge"), "file")
    return rows.select(id_col, (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def op4_tokens(spark, sf_dir: str) -> DataFrame:
    """Contract: write the token table of all documents, read it back, and describe each document."""
    path = new_path(spark, "tokens-orc")
    write_token_table(read_table(spark, sf_dir, "documents"), path)
    return token_digests(read_token_table(spark, path))
