"""Secret scans: known patterns, and a token-efficiency test for random strings.

A random string breaks into many short tokens of a vocabulary learnt from ordinary text, so few
characters per token betray it.  Known digests, UUIDs, numbers and word-like identifiers are left out.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgrid.llm.common import read_table

VOCAB = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: The patterns of the contract and the least length of what they must hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
ASSIGN_MIN, ACCESS_MIN = 12, 18
KINDS = ("assign", "access", "hex", "random")
#: Runs that the token test looks at.
MIN_CHARS, MAX_CHARS_PER_TOKEN = 20, 2.1
#: Shorter parts of one case count as words.
WORD_MIN = 12
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{%d,}" % MIN_CHARS)
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
_DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
_PART = re.compile(r"[A-Z]?[a-z]*\d{0,4}|[A-Z]+\d{0,4}|\d+")
_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
SPANS = T.ArrayType(_SPAN)


@lru_cache(maxsize=2)
def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _efficient(text: str, vocab: str, ratio: float) -> bool:
    return len(text) >= ratio * len(_encoding(vocab).encode_ordinary(text))


def is_known(run: str, vocab: str = VOCAB, ratio: float = MAX_CHARS_PER_TOKEN, least: int = WORD_MIN) -> bool:
    """Digests, UUIDs, numbers, and identifiers or paths made of word-like parts.

    A part of ``least`` characters or more is word-like only with ``ratio`` characters a token, as it
    stands or in lower case (capitals have few tokens of their own).
    """
    if _UUID.fullmatch(run) or len(run) in _DIGEST_LENGTHS and _DIGEST.fullmatch(run):
        return True
    parts = re.split(r"[+/_=.-]+", run)
    if not all(_PART.fullmatch(p) for p in parts):
        return False
    return all(len(p) < least or p.isdigit() or _efficient(p, vocab, ratio) or _efficient(p.lower(), vocab, ratio) for p in parts)


def looks_random(run: str, vocab: str = VOCAB, ratio: float = MAX_CHARS_PER_TOKEN) -> bool:
    return not _efficient(run, vocab, ratio) and not is_known(run, vocab, ratio)


def _rests(start: int, end: int, base: list[tuple[int, int]], at: int) -> tuple[list[tuple[int, int]], int]:
    """What the sorted base spans, from number ``at`` on, leave of start..end; and the first span that reaches beyond it."""
    out = []
    while at < len(base) and base[at][1] <= start:
        at += 1
    k = at
    while k < len(base) and base[k][0] < end:
        s, e = base[k]
        if start < s:
            out.append((start, s))
        start = max(start, e)
        k += 1
    if start < end:
        out.append((start, end))
    return out, at


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, overlapping ones joined."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def find_spans(text: str | None, vocab: str = VOCAB, ratio: float = MAX_CHARS_PER_TOKEN) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind in the order of KINDS."""
    if not text:
        return []
    out = []
    if ":" in text or "=" in text:  # every assignment has one
        out += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    out += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    base, at = _merged([(s, e) for _, s, e in out]), 0
    for m in _RUN.finditer(text):  # runs and base spans both go forward, so each list is walked once
        rests, at = _rests(m.start(), m.end(), base, at)
        if rests == [m.span()]:
            if looks_random(m[0], vocab, ratio):
                out.append((3, m.start(), m.end()))
            continue
        for s, e in rests:  # long rests are runs of their own, short ones are as random as the whole
            rest = text[s:e]
            if looks_random(rest, vocab, ratio) if e - s >= MIN_CHARS else looks_random(m[0], vocab, ratio) and not is_known(rest, vocab, ratio, 4):
                out.append((3, s, e))
    out.sort(key=lambda x: (x[1], x[0]))
    return [(KINDS[k], s, e) for k, s, e in out]


def secret_spans(text: str | Column, vocab: str = VOCAB, ratio: float = MAX_CHARS_PER_TOKEN) -> Column:
    """array<struct<kind,start,end>> of a text column; null and empty texts give an empty array."""

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("kind", "start", "end"), x)) for x in find_spans(t, vocab, ratio)])

    return spans(text)


def redact(text: str | Column, vocab: str = VOCAB, ratio: float = MAX_CHARS_PER_TOKEN, mask: str = "[SECRET]") -> Column:
    """The text with every found span (overlapping ones joined) replaced by mask; null stays null."""

    def clean(t: str | None) -> str | None:
        spans = find_spans(t, vocab, ratio)
        if not spans:
            return t
        parts, at = [], 0
        for _, s, e in spans:
            if s >= at:
                parts += [t[at:s], mask]
            at = max(at, e)
        return "".join([*parts, t[at:]])

    @F.pandas_udf("string")
    def redacted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(clean, na_action="ignore")

    return redacted(text)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = VOCAB, ratio: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """One row per input row: id_col and spans, over the whole text, whatever its length.

    Null and empty texts have no spans; null ids, repeated rows and other columns, whatever their
    names, have no influence; an empty table gives no rows.  Of a random run that overlaps a known pattern, what is left around it is told.
    """
    return docs.select(F.col(id_col), secret_spans(F.col(text_col), vocab, ratio).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    """Contract: counts by kind, a digest of the base spans, and all spans."""
    found = secret_scan(read_table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    return found.select("doc_id", *[n(k) for k in KINDS[:3]], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), n(KINDS[3]))


def known_patterns_query(spark, sf_dir: str) -> DataFrame:
    """The part of op2_secrets that SQL can say: everything but the spans of the token test."""
    return op2_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def _matches(kind: int, pattern: str, keep: str) -> str:
    """SQL for (doc_id, kind, start, end) of a pattern: the pieces between matches tell where they are."""
    return f"""
  select doc_id, {kind} as kind, place as s, place + len(hit) as e from (
    select doc_id, hit, sum(len(piece)) over w + coalesce(sum(len(hit)) over (w rows between unbounded preceding and 1 preceding), 0) as place from (
      select doc_id, unnest(string_split_regex(text, $${pattern}$$)) as piece, unnest(list_append(regexp_extract_all(text, $${pattern}$$), null)) as hit, generate_subscripts(list_append(regexp_extract_all(text, $${pattern}$$), null), 1) as k from t
    ) window w as (partition by doc_id order by k)
  ) where hit is not null and {keep}"""


PATTERNS_SQL = (
    "with t as (select doc_id, coalesce(text, '') as text from documents), m as ("
    + "\n  union all".join(
        [
            _matches(0, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", r"""len(regexp_extract(hit, $$^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$$, 1)) >= 12"""),
            _matches(1, "AKIA[A-Z0-9]+", "len(hit) >= 18"),
            _matches(2, "[0-9a-f]+", "len(hit) >= 16"),
        ]
    )
    + """
), g as (
  select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
    string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || s || ':' || e, ',' order by s, kind) as spans
  from m group by doc_id
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(spans, '')) as base_sha256
from t left join g using (doc_id)
"""
)
