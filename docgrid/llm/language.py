"""Language identification with a string kernel.

Kernel: blended-spectrum presence, k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|), where G are the
distinct byte n-grams (n = 1..MAX_N, hashed to DIM slots) of the lower-cased whole text.  Landmarks
give the Nystroem map phi(x) = K(x, L) K(L, L)^(-1/2); one-versus-rest ridge regression is fitted on
phi, and a batch is scored as (presence x landmarks) x coefficients.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgrid.llm.common import read_table, remainder, written

MAX_N = 4
DIM = 1 << 14
#: The fit's bound: labelled documents in all and a language, and landmarks in all and a language; languages share them evenly.
SAMPLE, PER_LANG, LANDMARKS, LANDMARKS_PER_LANG = 12_800, 200, 1024, 16
RIDGE = 1e-2
ROWS = 64
_STEP = 1 << 22


def presence(text: str) -> np.ndarray:
    """The distinct n-gram slots of a text as a 0/1 vector of DIM."""
    out = np.zeros(DIM, np.uint8)
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)
    for at in range(0, len(b), _STEP):  # very long texts in steps that overlap by MAX_N - 1
        c = b[at : at + _STEP + MAX_N - 1].astype(np.uint32)
        key = np.zeros(len(c), np.uint32)
        for n in range(MAX_N):
            if len(c) <= n:
                break
            key = (key[: len(c) - n] << np.uint32(8)) | c[n:]
            out[((key + np.uint32(n + 1)) * np.uint32(2654435761)) >> np.uint32(18)] = 1
    return out


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter (general category L), as the fit's \\p{L} has it."""
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    langs: list[str]
    landmarks: np.ndarray  # DIM x m, columns divided by their norm
    coef: np.ndarray  # m x classes, K(L, L)^(-1/2) times the ridge weights
    bias: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float32)
        norm = np.sqrt(np.maximum(1.0, x.sum(1, keepdims=True)))
        return ((x @ self.landmarks) / norm) @ self.coef + self.bias


def fit(spark, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_lang: int = PER_LANG, landmarks: int = LANDMARKS_PER_LANG, ridge: float = RIDGE, sample: int = SAMPLE, most_landmarks: int = LANDMARKS) -> LanguageModel | None:
    """Fit on a bounded sample: at most ``sample`` documents, per_lang a language, the first by a hash of
    id and text length among those that have a letter.  Every language has its share of the sample and
    of the landmarks, down to one document each.  Only presence vectors (DIM / 8 bytes each) come to the
    driver.  None without any labelled text.
    """
    pool = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    # more languages than the sample has documents leave the rarest ones without any
    sizes = written(pool.groupBy(F.col(lang_col).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(sample), "languages")
    n = sizes.count()
    if not n:
        return None
    per_lang, landmarks = max(1, min(per_lang, sample // n)), max(1, min(landmarks, most_landmarks // n))
    # a hash threshold first, so that ranking sees few rows of any language; sizes has ``sample`` rows at most
    share = F.broadcast(sizes.select("lang", F.least(F.lit(1.0), 8.0 * per_lang / F.col("count") + 1e-9).alias("share")))
    h = F.xxhash64(F.lit("lang"), F.col(id_col), F.length(text_col))
    rank = Window.partitionBy("lang").orderBy("h", "id", "text")

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: np.packbits(presence(t)).tobytes())

    few = pool.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), h.alias("h")).join(share, "lang")
    few = few.filter((F.pmod("h", F.lit(1 << 30)) / (1 << 30)) < F.col("share")).withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= per_lang)
    rows = few.select("lang", "r", "h", packed("text").alias("x")).orderBy("lang", "r").collect()
    langs, of = np.unique([r["lang"] for r in rows], return_inverse=True)
    marks = sorted((i for i, r in enumerate(rows) if r["r"] <= landmarks), key=lambda i: (rows[i]["r"], rows[i]["h"]))[:most_landmarks]

    def kernel_rows(some: list[int]) -> np.ndarray:
        x = np.array([np.unpackbits(np.frombuffer(rows[i]["x"], np.uint8)) for i in some], np.float32)
        return x / np.sqrt(np.maximum(1.0, x.sum(1, keepdims=True)))

    mark = kernel_rows(sorted(marks))
    value, vector = np.linalg.eigh((mark @ mark.T).astype(float))
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    phi = np.concatenate([(kernel_rows(list(range(at, min(at + 512, len(rows))))) @ mark.T).astype(float) @ root for at in range(0, len(rows), 512)])
    y = np.where(of[:, None] == np.arange(len(langs)), 1.0, -1.0)
    balance = 1.0 / np.bincount(of)[of]
    balance /= balance.sum()
    mean_phi, mean_y = balance @ phi, balance @ y
    a = (phi - mean_phi) * balance[:, None]
    w = np.linalg.solve(a.T @ (phi - mean_phi) + ridge / len(rows) * np.eye(phi.shape[1]), a.T @ (y - mean_y))
    return LanguageModel(langs.tolist(), np.ascontiguousarray(mark.T), (root @ w).astype(np.float32), (mean_y - mean_phi @ w).astype(np.float32))


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id_col, the columns named in keep, lang_pred and score (0 to 1).

    Null text, text without a letter, and any text when nothing was learnt get "und" and score 0.
    Ties go to the first language by name.  Texts of any length are read whole, in steps; null ids and
    repeated rows are predicted like any other.  Columns not named are not read, so their names cannot
    clash, except that id_col and keep must not hold lang_pred or score.  An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM x LANDMARKS floats at most

    @F.pandas_udf("lang_pred string, score double")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            real = [i for i, t in enumerate(texts) if m is not None and has_letter(t)]
            for at in range(0, len(real), ROWS):
                rows = real[at : at + ROWS]
                s = m.scores(np.stack([presence(texts.iloc[i]) for i in rows]))
                best = s.argmax(1)
                p = np.exp(4.0 * (s - s.max(1, keepdims=True)))
                lang[rows] = [m.langs[b] for b in best]
                score[rows] = 1.0 / p.sum(1)
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    return docs.select(id_col, *keep, guess(F.col(text_col)).alias("__g")).select(id_col, *keep, "__g.lang_pred", "__g.score")


def op9_language(spark, sf_dir: str) -> DataFrame:
    """Contract: language of every document, learnt from those whose remainder is not 2."""
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", remainder("doc_id", 4) == 2)
    model = fit(spark, docs.filter(~F.col("held_out")))
    return predict(docs, model, keep=("held_out",)).select("doc_id", "held_out", "lang_pred", "score")
