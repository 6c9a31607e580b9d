"""Quality classifier: a sparse ensemble of rules.

Trees fitted on text statistics are cut into their root-to-node paths; each path is a conjunctive
rule.  A lasso logistic regression weighs the rules, and the rules with a weight become one Spark
column expression over the statistics.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrid.llm.common import discard, read_table, remainder, written

#: Classes of bytes whose share of a text is a statistic.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "blank": b" \t\r\x0b\x0c",
    "line": b"\n",
    "stop": b".,;:?",
    "shout": b"!",
    "pipe": b"|",
    "quote": b"'\"`",
    "bracket": b"()[]{}<>",
    "symbol": b"#$%&*+=-/\\@^_~",
}
STATS = ("log_words", "word_length", "long_words", "distinct_words", "distinct_lines", "line_length", "top_word", "stops_per_word", *(f"of_{c}" for c in CLASSES), "of_other")
TREES, DEPTH, LASSO, SEED = 12, 3, 0.002, 7
THRESHOLD = 0.7
_TABLE = np.zeros(256, np.uint8)
for _i, _c in enumerate(CLASSES.values(), 1):
    _TABLE[np.frombuffer(_c, np.uint8)] = _i


def text_stats(text: str | None) -> list[float]:
    """STATS of a whole text; a null or empty text has all zeros."""
    if not text:
        return [0.0] * len(STATS)
    b = text.encode("utf-8", "surrogatepass")
    words, lines = b.lower().split(), [x for x in b.split(b"\n") if x]
    n, counts = max(1, len(words)), np.bincount(_TABLE[np.frombuffer(b, np.uint8)], minlength=len(CLASSES) + 1)
    of = dict(zip(("other", *CLASSES), (counts / len(b)).tolist()))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    long_words = sum(c for w, c in seen.items() if len(w) > 20)
    return [
        float(np.log1p(len(words))), sum(map(len, words)) / n, long_words / n, len(seen) / n, len(set(lines)) / max(1, len(lines)),
        float(np.log1p(len(b) / max(1, len(lines)))), max(seen.values(), default=0) / n, of["stop"] * len(b) / n, *(of[c] for c in CLASSES), of["other"],
    ]


def stats_column(text: str | Column) -> Column:
    """array<double> in the order of STATS."""

    @F.pandas_udf("array<double>")
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(text_stats)

    return stats(text)


#: A rule: conditions (statistic, is_at_most, threshold) that must all hold.
Rule = tuple[tuple[int, bool, float], ...]


def tree_rules(debug: str) -> list[Rule]:
    """Every path from a root to an inner or leaf node, from the text form of a forest."""
    rules: dict[Rule, None] = {}
    path: list[tuple[int, bool, float]] = []
    for line in debug.splitlines():
        if m := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line):
            if "Else" in line:
                path.pop()
            path.append((int(m[2]), m[3] == "<=", float(m[4])))
            rules.setdefault(tuple(path))
        elif line.strip().startswith("Predict") and path:
            while path and not path[-1][1]:  # a right branch ends with its last leaf
                path.pop()
        elif line.strip().startswith("Tree"):
            path = []
    return list(rules)


def rule_column(rule: Rule, stats: Column) -> Column:
    out = F.lit(True)
    for k, below, at in rule:
        x = F.get(stats, F.lit(k))
        out = out & ((x <= at) if below else (x > at))
    return out


class RuleModel:
    """Weighted rules and an intercept."""

    def __init__(self, rules: list[tuple[Rule, float]], intercept: float):
        self.rules, self.intercept = rules, intercept

    def score(self, stats: Column) -> Column:
        z = F.lit(self.intercept)
        for rule, w in self.rules:
            z = z + F.when(rule_column(rule, stats), w).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-z))


def fit(examples: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> RuleModel:
    """examples: stats array<double>, label 0/1.  All of them are used.

    Classes weigh the same in the trees; the logistic weights follow the examples as they are, so that
    a score is a probability.  Without examples every score is 0.5; with one class it is near that class.
    """
    counts = {int(r["label"]): r["count"] for r in examples.groupBy("label").count().collect()}
    if len(counts) < 2:
        return RuleModel([], 4.0 if 1 in counts else -4.0 if counts else 0.0)
    weight = F.when(F.col("label") == 1, sum(counts.values()) / (2.0 * counts[1])).otherwise(sum(counts.values()) / (2.0 * counts[0]))
    train = examples.select(array_to_vector("stats").alias("features"), F.col("label").cast("double").alias("label"), weight.alias("w"), "stats")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, weightCol="w", maxBins=64, featureSubsetStrategy="onethird").fit(train)
    rules = tree_rules(forest.toDebugString)
    if not rules:
        return RuleModel([], float(np.log(counts[1] / counts[0])))
    held = train.select("label", array_to_vector(F.array(*[rule_column(r, F.col("stats")).cast("double") for r in rules])).alias("features"))
    lr = LogisticRegression(elasticNetParam=1.0, regParam=lasso, standardization=False, maxIter=60).fit(held)
    return RuleModel([(r, float(w)) for r, w in zip(rules, lr.coefficients) if abs(w) > 1e-6], float(lr.intercept))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Training rows (stats, label) of docs (id_col, held_out, stats).  Labels with a null id or quality teach nothing."""
    known = labels.filter(F.col("quality").isNotNull()).select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("label"))
    examples = docs.filter(~F.col("held_out")).join(known.hint("merge"), F.col(id_col) == F.col("__id")).select("stats", "label")
    return written(examples, "quality-examples")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, held_out, score (0 to 1, higher: quality 1 likelier), predicted.

    Learns from labelled rows whose crc32(id as text) mod 4 is not 2; labels (doc_id, quality 0 or 1) with
    a null id or quality teach nothing, and rows repeated under an id, in either table, teach once for each pair.
    Null and empty texts get the score of all-zero statistics; null ids are scored too; repeated rows each
    come back, equal texts with equal scores; whole texts of any length are read; an empty table gives no
    rows.  Other columns are not read, so their names cannot clash.
    """
    stats = written(docs.select(F.col(id_col), (remainder(id_col, 4) == 2).alias("held_out"), stats_column(F.col(text_col)).alias("stats")), "quality-stats")
    examples = training_rows(stats, labels, id_col)
    model = fit(examples)
    discard(examples)
    return stats.select(id_col, "held_out", model.score(F.col("stats")).alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """Contract: quality score of every document."""
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
