"""Greedy CTC decoding of logits held in array columns."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docgrid.functions.base import C, col


def is_distribution(row: Column) -> Column:
    """No negative value, and a sum of one to 1e-3."""
    total = F.aggregate(row, F.lit(0.0), lambda a, x: a + x)
    return (F.array_min(row) >= 0) & (F.abs(total - 1.0) <= 1e-3)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once a row: inside a lambda Spark would compute it again for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def softmax(row: C) -> Column:
    """Softmax of array<double>; a row that already is a distribution stays."""
    r = col(row)
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    shifted = _let(F.array_max(r), lambda m: F.transform(r, lambda x: F.exp(x - m)))
    return F.when(is_distribution(r), r).otherwise(_let(shifted, lambda e: _let(total(e), lambda t: F.transform(e, lambda x: x / t))))


def ctc_decode(logits: C, charset: str) -> Column:
    """struct(text, score): best class of each step, repeats collapsed, class 0 (blank) left out.

    Class k is charset[k - 1]; score is the mean probability of the kept steps, 0 without any.  Time is linear in
    steps and classes.
    """
    best = lambda q: _let(F.array_max(q), lambda p: F.struct((F.array_position(q, p) - 1).cast("int").alias("k"), p.alias("p")))
    marked = lambda steps: F.zip_with(steps, F.concat(F.array(F.lit(-1)), F.transform(steps, lambda s: s["k"])), lambda s, before: F.struct(s["k"].alias("k"), s["p"].alias("p"), before.alias("before")))
    kept = lambda steps: F.filter(marked(steps), lambda s: s["k"].isNotNull() & (s["k"] != 0) & (s["k"] != s["before"]))
    text = lambda k: F.array_join(F.transform(k, lambda s: F.substring(F.lit(charset), s["k"], F.lit(1))), "")
    score = lambda k: F.aggregate(k, F.lit(0.0), lambda a, s: a + s["p"]) / F.greatest(F.lit(1), F.size(k))
    steps = F.transform(col(logits), lambda r: _let(softmax(r), best))
    return _let(steps, lambda x: _let(kept(x), lambda k: F.struct(text(k).alias("text"), score(k).alias("score"))))
