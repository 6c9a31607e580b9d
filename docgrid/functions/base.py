"""Names or columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

C = str | Column


def col(c) -> Column:
    """A column from its name; columns stay, other values become literals."""
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)
