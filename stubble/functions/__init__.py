"""Column expressions: every function maps Columns to a Column, no UDFs."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    """A Column from a Column or a column name (names may hold dots or spaces)."""
    return c if isinstance(c, Column) else F.col(quoted(c))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
