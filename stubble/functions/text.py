"""Text expressions for labels, codes and free-text numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stubble.functions import as_col


def remove_first(value, literal: str) -> Column:
    """Remove the first occurrence of a literal (later ones stay)."""
    return replace_first(value, literal, "")


def replace_first(value, literal: str, new: str) -> Column:
    v = as_col(value)
    at = F.locate(literal, v)
    return F.when(
        at > 0,
        F.concat(
            F.substring(v, F.lit(1), at - 1),
            F.lit(new),
            v.substr(at + len(literal), F.length(v)),
        ),
    ).otherwise(v)


def split_pieces(value, separator: str, names: list[str]) -> dict[str, Column]:
    """Named pieces of a code; missing pieces are null, surplus ones dropped."""
    parts = F.split(as_col(value), _literal_pattern(separator))
    return {n: F.get(parts, F.lit(i)) for i, n in enumerate(names)}


def paste(*parts, sep: str = " ") -> Column:
    """Join texts with a separator; a null part prints as ``NA``."""
    shown = [F.coalesce(as_col(p).cast("string"), F.lit("NA")) for p in parts]
    return F.concat_ws(sep, *shown)


def concat_or_null(*parts, sep: str = "_") -> Column:
    """Join texts with a separator; a null part makes the whole null."""
    out = []
    for p in parts:
        out += [as_col(p).cast("string"), F.lit(sep)]
    return F.concat(*out[:-1])


def short_year(year) -> Column:
    """Two-digit year text."""
    return F.substring(as_col(year).cast("string"), 3, 2)


def number_in(value) -> Column:
    """Text as a number, null where it is not one."""
    return as_col(value).try_cast("double")


def note_in(value) -> Column:
    """The text of a cell that should have held a number but does not."""
    v = as_col(value)
    return F.when(v.isNotNull() & number_in(v).isNull(), v)


def append_notes(*notes: tuple[str, Column, str]) -> Column:
    """``label: text`` of every note that is present, each followed by its own ending."""
    shown = [
        F.coalesce(F.concat(F.lit(f"{label}: "), note, F.lit(end)), F.lit(""))
        for label, note, end in notes
    ]
    return F.concat(*shown)


def null_tokens(value, tokens: list) -> Column:
    """Null where the cell holds one of the sentinel tokens or a blank."""
    v = as_col(value)
    text = F.trim(v.cast("string"))
    return F.when(~text.isin([str(t) for t in tokens] + [""]), v)


def upper_code(value) -> Column:
    return F.upper(as_col(value))


def _literal_pattern(separator: str) -> str:
    return r"\Q" + separator + r"\E"
