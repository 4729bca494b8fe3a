"""Columns by any name, and helper names that a table doesn't have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col(quoted(name))


def spare(docs: DataFrame, *wanted: str) -> list[str]:
    """For each wanted name itself or, if docs has a column so called, the next that is free;
    upper and lower case count as equal."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
