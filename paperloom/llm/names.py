"""Names beside a table's own ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, with more underscores where docs has such a column."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def own(docs: DataFrame) -> list[Column]:
    """docs' columns by name."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
