"""Columns by exact name and by place, so that no name a table has can clash with one an operator makes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def placed(docs: DataFrame) -> DataFrame:
    """`docs` with its columns named _c0, _c1, ... by place."""
    return docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])


def place(docs: DataFrame, name: str) -> str:
    """The name that placed() gives the column `name`: that of exactly this name, else the first of another case."""
    names = docs.columns
    return f"_c{names.index(name) if name in names else [n.lower() for n in names].index(name.lower())}"


def only(docs: DataFrame, *names: str) -> DataFrame:
    """The columns `names` of `docs`, whatever others there are and however they are written."""
    own = placed(docs)
    return own.select(*[F.col(place(docs, n)).alias(n) for n in names])
