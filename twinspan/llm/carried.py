"""Passing all columns of a table through an operator whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Carried:
    """A table with its columns under names of our own, which no column that is added can clash with."""

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        self.df = docs.toDF(*[f"_in{i}" for i in range(len(self.names))])

    def name(self, column: str) -> str:
        return f"_in{self.names.index(column)}"

    def col(self, column: str) -> Column:
        return F.col(self.name(column))

    def own(self) -> list[str]:
        return self.df.columns

    def back(self, columns: list[str] | None = None) -> list[Column]:
        """The given columns, or all, under their first names."""
        return [self.col(c).alias(c) for c in (columns or self.names)]
