"""The query on data sets: columns, conjuncts, disjuncts, limit and id join, as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DataError

OPERATORS = {"==": Column.__eq__, "!=": Column.__ne__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}


@dataclass(frozen=True)
class DataSetQuery:
    """Built by calls that each give a new query."""

    columns: frozenset[int] = frozenset()
    conjuncts: tuple = ()
    disjuncts: tuple = ()
    rows: int | None = None

    def add_column(self, index: int) -> DataSetQuery:
        return self.add_range(index, 1)

    def add_range(self, start: int, count: int) -> DataSetQuery:
        """Columns are a set: the output is ascending, each once."""
        if start < 0 or count < 1:
            raise DataError("a column range is invalid")
        return replace(self, columns=self.columns | set(range(start, start + count)))

    def _condition(self, column: int, op: str, value: float) -> tuple:
        if op not in OPERATORS or column < 0:
            raise DataError("a condition is invalid")
        return (column, op, float(value))

    def filter(self, column: int, op: str, value: float) -> DataSetQuery:
        if self.conjuncts:
            raise DataError("the filter is set already")
        return replace(self, conjuncts=(self._condition(column, op, value),))

    def and_(self, column: int, op: str, value: float) -> DataSetQuery:
        if not self.conjuncts:
            raise DataError("there is no filter yet")
        return replace(self, conjuncts=(*self.conjuncts, self._condition(column, op, value)))

    def or_(self, column: int, op: str, value: float) -> DataSetQuery:
        if not self.conjuncts:
            raise DataError("there is no filter yet")
        return replace(self, disjuncts=(*self.disjuncts, self._condition(column, op, value)))

    def limit(self, rows: int) -> DataSetQuery:
        if rows < 1:
            raise DataError("a limit must be positive")
        return replace(self, rows=rows)

    def clear(self) -> DataSetQuery:
        return DataSetQuery()

    def predicate(self) -> Column | None:
        """(c1 and c2 and ...) or d1 or d2 ...; None if every row passes."""
        if not self.conjuncts:
            return None
        test = lambda c: OPERATORS[c[1]](F.col("point")[c[0]], F.lit(c[2]))
        return reduce(Column.__or__, [reduce(Column.__and__, map(test, self.conjuncts)), *map(test, self.disjuncts)])

    def _selected(self, ds: DataFrame, any_columns: bool) -> DataFrame:
        if not any_columns and not self.columns:
            raise DataError("no columns are selected")
        # Points have one width, so one of them tells it without a scan.
        first = ds.select(F.size("point")).first()
        wide = first[0] if first is not None else 0
        used = [*self.columns, *(c[0] for c in (*self.conjuncts, *self.disjuncts))]
        if wide and used and max(used) >= wide:
            raise DataError("a column is out of range")
        out = ds if (test := self.predicate()) is None else ds.where(test)
        if self.rows is not None:
            out = out.orderBy("pos").limit(self.rows)
        point = F.array(*[F.col("point")[i] for i in sorted(self.columns)]) if self.columns else F.array().cast("array<double>")
        return out.select("id", "pos", point.alias("point"))

    def transform(self, ds: DataFrame) -> DataFrame:
        """Selected columns of the rows that pass, in order."""
        return self._selected(ds, False)

    def transform_join(self, first: DataFrame, second: DataFrame) -> DataFrame:
        """Rows of ``first`` that pass and whose id ``second`` has: all columns of ``second``, then the selected ones.

        The limit counts rows before the join.
        """
        left = self._selected(first, True)
        right = second.select("id", F.col("point").alias("other"))
        return left.join(right, "id").select("id", "pos", F.concat("other", "point").alias("point"))
