"""The month, year and type selection that most queries share, and its choice lists."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonja.functions.calendar import month_rank


def _whole_numbers(values: Iterable) -> list[int]:
    numbers = []
    for value in values:
        try:
            numbers.append(int(value))
        except (TypeError, ValueError):
            continue
    return numbers


@dataclass(frozen=True)
class OpsFilter:
    """Chosen months, years and operation types; an empty choice does not restrict."""

    months: tuple[str, ...] = ()
    years: tuple = ()
    operation_types: tuple[str, ...] = ()

    def condition(self) -> Column | None:
        """The predicate, or None when nothing is chosen. Years that are no integers drop out."""
        chosen = {
            "month_name": list(self.months),
            "year": _whole_numbers(self.years),
            "operation_type": list(self.operation_types),
        }
        terms = [F.col(name).isin(values) for name, values in chosen.items() if values]
        if not terms:
            return None
        predicate = terms[0]
        for term in terms[1:]:
            predicate = predicate & term
        return predicate


def apply_filter(ops: DataFrame, f: OpsFilter | None = None) -> DataFrame:
    predicate = f.condition() if f else None
    return ops if predicate is None else ops.where(predicate)


def _choices(ops: DataFrame, column: str) -> DataFrame:
    return ops.where(F.col(column).isNotNull()).select(column).distinct()


def list_months(ops: DataFrame) -> DataFrame:
    """Month labels in calendar order, unknown labels first."""
    return _choices(ops, "month_name").orderBy(month_rank(F.col("month_name")), "month_name")


def list_years(ops: DataFrame) -> DataFrame:
    """Years, newest first."""
    return _choices(ops, "year").orderBy(F.desc("year"))


def list_operation_types(ops: DataFrame) -> DataFrame:
    return _choices(ops, "operation_type")
