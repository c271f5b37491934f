"""Exact interpolated percentiles without gathering all values in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentiles(
    values: DataFrame, column: str, fractions: Sequence[float], accuracy: int = 10_000
) -> list[float | None]:
    """The continuous percentile of ``column`` at each fraction; NULLs are left out.

    A first job brackets each percentile between two values of an approximate sketch whose
    error is bounded. The second counts the values below each bracket and ranks only the
    distinct values inside it, about 6 in ``accuracy``. The caller stages ``values`` when they
    are costly to compute.
    """
    present = values.select(F.col(column).alias("value")).where(F.col("value").isNotNull())
    margin = 2.0 / accuracy
    wanted = [
        min(max(fraction + side, 0.0), 1.0) for fraction in fractions for side in (-margin, margin)
    ]
    bounds, n = present.agg(
        F.percentile_approx("value", wanted, accuracy), F.count("value")
    ).first()
    if n == 0:
        return [None] * len(fractions)
    brackets = F.array(
        *[
            F.struct(
                F.lit(i).alias("bracket"),
                F.lit(float(bounds[2 * i])).alias("low"),
                F.lit(float(bounds[2 * i + 1])).alias("high"),
                F.lit((n - 1) * float(fraction)).alias("at"),
            )
            for i, fraction in enumerate(fractions)
        ]
    )
    value = F.col("value")
    side = F.when(value < F.col("low"), -1).when(value > F.col("high"), 1).otherwise(0)
    grouped = (
        present.select("value", F.inline(brackets))
        .withColumn("side", side)
        .groupBy("bracket", "at", "side", F.when(F.col("side") == 0, value).alias("inside"))
        .agg(
            F.count("value").alias("n"),
            F.min("value").alias("least"),
            F.max("value").alias("greatest"),
        )
    )
    running = F.sum("n").over(Window.partitionBy("bracket").orderBy("side", "inside"))
    ranked = grouped.withColumn("end", running).withColumn("start", F.col("end") - F.col("n"))

    def value_at(rank: Column) -> Column:
        # the group below a bracket knows only its last value, the one above only its first
        side, start, end = F.col("side"), F.col("start"), F.col("end")
        known = (
            ((side == 0) & (rank >= start) & (rank < end))
            | ((side == -1) & (rank == end - 1))
            | ((side == 1) & (rank == start))
        )
        found = F.max(F.when(known, F.when(side == -1, F.col("greatest")).otherwise(F.col("least"))))
        return F.coalesce(found, F.raise_error(F.lit("percentile outside its bracket")))

    lower = value_at(F.floor("at"))
    upper = value_at(F.ceil("at"))
    weight = F.max(F.col("at") - F.floor("at"))
    exact = ranked.groupBy("bracket").agg((lower + (upper - lower) * weight).alias("exact"))
    return [row.exact for row in exact.orderBy("bracket").collect()]
