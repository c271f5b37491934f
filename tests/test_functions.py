import random
from decimal import Decimal

from pyspark.sql import functions as F

from lonja.functions import measures as m
from lonja.functions.calendar import month_rank, weekday_label, weekday_name, weekday_number
from lonja.operators.filters import (
    OpsFilter,
    apply_filter,
    list_months,
    list_operation_types,
    list_years,
)


def test_exact_sum_is_the_sum_to_twelve_decimals(spark):
    chance = random.Random(3)
    values = [round(chance.uniform(-1e9, 1e9), 4) for _ in range(5000)] + [0.0, -0.00005, 2.5, 4e14]
    expected = float(sum(map(Decimal, values)))
    for parts in (1, 7):
        df = spark.createDataFrame([(v,) for v in values], "x double").repartition(parts)
        assert df.agg(m.exact_sum(F.col("x"))).first()[0] == expected


def test_exact_sum_of_nothing_is_null(spark):
    df = spark.createDataFrame([(None,)], "x double")
    row = df.agg(m.exact_sum(F.col("x")), m.exact_avg(F.col("x"))).first()
    assert tuple(row) == (None, None)


def test_exact_sum_takes_values_of_any_size(spark):
    def total(*values):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        found = df.agg(m.exact_sum(F.col("x"))).first()[0]
        twice = df.agg(*m.subtotal(F.col("x"), "x")).agg(m.sum_of_subtotals("x")).first()[0]
        assert str(found) == str(twice)
        return found

    assert total(1e300, 2.5, None) == 1e300
    assert total(-1e16) == -1e16
    assert total(float("inf"), 1.0) == float("inf")
    assert str(total(float("nan"), 1.0)) == "nan"


def test_exact_sum_loses_nothing_over_many_rows(spark):
    def total(rows, value):
        return spark.range(rows).agg(m.exact_sum(F.lit(value) + F.col("id") * 0)).first()[0]

    assert total(1_000_000, 0.00003) == 30.0
    assert total(10_000_000, 4e14) == 4e21
    assert total(10_000_000, -4e18) == -4e25
    odd = 450359962737.0497
    assert total(1, odd) == odd


def test_exact_sum_keeps_what_is_beyond_twelve_decimals(spark):
    rates = spark.range(1_000_000).select(F.lit(3e-13).alias("x"), (F.col("id") * 0 + 0.25).alias("y"))
    found = rates.agg(m.exact_sum(F.col("x")), m.exact_avg(F.col("x")), m.exact_sum(F.col("x") + F.col("y"))).first()
    assert abs(found[0] - 3e-7) < 3e-17 and abs(found[1] - 3e-13) < 3e-23
    assert found[2] == float(1_000_000 * Decimal(3e-13 + 0.25))
    parts = rates.groupBy(F.spark_partition_id()).agg(*m.subtotal(F.col("x"), "x")).agg(m.sum_of_subtotals("x"))
    assert abs(parts.first()[0] - 3e-7) < 3e-17


def test_subtotals_add_up(spark):
    df = spark.range(1000).select((F.col("id") * 1.37).alias("x"), (F.col("id") % 7).alias("g"))
    whole = df.agg(m.exact_sum(F.col("x"))).first()[0]
    parts = df.groupBy("g").agg(*m.subtotal(F.col("x"), "x")).agg(m.sum_of_subtotals("x"))
    assert parts.first()[0] == whole


def test_mean_rate_is_the_mean_of_ratios(make_ops):
    def rate(*pairs):
        rows = [{"business_value": v, "commission": c} for v, c in pairs]
        return make_ops(*rows).agg(m.avg_rate()).first()[0]

    assert rate((0.0, 5.0), (100.0, 10.0)) == 10.0
    assert rate((100.0, 10.0), (900.0, 9.0)) == 5.5
    assert rate((0.0, 5.0)) is None


def test_month_rank(spark):
    labels = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto",
              "septiembre", "octubre", "noviembre", "dic"]
    df = spark.createDataFrame([(x,) for x in [*labels, "xyz", "Enero", None]], "m string")
    ranks = [row[0] for row in df.select(month_rank(F.col("m"))).collect()]
    assert ranks == [*range(1, 13), 0, 0, 0]


def test_weekdays(spark):
    df = spark.sql("select date_add(date'2025-01-05', cast(id as int)) as day from range(1, 8) union all select null")
    number = weekday_number(F.col("day"))
    rows = df.select(number, weekday_name(number), weekday_label(weekday_name(number))).collect()
    assert sorted(tuple(r) for r in rows if r[0])[::6] == [
        (1, "Monday", "Lunes"), (7, "Sunday", "Domingo")
    ]
    assert (None, None, None) in [tuple(r) for r in rows]
    other = spark.sql("select 'Someday' as d").select(weekday_label(F.col("d"))).first()[0]
    assert other == "Someday"


def test_filter(make_ops):
    ops = make_ops(
        {"operation_id": "a"},
        {"operation_id": "b", "month_name": "feb"},
        {"operation_id": "c", "year": 2024},
        {"operation_id": "d", "operation_type": "O'X"},
        {"operation_id": "e", "year": None},
    )

    def kept(**choice):
        return sorted(r.operation_id for r in apply_filter(ops, OpsFilter(**choice)).collect())

    assert kept() == list("abcde")
    assert apply_filter(ops).count() == 5
    assert kept(months=("feb",)) == ["b"]
    assert kept(years=("2024", "x", None)) == ["c"]
    assert kept(years=("x",)) == list("abcde")
    assert kept(operation_types=("O'X",)) == ["d"]
    assert kept(months=("enero",), years=(2025,), operation_types=("RSG",)) == ["a"]


def test_choice_lists(make_ops):
    ops = make_ops(*[{"month_name": name} for name in ("dic", "ene", "xyz", "abr", None)],
                   {"year": 2024, "operation_type": None})
    assert [r[0] for r in list_months(ops).where("month_name <> 'enero'").collect()] == [
        "xyz", "ene", "abr", "dic"
    ]
    assert [r[0] for r in list_years(ops).collect()] == [2025, 2024]
    assert [r[0] for r in list_operation_types(ops).collect()] == ["RSG"]
