import csv
import datetime as dt
import os
import random
import time

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from lonja.runtime import drop_staged, release, releases_staged, stage
from lonja.schema import OPERATIONS_SCHEMA
from lonja.sources import driver_tables, records, store
from lonja.sources.csv_files import (
    coerce_dates,
    detect_format,
    preview,
    read_operations_csv,
    schema_diff,
    schema_report,
    trim_columns,
    write_template,
)
from lonja.sources.upsert import upsert, upsert_summary, upsert_table, upsert_table_summary


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_utf8_comma(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'OPERACION,CLIENTE,COMISION\n1,"Peña, S.A.",2.5\n2,Díaz,\n')
    df = read_operations_csv(spark, path, schema=OPERATIONS_SCHEMA)
    assert [tuple(r) for r in df.orderBy("operation_id").collect()] == [
        ("1", "Peña, S.A.", 2.5), ("2", "Díaz", None)
    ]
    inferred = read_operations_csv(spark, path)
    assert dict(inferred.dtypes) == {
        "operation_id": "int", "client_name": "string", "commission": "double"
    }


def test_latin1_semicolon_with_late_accents_and_padded_headers(spark, tmp_path):
    lines = [f"{i};Compania, {i};1,5" for i in range(6000)] + ["x;Ñandú;2,5"]
    text = " OPERACION ; CLIENTE;nota \n" + "\n".join(lines) + "\n"
    path = write(tmp_path / "b.csv", text, "latin-1")
    assert text.index("Ñ") > 65536
    assert detect_format(spark, path) == ("ISO-8859-1", ";")
    df = read_operations_csv(spark, path, schema=OPERATIONS_SCHEMA)
    assert df.columns == ["operation_id", "client_name", "nota"]
    assert df.count() == 6001
    assert df.where("operation_id = 'x'").first().client_name == "Ñandú"


def test_tab_with_day_first_dates_and_bad_values(spark, tmp_path):
    text = "OPERACION\tFECHA REGISTRO\tYEAR\n1\t2/01/2025\t2025\n2\t31/31/2025\tsoon\n3\t\t\n"
    path = write(tmp_path / "c.csv", text)
    assert detect_format(spark, path) == ("UTF-8", "\t")
    lost = Observation()
    df = read_operations_csv(spark, path, schema=OPERATIONS_SCHEMA, unreadable="null", lost=lost)
    assert sorted(tuple(r) for r in df.collect()) == [
        ("1", dt.date(2025, 1, 2), 2025), ("2", None, None), ("3", None, None)
    ]
    assert lost.get == {"registered_on": 1, "year": 1}
    with pytest.raises(PySparkException, match="year cannot hold: soon"):
        read_operations_csv(spark, path, schema=OPERATIONS_SCHEMA).collect()


def test_format_of_empty_and_single_column_files(spark, tmp_path):
    assert detect_format(spark, write(tmp_path / "d.csv", "")) == ("UTF-8", ",")
    assert detect_format(spark, write(tmp_path / "e.csv", "OPERACION\n1\n")) == ("UTF-8", ",")


@pytest.fixture
def small_splits(spark):
    """Files are split every 300 bytes."""
    settings = {"maxPartitionBytes": "300", "openCostInBytes": "1", "minPartitionNum": "1"}
    for name, value in settings.items():
        spark.conf.set(f"spark.sql.files.{name}", value)
    yield
    for name in settings:
        spark.conf.unset(f"spark.sql.files.{name}")


def written_csv(path, rows, sep=",", encoding="utf-8", end="\n"):
    with open(path, "w", newline="", encoding=encoding) as file:
        csv.writer(file, delimiter=sep, lineterminator=end).writerows(rows)
    return str(path)


HARD = ["plain", "two\nlines", 'a "q" b', "x,y;z", 'five\n\n\n"",\n"lines', "", "é\r\nü", '5" pipe', '"', "\n", "'"]


@pytest.mark.parametrize("sep, encoding, end", [(",", "utf-8", "\n"), (";", "latin-1", "\r\n"), ("\t", "utf-8", "\n")])
def test_line_breaks_inside_quotes(spark, tmp_path, small_splits, sep, encoding, end):
    rng = random.Random(sep)
    header = ("OPERACION", " CLIENTE ", "COMISION", "no\nte")
    names = []
    for part in range(3):
        rows = [(f"{part}-{n}", rng.choice(HARD), n / 2, rng.choice(HARD)) for n in range(150)]
        written_csv(tmp_path / f"{part}.csv", [header, *rows], sep, encoding, end)
        names += [(key, name or None, value, note or None) for key, name, value, note in rows]
    df = read_operations_csv(spark, str(tmp_path), schema=OPERATIONS_SCHEMA)
    assert df.columns == ["operation_id", "client_name", "commission", "no\nte"]
    assert sorted(map(tuple, df.collect())) == sorted(names)
    inferred = read_operations_csv(spark, str(tmp_path))
    assert [kind for _, kind in inferred.dtypes] == ["string", "string", "double", "string"]


def test_quotes_inside_fields_are_text(spark, tmp_path, small_splits):
    text = "OPERACION,CLIENTE\n" + "".join(f'{n},5" pipe\n' for n in range(80))
    df = read_operations_csv(spark, write(tmp_path / "a.csv", text), schema=OPERATIONS_SCHEMA)
    assert df.count() == 80 and {r.client_name for r in df.collect()} == {'5" pipe'}
    mixed = text + '80,"two\n5"" lines"\n81,"""\n"\n'
    df = read_operations_csv(spark, write(tmp_path / "b.csv", mixed), schema=OPERATIONS_SCHEMA)
    assert {r.client_name for r in df.collect()} == {'5" pipe', 'two\n5" lines', '"\n'}
    assert df.count() == 82


def test_files_that_end_inside_quotes_or_differ_in_headers_are_refused(spark, tmp_path, small_splits):
    path = write(tmp_path / "a.csv", 'OPERACION,CLIENTE\n1,"open\n' + "2,x\n" * 200)
    with pytest.raises(ValueError, match="inside quotes"):
        read_operations_csv(spark, path, schema=OPERATIONS_SCHEMA)
    (tmp_path / "two").mkdir()
    written_csv(tmp_path / "two" / "a.csv", [("OPERACION", "CLIENTE"), ("1", "x\ny")])
    written_csv(tmp_path / "two" / "b.csv", [("CLIENTE", "OPERACION"), ("x\ny", "1")])
    with pytest.raises(ValueError, match="different headers"):
        read_operations_csv(spark, str(tmp_path / "two"), schema=OPERATIONS_SCHEMA)


def test_records_of_many_lines_and_of_one_file_without_an_end(spark, tmp_path, small_splits):
    long = "\n".join(f"line {n}" for n in range(400))
    path = written_csv(tmp_path / "a.csv", [("OPERACION", "CLIENTE"), ("1", long), ("2", "x")])
    with open(path, "a") as file:
        file.write('3,"last\none"')
    df = read_operations_csv(spark, path, schema=OPERATIONS_SCHEMA)
    assert dict(map(tuple, df.collect())) == {"1": long, "2": "x", "3": "last\none"}


def test_states_of_lines_compose():
    rng = np.random.default_rng(1)
    for _ in range(50):
        t0, t1 = rng.integers(0, 2, (2, 40))
        for start in (0, 1):
            expected, state = [], start
            for zero, one in zip(t0, t1):
                expected.append(state)
                state = int(one if state else zero)
            before, after = records._states(t0, t1, start)
            assert before.tolist() == expected and after == state


@pytest.mark.parametrize("breaks", [False, True])
def test_amounts_with_decimal_commas(spark, tmp_path, breaks):
    amounts = {"a": "1,5", "b": "1.234.567,25", "c": "-12", "d": "", "e": "7,", "f": " 2,5 "}
    rows = [(key, "x\ny" if breaks else "x", text) for key, text in amounts.items()]
    header = ("OPERACION", "CLIENTE", "COMISION")
    path = written_csv(tmp_path / "a.csv", [header, *rows], ";")
    df = read_operations_csv(spark, path, schema=OPERATIONS_SCHEMA, decimal=",")
    found = {r.operation_id: r.commission for r in df.collect()}
    assert found == {"a": 1.5, "b": 1234567.25, "c": -12.0, "d": None, "e": 7.0, "f": 2.5}
    with pytest.raises(PySparkException, match="commission cannot hold"):
        read_operations_csv(spark, path, schema=OPERATIONS_SCHEMA).collect()
    for wrong in ("1.5", "1,2,3", "1.23.456", "1 5"):
        path = written_csv(tmp_path / "b.csv", [header, ("a", "x", wrong)], ";")
        with pytest.raises(PySparkException, match="commission cannot hold"):
            read_operations_csv(spark, path, schema=OPERATIONS_SCHEMA, decimal=",").collect()
        lost = Observation()
        df = read_operations_csv(spark, path, schema=OPERATIONS_SCHEMA, decimal=",", unreadable="null", lost=lost)
        assert df.first().commission is None and lost.get == {"commission": 1}
    with pytest.raises(ValueError):
        read_operations_csv(spark, path, decimal="'")


def test_an_unreadable_amount_keeps_the_upload_out_of_the_table(spark, make_ops, tmp_path):
    table = store.create_operations(make_ops({"operation_id": "a"}), str(tmp_path / "table"))
    path = written_csv(tmp_path / "a.csv", [("OPERACION", "COMISION"), ("a", "1,5"), ("b", "2")], ";")
    with pytest.raises(PySparkException):
        upsert_table(table, read_operations_csv(spark, path, schema=OPERATIONS_SCHEMA))
    assert keyed(store.read_table(spark, table.folder)) == [("a", 10.0)]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2/01/2025", (2025, 1, 2, 0, 0, 0)),
        ("31-12-2024 13:05", (2024, 12, 31, 13, 5, 0)),
        (" 5.6.2025 ", (2025, 6, 5, 0, 0, 0)),
        ("2025-01-02T10:00:01", (2025, 1, 2, 10, 0, 1)),
        ("2025/1/2", (2025, 1, 2, 0, 0, 0)),
        ("02/03/25", (2025, 3, 2, 0, 0, 0)),
        ("02/03/95", (1995, 3, 2, 0, 0, 0)),
        ("02/03/68", (2068, 3, 2, 0, 0, 0)),
        ("01/31/2025", None),
        ("31/31/2025", None),
        ("2025-01-02 junk", None),
        ("", None),
    ],
)
def test_dates(spark, text, expected):
    df = spark.createDataFrame([(text, text, text)], "registered_on string, at string, other string")
    schema = spark.createDataFrame([], "registered_on date, at timestamp, other string").schema
    row = coerce_dates(df, schema).first()
    moment = dt.datetime(*expected) if expected else None
    assert tuple(row) == (moment and moment.date(), moment, text)


def test_schema_report_preview_and_template(spark, make_ops, tmp_path):
    ops = make_ops(*[{"operation_id": str(i)} for i in range(9)])
    upload = trim_columns(spark.createDataFrame([("1", "x")], "` operation_id` string, ` a b ` string"))
    report = {r.column: r.status for r in schema_diff(upload, ops).collect()}
    assert report.pop("a b") == "extra"
    assert report.pop("operation_id") == "matched"
    assert set(report.values()) == {"missing"} and len(report) == 19
    held = {r.column: (r.status, r.held) for r in schema_report(upload, ops).collect()}
    assert held["a b"] == ("extra", 1) and held["operation_id"] == ("matched", 1)
    assert held["client_name"] == ("missing", 0) and len(held) == 21
    assert preview(ops).count() == 5
    folder = str(tmp_path / "template")
    write_template(ops, folder)
    files = [name for name in os.listdir(folder) if name.endswith(".csv")]
    assert len(files) == 1
    with open(f"{folder}/{files[0]}") as template:
        assert template.read().strip() == ",".join(ops.columns)


def upload(spark, *rows):
    return spark.createDataFrame(rows, "operation_id string, commission string, extra string")


def keyed(df):
    pairs = [(r.operation_id, r.commission) for r in df.collect()]
    return sorted(pairs, key=lambda pair: (pair[0] or "", pair[1]))


def test_upsert(spark, make_ops):
    table = make_ops({"operation_id": "a"}, {"operation_id": "b"}, {"operation_id": None})
    batch = upload(spark, ("b", "1", "x"), ("b", "2", "x"), (None, "3", "x"), ("n", "4", "x"))
    merged = upsert(table, batch)
    assert merged.schema.names == table.schema.names
    assert keyed(merged) == [
        (None, 3.0), (None, 10.0), ("a", 10.0), ("b", 1.0), ("b", 2.0), ("n", 4.0)
    ]
    assert merged.where("operation_id = 'n'").first().client_name is None
    assert tuple(upsert_summary(table, batch).first()) == (4, 1, 2)


def test_upsert_without_key_appends_and_without_columns_fails(spark, make_ops):
    table = make_ops({"operation_id": "a"})
    batch = spark.createDataFrame([(1.5,)], "commission double")
    assert keyed(upsert(table, batch)) == [(None, 1.5), ("a", 10.0)]
    assert tuple(upsert_summary(table, batch).first()) == (1, 0, 1)
    with pytest.raises(ValueError):
        upsert(table, spark.createDataFrame([(1,)], "unknown int"))


def test_upsert_again_changes_nothing_and_separate_batches_commute(spark, make_ops):
    table = make_ops({"operation_id": "a"}, {"operation_id": "b"})
    one = upload(spark, ("b", "1", "x"), ("n", "2", "x"))
    two = upload(spark, ("a", "3", "x"), ("m", "4", "x"))
    once = upsert(table, one)
    assert keyed(upsert(once, one)) == keyed(once)
    assert keyed(upsert(once, two)) == keyed(upsert(upsert(table, two), one))


def test_upsert_reads_dates_day_first_and_rejects_bad_numbers(spark, make_ops):
    table = make_ops({"operation_id": "a"})
    dated = spark.createDataFrame([("a", "2/01/2025")], "operation_id string, registered_on string")
    assert upsert(table, dated).first().registered_on == dt.date(2025, 1, 2)
    with pytest.raises(PySparkException):
        upsert(table, upload(spark, ("a", "ten", "x"))).collect()


def files_of(df):
    return {name.split("/data/")[1] for name in df.inputFiles()}


def test_publish_replaces_whole_versions(spark, make_ops, tmp_path):
    folder = str(tmp_path / "table")
    table = store.create_operations(make_ops({"operation_id": "a"}), folder, ["year"])
    merged = upsert(table.rows(), upload(spark, ("a", "1", "x"), ("n", "2", "x")))
    following = store.publish(merged, table)
    assert keyed(store.read_table(spark, folder)) == [("a", 1.0), ("n", 2.0)]
    assert (table.version, following.version, store.current_version(spark, folder)) == (1, 2, 2)
    assert following.partition_by == ("year",)
    assert all("/_by_year=" in name for name in files_of(following.rows()))
    # a reader of the version before still has its files
    assert keyed(table.rows()) == [("a", 10.0)]
    assert keyed(store.open_table(spark, folder, 1).rows()) == [("a", 10.0)]


def test_a_failed_write_leaves_the_table_and_no_files(spark, make_ops, tmp_path):
    folder = str(tmp_path / "table")
    table = store.create_operations(make_ops({"operation_id": "a"}), folder)
    before = sorted(os.listdir(f"{folder}/data"))
    bad = upload(spark, ("a", "ten", "x"))
    with pytest.raises(PySparkException):
        store.publish(upsert(table.rows(), bad), table)
    with pytest.raises(PySparkException):
        upsert_table(table, bad)
    with pytest.raises(ValueError):
        store.publish(table.rows().drop("year"), table)
    assert keyed(store.read_table(spark, folder)) == [("a", 10.0)]
    assert sorted(os.listdir(f"{folder}/data")) == before
    assert [n for n in os.listdir(f"{folder}/versions") if not n.endswith(".crc")] == ["v00000001.json"]


def test_the_second_of_two_writers_gets_an_error(spark, make_ops, tmp_path):
    folder = str(tmp_path / "table")
    table = store.create_operations(make_ops({"operation_id": "a"}, {"operation_id": "b"}), folder)
    one, two = upload(spark, ("a", "1", "x")), upload(spark, ("b", "2", "x"))
    following = upsert_table(table, one)
    written = sorted(os.listdir(f"{folder}/data"))
    for write in (lambda: upsert_table(table, two), lambda: store.publish(upsert(table.rows(), two), table)):
        with pytest.raises(store.StaleTable):
            write()
    assert sorted(os.listdir(f"{folder}/data")) == written
    assert keyed(store.read_table(spark, folder)) == [("a", 1.0), ("b", 10.0)]
    upsert_table(following, two)
    assert keyed(store.read_table(spark, folder)) == [("a", 1.0), ("b", 2.0)]


def test_upsert_in_place_leaves_other_files_alone(spark, make_ops, tmp_path):
    rows = [{"operation_id": f"id{n}", "year": 2024 + n % 2} for n in range(200)] + [{"operation_id": None}] * 3
    table = store.create_operations(make_ops(*rows), str(tmp_path / "table"), ["year"], buckets=16)
    before = files_of(table.rows())
    batch = upload(spark, ("id7", "1", "x"), ("id7", "2", "x"), ("new", "3", "x"), (None, "4", "x"))
    following = upsert_table(table, batch)
    after = files_of(following.rows())
    changed = {name.split("/")[1] for name in before ^ after}
    hit = {r.bucket for r in batch.select(table.bucket().alias("bucket")).distinct().collect()}
    assert changed == {f"_bucket={bucket}" for bucket in hit} and len(hit) == 3
    assert len(before & after) >= len(before) - 4
    # rows without a key are added to, not rewritten
    assert {n for n in before if "/_bucket=-1/" in n} < {n for n in after if "/_bucket=-1/" in n}
    assert keyed(following.rows()) == keyed(upsert(table.rows(), batch))
    assert tuple(upsert_table_summary(table, batch).first()) == (4, 1, 2)
    assert tuple(upsert_table_summary(following, batch).first()) == (4, 3, 1)


def test_upsert_in_place_without_the_key_or_without_rows(spark, make_ops, tmp_path):
    table = store.create_operations(make_ops({"operation_id": "a"}), str(tmp_path / "one"))
    added = upsert_table(table, spark.createDataFrame([(1.5,)], "commission double"))
    assert keyed(added.rows()) == [(None, 1.5), ("a", 10.0)]
    assert tuple(upsert_table_summary(table, spark.createDataFrame([(1.5,)], "commission double")).first()) == (1, 0, 1)
    same = upsert_table(added, upload(spark, ("a", "1", "x")).where("false"))
    assert keyed(same.rows()) == keyed(added.rows()) and same.version == 3
    empty = store.create_operations(make_ops({}).where("false"), str(tmp_path / "two"))
    assert empty.rows().count() == 0 and empty.rows().schema == empty.schema
    assert keyed(upsert_table(empty, upload(spark, ("a", "1", "x"))).rows()) == [("a", 1.0)]
    unkeyed = store.create_operations(spark.createDataFrame([(1.5,)], "commission double"), str(tmp_path / "three"))
    assert unkeyed.key is None
    both = upsert_table(unkeyed, upload(spark, ("a", "1", "x")))
    assert sorted(r.commission for r in both.rows().collect()) == [1.0, 1.5]


def test_partition_values_come_back_as_they_were(spark, tmp_path):
    cities = ["007", "7", "", None, "a/b=c", "2024-01-02", "n", "v", " x ", "ñ%20"]
    days = [None, dt.date(2025, 1, 2)]
    rows = [(f"k{n}", city, days[n % 2]) for n, city in enumerate(cities)]
    df = spark.createDataFrame(rows, "operation_id string, buyer_city string, registered_on date")
    table = store.create_operations(df, str(tmp_path / "table"), ["buyer_city", "registered_on"], buckets=2)
    read = store.read_table(spark, table.folder)
    assert read.schema == df.schema
    assert sorted(map(tuple, read.collect())) == sorted(rows)
    chosen = read.where("buyer_city = '007'")
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "_by_buyer_city" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert [r.operation_id for r in chosen.collect()] == ["k0"]
    with pytest.raises(ValueError):
        store.create_operations(df.withColumn("x", F.lit(1.5)), str(tmp_path / "other"), ["x"])


def test_create_again_replaces_rows_and_layout(spark, make_ops, tmp_path):
    folder = str(tmp_path / "table")
    store.create_operations(make_ops({"operation_id": "a"}), folder, ["year"])
    small = spark.createDataFrame([("z",)], "operation_id string")
    assert store.create_operations(small, folder, buckets=4).version == 2
    assert [tuple(r) for r in store.read_table(spark, folder).collect()] == [("z",)]
    with pytest.raises(FileNotFoundError):
        store.open_table(spark, str(tmp_path / "none"))


def test_rebucket_and_vacuum(spark, make_ops, tmp_path):
    folder = str(tmp_path / "table")
    table = store.create_operations(make_ops(*[{"operation_id": f"id{n}"} for n in range(50)]), folder, buckets=4)
    following = upsert_table(table, upload(spark, ("id1", "1", "x"), (None, "2", "x")))
    expected = keyed(following.rows())
    store.vacuum(spark, folder)  # too young
    assert keyed(table.rows()) != expected
    store.vacuum(spark, folder, older_than_hours=0)
    kept = {f"_write={d}" for name in files_of(following.rows()) for d in [name.split("/")[0].split("=")[1]]}
    assert {n for n in os.listdir(f"{folder}/data")} == kept
    held = {f"{top}/{b}" for top in kept for b in os.listdir(f"{folder}/data/{top}") if b.startswith("_bucket")}
    assert held == {path for paths in following.parts.values() for path in paths}
    assert keyed(store.read_table(spark, folder)) == expected
    dealt = store.rebucket(following, 7)
    assert keyed(dealt.rows()) == expected and set(dealt.parts) <= {-1, *range(7)}
    store.vacuum(spark, folder, older_than_hours=0)
    assert keyed(store.read_table(spark, folder)) == expected
    with pytest.raises(FileNotFoundError):
        store.open_table(spark, str(tmp_path / "nothing"))


def test_snapshot(spark, make_ops, tmp_path):
    ops = make_ops({"operation_id": "a"}, {"operation_id": None})
    path = str(tmp_path / "snapshot")
    store.save_snapshot(ops, path)
    restored = store.load_snapshot(spark, path)
    assert restored.schema == ops.schema
    assert keyed(restored) == keyed(ops)
    with pytest.raises(PySparkException):
        store.save_snapshot(ops, path)


def test_staged_tables(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    staged = stage(spark.range(5).select(F.col("id").alias("x")), "numbers")
    assert staged.inputFiles()[0].startswith(f"file://{folder}")
    assert staged.agg(F.sum("x")).first()[0] == 10
    drop_staged(spark)
    assert not os.path.exists(f"{folder}/lonja-{spark.sparkContext.applicationId}")


def staged_names(spark):
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/lonja-{spark.sparkContext.applicationId}"
    names = os.listdir(folder) if os.path.exists(folder) else []
    return sorted(name.split("-")[0] for name in names)


def test_staged_tables_live_as_long_as_the_result_reads_them(spark):
    drop_staged(spark)

    @releases_staged
    def inner(n):
        numbers = stage(spark.range(n), "replaced")
        return stage(numbers.select((F.col("id") + 1).alias("id")), "inner").where("id > 1")

    @releases_staged
    def outer():
        left, right = inner(5), stage(spark.range(3), "outer")
        largest = stage(spark.range(4).toDF("v"), "subquery")
        return left.join(right, "id").withColumn("largest", largest.agg(F.max("v")).scalar())

    result = outer()
    assert staged_names(spark) == ["inner", "outer", "subquery"]
    assert [tuple(r) for r in result.collect()] == [(2, 3)]
    release(result)
    assert staged_names(spark) == []


def test_an_operator_that_fails_leaves_no_staged_table(spark):
    drop_staged(spark)
    kept = stage(spark.range(3), "kept")

    @releases_staged
    def fails():
        stage(kept, "lost")
        raise ValueError

    @releases_staged
    def counts():
        return stage(kept, "counted").count()

    with pytest.raises(ValueError):
        fails()
    assert counts() == 3
    assert staged_names(spark) == ["kept"]
    release(kept)
    assert staged_names(spark) == []


def shuffled_files(spark):
    """The names of shuffle files on the executors' disks; here there is one executor."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    found = set()
    for top in manager.localDirsString():
        for _, _, names in os.walk(top):
            found |= {name for name in names if name.startswith("shuffle_") and name.endswith(".data")}
    return found


def left_behind(spark, before):
    """Shuffle files that are new, after the cleaner had some time."""
    for _ in range(50):
        if not shuffled_files(spark) - before:
            break
        time.sleep(0.1)
    return shuffled_files(spark) - before


def test_writing_a_table_leaves_no_shuffle_files(spark, make_ops, tmp_path):
    ops = make_ops(*[{"operation_id": f"id{n}"} for n in range(40)]).repartition("operation_id")
    before = shuffled_files(spark)
    table = store.create_operations(ops, str(tmp_path / "table"), ["year"], buckets=4)
    assert not left_behind(spark, before)
    store.publish(upsert(table.rows(), upload(spark, ("id1", "1", "x"))), table)
    assert not left_behind(spark, before)
    store.save_snapshot(ops, str(tmp_path / "snapshot"))
    assert not left_behind(spark, before)


@pytest.fixture
def small_rounds(monkeypatch):
    monkeypatch.setattr(store, "ROUND_BYTES", 2000)


def test_large_tables_are_written_in_rounds_of_buckets(spark, make_ops, tmp_path, small_rounds, monkeypatch):
    rows = [{"operation_id": f"id{n % 90}", "year": 2024 + n % 2, "buyer_name": f"b{n}"} for n in range(300)]
    ops = make_ops(*rows, *[{"operation_id": None, "year": None}] * 3)
    drop_staged(spark)
    table = store.create_operations(ops, str(tmp_path / "table"), ["year"], buckets=16)
    assert 1 < table.rounds(4001) <= table.rounds(10**9) == store.ROUNDS
    assert sorted(map(repr, table.rows().collect())) == sorted(map(repr, ops.collect()))
    hashed = {r.bucket for r in ops.select(table.bucket().alias("bucket")).distinct().collect()}
    assert set(table.parts) == hashed and store.NO_KEY in hashed
    for bucket in hashed:
        assert {r.bucket for r in table.rows([bucket]).select(table.bucket().alias("bucket")).collect()} == {bucket}

    written = []
    write = store.StoredTable.write
    monkeypatch.setattr(store.StoredTable, "write", lambda self, rows: written.append(1) or write(self, rows))
    batch = upload(spark, *[(f"id{n}", str(n), "x") for n in range(60, 120)], ("id60", "7", "x"), (None, "3", "x"))
    following = upsert_table(table, batch)
    assert len(written) > 1
    assert keyed(following.rows()) == keyed(upsert(table.rows(), batch))
    assert keyed(store.publish(upsert(table.rows(), batch), store.open_table(spark, table.folder)).rows()) == keyed(
        following.rows()
    )
    assert staged_names(spark) == []


def test_a_round_that_fails_takes_the_earlier_rounds_along(spark, make_ops, tmp_path, small_rounds, monkeypatch):
    rows = [{"operation_id": f"id{n}", "buyer_name": f"b{n * 7919}"} for n in range(300)]
    table = store.create_operations(make_ops(*rows), str(tmp_path / "table"), buckets=16)
    before = sorted(os.listdir(f"{table.folder}/data"))
    write, calls = store.StoredTable.write, []

    def fails_later(self, rows):
        calls.append(1)
        if len(calls) > 1:
            raise RuntimeError("disk full")
        return write(self, rows)

    monkeypatch.setattr(store.StoredTable, "write", fails_later)
    with pytest.raises(RuntimeError, match="disk full"):
        upsert_table(table, upload(spark, *[(f"id{n}", "1", "x") for n in range(300)]))
    assert len(calls) == 2 and sorted(os.listdir(f"{table.folder}/data")) == before
    assert keyed(store.read_table(spark, table.folder)) == keyed(table.rows())


@pytest.fixture
def star(spark, tmp_path):
    """A small star schema; a line, an order and a part come twice, and keys are null or unknown."""
    tables = {
        "nation": ("n_nationkey long, n_name string", [(n, f"N{n}") for n in range(3)]),
        "customer": ("c_custkey long, c_name string, c_nationkey long", [(n, f"c{n}", n % 4) for n in range(9)]),
        "supplier": ("s_suppkey long, s_name string, s_nationkey long", [(n, f"s{n}", n % 3) for n in range(5)]),
        "part": ("p_partkey long, p_name string", [(n % 6, f"p{n}") for n in range(7)]),
        "orders": (
            "o_orderkey long, o_custkey long, o_orderdate date",
            [(n % 20, n % 10, dt.date(2025, 1 + n % 12, 2)) for n in range(21)],
        ),
        "lineitem": (
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, "
            "l_discount double, l_tax double, l_returnflag string, l_linestatus string",
            [
                (n % 21, n % 6, n % 5 if n % 13 else None, n % 4, n * 1.5, 0.05, 0.02, "NRA"[n % 3], "OF"[n % 2])
                for n in [*range(80), 3]
            ],
        ),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_small_dimensions_are_broadcast_to_the_facts(spark, star):
    size = max(
        os.path.getsize(os.path.join(top, name)) for top, _, names in os.walk(star) for name in names
        if "lineitem" not in top
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(8 * size))
    try:
        ops = driver_tables.operations(spark, star, ("operation_id", "seller_name", "seller_city"))
        plan = ops._jdf.queryExecution().executedPlan().toString()
        # the supplier with its nation, joined first, has no known size
        assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_operations_of_repeated_null_and_unknown_keys(spark, star):
    def table(name):
        return [r.asDict() for r in spark.read.parquet(f"{star}/{name}.parquet").collect()]

    expected = [
        (line["l_extendedprice"] * 1000, c["c_name"], bn["n_name"], s["s_name"], sn["n_name"], p["p_name"])
        for line in table("lineitem")
        for s in table("supplier") if s["s_suppkey"] == line["l_suppkey"]
        for sn in table("nation") if sn["n_nationkey"] == s["s_nationkey"]
        for p in table("part") if p["p_partkey"] == line["l_partkey"]
        for o in table("orders") if o["o_orderkey"] == line["l_orderkey"]
        for c in table("customer") if c["c_custkey"] == o["o_custkey"]
        for bn in table("nation") if bn["n_nationkey"] == c["c_nationkey"]
    ]
    columns = ("business_value", "buyer_name", "buyer_city", "seller_name", "seller_city", "product")
    found = [tuple(r) for r in driver_tables.operations(spark, star, columns).collect()]
    assert sorted(found) == sorted(expected) and len(set(found)) < len(found)
    assert driver_tables.operations(spark, star).count() == len(expected)
