"""Operations from delimited text files, and the checks made before they are loaded."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lonja.schema import SOURCE_COLUMNS
from lonja.sources.records import opens, read_records

DELIMITERS = (",", ";", "\t", "|")
FALLBACK_ENCODING = "ISO-8859-1"

# Rewritten to year-month-day: day first, and two-digit years from 1969 to 2068.
DATE_SHAPES = (
    (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?!\d)", "$3-$2-$1"),
    (r"^(\d{1,2})[-/.](\d{1,2})[-/.](69|[7-9]\d)(?!\d)", "19$3-$2-$1"),
    (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{2})(?!\d)", "20$3-$2-$1"),
    (r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})(?!\d)", "$1-$2-$3"),
)

_QUOTED = '"[^"]*"'
_MOMENTS = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _look(spark: SparkSession, path: str) -> tuple[str, str, bool]:
    """Encoding, delimiter, and whether some line breaks are inside quotes; one pass."""
    lines = spark.read.text(path)
    header = lines.first()
    if header is None:
        return "UTF-8", DELIMITERS[0], False
    names = re.sub(_QUOTED, "", header.value)
    candidates = [mark for mark in DELIMITERS if mark in names] or [DELIMITERS[0]]
    bare = F.regexp_replace("value", _QUOTED, "")
    counts = {}
    for i, mark in enumerate(candidates):
        alike = F.regexp_count(bare, F.lit(re.escape(mark))) == names.count(mark)
        counts |= {f"like_{i}": F.count_if(alike), f"open_{i}": F.count_if(opens(F.col("value"), mark))}
    found = lines.agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
        *[count.alias(name) for name, count in counts.items()],
    ).first()
    best = max(range(len(candidates)), key=lambda i: (found[f"like_{i}"], names.count(candidates[i])))
    encoding = "UTF-8" if found.utf8 else FALLBACK_ENCODING
    return encoding, candidates[best], found[f"open_{best}"] > 0


def detect_format(spark: SparkSession, path: str) -> tuple[str, str]:
    """Encoding and delimiter of the file or files at ``path``, from one pass over every line.

    The text is UTF-8 unless some line is not valid. The delimiter is the one whose count in
    the header recurs on most lines, outside quotes.
    """
    return _look(spark, path)[:2]


def trim_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.strip() for name in df.columns])


def rename_source_columns(df: DataFrame) -> DataFrame:
    """Known headers become our column names; other columns keep theirs."""
    return df.withColumnsRenamed(SOURCE_COLUMNS)


def _as_timestamp(text: Column) -> Column:
    text = F.trim(text)
    for shape, year_first in DATE_SHAPES:
        text = F.regexp_replace(text, shape, year_first)
    return text.try_cast("timestamp_ntz")


def coerce_dates(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Read text day-first into the date and timestamp columns of ``schema``; bad text is NULL."""
    types = {field.name: field.dataType for field in schema}

    def read(name: str) -> Column:
        column, wanted = F.col(f"`{name}`"), types.get(name)
        if not isinstance(wanted, _MOMENTS):
            return column
        if isinstance(df.schema[name].dataType, _MOMENTS):
            return column.cast(wanted).alias(name)
        return _as_timestamp(column.cast("string")).cast(wanted).alias(name)

    return df.select(*[read(name) for name in df.columns])


def _as_number(text: Column, decimal: str) -> Column:
    """Text with the given decimal mark, in groups of three or not, as a number's usual text."""
    if decimal == ".":
        return text
    shape = r"^[+-]?([0-9]{1,3}(\.[0-9]{3})+|[0-9]+)(,[0-9]*)?$"
    return F.when(text.rlike(shape), F.translate(text, ",.", "."))


def _typed(df: DataFrame, schema: T.StructType, decimal: str) -> dict[str, tuple[Column, Column]]:
    """For each column that ``schema`` gives a type other than text: its value, and whether text was
    lost."""
    found = {}
    for name in df.columns:
        wanted = next((f.dataType for f in schema if f.name == name), None)
        if wanted is None or isinstance(wanted, T.StringType):
            continue
        text = F.trim(F.col(f"`{name}`"))
        if isinstance(wanted, _MOMENTS):
            value = _as_timestamp(text).cast(wanted)
        elif isinstance(wanted, T.NumericType):
            value = _as_number(text, decimal).try_cast(wanted)
        else:
            value = text.try_cast(wanted)
        found[name] = value, (text != "") & value.isNull()
    return found


def read_operations_csv(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    encoding: str | None = None,
    schema: T.StructType | None = None,
    multi_line: bool | None = None,
    decimal: str = ".",
    unreadable: str = "raise",
    lost: Observation | None = None,
) -> DataFrame:
    """The rows of a delimited file with a header, or of several with the same header.

    Headers are trimmed and known ones renamed. With ``schema`` its columns take its types; without
    one, types are inferred in another pass. ``decimal`` may be a comma.

    Text that is no number, or not one of the column's type, ends the job with an error that quotes
    it; ``unreadable="null"`` makes it NULL. Text that is no date is NULL, as dates are coerced. How
    much text became NULL is counted for each column on the same read: name an ``Observation`` as
    ``lost``. (A sort reads its input twice and counts twice; write or collect the rows first.)

    Line breaks inside quotes are found by the pass that detects the format and read in parallel.
    Naming ``sep``, ``encoding`` and ``multi_line`` (whether there are such breaks) saves that pass.
    """
    if unreadable not in ("raise", "null") or decimal not in (".", ","):
        raise ValueError("unreadable is raise or null, and decimal a point or a comma")
    if sep is None or encoding is None or multi_line is None:
        found_encoding, found_sep, breaks = _look(spark, path)
        sep, encoding = sep or found_sep, encoding or found_encoding
        multi_line = breaks if multi_line is None else multi_line
    options = {"sep": sep, "quote": '"', "escape": '"'}
    if multi_line:
        raw = _from_records(spark, path, sep, encoding, options)
    else:
        raw = spark.read.csv(path, header=True, encoding=encoding, inferSchema=schema is None, **options)
    df = rename_source_columns(trim_columns(raw))
    if schema is None:
        return _inferred(df) if multi_line else df
    typed = _typed(df, schema, decimal)
    if lost is not None and typed:
        df = df.observe(lost, *[F.count_if(gone).alias(name) for name, (_, gone) in typed.items()])

    def read(name: str) -> Column:
        if name not in typed:
            return F.col(f"`{name}`")
        value, gone = typed[name]
        if unreadable == "raise" and not isinstance(schema[name].dataType, _MOMENTS):
            told = F.concat(F.lit(f"{name} cannot hold: "), F.col(f"`{name}`"))
            value = F.when(gone, F.raise_error(told)).otherwise(value)
        return value.alias(name)

    return df.select(*[read(name) for name in df.columns])


def _from_records(spark: SparkSession, path: str, sep: str, encoding: str, options: dict) -> DataFrame:
    """The fields of records that may hold line breaks, as text."""
    records, headers = read_records(spark, path, sep, encoding)
    parse = {**options, "multiLine": "true"}

    def fields(names: list[str]) -> Column:
        written = ", ".join("`" + name.replace("`", "``") + "` string" for name in names)
        return F.from_csv("value", written, parse)

    many = [f"c{n}" for n in range(max((h.count(sep) for h in headers), default=0) + 1)]
    rows = spark.createDataFrame([(h,) for h in headers], "value string").select(fields(many).alias("f")).collect()
    names = {tuple(name.strip() for name in row["f"] if name is not None) for row in rows}
    if len(names) != 1:
        raise ValueError(f"files with different headers: {sorted(names)}")
    (named,) = names
    return records.select(fields(list(named)).alias("f")).select("f.*")


def _inferred(df: DataFrame) -> DataFrame:
    """Text columns as the first of some types that all their values have."""
    kinds = ("int", "bigint", "double", "date", "timestamp", "boolean")
    held = F.lit(True)
    checks = []
    for n, name in enumerate(df.columns):
        text = F.col(f"`{name}`")
        for kind in kinds:
            fits = text.try_cast(kind).isNotNull()
            if kind == "boolean":
                fits = F.lower(text).isin("true", "false")
            checks.append(F.bool_and(F.when(text.isNull(), held).otherwise(fits)).alias(f"{n}_{kind}"))
        checks.append(F.count(text).alias(f"{n}_held"))
    found = df.agg(*checks).first()
    types = [
        next((k for k in kinds if found[f"{n}_held"] and found[f"{n}_{k}"]), "string")
        for n in range(len(df.columns))
    ]
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in zip(df.columns, types)])


def schema_diff(incoming: DataFrame, target: DataFrame) -> DataFrame:
    """Each column as ``matched``, ``missing`` from the upload or ``extra`` in it."""
    arriving, expected = incoming.columns, target.columns
    rows = [(name, "matched" if name in expected else "extra") for name in arriving]
    rows += [(name, "missing") for name in expected if name not in arriving]
    return incoming.sparkSession.createDataFrame(rows, "column string, status string")


def schema_report(incoming: DataFrame, target: DataFrame) -> DataFrame:
    """``schema_diff`` with the number of values that each column of the upload holds."""
    counts = [F.count(F.col(f"`{name}`")).alias(f"n{i}") for i, name in enumerate(incoming.columns)]
    held = [F.struct(F.lit(name).alias("column"), F.col(f"n{i}").alias("held")) for i, name in enumerate(incoming.columns)]
    counted = incoming.agg(*counts).select(F.inline(F.array(*held)))
    return schema_diff(incoming, target).join(counted, "column", "left").select(
        "column", "status", F.coalesce("held", F.lit(0)).alias("held")
    )


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def write_template(df: DataFrame, path: str) -> None:
    """A file with the table's header and no rows."""
    df.limit(0).coalesce(1).write.csv(path, header=True)
