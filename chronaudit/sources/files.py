"""Parquet and CSV files, and a shared place for files that a job writes for itself."""

from __future__ import annotations

import csv
import tempfile
import uuid
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronaudit.functions.dates import parse_text_date


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    date_cols: Iterable[str] = (),
    null_text: str | None = None,
    drop_index: bool = True,
    strict: bool = False,
) -> DataFrame:
    """CSV with a header. Date columns may hold any of the known text forms.

    Text that is no date reads as null; with ``strict`` it is an error, blank text apart.

    Without a schema every column is text. A blank first header, left behind by an
    index column, is dropped. ``null_text`` (such as N/A) reads as null.
    """
    reader = spark.read.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.csv(path)
    if drop_index and df.columns and df.columns[0] in ("_c0", ""):
        df = df.drop(df.columns[0])
    if null_text is not None:
        texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
        df = df.withColumns({c: F.nullif(F.col(c), F.lit(null_text)) for c in texts})
    parsed = {c: _parsed(c, strict) for c in date_cols}
    return df.withColumns(parsed) if parsed else df


class CheckedCsv(NamedTuple):
    """Rows whose cells all read as they should, and the lines of all others."""

    typed: DataFrame
    quarantined: DataFrame


def read_csv_checked(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    date_cols: Iterable[str] = (),
    null_text: str | None = None,
) -> CheckedCsv:
    """CSV lines as typed rows, or as quarantined ones: file, line and reason.

    Every line but headers and blank ones is in one of the two. A line is quarantined if it
    has more or fewer cells than the header, or a cell that is neither blank nor of its
    column's type; the reason names all such cells. Columns are found by the names in the
    header, which all files under the path share; header columns that the schema lacks are
    not read. ``date_cols`` are dates in any of the known text forms; ``null_text`` (such as
    N/A) and blank cells read as null. A quoted cell must not run over the end of a line.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("line"), F.col("_metadata.file_path").alias("file"))
    lines = lines.where(F.trim("line") != "")
    first = lines.select("line").first()
    if first is None:
        raise ValueError(f"{path}: no header")
    header = next(csv.reader([first["line"]]))
    fields = list(spark.createDataFrame([], schema).schema)
    lacking = [f.name for f in fields if f.name not in header]
    if lacking:
        raise ValueError(f"{path}: no column {', '.join(lacking)}")
    cells = ", ".join(f"c{i} string" for i in range(len(header)))
    parsed = F.from_csv("line", f"{cells}, bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    rows = _once(lines.where(F.col("line") != first["line"]), "cells", parsed)

    dated, values, faults = set(date_cols), [], []
    for i, f in enumerate(fields):
        raw = F.col(f"cells.c{header.index(f.name)}")
        text = F.when(F.trim(raw) != "", raw)
        if null_text is not None:
            text = F.nullif(text, F.lit(null_text))
        kind = "date" if f.name in dated else f.dataType.simpleString()
        value = parse_text_date(text) if f.name in dated else text if kind == "string" else F.trim(text).try_cast(f.dataType)
        values.append(value.alias(f"v{i}"))
        if kind != "string":
            faults.append(F.when(text.isNotNull() & F.col(f"row.v{i}").isNull(), F.concat(F.lit(f"{f.name}: not {kind}: "), text)))
    count = F.when(F.col("cells.bad").isNotNull(), F.lit(f"not {len(header)} cells"))
    reason = F.coalesce(count, F.concat_ws("; ", *faults) if faults else F.lit(""))
    judged = _once(rows, "row", F.struct(*values)).withColumn("reason", reason)
    typed = judged.where("reason = ''").select(*[F.col(f"row.v{i}").alias(f.name) for i, f in enumerate(fields)])
    return CheckedCsv(typed, judged.where("reason <> ''").select("file", "line", "reason"))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that is computed once for each row, however often later columns and filters name it.

    Spark writes a plain column out at every mention and moves filters below it; a generator of
    one row keeps it whole.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def _parsed(name: str, strict: bool) -> Column:
    text, parsed = F.col(name).cast("string"), parse_text_date(F.col(name))
    if not strict:
        return parsed
    said = F.concat(F.lit(f"{name}: not a date: "), text)
    return F.when(parsed.isNull() & (F.trim(text) != ""), F.raise_error(said).cast("date")).otherwise(parsed)


def write_by_year(
    df: DataFrame, path: str, date_col: str, year_col: str = "year", files_per_year: int = 1
) -> None:
    """Parquet in one folder per year, for ``TableSpec(year_col=...)``.

    Rows are dealt out by year and a part of it, so a year has ``files_per_year`` files at
    most, however many tasks read the rows; the more rows a year has, the more it should be.
    """
    part = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_year))
    (
        df.withColumn(year_col, F.year(date_col))
        .repartition(year_col, part)
        .write.mode("errorifexists")
        .partitionBy(year_col)
        .parquet(path)
    )


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder set by ``spark.checkpoint.dir``.

    Only where that is unset (a local session) does it fall back to the machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="chronaudit-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
