"""Appending to existing tables."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronaudit.sources.files import scratch_path


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def aligned(df: DataFrame, target: T.StructType) -> DataFrame:
    """The rows in the target's column order and types; absent columns become null."""
    unknown = [c for c in df.columns if c not in target.names]
    if unknown:
        raise ValueError(f"target has no column {', '.join(unknown)}")
    return nan_to_null(df).select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in target
        ]
    )


def append(
    spark: SparkSession, df: DataFrame, table: str, allowed_databases: Sequence[str], batch: str | None = None,
    batch_col: str = "batch",
) -> None:
    """Append rows by column name to an existing ``database.table``.

    The rows are written beside the table first and counted, so that an empty input or one
    that fails leaves the table alone; then they are committed as a whole by the job commit.
    NaN becomes null. An empty input, a foreign database or an unknown table is an error.

    With ``batch`` the table must be partitioned by ``batch_col``: the batch's partition is
    replaced, so that doing it again after a failure adds nothing twice. Where no such column
    is at hand, ``publish.BatchTable`` gives the same.
    """
    database = table.split(".")[0].lower()
    if database not in [d.lower() for d in allowed_databases]:
        raise ValueError(f"choose a database from {', '.join(allowed_databases)}")
    if not spark.catalog.tableExists(table):
        raise ValueError(f"table {table} does not exist")
    target = spark.table(table).schema
    if batch is not None:
        parts = [c.name for c in spark.catalog.listColumns(table) if c.isPartition]
        if parts != [batch_col]:
            raise ValueError(f"table {table} is not partitioned by {batch_col}")
        target = T.StructType([f for f in target if f.name != batch_col])
    written, staged = Observation(), scratch_path(spark, "append-rows")  # counted while writing
    aligned(df, target).observe(written, F.count(F.lit(1)).alias("n")).write.parquet(staged)
    if not written.get["n"]:
        raise ValueError("nothing to append")
    rows = spark.read.schema(target).parquet(staged)
    if batch is None:
        rows.write.insertInto(table, overwrite=False)
        return
    names = ", ".join(f"`{f.name}`" for f in target)
    spark.sql(
        f"INSERT OVERWRITE {table} PARTITION (`{batch_col}` = {json.dumps(str(batch))}) SELECT {names} FROM {{rows}}", rows=rows)
