"""Findings kept in folders by table and month.

A view of one date reads one month's folders, and a re-run replaces the months it covers.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronaudit.model import ISSUE_SCHEMA
from chronaudit.operators.calendar import single_row
from chronaudit.operators.issues import MONTH, UNDATED


def store_issues(
    issues: DataFrame, path: str, tables: Sequence[str], start: date, end: date, files_per_month: int = 1
) -> None:
    """Replace the findings of these tables in the months from start to end, and those without a date.

    Every folder covered gets a row of nulls, so a month that has become clean is replaced
    as well. Other tables and months stay as they are. Findings of other tables or months
    are an error, and then nothing is replaced. A month's findings are dealt out over
    ``files_per_month`` files.
    """
    month = F.when(F.col("rdate").isNull(), UNDATED).otherwise(F.date_format("rdate", "yyyy-MM"))
    covered = F.col("table_name").isin(*tables) & ((F.col(MONTH) == UNDATED) | F.col(MONTH).between(f"{start:%Y-%m}", f"{end:%Y-%m}"))
    said = F.concat(F.lit("a finding is not covered: "), F.coalesce("table_name", F.lit("null")), F.lit(" "), F.col(MONTH))
    rows = issues.select(*ISSUE_SCHEMA.names, month.alias(MONTH))
    rows = rows.withColumn(MONTH, F.when(F.coalesce(covered, F.lit(False)), F.col(MONTH)).otherwise(F.raise_error(said).cast("string")))
    months = F.expr(f"transform(sequence(date'{start.replace(day=1)}', date'{end}', interval 1 month), d -> date_format(d, 'yyyy-MM'))")
    marks = single_row(issues.sparkSession).select(
        F.explode(F.array(*[F.lit(t) for t in tables])).alias("table_name"), F.concat(months, F.array(F.lit(UNDATED))).alias("months")
    ).select("table_name", F.explode("months").alias(MONTH))
    absent = [F.lit(None).cast(f.dataType).alias(f.name) for f in ISSUE_SCHEMA if f.name != "table_name"]
    marks = marks.select("table_name", *absent, MONTH)
    part = F.pmod(F.xxhash64("group_value", "rdate", "entity_id"), F.lit(files_per_month))
    (
        rows.unionByName(marks)
        .repartition("table_name", MONTH, part)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("table_name", MONTH)
        .parquet(path)
    )


def stored_issues(spark: SparkSession, path: str) -> DataFrame:
    """The findings, with the ``month`` of their folder, for the reports of ``operators.issues``."""
    schema = T.StructType([*(f for f in ISSUE_SCHEMA if f.name != "table_name"), ISSUE_SCHEMA["table_name"], T.StructField(MONTH, T.StringType())])
    return spark.read.schema(schema).parquet(path).where("issue_type is not null").select(*ISSUE_SCHEMA.names, MONTH)
