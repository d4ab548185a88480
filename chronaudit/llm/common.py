"""Small helpers that several operators of this package share."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronaudit.sources.files import scratch_path

__all__ = ["byte_slices", "in_files", "reach_workers", "read_if_there", "scratch_path", "text_or_empty"]


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it.

    Where the executors do not share that folder, the package goes with ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = [x for x in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def text_or_empty(col: str) -> F.Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def in_files(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the folder that all executors share and read from there.

    Later readers then neither repeat the work nor depend on the executors that did it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet rows under a path; none where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def byte_slices(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows in order, in slices whose texts have ``limit`` bytes at most, or one row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        begin = held = 0
        for row, length in enumerate(lengths):
            if held + length > limit and row > begin:
                yield batch.slice(begin, row - begin)
                begin, held = row, 0
            held += length
        if len(lengths) > begin:
            yield batch.slice(begin)
