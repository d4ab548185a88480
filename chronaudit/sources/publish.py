"""Tables that grow by published batches.

A batch is written beside the table, counted and checked, and only then named in the table's
manifest. Readers see what the manifest names, so a batch that fails at any point leaves the
table as it was, and one that is already named is not added again.

Below the table's path, ``batches/<batch>/<attempt>`` holds the rows of an attempt as Parquet
and ``manifest/<batch>.json`` names the attempt that counts.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronaudit.sources.sinks import aligned

MANIFEST = "batch string, attempt string, n_rows bigint"


class BatchTable:
    """A table of published batches below a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = spark.createDataFrame([], schema).schema

    def append(self, df: DataFrame, batch: str, checks: Mapping[str, Column] | None = None) -> int:
        """Publish the rows as a batch and return their number; 0 if the batch is there already.

        Columns are matched by name, absent ones are null and NaN becomes null. ``checks`` names
        conditions that every row must meet (unknown is not met). A batch without rows, or with rows that
        fail a check, is an error and its files are removed.
        """
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch):
            raise ValueError(f"{batch!r}: a batch is named with letters, digits, dots, dashes and underscores")
        if self._exists(self._entry(batch)):
            return 0
        attempt = f"{self.path}/batches/{batch}/{uuid.uuid4().hex}"
        try:
            n = self._staged(df, attempt, checks or {})
        except BaseException:
            self._remove(attempt)
            raise
        entry = json.dumps({"batch": batch, "attempt": attempt[len(self.path) + 1 :], "n_rows": n})
        if not self._publish(self._entry(batch), entry):
            self._remove(attempt)  # another attempt was faster
            return 0
        return n

    def _staged(self, df: DataFrame, attempt: str, checks: Mapping[str, Column]) -> int:
        rows, seen = aligned(df, self.schema), Observation()
        failed = [F.count_if(~F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, c in enumerate(checks.values())]
        rows.observe(seen, F.count(F.lit(1)).alias("n"), *failed).write.mode("errorifexists").parquet(attempt)
        n = self.spark.read.schema(self.schema).parquet(attempt).count()
        if not n:
            raise ValueError("nothing to append")
        if n != seen.get["n"]:
            raise ValueError(f"{n} rows are in the files, {seen.get['n']} were written")
        broken = {name: seen.get[f"c{i}"] for i, name in enumerate(checks) if seen.get[f"c{i}"]}
        if broken:
            raise ValueError("rows that fail checks: " + ", ".join(f"{name} {k}" for name, k in broken.items()))
        return n

    def batches(self) -> DataFrame:
        """One row per published batch: batch, attempt (below the path) and n_rows."""
        if not self._exists(f"{self.path}/manifest"):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest")

    def read(self) -> DataFrame:
        """The rows of all published batches; the names of the batches pass through the driver."""
        found = [f"{self.path}/{r['attempt']}" for r in self.batches().collect()]
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*found)

    def _entry(self, batch: str) -> str:
        return f"{self.path}/manifest/{batch}.json"

    def _file(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _exists(self, path: str) -> bool:
        files, path = self._file(path)
        return files.exists(path)

    def _remove(self, attempt: str) -> None:
        """Delete an attempt of this object's own that was not published."""
        files, path = self._file(attempt)
        files.delete(path, True)

    def _publish(self, entry: str, text: str) -> bool:
        """Put the entry in place whole, unless there is one; readers skip names with an underscore."""
        files, final = self._file(entry)
        _, draft = self._file(f"{entry.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        if files.exists(final) or not files.rename(draft, final):
            files.delete(draft, False)
            return False
        return True
