"""Tables and queries of an outside database, read in parallel slices."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class JdbcSlices:
    """How a read is split over tasks: bounds of a numeric, date or timestamp column."""

    column: str
    lower: str
    upper: str
    count: int


@dataclass(frozen=True)
class JdbcSource:
    """Connection settings. Credentials come from the caller's configuration."""

    url: str
    properties: dict[str, str] = field(default_factory=dict, repr=False)
    fetch_size: int = 10_000

    def options(
        self, table: str | None = None, query: str | None = None, slices: JdbcSlices | None = None
    ) -> dict[str, str]:
        if (table is None) == (query is None):
            raise ValueError("name either a table or a query")
        # A sliced read needs dbtable, so a query goes in as a derived table.
        source = table if table is not None else f"({query}) AS q"
        opts = {"url": self.url, "dbtable": source, "fetchsize": str(self.fetch_size)}
        if slices is not None:
            opts |= {
                "partitionColumn": slices.column,
                "lowerBound": slices.lower,
                "upperBound": slices.upper,
                "numPartitions": str(slices.count),
            }
        return opts | self.properties

    def load(
        self,
        spark: SparkSession,
        table: str | None = None,
        query: str | None = None,
        slices: JdbcSlices | None = None,
        one_task: bool = False,
    ) -> DataFrame:
        """Read in slices. A read without them passes through one task, and has to be asked for."""
        if slices is None and not one_task:
            raise ValueError("name the slices of the read, or ask for one_task if it is small")
        return spark.read.format("jdbc").options(**self.options(table, query, slices)).load()
