"""Rate series kept as a long table of series_id, date and value."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronaudit.functions.predicates import in_period

# The series offered by default, and the first day loaded.
RATE_SERIES = (
    "DTWEXM", "TEDRATE", "DTWEXAFEGS", "UNRATE", "U1RATE", "U6RATE",
    "BOPGSTB", "CPIAUCSL", "TB3MS", "GDP", "GNP",
)
DEFAULT_START = date(1995, 1, 1)


def read_series(
    table: DataFrame,
    items: Sequence[str] = RATE_SERIES,
    start: date = DEFAULT_START,
    end: date | None = None,
) -> DataFrame:
    """Observations of the chosen series from start to end (today); nulls and NaN dropped."""
    wanted = F.col("series_id").isin(*items) & in_period(F.col("date"), start, end or date.today())
    return table.where(wanted).dropna(subset=["value"]).select("series_id", "date", "value")
