"""Named tables, the queries over them, and lists drawn from them."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronaudit.functions.predicates import in_period, text_in, text_not_in
from chronaudit.model import (
    BAD_ROW,
    NO_DATA,
    NO_FLAG,
    NO_ID,
    NO_REFERENCE,
    NOT_DAILY,
    NOT_MONTHLY,
    ORPHAN_ROW,
    SIZE_JUMP,
    EventRule,
    TableSpec,
)

# Filters of the standard finance tables.
BENCHMARKS = ("sp500", "sptsx")
UNIVERSES = ("CANADA", "US")
PORTFOLIOS = ("bg001", "bg013", "bg014")
CASH_COMPANIES = ("Placeholder", "Cash-INVEST-USD", "Cash-INVEST-CAD")
EXCHANGES = ("NYS", "TSE")
# Names under which predefined datasets are asked for.
PREDEFINED = (
    "adjusted price", "security info", "rate", "holding", "dividend",
    "benchmark price", "historic benchmark constituent",
)
# Names of the frequently used lists.
GROUP_LISTS = ("benchmark_constituent", "rate", "portfolio", "trading dates", "sector")


class TableRegistry:
    """Tables by name, each also visible to SQL as a temporary view."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._tables: dict[str, DataFrame] = {}
        self._lists: dict[str, tuple[str, str, str | None]] = {}

    def add(self, name: str, df: DataFrame, required: Iterable[str] = ()) -> DataFrame:
        absent = [c for c in required if c not in df.columns]
        if absent:
            raise ValueError(f"{name}: no column {', '.join(absent)}")
        df.createOrReplaceTempView(name)
        self._tables[name] = df
        return df

    def add_parquet(self, name: str, path: str, required: Iterable[str] = ()) -> DataFrame:
        return self.add(name, self.spark.read.parquet(path), required)

    def define_list(self, name: str, table: str, col: str, of: str | None = None) -> None:
        """Where one of the frequently used lists is found; ``of`` is the column that picks a part of it."""
        if name not in GROUP_LISTS:
            raise ValueError(f"unknown list {name!r}; choose from {', '.join(GROUP_LISTS)}")
        absent = [c for c in (col, of) if c is not None and c not in self[table].columns]
        if absent:
            raise ValueError(f"{table}: no column {', '.join(absent)}")
        self._lists[name] = (table, col, of)

    def list_source(self, name: str) -> tuple[str, str, str | None]:
        if name not in self._lists:
            raise KeyError(f"the list {name!r} is not defined")
        return self._lists[name]

    def __getitem__(self, name: str) -> DataFrame:
        if name in self._tables:
            return self._tables[name]
        if self.spark.catalog.tableExists(name):
            return self.spark.table(name)
        raise KeyError(f"unknown table {name!r}")

    def __contains__(self, name: str) -> bool:
        return name in self._tables or self.spark.catalog.tableExists(name)

    def names(self) -> list[str]:
        return sorted(self._tables)


def load_sql(spark: SparkSession, query: str, **params) -> DataFrame:
    """Run a query; values are bound to its ``:name`` markers, never pasted into it."""
    return spark.sql(query, args=params or None)


def first_column(df: DataFrame) -> DataFrame:
    """The first column alone, for use in a semi join rather than as a driver list."""
    return df.select(df.columns[0])


def in_subquery(df: DataFrame, col: str, values: DataFrame, value_col: str | None = None) -> DataFrame:
    """``col IN (SELECT DISTINCT value_col ...)``; repeated values never meet a hot key."""
    keys = values.select(F.col(value_col or values.columns[0]).alias("_in")).distinct()
    return df.join(keys, F.col(col) == F.col("_in"), "left_semi")


def predefined(
    tables: TableRegistry,
    name: str,
    identifiers: DataFrame | Iterable[str] | None = None,
    id_col: str | None = None,
) -> DataFrame:
    """A predefined dataset, restricted to identifiers when they are given."""
    if name not in PREDEFINED:
        raise ValueError(f"unknown dataset {name!r}; choose from {', '.join(PREDEFINED)}")
    df = tables[name.replace(" ", "_")]
    if identifiers is None:
        return df
    id_col = id_col or df.columns[0]
    if isinstance(identifiers, DataFrame):
        return in_subquery(df, id_col, identifiers)
    return df.where(F.col(id_col).isin(list(identifiers)))


def group_list(tables: TableRegistry, name: str, of: str | None = None) -> DataFrame:
    """One of the frequently used lists by its name: the distinct values of its column.

    ``of`` takes the part of it that belongs to one identifier, such as a benchmark.
    """
    if name not in GROUP_LISTS:
        raise ValueError(f"unknown list {name!r}; choose from {', '.join(GROUP_LISTS)}")
    table, col, part = tables.list_source(name)
    df = tables[table]
    if of is not None:
        if part is None:
            raise ValueError(f"the list {name!r} has no parts")
        df = df.where(text_in(F.col(part), [of]))
    return df.where(F.col(col).isNotNull()).select(col).distinct()


def regular_dividends(div: DataFrame, ltm: DataFrame) -> DataFrame:
    """Regular dividends with the matching last-12-month date as rdate (null if none)."""
    right = ltm.select(F.col("fsym_id"), F.col("date").alias("rdate")).distinct()
    match = (div["fsym_id"] == right["fsym_id"]) & (div["exdate"] == right["rdate"])
    rows = div.where((F.col("div_type") == "regular") & (F.col("dummy_payment") == 0))
    return rows.join(right, match, "left").select(
        div["fsym_id"], "exdate", "rdate", "div_type", "div_freq"
    )


def suspended_histories(div: DataFrame) -> DataFrame:
    """Regular and suspended dividends of every security that was ever suspended."""
    suspended = div.where(F.col("div_type") == "suspension").select("fsym_id")
    kept = div.where(F.col("div_type").isin("suspension", "regular"))
    return in_subquery(kept, "fsym_id", suspended).select(
        "fsym_id", "exdate", "div_type", "div_initiation"
    )


def standard_queries(tables: TableRegistry) -> dict[str, Callable[..., DataFrame]]:
    """The named source queries. Each takes an optional (start, end) period."""

    def dated(df, col, period):
        return df if period is None else df.where(in_period(F.col(col), *period))

    def bmc_monthly(period=None):
        df = tables["bmc_monthly"].where(text_in(F.col("bm_id"), BENCHMARKS))
        return dated(df, "rdate", period).select("bm_id", "rdate", "fsym_id")

    def univsnapshot(period=None):
        df = tables["univsnapshot"].where(text_in(F.col("univ_id"), UNIVERSES))
        return dated(df, "rdate", period).select("univ_id", "rdate", "fsym_id")

    def portholding(period=None):
        df = tables["portholding"].where(
            text_not_in(F.col("company"), CASH_COMPANIES) & text_in(F.col("pid"), PORTFOLIOS)
        )
        return dated(df, "rdate", period).select("pid", "rdate", F.col("secid").alias("fsym_id"))

    def div_ltm(period=None):
        # The period is that of the dividend, so that unmatched ones survive it.
        div = dated(tables["bg_div"], "exdate", period)
        return regular_dividends(div, tables["bg_div_ltm"])

    def portreturn(period=None):
        return dated(tables["portreturn"], "rdate", period)

    def bmprices(period=None):
        df = dated(tables["bmprices"], "rdate", period)
        return df.select("bm_id", "rdate", "price_index", "total_index")

    def adjpricet(period=None):
        return tables["adjpricet"].select("fsym_id")

    def bg_div(period=None):
        return suspended_histories(tables["bg_div"])

    def holiday(period=None):
        df = tables["holiday"].where(text_in(F.col("fref_exchange_code"), EXCHANGES))
        return dated(df, "holiday_date", period)

    return {
        q.__name__: q
        for q in (
            bmc_monthly, univsnapshot, portholding, div_ltm, portreturn,
            bmprices, adjpricet, bg_div, holiday,
        )
    }


def year_period(year: int) -> tuple[date, date]:
    return date(year, 1, 1), date(year, 12, 31)


def standard_specs(tables: TableRegistry, period: tuple[date, date] | None = None) -> list[TableSpec]:
    """The standard finance tables with the checks that apply to each."""
    source = standard_queries(tables)
    ids = source["adjpricet"]()
    return [
        TableSpec(
            "portholding", source["portholding"](period), "rdate", "pid", "fsym_id", "daily",
            "Portfolio Holding", (NO_DATA, NO_ID, NOT_DAILY, BAD_ROW),
        ),
        TableSpec(
            "portreturn", source["portreturn"](period), "rdate", "pid", None, "daily",
            "Portfolio Return", (NO_DATA, NOT_DAILY),
        ),
        TableSpec(
            "bmprices", source["bmprices"](period), "rdate", "bm_id", None, "daily",
            "BM Prices", (NO_DATA, NOT_DAILY),
        ),
        TableSpec(
            "bmc_monthly", source["bmc_monthly"](period), "rdate", "bm_id", "fsym_id", "monthly",
            "BMC Monthly", (NO_DATA, NO_ID, NOT_MONTHLY, BAD_ROW),
        ),
        TableSpec(
            "univsnapshot", source["univsnapshot"](period), "rdate", "univ_id", "fsym_id", "monthly",
            "Universe Snapshot", (NO_DATA, NO_REFERENCE, SIZE_JUMP, NOT_MONTHLY, ORPHAN_ROW),
            ids, "fsym_id",
        ),
        TableSpec(
            "bg_div", source["bg_div"](), "exdate", "fsym_id", None, None,
            "BG Div", (NO_FLAG,), event_rule=EventRule("div_type", "suspension", "div_initiation", ("div_type", "div_initiation")),
        ),
        # Unmatched dividends are dated by exdate, months by the matched date.
        TableSpec(
            "div_ltm", source["div_ltm"](period), "exdate", "fsym_id", "rdate", "monthly",
            "Div LTM", (BAD_ROW,),
        ),
        TableSpec(
            "div_ltm", source["div_ltm"](period), "rdate", "fsym_id", None, "monthly",
            "Div LTM", (NOT_MONTHLY,),
        ),
    ]
