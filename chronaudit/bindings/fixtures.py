"""What the queries share: the calendar, holidays, the audited tables, and SQL for each."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronaudit.bindings.registry import table
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
from chronaudit.operators.calendar import Calendar
from chronaudit.plans.audit import run_checks

START, END = date(1995, 1, 1), date(2001, 12, 31)
AS_OF = date(2001, 8, 3)
TABLES = ("portholding", "portreturn", "bmprices", "bmc_monthly", "univsnapshot", "bg_div", "div_ltm")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")

# Holidays of the span: month and day per exchange, repeated each year.
_FIXED_DAYS = (
    ("NYS", 1, 1, "New Year"), ("NYS", 7, 4, "Independence Day"), ("NYS", 12, 25, "Christmas"),
    ("TSE", 1, 1, "New Year"), ("TSE", 7, 1, "Canada Day"), ("TSE", 12, 25, "Christmas"),
)
HOLIDAYS = [
    (code, date(year, month, day), name)
    for year in range(START.year, END.year + 1)
    for code, month, day, name in _FIXED_DAYS
]
_HOLIDAY_VALUES = ", ".join(f"('{c}', DATE '{d}', '{n}')" for c, d, n in HOLIDAYS)


def holiday_table(spark: SparkSession) -> DataFrame:
    return spark.sql(
        f"SELECT * FROM VALUES {_HOLIDAY_VALUES} AS h(fref_exchange_code, holiday_date, holiday_name)"
    )


def calendar(spark: SparkSession) -> Calendar:
    return Calendar(spark, START, END, holiday_table(spark))


def orders_with_lines(spark: SparkSession, d: str) -> DataFrame:
    return _with_lines(table(spark, d, "orders"), table(spark, d, "lineitem"))


def _with_lines(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Orders with the key of their lines, null for an order without any."""
    keys = lines.select("l_orderkey").distinct()
    return orders.join(keys, orders.o_orderkey == keys.l_orderkey, "left")


def orders_by_month(spark: SparkSession, d: str) -> DataFrame:
    return _by_month(table(spark, d, "orders"))


def _by_month(orders: DataFrame) -> DataFrame:
    return orders.select("o_orderpriority", F.last_day("o_orderdate").alias("rdate"), "o_orderkey")


def orders_spec(spark: SparkSession, d: str, **kw) -> TableSpec:
    return TableSpec("orders", table(spark, d, "orders"), "o_orderdate", "o_orderpriority", "o_orderkey", **kw)


def status_history(spark: SparkSession, d: str) -> DataFrame:
    return _history(table(spark, d, "orders"))


def _history(orders: DataFrame) -> DataFrame:
    return orders.select(
        "o_custkey",
        F.to_date("o_orderdate").alias("exdate"),
        "o_orderkey",
        "o_orderstatus",
        (F.col("o_orderstatus") == "F").alias("flagged"),
    )


def specs(spark: SparkSession, d: str) -> list[TableSpec]:
    """The sample tables in the roles of the audited ones."""
    orders = table(spark, d, "orders")
    lines = table(spark, d, "lineitem")
    held = _with_lines(orders, lines)
    finished = orders.where(F.col("o_orderstatus") == "F")
    unmatched = held.where(F.col("o_orderstatus") == "F")
    return [
        TableSpec(
            "portholding", held, "o_orderdate", "o_orderpriority", "l_orderkey", "daily",
            checks=(NO_DATA, NO_ID, NOT_DAILY, BAD_ROW),
        ),
        TableSpec(
            "portreturn", lines, "l_shipdate", "l_returnflag", None, "daily",
            checks=(NO_DATA, NOT_DAILY),
        ),
        TableSpec(
            "bmprices", finished, "o_orderdate", "o_orderpriority", None, "daily",
            checks=(NO_DATA, NOT_DAILY),
        ),
        TableSpec(
            "bmc_monthly", held, "o_orderdate", "o_orderstatus", "l_orderkey", "monthly",
            checks=(NO_DATA, NO_ID, NOT_MONTHLY, BAD_ROW),
        ),
        TableSpec(
            "univsnapshot", _by_month(orders), "rdate", "o_orderpriority", "o_orderkey",
            "monthly", checks=(NO_DATA, NO_REFERENCE, SIZE_JUMP, NOT_MONTHLY, ORPHAN_ROW),
            reference=lines, reference_key="l_orderkey", change_tolerance=10,
        ),
        TableSpec(
            "bg_div", _history(orders), "exdate", "o_custkey", None, None,
            checks=(NO_FLAG,),
            event_rule=EventRule("o_orderstatus", "P", "flagged", ("o_orderkey",)),
        ),
        TableSpec(
            "div_ltm", unmatched, "o_orderdate", "o_custkey", "l_orderkey", "monthly",
            checks=(NOT_MONTHLY, BAD_ROW),
        ),
    ]


def grouped_issues(spark: SparkSession, d: str) -> DataFrame:
    return run_checks(specs(spark, d), calendar(spark), AS_OF)


def table_issues(spark: SparkSession, d: str) -> DataFrame:
    return run_checks(specs(spark, d), calendar(spark), AS_OF, style="table")


# SQL building blocks. Each is a list of common table expressions without WITH.

SQL_HOLIDAYS = (
    "hol AS (SELECT * FROM (VALUES "
    + _HOLIDAY_VALUES
    + ") AS h(fref_exchange_code, holiday_date, holiday_name))"
)


def sql_days(start: date, end: date) -> str:
    return f"""
span AS (
  SELECT CAST(t.d AS DATE) AS date
  FROM generate_series(TIMESTAMP '{start}', TIMESTAMP '{end}', INTERVAL 1 DAY) AS t(d)
),
days AS (
  SELECT s.date,
         CAST(year(s.date) AS INTEGER) AS year,
         CAST(month(s.date) AS INTEGER) AS month,
         CAST(isodow(s.date) - 1 AS INTEGER) AS weekday,
         CAST(day(s.date) AS INTEGER) AS day,
         CAST(ceil((day(s.date) + isodow(date_trunc('month', s.date)) - 1) / 7.0) AS INTEGER) AS week,
         CASE WHEN h.date IS NULL THEN 0 ELSE 1 END AS holiday_flag,
         isodow(s.date) < 6 AND h.date IS NULL AS bday
  FROM span s LEFT JOIN (SELECT DISTINCT holiday_date AS date FROM hol) h ON s.date = h.date
)"""


SQL_CALENDAR = SQL_HOLIDAYS + "," + sql_days(START, END)
SQL_CUTOFF = "DATE '2001-08-02'"
SQL_PERIOD = f"BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END} 23:59:59.999999'"

SQL_HELD = """
held AS (
  SELECT o.*, l.l_orderkey
  FROM orders o LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) l ON o.o_orderkey = l.l_orderkey
)"""


def sql_missing(source: str, group: str, dated: str, due: str) -> str:
    """Dates marked by ``due`` that a group lacks in a year in which it has rows."""
    return f"""
  SELECT g.grp, d.date AS rdate
  FROM (SELECT DISTINCT {group} AS grp, year({dated}) AS yr FROM {source}
        WHERE {group} IS NOT NULL AND {dated} {SQL_PERIOD}) g
  JOIN days d ON d.year = g.yr AND {due} AND d.date < {SQL_CUTOFF}
  ANTI JOIN (SELECT DISTINCT {group} AS grp, CAST({dated} AS DATE) AS date FROM {source}) p
    ON p.grp = g.grp AND p.date = d.date"""


def sql_null_dates(source: str, group: str, dated: str, ident: str) -> str:
    return f"""
  SELECT DISTINCT {group} AS grp, CAST({dated} AS DATE) AS rdate
  FROM {source} WHERE {ident} IS NULL AND {group} IS NOT NULL
    AND CAST({dated} AS DATE) IN (SELECT date FROM days WHERE bday AND date < {SQL_CUTOFF})"""


DUE_DAILY, DUE_MONTHLY = "d.bday", "d.date = last_day(d.date)"

SQL_HISTORY = """
history AS (
  SELECT o_custkey, CAST(o_orderdate AS DATE) AS exdate, o_orderkey, o_orderstatus,
         o_orderstatus = 'F' AS flagged
  FROM orders
),
placed AS (
  SELECT *,
         row_number() OVER (PARTITION BY o_custkey ORDER BY exdate DESC, o_orderkey DESC) AS from_end,
         lag(o_orderstatus) OVER w AS prev_status,
         lead(flagged) OVER w AS next_flagged
  FROM history WINDOW w AS (PARTITION BY o_custkey ORDER BY exdate, o_orderkey)
),
faulty AS (
  SELECT o_custkey, exdate, o_orderkey, o_orderstatus, flagged FROM placed
  WHERE (from_end > 1 AND prev_status = 'P' AND NOT flagged)
     OR (from_end > 2 AND o_orderstatus = 'P' AND NOT next_flagged)
)"""

SQL_SIZES = """
sizes AS (
  SELECT grp, rdate, n, n - lag(n) OVER (PARTITION BY grp ORDER BY rdate) AS change
  FROM (SELECT o_orderpriority AS grp, last_day(o_orderdate) AS rdate, count(*) AS n
        FROM orders GROUP BY ALL)
)"""

_SHAPE = "CAST(grp AS VARCHAR) AS group_value, rdate, CAST(NULL AS VARCHAR) AS entity_id, CAST(NULL AS DOUBLE) AS metric"


def _dated(table_name: str, kind: str, body: str) -> str:
    return f"SELECT '{table_name}' AS table_name, '{kind}' AS issue_type, {_SHAPE} FROM ({body})"


SQL_GROUPED_ISSUES = ",".join([
    SQL_CALENDAR,
    SQL_HELD,
    SQL_HISTORY,
    SQL_SIZES,
    "finished AS (SELECT * FROM orders WHERE o_orderstatus = 'F')",
    "snapshot AS (SELECT o_orderpriority, last_day(o_orderdate) AS rdate, o_orderkey FROM orders)",
    "issues AS ("
    + "\nUNION ALL\n".join([
        _dated("portholding", NO_DATA, sql_missing("held", "o_orderpriority", "o_orderdate", DUE_DAILY)),
        _dated("portholding", NO_ID, sql_null_dates("held", "o_orderpriority", "o_orderdate", "l_orderkey")),
        _dated("portreturn", NO_DATA, sql_missing("lineitem", "l_returnflag", "l_shipdate", DUE_DAILY)),
        _dated("bmprices", NO_DATA, sql_missing("finished", "o_orderpriority", "o_orderdate", DUE_DAILY)),
        _dated("bmc_monthly", NO_DATA, sql_missing("held", "o_orderstatus", "o_orderdate", DUE_MONTHLY)),
        _dated("bmc_monthly", NO_ID, sql_null_dates("held", "o_orderstatus", "o_orderdate", "l_orderkey")),
        _dated("univsnapshot", NO_DATA, sql_missing("snapshot", "o_orderpriority", "rdate", DUE_MONTHLY)),
        f"""SELECT 'univsnapshot', '{NO_REFERENCE}', NULL, NULL, CAST(o_orderkey AS VARCHAR), NULL
            FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)""",
        f"""SELECT 'univsnapshot', '{SIZE_JUMP}', grp, rdate, NULL, change / n
            FROM sizes WHERE change / n > 0.01""",
        f"""SELECT 'bg_div', '{NO_FLAG}', CAST(o_custkey AS VARCHAR), exdate, CAST(o_custkey AS VARCHAR), NULL
            FROM faulty""",
    ])
    + ")",
])


def _no_group(body: str) -> str:
    return f"SELECT NULL AS grp, rdate FROM ({body})"


def sql_missing_any(source: str, dated: str) -> str:
    return f"""
  SELECT date AS rdate FROM days WHERE bday AND date NOT IN (SELECT CAST({dated} AS DATE) FROM {source})"""


def sql_missing_months(source: str, dated: str) -> str:
    return f"""
  SELECT date AS rdate FROM days
  WHERE date_trunc('month', date) NOT IN (SELECT date_trunc('month', {dated}) FROM {source})"""


def _null_rows(name: str, source: str, group: str) -> str:
    body = f"SELECT {group} AS grp, CAST(o_orderdate AS DATE) AS rdate FROM {source} WHERE l_orderkey IS NULL"
    return _dated(name, BAD_ROW, body)


SQL_TABLE_ISSUES = ",".join([
    SQL_CALENDAR,
    SQL_HELD,
    SQL_SIZES,
    "finished AS (SELECT * FROM held WHERE o_orderstatus = 'F')",
    "snapshot AS (SELECT o_orderpriority, last_day(o_orderdate) AS rdate, o_orderkey FROM orders)",
    "issues AS ("
    + "\nUNION ALL\n".join([
        _dated("portholding", NOT_DAILY, _no_group(sql_missing_any("held", "o_orderdate"))),
        _null_rows("portholding", "held", "o_orderpriority"),
        _dated("portreturn", NOT_DAILY, _no_group(sql_missing_any("lineitem", "l_shipdate"))),
        _dated("bmprices", NOT_DAILY, _no_group(sql_missing_any("finished", "o_orderdate"))),
        _dated("bmc_monthly", NOT_MONTHLY, _no_group(sql_missing_months("held", "o_orderdate"))),
        _null_rows("bmc_monthly", "held", "o_orderstatus"),
        _dated("univsnapshot", NOT_MONTHLY, _no_group(sql_missing_months("snapshot", "rdate"))),
        f"""SELECT 'univsnapshot', '{ORPHAN_ROW}', o_orderpriority, rdate, CAST(o_orderkey AS VARCHAR), NULL
            FROM snapshot WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
        f"""SELECT 'univsnapshot', '{SIZE_JUMP}', grp, rdate, NULL, CAST(change AS DOUBLE)
            FROM sizes WHERE change > 10""",
        _dated("div_ltm", NOT_MONTHLY, _no_group(sql_missing_months("finished", "o_orderdate"))),
        _null_rows("div_ltm", "finished", "o_custkey"),
    ])
    + ")",
])
