"""The checks and reports over the sample tables."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import functions as F

from chronaudit.bindings.fixtures import (
    AS_OF,
    DUE_DAILY,
    DUE_MONTHLY,
    END,
    PRIORITIES,
    SQL_CALENDAR,
    SQL_GROUPED_ISSUES,
    SQL_HELD,
    SQL_HISTORY,
    SQL_TABLE_ISSUES,
    START,
    TABLES,
    calendar,
    grouped_issues,
    orders_by_month,
    orders_spec,
    orders_with_lines,
    specs,
    sql_missing,
    sql_missing_any,
    sql_missing_months,
    sql_null_dates,
    status_history,
    table_issues,
)
from chronaudit.bindings.registry import bound, table
from chronaudit.functions.dates import MONTH_NAMES, WEEKDAY_LABELS
from chronaudit.model import BAD_ROW, NO_DATA, SIZE_JUMP, TableSpec
from chronaudit.operators import (
    completeness,
    events,
    integrity,
    issues,
    size,
    status,
)
from chronaudit.operators.calendar import calendar_spanning, holidays
from chronaudit.plans import findings
from chronaudit.plans.audit import keep_issues
from chronaudit.plans.state import STATE_CHECKS, AuditState
from chronaudit.sources.files import scratch_path

VERDICT_DAY = date(2000, 6, 14)


@bound(
    "c01_missing_dates",
    f"""WITH {SQL_CALENDAR}
SELECT grp AS o_orderpriority, rdate FROM ({sql_missing('orders', 'o_orderpriority', 'o_orderdate', DUE_DAILY)})""",
)
def missing_dates(spark, d):
    return completeness.missing_dates(orders_spec(spark, d), calendar(spark), AS_OF)


@bound(
    "c02_missing_month_ends",
    f"""WITH {SQL_CALENDAR}
SELECT grp AS o_orderpriority, rdate FROM ({sql_missing('orders', 'o_orderpriority', 'o_orderdate', DUE_MONTHLY)})""",
)
def missing_month_ends(spark, d):
    return completeness.missing_month_ends(orders_spec(spark, d), calendar(spark), AS_OF)


@bound(
    "c03_missing_dates_any",
    f"""WITH {SQL_CALENDAR}
{sql_missing_any("(SELECT * FROM orders WHERE o_orderstatus = 'F')", 'o_orderdate')}""",
)
def missing_dates_any(spark, d):
    finished = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return completeness.missing_dates_any(finished, "o_orderdate", calendar(spark))


@bound("c04_missing_months", f"WITH {SQL_CALENDAR} {sql_missing_months('orders', 'o_orderdate')}")
def missing_months(spark, d):
    return completeness.missing_months(table(spark, d, "orders"), "o_orderdate", calendar(spark))


@bound(
    "c05_null_rows",
    """SELECT d.doc_id, d.lang, d.n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE l.quality IS NULL""",
)
def null_rows(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    labelled = docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return integrity.null_rows(labelled, "quality").drop("quality")


@bound(
    "c06_null_id_dates",
    f"""WITH {SQL_CALENDAR},{SQL_HELD}
SELECT grp AS o_orderpriority, rdate
FROM ({sql_null_dates('held', 'o_orderpriority', 'o_orderdate', 'l_orderkey')})""",
)
def null_id_dates(spark, d):
    spec = TableSpec(
        "orders", orders_with_lines(spark, d), "o_orderdate", "o_orderpriority", "l_orderkey"
    )
    return integrity.null_id_dates(spec, calendar(spark), AS_OF)


@bound("c07_orphan_ids", "SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def orphan_ids(spark, d):
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    return integrity.orphan_ids(orders, lines, "o_orderkey", "l_orderkey")


@bound(
    "c08_orphan_rows",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS rdate
FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
)
def orphan_rows(spark, d):
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    found = integrity.orphan_rows(orders, lines, "o_orderkey", "l_orderkey")
    return found.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("rdate")
    )


SQL_MONTH_SIZES = """
SELECT o_orderpriority, rdate, n_rows, n_rows - lag(n_rows) OVER (PARTITION BY o_orderpriority ORDER BY rdate) AS change
FROM (SELECT o_orderpriority, last_day(o_orderdate) AS rdate, count(*) AS n_rows FROM orders GROUP BY ALL)"""


def _monthly_spec(spark, d, **kw):
    return TableSpec(
        "orders", orders_by_month(spark, d), "rdate", "o_orderpriority", "o_orderkey", "monthly", **kw
    )


@bound(
    "c09_group_growth",
    f"""SELECT o_orderpriority, rdate, n_rows, change / n_rows AS growth FROM ({SQL_MONTH_SIZES})
WHERE change / n_rows > 0.01""",
)
def group_growth(spark, d):
    return size.group_growth(_monthly_spec(spark, d))


@bound(
    "c10_group_change_abs",
    f"SELECT o_orderpriority, rdate, n_rows, change FROM ({SQL_MONTH_SIZES}) WHERE change > 10",
)
def group_change_abs(spark, d):
    return size.group_change_abs(_monthly_spec(spark, d), tolerance=10)


@bound("c11_missing_flag_after_event", f"WITH {SQL_HISTORY} SELECT * FROM faulty")
def missing_flag_after_event(spark, d):
    return events.missing_flag_after_event(
        status_history(spark, d), "o_custkey", "exdate", "o_orderstatus", "P", "flagged", ["o_orderkey"]
    )


@bound(
    "c12_unmatched_events",
    """SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS rdate FROM orders o
WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)""",
)
def unmatched_events(spark, d):
    regular = (
        table(spark, d, "orders")
        .where("o_orderstatus = 'F'")
        .select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("rdate"))
    )
    return integrity.unmatched_events(regular, table(spark, d, "lineitem"), ["o_orderkey"], ["l_orderkey"])


# The events lie in January 2024, where these days count as holidays.
EVENT_HOLIDAYS = (date(2024, 1, 1), date(2024, 1, 12), date(2024, 1, 15), date(2024, 1, 23))
_EVENT_HOLIDAY_VALUES = ", ".join(f"(DATE '{h}')" for h in EVENT_HOLIDAYS)
SQL_GAPS = f"""
hol AS (SELECT * FROM (VALUES {_EVENT_HOLIDAY_VALUES}) AS h(holiday_date)),
gaps AS (
  SELECT user_id, rdate, CAST(isodow(rdate) - 1 AS INTEGER) AS weekday, n,
         CAST(coalesce(rdate - lag(rdate) OVER (PARTITION BY user_id ORDER BY rdate), 1) AS INTEGER) AS diff_days,
         rdate - 1 IN (SELECT holiday_date FROM hol) AS after_holiday,
         rdate - 3 IN (SELECT holiday_date FROM hol) AS friday_off
  FROM (SELECT user_id, CAST(ts AS DATE) AS rdate, count(*) AS n FROM events GROUP BY ALL)
),
hits AS (
  SELECT user_id, rdate, weekday, diff_days, 1 AS n_flagged FROM gaps
  WHERE CASE WHEN diff_days = 1 THEN false WHEN weekday = 0 AND diff_days = 3 THEN false
             WHEN after_holiday THEN false WHEN weekday = 0 AND diff_days = 4 AND friday_off THEN false
             ELSE true END
  UNION ALL
  SELECT user_id, rdate, weekday, 0, n - 1 FROM gaps WHERE n > 1 AND NOT after_holiday
)"""


def event_holidays(spark):
    return spark.sql(f"SELECT * FROM VALUES {_EVENT_HOLIDAY_VALUES} AS h(holiday_date)")


@bound(
    "c13_irregular_gaps",
    f"""WITH {SQL_GAPS},
ranked AS (
  SELECT event_id, user_id, CAST(ts AS DATE) AS rdate, event_type,
         row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS place
  FROM events
)
SELECT r.event_id, r.user_id, r.rdate, r.event_type, h.weekday, h.diff_days
FROM ranked r JOIN hits h ON r.user_id = h.user_id AND r.rdate = h.rdate AND (r.place = 1) = (h.diff_days > 0)""",
)
def irregular_gaps(spark, d):
    found = events.irregular_gaps(
        table(spark, d, "events"), "user_id", "ts", event_holidays(spark), ["event_id"]
    )
    return found.select(
        "event_id", "user_id", F.to_date("ts").alias("rdate"), "event_type", "weekday", "diff_days"
    )


@bound(
    "c13b_irregular_gap_days",
    f"WITH {SQL_GAPS} SELECT user_id, rdate, weekday, diff_days, CAST(n_flagged AS BIGINT) AS n_flagged FROM hits",
)
def irregular_gap_days(spark, d):
    return events.irregular_gap_days(table(spark, d, "events"), "user_id", "ts", event_holidays(spark))


@bound(
    "c13c_irregular_gaps_of_repeats",
    f"""WITH {SQL_GAPS}
SELECT user_id, rdate, weekday, diff_days
FROM (SELECT *, unnest(range(CAST(n_flagged AS BIGINT))) FROM hits)""",
)
def irregular_gaps_of_repeats(spark, d):
    days = table(spark, d, "events").select("user_id", F.to_date("ts").alias("rdate"))
    return events.irregular_gaps(days, "user_id", "rdate", event_holidays(spark))


@bound(
    "c14_row_mismatch",
    """SELECT p_partkey, CASE WHEN p_size > 25 THEN 'x' ELSE p_brand END AS p_brand,
       CASE WHEN p_retailprice > 1500 THEN p_retailprice + 1 ELSE p_retailprice END AS p_retailprice
FROM part WHERE p_size > 25 OR p_retailprice > 1500""",
)
def row_mismatch(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    old = part.select("p_partkey", "p_brand", "p_retailprice")
    new = part.select(
        "p_partkey",
        F.when(F.col("p_size") > 25, "x").otherwise(F.col("p_brand")).alias("p_brand"),
        F.when(F.col("p_retailprice") > 1500, F.col("p_retailprice") + 1)
        .otherwise(F.col("p_retailprice"))
        .alias("p_retailprice"),
    )
    return integrity.row_mismatch(old, new, "p_partkey")


SQL_SUMMARY = f"""WITH {SQL_GROUPED_ISSUES},
counts AS (
  SELECT table_name,
    count(DISTINCT rdate) FILTER (issue_type = 'no_data') AS missing_data,
    count(DISTINCT rdate) FILTER (issue_type = 'no_fsym_id') AS missing_id,
    count(*) FILTER (issue_type = 'no_adjprice') AS orphans,
    count(*) FILTER (issue_type = 'universe_size') AS size_jumps,
    count(*) FILTER (issue_type = 'no_div_init_flag') // 2 AS missing_flags
  FROM issues GROUP BY table_name
)"""


@bound(
    "c15_issue_summary",
    f"""{SQL_SUMMARY}
SELECT t.table_name,
       coalesce(missing_data + missing_id + orphans + size_jumps + missing_flags, 0) AS total_issues,
       coalesce(missing_data, 0) AS missing_data, coalesce(missing_id, 0) AS missing_id,
       coalesce(orphans, 0) AS orphans, coalesce(size_jumps, 0) AS size_jumps,
       coalesce(missing_flags, 0) AS missing_flags
FROM (VALUES {', '.join(f"('{t}')" for t in TABLES)}) AS t(table_name)
LEFT JOIN counts c ON c.table_name = t.table_name""",
)
def issue_summary(spark, d):
    return issues.issue_summary(grouped_issues(spark, d), TABLES)


@bound(
    "c16_issue_detail",
    f"""WITH {SQL_GROUPED_ISSUES}
SELECT issue_type, strftime(rdate, '%Y-%m-%d') AS rdate, entity_id,
  {', '.join(f'''max(CASE WHEN group_value = '{p}' THEN coalesce(metric, 1.0) END) AS "{p}"''' for p in PRIORITIES)}
FROM issues WHERE table_name = 'univsnapshot' GROUP BY issue_type, rdate, entity_id""",
)
def issue_detail(spark, d):
    return issues.issue_detail(grouped_issues(spark, d), "univsnapshot", PRIORITIES)


@bound(
    "c16b_issue_detail_with_others",
    f"""WITH {SQL_GROUPED_ISSUES}
SELECT issue_type, strftime(rdate, '%Y-%m-%d') AS rdate, entity_id,
  {', '.join(f'''max(CASE WHEN group_value = '{p}' THEN coalesce(metric, 1.0) END) AS "{p}"''' for p in PRIORITIES[:3])},
  CASE WHEN group_value NOT IN {PRIORITIES[:3]} THEN group_value END AS other_group,
  max(CASE WHEN group_value NOT IN {PRIORITIES[:3]} THEN coalesce(metric, 1.0) END) AS other_value
FROM issues WHERE table_name = 'univsnapshot' GROUP BY issue_type, rdate, entity_id, other_group""",
)
def issue_detail_with_others(spark, d):
    return issues.issue_detail(grouped_issues(spark, d), "univsnapshot", PRIORITIES[:3], others=True)


# Days with an urgent open order serve as holidays that come from the data.
SQL_DATA_HOLIDAYS = """
hol AS (
  SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'NYS' WHEN '2-HIGH' THEN 'TSE' ELSE o_orderpriority END
           AS fref_exchange_code,
         CAST(o_orderdate AS DATE) AS holiday_date
  FROM orders WHERE o_orderstatus = 'P'
)"""


def data_holidays(spark, d):
    code = F.col("o_orderpriority")
    return (
        table(spark, d, "orders")
        .where("o_orderstatus = 'P'")
        .select(
            F.when(code == "1-URGENT", "NYS").when(code == "2-HIGH", "TSE").otherwise(code)
            .alias("fref_exchange_code"),
            F.to_date("o_orderdate").alias("holiday_date"),
        )
    )


@bound(
    "c17_business_calendar",
    f"""WITH {SQL_DATA_HOLIDAYS.replace("o_orderstatus = 'P'", "o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'")},
span AS (
  SELECT CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS DATE) AS date FROM orders
)
SELECT s.date, CAST(year(s.date) AS INTEGER) AS year, CAST(month(s.date) AS INTEGER) AS month,
       CAST(isodow(s.date) - 1 AS INTEGER) AS weekday, CAST(day(s.date) AS INTEGER) AS day,
       CAST(ceil((day(s.date) + isodow(date_trunc('month', s.date)) - 1) / 7.0) AS INTEGER) AS week,
       CASE WHEN h.date IS NULL THEN 0 ELSE 1 END AS holiday_flag,
       isodow(s.date) < 6 AND h.date IS NULL AS bday
FROM span s LEFT JOIN (SELECT DISTINCT holiday_date AS date FROM hol) h ON s.date = h.date""",
)
def business_calendar(spark, d):
    urgent = data_holidays(spark, d).where("fref_exchange_code = 'NYS'")
    return calendar_spanning(table(spark, d, "orders"), "o_orderdate", urgent)


@bound(
    "c18_holidays",
    f"WITH {SQL_DATA_HOLIDAYS} SELECT DISTINCT holiday_date FROM hol WHERE fref_exchange_code <> 'TSE'",
)
def holidays_latest(spark, d):
    return holidays(data_holidays(spark, d), us=False, ca=False)


@bound(
    "c18b_holidays_by_flags",
    f"""WITH {SQL_DATA_HOLIDAYS} SELECT DISTINCT holiday_date FROM hol
WHERE fref_exchange_code = 'TSE' AND year(holiday_date) = 1997""",
)
def holidays_flags(spark, d):
    return holidays(data_holidays(spark, d), us=False, ca=True, year=1997, mode="flags")


@bound(
    "c19_month_grid",
    f"""WITH {SQL_GROUPED_ISSUES},
cells AS (
  SELECT t.table_name, d.year, d.month, d.week, d.weekday, CAST(count(i.issue_type) AS VARCHAR) AS cell
  FROM days d CROSS JOIN (VALUES {', '.join(f"('{t}')" for t in TABLES)}) AS t(table_name)
  LEFT JOIN issues i ON i.table_name = t.table_name AND i.rdate = d.date GROUP BY ALL
)
SELECT table_name, year, month, week,
  {', '.join(f"coalesce(max(CASE WHEN weekday = {i} THEN cell END), '') AS {n}" for i, n in enumerate(WEEKDAY_LABELS))}
FROM cells GROUP BY ALL""",
)
def month_grid(spark, d):
    return status.month_grid(calendar(spark).days(), grouped_issues(spark, d), TABLES)


@bound(
    "c20_day_status",
    f"""WITH {SQL_GROUPED_ISSUES}
SELECT t.table_name, d.date AS rdate,
  CASE WHEN EXISTS (SELECT 1 FROM issues i WHERE i.table_name = t.table_name AND i.rdate = d.date) THEN 'quality issue'
       WHEN d.weekday >= 5 THEN 'weekend' WHEN d.holiday_flag = 1 THEN 'holiday'
       WHEN d.date = DATE '{AS_OF}' THEN 'today'
       WHEN date_trunc('month', d.date) = date_trunc('month', DATE '{AS_OF}') AND d.date > DATE '{AS_OF}' THEN 'later'
       ELSE 'none' END AS status
FROM days d CROSS JOIN (VALUES {', '.join(f"('{t}')" for t in TABLES)}) AS t(table_name)""",
)
def day_status(spark, d):
    return status.day_status(calendar(spark).days(), grouped_issues(spark, d), TABLES, AS_OF)


def _sql_matrix():
    def has(t, k):
        return f"coalesce(bool_or(i.table_name = '{t}' AND i.issue_type = '{k}'), false)"

    checks = ", ".join(f"{has(t, k)} AS {n}" for n, (t, k) in status.MATRIX_CHECKS.items())
    return f"""matrix AS (
  SELECT d.date AS rdate, {checks}, d.holiday_flag = 1 AS holiday
  FROM days d LEFT JOIN issues i ON i.rdate = d.date GROUP BY d.date, d.holiday_flag
)"""


@bound("c21_status_matrix", f"WITH {SQL_TABLE_ISSUES},{_sql_matrix()} SELECT * FROM matrix")
def status_matrix(spark, d):
    return status.status_matrix(calendar(spark).days(), table_issues(spark, d))


def _sql_codes():
    def code(t):
        def has(*kinds):
            wanted = ", ".join(f"'{k}'" for k in kinds)
            return f"coalesce(bool_or(i.table_name = '{t}' AND i.issue_type IN ({wanted})), false)"

        return (
            f"CASE WHEN {has('notin_id')} THEN 4 WHEN {has('is_monthly')} THEN 2"
            f" WHEN {has('is_daily')} THEN 1 WHEN {has('problem_row', 'universe_size')} THEN 3 ELSE 0 END AS {t}"
        )

    return ", ".join(code(t) for t in TABLES)


@bound(
    "c22_status_codes",
    f"""WITH {SQL_TABLE_ISSUES}
SELECT d.date AS rdate, {_sql_codes()}, CASE WHEN d.holiday_flag = 1 THEN 5 ELSE 0 END AS holiday
FROM days d LEFT JOIN issues i ON i.rdate = d.date GROUP BY d.date, d.holiday_flag""",
)
def status_codes(spark, d):
    return status.status_codes(calendar(spark).days(), table_issues(spark, d), TABLES)


@bound(
    "c23_day_reason",
    f"""WITH {SQL_TABLE_ISSUES},{_sql_matrix()}
SELECT rdate, CASE WHEN rdate > DATE '{AS_OF}' THEN 'none' WHEN holiday THEN 'holiday'
  WHEN rdate = DATE '{AS_OF}' THEN 'today'
  {' '.join(f"WHEN {c} THEN '{c}'" for c in status.REASON_ORDER)} ELSE 'none' END AS reason
FROM matrix""",
)
def day_reason(spark, d):
    return status.day_reason(status_matrix(spark, d), AS_OF)


SQL_NEAR = f"""near AS (
  SELECT * FROM issues
  WHERE CASE WHEN issue_type IN ('no_data', 'is_daily') OR (table_name = 'portholding' AND issue_type = 'problem_row')
             THEN rdate = DATE '{VERDICT_DAY}'
             ELSE date_trunc('month', rdate) = date_trunc('month', DATE '{VERDICT_DAY}') END
)"""
EXACT = [("portholding", BAD_ROW)]


@bound("c24_issues_on_date", f"WITH {SQL_TABLE_ISSUES},{SQL_NEAR} SELECT * FROM near")
def issues_on_date(spark, d):
    return issues.issues_on_date(table_issues(spark, d), VERDICT_DAY, EXACT)


@bound("c24b_issues_on_stored_date", f"WITH {SQL_TABLE_ISSUES},{SQL_NEAR} SELECT * FROM near")
def issues_on_stored_date(spark, d):
    """The findings are kept by table and month; one month is replaced by a second run, and one is read."""
    path, found = scratch_path(spark, "findings"), keep_issues(table_issues(spark, d))
    first, last = VERDICT_DAY.replace(day=1), VERDICT_DAY.replace(day=28)
    dated = found.where((F.col("rdate") < F.lit(first)) | (F.col("rdate") > F.last_day(F.lit(first))))
    findings.store_issues(dated, path, TABLES, START, END)
    month = found.where(F.col("rdate").isNull() | (F.date_trunc("month", "rdate") == F.lit(first)))
    findings.store_issues(month, path, TABLES, first, last)
    return issues.issues_on_date(findings.stored_issues(spark, path), VERDICT_DAY, EXACT)


SQL_STATE = f"""state AS (
  SELECT t.table_name,
         count(*) FILTER (n.issue_type IN ('is_daily', 'is_monthly')) > 0 AS absent,
         count(*) FILTER (n.issue_type NOT IN ('is_daily', 'is_monthly')) > 0 AS bad
  FROM (VALUES {', '.join(f"('{t}')" for t in TABLES)}) AS t(table_name)
  LEFT JOIN near n ON n.table_name = t.table_name GROUP BY t.table_name
)"""


@bound(
    "c25_date_verdict",
    f"""WITH {SQL_TABLE_ISSUES},{SQL_NEAR},{SQL_STATE}
SELECT table_name, CASE WHEN absent THEN 'no data' WHEN bad THEN 'problematic rows' ELSE 'success' END AS verdict
FROM state""",
)
def date_verdict(spark, d):
    return issues.date_verdict(table_issues(spark, d), VERDICT_DAY, TABLES, EXACT)


@bound(
    "c25b_date_verdict_all",
    f"""WITH {SQL_TABLE_ISSUES},{SQL_NEAR},{SQL_STATE}
SELECT table_name, 'no data' AS verdict FROM state WHERE absent
UNION ALL SELECT table_name, 'problematic rows' FROM state WHERE bad
UNION ALL SELECT table_name, 'success' FROM state WHERE NOT absent AND NOT bad""",
)
def date_verdict_all(spark, d):
    return issues.date_verdict(table_issues(spark, d), VERDICT_DAY, TABLES, EXACT, show_all=True)


@bound(
    "c26_bad_dates",
    f"""WITH {SQL_GROUPED_ISSUES}
SELECT DISTINCT rdate FROM issues WHERE table_name IN ('portholding', 'bg_div') AND rdate IS NOT NULL""",
)
def bad_dates(spark, d):
    return issues.bad_dates(grouped_issues(spark, d), ["portholding", "bg_div"])


@bound(
    "c27_join_by_date",
    """SELECT coalesce(o.rdate, l.rdate) AS rdate, o.n AS orders_n, l.n AS lines_n
FROM (SELECT CAST(o_orderdate AS DATE) AS rdate, count(*) AS n FROM orders GROUP BY ALL) o
FULL JOIN (SELECT CAST(l_shipdate AS DATE) AS rdate, count(*) AS n FROM lineitem GROUP BY ALL) l ON o.rdate = l.rdate""",
)
def join_by_date(spark, d):
    def daily(name, col):
        return table(spark, d, name).groupBy(F.to_date(col).alias("rdate")).agg(F.count(F.lit(1)).alias("n"))

    return issues.join_by_date(
        {"orders": daily("orders", "o_orderdate"), "lines": daily("lineitem", "l_shipdate")}
    )


@bound(
    "c28_date_flags",
    f"""WITH {SQL_CALENDAR}
SELECT date AS rdate, CASE WHEN date IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderstatus = 'P')
  THEN 1 ELSE 0 END AS flag FROM days WHERE date < DATE '{END}'""",
)
def date_flags(spark, d):
    pending = table(spark, d, "orders").where("o_orderstatus = 'P'")
    return completeness.date_flags(pending, "o_orderdate", START, END)


@bound(
    "c29_iso_week_grid",
    f"""WITH counts AS (
  SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY ALL
)
SELECT CAST(week(d) - min(week(d)) OVER () AS INTEGER) AS week,
  {', '.join(f"{n}" for n in WEEKDAY_LABELS)}
FROM (
  SELECT min(d) AS d,
    {', '.join(f"max(CASE WHEN isodow(d) = {i} THEN n END) AS {n}" for i, n in enumerate(WEEKDAY_LABELS, start=1))}
  FROM counts GROUP BY week(d)
)""",
)
def iso_week_grid(spark, d):
    counts = table(spark, d, "events").groupBy(F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return status.iso_week_grid(counts, "d", "n")


@bound(
    "c29b_iso_week_grid_over_years",
    f"""WITH counts AS (
  SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY ALL
)
SELECT CAST(date_diff('day', min(monday) OVER (), monday) // 7 AS INTEGER) AS week,
  {', '.join(f"{n}" for n in WEEKDAY_LABELS)}
FROM (
  SELECT CAST(date_trunc('week', d) AS DATE) AS monday,
    {', '.join(f"max(CASE WHEN isodow(d) = {i} THEN n END) AS {n}" for i, n in enumerate(WEEKDAY_LABELS, start=1))}
  FROM counts GROUP BY ALL
)""",
)
def iso_week_grid_over_years(spark, d):
    counts = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return status.iso_week_grid(counts, "d", "n")


@bound(
    "c30_year_month_status",
    f"""WITH {SQL_GROUPED_ISSUES}
SELECT CAST(y.year AS INTEGER) AS year,
  {', '.join(f"coalesce(bool_or(month(i.rdate) = {m}), false) AS {n}" for m, n in enumerate(MONTH_NAMES, start=1))}
FROM range(1990, 2003) AS y(year) LEFT JOIN issues i ON year(i.rdate) = y.year GROUP BY y.year""",
)
def year_month_status(spark, d):
    return status.year_month_status(grouped_issues(spark, d), 1990, 2002)


@bound(
    "c31_stale_weekly",
    """SELECT o_custkey, CAST(max(o_orderdate) AS DATE) AS last_update, DATE '2001-07-29' AS due
FROM orders GROUP BY o_custkey HAVING max(o_orderdate) < DATE '2001-07-29'""",
)
def stale_weekly(spark, d):
    return completeness.stale_weekly(table(spark, d, "orders"), "o_custkey", "o_orderdate", AS_OF)


@bound(
    "c32_date_coverage",
    f"""WITH {SQL_CALENDAR}
SELECT date AS rdate, date IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderstatus = 'F') AS present
FROM days WHERE holiday_flag = 0""",
)
def date_coverage(spark, d):
    finished = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return completeness.date_coverage(finished, "o_orderdate", calendar(spark))


@bound("c33_run_checks", f"WITH {SQL_GROUPED_ISSUES} SELECT * FROM issues")
def run_checks_grouped(spark, d):
    return grouped_issues(spark, d)


@bound(
    "c33c_audit_state",
    f"""WITH {SQL_GROUPED_ISSUES} SELECT * FROM issues
WHERE table_name = 'portholding' OR (table_name = 'univsnapshot' AND issue_type IN ('{NO_DATA}', '{SIZE_JUMP}'))""",
)
def audit_by_state(spark, d):
    """Three deliveries of each table, out of order and one of them repeated, each read once."""
    found = []
    for spec in specs(spark, d):
        if spec.name not in ("portholding", "univsnapshot"):
            continue
        kept = AuditState(spark, scratch_path(spark, f"state-{spec.name}"))
        wanted = [c for c in spec.checks if c in STATE_CHECKS]
        for part in (2, 0, 2, 1):
            delivery = F.pmod(F.col("o_orderkey"), F.lit(3)) == part
            kept.add(replace(spec, df=spec.df.where(delivery), reference=None, reference_key=None, checks=wanted), f"delivery-{part}")
        found.append(kept.issues(spec.name, calendar(spark), AS_OF, checks=wanted, frequency=spec.frequency))
    return found[0].unionByName(found[1])


@bound("c33b_run_checks_by_table", f"WITH {SQL_TABLE_ISSUES} SELECT * FROM issues")
def run_checks_table(spark, d):
    return table_issues(spark, d)


@bound(
    "flagship_missing_dates_with_totals",
    f"""{SQL_SUMMARY}
SELECT i.table_name, i.group_value, i.rdate, c.missing_data
FROM issues i JOIN counts c ON c.table_name = i.table_name WHERE i.issue_type = 'no_data'""",
)
def flagship(spark, d):
    """Missing dates of every group, next to their table's total of missing days."""
    found = keep_issues(grouped_issues(spark, d).where(F.col("issue_type") == NO_DATA))
    # One row per audited table.
    totals = issues.issue_summary(found, TABLES).select("table_name", "missing_data")
    return found.select("table_name", "group_value", "rdate").join(F.broadcast(totals), "table_name")
