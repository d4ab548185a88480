"""The relational building blocks of the checks, one query each, over whole tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from chronaudit.bindings.checks import SQL_DATA_HOLIDAYS, data_holidays
from chronaudit.bindings.fixtures import (
    END,
    PRIORITIES,
    SQL_CALENDAR,
    SQL_HELD,
    START,
    calendar,
    orders_by_month,
    orders_spec,
    orders_with_lines,
    status_history,
)
from chronaudit.bindings.registry import bound, table
from chronaudit.functions import dates as fd
from chronaudit.functions import predicates as fp
from chronaudit.model import TableSpec
from chronaudit.operators import integrity, ordered
from chronaudit.operators.calendar import calendar_spanning
from chronaudit.operators.completeness import present_dates
from chronaudit.operators.events import date_gaps
from chronaudit.operators.issues import join_by_date
from chronaudit.operators.rollup import growth, rollup, with_previous
from chronaudit.sources.catalog import in_subquery

DAY = "CAST(o_orderdate AS DATE)"


def orders(spark, d):
    return table(spark, d, "orders")


def dated_orders(spark, d):
    """Orders with the date as ``rdate``."""
    return orders(spark, d).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice",
        F.to_date("o_orderdate").alias("rdate"),
    )


def order_days(spark, d):
    return orders(spark, d).select(F.to_date("o_orderdate").alias("rdate")).distinct()


# Projections, filters, predicates


@bound("f01_projection", f"SELECT o_orderkey, {DAY} AS rdate, o_orderpriority FROM orders")
def projection(spark, d):
    return orders(spark, d).select("o_orderkey", F.to_date("o_orderdate").alias("rdate"), "o_orderpriority")


@bound("f01b_star", "SELECT * FROM customer")
def star(spark, d):
    return table(spark, d, "customer").select("*")


@bound("f02_rename", "SELECT c_custkey AS fsym_id, c_name AS security, c_mktsegment AS sector FROM customer")
def rename(spark, d):
    names = {"c_custkey": "fsym_id", "c_name": "security", "c_mktsegment": "sector"}
    return table(spark, d, "customer").select(*names).withColumnsRenamed(names)


@bound(
    "f03_in_list",
    "SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery')",
)
def in_list(spark, d):
    wanted = fp.text_in(F.col("c_mktsegment"), ["Building", "machinery"])
    return table(spark, d, "customer").where(wanted).select("c_custkey", "c_mktsegment")


@bound(
    "f04_not_in_list",
    f"""WITH {SQL_HELD}, tagged AS (
  SELECT o_orderkey, CASE WHEN l_orderkey IS NOT NULL THEN o_orderpriority END AS company FROM held)
SELECT o_orderkey, company FROM tagged WHERE company NOT IN ('1-URGENT', '5-LOW')""",
)
def not_in_list(spark, d):
    company = F.when(F.col("l_orderkey").isNotNull(), F.col("o_orderpriority")).alias("company")
    tagged = orders_with_lines(spark, d).select("o_orderkey", company)
    return tagged.where(fp.text_not_in(F.col("company"), ["1-urgent", "5-low"]))


@bound(
    "f05_equality_and",
    "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'",
)
def equality_and(spark, d):
    both = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "5-LOW")
    return orders(spark, d).where(both).select("o_orderkey")


@bound("f06_year_filter", f"SELECT o_orderkey, {DAY} AS rdate FROM orders WHERE year(o_orderdate) = 1997")
def year_filter(spark, d):
    rows = orders(spark, d).where(fp.in_year(F.col("o_orderdate"), 1997))
    return rows.select("o_orderkey", F.to_date("o_orderdate").alias("rdate"))


@bound(
    "f07_month_filter",
    f"SELECT o_orderkey, {DAY} AS rdate FROM orders WHERE year(o_orderdate) = 1998 AND month(o_orderdate) = 12",
)
def month_filter(spark, d):
    rows = orders(spark, d).where(fp.in_month(F.col("o_orderdate"), 1998, 12))
    return rows.select("o_orderkey", F.to_date("o_orderdate").alias("rdate"))


@bound("f08_before_cutoff", "SELECT o_orderkey FROM orders WHERE o_orderdate < DATE '1996-06-30'")
def before_cutoff(spark, d):
    return orders(spark, d).where(F.col("o_orderdate") < F.lit(date(1996, 6, 30))).select("o_orderkey")


@bound(
    "f09_null_tests",
    f"""WITH {SQL_HELD} SELECT o_orderkey, l_orderkey IS NULL AS no_lines FROM held
WHERE l_orderkey IS NULL OR l_orderkey IS NOT NULL AND o_orderstatus = 'P'""",
)
def null_tests(spark, d):
    key = F.col("l_orderkey")
    rows = orders_with_lines(spark, d).where(key.isNull() | key.isNotNull() & (F.col("o_orderstatus") == "P"))
    return rows.select("o_orderkey", key.isNull().alias("no_lines"))


@bound(
    "f10_not_equal_keeping_nulls",
    """SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE l.quality IS DISTINCT FROM 1""",
)
def not_equal(spark, d):
    docs = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return docs.where(fp.differs(F.col("quality"), 1)).select("doc_id")


@bound("f11_threshold", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000")
def threshold(spark, d):
    return table(spark, d, "customer").where(F.col("c_acctbal") > 5000).select("c_custkey", "c_acctbal")


@bound(
    "f12_mask_logic",
    f"""SELECT o_orderkey, isodow(o_orderdate) > 5 OR o_orderstatus = 'P' AS masked,
NOT (isodow(o_orderdate) > 5) AS weekday FROM orders""",
)
def mask_logic(spark, d):
    weekend = fd.is_weekend(F.col("o_orderdate").cast("date"))
    pending = F.col("o_orderstatus") == "P"
    return orders(spark, d).select(
        "o_orderkey", (weekend | pending).alias("masked"), (~weekend).alias("weekday")
    )


@bound("f13_constant", "SELECT o_orderkey, 1 AS count, 'no_data' AS issue_type FROM orders")
def constant(spark, d):
    return orders(spark, d).select("o_orderkey", F.lit(1).alias("count"), F.lit("no_data").alias("issue_type"))


@bound(
    "f14_conditional",
    "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'mid' "
    "ELSE 'small' END AS size FROM orders",
)
def conditional(spark, d):
    price = F.col("o_totalprice")
    size = F.when(price > 300000, "large").when(price > 100000, "mid").otherwise("small")
    return orders(spark, d).select("o_orderkey", size.alias("size"))


@bound(
    "f15_fill_missing",
    """SELECT d.doc_id, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def fill_missing(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return docs.join(table(spark, d, "labels"), "doc_id", "left").fillna(0)


@bound("f16_drop", f"WITH {SQL_HELD} SELECT o_orderkey, l_orderkey FROM held WHERE l_orderkey IS NOT NULL")
def drop(spark, d):
    rows = orders_with_lines(spark, d).dropna(subset=["l_orderkey"])
    return rows.drop("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


# Joins


@bound(
    "j01_left_two_keys",
    f"""SELECT o_orderkey, {DAY} AS exdate, l.ship AS rdate
FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, CAST(l_shipdate AS DATE) AS ship FROM lineitem) l
  ON o_orderkey = l.l_orderkey AND {DAY} = l.ship""",
)
def left_two_keys(spark, d):
    left = orders(spark, d).select("o_orderkey", F.to_date("o_orderdate").alias("exdate"))
    right = table(spark, d, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("rdate")).distinct()
    match = (left.o_orderkey == right.l_orderkey) & (left.exdate == right.rdate)
    return left.join(right, match, "left").select("o_orderkey", "exdate", "rdate")


@bound(
    "j02_calendar_holidays",
    f"""WITH {SQL_DATA_HOLIDAYS},
span AS (SELECT CAST(unnest(generate_series(min(l_shipdate), max(l_shipdate), INTERVAL 1 DAY)) AS DATE) AS date FROM lineitem)
SELECT s.date, CASE WHEN h.date IS NULL THEN 0 ELSE 1 END AS holiday_flag
FROM span s LEFT JOIN (SELECT DISTINCT holiday_date AS date FROM hol) h ON s.date = h.date""",
)
def calendar_holidays(spark, d):
    days = calendar_spanning(table(spark, d, "lineitem"), "l_shipdate", data_holidays(spark, d))
    return days.select("date", "holiday_flag")


@bound(
    "j03_anti_dates",
    f"WITH {SQL_CALENDAR} SELECT date FROM days WHERE date NOT IN (SELECT {DAY} FROM orders)",
)
def anti_dates(spark, d):
    cal = calendar(spark)
    there = present_dates(orders(spark, d), "o_orderdate", cal)
    return cal.days().select("date").join(F.broadcast(there), "date", "left_anti")


@bound(
    "j04_semi_dates",
    f"WITH {SQL_CALENDAR} SELECT date FROM days WHERE bday AND date IN (SELECT {DAY} FROM orders)",
)
def semi_dates(spark, d):
    cal = calendar(spark)
    there = present_dates(orders(spark, d), "o_orderdate", cal)
    return cal.business_days().join(F.broadcast(there), "date", "left_semi")


@bound(
    "j05_in_subquery",
    """SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey IN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P')""",
)
def in_distinct(spark, d):
    rows = orders(spark, d).select("o_orderkey", "o_custkey")
    pending = orders(spark, d).where("o_orderstatus = 'P'").select("o_custkey")
    return in_subquery(rows, "o_custkey", pending)


@bound(
    "j06_anti_rows_null_safe",
    f"""WITH {SQL_HELD} SELECT o_orderkey, l_orderkey FROM held h
WHERE NOT EXISTS (SELECT 1 FROM held k WHERE k.o_orderstatus = 'F' AND k.l_orderkey IS NOT DISTINCT FROM h.l_orderkey)""",
)
def anti_rows(spark, d):
    held = orders_with_lines(spark, d)
    rows = held.select("o_orderkey", "l_orderkey")
    known = held.where("o_orderstatus = 'F'").select(F.col("l_orderkey").alias("known"))
    return integrity.orphan_rows(rows, known, "l_orderkey", "known")


SQL_TWO_COUNTS = """
o AS (SELECT CAST(o_orderdate AS DATE) AS rdate, count(*) AS n FROM orders GROUP BY ALL),
l AS (SELECT CAST(l_shipdate AS DATE) AS rdate, count(*) AS n FROM lineitem GROUP BY ALL)"""


def two_counts(spark, d):
    def daily(name, col):
        return table(spark, d, name).groupBy(F.to_date(col).alias("rdate")).agg(F.count(F.lit(1)).alias("n"))

    return daily("orders", "o_orderdate"), daily("lineitem", "l_shipdate")


@bound(
    "j07_inner_on_date",
    f"WITH {SQL_TWO_COUNTS} SELECT o.rdate, o.n AS orders_n, l.n AS lines_n FROM o JOIN l ON o.rdate = l.rdate",
)
def inner_on_date(spark, d):
    o, l = two_counts(spark, d)
    return o.withColumnRenamed("n", "orders_n").join(l.withColumnRenamed("n", "lines_n"), "rdate")


@bound(
    "j08_full_outer",
    f"""WITH {SQL_TWO_COUNTS},
f AS (SELECT CAST(o_orderdate AS DATE) AS rdate, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
SELECT coalesce(o.rdate, l.rdate, f.rdate) AS rdate, o.n AS o_n, l.n AS l_n, f.n AS f_n
FROM o FULL JOIN l ON o.rdate = l.rdate FULL JOIN f ON coalesce(o.rdate, l.rdate) = f.rdate""",
)
def full_outer(spark, d):
    o, l = two_counts(spark, d)
    f = (
        orders(spark, d).where("o_orderstatus = 'F'")
        .groupBy(F.to_date("o_orderdate").alias("rdate")).agg(F.count(F.lit(1)).alias("n"))
    )
    return join_by_date({"o": o, "l": l, "f": f})


@bound(
    "j09_groups_by_calendar",
    f"""WITH {SQL_CALENDAR}
SELECT g.o_custkey, d.date AS rdate
FROM (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders GROUP BY o_custkey) g
JOIN (SELECT date FROM days WHERE date = last_day(date)) d ON d.date BETWEEN g.a AND g.b""",
)
def groups_by_calendar(spark, d):
    """Each group with each month end of the calendar within the group's own span."""
    spans = dated_orders(spark, d).groupBy("o_custkey").agg(
        F.greatest(F.min("rdate"), F.lit(START)).alias("a"), F.least(F.max("rdate"), F.lit(END)).alias("b")
    ).where("a <= b")
    return spans.select("o_custkey", F.explode(fd.month_ends_between(F.col("a"), F.col("b"))).alias("rdate"))


# Aggregations


@bound(
    "a01_count_per_group_date",
    f"SELECT o_orderpriority, {DAY} AS rdate, count(*) AS n_rows FROM orders GROUP BY ALL",
)
def count_per_group(spark, d):
    counts = rollup(orders_spec(spark, d))
    return counts.select(F.col("group_value").alias("o_orderpriority"), "rdate", "n_rows")


@bound("a02_distinct", "SELECT DISTINCT o_custkey, o_orderpriority FROM orders")
def distinct(spark, d):
    return orders(spark, d).select("o_custkey", "o_orderpriority").distinct()


@bound(
    "a03_drop_duplicates",
    f"SELECT o_orderpriority, {DAY} AS rdate FROM orders GROUP BY ALL",
)
def drop_duplicates(spark, d):
    return dated_orders(spark, d).select("o_orderpriority", "rdate").dropDuplicates(["o_orderpriority", "rdate"])


@bound(
    "a04_row_count",
    f"SELECT count(*) AS n_rows, count(DISTINCT {DAY}) AS n_dates FROM orders",
)
def row_count(spark, d):
    # Counting per date first leaves one row per date for the distinct count.
    per_date = dated_orders(spark, d).groupBy("rdate").agg(F.count(F.lit(1)).alias("n"))
    return per_date.agg(F.sum("n").alias("n_rows"), F.count("rdate").alias("n_dates"))


@bound(
    "a05_collect_explode",
    "SELECT DISTINCT o_orderpriority, last_day(o_orderdate) AS month_end FROM orders",
)
def collect_explode(spark, d):
    """Months per group, gathered into one array per group and unrolled again."""
    months = orders(spark, d).select("o_orderpriority", F.last_day("o_orderdate").alias("m")).distinct()
    arrays = months.groupBy("o_orderpriority").agg(F.collect_list("m").alias("ms"))
    return arrays.select("o_orderpriority", F.explode("ms").alias("month_end"))


@bound("a06_max", f"SELECT o_custkey, max({DAY}) AS latest FROM orders GROUP BY o_custkey")
def maximum(spark, d):
    return dated_orders(spark, d).groupBy("o_custkey").agg(F.max("rdate").alias("latest"))


@bound("a07_min", f"SELECT o_custkey, min({DAY}) AS earliest FROM orders GROUP BY o_custkey")
def minimum(spark, d):
    return dated_orders(spark, d).groupBy("o_custkey").agg(F.min("rdate").alias("earliest"))


@bound(
    "a08_all_any",
    f"""WITH {SQL_HELD} SELECT o_custkey, bool_and(l_orderkey IS NULL) AS all_null,
bool_or(l_orderkey IS NULL) AS any_null FROM held GROUP BY o_custkey""",
)
def all_any(spark, d):
    gone = F.col("l_orderkey").isNull()
    return orders_with_lines(spark, d).groupBy("o_custkey").agg(
        F.bool_and(gone).alias("all_null"), F.bool_or(gone).alias("any_null")
    )


@bound(
    "a09_pivot_date_group",
    "SELECT CAST(o_orderdate AS DATE) AS rdate, "
    + ", ".join(f"""CAST(count(*) FILTER (o_orderpriority = '{p}') AS BIGINT) AS "{p}" """ for p in PRIORITIES)
    + " FROM orders GROUP BY ALL",
)
def pivot_date_group(spark, d):
    days = dated_orders(spark, d).groupBy("rdate").pivot("o_orderpriority", list(PRIORITIES))
    return days.agg(F.count(F.lit(1))).fillna(0)


@bound(
    "a10_pivot_week_weekday",
    "SELECT CAST(week(ts) AS INTEGER) AS week, "
    + ", ".join(f"""count(*) FILTER (isodow(ts) = {i}) AS {n}""" for i, n in enumerate(fd.WEEKDAY_LABELS, start=1))
    + " FROM events GROUP BY ALL",
)
def pivot_week_weekday(spark, d):
    day = F.to_date("ts")
    rows = table(spark, d, "events").select(
        F.weekofyear(day).alias("week"), fd.weekday_label(day).alias("label")
    )
    return rows.groupBy("week").pivot("label", list(fd.WEEKDAY_LABELS)).agg(F.count(F.lit(1))).fillna(0)


@bound(
    "a11_sum_of_counts",
    """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS finished,
count(*) FILTER (o_orderstatus = 'P') AS pending,
count(*) FILTER (o_orderstatus = 'F') + count(*) FILTER (o_orderstatus = 'P') AS total
FROM orders GROUP BY o_orderpriority""",
)
def sum_of_counts(spark, d):
    counts = orders(spark, d).groupBy("o_orderpriority").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("finished"),
        F.count_if(F.col("o_orderstatus") == "P").alias("pending"),
    )
    return counts.withColumn("total", F.col("finished") + F.col("pending"))


# Windows


SQL_SIZES = """
sizes AS (
  SELECT o_orderpriority, rdate, n_rows, lag(n_rows) OVER (PARTITION BY o_orderpriority ORDER BY rdate) AS previous
  FROM (SELECT o_orderpriority, last_day(o_orderdate) AS rdate, count(*) AS n_rows FROM orders GROUP BY ALL)
)"""


def monthly_sizes(spark, d):
    spec = TableSpec("orders", orders_by_month(spark, d), "rdate", "o_orderpriority", None, "monthly")
    sizes = with_previous(rollup(spec)).where("previous IS NOT NULL")
    return sizes.withColumnRenamed("group_value", "o_orderpriority")


@bound(
    "w01_difference",
    f"WITH {SQL_SIZES} SELECT o_orderpriority, rdate, n_rows - previous AS change FROM sizes WHERE previous IS NOT NULL",
)
def difference(spark, d):
    return monthly_sizes(spark, d).select(
        "o_orderpriority", "rdate", (F.col("n_rows") - F.col("previous")).alias("change")
    )


@bound(
    "w02_relative_change",
    f"""WITH {SQL_SIZES} SELECT o_orderpriority, rdate, (n_rows - previous) / n_rows AS growth FROM sizes
WHERE previous IS NOT NULL""",
)
def relative_change(spark, d):
    return monthly_sizes(spark, d).select("o_orderpriority", "rdate", growth().alias("growth"))


@bound(
    "w03_drop_latest",
    f"""SELECT o_orderkey, o_custkey, {DAY} AS exdate FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY {DAY} DESC, o_orderkey DESC) > 1""",
)
def drop_latest(spark, d):
    rows = status_history(spark, d).select("o_orderkey", "o_custkey", "exdate")
    return ordered.drop_latest(rows, "o_custkey", ["exdate", "o_orderkey"])


@bound(
    "w04_neighbours",
    f"""SELECT o_orderkey, coalesce(lag(o_orderkey) OVER w, -1) AS previous_key,
       coalesce(lead(o_orderkey) OVER w, -1) AS next_key,
       first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY {DAY} DESC, o_orderkey DESC) AS latest_key
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY {DAY}, o_orderkey)""",
)
def neighbours(spark, d):
    rows = status_history(spark, d).select("o_orderkey", "o_custkey", "exdate")
    near = ordered.with_neighbours(rows, "o_custkey", "exdate", "o_orderkey")
    return near.select(
        "o_orderkey",
        F.coalesce("previous.o_orderkey", F.lit(-1)).alias("previous_key"),
        F.coalesce("next.o_orderkey", F.lit(-1)).alias("next_key"),
        F.col("latest.o_orderkey").alias("latest_key"),
    )


@bound(
    "w05_day_gap",
    """SELECT user_id, rdate,
  CAST(coalesce(rdate - lag(rdate) OVER (PARTITION BY user_id ORDER BY rdate), 1) AS INTEGER) AS diff_days
FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS rdate FROM events)""",
)
def day_gap(spark, d):
    return date_gaps(table(spark, d, "events"), "user_id", "ts").drop("n_rows")


@bound(
    "w06_first_row_per_group",
    f"""SELECT o_custkey, {DAY} AS exdate, o_orderkey, o_orderstatus FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY {DAY}, o_orderkey) = 1""",
)
def first_row(spark, d):
    rows = status_history(spark, d).drop("flagged")
    return ordered.first_per_group(rows, "o_custkey", ["exdate", "o_orderkey"])


# Sorts


@bound("o01_order_by", f"SELECT o_custkey, {DAY} AS rdate, o_orderkey FROM orders ORDER BY o_custkey, rdate, o_orderkey")
def order_by(spark, d):
    return dated_orders(spark, d).select("o_custkey", "rdate", "o_orderkey").orderBy("o_custkey", "rdate", "o_orderkey")


@bound(
    "o02_sorted_list",
    """SELECT o_orderpriority, string_agg(strftime(m, '%Y-%m-%d'), ',' ORDER BY m) AS months
FROM (SELECT DISTINCT o_orderpriority, last_day(o_orderdate) AS m FROM orders) GROUP BY o_orderpriority""",
)
def sorted_list(spark, d):
    months = orders(spark, d).select("o_orderpriority", F.last_day("o_orderdate").alias("m")).distinct()
    lists = months.groupBy("o_orderpriority").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    text = F.array_join(F.transform("ms", fd.iso_text), ",")
    return lists.select("o_orderpriority", text.alias("months"))


@bound(
    "o03_last_per_group",
    f"""SELECT o_custkey, {DAY} AS exdate, o_orderkey, o_orderstatus FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY {DAY} DESC, o_orderkey DESC) = 1""",
)
def last_row(spark, d):
    rows = status_history(spark, d).drop("flagged")
    return ordered.last_per_group(rows, "o_custkey", ["exdate", "o_orderkey"])


# Set operations


def finished_days(spark, d):
    return order_days_of(spark, d, "F")


def order_days_of(spark, d, status):
    return orders(spark, d).where(F.col("o_orderstatus") == status).select(F.to_date("o_orderdate").alias("rdate"))


def _days_of(status):
    return f"SELECT {DAY} AS rdate FROM orders WHERE o_orderstatus = '{status}'"


@bound("u01_difference", f"SELECT {DAY} AS rdate FROM orders EXCEPT {_days_of('F')}")
def set_difference(spark, d):
    return integrity.difference(order_days(spark, d), finished_days(spark, d))


@bound("u02_intersection", f"{_days_of('P')} INTERSECT {_days_of('F')}")
def set_intersection(spark, d):
    return integrity.intersection(order_days_of(spark, d, "P"), finished_days(spark, d))


@bound(
    "u03_union_tagged",
    f"""SELECT 'finished' AS issue_type, {DAY} AS rdate, o_orderkey AS entity_id, NULL AS qty FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'shipped', CAST(l_shipdate AS DATE), l_orderkey, l_quantity FROM lineitem""",
)
def union_tagged(spark, d):
    done = orders(spark, d).where("o_orderstatus = 'F'").select(
        F.lit("finished").alias("issue_type"),
        F.to_date("o_orderdate").alias("rdate"),
        F.col("o_orderkey").alias("entity_id"),
    )
    shipped = table(spark, d, "lineitem").select(
        F.lit("shipped").alias("issue_type"),
        F.to_date("l_shipdate").alias("rdate"),
        F.col("l_orderkey").alias("entity_id"),
        F.col("l_quantity").alias("qty"),
    )
    return done.unionByName(shipped, allowMissingColumns=True)


@bound("u04_union_distinct", f"SELECT {DAY} AS rdate FROM orders UNION SELECT CAST(l_shipdate AS DATE) FROM lineitem")
def union_distinct(spark, d):
    shipped = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("rdate"))
    return orders(spark, d).select(F.to_date("o_orderdate").alias("rdate")).union(shipped).distinct()


# Scalar functions: each over the date of every order


def scalar(name, sql, column):
    """Register one expression on ``rdate`` as column ``v`` next to the order key."""

    @bound(name, f"SELECT o_orderkey, {sql} AS v FROM (SELECT *, {DAY} AS rdate FROM orders)")
    def query(spark, d):
        return dated_orders(spark, d).select("o_orderkey", column().alias("v"))


def rdate():
    return F.col("rdate")


@bound(
    "x01_year_month_day",
    f"""SELECT o_orderkey, CAST(year({DAY}) AS INTEGER) AS y, CAST(month({DAY}) AS INTEGER) AS m,
CAST(day({DAY}) AS INTEGER) AS d FROM orders""",
)
def year_month_day(spark, d):
    return dated_orders(spark, d).select(
        "o_orderkey", F.year("rdate").alias("y"), F.month("rdate").alias("m"), F.day("rdate").alias("d")
    )


scalar("x02_weekday", "CAST(isodow(rdate) - 1 AS INTEGER)", lambda: F.weekday("rdate"))
scalar("x03_month_name", "monthname(rdate)", lambda: fd.month_name(rdate()))
scalar(
    "x04_weekday_label",
    "['M', 'T', 'W', 'Th', 'F', 'S', 'Su'][isodow(rdate)]",
    lambda: fd.weekday_label(rdate()),
)
scalar("x05_iso_week", "CAST(week(rdate) AS INTEGER)", lambda: F.weekofyear("rdate"))
scalar("x06_month_end", "last_day(rdate)", lambda: F.last_day("rdate"))
scalar(
    "x07_shift_days",
    "CAST(rdate - 3 AS DATE)",
    lambda: F.date_sub(F.date_add("rdate", 1), 4),
)


@bound(
    "x08_daily_range",
    """SELECT o_orderpriority, o_orderstatus,
  CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS DATE) AS rdate
FROM orders GROUP BY o_orderpriority, o_orderstatus""",
)
def daily_range(spark, d):
    spans = dated_orders(spark, d).groupBy("o_orderpriority", "o_orderstatus").agg(
        F.min("rdate").alias("a"), F.max("rdate").alias("b")
    )
    days = F.explode(fd.days_between(F.col("a"), F.col("b"))).alias("rdate")
    return spans.select("o_orderpriority", "o_orderstatus", days)


@bound(
    "x09_month_end_range",
    f"""SELECT o_custkey, e AS rdate FROM (
  SELECT o_custkey, max(o_orderdate) AS b,
    last_day(unnest(generate_series(date_trunc('month', min(o_orderdate)), max(o_orderdate), INTERVAL 1 MONTH))) AS e
  FROM orders GROUP BY o_custkey) WHERE e <= b""",
)
def month_end_range(spark, d):
    spans = dated_orders(spark, d).groupBy("o_custkey").agg(F.min("rdate").alias("a"), F.max("rdate").alias("b"))
    return spans.select("o_custkey", F.explode(fd.month_ends_between(F.col("a"), F.col("b"))).alias("rdate"))


@bound("x10_truncate_to_date", "SELECT event_id, CAST(ts AS DATE) AS v FROM events")
def truncate(spark, d):
    return table(spark, d, "events").select("event_id", F.to_date("ts").alias("v"))


scalar(
    "x11_today",
    "rdate < DATE '2000-01-01'",
    lambda: rdate() < F.lit(date(2000, 1, 1)),
)
scalar("x12_format_date", "strftime(rdate, '%Y-%m-%d')", lambda: fd.iso_text(rdate()))
scalar(
    "x13_week_of_month",
    "CAST(ceil((day(rdate) + isodow(date_trunc('month', rdate)) - 1) / 7.0) AS INTEGER)",
    lambda: fd.week_of_month(rdate()),
)
scalar(
    "x14_replace",
    "replace(o_orderpriority, '-', ' ')",
    lambda: F.replace("o_orderpriority", F.lit("-"), F.lit(" ")),
)
scalar("x15_cast", "CAST(day(rdate) AS VARCHAR)", lambda: F.day("rdate").cast("string"))


@bound("x16_integer_division", "SELECT l_orderkey, l_linenumber, l_linenumber // 2 AS v FROM lineitem")
def integer_division(spark, d):
    halves = F.expr("l_linenumber div 2").cast("int").alias("v")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", halves)


scalar("x17_ceiling", "CAST(ceil(o_totalprice / 1000) AS BIGINT)", lambda: F.ceil(F.col("o_totalprice") / 1000))


@bound(
    "x18_null_and_nan",
    """SELECT d.doc_id, l.quality IS NULL AS is_null, coalesce(isnan(CASE WHEN l.quality = 0 THEN 'NaN'::DOUBLE
ELSE l.quality END), false) AS is_nan FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def null_and_nan(spark, d):
    docs = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    value = F.when(F.col("quality") == 0, F.lit(float("nan"))).otherwise(F.col("quality"))
    return docs.select("doc_id", F.isnull("quality").alias("is_null"), F.isnan(value).alias("is_nan"))


scalar("x19_lower", "lower(o_orderpriority)", lambda: F.lower("o_orderpriority"))
