"""Sources and sinks over the sample tables."""

from __future__ import annotations

import contextlib
from datetime import date

from pyspark.sql import functions as F

from chronaudit.bindings.registry import bound, table
from chronaudit.sources import files, publish, series, sinks
from chronaudit.sources.catalog import (
    TableRegistry,
    first_column,
    group_list,
    in_subquery,
    load_sql,
    predefined,
    standard_queries,
    year_period,
)

SQL_BENCHMARK = """
bench AS (
  SELECT CASE o_orderstatus WHEN 'F' THEN 'SP500' WHEN 'O' THEN 'sptsx' ELSE 'other' END AS bm_id,
         CAST(o_orderdate AS DATE) AS rdate, CAST(o_orderkey AS VARCHAR) AS fsym_id
  FROM orders
)"""


def benchmark(spark, d):
    status = F.col("o_orderstatus")
    return table(spark, d, "orders").select(
        F.when(status == "F", "SP500").when(status == "O", "sptsx").otherwise("other").alias("bm_id"),
        F.to_date("o_orderdate").alias("rdate"),
        F.col("o_orderkey").cast("string").alias("fsym_id"),
    )


@bound(
    "s01_named_queries",
    f"""WITH {SQL_BENCHMARK} SELECT * FROM bench
WHERE lower(bm_id) IN ('sp500', 'sptsx') AND year(rdate) = 1997""",
)
def named_queries(spark, d):
    tables = TableRegistry(spark)
    tables.add("bmc_monthly", benchmark(spark, d), ["bm_id", "rdate", "fsym_id"])
    return standard_queries(tables)["bmc_monthly"](year_period(1997))


@bound(
    "s01b_regular_dividends",
    """SELECT o.o_custkey AS fsym_id, CAST(o.o_orderdate AS DATE) AS exdate, l.rdate, o.o_orderstatus AS div_type
FROM orders o LEFT JOIN (
  SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS rdate FROM orders WHERE o_orderpriority = '1-URGENT'
) l ON l.o_custkey = o.o_custkey AND l.rdate = CAST(o.o_orderdate AS DATE)
WHERE o.o_orderstatus = 'F'""",
)
def dividends(spark, d):
    orders = table(spark, d, "orders")
    tables = TableRegistry(spark)
    kind = F.when(F.col("o_orderstatus") == "F", "regular").otherwise("other").alias("div_type")
    tables.add(
        "bg_div",
        orders.select(
            F.col("o_custkey").alias("fsym_id"), F.to_date("o_orderdate").alias("exdate"), kind,
            F.lit(0).alias("dummy_payment"), F.col("o_orderstatus").alias("div_freq"),
        ),
    )
    tables.add(
        "bg_div_ltm",
        orders.where("o_orderpriority = '1-URGENT'").select(
            F.col("o_custkey").alias("fsym_id"), F.to_date("o_orderdate").alias("date")
        ),
    )
    rows = standard_queries(tables)["div_ltm"]()
    return rows.select("fsym_id", "exdate", "rdate", F.col("div_freq").alias("div_type"))


@bound(
    "s02_load_by_sql",
    "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate >= DATE '1999-01-01' GROUP BY o_orderpriority",
)
def by_sql(spark, d):
    TableRegistry(spark).add("audited_orders", table(spark, d, "orders"))
    return load_sql(
        spark,
        """SELECT o_orderpriority, count(*) AS n FROM audited_orders
           WHERE o_orderdate >= :start GROUP BY o_orderpriority""",
        start=date(1999, 1, 1),
    )


@bound(
    "s03_first_column",
    """SELECT l_orderkey, l_linenumber FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""",
)
def as_list(spark, d):
    keys = first_column(table(spark, d, "orders").where("o_orderstatus = 'P'"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return in_subquery(lines, "l_orderkey", keys)


@bound(
    "s04_predefined",
    """SELECT o_custkey, o_orderkey FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def predefined_dataset(spark, d):
    tables = TableRegistry(spark)
    tables.add("holding", table(spark, d, "orders").select("o_custkey", "o_orderkey"))
    wanted = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return predefined(tables, "holding", wanted)


@bound(
    "s05_group_lists",
    """SELECT 'portfolio' AS list, c_mktsegment AS value FROM customer
UNION SELECT 'trading dates', strftime(o_orderdate, '%Y-%m-%d') FROM orders
UNION SELECT 'sector', p_type FROM part
UNION SELECT 'benchmark_constituent', CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'P'
UNION SELECT 'rate', event_type FROM events""",
)
def group_lists(spark, d):
    tables = TableRegistry(spark)
    for name in ("customer", "orders", "part", "events"):
        tables.add(f"src_{name}", table(spark, d, name))
    dates = tables["src_orders"].select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("tdate"))
    tables.add("src_tdates", dates)
    tables.define_list("portfolio", "src_customer", "c_mktsegment")
    tables.define_list("trading dates", "src_tdates", "tdate")
    tables.define_list("sector", "src_part", "p_type")
    tables.define_list("benchmark_constituent", "src_orders", "o_custkey", of="o_orderstatus")
    tables.define_list("rate", "src_events", "event_type")
    wanted = {"portfolio": None, "trading dates": None, "sector": None, "benchmark_constituent": "p", "rate": None}
    parts = []
    for name, of in wanted.items():
        values = group_list(tables, name, of)
        parts.append(values.select(F.lit(name).alias("list"), F.col(values.columns[0]).cast("string").alias("value")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@bound(
    "s06_append",
    """SELECT doc_id, CAST(nullif(quality, 0) AS DOUBLE) AS quality, CAST(NULL AS VARCHAR) AS note FROM labels
UNION ALL SELECT doc_id, 2.0, 'kept' FROM documents""",
)
def append(spark, d):
    """Append to a table that holds rows already; its files are read back."""
    path = files.scratch_path(spark, "append")
    kept = table(spark, d, "documents").select(
        "doc_id", F.lit(2.0).alias("quality"), F.lit("kept").alias("note")
    )
    kept.write.parquet(path)
    name = f"default.target_{path[-32:]}"
    spark.sql(
        f"CREATE TABLE {name} (doc_id BIGINT, quality DOUBLE, note STRING) USING parquet LOCATION '{path}'"
    )
    quality = F.when(F.col("quality") == 0, float("nan")).otherwise(F.col("quality").cast("double"))
    rows = table(spark, d, "labels").select("doc_id", quality.alias("quality"))
    sinks.append(spark, rows, name, ["default"])
    # The table is external: dropping its entry leaves the files in place.
    spark.sql(f"DROP TABLE {name}")
    return spark.read.parquet(path)


@bound(
    "s06b_publish",
    """SELECT doc_id, CAST(quality AS DOUBLE) AS quality, CAST(NULL AS VARCHAR) AS note FROM labels WHERE quality IS NOT NULL
UNION ALL SELECT doc_id, 2.0, 'kept' FROM documents""",
)
def publish_batches(spark, d):
    """Two batches, one of them delivered twice, and one that fails its check."""
    target = publish.BatchTable(spark, files.scratch_path(spark, "publish"), "doc_id bigint, quality double, note string")
    target.append(table(spark, d, "documents").select("doc_id", F.lit(2.0).alias("quality"), F.lit("kept").alias("note")), "documents")
    labels = table(spark, d, "labels").select("doc_id", "quality")
    known = {"quality": F.col("quality").isNotNull()}
    for _ in range(2):
        target.append(labels.where("quality is not null"), "labels", known)
    with contextlib.suppress(ValueError):
        target.append(labels.withColumn("quality", F.lit(None).cast("double")), "broken", known)
    return target.read()


@bound(
    "s07_rate_series",
    """SELECT event_type AS series_id, CAST(ts AS DATE) AS date, value FROM events
WHERE event_type IN ('click', 'error') AND ts >= DATE '2024-01-05' AND ts < DATE '2024-01-21'
  AND value IS NOT NULL""",
)
def rate_series(spark, d):
    long = table(spark, d, "events").select(
        F.col("event_type").alias("series_id"), F.to_date("ts").alias("date"), "value"
    )
    return series.read_series(long, ["click", "error"], date(2024, 1, 5), date(2024, 1, 20))


@bound(
    "s08_csv_files",
    """SELECT o_orderkey, o_orderpriority, CAST(o_orderdate AS DATE) AS rdate,
       CAST(o_orderdate AS DATE) AS packed FROM orders""",
)
def csv_files(spark, d):
    """Write CSV with dates as text in two of the known forms, and read it back typed."""
    path = files.scratch_path(spark, "csv")
    table(spark, d, "orders").select(
        "o_orderkey",
        "o_orderpriority",
        F.date_format("o_orderdate", "M/d/yyyy").alias("rdate"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("packed"),
    ).write.option("header", True).csv(path)
    schema = "o_orderkey bigint, o_orderpriority string, rdate string, packed string"
    return files.read_csv(spark, path, schema, date_cols=["rdate", "packed"])


@bound(
    "s08c_csv_quarantine",
    """SELECT o_orderkey, o_totalprice AS price, CAST(o_orderdate AS DATE) AS rdate, NULL AS line, NULL AS reason
FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT NULL, NULL, NULL, o_orderkey || ',' || o_orderpriority || ',' || strftime(o_orderdate, '%Y%m%d'),
  'price: not double: ' || o_orderpriority FROM orders WHERE o_orderstatus = 'P'""",
)
def csv_quarantine(spark, d):
    """Files in which some prices are texts: typed rows, and the lines of the others."""
    path = files.scratch_path(spark, "csv")
    price = F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise(F.col("o_totalprice").cast("string"))
    table(spark, d, "orders").select(
        "o_orderkey", price.alias("price"), F.date_format("o_orderdate", "yyyyMMdd").alias("rdate")
    ).write.option("header", True).csv(path)
    found = files.read_csv_checked(spark, path, "o_orderkey bigint, price double, rdate date", date_cols=["rdate"])
    return found.typed.unionByName(found.quarantined.drop("file"), allowMissingColumns=True)


@bound(
    "s08b_parquet_by_year",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS rdate, CAST(year(o_orderdate) AS INTEGER) AS year
FROM orders WHERE year(o_orderdate) IN (1996, 1997)""",
)
def parquet_by_year(spark, d):
    """Store by year and read a period back; other years' folders are not opened."""
    from chronaudit.model import TableSpec

    path = files.scratch_path(spark, "by-year")
    rows = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("rdate"))
    files.write_by_year(rows, path, "rdate")
    spec = TableSpec("orders", files.read_parquet(spark, path), year_col="year")
    return spec.between(date(1996, 1, 1), date(1997, 12, 31))
