from datetime import date

import pytest
from helpers import dates, day, frame, rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from chronaudit import Calendar, run_checks
from chronaudit.functions.dates import parse_text_date
from chronaudit.functions.predicates import in_month, in_year, text_in, text_not_in
from chronaudit.sources import catalog, files, jdbc, series, sinks


@pytest.fixture(scope="module")
def tables(spark):
    t = catalog.TableRegistry(spark)
    t.add("bmc_monthly", frame(spark, "bm_id string, rdate date, fsym_id string, w double", [
        ("SP500", "2021-01-31", "a", 1.0), ("sptsx", "2021-01-31", None, 1.0), ("R2000", "2021-01-31", "c", 1.0),
        ("SP500", "2020-12-31", "a", 1.0),
    ]))
    t.add("univsnapshot", frame(spark, "univ_id string, rdate date, fsym_id string", [
        ("us", "2021-01-31", "a"), ("CANADA", "2021-01-31", "zz"), ("EU", "2021-01-31", "q"),
    ]))
    t.add("portholding", frame(spark, "pid string, rdate date, secid string, company string", [
        ("BG001", "2021-01-04", "a", "A Inc"), ("BG001", "2021-01-05", None, "B Inc"),
        ("BG001", "2021-01-05", None, "cash-invest-usd"), ("BG001", "2021-01-05", "x", None),
        ("BG099", "2021-01-05", "x", "A Inc"),
    ]))
    t.add("portreturn", frame(spark, "pid string, rdate date, ret double", [("BG001", "2021-01-04", 0.1)]))
    t.add("bmprices", frame(spark, "bm_id string, rdate date, price_index double, total_index double, v int", [
        ("SP500", "2021-01-04", 1.0, 2.0, 3),
    ]))
    t.add("adjpricet", frame(spark, "fsym_id string", [("a",)]))
    t.add("bg_div", frame(
        spark,
        "fsym_id string, exdate date, div_type string, div_initiation boolean, div_freq string, dummy_payment int",
        [
            ("s", "2021-01-05", "suspension", False, "q", 0), ("s", "2021-02-05", "regular", False, "q", 0),
            ("s", "2021-03-05", "regular", False, "q", 0), ("s", "2021-02-06", "special", False, "q", 0),
            ("r", "2021-01-07", "regular", False, "q", 0), ("r", "2020-01-07", "regular", False, "q", 1),
        ],
    ))
    t.add("bg_div_ltm", frame(spark, "fsym_id string, date date", [("r", "2021-01-07"), ("r", "2021-01-07")]))
    t.add("holiday", frame(spark, "fref_exchange_code string, holiday_date date, holiday_name string", [
        ("NYS", "2021-01-01", "New Year"), ("LSE", "2021-01-04", "other"), ("TSE", "2020-07-01", "Canada Day"),
    ]))
    return t


def test_standard_queries(tables):
    q = catalog.standard_queries(tables)
    year = catalog.year_period(2021)
    assert rows(q["bmc_monthly"](year)) == [
        ("SP500", date(2021, 1, 31), "a"), ("sptsx", date(2021, 1, 31), None),
    ]
    assert {r["univ_id"] for r in q["univsnapshot"](year).collect()} == {"us", "CANADA"}
    # Cash lines go, as does a row without company; ids are renamed.
    held = q["portholding"](year)
    assert held.columns == ["pid", "rdate", "fsym_id"]
    assert rows(held) == [("BG001", date(2021, 1, 4), "a"), ("BG001", date(2021, 1, 5), None)]
    # Matched and unmatched regular dividends of the year, each once.
    assert rows(q["div_ltm"](year).select("fsym_id", "exdate", "rdate")) == [
        ("r", date(2021, 1, 7), date(2021, 1, 7)), ("s", date(2021, 2, 5), None), ("s", date(2021, 3, 5), None),
    ]
    assert q["portreturn"](year).columns == ["pid", "rdate", "ret"]
    assert q["bmprices"]().columns == ["bm_id", "rdate", "price_index", "total_index"]
    assert len(rows(q["bg_div"]())) == 3
    assert dates(q["holiday"](year), "holiday_date") == ["2021-01-01"]


def test_standard_audit(spark, tables):
    cal = Calendar.for_year(spark, 2021, catalog.standard_queries(tables)["holiday"]())
    specs = catalog.standard_specs(tables, catalog.year_period(2021))
    found = run_checks(specs, cal, day("2021-01-08"))
    kinds = {(r["table_name"], r["issue_type"]) for r in found.collect()}
    assert ("portholding", "no_fsym_id") in kinds and ("univsnapshot", "no_adjprice") in kinds
    assert ("bg_div", "no_div_init_flag") in kinds
    by_table = run_checks(specs, cal, day("2021-01-08"), style="table")
    div = by_table.where("table_name = 'div_ltm'")
    assert div.where("issue_type = 'problem_row'").count() == 2
    # Only January has a matched dividend.
    assert div.where("issue_type = 'is_monthly'").count() == 334


def test_registry(spark, tables):
    assert "bmc_monthly" in tables and "nope" not in tables
    assert "bg_div" in tables.names()
    with pytest.raises(KeyError):
        tables["nope"]
    with pytest.raises(ValueError):
        tables.add("bad", frame(spark, "a int", []), ["b"])


def test_sql_parameters_are_bound(spark, tables):
    hit = catalog.load_sql(spark, "SELECT bm_id FROM bmc_monthly WHERE bm_id = :b", b="SP500")
    assert hit.count() == 2
    none = catalog.load_sql(spark, "SELECT bm_id FROM bmc_monthly WHERE bm_id = :b", b="x' OR '1'='1")
    assert none.count() == 0
    assert catalog.first_column(tables["bmprices"]).columns == ["bm_id"]


def test_predefined_and_lists(spark, tables):
    tables.add("holding", tables["portholding"])
    assert catalog.predefined(tables, "holding").count() == 5
    assert catalog.predefined(tables, "holding", ["BG099"], "pid").count() == 1
    ids = frame(spark, "p string", [("BG001",), ("BG001",), (None,)])
    assert catalog.predefined(tables, "holding", ids).count() == 4
    with pytest.raises(ValueError):
        catalog.predefined(tables, "rateholding")
    tables.define_list("portfolio", "portholding", "pid")
    tables.define_list("benchmark_constituent", "bmc_monthly", "fsym_id", of="bm_id")
    assert rows(catalog.group_list(tables, "portfolio")) == [("BG001",), ("BG099",)]
    assert rows(catalog.group_list(tables, "benchmark_constituent", "sp500")) == [("a",)]
    assert rows(catalog.group_list(tables, "benchmark_constituent")) == [("a",), ("c",)]
    with pytest.raises(ValueError):
        catalog.group_list(tables, "nope")
    with pytest.raises(ValueError):
        catalog.group_list(tables, "portfolio", "bg001")
    with pytest.raises(ValueError):
        tables.define_list("rate", "portholding", "nothing")
    with pytest.raises(KeyError):
        catalog.group_list(tables, "sector")


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2021-03-02", "2021-03-02"), ("11/30/2021", "2021-11-30"), ("1/1/2020 0:00", "2020-01-01"),
        ("20210731", "2021-07-31"), (" 2021-03-02 ", "2021-03-02"), ("N/A", None), (None, None), ("", None),
        ("2021-13-01", None),
    ],
)
def test_text_dates(spark, text, expected):
    got = frame(spark, "t string", [(text,)]).select(parse_text_date(F.col("t"))).first()[0]
    assert str(got) == str(expected)


def test_csv(spark, tmp_path):
    text = (
        "\ufeff,fsym_id,exdate,rating\n"
        "0,B19ST9-R,1/1/2020 0:00,N/A\n"
        '1,"A, B",2021-03-02,AA\n'
        "2,C,,\n"
    )
    (tmp_path / "sec.csv").write_text(text, encoding="utf-8")
    df = files.read_csv(spark, str(tmp_path / "sec.csv"), date_cols=["exdate"], null_text="N/A")
    assert df.columns == ["fsym_id", "exdate", "rating"]
    assert rows(df) == [("A, B", date(2021, 3, 2), "AA"), ("B19ST9-R", date(2020, 1, 1), None), ("C", None, None)]


def test_strict_csv(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("k,d\na,2021-03-02\nb,\nc,soon\n", encoding="utf-8")
    path = str(tmp_path / "bad.csv")
    assert rows(files.read_csv(spark, path, date_cols=["d"]))[0] == ("a", date(2021, 3, 2))
    with pytest.raises(PySparkException, match="not a date: soon"):
        files.read_csv(spark, path, date_cols=["d"], strict=True).collect()
    kept = files.read_csv(spark, path, date_cols=["d"], null_text="soon", strict=True)
    assert [r["k"] for r in kept.where("d is null").orderBy("k").collect()] == ["b", "c"]


def test_files_by_year(spark, tmp_path):
    df = spark.range(0, 4000, 1, 16).select("id", F.expr("date_add(date'2019-01-01', cast(id % 1000 as int))").alias("d"))
    for n in (1, 3):
        path = tmp_path / f"t{n}"
        files.write_by_year(df, str(path), "d", files_per_year=n)
        assert all(1 <= len(list(y.glob("part-*"))) <= n for y in path.glob("year=*"))
        assert spark.read.parquet(str(path)).count() == 4000


def test_append(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql(f"CREATE TABLE sink_test (a STRING, b DOUBLE, c INT) USING parquet LOCATION '{path}'")
    try:
        new = spark.createDataFrame([(float("nan"), "x"), (1.5, None)], "b double, a string")
        sinks.append(spark, new, "default.sink_test", ["Default"])
        sinks.append(spark, new.limit(1), "default.sink_test", ["default"])
        assert rows(spark.table("sink_test")) == [(None, 1.5, None), ("x", None, None), ("x", None, None)]
        with pytest.raises(ValueError, match="nothing"):
            sinks.append(spark, new.where("false"), "default.sink_test", ["default"])
        with pytest.raises(ValueError, match="database"):
            sinks.append(spark, new, "default.sink_test", ["fstest", "development"])
        with pytest.raises(ValueError, match="exist"):
            sinks.append(spark, new, "default.no_such_table", ["default"])
        with pytest.raises(ValueError, match="column"):
            sinks.append(spark, new.withColumn("z", F.lit(1)), "default.sink_test", ["default"])
        # A job that fails half way leaves the table as it was.
        broken = new.withColumn("c", F.raise_error(F.lit("broken")).cast("int"))
        with pytest.raises(Exception, match="broken"):
            sinks.append(spark, broken, "default.sink_test", ["default"])
        assert spark.table("sink_test").count() == 3
    finally:
        spark.sql("DROP TABLE sink_test")


def test_series(spark):
    table = spark.createDataFrame(
        [
            ("GDP", date(1994, 12, 31), 1.0), ("GDP", date(1995, 1, 1), 2.0), ("GDP", date(2000, 1, 1), None),
            ("GDP", date(2001, 1, 1), float("nan")), ("GNP", date(2002, 1, 1), 3.0), ("XYZ", date(2002, 1, 1), 4.0),
        ],
        "series_id string, date date, value double",
    )
    assert rows(series.read_series(table)) == [("GDP", date(1995, 1, 1), 2.0), ("GNP", date(2002, 1, 1), 3.0)]
    some = series.read_series(table, ["GDP"], date(1990, 1, 1), date(1994, 12, 31))
    assert rows(some) == [("GDP", date(1994, 12, 31), 1.0)]


def test_jdbc_reads_are_sliced(spark):
    with pytest.raises(ValueError, match="slices"):
        jdbc.JdbcSource("jdbc:x://h/db").load(spark, table="t")


def test_text_filters_find_every_spelling(spark):
    texts = ["building", "BUILDING", "BuildinG", "buildingx", "Building ", "bank", "BANK", "ban\u212a", "éa", "ÉA", None, "", "_x", "_X"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for values in (["Building"], ["bank", "building"], ["éa", "bank"], ["_x"], [], [""]):
        wanted = [t for t in texts if t is not None and t.lower() in [v.lower() for v in values]]
        assert sorted(r["t"] for r in df.where(text_in(F.col("t"), values)).collect()) == sorted(wanted), values
        others = [t for t in texts if t is not None and t.lower() not in [v.lower() for v in values]]
        if values:
            assert sorted(r["t"] for r in df.where(text_not_in(F.col("t"), values)).collect()) == sorted(others)


def test_jdbc_options():
    source = jdbc.JdbcSource("jdbc:x://h/db", {"user": "u"})
    slices = jdbc.JdbcSlices("rdate", "2020-01-01", "2021-01-01", 12)
    assert source.options(query="SELECT 1", slices=slices) == {
        "url": "jdbc:x://h/db", "dbtable": "(SELECT 1) AS q", "fetchsize": "10000", "partitionColumn": "rdate",
        "lowerBound": "2020-01-01", "upperBound": "2021-01-01", "numPartitions": "12", "user": "u",
    }
    assert "properties" not in repr(source)
    with pytest.raises(ValueError):
        source.options()
    with pytest.raises(ValueError):
        source.options("t", "SELECT 1")


def test_scratch_stays_below_the_shared_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    first, second = files.scratch_path(spark, "x"), files.scratch_path(spark, "x")
    assert first.startswith(base) and first != second


def test_period_filters_reach_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    for wanted in (in_year(F.col("o_orderdate"), 1997), in_month(F.col("o_orderdate"), 1998, 12)):
        plan = orders.where(wanted).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan
        assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan
