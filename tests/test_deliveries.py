"""Published batches, audit states, stored findings and quarantined lines."""

import random
from dataclasses import replace
from datetime import date, timedelta

import pytest
from helpers import frame, rows
from pyspark.sql import functions as F

from chronaudit import Calendar, TableSpec, bad_dates, date_verdict, issues_on_date, run_checks
from chronaudit.functions.dates import TEXT_DATE_FORMATS
from chronaudit.model import ISSUE_SCHEMA, NO_DATA, NO_ID, SIZE_JUMP
from chronaudit.plans.findings import store_issues, stored_issues
from chronaudit.plans.state import AuditState, audit_state, merged, state_issues
from chronaudit.sources import files, sinks
from chronaudit.sources.publish import BatchTable


def batch(spark, *values):
    return frame(spark, "a string, b double", list(values))


@pytest.fixture
def target(spark, tmp_path):
    return BatchTable(spark, str(tmp_path / "t"), "a string, b double, c int")


def test_batches_are_published_once(spark, target):
    assert target.read().collect() == [] and target.read().columns == ["a", "b", "c"]
    new = batch(spark, ("x", float("nan")), (None, 1.5))
    assert target.append(new, "one") == 2
    assert target.append(new, "one") == 0  # a retry adds nothing
    assert target.append(new.limit(1), "one") == 0
    assert target.append(new.select("b", "a"), "two") == 2
    assert rows(target.read()) == [(None, 1.5, None), (None, 1.5, None), ("x", None, None), ("x", None, None)]
    assert rows(target.batches().select("batch", "n_rows")) == [("one", 2), ("two", 2)]


def test_failures_leave_the_table_as_it_was(spark, target, monkeypatch):
    good = batch(spark, ("x", 1.0), ("y", 2.0))
    target.append(good, "one")
    before = rows(target.read())
    failures = [
        (good.where("false"), {}, "nothing"),
        (good.withColumn("z", F.lit(1)), {}, "no column z"),
        (good, {"small": F.col("b") < 2}, "small 1"),
        (good, {"known": F.col("c") > 0}, "known 2"),
        (good.withColumn("c", F.when(F.col("a") == "y", F.raise_error(F.lit("broken")).cast("int"))), {}, "broken"),
    ]
    for df, checks, said in failures:
        with pytest.raises(Exception, match=said):
            target.append(df, "next", checks)
        assert rows(target.read()) == before
    with pytest.raises(ValueError, match="named"):
        target.append(good, "../other")
    # the driver stops between the staged files and the manifest
    with monkeypatch.context() as m:
        m.setattr(BatchTable, "_publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            target.append(good, "next")
    assert rows(target.read()) == before
    assert target.append(good, "next", {"small": F.col("b") < 3}) == 2  # and a retry completes it
    assert target.read().count() == 4


def test_the_faster_attempt_counts(spark, target, monkeypatch):
    """Another attempt publishes while this one is being staged."""
    staged = BatchTable._staged

    def slow(self, df, attempt, checks):
        monkeypatch.setattr(BatchTable, "_staged", staged)
        assert BatchTable(spark, self.path, self.schema).append(batch(spark, ("first", 1.0)), "one") == 1
        return staged(self, df, attempt, checks)

    monkeypatch.setattr(BatchTable, "_staged", slow)
    assert target.append(batch(spark, ("second", 2.0)), "one") == 0
    assert rows(target.read().select("a")) == [("first",)]


def test_append_by_batch_replaces_its_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql(f"CREATE TABLE by_batch (a STRING, b DOUBLE, batch STRING) USING parquet PARTITIONED BY (batch) LOCATION '{path}'")
    spark.sql(f"CREATE TABLE no_batch (a STRING, b DOUBLE) USING parquet LOCATION '{tmp_path / 'n'}'")
    try:
        for name, df in (("one", batch(spark, ("x", 1.0))), ("two", batch(spark, ("y", 2.0))), ("one", batch(spark, ("x", 1.0)))):
            sinks.append(spark, df, "default.by_batch", ["default"], batch=name)
        assert rows(spark.table("by_batch")) == [("x", 1.0, "one"), ("y", 2.0, "two")]
        with pytest.raises(ValueError, match="nothing"):
            sinks.append(spark, batch(spark), "default.by_batch", ["default"], batch="one")
        assert spark.table("by_batch").count() == 2
        with pytest.raises(ValueError, match="partitioned"):
            sinks.append(spark, batch(spark, ("x", 1.0)), "default.no_batch", ["default"], batch="one")
    finally:
        spark.sql("DROP TABLE by_batch")
        spark.sql("DROP TABLE no_batch")


# Audit states


def random_table(seed, n):
    rng = random.Random(seed)
    start = date(2020, 11, 1)
    out = []
    for i in range(n):
        group = "hot" if i % 3 == 0 else rng.choice(["a", "b", None])
        day = start + timedelta(days=int(rng.random() ** 2 * 200)) if rng.random() > 0.02 else None
        out.append((group, day, f"id{i}" if rng.random() > 0.03 else None))
    return out


@pytest.mark.parametrize("frequency", ["daily", "monthly"])
def test_states_of_deliveries_give_the_audit_of_all_rows(spark, tmp_path, frequency):
    values = random_table(1, 1500) + [("late", date(2020, 11, 2), "x"), ("early", date(2021, 6, 1), "x")]
    whole = TableSpec(
        "t", frame(spark, "g string, d date, i string", values), "d", "g", "i", frequency, checks=(NO_DATA, NO_ID, SIZE_JUMP), growth_threshold=0.3)
    calendar, as_of = Calendar(spark, date(2020, 12, 10), date(2021, 4, 20)), date(2021, 4, 1)
    want = rows(run_checks([whole], calendar, as_of))
    state = AuditState(spark, str(tmp_path / "state"))
    parts, added = [values[i::4] for i in range(4)], set()
    for at in (3, 1, 3, 0, 2, 1):  # out of order, some repeated
        new = replace(whole, df=frame(spark, "g string, d date, i string", parts[at]))
        assert state.add(new, f"part-{at}") == (at not in added)
        added.add(at)
    how = {"checks": whole.checks, "frequency": frequency, "growth_threshold": 0.3}
    assert rows(state.issues("t", calendar, as_of, **how)) == want
    assert {r[1] for r in want} == {NO_DATA, NO_ID, SIZE_JUMP}
    for one in whole.checks:
        found = state.issues("t", calendar, as_of, **(how | {"checks": [one]}))
        assert rows(found) == [r for r in want if r[1] == one]
    with pytest.raises(ValueError, match="answers"):
        state.issues("t", calendar, as_of, checks=["is_daily"])


def test_states_hold_counts(spark):
    values = [("a", "2021-01-01", "x"), ("a", "2021-01-01", None), ("a", "2020-12-31", None), (None, "2021-01-01", "x"), ("b", None, "x")]
    spec = TableSpec("t", frame(spark, "g string, d date, i string", values), "d", "g", "i")
    both = audit_state(spec).unionByName(audit_state(spec))
    assert rows(merged(both).select("group_value", "year", "n_rows", "n_null_ids", "seen_0")) == [("a", 2020, 2, 2, 0), ("a", 2021, 4, 2, 1)]
    nothing = state_issues(both.limit(0), "t", Calendar.for_year(spark, 2021), date(2021, 2, 1))
    assert nothing.collect() == [] and nothing.schema.names == ISSUE_SCHEMA.names


def test_a_delivery_is_read_alone(spark, tmp_path):
    """The audit's plan reads states, not the deliveries' rows."""
    rows_path = str(tmp_path / "rows")
    frame(spark, "g string, d date", [("a", "2021-01-04")]).write.parquet(rows_path)
    state = AuditState(spark, str(tmp_path / "state"))
    state.add(TableSpec("t", spark.read.parquet(rows_path), "d", "g"), "one")
    found = state.issues("t", Calendar.for_year(spark, 2021), date(2021, 1, 9))
    assert rows_path not in found._jdf.queryExecution().executedPlan().toString()
    assert [r["rdate"].day for r in found.orderBy("rdate").collect()] == [1, 5, 6, 7]


# Stored findings


def finding(table, kind, day, group=None):
    return (table, kind, group, date.fromisoformat(day) if day else None, None, None)


def found_rows(spark, *values):
    return spark.createDataFrame(list(values), ISSUE_SCHEMA)


def test_one_month_is_replaced(spark, tmp_path):
    path, tables = str(tmp_path / "findings"), ["t", "u"]
    first = found_rows(
        spark, finding("t", "no_data", "2021-01-05"), finding("t", "no_data", "2021-02-05"), finding("u", "no_data", "2021-02-06"),
        finding("u", "no_adjprice", None))
    store_issues(first, path, tables, date(2021, 1, 1), date(2021, 3, 31))
    assert rows(stored_issues(spark, path).drop("month")) == rows(first)
    again = found_rows(spark, finding("t", "no_data", "2021-02-09"), finding("t", "no_data", "2021-02-09", "g"))
    store_issues(again, path, ["t"], date(2021, 2, 1), date(2021, 2, 28), files_per_month=3)
    want = [finding("t", "no_data", "2021-01-05"), finding("u", "no_data", "2021-02-06"), finding("u", "no_adjprice", None)]
    assert rows(stored_issues(spark, path).drop("month")) == rows(again.unionByName(found_rows(spark, *want)))
    store_issues(again.limit(0), path, ["t", "u"], date(2021, 2, 1), date(2021, 2, 28))  # the month has become clean
    assert rows(stored_issues(spark, path).drop("month")) == rows(found_rows(spark, finding("t", "no_data", "2021-01-05")))


@pytest.mark.parametrize("other", [finding("t", "no_data", "2021-04-01"), finding("v", "no_data", "2021-01-01"), finding(None, "no_data", None)])
def test_findings_that_are_not_covered_are_refused(spark, tmp_path, other):
    path = str(tmp_path / "findings")
    kept = found_rows(spark, finding("t", "no_data", "2021-01-05"))
    store_issues(kept, path, ["t"], date(2021, 1, 1), date(2021, 3, 31))
    with pytest.raises(Exception, match="not covered"):
        store_issues(found_rows(spark, other), path, ["t"], date(2021, 1, 1), date(2021, 3, 31))
    assert rows(stored_issues(spark, path).drop("month")) == rows(kept)


def test_a_date_reads_its_month(spark, tmp_path):
    path, tables = str(tmp_path / "findings"), ["t", "u", "v"]
    rng = random.Random(2)
    found = found_rows(spark, *[
        finding(rng.choice("tuv"), rng.choice(["no_data", "no_fsym_id", "is_monthly"]), str(date(2021, 1, 1) + timedelta(days=rng.randrange(300))), f"g{i}")
        for i in range(200)], finding("t", "no_adjprice", None))
    store_issues(found, path, tables, date(2021, 1, 1), date(2021, 12, 31))
    stored, day = stored_issues(spark, path), date(2021, 5, 14)
    assert rows(issues_on_date(stored, day)) == rows(issues_on_date(found, day))
    assert rows(date_verdict(stored, day, ["t", "v"])) == rows(date_verdict(found, day, ["t", "v"]))
    assert rows(bad_dates(stored, ["t"])) == rows(bad_dates(found, ["t"]))
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = date_verdict(stored, day, ["t", "v"])._jdf.queryExecution().executedPlan().toString()
    partitions = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "(month#" in partitions and "2021-05" in partitions and "table_name#" in partitions


# Quarantined lines


def lines(path, *texts):
    path.mkdir(exist_ok=True)
    for i, text in enumerate(texts):
        (path / f"f{i}.csv").write_text(text, encoding="utf-8")
    return str(path)


def test_every_line_is_typed_or_quarantined(spark, tmp_path):
    path = lines(
        tmp_path / "csv",
        "﻿,fsym_id,exdate,n,x\n0,A,1/1/2020 0:00,1,2.5\n1,B,2020-12-30,,N/A\n\n2,\"C, D\",20201230,3,1e3\n3,E,soon,4,5\n4,F,2020-01-01,many,much\n",
        "﻿,fsym_id,exdate,n,x\n5,G,2020-01-01,5\n6,H,2020-01-01,6,7,8\n7,,,,\n8,I,2020-01-01, 8 ,2.0\n9,J,2020-01-01,2.5,1\n",
    )
    found = files.read_csv_checked(spark, path, "fsym_id string, exdate date, n int, x double", date_cols=["exdate"], null_text="N/A")
    new_year = date(2020, 1, 1)
    assert rows(found.typed) == rows(spark.createDataFrame([
        ("A", new_year, 1, 2.5), ("B", date(2020, 12, 30), None, None), ("C, D", date(2020, 12, 30), 3, 1000.0), (None, None, None, None),
        ("I", new_year, 8, 2.0)], found.typed.schema))
    assert rows(found.quarantined.select("line", "reason")) == [
        ("3,E,soon,4,5", "exdate: not date: soon"),
        ("4,F,2020-01-01,many,much", "n: not int: many; x: not double: much"),
        ("5,G,2020-01-01,5", "not 5 cells"),
        ("6,H,2020-01-01,6,7,8", "not 5 cells"),
        ("9,J,2020-01-01,2.5,1", "n: not int: 2.5"),
    ]
    assert {r["file"].rsplit("/", 1)[1] for r in found.quarantined.collect()} == {"f0.csv", "f1.csv"}
    assert found.typed.count() + found.quarantined.count() == 10


def test_odd_csv(spark, tmp_path):
    texts = files.read_csv_checked(spark, lines(tmp_path / "t", "b,a,c\n1,x,2\n"), "a string, b string")
    assert rows(texts.typed) == [("x", "1")] and texts.quarantined.collect() == []
    only = files.read_csv_checked(spark, lines(tmp_path / "h", "a,b\n"), "a int")
    assert only.typed.collect() == [] and only.quarantined.collect() == []
    with pytest.raises(ValueError, match="no column z"):
        files.read_csv_checked(spark, lines(tmp_path / "z", "a,b\n1,2\n"), "z int")
    with pytest.raises(ValueError, match="no header"):
        files.read_csv_checked(spark, lines(tmp_path / "e", ""), "a int")


def test_a_line_is_parsed_once(spark, tmp_path):
    path = lines(tmp_path / "p", "n,d,x\n1,20200101,a\n2,soon,b\n3,2020-01-01,1.5\nmany,,\n")
    found = files.read_csv_checked(spark, path, "n int, d date, x double", date_cols=["d"])
    for df, count in zip(found, (1, 3)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_csv(") == 1  # a filter that is moved below the columns repeats them
        assert plan.count("gettimestamp(") == len(TEXT_DATE_FORMATS)
        assert plan.count("try_cast(") == 2
        assert df.count() == count
    assert rows(found.typed) == [(3, date(2020, 1, 1), 1.5)]
    assert rows(found.quarantined.select("line", "reason")) == [
        ("1,20200101,a", "x: not double: a"),
        ("2,soon,b", "d: not date: soon; x: not double: b"),
        ("many,,", "n: not int: many"),
    ]
