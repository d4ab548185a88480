from datetime import date

import pytest
from helpers import frame, rows
from pyspark.sql import functions as F

from chronaudit import (
    TableSpec,
    group_change_abs,
    group_growth,
    null_rows,
    orphan_ids,
    orphan_rows,
    row_mismatch,
    unmatched_events,
)
from chronaudit.operators import prefilter
from chronaudit.operators.integrity import difference, intersection
from chronaudit.operators.prefilter import key_words, may_be_in


@pytest.fixture(params=["large", "small"], autouse=True)
def sizes(request, monkeypatch):
    """Every test of this module runs with the plans for large tables and with those for small ones."""
    monkeypatch.setattr(prefilter, "SMALL_BYTES", 0 if request.param == "large" else 1 << 62)
    return request.param


def ids(spark, *values):
    return frame(spark, "fsym_id string", [(v,) for v in values])


def test_orphan_ids_treat_null_as_a_value(spark):
    assert rows(orphan_ids(ids(spark, "a", "a", "b", None), ids(spark, "b", "c"), "fsym_id")) == [(None,), ("a",)]
    assert rows(orphan_ids(ids(spark, "a", None), ids(spark, "b", None, None), "fsym_id")) == [("a",)]
    assert rows(orphan_ids(ids(spark, "a"), ids(spark, "b", None), "fsym_id")) == [("a",)]
    assert rows(orphan_ids(ids(spark, None), ids(spark), "fsym_id")) == [(None,)]


def test_orphan_rows_keep_every_row(spark):
    table = frame(spark, "fsym_id string, n int", [("a", 1), ("a", 2), ("b", 3), (None, 4)])
    assert rows(orphan_rows(table, ids(spark, "b"), "fsym_id")) == [(None, 4), ("a", 1), ("a", 2)]
    assert rows(orphan_rows(table, ids(spark, "b", None), "fsym_id")) == [("a", 1), ("a", 2)]


def test_set_operations_match_spark(spark):
    a = frame(spark, "x int, y string", [(1, "a"), (1, "a"), (2, None), (3, "c"), (None, None)])
    b = frame(spark, "x int, y string", [(1, "a"), (2, None), (2, None), (4, "d")])
    assert rows(difference(a, b)) == rows(a.subtract(b))
    assert rows(intersection(a, b)) == rows(a.intersect(b))
    assert rows(difference(b, a)) == rows(b.subtract(a))


def test_unmatched_events_never_match_null(spark):
    left = frame(spark, "k string, d date", [("a", "2021-01-01"), ("a", "2021-01-02"), (None, "2021-01-01")])
    right = frame(spark, "k string, d date", [("a", "2021-01-01"), ("a", "2021-01-01"), (None, "2021-01-01")])
    assert rows(unmatched_events(left, right, ["k", "d"])) == [(None, date(2021, 1, 1)), ("a", date(2021, 1, 2))]


def test_no_partner_is_lost_or_invented(spark):
    """Many keys, also more than the filter has room for, against plain anti-joins."""
    left = spark.range(30_000).selectExpr("if(id % 3 = 0, 77, id) as k", "if(id % 50 = 0, null, cast(id % 9 as string)) as g", "id as n")
    right = spark.range(0, 60_000, 7).selectExpr("id as k", "cast(id % 9 as string) as g")
    want = left.join(right.distinct(), ["k", "g"], "left_anti").select("k", "g", "n")
    assert rows(unmatched_events(left, right, ["k", "g"])) == rows(want)
    assert rows(orphan_rows(left, right, "k")) == rows(left.join(right.select("k").distinct(), "k", "left_anti"))


def test_filter_keeps_all_keys_and_drops_most_others(spark):
    keys = spark.range(2000).selectExpr("id * 3 as k", "if(id = 5, null, cast(id as string)) as s")
    for words, most in ((1 << 16, 30), (64, 4000), (1, 4000)):
        seen = may_be_in(keys, [F.col("k"), F.col("s")], words)
        assert keys.where(seen).count() == 2000
        others = spark.range(4000).selectExpr("id * 3 + 1 as k", "cast(id as string) as s")
        assert others.where(seen).count() <= most
    assert spark.range(10).where(may_be_in(spark.range(0), [F.col("id")])).count() == 0


def test_filters_of_parts_merge(spark):
    keys = spark.range(5000)
    parts = key_words(keys.where("id % 2 = 0")).unionByName(key_words(keys.where("id % 2 = 1")))
    merged = parts.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    assert rows(merged) == rows(key_words(keys))


def test_filter_lies_under_the_shuffle(spark, tmp_path, sizes):
    """Rows meet the filter while they are scanned, and only then are dealt out."""
    if sizes == "small":
        pytest.skip("small tables are joined at once")
    for name, df in (("a", spark.range(5000).selectExpr("id as k", "id as n")), ("b", spark.range(4990).selectExpr("id as k"))):
        df.write.parquet(str(tmp_path / name))
    a, b = spark.read.parquet(str(tmp_path / "a")), spark.read.parquet(str(tmp_path / "b"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for found in (orphan_rows(a, b, "k"), unmatched_events(a, b, ["k"])):
            assert sorted(r["n"] for r in found.collect()) == list(range(4990, 5000))
            lines = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
            filtered = next(i for i, x in enumerate(lines) if "Filter" in x and "subquery" in x.lower())
            assert any("Exchange hashpartitioning" in x for x in lines[:filtered])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_types_of_keys_may_differ(spark):
    left = frame(spark, "k int, n int", [(1, 1), (2, 2), (None, 3)])
    right = frame(spark, "k bigint", [(1,), (None,)])
    assert rows(orphan_rows(left, right, "k")) == [(2, 2)]
    assert rows(unmatched_events(left, right, ["k"])) == [(None, 3), (2, 2)]


def test_orphans_of_columns_with_any_names(spark):
    table = frame(spark, "fsym_id string, n int", [("a", 1), ("b", 3), (None, 4)])
    wide = table.withColumns({c: F.lit(c) for c in ("_k0", "_k0_", "_row", "_known0", "word", "bits", "mask")})
    found = orphan_rows(wide, ids(spark, "b"), "fsym_id")
    assert found.columns == wide.columns and rows(found.select("fsym_id", "n")) == [(None, 4), ("a", 1)]
    assert unmatched_events(wide, ids(spark, "b"), ["fsym_id"]).columns == wide.columns


def test_null_rows(spark):
    table = frame(spark, "a string, b int", [("x", 1), (None, 2), (None, None)])
    assert rows(null_rows(table, "a")) == [(None, None), (None, 2)]


def test_row_mismatch(spark):
    schema = "k int, a string, b double"
    old = frame(spark, schema, [(1, "x", 1.0), (2, "x", 1.0), (3, None, 1.0), (4, "x", 1.0)])
    new = frame(spark, schema, [(1, "x", 1.0), (2, "y", 1.0), (3, None, 1.0), (4, "x", 2.0), (5, "n", 0.0)])
    assert [r[0] for r in rows(row_mismatch(old, new, "k"))] == [2, 3, 4, 5]
    assert [r[0] for r in rows(row_mismatch(old, new, "k", null_equal=True))] == [2, 4, 5]
    assert [r[0] for r in rows(row_mismatch(old, new, ["k"], ["b"]))] == [4, 5]


def test_row_mismatch_with_null_and_repeated_keys(spark):
    old = frame(spark, "k int, a string", [(None, "n"), (1, "x"), (1, "y"), (2, "z")])
    new = frame(spark, "k int, a string", [(None, "n"), (None, "m"), (1, "y"), (1, "w"), (2, "z"), (2, "z")])
    assert rows(row_mismatch(old, new, "k")) == [(None, "m"), (1, "w")]


def both_tables(spark, n):
    """Two tables of n rows that differ here and there, with nulls, repeated keys and rows on one side only."""
    a = spark.range(n).selectExpr("if(id % 10 < 3, 7, id) as k", "if(id % 11 = 0, null, cast(id % 5 as string)) as s", "id % 3 as v")
    b = spark.range(n + 5).selectExpr(
        "if(id % 10 < 3, 7, id) as k", "if(id % 11 = 0, null, cast(id % 5 as string)) as s", "if(id % 997 = 1, -1, id % 3) as v")
    return a, b


@pytest.mark.parametrize("null_equal", [True, False])
def test_row_mismatch_by_digests_is_the_join(spark, null_equal):
    a, b = both_tables(spark, 20_000)
    found = rows(row_mismatch(a, b, "k", null_equal=null_equal))
    if null_equal:
        kept = {tuple(r) for r in a.collect()}
        want = [tuple(r) for r in b.collect() if tuple(r) not in kept]
    else:
        kept = {tuple(r) for r in a.collect() if None not in r[1:]}
        want = [tuple(r) for r in b.collect() if tuple(r) not in kept]
    assert found == sorted(want, key=lambda r: tuple((v is not None, str(v)) for v in r)) and found


def test_swapped_nulls_and_doubled_rows_differ(spark):
    schema = "k int, a string, b string"
    old = frame(spark, schema, [(1, None, "x"), (2, "y", "y")])
    new = frame(spark, schema, [(1, "x", None), (2, "y", "y"), (2, "y", "y")])
    assert rows(row_mismatch(old, new, "k", null_equal=True)) == [(1, "x", None)]


def test_equal_tables_move_digests_only(spark, tmp_path, sizes):
    if sizes == "small":
        pytest.skip("small tables are joined at once")
    a, _ = both_tables(spark, 20_000)
    for name in "ab":
        a.repartition(4).write.parquet(str(tmp_path / name))
    a, b = spark.read.parquet(str(tmp_path / "a")), spark.read.parquet(str(tmp_path / "b"))
    found = row_mismatch(a, b, "k", null_equal=True)
    assert found.collect() == []
    plan = found._jdf.queryExecution().executedPlan()
    assert shuffled(plan) <= 2 * 4 * 256 + 2 * 256  # a row for each coarse bucket and task, and their comparison
    changed = b.withColumn("v", F.when((F.col("k") == 13) & F.col("v").isNotNull(), -5).otherwise(F.col("v")))
    found = row_mismatch(a, changed, "k", null_equal=True)
    assert {r["k"] for r in found.collect()} == {13}


def shuffled(plan):
    """Rows written to shuffles that were run, as the plan's own counters say."""
    seen, total, todo = set(), 0, [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        if name == "Exchange" and node.id() not in seen:
            seen.add(node.id())
            total += node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_mismatch_of_columns_with_any_names_and_kinds(spark):
    old = frame(spark, "k int, a string, bucket int, side int, n int", [(1, "x", 1, 1, 1), (2, "x", 2, 2, 2)])
    new = old.withColumns({"_row": F.lit("r"), "apart": F.lit(True)}).withColumn("n", F.when(F.col("k") == 2, 9).otherwise(F.col("n")))
    found = row_mismatch(old, new, "k")
    assert found.columns == new.columns and [r["k"] for r in found.collect()] == [2]
    wide = old.withColumn("n", F.col("n").cast("bigint"))
    assert row_mismatch(old, wide, "k").count() == 0


def sized(spark, counts):
    rows_ = [(g, d, f"{g}{i}") for g, d, n in counts for i in range(n)]
    return TableSpec("snapshot", frame(spark, "univ_id string, rdate date, fsym_id string", rows_),
                     "rdate", "univ_id", "fsym_id", "monthly")


def test_group_growth(spark):
    spec = sized(spark, [
        ("under", "2021-01-31", 199), ("under", "2021-02-28", 200),  # 0.005
        ("at", "2021-01-31", 99), ("at", "2021-02-28", 100),         # exactly 0.01
        ("over", "2021-01-31", 98), ("over", "2021-02-28", 100),     # 0.02
        ("less", "2021-01-31", 100), ("less", "2021-02-28", 50),
        ("skip", "2021-01-31", 5), ("skip", "2021-04-30", 10),       # previous date present
        ("once", "2021-01-31", 40),
        (None, "2021-01-31", 1), (None, "2021-02-28", 9),
    ])
    assert rows(group_growth(spec)) == [
        ("over", date(2021, 2, 28), 100, 0.02), ("skip", date(2021, 4, 30), 10, 0.5),
    ]
    assert len(rows(group_growth(spec, threshold=0.001))) == 4


def test_group_change_abs(spark):
    spec = sized(spark, [
        ("a", "2021-01-31", 1), ("a", "2021-02-28", 301), ("a", "2021-03-31", 602), ("b", "2021-01-31", 900),
        ("b", "2021-02-28", 1),
    ])
    assert rows(group_change_abs(spec)) == [("a", date(2021, 3, 31), 602, 301)]
    assert len(rows(group_change_abs(spec, tolerance=299))) == 2
