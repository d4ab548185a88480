"""Order-dependent checks, against rules written out row by row."""

import random
from datetime import date, timedelta

import pytest
from helpers import frame, rows
from pyspark.sql import functions as F

from chronaudit import irregular_gap_days, irregular_gaps, missing_flag_after_event
from chronaudit.operators.ordered import drop_latest, first_per_group, last_per_group, neighbours, numbered, with_neighbours

EVENTS = "fsym_id string, exdate date, seq int, div_type string, div_initiation boolean"


def flagged(spark, events):
    table = frame(spark, EVENTS, events)
    return rows(missing_flag_after_event(
        table, "fsym_id", "exdate", "div_type", "suspension", "div_initiation", ["seq"]
    ).select("seq"))


def history(*kinds, key="a"):
    """(type, flag) pairs as a key's rows, a quarter apart."""
    return [(key, date(2020, 1, 1) + timedelta(days=91 * i), i, t, f) for i, (t, f) in enumerate(kinds)]


S, R = "suspension", "regular"


@pytest.mark.parametrize(
    "kinds, found",
    [
        ([(R, False), (S, False), (R, True), (R, False)], []),
        ([(R, False), (S, False), (R, False), (R, False)], [1, 2]),
        ([(R, False), (S, False), (R, None), (R, False)], [1, 2]),
        # The latest row is not judged, nor what leads up to it.
        ([(R, False), (S, False), (R, False)], []),
        ([(R, False), (S, False)], []),
        ([(S, False)], []),
        # Two suspensions in a row: the second lacks the flag, as does its follower.
        ([(S, False), (S, False), (R, False), (R, False)], [0, 1, 2]),
        ([(S, False), (S, True), (R, False), (R, False)], [1, 2]),
        ([(S, False), (S, False), (R, True), (R, False)], [0, 1]),
    ],
)
def test_missing_flag(spark, kinds, found):
    assert flagged(spark, history(*kinds)) == [(i,) for i in found]


def test_tied_dates_follow_the_tie_breaker(spark):
    same = date(2020, 5, 1)
    events = [("a", same, 0, S, False), ("a", same, 1, R, False), ("a", same, 2, R, True)]
    assert flagged(spark, events) == [(0,), (1,)]


def test_keys_stay_apart(spark):
    events = history((R, False), (S, False), key="a") + history((R, False), (R, False), key="b")
    assert flagged(spark, events + [(None, date(2020, 1, 1), 9, S, False)]) == []


def random_events(seed, keys, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        # One key holds a third of the rows.
        key = "hot" if rng.random() < 0.34 else rng.choice(keys)
        d = date(2018, 1, 1) + timedelta(days=rng.randrange(900))
        out.append((key, d, i, rng.choice([S, R, R]), rng.choice([True, False, None])))
    return out


def brute_flags(events):
    found = []
    for key in {e[0] for e in events}:
        kept = sorted((e for e in events if e[0] == key), key=lambda e: (e[1], e[2]))[:-1]
        for before, after in zip(kept, kept[1:]):
            if before[3] == S and not after[4]:
                found += [before[2], after[2]]
    return sorted(set(found))


@pytest.mark.parametrize("seed", [1, 2])
def test_missing_flag_matches_brute_force(spark, seed):
    events = random_events(seed, list("abcdef"), 600)
    assert sorted(r[0] for r in flagged(spark, events)) == brute_flags(events)
    shuffled = events[:]
    random.Random(seed).shuffle(shuffled)
    assert flagged(spark, shuffled) == flagged(spark, events)


@pytest.fixture
def conf(spark):
    """Settings for one test."""
    kept = {}

    def put(name, value):
        kept.setdefault(name, spark.conf.get(name, None))
        spark.conf.set(name, value)

    yield put
    for name, value in kept.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def near_rows(spark, events):
    near = with_neighbours(frame(spark, EVENTS, events), "fsym_id", "exdate", "seq", carry="div_type")
    return {
        r["seq"]: (r["previous"] and r["previous"]["seq"], r["next"] and r["next"]["seq"], r["latest"]["seq"])
        for r in near.collect()
    }


@pytest.mark.parametrize("ranges, batch", [(1, 10_000), (3, 7), (8, 1), (64, 2), (200, 10_000)])
def test_neighbours_match_a_plain_order(spark, conf, ranges, batch):
    """Also where ranges and batches end within keys, between them, and after every row."""
    conf("spark.sql.shuffle.partitions", ranges)
    conf("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    events = random_events(3, list("ab"), 300) + [("a", None, 900, R, None), ("a", None, 901, R, None)]
    events += [(f"key{i}", date(2020, 1, 1), 1000 + i, R, None) for i in range(60)]
    want = {}
    for key in {e[0] for e in events}:
        own = sorted((e for e in events if e[0] == key), key=lambda e: (e[1] or date.min, e[2]))
        seqs = [e[2] for e in own]
        for i, s in enumerate(seqs):
            want[s] = (seqs[i - 1] if i else None, seqs[i + 1] if i + 1 < len(seqs) else None, seqs[-1])
    assert near_rows(spark, events + [(None, date(2020, 1, 1), 5000, R, None)]) == want
    assert near_rows(spark, []) == {}


def test_neighbours_within_one_hot_day(spark, conf):
    """A key with all rows on one day is spread over many ranges, whose sizes are alike."""
    conf("spark.sql.shuffle.partitions", 20)
    day_rows = [("hot", date(2020, 1, 1), i, R, None) for i in range(4000)]
    found = near_rows(spark, day_rows)
    assert found == {i: (i - 1 if i else None, i + 1 if i < 3999 else None, 3999) for i in range(4000)}
    table = frame(spark, EVENTS, day_rows)
    sizes = neighbours(table, "fsym_id", ["exdate", "seq"]).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 15 and max(r["count"] for r in sizes) < 600


def test_rows_are_shuffled_once(spark):
    """One exchange of whole rows, which the ends of ranges are read from as well; no window over keys."""
    table = frame(spark, EVENTS, random_events(3, list("ab"), 300))
    found = missing_flag_after_event(table, "fsym_id", "exdate", "div_type", "suspension", "div_initiation", ["seq"])
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("rangepartitioning") == 2 and "ReusedExchange" in plan  # once, and where it is named again
    assert "hashpartitioning" not in plan and "Window" in plan


def test_two_runs_of_the_shuffle_do_not_pass_unseen(spark, conf):
    """Without reuse the ends may come from other ranges than the rows; that is right or an error, never wrong."""
    conf("spark.sql.exchange.reuse", "false")
    conf("spark.sql.shuffle.partitions", 8)
    wanted = {i: (i - 1 if i else None, i + 1 if i < 29_999 else None, 29_999) for i in range(30_000)}
    try:
        found = near_rows(spark, [("hot", date(2020, 1, 1), i, R, None) for i in range(30_000)])
    except Exception as error:
        assert "spark.sql.exchange.reuse" in str(error)
    else:
        assert found == wanted


def test_keys_of_several_columns_and_kinds(spark, conf):
    conf("spark.sql.shuffle.partitions", 5)
    schema = "a string, b double, c array<int>, d int"
    events = [("x", float("nan"), [1], 3), ("x", float("nan"), [1], 1), ("x", 1.0, [1], 2), ("x", 1.0, [2], 4), ("y", 1.0, [2], 5),
              ("x", float("nan"), [1], 7), ("x", None, [1], 8)]
    near = with_neighbours(spark.createDataFrame(events, schema), ["a", "b", "c"], "d")
    got = {r["d"]: (r["previous"] and r["previous"]["d"], r["next"] and r["next"]["d"], r["latest"]["d"]) for r in near.collect()}
    assert got == {1: (None, 3, 7), 3: (1, 7, 7), 7: (3, None, 7), 2: (None, None, 2), 4: (None, None, 4), 5: (None, None, 5)}


@pytest.mark.parametrize("ranges, batch", [(1, 10_000), (3, 7), (8, 1), (40, 2)])
def test_numbers_within_keys(spark, conf, ranges, batch):
    conf("spark.sql.shuffle.partitions", ranges)
    conf("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    values = [("hot" if i % 3 else None, i % 5 if i % 7 else None, i) for i in range(300)] + [(f"k{i}", 1, 1000 + i) for i in range(40)]
    table = spark.createDataFrame(values, "a string, b int, i int")
    want = []
    for key in {v[:2] for v in values}:
        want += [(*key, i, n) for n, (_, _, i) in enumerate(sorted((v for v in values if v[:2] == key), key=lambda v: v[2]), 1)]
    assert rows(numbered(table, ["a", "b"], ["i"], "no")) == rows_of(want)
    assert numbered(table.limit(0), ["a", "b"], ["i"], "no").collect() == []


def test_a_hot_key_is_numbered_in_many_tasks(spark, conf):
    conf("spark.sql.shuffle.partitions", 20)
    table = spark.range(6000).selectExpr("if(id % 3 = 0, 0, id) as k", "id")
    sizes = numbered(table, "k", "id", "no").where("k = 0").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 6 and max(r["count"] for r in sizes) < 700


CLASHES = ["previous", "next", "latest", "row", "key", "near", "range", "diff_days", "gap_bad", "_n", "_day", "weekday", "n", "day", "group",
           "first", "is_first", "rdate", "n_rows", "_row", "a.b"]


def test_columns_may_have_any_names(spark):
    """Extra columns named like the operators' own change nothing and come back as they were."""
    events = random_events(1, list("abc"), 200)
    plain = frame(spark, EVENTS, events)
    wide = plain.withColumns({c: F.lit(f"<{c}>") for c in CLASHES})
    args = "fsym_id", "exdate", "div_type", "suspension", "div_initiation", ["seq"]
    found = missing_flag_after_event(wide, *args)
    assert found.columns == wide.columns
    assert rows(found.select(plain.columns)) == rows(missing_flag_after_event(plain, *args))
    assert {r["a.b"] for r in found.collect()} == {"<a.b>"}

    near = with_neighbours(wide, "fsym_id", "exdate", "seq")
    assert near.columns == [*wide.columns, "previous_", "next_", "latest_"]
    gaps = irregular_gaps(wide, "fsym_id", "exdate", order_by=["seq"])
    assert gaps.columns == [*wide.columns, "weekday_", "diff_days_"]
    wanted = irregular_gaps(plain, "fsym_id", "exdate", order_by=["seq"])
    assert rows(gaps.select(*plain.columns, "weekday_", "diff_days_")) == rows(wanted)
    assert rows(drop_latest(wide, "fsym_id", ["exdate", "seq"]).select(plain.columns)) == rows(drop_latest(plain, "fsym_id", ["exdate", "seq"]))
    assert rows(last_per_group(wide, "fsym_id", ["exdate", "seq"]).select(plain.columns)) == rows(last_per_group(plain, "fsym_id", ["exdate", "seq"]))


def test_first_last_and_drop_latest(spark):
    events = random_events(4, list("abc"), 200)
    table = frame(spark, EVENTS, events)
    order = ["exdate", "seq"]
    by_key = {}
    for e in sorted(events, key=lambda e: (e[1], e[2])):
        by_key.setdefault(e[0], []).append(e)
    assert rows(first_per_group(table, "fsym_id", order)) == sorted(v[0] for v in by_key.values())
    assert rows(last_per_group(table, "fsym_id", order)) == sorted(v[-1] for v in by_key.values())
    kept = drop_latest(table, "fsym_id", order).select("seq").collect()
    assert sorted(r[0] for r in kept) == sorted(e[2] for v in by_key.values() for e in v[:-1])


# Gaps between dates


def off_days(spark, *days):
    return frame(spark, "holiday_date date", [(d,) for d in days])


def unexplained(gap, d, off):
    if gap == 1 or (d.weekday() == 0 and gap == 3):
        return False
    if d - timedelta(days=1) in off:
        return False
    return not (d.weekday() == 0 and gap == 4 and d - timedelta(days=3) in off)


@pytest.mark.parametrize(
    "before, after, off, bad",
    [
        ("2021-06-01", "2021-06-02", [], False),            # gap 1
        ("2021-06-04", "2021-06-07", [], False),            # Friday to Monday
        ("2021-06-01", "2021-06-03", [], True),             # gap 2, no holiday
        ("2021-06-01", "2021-06-03", ["2021-06-02"], False),
        ("2021-06-04", "2021-06-08", ["2021-06-07"], False),  # Tuesday after a Monday off
        ("2021-06-01", "2021-06-09", ["2021-06-08"], False),  # any gap, yesterday off
        ("2021-06-03", "2021-06-07", ["2021-06-04"], False),  # Monday after a Friday off
        ("2021-06-03", "2021-06-07", [], True),             # Monday, gap 4, Friday was open
        ("2021-06-03", "2021-06-07", ["2021-06-03"], True),
        ("2021-06-05", "2021-06-08", [], True),             # gap 3 but a Tuesday
        ("2021-06-01", "2021-06-01", [], True),             # same day twice
        ("2021-06-08", "2021-06-08", ["2021-06-07"], False),  # twice, yesterday off
    ],
)
def test_gap_rule(spark, before, after, off, bad):
    table = frame(spark, "bm_id string, rdate date, n int", [("a", before, 1), ("a", after, 2)])
    found = irregular_gaps(table, "bm_id", "rdate", off_days(spark, *off), ["n"])
    assert [r["n"] for r in found.collect()] == ([2] if bad else [])


def test_repeats_without_an_order(spark):
    """Of rows that share a day one carries the gap, the others gap 0, also where they are equal."""
    table = frame(spark, "bm_id string, rdate date, n int", [
        ("a", "2021-06-01", 1), ("a", "2021-06-04", 7), ("a", "2021-06-04", 5), ("a", "2021-06-04", 5),
    ])
    assert rows(irregular_gaps(table, "bm_id", "rdate")) == rows_of([
        ("a", date(2021, 6, 4), 5, 4, 3), ("a", date(2021, 6, 4), 5, 4, 0), ("a", date(2021, 6, 4), 7, 4, 0),
    ])
    assert rows(irregular_gaps(table, "bm_id", "rdate", order_by=["n"])) == rows(irregular_gaps(table, "bm_id", "rdate"))


def test_only_one_of_tied_rows_is_the_latest(spark):
    schema = "k string, exdate date, kind string, flag boolean"
    table = frame(spark, schema, [
        ("a", "2021-01-01", "suspension", None), ("a", "2021-02-01", "regular", False), ("a", "2021-02-01", "special", False),
    ])
    found = missing_flag_after_event(table, "k", "exdate", "kind", "suspension", "flag")
    assert sorted(r["kind"] for r in found.collect()) == ["regular", "suspension"]


def test_first_row_option(spark):
    table = frame(spark, "bm_id string, rdate date", [("a", "2021-06-02"), ("b", "2021-06-02")])
    assert irregular_gaps(table, "bm_id", "rdate").count() == 0
    assert irregular_gaps(table, "bm_id", "rdate", first_gap=0).count() == 2


def test_gaps_match_brute_force(spark):
    rng = random.Random(5)
    off = {date(2021, 1, 1) + timedelta(days=rng.randrange(200)) for _ in range(25)}
    table = []
    for i in range(500):
        key = "hot" if i % 3 == 0 else rng.choice("abcd")
        table.append((key, date(2021, 1, 1) + timedelta(days=rng.randrange(200)), i))
    want, per_day = [], {}
    for key in {t[0] for t in table}:
        own = sorted((t for t in table if t[0] == key), key=lambda t: (t[1], t[2]))
        for before, (k, d, n) in zip([None, *own], own):
            gap = 1 if before is None else (d - before[1]).days
            if unexplained(gap, d, off):
                want.append((k, d, n, d.weekday(), gap))
                per_day[k, d, d.weekday(), gap] = per_day.get((k, d, d.weekday(), gap), 0) + 1
    df = frame(spark, "bm_id string, rdate date, n int", table)
    assert rows(irregular_gaps(df, "bm_id", "rdate", off_days(spark, *off), ["n"])) == rows_of(want)
    days = irregular_gap_days(df, "bm_id", "rdate", off_days(spark, *off))
    assert rows(days) == rows_of([(*k, v) for k, v in per_day.items()])


def rows_of(values):
    return sorted(values, key=lambda r: tuple((v is not None, str(v)) for v in r))
