"""The lookups against brute force, with ties, NULLs, a hot key and exact bounds."""

import calendar
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import temporal as T

T0 = datetime(2020, 1, 1)
LEFT = "lid long, k long, t timestamp_ntz"
RIGHT = "id long, k long, rt timestamp_ntz, kind string, amount long"


def moments(rng):
    """Few distinct moments, many on the hour, so ties and slice edges happen."""
    base = T0 + timedelta(hours=rng.randrange(0, 120))
    return base + timedelta(microseconds=rng.choice([0, 0, 1, -1, 30 * 60 * 10**6]))


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(7)
    key = lambda: rng.choice([1] * 6 + [2, 3, 4, None])
    left = [(i, key(), rng.choice([None] + [moments(rng)] * 9)) for i in range(150)]
    right = [
        (i, key(), rng.choice([None] + [moments(rng)] * 9), rng.choice("ab"), rng.choice([None, 1, 2]))
        for i in rng.sample(range(400), 250)
    ]
    return left, right, spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)


def brute(left, right, test):
    out = {}
    for lid, k, t in left:
        hits = [r for r in right if k is not None and t is not None and r[1] == k and r[2] is not None and test(r[2], t)]
        amounts = [r[4] for r in hits if r[4] is not None]
        out[lid] = (
            max((r[0] for r in hits), default=None),
            min((r[0] for r in hits if r[3] == "a"), default=None),
            max(((r[2], r[0]) for r in hits), default=(None, None))[1],
            sum(amounts) if amounts else None,
        )
    return out


def folds():
    return [
        T.pick_max("top", "id"),
        T.pick_min("low_a", "id", ["kind"], F.col("kind") == "a"),
        T.pick_max("latest", ["rt", "id"]),
        T.total("amount_sum", F.col("amount")),
    ]


def answers(df):
    rows = df.select("lid", "top.id", F.col("low_a.id").alias("a"), F.col("latest.id").alias("b"), "amount_sum").collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r)[1:] for r in rows}


@pytest.mark.parametrize("slice_rows", [None, 12])
@pytest.mark.parametrize("side,test", [
    ("before", lambda r, t: r < t), ("until", lambda r, t: r <= t),
    ("after", lambda r, t: r > t), ("from", lambda r, t: r >= t),
])
def test_lookup_equals_brute_force(data, side, test, slice_rows):
    left, right, ldf, rdf = data
    got = answers(T.lookup(ldf, rdf, "k", F.col("t"), F.col("rt"), folds(), side, slice_rows))
    assert got == brute(left, right, test)


def rows_of_largest_task(df):
    """Most rows that one partition of the last shuffle holds before the answers are cut out."""
    return max(r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())


@pytest.mark.parametrize("backwards", [False, True])
def test_one_key_of_random_ids_within_an_hour_is_spread(spark, backwards):
    """One key, random 63-bit ids as moments in one case, moments of one hour in the other."""
    n = 20_000
    ids = F.xxhash64("id").bitwiseAND(F.lit(2**63 - 1))
    hour = F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, 0, 0, pmod(xxhash64(id), 3600000000) / 1000000)")
    for moment in (ids, hour):
        rows = spark.range(n).select(F.lit(1).alias("k"), moment.alias("m"), F.col("id").alias("v"))
        left = rows.where("v % 3 = 0").select("k", "m", F.col("v").alias("lid"))
        got = T.lookup(left, rows, "k", F.col("m"), F.col("m"), [T.count_where("n")], "after" if backwards else "before", 500)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            held = got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"))
            assert held.agg(F.max("n")).first()[0] < n / 3 / 3
        finally:
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        places = {r["m"]: i for i, r in enumerate(sorted(rows.collect(), key=lambda r: r["m"]))}
        for r in got.collect():
            want = n - 1 - places[r["m"]] if backwards else places[r["m"]]
            assert (r["n"] or 0) == want


def test_keys_are_filtered_below_the_first_exchange(data, monkeypatch):
    """By their hashes where they are few, by the words of a Bloom filter where they are many."""
    left, right, ldf, rdf = data
    for few in (True, False):
        if not few:
            monkeypatch.setattr("cohortloom.operators.spread.FILTER_ROWS", 2)
        got = T.lookup(ldf, rdf, "k", F.col("t"), F.col("rt"), folds(), "until")
        plan = got._jdf.queryExecution().executedPlan().toString().splitlines()
        joins = [i for i, line in enumerate(plan) if "BroadcastHashJoin" in line and "__" in line]
        shuffles = [i for i, line in enumerate(plan) if "Exchange hashpartitioning(__k0" in line]
        assert joins and len(shuffles) == 1 and min(joins) > shuffles[0]
        assert answers(got) == brute(left, right, lambda r, t: r <= t)


def test_lookup_of_nothing(data):
    left, right, ldf, rdf = data
    none = T.lookup(ldf, rdf.limit(0), "k", F.col("t"), F.col("rt"), folds())
    assert none.count() == len(left) and none.where("top is not null or amount_sum is not null").count() == 0
    assert T.lookup(ldf.limit(0), rdf, "k", F.col("t"), F.col("rt"), folds()).count() == 0


def shifted(moment, text):
    """``moment`` plus an interval text; a day that the month lacks becomes its last."""
    months, micros = T._interval(text)
    year, month = divmod(moment.year * 12 + moment.month - 1 + months, 12)
    day = min(moment.day, calendar.monthrange(year, month + 1)[1])
    return moment.replace(year=year, month=month + 1, day=day) + timedelta(microseconds=micros)


@pytest.mark.parametrize("low,high", [
    ("-3 days", "30 minutes"), ("-2 hours", "0 minutes"), ("-1 hours", "90 minutes"), ("-30 minutes", "0 minutes"),
    ("0 days", "0 days"), ("-1 microsecond", "1 microsecond"), ("-1 month", "-27 days"), ("-1 week", "-2 days 12 hours")])
def test_lookup_between_equals_brute_force(data, low, high):
    left, right, ldf, rdf = data
    got = answers(T.lookup_between(ldf, rdf, "k", F.col("t"), low, high, F.col("rt"), folds()))
    assert got == brute(left, right, lambda r, t: shifted(t, low) <= r <= shifted(t, high))


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
@pytest.mark.parametrize("low,high", [("-18 months", "0 days"), ("-1 month", "1 month"), ("-2 years", "-1 month 3 days")])
def test_windows_of_months_equal_brute_force(spark, low, high, kind):
    """Month ends, leap days, and moments before 1970."""
    rng = random.Random(5)
    moment = lambda: datetime(1968, 1, 1) + timedelta(days=rng.randrange(1500), hours=rng.choice([0, 0, 7]))
    left = [(i, rng.choice([1, 1, 2]), moment()) for i in range(120)]
    right = [(i, rng.choice([1, 1, 2]), moment(), "ab"[i % 2], i % 5) for i in range(300)]
    ldf, rdf = (spark.createDataFrame(x, y).withColumn(c, F.col(c).cast(kind))
                for x, y, c in ((left, LEFT, "t"), (right, RIGHT, "rt")))
    got = answers(T.lookup_between(ldf, rdf, "k", F.col("t"), low, high, F.col("rt"), folds()))
    assert got == brute(left, right, lambda r, t: shifted(t, low) <= r <= shifted(t, high))


def test_window_that_may_end_before_it_begins_is_refused(data):
    for low, high in (("1 hours", "0 minutes"), ("-27 days", "-1 month")):
        with pytest.raises(ValueError):
            T.lookup_between(data[2], data[3], "k", F.col("t"), low, high, F.col("rt"), folds())


def test_lookup_over_ids_and_dates(spark):
    left = spark.createDataFrame([(1, 9, 5), (2, 9, 200000), (3, None, 5)], "lid long, k long, at long")
    right = spark.createDataFrame([(9, 5, 1), (9, 6, 2), (9, 199999, 4)], "k long, id long, v long")
    got = T.lookup(left, right, "k", F.col("at"), F.col("id"), [T.total("v_sum", F.col("v"))], "until")
    assert {r.lid: r.v_sum for r in got.collect()} == {1: 1, 2: 7, 3: None}


def test_date_meets_timestamp_at_midnight(spark):
    left = spark.createDataFrame([(1, 1, datetime(2020, 1, 5, 0, 0)), (2, 1, datetime(2020, 1, 5, 1, 0))], LEFT)
    right = spark.createDataFrame([(1, date(2020, 1, 5))], "k long, d date")
    got = T.lookup(left, right, "k", F.col("t"), F.col("d"), [T.count_where("n")], "before")
    assert {r.lid: r.n for r in got.collect()} == {1: None, 2: 1}


@pytest.mark.parametrize("slice_rows", [None, 10])
@pytest.mark.parametrize("spread", [1, 10**12, -(10**15)])
def test_count_above_until(spark, spread, slice_rows):
    """Dense, sparse and negative ids; one key holds three quarters of the rows."""
    rng = random.Random(3)
    rights = [(i * spread + 500 * abs(spread) * (spread < 0), rng.choice([1, 1, 1, 2]), date(2020, 1, 1) + timedelta(days=rng.randrange(60)), rng.random() < 0.5)
              for i in rng.sample(range(1000), 120)]
    lefts = [(n, k, i if rng.random() < 0.5 else i + 1, d) for n, (i, k, d, _) in enumerate(rights)]
    ldf = spark.createDataFrame(lefts, "lid long, k long, id long, d date")
    rdf = spark.createDataFrame(rights, "id long, k long, rd date, base boolean")
    got = T.count_above_until(
        ldf, rdf, "k", "id", {"ten": F.date_add("d", 10), "thirty": F.date_add("d", 30)}, "rd",
        [T.count_where("n"), T.count_where("b", F.col("base"))], "lid", slice_rows)
    rows = got.collect()
    assert sorted(r.lid for r in rows) == list(range(120))
    for r in rows:
        for name, days in (("ten", 10), ("thirty", 30)):
            hits = [x for x in rights if x[1] == r.k and x[0] > r.id and x[2] <= r.d + timedelta(days=days)]
            assert (r[f"n_{name}"] or 0) == len(hits)
            assert (r[f"b_{name}"] or 0) == sum(x[3] for x in hits)


def test_value_as_of(spark):
    t = datetime(2020, 1, 10)
    log = spark.createDataFrame([
        (5, 1, "customers", "email", t + timedelta(days=2), "second"),
        (3, 1, "customers", "email", t + timedelta(days=5), "lowest id wins"),
        (1, 1, "customers", "email", t, "not after"),
        (2, 1, "people", "email", t + timedelta(days=1), "other table"),
        (4, 1, "customers", "phone", t + timedelta(days=1), "other column"),
        (6, 2, "customers", "email", t + timedelta(days=1), None),
        (7, 2, "customers", "income", t + timedelta(days=1), "old income"),
    ], "id long, record_id long, table_name string, column_name string, change_time timestamp_ntz, old_value string")
    left = spark.createDataFrame([(1, t, "now1", "inc1"), (2, t, "now2", "inc2"), (3, t, "now3", "inc3")],
                                 "cid long, t timestamp_ntz, email string, income string")
    got = T.value_as_of(left, log, {"cid": "record_id"}, F.col("t"), ["email", "income"], "customers")
    got = got.withColumns({c: F.coalesce(f"{c}_before", c) for c in ("email", "income")})
    assert {r.cid: (r.email, r.income) for r in got.collect()} == {
        1: ("lowest id wins", "inc1"), 2: ("now2", "old income"), 3: ("now3", "inc3")}


def test_distinct_on_null_order(spark):
    df = spark.createDataFrame([(1, 5, None), (1, 5, 7), (1, 6, 1), (2, None, 3), (2, 4, None)],
                               "k long, a long, b long")
    got = T.distinct_on(df, ["k"], [*T.nulls_last(F.col("a")), *T.nulls_last(F.col("b"))])
    assert {tuple(r) for r in got.collect()} == {(1, 5, 7), (2, 4, None)}
    got = T.distinct_on(df, ["k"], [*T.negated_nulls_first(F.col("a")), *T.nulls_last(F.col("b"))])
    assert {tuple(r) for r in got.collect()} == {(1, 6, 1), (2, None, 3)}


def test_without_earlier_and_ties(spark):
    df = spark.createDataFrame([(1, 3), (1, 5), (2, 4), (None, 1)], "k long, id long")
    done = spark.createDataFrame([(1, 4), (1, 9), (2, 4), (None, 0)], "k long, id long")
    got = T.without_earlier(df, done, "k", "id")
    assert {tuple(r) for r in got.collect()} == {(1, 3), (2, 4), (None, 1)}
    flows = spark.createDataFrame([(1, 7, 2), (1, 7, 3), (1, 9, 50)], "k long, id long, v long")
    row = T.first_with_ties(flows, ["k"], "id", {"v": F.col("v")}).collect()
    assert [(r.k, r.id, r.n, r.v) for r in row] == [(1, 7, 2, 5)]


def test_first_event_within(spark):
    left = spark.createDataFrame([(1, date(2020, 1, 10)), (2, date(2020, 1, 10)), (3, date(2020, 1, 10))], "k long, d date")
    right = spark.createDataFrame([(1, date(2020, 1, 10)), (1, date(2020, 1, 20)), (2, date(2020, 2, 15))], "k long, e date")
    end = F.date_add("d", 35)
    got = T.first_event_within(left, right, {"k": "k"}, F.col("d"), "e", end, "nxt", side="after")
    assert {r.k: r.nxt and r.nxt.e for r in got.collect()} == {1: date(2020, 1, 20), 2: None, 3: None}


@pytest.mark.parametrize("slice_rows", [None, 3])
def test_count_above_until_odd_ranks(spark, slice_rows):
    far = 2**62
    rights = [(i, 1) for i in (-5, -3, -2, 4, far, -far, far)] + [(None, 1), (7, None), (1, 2)]
    lefts = [(n, k, i) for n, (i, k) in enumerate([*rights, (-far - 1, 1), (far + 1, 1), (0, 2), (1, 2), (5, 3)])]
    day = date(2020, 1, 1)
    ldf = spark.createDataFrame([(*x, day) for x in lefts], "lid long, k long, id long, d date")
    rdf = spark.createDataFrame([(*x, day) for x in rights], "id long, k long, rd date")
    got = T.count_above_until(ldf, rdf, "k", "id", {"now": F.col("d")}, "rd", [T.count_where("n")], "lid", slice_rows)
    for r in got.collect():
        hits = [x for x in rights if None not in (r.k, r.id, *x) and x[1] == r.k and x[0] > r.id]
        assert (r.n_now or 0) == len(hits), r


def test_sums_above_until_of_timestamps_and_text_keys(spark):
    rng = random.Random(9)
    rights = [(rng.choice("abc"), rng.randrange(30), moments(rng), rng.choice([None, 1, -5, 7])) for _ in range(200)]
    lefts = [(n, rng.choice(["a", "b", "z", None]), rng.choice([None, *range(30)]), rng.choice([None, moments(rng)])) for n in range(80)]
    ldf = spark.createDataFrame(lefts, "lid long, k string, r long, t timestamp_ntz")
    rdf = spark.createDataFrame(rights, "k string, r long, rt timestamp_ntz, v long")
    for slice_rows in (None, 15):
        got = T.count_above_until(ldf, rdf, "k", "r", {"x": F.col("t")}, "rt", [T.total("v_sum", F.col("v"))], "lid", slice_rows)
        rows = got.collect()
        assert len(rows) == len(lefts)
        for row in rows:
            hits = [v for k, r, t, v in rights if None not in (row.k, row.r, row.t, v) and k == row.k and r > row.r and t <= row.t]
            assert row.v_sum_x == (sum(hits) if hits else None)
    assert T.count_above_until(ldf, rdf.limit(0), "k", "r", {"x": F.col("t")}, "rt", [T.total("v", F.col("v"))], "lid").where(
        "v_x is not null").count() == 0


def test_only_sums_fold_over_two_orders(data):
    with pytest.raises(ValueError):
        T.count_above_until(data[2], data[3], "k", "lid", {"x": F.col("t")}, "rt", [T.pick_max("m", "id")], "lid")
