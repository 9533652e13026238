"""Column functions at their edges."""

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from cohortloom.functions import scalars as S


def one(spark, schema, row, *columns):
    return tuple(spark.createDataFrame([row], schema).select(*columns).collect()[0])


def test_add_business_days(spark):
    d = F.col("d")
    cases = {
        date(2024, 1, 5): (date(2024, 1, 8), date(2024, 1, 12)),  # Friday
        date(2024, 1, 6): (date(2024, 1, 8), date(2024, 1, 12)),  # Saturday
        date(2024, 1, 7): (date(2024, 1, 8), date(2024, 1, 12)),  # Sunday
        date(2024, 1, 3): (date(2024, 1, 4), date(2024, 1, 10)),  # Wednesday
    }
    for day, expected in cases.items():
        assert one(spark, "d date", (day,), S.add_business_days(d, 1), S.add_business_days(d, 5)) == expected
    holidays = [date(2024, 1, 8), date(2024, 1, 9)]
    assert one(spark, "d date", (date(2024, 1, 5),), S.add_business_days(d, 1, holidays)) == (date(2024, 1, 10),)
    assert one(spark, "d date", (None,), S.add_business_days(d, 5)) == (None,)


def test_score_tier(spark):
    for score, tier in ((600.0, 1), (599.99, 2), (578.0, 2), (556.0, 3), (555.9, 4), (None, 4)):
        assert one(spark, "s double", (score,), S.score_tier(F.col("s"))) == (tier,)


def test_nice_div(spark):
    for a, b, out in ((6.0, 3.0, 2.0), (6.0, 0.0, None), (None, 3.0, None), (6.0, None, None)):
        assert one(spark, "a double, b double", (a, b), S.nice_div(F.col("a"), F.col("b"))) == (out,)


def test_average_month_bucket(spark):
    for days, month in ((-5, 1), (0, 1), (30, 1), (31, 2), (487, 16), (488, 17), (None, None)):
        assert one(spark, "d int", (days,), S.average_month_bucket(F.col("d"))) == (month,)


def test_calendar_month_bucket(spark):
    c = S.calendar_month_bucket(F.col("s"), F.col("d"))
    start = date(2023, 1, 31)
    for day, month in ((date(2022, 5, 1), 1), (date(2023, 2, 28), 1), (date(2023, 3, 1), 2), (date(2023, 3, 31), 2),
                       (date(2023, 4, 1), 3), (None, None)):
        assert one(spark, "s date, d date", (start, day), c) == (month,)
    assert one(spark, "s date, d date", (None, start), c) == (None,)


def test_first_date_at_or_after(spark):
    c = S.first_date_at_or_after(F.col("t"))
    assert one(spark, "t timestamp_ntz", (datetime(2023, 1, 5),), c) == (date(2023, 1, 5),)
    assert one(spark, "t timestamp_ntz", (datetime(2023, 1, 5, 0, 0, 1),), c) == (date(2023, 1, 6),)


def test_token_list(spark):
    c = S.has_token(F.col("s"), "1").cast("int")
    for text, hit in ((None, None), ("", 0), ("1", 1), ("11", 0), ("1,11", 1), ("2, 1", 0), ("2,1,", 1), ("3,1", 1)):
        assert one(spark, "s string", (text,), c) == (hit,)


def test_text_pieces(spark):
    s = F.col("s")
    columns = (S.first_digit_run(s), S.digit_count(s))
    for text, expected in (("ab12c345", ("12", 5)), ("abc", (None, 0)), (None, (None, 0))):
        assert one(spark, "s string", (text,), *columns) == expected
    c = S.ilike_infix(s, F.col("n"))
    for text, name, hit in (("xJOHNx", "john", True), ("x_y", "a_", False), ("axb", "a_b", True), ("ab", "a%b", True),
                            ("a\\z", "a\\z", False), ("azb", "a\\z", True), ("x", None, None)):
        assert one(spark, "s string, n string", (text, name), c) == (hit,)


def test_reversed_regex(spark):
    c = S.any_word_matches(("interest", "fee", "principal"), F.col("p"))
    for pattern, hit in (("FEE", True), ("inter.st", True), ("fees", False), (None, None)):
        assert one(spark, "p string", (pattern,), c) == (hit,)


def test_add_business_days_with_any_holiday_list(spark):
    start = date(2019, 12, 1)
    weekdays = [start + timedelta(days=i) for i in range(120) if (start + timedelta(days=i)).weekday() < 5]
    january = [x for x in weekdays if x >= date(2020, 1, 6)]
    weekend = [date(2020, 1, 4), date(2020, 1, 5)]
    lists = [january[:20], january[:20:2], [*weekdays[:10], *january[3:9], *weekend], weekend]
    days = [date(2019, 12, 20) + timedelta(days=i) for i in range(30)]
    df = spark.createDataFrame([(x,) for x in [*days, None]], "d date")
    for holidays in lists:
        got = df.select("d", *[S.add_business_days(F.col("d"), n, holidays).alias(f"n{n}") for n in (1, 5, 13)])
        for r in got.collect():
            for n in (1, 5, 13):
                x, left = r.d, n
                while r.d and left:
                    x += timedelta(days=1)
                    left -= x.weekday() < 5 and x not in holidays
                assert r[f"n{n}"] == x
