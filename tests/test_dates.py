import datetime as dt

from conftest import day, rows

from cashtide.functions.dates import calendar, fiscal_quarter, open_as_of, saturdays, trailing, week_ending


def dates(spark, *texts):
    return spark.createDataFrame([(day(t) if t else None,) for t in texts], "d date")


def test_week_ends_on_saturday(spark):
    got = rows(dates(spark, "2026-11-06", "2026-11-07", "2026-11-08").select(week_ending("d")))
    assert got == [(day("2026-11-07"),), (day("2026-11-07"),), (day("2026-11-14"),)]


def test_trailing_counts_the_last_day_and_not_the_day_before_the_first(spark):
    as_of = day("2026-11-05")
    inside = {as_of, as_of - dt.timedelta(days=89)}
    outside = {as_of - dt.timedelta(days=90), as_of + dt.timedelta(days=1)}
    df = spark.createDataFrame([(d,) for d in inside | outside], "d date")
    assert {r[0] for r in rows(df.filter(trailing("d", as_of, 90)))} == inside


def test_open_as_of(spark):
    as_of = day("2026-11-05")
    df = spark.createDataFrame(
        [
            ("unpaid", day("2026-10-01"), None),
            ("paid that day", day("2026-10-01"), as_of),
            ("paid later", day("2026-10-01"), day("2026-11-06")),
            ("not yet issued", day("2026-11-06"), None),
        ],
        "what string, issued date, paid date",
    )
    assert {r[0] for r in rows(df.filter(open_as_of("issued", "paid", as_of)).select("what"))} == {"unpaid", "paid later"}


def test_fiscal_quarter(spark):
    assert rows(dates(spark, "2026-12-31", "2027-01-01").select(fiscal_quarter("d"))) == [("FY2026-Q4",), ("FY2027-Q1",)]


def test_calendar(spark):
    bounds = spark.createDataFrame([(day("2024-02-01"), day("2026-12-31"))], "first_day date, last_day date")
    by_day = {r.date_key: r for r in calendar(bounds).collect()}
    assert len(by_day) == (day("2026-12-31") - day("2024-02-01")).days + 1
    last = by_day[day("2026-12-31")]
    assert (last.week_of_year, last.is_quarter_end, last.day_of_week, last.is_weekend) == (53, True, "Thu", False)
    assert (last.month_name, last.fiscal_quarter, last.fiscal_year) == ("December", "FY2026-Q4", 2026)
    assert last.week_ending_date == day("2027-01-02")
    leap = by_day[day("2024-02-29")]
    assert (leap.day_of_month, leap.month_num, leap.is_quarter_end) == (29, 2, False)
    assert by_day[day("2024-03-31")].is_quarter_end
    assert [by_day[day(d)].is_weekend for d in ("2026-11-06", "2026-11-07", "2026-11-08")] == [False, True, True]


def test_saturdays():
    assert saturdays(day("2026-10-25"), day("2026-11-14")) == [day("2026-10-31"), day("2026-11-07"), day("2026-11-14")]
    assert saturdays(day("2026-11-01"), day("2026-11-06")) == []
