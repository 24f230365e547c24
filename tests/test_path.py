import datetime as dt
import random
import statistics
from decimal import Decimal

import pytest
from conftest import day, rows

from cashtide.plans.path import ALL, historic_path, quarter_profile

END = day("2026-12-31")


def balances(spark, values):
    return spark.createDataFrame([(d, Decimal(v)) for d, v in values.items()], "day date, balance decimal(28,2)")


def amounts(spark, *parts):
    return spark.createDataFrame([(r, d, Decimal(p), Decimal(q)) for r, d, p, q in parts], "forecast_run_date date, driver string, planned_amt decimal(28,2), projected_amt decimal(28,2)")


def after(first):
    """The first day of the next quarter."""
    return dt.date(first.year + 1, 1, 1) if first.month == 10 else dt.date(first.year, first.month + 3, 1)


def brute(values, until):
    """Shares reached by the end of each week, by loops over days."""
    quarters = sorted({dt.date(d.year, (d.month - 1) // 3 * 3 + 1, 1) for d in values if d <= until})
    known = {d: v for d, v in values.items() if d <= until}

    def at(limit):
        return known[max(d for d in known if d < limit)]

    found = []
    for first in quarters[1:]:
        if after(first) > until + dt.timedelta(days=1):
            continue
        opening, ending = at(first), at(after(first))
        if opening == ending:
            continue
        shares = []
        for w in range(14):
            limit = after(first) if w == 13 else first + dt.timedelta(days=7 * w)
            come, moved = at(limit) - opening, ending - opening
            same = come * moved > 0
            shares.append(0 if not same else 1_000_000 if abs(come) >= abs(moved) else abs(come) * 1_000_000 // abs(moved))
        found.append(shares)
    reached, most = [], 0
    for week in zip(*found, strict=True):
        most = max(most, int(2 * statistics.median(week)))
        reached.append(most)
    return reached, len(found)


def test_profile_by_hand(spark):
    # All of one quarter's change comes in its third week, all of the next one's on its last day.
    values = {day("2026-01-05"): 100, day("2026-03-31"): 200, day("2026-04-16"): 600, day("2026-09-30"): 700}
    found = rows(quarter_profile(balances(spark, values), day("2026-09-30")).select("week", "reached", "quarters").orderBy("week"))
    half = ALL // 2
    assert found == [(w, 0 if w < 3 else half if w < 13 else ALL, 2) for w in range(14)]
    # A quarter that has not ended does not count, nor does one without a quarter before it.
    only = rows(quarter_profile(balances(spark, values), day("2026-09-29")).select("reached").orderBy("week"))
    assert [r for (r,) in only] == [0] * 3 + [ALL] * 11
    assert quarter_profile(balances(spark, values), day("2026-03-31")).count() == 0
    assert quarter_profile(balances(spark, {}), day("2026-03-31")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_profile_equals_loops(spark, seed):
    made = random.Random(seed)
    values, level = {}, 0
    for n in range(1500):
        level += made.randint(-40, 50)
        # Days, and now and then whole quarters, without a movement.
        if made.random() < 0.3 and (n // 200) % 4 != 3:
            values[day("2020-01-10") + dt.timedelta(days=n)] = level
    until = day("2023-11-15")
    found = rows(quarter_profile(balances(spark, values), until).select("reached", "quarters").orderBy("week"))
    reached, quarters = brute(values, until)
    assert [r for r, _ in found] == reached and {q for _, q in found} == {quarters} and quarters >= 6


def test_path_follows_the_profile(spark):
    # In the past a quarter's change came half in its third week and half at its end.
    values = {day("2026-03-31"): 100, day("2026-04-16"): 300, day("2026-06-30"): 500, day("2026-09-30"): 500, day("2026-11-05"): 450}
    run = day("2026-10-03")
    plan = amounts(spark, (run, "BASELINE", 1500, 1500), (run, "INVENTORY_TRAP", 0, -600))
    found = historic_path(plan, balances(spark, values), [run], END).orderBy("forecast_week_ending").collect()
    assert [r.forecast_week_ending for r in found] == [day("2026-10-10") + dt.timedelta(weeks=n) for n in range(12)] + [END]
    assert all(r.from_history and r.opening_balance == 500 for r in found)
    # Three full weeks have passed from the 21st on.
    assert [int(r.planned_cash_amt) for r in found] == [500] * 2 + [1000] * 10 + [1500]
    assert [int(r.projected_cash_amt) for r in found] == [500] * 2 + [700] * 10 + [900]
    assert [int(r.variance_amt) for r in found] == [0] * 2 + [-300] * 10 + [-600]


def test_path_covers_what_is_left(spark):
    """A run in mid-quarter starts at its own balance and spreads only what has not come yet."""
    values = {day("2026-03-31"): 0, day("2026-04-16"): 500, day("2026-05-30"): 750, day("2026-06-30"): 1000, day("2026-09-30"): 1000, day("2026-11-01"): 1200}
    run = day("2026-11-07")  # five full weeks in: half has come
    found = historic_path(amounts(spark, (run, "BASELINE", 2200, 2200)), balances(spark, values), [run], END)
    by_day = {r.forecast_week_ending: int(r.projected_cash_amt) for r in found.collect()}
    assert by_day[day("2026-11-14")] == 1200 and by_day[day("2026-11-28")] == 1200
    assert by_day[day("2026-12-05")] == 1700 and by_day[END] == 2200


def test_straight_without_history(spark):
    run = day("2026-12-11")
    found = historic_path(amounts(spark, (run, "BASELINE", 200, 100)), balances(spark, {}), [run], END).orderBy("forecast_week_ending")
    assert rows(found.select("forecast_week_ending", "from_history", "opening_balance", "planned_cash_amt")) == [
        (day("2026-12-12"), False, 0, 10),
        (day("2026-12-19"), False, 0, 80),
        (day("2026-12-26"), False, 0, 150),
        (END, False, 0, 200),
    ]


def test_run_on_the_last_day(spark):
    found = historic_path(amounts(spark, (END, "BASELINE", 200, 100)), balances(spark, {}), [END], END)
    assert rows(found.select("forecast_week_ending", "projected_cash_amt")) == [(END, 100)]
