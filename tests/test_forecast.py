import datetime as dt
import math
import random
import statistics
from decimal import Decimal

import golden
import pytest
from conftest import day, rows
from pyspark.sql import functions as F

from cashtide.operators.projection import forecast_rows
from cashtide.plans.alerts import cash_alert, drift_alert
from cashtide.plans.forecast import backtested_forecast, predict_cash_flow, register_forecast, rolling_weeks
from cashtide.plans.kpis import deterioration
from cashtide.plans.reports import waterfall
from cashtide.plans.worksheet import driver_variance, plan_vs_projected


@pytest.fixture(scope="module")
def forecast(spark):
    return forecast_rows(golden.amounts(spark), golden.QUARTER_END, golden.HORIZON)


def test_rows_and_levels(forecast):
    assert forecast.count() == 88
    assert rows(plan_vs_projected(forecast, golden.QUARTER_END)) == [
        (golden.PRIOR, 30_000_000, 25_000_000, -5_000_000),
        (golden.AS_OF, 30_000_000, 22_000_000, -8_000_000),
    ]
    assert dict(rows(driver_variance(forecast, golden.AS_OF, golden.QUARTER_END))) == {
        "BASELINE": 0,
        "INVENTORY_TRAP": -3_500_000,
        "COLLECTIONS_SLOWDOWN": -2_500_000,
        "AP_ACCELERATION": -2_000_000,
    }


def test_ramp(forecast):
    weekly = forecast.filter((F.col("forecast_run_date") == F.lit(golden.AS_OF)) & (F.col("forecast_week_ending") != F.lit(golden.QUARTER_END)))
    weeks = sorted({r.forecast_week_ending for r in weekly.collect()})
    assert (weeks[0], weeks[-1], len(weeks)) == (day("2026-11-07"), day("2027-01-02"), 9)
    for r in weekly.collect():
        part = Decimal(weeks.index(r.forecast_week_ending) + 1) / 9
        if r.driver == "BASELINE":
            want = (30_000_000 * (Decimal("0.94") + Decimal("0.06") * part)).quantize(Decimal("0.01"))
            assert r.planned_cash_amt == r.projected_cash_amt == want
        else:
            amount = golden.DRIVER_AMOUNTS[golden.AS_OF][r.driver]
            assert r.planned_cash_amt == 0
            assert r.projected_cash_amt == (-amount * part).quantize(Decimal("0.01"))
        assert r.variance_amt == r.projected_cash_amt - r.planned_cash_amt


def test_the_start_of_the_path_is_an_argument(spark):
    got = forecast_rows(golden.amounts(spark).filter("driver = 'BASELINE'"), golden.QUARTER_END, golden.HORIZON, start_pct=40)
    first = got.filter(F.col("forecast_run_date") == F.lit(golden.AS_OF)).orderBy("forecast_week_ending").first()
    assert first.planned_cash_amt == (30_000_000 * (Decimal("0.4") + Decimal("0.6") / 9)).quantize(Decimal("0.01"))


def test_a_saturday_quarter_end_has_one_row(spark):
    end = day("2026-10-31")
    got = forecast_rows(golden.amounts(spark).filter("driver = 'BASELINE'"), end, end)
    dates = [r.forecast_week_ending for r in got.filter(F.col("forecast_run_date") == F.lit(golden.PRIOR)).collect()]
    assert sorted(dates) == [day("2026-10-24"), end]
    # The later run lies after the quarter-end: only the checkpoint is left.
    assert got.filter(F.col("forecast_run_date") == F.lit(golden.AS_OF)).count() == 1


def runs(spark, *levels):
    data = [(dt.date(2026, 1, 3) + dt.timedelta(weeks=2 * n), golden.QUARTER_END, "BASELINE", Decimal(1000), Decimal(v), Decimal(v - 1000)) for n, v in enumerate(levels)]
    return spark.createDataFrame(
        data,
        "forecast_run_date date, forecast_week_ending date, driver string, planned_cash_amt decimal(14,2), "
        "projected_cash_amt decimal(14,2), variance_amt decimal(14,2)",
    )


@pytest.mark.parametrize("levels", [(900,), (900, 800), (900, 800, 850)])
def test_deterioration(spark, levels):
    got = [int(r.deterioration_2wk) for r in deterioration(runs(spark, *levels), golden.QUARTER_END).orderBy("current_run_date").collect()]
    assert got == [b - a for a, b in zip(levels, levels[1:], strict=False)]


def test_golden_deterioration(forecast):
    assert rows(deterioration(forecast, golden.QUARTER_END)) == [
        (golden.AS_OF, Decimal("22000000.00"), Decimal("25000000.00"), Decimal("-3000000.00"))
    ]


def alerts(spark, *levels, **how):
    how = {"level": 100, "velocity": 50, **how}
    return [(r.level_breach, r.velocity_breach, r.alert) for r in cash_alert(runs(spark, *levels), golden.QUARTER_END, **how).collect()]


def test_alert_needs_level_and_velocity(spark):
    assert alerts(spark, 1000, 880, 870, 990) == [
        (False, False, False),  # neither
        (True, True, True),  # both
        (True, False, False),  # level only
        (False, False, False),
    ]
    assert alerts(spark, 1000, 920)[1] == (False, True, False)  # velocity only


def test_alert_stays_quiet_inside_the_control_limits(spark):
    # Losses swing between 60 and 160, so another 100 is nothing new; 400 is.
    usual = (2000, 1940, 1780, 1720, 1560, 1500)
    assert alerts(spark, *usual, 1400, level=-10_000)[-1] == (True, True, False)
    assert alerts(spark, *usual, 1100, level=-10_000)[-1] == (True, True, True)


def drifts(spark, *levels, **how):
    how = {"slack": 10, "limit": 100, **how}
    found = drift_alert(runs(spark, *levels), golden.QUARTER_END, **how).collect()
    dates = [r.forecast_run_date for r in found]
    at = {None: None, **{d: n for n, d in enumerate(dates)}}
    return [(int(r.falling), at[r.falling_since], int(r.rising), at[r.rising_since], r.signal) for r in found]


def test_small_losses_add_up_to_a_signal(spark):
    slow = [1000 - 40 * n for n in range(6)]
    assert drifts(spark, *slow) == [
        (0, None, 0, None, None),
        (30, 1, 0, None, None),
        (60, 1, 0, None, None),
        (90, 1, 0, None, None),
        (120, 1, 0, None, "FALLING"),
        (30, 5, 0, None, None),  # starts again
    ]
    # The same losses never leave the control limits.
    assert not any(alert for *_, alert in alerts(spark, *slow, level=-10_000))


def test_a_recovery_ends_the_excursion(spark):
    assert drifts(spark, 1000, 950, 1000, 950) == [
        (0, None, 0, None, None),
        (40, 1, 0, None, None),
        (0, None, 40, 2, None),
        (40, 3, 0, None, None),
    ]
    assert drifts(spark, 1000, 1300)[-1] == (0, None, 290, 1, "RISING")
    # What is expected is no drift.
    assert drifts(spark, 1000, 950, 900, 850, expected=-50) == [(0, None, 0, None, None)] * 4


def test_drift_of_few_runs(spark):
    assert drifts(spark, 1000) == [(0, None, 0, None, None)]
    assert drift_alert(runs(spark, 1000).limit(0), golden.QUARTER_END, 1, 1).filter("forecast_run_date IS NOT NULL").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_drift_equals_a_loop(spark, seed):
    made = random.Random(seed)
    levels = [1000]
    for _ in range(30):
        levels.append(levels[-1] + made.randint(-60, 50))
    falling = rising = 0
    expected = [(0, 0, None)]
    for a, b in zip(levels, levels[1:], strict=False):
        falling = max(0, (0 if falling > 100 else falling) - (b - a) - 10)
        rising = max(0, (0 if rising > 100 else rising) + (b - a) - 10)
        expected.append((falling, rising, "FALLING" if falling > 100 else "RISING" if rising > 100 else None))
    assert [(f, r, s) for f, _, r, _, s in drifts(spark, *levels)] == expected


def test_waterfall(forecast):
    got = [(r.item, int(r.amount), int(r.running)) for r in waterfall(forecast, golden.AS_OF, golden.QUARTER_END).collect()]
    assert got == [
        ("PLAN", 30_000_000, 30_000_000),
        ("INVENTORY_TRAP", -3_500_000, 26_500_000),
        ("COLLECTIONS_SLOWDOWN", -2_500_000, 24_000_000),
        ("AP_ACCELERATION", -2_000_000, 22_000_000),
        ("OTHER", 0, 22_000_000),
        ("PROJECTED", 22_000_000, 22_000_000),
    ]


def ledger(spark, values):
    """One category; ``values`` are the end-of-day balances."""
    start, before, data = dt.date(2026, 8, 1), 0, []
    for n, value in enumerate(values):
        net = Decimal(value) - Decimal(before)
        data.append((start + dt.timedelta(days=n), "SALES_RECEIPTS", max(net, Decimal(0)), max(-net, Decimal(0)), net, Decimal(value)))
        before = value
    return spark.createDataFrame(
        data,
        "ledger_date date, cash_category string, cash_in_amt decimal(14,2), cash_out_amt decimal(14,2), "
        "net_cash_amt decimal(14,2), running_cash_balance decimal(14,2)",
    )


def test_a_straight_line_is_continued(spark):
    as_of = day("2026-08-30")
    got = predict_cash_flow(ledger(spark, [1000 - 10 * n for n in range(30)]), as_of, [day("2026-09-09")]).first()
    assert (got.segment, int(got.projected_balance)) == ("ALL", 1000 - 10 * 39)
    assert got.lower_bound == got.upper_bound == got.projected_balance


def test_interval_follows_the_textbook(spark):
    values = [1000 + 7 * n + (-1) ** n * 40 for n in range(40)]
    as_of, target = day("2026-09-09"), day("2026-09-30")
    got = predict_cash_flow(ledger(spark, values), as_of, [target], history_days=40).first()
    xs, n, x0 = range(40), 40, (target - day("2026-08-01")).days
    slope, intercept = statistics.linear_regression(xs, values)
    mean = statistics.mean(xs)
    sxx = sum((x - mean) ** 2 for x in xs)
    sd = math.sqrt(sum((y - intercept - slope * x) ** 2 for x, y in zip(xs, values, strict=True)) / (n - 2))
    width = statistics.NormalDist().inv_cdf(0.975) * sd * math.sqrt(1 + 1 / n + (x0 - mean) ** 2 / sxx)
    middle = intercept + slope * x0
    assert [int(v) for v in (got.projected_balance, got.lower_bound, got.upper_bound)] == [
        round(middle), round(middle - width), round(middle + width),
    ]


def test_history_is_limited_and_the_future_is_not_seen(spark):
    values = [10_000] * 10 + [500] * 20 + [-9_999] * 5
    got = predict_cash_flow(ledger(spark, values), day("2026-08-30"), [day("2026-09-30")], history_days=20).first()
    assert int(got.projected_balance) == 500


def test_too_little_history_gives_no_forecast(spark):
    assert predict_cash_flow(ledger(spark, [1, 2]), day("2026-08-02"), [day("2026-09-30")]).count() == 0


def test_by_name_from_sql(spark):
    book = ledger(spark, [1000 - 10 * n for n in range(30)])
    register_forecast(predict_cash_flow(book, day("2026-08-30"), [day("2026-09-09")], by_category=True))
    found = spark.sql("SELECT projected_balance FROM predict_cash_flow('SALES_RECEIPTS')")
    assert rows(found) == [(Decimal("610.00"),)]
    assert spark.sql("SELECT * FROM predict_cash_flow('RENT')").count() == 0


def test_rolling_weeks(spark):
    got = rolling_weeks(ledger(spark, [1000 - 10 * n for n in range(29)]), day("2026-08-29"), weeks=3).collect()
    assert [(str(r.week_ending_date), r.kind) for r in got] == [
        ("2026-08-15", "ACTUAL"), ("2026-08-22", "ACTUAL"), ("2026-08-29", "ACTUAL"),
        ("2026-09-05", "FORECAST"), ("2026-09-12", "FORECAST"), ("2026-09-19", "FORECAST"),
    ]
    assert [int(r.closing_balance) for r in got] == [860, 790, 720, 650, 580, 510]
    assert [int(r.cash_out) for r in got[:3]] == [70, 70, 70]


def test_intervals_are_as_wide_as_forecasts_were_wrong(spark):
    """Against plain fits at every origin, on days with gaps."""
    draw = random.Random(6)
    days = [x for x in range(-150, 1) if draw.random() < 0.8 or x in (-150, 0)]
    net = {x: draw.randrange(-500, 700) for x in days}
    ledger = spark.createDataFrame([(golden.AS_OF + dt.timedelta(days=x), "ANY", Decimal(v)) for x, v in net.items()], "ledger_date date, cash_category string, net_cash_amt decimal(12,2)")
    balance = {x: sum(net[y] for y in days if y <= x) for x in days}

    def line(upto):
        xs = [x for x in days if x <= upto]
        ys = [balance[x] for x in xs]
        n, mx, my = len(xs), sum(xs) / len(xs), sum(ys) / len(xs)
        slope = sum((x - mx) * (y - my) for x, y in zip(xs, ys, strict=True)) / sum((x - mx) ** 2 for x in xs)
        return n, slope, my - slope * mx

    got = {r.horizon_days: r for r in backtested_forecast(ledger, golden.AS_OF, [1, 20, 400], level=0.9, least=30).collect()}
    _, slope, intercept = line(0)
    for h in (1, 20):
        away = []
        for x in days:
            if len([d for d in days if d <= x]) >= 30 and x + h <= 0:
                _, s, i = line(x)
                away.append(abs(round(balance[max(d for d in days if d <= x + h)] - (i + s * (x + h)))))
        away.sort()
        width = away[math.ceil(0.9 * len(away)) - 1]
        middle = round(intercept + slope * h)
        assert got[h].origins == len(away)
        assert [int(got[h][c]) for c in ("projected_balance", "lower_bound", "upper_bound")] == [middle, middle - width, middle + width]
    # Nothing is known about so far ahead.
    assert got[400].origins == 0 and got[400].lower_bound is None and got[400].projected_balance is not None
