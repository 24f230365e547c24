"""The shortfall on one page, as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashtide.functions.amounts import TOTAL, total
from cashtide.operators.star import side_by_side

# Which lever answers which driver.
LEVERS = {
    "INVENTORY_TRAP": "cancel open orders, move stock",
    "COLLECTIONS_SLOWDOWN": "chase collections",
    "AP_ACCELERATION": "defer payments",
}


def briefing(
    levels: DataFrame,
    cycle: DataFrame,
    cancellable: DataFrame,
    deferrable: DataFrame,
    collectable: DataFrame,
    movable: DataFrame,
) -> DataFrame:
    """``(section, item, lever, value)``: the gap, its drivers, the cycle, and what each lever is worth.

    ``levels`` and ``cycle`` are one row; the lists are added up to one row each and all come side
    by side, so nothing is joined.
    """
    days = ("dso_days", "dpo_days", "dio_days", "ccc_days")
    row = side_by_side(
        [
            levels,
            cycle.selectExpr(*(f"CAST({c} AS {TOTAL}) AS {c}" for c in days)),
            cancellable.agg(total("committed_cost").alias("cancel")),
            deferrable.agg(total("deferrable_cash").alias("defer"), total("avoidable_cost").alias("avoid")),
            collectable.agg(total("overdue_amount").alias("chase")),
            movable.agg(F.expr(f"CAST(sum(units) AS {TOTAL}) AS move")),
        ]
    )
    lines: list[tuple[str, str, str | None, str]] = [
        ("ALERT", "planned quarter-end cash", None, "plan"),
        ("ALERT", "projected quarter-end cash", None, "projected"),
        ("ALERT", "gap to plan", None, "projected - plan"),
        ("ALERT", "change since the last forecast", None, "projected - prior_projected"),
        *(("DRIVER", driver, lever, driver) for driver, lever in LEVERS.items()),
        ("KPI", "days sales outstanding", None, "dso_days"),
        ("KPI", "days payable outstanding", None, "dpo_days"),
        ("KPI", "days inventory outstanding", None, "dio_days"),
        ("KPI", "cash conversion cycle", None, "ccc_days"),
        ("ACTION", "open orders in weak categories", "cancel open orders", "cancel"),
        ("ACTION", "payments leaving early", "defer payments", "defer"),
        ("ACTION", "cost of paying early", "defer payments", "avoid"),
        ("ACTION", "overdue and undisputed invoices", "chase collections", "chase"),
        ("ACTION", "units to move between locations", "move stock", "move"),
    ]
    entries = ", ".join(
        f"named_struct('section', '{section}', 'item', '{item}', "
        f"'lever', {f'{lever!r}' if lever else 'CAST(NULL AS STRING)'}, "
        f"'value', CAST(coalesce({value}, 0) AS {TOTAL}))"
        for section, item, lever, value in lines
    )
    return row.selectExpr(f"inline(array({entries}))")
