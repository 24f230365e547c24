"""A dimension key that occurs twice is an error in every query that looks it up."""

import pytest

from cashtide import queries
from cashtide.schemas import TRADE_SCHEMAS
from cashtide.sources.model import Model
from cashtide.sources.tables import read_tables

FOLDER = "/root/testdata/sf0.001"
READERS = {
    "customer": [
        "q_sales_valued", "q_collections_by_channel", "q_disputes", "q_mv_ar", "q_mv_sales", "q_inventory_snapshot", "q_running_total",
        "q_position", "q_fill_nulls", "q_chase_collections", "q_allocate_exact", "q_ar_aging", "q_reflow",
    ],
    "part": [
        "q_sales_valued", "q_po_by_status", "q_inventory_snapshot", "q_aged_inventory", "q_sell_through", "q_units_8wk", "q_cancel_pos",
        "q_working_capital", "q_mv_sales_goods",
    ],
    "supplier": ["q_inventory_snapshot", "q_mv_ap", "q_terms_variance", "q_defer_payments", "q_sell_through"],
}


@pytest.mark.parametrize(("table", "name"), [(t, n) for t, names in READERS.items() for n in names])
def test_a_doubled_key_is_refused(spark, monkeypatch, table, name):
    def doubled(*args):
        source = dict(read_tables(*args))
        source[table] = source[table].union(source[table])
        return source

    monkeypatch.setattr(queries, "read_tables", doubled)
    with pytest.raises(Exception, match="not unique"):
        queries.QUERIES[name](spark, FOLDER).collect()


def test_the_model_itself_is_lazy(spark):
    model = Model(read_tables(spark, FOLDER, TRADE_SCHEMAS, TRADE_SCHEMAS), queries.AS_OF, queries.QUARTER_END)
    assert set(model.tables()) >= {"fact_sales", "fact_cash_ledger"}
