from conftest import rows

from cashtide.plans.evidence import CONTACT_RULES, FINANCE_RULES, Rule, evidence_summary, extract_evidence

TEXTS = [
    (1, "Invoice 88 for $12,500.00 is on hold: the order was short-shipped. A Short Shipment again costs USD 300."),
    (2, "Terms are net 60 with 2.5% if paid early; formerly Net-45 with 2 %. No quality defect was found."),
    (3, "A pricing discrepancy and DEFECTIVE goods. " + "x" * 50_000 + " " + "7" * 50_000 + " Call 555-123-4567 or a.b@c.org, $1"),
    (4, ""),
    (5, None),
    (6, "Nothing to see: $ 5, net worth, 100 percent, a@b, 55-123-4567."),
]


def found(spark, rules):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return sorted(tuple(r) for r in extract_evidence(docs, rules).collect())


def test_finance_rules(spark):
    assert found(spark, FINANCE_RULES) == [
        (1, "amount", 1, "$12,500.00"),
        (1, "amount", 2, "USD 300"),
        (1, "reason", 1, "short-ship"),
        (1, "reason", 2, "short-ship"),
        (2, "discount_pct", 1, "2.5"),
        (2, "discount_pct", 2, "2"),
        (2, "reason", 1, "quality defect"),
        (2, "terms_days", 1, "60"),
        (2, "terms_days", 2, "45"),
        (3, "amount", 1, "$1"),
        (3, "reason", 1, "pricing discrepancy"),
        (3, "reason", 1, "quality defect"),
    ]


def test_contact_rules_reach_the_end_of_a_long_text(spark):
    assert found(spark, CONTACT_RULES) == [(3, "email", 1, "a.b@c.org"), (3, "phone", 1, "555-123-4567")]


def test_signs_change_nothing_but_the_work(spark):
    for rule in (*FINANCE_RULES, *CONTACT_RULES):
        bare = Rule(rule.name, rule.pattern, rule.group, rule.finding)
        assert found(spark, [rule]) == found(spark, [bare])


def test_summary(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    got = rows(evidence_summary(extract_evidence(docs, FINANCE_RULES)).filter("rule = 'reason'"))
    assert sorted(got) == [
        ("reason", "pricing discrepancy", 1, 1), ("reason", "quality defect", 2, 2), ("reason", "short-ship", 2, 1),
    ]


def test_whole_values_of_any_length_and_case(spark):
    long = "1" * 5000
    texts = [
        (1, f"{long}% and net {long} days, mail {'a' * 80}@{'b' * 300}.example"),
        (2, "planet 30, internet 24, NET 30, Net30, usd 5 and 3.50 EUR, 1,200.00eur"),
        (3, "1,2,3,4," * 20_000 + "a@" * 20_000),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted((r.doc_id, r.rule, r.value) for r in extract_evidence(docs, (*FINANCE_RULES, *CONTACT_RULES)).collect())
    assert got == sorted([
        (1, "discount_pct", long), (1, "terms_days", long), (1, "email", f"{'a' * 80}@{'b' * 300}.example"),
        (2, "terms_days", "30"), (2, "terms_days", "30"), (2, "amount", "usd 5"), (2, "amount", "3.50 EUR"), (2, "amount", "1,200.00eur"),
    ])


def test_amounts_end_with_a_digit_and_phones_stand_alone(spark):
    text = "$1,200, then USD 5, or 1.234.567,89 EUR and $3. Call 555-123-4567. Not 12345-678-90123 nor 1555-123-45678."
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = [(r.rule, r.value) for r in extract_evidence(docs, (*FINANCE_RULES, *CONTACT_RULES)).collect()]
    assert got == [("amount", "$1,200"), ("amount", "USD 5"), ("amount", "$3"), ("amount", "1.234.567,89 EUR"), ("phone", "555-123-4567")]


def test_time_is_in_proportion_to_length(spark):
    """Ten million characters that begin an amount at every third place; in quadratic time they would take days."""
    for piece in ("1,,", "1,", "$1", "1-"):
        docs = spark.range(1).selectExpr("id AS doc_id", f"repeat('{piece}', {10_000_000 // len(piece)}) AS text")
        assert extract_evidence(docs, FINANCE_RULES[:2] + CONTACT_RULES[1:2]).filter("rule = 'phone'").count() == 0
