"""Facts found in text by rules."""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """What to look for: a regular expression and the group to keep, or a fixed finding.

    ``signs`` are texts of which every match has at least one: a document without any is not
    searched with the slower pattern.
    """

    name: str
    pattern: str
    group: int = 0
    finding: str | None = None
    signs: tuple[str, ...] = ()


# No lengths are bounded. Where a run of letters or digits could be tried again from each of its
# places, a look-behind starts it at its first one only, and possessive quantifiers keep it from
# being given back, so that time stays in proportion to length.

# Rules for dispute letters, remittance notes, and supplier contracts.
FINANCE_RULES = (
    Rule("amount", r"(?:\$|(?<![A-Za-z0-9_])(?i:USD|EUR) ?)[0-9]++(?:,[0-9]++)*+(?:\.[0-9]++)?+"),
    Rule("amount", r"(?<![0-9])(?<![0-9][,.])[0-9]++(?:[,.][0-9]++)*+ ?(?i:USD|EUR)(?![A-Za-z0-9_])"),
    Rule("terms_days", r"(?<![A-Za-z0-9_])(?i:net)[ -]?([0-9]++)", 1),
    Rule("discount_pct", r"(?<![0-9])([0-9]++(?:\.[0-9]++)?) ?%", 1, signs=("%",)),
    Rule("reason", r"(?i)short[- ]ship(?:ped|ment)?", finding="short-ship"),
    Rule("reason", r"(?i)(?:quality (?:defect|issue)|defective)", finding="quality defect"),
    Rule("reason", r"(?i)pric(?:e|ing) (?:discrepancy|difference|error)", finding="pricing discrepancy"),
)

# Rules for what general prose holds.
CONTACT_RULES = (
    Rule("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", signs=("@",)),
    Rule("phone", r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![A-Za-z0-9_])", signs=("-",)),
    Rule(
        "licence",
        r"(?:MIT License|Apache License|GNU General Public License|Creative Commons)",
        signs=("License", "Creative Commons"),
    ),
)


def _hits(rule: Rule, text: str) -> Column:
    hits = F.regexp_extract_all(F.col(text), F.lit(rule.pattern), F.lit(rule.group))
    if not rule.signs:
        return hits
    seen = reduce(operator.or_, (F.contains(F.col(text), F.lit(sign)) for sign in rule.signs))
    return F.when(seen, hits).otherwise(F.array().cast("array<string>"))


def _entry(rule: Rule) -> Callable[[Column, Column], Column]:
    def entry(hit: Column, place: Column) -> Column:
        value = hit if rule.finding is None else F.lit(rule.finding)
        return F.struct(F.lit(rule.name).alias("rule"), (place + 1).alias("occurrence"), value.alias("value"))

    return entry


def extract_evidence(
    documents: DataFrame, rules: Sequence[Rule], key: str | Sequence[str] = "doc_id", text: str = "text"
) -> DataFrame:
    """Every finding in every document: ``(key, rule, occurrence, value)``, occurrences from 1.

    One pass over the whole text of each document with compiled patterns inside the JVM. Each rule
    counts its own occurrences.
    """
    found = [F.transform(_hits(rule, text), _entry(rule)) for rule in rules]
    keys = [key] if isinstance(key, str) else list(key)
    return documents.select(*keys, F.inline(F.concat(*found)))


def evidence_summary(evidence: DataFrame, key: str | Sequence[str] = "doc_id") -> DataFrame:
    """Findings by rule and value: how many, in how many documents, as ``key`` names them."""
    keys = [key] if isinstance(key, str) else list(key)
    per_document = evidence.groupBy("rule", "value", *keys).agg(F.count(F.lit(1)).alias("n"))
    return per_document.groupBy("rule", "value").agg(
        F.sum("n").cast("bigint").alias("findings"), F.count(F.lit(1)).alias("documents")
    )
