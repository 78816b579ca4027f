"""Account prediction by an ordered table of typed conditions (R-27, R-28).

A rule states any of: a department list, a department prefix, one supplier, one
product code, keywords (a regex, ignoring case), an amount from (inclusive) and
below (exclusive).  What it does not state, or states as ``"0"``, is a wildcard.
All stated conditions have to hold; the first rule that holds wins.  The table is
compiled to one CASE that yields the rule's number; account, liability and note
are looked up by that number.
"""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closebook.functions.numbers import parse_double
from closebook.operators.documents import has

_RULES_DIR = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "rules")
ANY = "0"
#: The amount as a number, read once per line.
AMOUNT = "_amount"


@dataclass(frozen=True)
class AccountRule:
    account: str
    note: str
    liability: str | None = None
    departments: tuple[str, ...] = ()
    department: str = ANY
    supplier: str = ANY
    product_code: str = ANY
    keywords: str = ""
    min_amount: float | None = None
    max_amount: float | None = None

    def stated(self) -> dict[str, object]:
        """The conditions that are no wildcard."""
        named = {k: getattr(self, k) for k in ("departments", "department", "supplier", "product_code", "keywords", "min_amount", "max_amount")}
        return {k: v for k, v in named.items() if v is not None and v not in ("", ANY, ())}


def load_rules(name: str) -> list[AccountRule]:
    """The rules of ``rules/<name>.toml`` by rising ``rule_id``."""
    with open(os.path.join(_RULES_DIR, f"{name}.toml"), "rb") as f:
        raw = tomllib.load(f)["rules"]
    rows = sorted(raw, key=lambda r: r["rule_id"])
    if len({r["rule_id"] for r in rows}) != len(rows):
        raise ValueError(f"{name}: rule_id repeats")
    return [AccountRule(**{k: tuple(v) if isinstance(v, list) else v for k, v in r.items() if k != "rule_id"}) for r in rows]


def condition(rule: AccountRule) -> Column:
    """All stated conditions of a rule; null fields and unreadable amounts fail."""
    amount = F.col(AMOUNT)
    by = {
        "departments": lambda v: F.col("department").isin(*v),
        "department": lambda v: F.startswith("department", F.lit(v)),
        "supplier": lambda v: F.col("supplier") == v,
        "product_code": lambda v: F.col("product_code") == v,
        "keywords": lambda v: has(F.col("item_description"), f"(?:{v})"),
        "min_amount": lambda v: amount >= float(v),
        "max_amount": lambda v: amount < float(v),
    }
    parts = [F.coalesce(by[k](v), F.lit(False)) for k, v in rule.stated().items()]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def rule_number(rules: list[AccountRule]) -> Column:
    """Number (from 1) of the first rule that holds, null if none."""
    case = None
    for no, rule in enumerate(rules, 1):
        case = F.when(condition(rule), F.lit(no)) if case is None else case.when(condition(rule), F.lit(no))
    return F.lit(None).cast("int") if case is None else case


def predict(lines: DataFrame, rules: list[AccountRule]) -> DataFrame:
    """``lines`` with predicted_rule, predicted_account, predicted_liability and
    matched_conditions (null where no rule holds; a rule without a liability
    leaves it null)."""
    def decoded(field: str) -> Column:
        return F.get(F.array(*[F.lit(getattr(r, field)).cast("string") for r in rules] or [F.lit(None).cast("string")]), F.col("predicted_rule") - 1)

    numbered = lines.withColumn(AMOUNT, parse_double(F.col("entry_amount"))).withColumn("predicted_rule", rule_number(rules)).drop(AMOUNT)
    return numbered.withColumns({
        "predicted_account": decoded("account"), "predicted_liability": decoded("liability"), "matched_conditions": decoded("note")})


def statistics(predicted: DataFrame) -> DataFrame:
    """A-15: rows (metric, account, value) — total, matched, unmatched, match
    rate in per cent (0 for no lines), and the lines of every account.

    One group-by over the lines; the totals are sums over one row per account.
    """
    by = predicted.groupBy(F.col("predicted_account").alias("account")).agg(F.count(F.lit(1)).alias("n"))
    known = F.col("account").isNotNull()
    totals = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("m"))
    t, m = F.col("t").cast("double"), F.col("m").cast("double")
    rows = {"total": t, "matched": m, "unmatched": t - m, "match_rate": F.coalesce(F.try_divide(m * 100, t), F.lit(0.0))}
    head = totals.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.lit(None).cast("string").alias("account"), v.alias("value"))
                                             for k, v in rows.items()])).alias("r")).select("r.*")
    # exploded, not filtered: a filter would be pushed below the group-by and repeat the rules
    one = F.array(F.struct(F.lit("account").alias("metric"), F.col("account"), F.col("n").cast("double").alias("value")))
    return head.unionByName(by.select(F.explode(F.when(known, one).otherwise(F.array_except(one, one))).alias("r")).select("r.*"))


# ------------------------------------------------------------------- SQL twin

def condition_sql(rule: AccountRule) -> str:
    def q(v: object) -> str:
        return "'" + str(v).replace("'", "''") + "'"

    amount = "TRY_CAST(entry_amount AS DOUBLE)"
    by = {
        "departments": lambda v: f"department IN ({', '.join(map(q, v))})",
        "department": lambda v: f"starts_with(department, {q(v)})",
        "supplier": lambda v: f"supplier = {q(v)}",
        "product_code": lambda v: f"product_code = {q(v)}",
        "keywords": lambda v: f"regexp_matches(item_description, {q(f'(?i)(?:{v})')})",
        "min_amount": lambda v: f"{amount} >= {float(v)}",
        "max_amount": lambda v: f"{amount} < {float(v)}",
    }
    return " AND ".join(f"coalesce({by[k](v)}, false)" for k, v in rule.stated().items()) or "true"


def predict_sql(source: str, rules: list[AccountRule]) -> str:
    """The prediction as one CASE per output, each over the same conditions."""
    def q(v: str | None) -> str:
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'"

    number = " ".join(f"WHEN {condition_sql(r)} THEN {no}" for no, r in enumerate(rules, 1))
    values = ", ".join(f"({no}, {q(r.account)}, {q(r.liability)}, {q(r.note)})" for no, r in enumerate(rules, 1))
    return f"""SELECT s.*, k.account AS predicted_account, k.liability AS predicted_liability, k.note AS matched_conditions
FROM (SELECT *, CASE {number} END AS predicted_rule FROM {source}) s
LEFT JOIN (VALUES {values}) k(no, account, liability, note) ON k.no = s.predicted_rule"""
