"""Acceptance quantities and their reconciliation (A-05 to A-08, D-03, F-19 to
F-23, J-16, J-17).

The acceptance sheet has one column per cabinet type.  It is summed per document
while still wide (25 sums a row, combined before the shuffle) and only the sums
are unpivoted to (document, type) rows, which the lines join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closebook.functions.numbers import parse_double
from closebook.functions.text import discount_rate
from closebook.operators.documents import has

# The sheet's type columns, fee columns last.
CABINETS = ("A", "B", "C", "D", "E", "F", "G", "H", "I", "J", "K", "DA", "控制系統",
            "XA", "XB", "XC", "XD", "XE", "XF", "XA30", "XC30", "XG",
            "超出櫃體安裝費", "超出櫃體運費", "裝運費")
FEE = "費"
# Types whose text in a description is not their column name.
CABINET_TEXTS = {"DA": "控制主[櫃|機]", "裝運費": "安裝運費"}
# Fixed value: named types are tried first, then the letter codes.
NAMED_FIRST = ("DA", "控制系統", "裝運費", "超出櫃體安裝費", "超出櫃體運費")
# Marks in descriptions and in the discount column.
CABINET_MARK, KIOSK_MARK, REDUCED_MARK = "門市智取櫃", "門市繳費機", "減價"
DISCOUNT = r"\d折驗收|\d折出貨"
FEE_LINE = "運費|安裝費"
# Accounting fields of accepted lines.
CLEARING_NAME, CLEARING_LIABILITY = "AP,FA Clear Account", "200414"
KIOSK = "kiosk"


def priority() -> list[str]:
    return [*NAMED_FIRST, *[c for c in CABINETS if c not in NAMED_FIRST]]


def cabinet_pattern(cabinet: str) -> str:
    """The type after ``locker``; a letter code must not run on into letters or
    digits (CJK text may follow)."""
    text = CABINET_TEXTS.get(cabinet, cabinet)
    return rf"locker\s*{text}" + (r"(?![A-Za-z0-9])" if text.isascii() else "")


def cabinet_by_priority(text: Column) -> Column:
    """F-21: the first type of the priority list that the text names; else null."""
    case = None
    for c in priority():
        case = F.when(has(text, cabinet_pattern(c)), F.lit(c)) if case is None else case.when(has(text, cabinet_pattern(c)), F.lit(c))
    return case


def in_month(sheet: DataFrame, month: int, column: str = "accepted_on") -> DataFrame:
    """Rows accepted in a month (YYYYMM); missing or unreadable dates go."""
    d = F.try_to_timestamp(F.regexp_replace(F.trim(column), "/", "-"), F.lit("yyyy-M-d"))
    return sheet.where(F.year(d) * 100 + F.month(d) == month)


def acceptance_totals(sheet: DataFrame, kiosks: DataFrame, month: int) -> DataFrame:
    """A-05: (po_number, kind, cabinet_type, quantity) of one month — kinds
    ``plain`` and ``discount`` with a row for every type, and ``kiosk`` with the
    number of sheet rows of the document."""
    rows = in_month(sheet, month).where(F.col("po_number").isNotNull())
    kind = F.when(F.coalesce(F.rlike("discount", F.lit(DISCOUNT)), F.lit(False)), F.lit("discount")).otherwise(F.lit("plain"))
    wide = rows.withColumn("kind", kind).groupBy("po_number", "kind").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in CABINETS])
    long = wide.unpivot(["po_number", "kind"], list(CABINETS), "cabinet_type", "quantity")
    machines = in_month(kiosks, month).where(F.col("po_number").isNotNull()).groupBy("po_number").agg(F.count(F.lit(1)).alias("quantity"))
    return long.unionByName(machines.select("po_number", F.lit(KIOSK).alias("kind"), F.lit(KIOSK).alias("cabinet_type"), "quantity"))


def month_rate(sheet: DataFrame, month: int, order: str = "_ord") -> DataFrame:
    """One row: the discount rate of the month, read from its first discounted row."""
    rows = in_month(sheet, month).where(F.rlike("discount", F.lit(DISCOUNT)) & F.col("po_number").isNotNull())
    return rows.agg(F.min_by("discount", order).alias("d")).select(discount_rate(F.col("d")).alias("rate"))


def apply_quantities(lines: DataFrame, totals: DataFrame, rate: DataFrame, cabinet_suppliers: list[str],
                     kiosk_suppliers: list[str]) -> DataFrame:
    """J-17: ``lines`` with accepted_qty, discount and cabinet_type.

    A cabinet line of a listed supplier takes the plain quantity of its document
    and type unless it is a reduced one; lines still at 0 take the discounted
    quantity, with the month's rate; lines still at 0 that name a kiosk take the
    document's kiosk count.
    """
    text = F.col("item_description")
    cabinet = has(text, CABINET_MARK) & F.coalesce(F.col("supplier").isin(cabinet_suppliers), F.lit(False))
    kiosk = has(text, KIOSK_MARK) & F.coalesce(F.col("supplier").isin(kiosk_suppliers), F.lit(False))
    by = (totals.where(F.col("kind") != KIOSK).groupBy("po_number", "cabinet_type")
          .agg(*[F.max(F.when(F.col("kind") == k, F.col("quantity"))).alias(f"_{k}") for k in ("plain", "discount")]))
    machines = totals.where(F.col("kind") == KIOSK).select("po_number", F.col("quantity").alias("_kiosk"))
    out = (lines.withColumn("cabinet_type", F.when(cabinet, cabinet_by_priority(text)))
           .join(by, ["po_number", "cabinet_type"], "left").join(machines, "po_number", "left"))
    first = F.when(~has(text, REDUCED_MARK), F.coalesce("_plain", F.lit(0))).otherwise(F.lit(0))
    second = (first == 0) & F.col("_discount").isNotNull()
    qty = F.when(second, F.col("_discount")).otherwise(first)
    out = out.withColumn("_qty", qty).withColumn("discount", F.when(second, rate.select("rate").scalar()))
    return (out.withColumn("accepted_qty", F.when((F.col("_qty") == 0) & kiosk, F.coalesce("_kiosk", F.lit(0))).otherwise(F.col("_qty")).cast("bigint"))
            .drop("_plain", "_discount", "_kiosk", "_qty"))


def accepted_fields(lines: DataFrame, clearing_account: str, region: str, department: str) -> DataFrame:
    """D-03: accounting fields of lines with an accepted quantity; amount is
    price × quantity × discount, for fee lines the quantity itself."""
    hit = F.col("accepted_qty") != 0
    amount = F.col("unit_price").cast("double") * F.col("accepted_qty") * F.coalesce("discount", F.lit(1.0))
    amount = F.when(has(F.col("item_description"), FEE_LINE), F.col("accepted_qty").cast("double")).otherwise(amount)
    new = {"accrue": F.lit("Y"), "account_code": F.lit(clearing_account), "account_name": F.lit(CLEARING_NAME), "accr_product": F.col("product_code"),
           "accr_region": F.lit(region), "accr_dept": F.lit(department), "accr_currency": F.col("currency"), "accr_amount": amount,
           "liability": F.lit(CLEARING_LIABILITY)}
    return lines.withColumns({k: F.when(hit, v).otherwise(F.col(k) if k in lines.columns else F.lit(None)) for k, v in new.items()})


# ------------------------------------------------------------ reconciliation

# Fixed value: a cabinet named in a line's text, up to the instalment.
CABINET_IN_TEXT = r"SPX\s+locker\s+([A-Z]{1,2}|控制主[櫃機]|[^\s]+?)(?:\s*第[一二]期款項|\s*訂金|\s*\d+%款項|\s*#)"
# Names in line texts and in the operations sheet.
RENAMED = (("主機", "主櫃"), ("控制主櫃", "DA"), ("安裝運費", "裝運費"))


def cabinet_in_text(text: Column) -> Column:
    """F-19: the cabinet type that a line names, as the operations sheet calls it."""
    found = F.trim(F.regexp_extract(text, CABINET_IN_TEXT, 1))
    return F.nullif(reduce(lambda c, ab: F.replace(c, F.lit(ab[0]), F.lit(ab[1])), RENAMED, found), F.lit(""))


def cell_number(cell: Column) -> Column:
    """A cell of the operations sheet: broken references, blanks and nulls count 0."""
    return F.when(F.contains(cell, F.lit("REF")), 0.0).otherwise(F.coalesce(parse_double(cell), F.lit(0.0)))


def operations_totals(sheet: DataFrame, before: int, column: str = "accepted_on") -> DataFrame:
    """A-06: (po_number, locker_type, amount, ops_locker_count) of the rows
    accepted before a month; the count leaves fee columns out."""
    d = F.try_to_timestamp(F.regexp_replace(F.trim(column), "/", "-"), F.lit("yyyy-M-d"))
    rows = sheet.where((F.year(d) * 100 + F.month(d) < before) & F.col("po_number").isNotNull())
    wide = rows.groupBy("po_number").agg(*[F.sum(cell_number(F.col(c))).alias(c) for c in CABINETS])
    wide = wide.withColumn("ops_locker_count", sum((F.col(c) for c in CABINETS if FEE not in c), F.lit(0.0)))
    return wide.unpivot(["po_number", "ops_locker_count"], list(CABINETS), "locker_type", "amount")


def accounting_totals(lines: DataFrame) -> DataFrame:
    """A-07: (po_number, locker_type, memo_sum, accounting_locker_count) over the
    distinct (document, cumulative quantity, type); blank quantities count 0."""
    typed = lines.withColumn("locker_type", cabinet_in_text(F.col("item_description"))).where(F.col("locker_type").isNotNull())
    unique = typed.where(F.col("po_number").isNotNull()).select("po_number", "cumulative_qty", "locker_type").distinct()
    by = unique.groupBy("po_number", "locker_type").agg(
        F.coalesce(F.sum(parse_double(F.col("cumulative_qty"))), F.lit(0.0)).alias("memo_sum"), F.count(F.lit(1)).alias("_n"))
    docs = by.groupBy("po_number").agg(F.sum("_n").alias("accounting_locker_count"))
    return by.drop("_n").join(docs, "po_number")


def reconcile(accounting: DataFrame, operations: DataFrame) -> DataFrame:
    """J-16: full outer join on (document, type) with the outcome of each pair."""
    keys = ["po_number", "locker_type"]
    j = accounting.select(*keys, "memo_sum").join(operations.select(*keys, "amount"), keys, "full_outer")
    status = (F.when(F.col("memo_sum").isNull(), F.lit("ops_only")).when(F.col("amount").isNull(), F.lit("accounting_only"))
              .when(F.col("memo_sum") == F.col("amount"), F.lit("matched")).otherwise(F.lit("mismatched")))
    return j.withColumn("status", status)


def ordered(compared: DataFrame) -> DataFrame:
    """O-04: by document, types falling."""
    return compared.orderBy(F.col("po_number").asc(), F.col("locker_type").desc())


OUTCOMES = ("matched", "mismatched", "accounting_only", "ops_only")


def reconcile_report(compared: DataFrame) -> DataFrame:
    """A-08: rows (metric, value): total, one count per outcome, match rate in
    per cent (0 for no rows), in one pass."""
    counts = compared.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in OUTCOMES])
    value = {k: F.col(k).cast("double") for k in ("total", *OUTCOMES)}
    value["match_rate"] = F.coalesce(F.try_divide(F.col("matched") * F.lit(100.0), F.col("total")), F.lit(0.0))
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in value.items()])).alias("r")).select("r.*")


# ------------------------------------------------------------- sheet, texts

def standardised(sheet: DataFrame, required: list[str], month: str = "accepted_on") -> DataFrame:
    """S-24: the sheet as text without blanks around and without a trailing
    ``.0``, its month as a first-of-month date, rows without one left out.
    A missing required column raises."""
    missing = [c for c in required if c not in sheet.columns]
    if missing:
        raise ValueError(f"columns missing in the sheet: {', '.join(missing)}")
    clean = {c: F.regexp_replace(F.trim(F.col(c).cast("string")), r"\.0$", "") for c in required if c != month}
    d = F.try_to_timestamp(F.regexp_replace(F.trim(month), "/", "-"), F.lit("yyyy-M-d"))
    out = sheet.withColumns(clean).withColumn(month, F.trunc(d, "month"))
    return out.where(F.col(month).isNotNull()).select(*required)


# The words of the instalment tag and its two values.
DECORATION, INSTALMENT = "裝修", "第[一|二|三]期款項"
BY_INSTALMENT, GENERAL = "分期", "一般"


def installment_flag(text: Column) -> Column:
    """F-23: decoration with an instalment, decoration alone, or null."""
    deco = has(text, DECORATION)
    return F.when(deco & has(text, INSTALMENT), F.lit(BY_INSTALMENT)).when(deco, F.lit(GENERAL))
