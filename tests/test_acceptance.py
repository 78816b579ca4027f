"""Acceptance quantities and reconciliation on literal rows."""

import pytest
from pyspark.sql import functions as F

from closebook.operators import acceptance as AC

RUN = 202510
SHEET = "_ord string, po_number string, discount string, accepted_on string, " + ", ".join(f"`{c}` bigint" for c in AC.CABINETS)


def sheet(spark, rows):
    """rows: (order, document, discount, date, {type: quantity})."""
    return spark.createDataFrame([(o, p, d, a, *[q.get(c) for c in AC.CABINETS]) for o, p, d, a, q in rows], SHEET)


@pytest.mark.parametrize("text, cabinet", [
    ("門市智取櫃工程SPX locker XA 第二期款項 #SP", "XA"), ("locker XA第一期", "XA"), ("LOCKER a", "A"), ("locker AB", None), ("locker XA30 #", "XA30"),
    ("locker XA3", None), ("locker 控制主機", "DA"), ("locker控制主櫃", "DA"), ("locker 控制系統", "控制系統"), ("locker 安裝運費", "裝運費"),
    ("locker 裝運費", None), ("locker 超出櫃體運費", "超出櫃體運費"), ("locker K", "K"), ("locker L", None), ("no type", None), (None, None),
    ("locker B, locker 控制系統", "控制系統"), ("locker C locker A", "A")])
def test_type_by_priority(spark, text, cabinet):
    df = spark.createDataFrame([(text,)], "t string").select(AC.cabinet_by_priority(F.col("t")).alias("c"))
    assert df.first().c == cabinet


def test_totals_of_a_month_split_by_discount(spark):
    s = sheet(spark, [("1", "P1", None, "2025/10/01", {"A": 2, "B": 1}), ("2", "P1", "", "2025-10-31", {"A": 3}), ("3", "P1", "8折驗收", "2025/10/5", {"A": 7}),
                      ("4", "P1", "9折", "2025/10/5", {"C": 4}), ("5", "P1", None, "2025/09/30", {"A": 100}), ("6", "P2", None, None, {"A": 1}),
                      ("7", "P2", None, "soon", {"A": 1}), ("8", None, None, "2025/10/01", {"A": 1})])
    kiosks = spark.createDataFrame([("P1", "2025/10/02"), ("P1", "2025-10-03"), ("P1", "2025/11/03"), (None, "2025/10/02")], "po_number string, accepted_on string")
    rows = AC.acceptance_totals(s, kiosks, RUN).collect()
    got = {(r.po_number, r.kind, r.cabinet_type): r.quantity for r in rows if r.quantity}
    assert got == {("P1", "plain", "A"): 5, ("P1", "plain", "B"): 1, ("P1", "plain", "C"): 4, ("P1", "discount", "A"): 7, ("P1", "kiosk", "kiosk"): 2}
    assert len(rows) == 2 * len(AC.CABINETS) + 1
    assert AC.month_rate(s, RUN).first().rate == 0.8
    assert AC.month_rate(s, 202001).first().rate is None


LINES = ("po_number string, po_line string, supplier string, item_description string, unit_price decimal(18,2), product_code string, currency string, "
         "accrue string, account_code string, accr_amount double")
TOTALS = "po_number string, kind string, cabinet_type string, quantity bigint"


def applied(spark, lines, totals, rate=0.8):
    df = spark.createDataFrame([(p, str(i), s, d, 10, "BR1", "TWD", "N", "old", None) for i, (p, s, d) in enumerate(lines)],
                               LINES.replace("decimal(18,2)", "int"))
    rates = spark.createDataFrame([(rate,)], "rate double")
    return AC.apply_quantities(df, spark.createDataFrame(totals, TOTALS), rates, ["S1"], ["S1", "K1"])


T = [("P", "plain", "A", 5), ("P", "plain", "B", 0), ("P", "discount", "A", 3), ("P", "discount", "B", 4), ("P", "kiosk", "kiosk", 2), ("Q", "plain", "A", 9)]
M = "門市智取櫃工程SPX "


def test_plain_then_discounted_then_kiosk(spark):
    lines = [("P", "S1", M + "locker A #"), ("P", "S1", M + "locker A 減價"), ("P", "S1", M + "locker B"), ("P", "S1", M + "locker C"), ("P", "S2", M + "locker A"),
             ("P", "S1", "locker A"), ("Q", "S1", M + "locker A"), ("Q", "S1", M + "locker A 減價"), ("R", "S1", M + "locker A"), ("P", "K1", "門市繳費機"),
             ("P", "S2", "門市繳費機"), ("Q", "K1", "門市繳費機"), (None, "S1", M + "locker A"), ("P", None, M + "locker A"), ("P", "S1", None)]
    got = {int(r.po_line): (r.accepted_qty, r.discount) for r in applied(spark, lines, T).collect()}
    assert got == {0: (5, None), 1: (3, 0.8), 2: (4, 0.8), 3: (0, None), 4: (0, None), 5: (0, None), 6: (9, None), 7: (0, None), 8: (0, None),
                   9: (2, None), 10: (0, None), 11: (0, None), 12: (0, None), 13: (0, None), 14: (0, None)}


def test_accounting_fields_of_accepted_lines(spark):
    lines = [("P", "S1", M + "locker A"), ("P", "S1", M + "locker B"), ("P", "S1", M + "locker A 運費"), ("P", "S1", "x")]
    out = AC.accepted_fields(applied(spark, lines, T), "199999", "TW", "000")
    got = {int(r.po_line): (r.accrue, r.account_code, r.accr_amount, r.liability, r.accr_currency) for r in out.collect()}
    assert got == {0: ("Y", "199999", 50.0, AC.CLEARING_LIABILITY, "TWD"), 1: ("Y", "199999", 32.0, AC.CLEARING_LIABILITY, "TWD"),
                   2: ("Y", "199999", 5.0, AC.CLEARING_LIABILITY, "TWD"), 3: ("N", "old", None, None, None)}


def test_operations_totals_read_cells(spark):
    ddl = "po_number string, accepted_on string, " + ", ".join(f"`{c}` string" for c in AC.CABINETS)
    row = lambda p, a, **q: (p, a, *[q.get(c) for c in AC.CABINETS])
    df = spark.createDataFrame([row("P", "2025/09/01", A="2", B="#REF!", 裝運費="50"), row("P", "2025-08-01", A="1.5", B=""), row("P", "2025/10/01", A="7"),
                                row("Q", None, A="1"), row("R", "2025/09/01")], ddl)
    rows = AC.operations_totals(df, RUN).collect()
    got = {(r.po_number, r.locker_type): r.amount for r in rows if r.amount}
    assert got == {("P", "A"): 3.5, ("P", "裝運費"): 50.0}
    assert {(r.po_number, r.ops_locker_count) for r in rows} == {("P", 3.5), ("R", 0.0)}


@pytest.mark.parametrize("text, name", [("x SPX locker XA 第一期款項", "XA"), ("SPX locker XA訂金", "XA"), ("SPX locker 控制主機 30%款項", "DA"), ("SPX locker 控制主櫃 #", "DA"),
                                        ("SPX locker 安裝運費 #x", "裝運費"), ("SPX locker XA30 #", "XA30"), ("SPX locker A", None), (None, None)])
def test_type_named_in_a_line(spark, text, name):
    assert spark.createDataFrame([(text,)], "t string").select(AC.cabinet_in_text(F.col("t")).alias("c")).first().c == name


def test_accounting_totals_of_distinct_rows(spark):
    d = "SPX locker {} #"
    df = spark.createDataFrame([("P", "3", d.format("A")), ("P", "3", d.format("A")), ("P", "4", d.format("A")), ("P", "", d.format("B")), ("P", None, d.format("B")),
                                ("P", "9", "none"), (None, "1", d.format("A"))], "po_number string, cumulative_qty string, item_description string")
    got = {r.locker_type: (r.memo_sum, r.accounting_locker_count) for r in AC.accounting_totals(df).collect()}
    assert got == {"A": (7.0, 4), "B": (0.0, 4)}


def test_outcomes_order_and_report(spark):
    acc = spark.createDataFrame([("P", "A", 2.0), ("P", "B", 3.0), ("R", "A", 0.0)], "po_number string, locker_type string, memo_sum double")
    ops = spark.createDataFrame([("P", "A", 2.0), ("P", "B", 4.0), ("Q", "A", 0.0)], "po_number string, locker_type string, amount double")
    c = AC.reconcile(acc, ops)
    assert [(r.po_number, r.locker_type, r.status) for r in AC.ordered(c).collect()] == [
        ("P", "B", "mismatched"), ("P", "A", "matched"), ("Q", "A", "ops_only"), ("R", "A", "accounting_only")]
    got = {r.metric: r.value for r in AC.reconcile_report(c).collect()}
    assert got == {"total": 4, "matched": 1, "mismatched": 1, "accounting_only": 1, "ops_only": 1, "match_rate": 25.0}
    assert {r.metric: r.value for r in AC.reconcile_report(c.limit(0)).collect()}["match_rate"] == 0.0


def test_standardised_sheet(spark):
    df = spark.createDataFrame([(" 10.0 ", "2025/9/3"), ("1.05", "2025-09-30"), (None, "2025/09/01"), ("x", None), ("y", "n/a")], "line string, accepted_on string")
    got = sorted((str(r.line), str(r.accepted_on)) for r in AC.standardised(df, ["line", "accepted_on"]).collect())
    assert got == [("1.05", "2025-09-01"), ("10", "2025-09-01"), ("None", "2025-09-01")]
    with pytest.raises(ValueError, match="po_number"):
        AC.standardised(df, ["po_number", "accepted_on"])


@pytest.mark.parametrize("text, tag", [("門市裝修工程 第一期款項", "分期"), ("裝修", "一般"), ("第二期款項", None), (None, None)])
def test_installment_tag(spark, text, tag):
    assert spark.createDataFrame([(text,)], "t string").select(AC.installment_flag(F.col("t")).alias("c")).first().c == tag
