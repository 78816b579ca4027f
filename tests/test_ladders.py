"""The ladders on literal rows: priorities, missing values, later writes."""

import pytest

from closebook.operators import ladders as L
from closebook.plans import q_ladders as Q

FIELDS = ("item_description gl_number account_code product_code fn_remark status task department entry_qty received_qty cross_month "
          "proc_remark supplier line_status receipt_month closed_for_invoice closed_mark accrue accrual_note early entry_amount").split()
SCHEMA = ", ".join(f"{c} {'bigint' if c.endswith(('_qty', '_amount')) else 'string'}" for c in FIELDS)


@pytest.fixture
def one(spark):
    """Runs a ladder on one line, other fields null, and gives the named columns."""
    def run(ladder, *out, **given):
        row = ladder(spark.createDataFrame([tuple(given.get(c) for c in FIELDS)], SCHEMA)).select(*out).first()
        return tuple(row)
    return run


def test_date_logic_profit_share_before_posted(one):
    assert one(L.date_logic, "status", "accrue", item_description="x 分潤合作", closed_for_invoice="1") == ("分潤", None)
    assert one(L.date_logic, "status", "accrue", status="nan", closed_for_invoice="1", accrue="Y") == ("posted", "N")
    assert one(L.date_logic, "status", "accrue", status="held", closed_for_invoice="1", accrue="Y") == ("held", "Y")


def test_commission_later_kind_wins_and_accrues(one):
    run = lambda df: L.commission(df, Q.COMMISSIONS)
    both = "Affiliate commission Affiliate分潤合作 品牌加碼"
    assert one(run, "gl_number", "product_code", item_description=both) == ("650019", "EC_AMS_COST")
    assert one(run, "gl_number", "fn_remark", item_description="Shopee commission 品牌加碼", gl_number="1") == ("1", None)
    assert one(run, "account_code", "accrue", item_description="affiliate COMMISSION", status="x已完成") == ("650022", "Y")
    assert one(run, "accrue", gl_number="650022", fn_remark="分潤", status="已完成", accrue="N") == ("Y",)


def test_payroll_keeps_remarks(one):
    assert one(L.payroll, "fn_remark", "status", task="Payroll", fn_remark="nan", status="s") == ("Payroll", "s")
    assert one(L.payroll, "fn_remark", "status", item_description="PAYROLL") == ("Payroll", "Payroll")
    assert one(L.payroll, "fn_remark", "status", task="Payroll", fn_remark="by hand") == ("by hand", None)


def test_department_override(one):
    run = lambda df: L.department_override(df, Q.DEPARTMENT_CODES)
    code = lambda **k: one(run, "department_code", **k)[0]
    assert code(department="305 IT") == "305" and code(department="305 IT", account_code="512") == "000"
    assert code(department="xa_ops", account_code="512") == "100" and code(department="team") == "999" and code() == "999"


def test_accrual_veto_beats_all(one):
    run = lambda df: L.accrual_decision(df, ("171000",))
    assert one(run, "accrue", "accrual_note", cross_month="Y", proc_remark="勿估") == ("N", "採購備註-不預估")
    assert one(run, "accrue", "account_code", status="部分收貨", entry_qty=10, received_qty=8, gl_number="171000") == ("Y", "171000")
    assert one(run, "accrue", status="部分收貨", entry_qty=0, received_qty=8) == ("N",)


def test_deposit_and_rent(one):
    dep = lambda df: L.deposit_type(df, "199999", Q.DEPOSIT_WORDS)
    assert one(dep, "deposit_type", "accrue", gl_number="199999", accrue="Y") == ("其他押金", "N")
    assert one(dep, "deposit_type", item_description="Lease DEPOSIT") == ("租賃押金",)
    rent = lambda df: L.rent_type(df, 199806, "622101", "unitops07")
    assert one(rent, "rent_type", "rent_period", "rent_state", item_description="office rent 1998-7") == ("辦公室租金", "199807", "預付租金-不預估")
    assert one(rent, "rent_type", "rent_state", gl_number="622101", department="UnitOps07 x") == ("OPS倉庫租金", "待判斷")
    assert one(rent, "rent_mark", "rent_period", "rent_state", item_description="1998/01") == (None, None, None)


def test_asset_and_complex_status(one):
    asset = lambda df: L.asset_type(df, ("S1",), ("S1",))
    assert one(asset, "asset_type", "acceptance", "accrue", supplier="S1") == ("Locker", "待驗收", "N")
    assert one(asset, "acceptance", "accrue", item_description="kiosk", line_status="已驗收") == ("已驗收", "Y")

    def merged(df):
        df = L.rent_type(L.deposit_type(df, "199999", Q.DEPOSIT_WORDS), 199806, "622101", "unitops07")
        return L.complex_status(asset(df), 199806)

    assert one(merged, "status", gl_number="199999", supplier="S1", closed_mark="Y") == ("待驗收",)
    assert one(merged, "status", gl_number="199999", closed_mark="Y") == ("押金項目",)
    assert one(merged, "status", "condition", receipt_month="1998-05", entry_qty=2, received_qty=1) == ("部分收貨", "標準判斷")
    assert one(merged, "status", receipt_month="199807") == ("未到期",) and one(merged, "status", receipt_month="x") == ("資訊不足",)


def test_completion_and_asset_class(one):
    run = lambda df: L.completion_status(df.drop("cross_month"), 199806)
    done = lambda **k: one(run, "completion_status", **({"receipt_month": "1998-06", "entry_qty": 10} | k))[0]
    assert done(receipt_month="1998-07", received_qty=10) == "提早完成" and done(receipt_month="199807", received_qty=9) == "未到期"
    assert [done(received_qty=n) for n in (10, 8, 5, 1, 0, None)] == ["已完成", "接近完成", "部分收貨", "少量收貨", "待收貨", "待收貨"]
    assert done(line_status="Closed", received_qty=10) == "已關單" and done(line_status="Closed", early="Y") == "提早完成"
    assert done(receipt_month="x", line_status="Closed") == "資訊不足"
    assert one(L.ppe_class, "capitalised", "ppe_class", "fa_accrue", gl_number="151101", item_description="Computer", entry_amount=10000,
               status="已完成") == ("Y", "IT設備", "資本化-預估")
    assert one(L.ppe_class, "capitalised", "ppe_class", "fa_accrue", gl_number="199999", entry_amount=9999) == ("N", "押金及預付", "未完成-不預估")
    assert one(L.ppe_class, "is_fa", "ppe_class", gl_number="5") == ("N", None)
    adjust = lambda df: L.accounting_adjust(df, ("171000",))
    assert one(adjust, "accrue", "is_fa", "department_code", status="已完成", gl_number="171000", department="305 IT") == ("Y", "Y", "000")
    assert one(adjust, "account_code", "department_code", gl_number="171000", department="305 IT") == (None, "305")


def test_worksheet_headers(spark):
    from closebook.operators import worksheets as W

    df = spark.createDataFrame([("P1", "-2", 5, "Y"), ("P2", "-1", 6, "N")], ["PO#", "Line#", "Accr. Amount", "Use"])
    out = W.prepare_worksheet(df, "use", "Y", ["po_line", "amount", "none"], {"amount": ["accr._amount"]}, {"po_line": ["po#", "line#"]})
    assert out.columns == ["po_line", "amount"] and [tuple(r) for r in out.collect()] == [("P1-2", 5)]
    with pytest.raises(ValueError):
        W.prepare_worksheet(spark.createDataFrame([(1, 2)], ["PO Line", "po_line"]), "use", "Y", ["po_line"], {})
