"""Status and flag ladders (D-05 to D-07, L-01 to L-09)."""

from __future__ import annotations

from closebook.operators import ladders as L
from closebook.plans.registry import register
from closebook.sources import adapter as A
from closebook.sources.adapter_sql import RUN_MONTH
from closebook.sources.testdata import Tables

# Accounts, products and words of the two kinds of commission.
COMMISSIONS = [
    L.Commission("650022", "EC_SPE_COM", "Affiliate commission|Shopee commission|蝦皮分潤計劃會員分潤金", exclude="品牌加碼"),
    L.Commission("650019", "EC_AMS_COST", "AMS commission", both=("Affiliate分潤合作", "品牌加碼")),
]
# Our own department names; a later one wins.
DEPARTMENT_CODES = [("XA_OPS", "100"), ("XA_HQ", "000"), ("unitops", "100")]
DEPOSIT_ACCOUNT, DEPOSIT_WORDS, RENT_ACCOUNT, OPS_DEPARTMENT = "199999", "押金|保證金|deposit|找零金", "622101", "unitops07"
KIOSK_SUPPLIERS, LOCKER_SUPPLIERS = ("S1", "S2"), ("S2", "S3")


def _m(col: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({col}, '(?i){pattern}'), false)"


def _lines(spark, sf):
    return A.ladder_lines(Tables(spark, sf))


@register("date_logic", """
SELECT po_line, status, CASE WHEN status = 'posted' THEN 'N' ELSE accrue END AS accrue
FROM (SELECT po_line, accrue, CASE WHEN (status IS NULL OR status = 'nan') AND item_description LIKE '%分潤合作%' THEN '分潤'
  WHEN (status IS NULL OR status = 'nan') AND closed_for_invoice = '1' THEN 'posted' ELSE status END AS status FROM ladder_lines) x""")
def date_logic(spark, sf):
    """D-05: profit share, then posted, on lines without a status."""
    return L.date_logic(_lines(spark, sf)).select("po_line", "status", "accrue")


_AMS = f"({_m('item_description', 'AMS commission')} OR (coalesce(item_description LIKE '%Affiliate分潤合作%', false) AND item_description LIKE '%品牌加碼%'))"
_AFF = f"({_m('item_description', COMMISSIONS[0].words)} AND NOT coalesce(item_description LIKE '%品牌加碼%', false))"


@register("commission_update", f"""
SELECT po_line, gl_number, account_code, product_code, fn_remark,
  CASE WHEN gl_number IN ('650022', '650019') AND fn_remark = '分潤' AND status LIKE '%已完成%' THEN 'Y' ELSE accrue END AS accrue
FROM (SELECT po_line, status, accrue, CASE WHEN ams THEN '650019' WHEN aff THEN '650022' ELSE gl_number END AS gl_number,
    CASE WHEN ams THEN '650019' WHEN aff THEN '650022' ELSE account_code END AS account_code,
    CASE WHEN ams THEN 'EC_AMS_COST' WHEN aff THEN 'EC_SPE_COM' ELSE product_code END AS product_code,
    CASE WHEN ams OR aff THEN '分潤' ELSE fn_remark END AS fn_remark
  FROM (SELECT *, {_AMS} AS ams, {_AFF} AS aff FROM ladder_lines) m) x""")
def commission_update(spark, sf):
    """D-06: two kinds of commission; the later kind wins."""
    return L.commission(_lines(spark, sf), COMMISSIONS).select("po_line", "gl_number", "account_code", "product_code", "fn_remark", "accrue")


@register("payroll_detect", f"""
SELECT po_line, CASE WHEN hit THEN 'Payroll' ELSE fn_remark END AS fn_remark, CASE WHEN hit AND status IS NULL THEN 'Payroll' ELSE status END AS status
FROM (SELECT *, ({_m('task', 'payroll')} OR {_m('item_description', 'payroll')}) AND (fn_remark IS NULL OR fn_remark IN ('', 'nan')) AS hit FROM ladder_lines) x""")
def payroll_detect(spark, sf):
    """D-07: payroll by task or description where the remark is empty."""
    return L.payroll(_lines(spark, sf)).select("po_line", "fn_remark", "status")


@register("department_override", """
SELECT po_line, CASE WHEN regexp_full_match(code, '[0-9]{3}') THEN code ELSE '999' END AS department_code
FROM (SELECT po_line, CASE WHEN contains(lower(department), 'unitops') THEN '100' WHEN contains(lower(department), 'xa_hq') THEN '000'
  WHEN contains(lower(department), 'xa_ops') THEN '100' WHEN left(account_code, 1) IN ('1', '2', '4', '5', '9') THEN '000'
  ELSE left(department, 3) END AS code FROM ladder_lines) x""")
def department_override(spark, sf):
    """L-02: department code with overrides by account and name."""
    return L.department_override(_lines(spark, sf), DEPARTMENT_CODES).select("po_line", "department_code")


@register("accrual_decision", f"""
SELECT po_line, accrue, accrual_note, is_fa, CASE WHEN accrue = 'Y' THEN gl_number ELSE account_code END AS account_code
FROM (SELECT po_line, gl_number, account_code, CASE WHEN veto THEN 'N' WHEN cross_month = 'Y' OR status IN ('已完成', '提早完成', '接近完成')
    OR (status = '部分收貨' AND entry_qty <> 0 AND CAST(received_qty AS DOUBLE) / entry_qty >= 0.8) THEN 'Y' ELSE 'N' END AS accrue,
    CASE WHEN veto THEN '採購備註-不預估' WHEN cross_month = 'Y' THEN '跨月項目-全額預估' END AS accrual_note,
    CASE WHEN gl_number = '171000' THEN 'Y' ELSE 'N' END AS is_fa
  FROM (SELECT *, {_m('proc_remark', '不預估|不估計|勿估|暫緩')} AS veto FROM ladder_lines) v) x""")
def accrual_decision(spark, sf):
    """L-03: accrual by status, share received and month end, with a veto."""
    return L.accrual_decision(_lines(spark, sf), (A.FA_ACCOUNT,)).select("po_line", "accrue", "accrual_note", "is_fa", "account_code")


_DEP = f"({_m('item_description', DEPOSIT_WORDS)} OR coalesce(gl_number = '{DEPOSIT_ACCOUNT}', false))"
_RENT = f"({_m('item_description', '租金|Rent|租賃|Lease|月租')} OR coalesce(gl_number = '{RENT_ACCOUNT}', false))"
_OPS = f"coalesce(contains(lower(department), '{OPS_DEPARTMENT}'), false)"
_LOCKER = f"(supplier IN ('S2', 'S3') OR {_m('item_description', 'Locker|智能櫃')})"
_KIOSK = f"(supplier IN ('S1', 'S2') OR {_m('item_description', 'Kiosk|機台')})"
_ACCEPT = f"""CASE WHEN NOT {_LOCKER} AND NOT {_KIOSK} THEN NULL WHEN {_m('line_status', 'validated|驗收')} THEN '已驗收'
  WHEN received_qty >= entry_qty THEN '已收貨待驗收' WHEN received_qty > 0 THEN '部分收貨' ELSE '待驗收' END"""


def _type_sql(types, other):
    return "CASE " + " ".join(f"WHEN {_m('item_description', w)} THEN '{n}'" for n, w in types) + f" ELSE '{other}' END"


@register("deposit_type", f"""
SELECT po_line, CASE WHEN hit THEN 'Y' END AS deposit_mark, CASE WHEN hit THEN {_type_sql(L.DEPOSIT_TYPES, '其他押金')} END AS deposit_type,
  CASE WHEN hit THEN 'N' ELSE accrue END AS accrue, CASE WHEN hit THEN '押金項目-不預估' ELSE accrual_note END AS accrual_note
FROM (SELECT *, {_DEP} AS hit FROM ladder_lines) x""")
def deposit_type(spark, sf):
    """L-04: deposit mark and type."""
    out = L.deposit_type(_lines(spark, sf), DEPOSIT_ACCOUNT, DEPOSIT_WORDS)
    return out.select("po_line", "deposit_mark", "deposit_type", "accrue", "accrual_note")


@register("rent_type", f"""
SELECT po_line, rent_mark, rent_type, rent_period, CASE WHEN rent_mark IS NULL THEN NULL WHEN rent_period = '' THEN '待判斷'
  WHEN CAST(rent_period AS INTEGER) <= {RUN_MONTH} THEN '當期租金-預估' ELSE '預付租金-不預估' END AS rent_state
FROM (SELECT po_line, CASE WHEN hit THEN 'Y' END AS rent_mark,
    CASE WHEN hit AND {_OPS} THEN 'OPS倉庫租金' WHEN hit THEN {_type_sql(L.RENT_TYPES, '其他租金')} END AS rent_type,
    CASE WHEN NOT hit THEN NULL WHEN y = '' THEN '' ELSE y || lpad(m, 2, '0') END AS rent_period
  FROM (SELECT *, {_RENT} AS hit, regexp_extract(coalesce(item_description, ''), '([0-9]{{4}})[/-]([0-9]{{1,2}})', 1) AS y,
      regexp_extract(coalesce(item_description, ''), '([0-9]{{4}})[/-]([0-9]{{1,2}})', 2) AS m FROM ladder_lines) r) x""")
def rent_type(spark, sf):
    """L-05: rent mark, type, period and accrual state."""
    out = L.rent_type(_lines(spark, sf), RUN_MONTH, RENT_ACCOUNT, OPS_DEPARTMENT)
    return out.select("po_line", "rent_mark", "rent_type", "rent_period", "rent_state")


@register("asset_type", f"""
SELECT po_line, asset_type, acceptance, CASE acceptance WHEN '待驗收' THEN 'N' WHEN '已驗收' THEN 'Y' ELSE accrue END AS accrue,
  CASE acceptance WHEN '待驗收' THEN '資產待驗收-不預估' WHEN '已驗收' THEN '資產已驗收-預估' ELSE accrual_note END AS accrual_note
FROM (SELECT *, CASE WHEN {_LOCKER} THEN 'Locker' WHEN {_KIOSK} THEN 'Kiosk' END AS asset_type, {_ACCEPT} AS acceptance FROM ladder_lines) x""")
def asset_type(spark, sf):
    """L-06: kiosks and lockers and their acceptance."""
    out = L.asset_type(_lines(spark, sf), KIOSK_SUPPLIERS, LOCKER_SUPPLIERS)
    return out.select("po_line", "asset_type", "acceptance", "accrue", "accrual_note")


@register("complex_status", f"""
SELECT po_line, CASE WHEN acc = '已驗收' THEN '已驗收完成' WHEN acc = '待驗收' THEN '待驗收' WHEN ops THEN 'OPS倉租' WHEN dep THEN '押金項目'
    WHEN closed_mark = 'Y' THEN '已關單' WHEN mon IS NULL THEN '資訊不足' WHEN mon > {RUN_MONTH} THEN '未到期'
    WHEN received_qty >= entry_qty THEN '已完成' WHEN received_qty > 0 THEN '部分收貨' ELSE '待收貨' END AS status,
  CASE WHEN acc = '已驗收' THEN '條件4-已驗收' WHEN acc = '待驗收' THEN '條件4-待驗收' WHEN ops THEN '條件3-OPS倉租' WHEN dep THEN '條件2-押金'
    WHEN closed_mark = 'Y' THEN '條件1-已關單' ELSE '標準判斷' END AS condition
FROM (SELECT *, {_ACCEPT} AS acc, {_RENT} AND {_OPS} AS ops, {_DEP} AS dep,
  CASE WHEN regexp_full_match(receipt_month, '[0-9]{{4}}-?[0-9]{{2}}') THEN TRY_CAST(replace(receipt_month, '-', '') AS INTEGER) END AS mon FROM ladder_lines) x""")
def complex_status(spark, sf):
    """L-07: deposit, rent and asset marks in sequence, merged by priority."""
    out = L.deposit_type(_lines(spark, sf), DEPOSIT_ACCOUNT, DEPOSIT_WORDS)
    out = L.asset_type(L.rent_type(out, RUN_MONTH, RENT_ACCOUNT, OPS_DEPARTMENT), KIOSK_SUPPLIERS, LOCKER_SUPPLIERS)
    return L.complex_status(out, RUN_MONTH).select("po_line", "status", "condition")


_MONTH = "CASE WHEN regexp_full_match(receipt_month, '[0-9]{4}-?[0-9]{2}') THEN TRY_CAST(replace(receipt_month, '-', '') AS INTEGER) END"


@register("completion_status", f"""
SELECT po_line, CASE WHEN early = 'Y' THEN '提早完成' WHEN mon IS NULL THEN '資訊不足' WHEN line_status LIKE '%Closed%' THEN '已關單'
    WHEN line_status LIKE '%Cancelled%' THEN '已取消' WHEN mon > {RUN_MONTH} THEN CASE WHEN received_qty >= entry_qty THEN '提早完成' ELSE '未到期' END
    WHEN received_qty >= entry_qty THEN '已完成' WHEN coalesce(received_qty, 0) <= 0 THEN '待收貨'
    WHEN entry_qty > 0 AND CAST(received_qty AS DOUBLE) / entry_qty >= 0.8 THEN '接近完成'
    WHEN entry_qty > 0 AND CAST(received_qty AS DOUBLE) / entry_qty >= 0.5 THEN '部分收貨' ELSE '少量收貨' END AS completion_status,
  CASE WHEN {_m('item_description', '跨月|Cross Month')} THEN 'Y' END AS cross_month
FROM (SELECT *, {_MONTH} AS mon FROM ladder_lines) x""")
def completion_status(spark, sf):
    """L-01: status by receipt month and share received."""
    return L.completion_status(_lines(spark, sf).drop("cross_month"), RUN_MONTH).select("po_line", "completion_status", "cross_month")


@register("ppe_class", f"""
SELECT po_line, CASE WHEN fa THEN 'Y' ELSE 'N' END AS is_fa, CASE WHEN fa THEN CASE WHEN entry_amount >= {L.CAPITAL_LIMIT} THEN 'Y' ELSE 'N' END END AS capitalised,
  CASE WHEN fa AND entry_amount < {L.CAPITAL_LIMIT} THEN '金額未達資本化門檻-費用化' END AS ppe_note,
  CASE WHEN NOT fa THEN NULL WHEN gl_number = '151201' THEN '租賃改良' WHEN gl_number = '199999' THEN '押金及預付'
    WHEN {_m('item_description', 'computer|電腦')} THEN 'IT設備' WHEN {_m('item_description', 'furniture|家具')} THEN '辦公家具' ELSE '一般設備' END AS ppe_class,
  CASE WHEN NOT fa THEN NULL WHEN status IN ('已完成', '已驗收完成') THEN CASE WHEN entry_amount >= {L.CAPITAL_LIMIT} THEN '資本化-預估' ELSE '費用化-預估' END
    WHEN status = '待驗收' THEN '待驗收-不預估' ELSE '未完成-不預估' END AS fa_accrue
FROM (SELECT *, coalesce(gl_number IN ('151101', '151201', '199999'), false) AS fa FROM ladder_lines) x""")
def ppe_class(spark, sf):
    """L-08: capitalise or expense, class and accrual state of asset lines."""
    return L.ppe_class(_lines(spark, sf)).select("po_line", "is_fa", "capitalised", "ppe_note", "ppe_class", "fa_accrue")


@register("accounting_adjust", """
SELECT po_line, accrue, account_code, is_fa, CASE WHEN left(account_code, 1) IN ('1', '2', '9') THEN '000' ELSE left(department, 3) END AS department_code
FROM (SELECT po_line, department, CASE WHEN status = '已完成' THEN 'Y' ELSE 'N' END AS accrue, CASE WHEN status = '已完成' THEN gl_number END AS account_code,
  CASE WHEN gl_number = '171000' THEN 'Y' ELSE 'N' END AS is_fa FROM ladder_lines) x""")
def accounting_adjust(spark, sf):
    """L-09: generic flag, account, asset flag and department."""
    return L.accounting_adjust(_lines(spark, sf), (A.FA_ACCOUNT,)).select("po_line", "accrue", "account_code", "is_fa", "department_code")
