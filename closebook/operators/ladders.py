"""Status and flag ladders over a line's own columns (D-05 to D-07, L-01 to L-09).

Each ladder is one projection: no join, no shuffle, no Python.  Columns are
added or replaced; the other columns of a line stay.  The texts that a ladder
writes and looks for are fixed values of its defaults.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closebook.operators.documents import has


def date_logic(lines: DataFrame, profit: str = "分潤合作", profit_status: str = "分潤", posted: str = "posted") -> DataFrame:
    """D-05: profit-share lines without a status get theirs; lines still without
    one and fully invoiced are posted; posted lines are not accrued."""
    open_ = F.coalesce(F.col("status") == "nan", F.lit(True))
    status = (F.when(open_ & F.coalesce(F.col("item_description").contains(profit), F.lit(False)), F.lit(profit_status))
              .when(open_ & F.coalesce(F.col("closed_for_invoice") == "1", F.lit(False)), F.lit(posted)).otherwise(F.col("status")))
    out = lines.withColumn("status", status)
    return out.withColumn("accrue", F.when(F.col("status") == posted, F.lit("N")).otherwise(F.col("accrue")))


@dataclass(frozen=True)
class Commission:
    """One kind of commission: its words, words that exclude it, and a pair of
    phrases that also mark it when both stand in the text."""

    account: str
    product: str
    words: str
    exclude: str | None = None
    both: tuple[str, str] | None = None

    def hit(self, text: Column) -> Column:
        found = has(text, self.words)
        if self.exclude:
            found = found & ~F.coalesce(text.contains(self.exclude), F.lit(False))
        if self.both:
            found = found | (F.coalesce(text.contains(self.both[0]), F.lit(False)) & F.coalesce(text.contains(self.both[1]), F.lit(False)))
        return found


def commission(lines: DataFrame, kinds: list[Commission], remark: str = "分潤", done: str = "已完成") -> DataFrame:
    """D-06: account, product and remark of commission lines, where a later
    kind wins; lines of these accounts with the remark and a completed status
    are accrued, whoever set the remark."""
    hit = account = product = None
    for k in reversed(kinds):
        h = k.hit(F.col("item_description"))
        hit = h if hit is None else hit | h
        account = F.when(h, F.lit(k.account)) if account is None else account.when(h, F.lit(k.account))
        product = F.when(h, F.lit(k.product)) if product is None else product.when(h, F.lit(k.product))
    out = lines.withColumns({
        "gl_number": F.coalesce(account, F.col("gl_number")), "account_code": F.coalesce(account, F.col("account_code")),
        "product_code": F.coalesce(product, F.col("product_code")), "fn_remark": F.when(hit, F.lit(remark)).otherwise(F.col("fn_remark"))})
    due = (F.col("gl_number").isin(*[k.account for k in kinds]) & (F.col("fn_remark") == remark)
           & F.coalesce(F.col("status").contains(done), F.lit(False)))
    return out.withColumn("accrue", F.when(due, F.lit("Y")).otherwise(F.col("accrue")))


def payroll(lines: DataFrame, words: str = "payroll", label: str = "Payroll") -> DataFrame:
    """D-07: lines whose task or description names payroll and whose remark is
    empty get the label as remark, and as status where that is null."""
    hit = (has(F.col("task"), words) | has(F.col("item_description"), words)) & F.coalesce(F.col("fn_remark").isin("", "nan"), F.lit(True))
    return lines.withColumns({
        "fn_remark": F.when(hit, F.lit(label)).otherwise(F.col("fn_remark")),
        "status": F.when(hit & F.col("status").isNull(), F.lit(label)).otherwise(F.col("status"))})


def department_override(lines: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
    """L-02: the code is the department's first three characters; 000 for
    accounts that begin with 1, 2, 4, 5 or 9; the last of ``names`` (text,
    code) found in the department beats both; what is not three digits is 999."""
    code = F.when(F.col("account_code").rlike("^[12459]"), F.lit("000")).otherwise(F.substring("department", 1, 3))
    for name, value in names:
        code = F.when(F.coalesce(F.lower("department").contains(name.lower()), F.lit(False)), F.lit(value)).otherwise(code)
    return lines.withColumn("department_code", F.when(F.coalesce(code.rlike("^[0-9]{3}$"), F.lit(False)), code).otherwise(F.lit("999")))


def accrual_decision(lines: DataFrame, fa_accounts: tuple[str, ...], accrued: tuple[str, ...] = ("已完成", "提早完成", "接近完成"),
                     partial: str = "部分收貨", least: float = 0.8, veto: str = "不預估|不估計|勿估|暫緩") -> DataFrame:
    """L-03: accrued by status, by the share received of partial deliveries,
    or over the month end; a veto in the procurement remark beats all three."""
    ratio = F.when(F.col("entry_qty") != 0, F.col("received_qty") / F.col("entry_qty"))
    cross, no = F.coalesce(F.col("cross_month") == "Y", F.lit(False)), has(F.col("proc_remark"), veto)
    yes = F.coalesce(F.col("status").isin(*accrued), F.lit(False)) | F.coalesce((F.col("status") == partial) & (ratio >= least), F.lit(False)) | cross
    out = lines.withColumns({
        "accrue": F.when(no, F.lit("N")).when(yes, F.lit("Y")).otherwise(F.lit("N")),
        "accrual_note": F.when(no, F.lit("採購備註-不預估")).when(cross, F.lit("跨月項目-全額預估")),
        "is_fa": F.when(F.coalesce(F.col("gl_number").isin(*fa_accounts), F.lit(False)), F.lit("Y")).otherwise(F.lit("N"))})
    return out.withColumn("account_code", F.when(F.col("accrue") == "Y", F.col("gl_number")).otherwise(F.col("account_code")))


#: (type, words) in order; the first found in the lower-cased text counts.
DEPOSIT_TYPES = [("找零金", "找零金"), ("租賃押金", "租賃|lease"), ("保證金", "保證金"), ("一般押金", "deposit")]
RENT_TYPES = [("倉庫租金", "倉庫|warehouse"), ("辦公室租金", "辦公室|office"), ("Kiosk租金", "kiosk|機台"), ("Locker租金", "locker|櫃"),
              ("車輛租金", "車|vehicle")]


def _first_type(types: list[tuple[str, str]], other: str) -> Column:
    out = None
    for name, words in types:
        hit = has(F.col("item_description"), words)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(other))


def deposit_type(lines: DataFrame, account: str, words: str) -> DataFrame:
    """L-04: deposits by word or account, their type, and no accrual."""
    hit = has(F.col("item_description"), words) | F.coalesce(F.col("gl_number") == account, F.lit(False))
    return lines.withColumns({
        "deposit_mark": F.when(hit, F.lit("Y")), "deposit_type": F.when(hit, _first_type(DEPOSIT_TYPES, "其他押金")),
        "accrue": F.when(hit, F.lit("N")).otherwise(F.col("accrue")),
        "accrual_note": F.when(hit, F.lit("押金項目-不預估")).otherwise(F.col("accrual_note"))})


def rent_type(lines: DataFrame, run_month: int, account: str, ops_department: str, words: str = "租金|Rent|租賃|Lease|月租") -> DataFrame:
    """L-05: rents by word or account: type (the operations department has its
    own), the first year and month in the text, and whether they are due."""
    text = F.col("item_description")
    hit = has(text, words) | F.coalesce(F.col("gl_number") == account, F.lit(False))
    ops = F.coalesce(F.lower("department").contains(ops_department.lower()), F.lit(False))
    part = [F.regexp_extract(F.coalesce(text, F.lit("")), r"([0-9]{4})[/\-]([0-9]{1,2})", g) for g in (1, 2)]
    period = F.when(part[0] == "", F.lit("")).otherwise(F.concat(part[0], F.lpad(part[1], 2, "0")))
    due = F.when(F.col("rent_period") == "", F.lit("待判斷")).when(F.col("rent_period") <= f"{run_month:06d}", F.lit("當期租金-預估")).otherwise(F.lit("預付租金-不預估"))
    out = lines.withColumns({
        "rent_mark": F.when(hit, F.lit("Y")), "rent_type": F.when(hit & ops, F.lit("OPS倉庫租金")).when(hit, _first_type(RENT_TYPES, "其他租金")),
        "rent_period": F.when(hit, period)})
    return out.withColumn("rent_state", F.when(F.col("rent_mark") == "Y", due))


def asset_type(lines: DataFrame, kiosk_suppliers: tuple[str, ...], locker_suppliers: tuple[str, ...]) -> DataFrame:
    """L-06: kiosks and lockers by supplier or word (locker wins), how far their
    acceptance is, and the accrual that follows from it."""
    def kind(suppliers: tuple[str, ...], words: str) -> Column:
        return F.coalesce(F.col("supplier").isin(*suppliers), F.lit(False)) | has(F.col("item_description"), words)

    type_ = F.when(kind(locker_suppliers, "Locker|智能櫃"), F.lit("Locker")).when(kind(kiosk_suppliers, "Kiosk|機台"), F.lit("Kiosk"))
    state = (F.when(has(F.col("line_status"), "validated|驗收"), F.lit("已驗收")).when(F.col("received_qty") >= F.col("entry_qty"), F.lit("已收貨待驗收"))
             .when(F.col("received_qty") > 0, F.lit("部分收貨")).otherwise(F.lit("待驗收")))
    out = lines.withColumn("asset_type", type_)
    out = out.withColumn("acceptance", F.when(F.col("asset_type").isNotNull(), state))
    waits, done = F.col("acceptance") == "待驗收", F.col("acceptance") == "已驗收"
    return out.withColumns({
        "accrue": F.when(waits, F.lit("N")).when(done, F.lit("Y")).otherwise(F.col("accrue")),
        "accrual_note": F.when(waits, F.lit("資產待驗收-不預估")).when(done, F.lit("資產已驗收-預估")).otherwise(F.col("accrual_note"))})


def complex_status(lines: DataFrame, run_month: int) -> DataFrame:
    """L-07: the marks of the other ladders in rising priority (closed, deposit,
    operations rent, acceptance); lines with none by receipt month and quantity."""
    marks = [(F.col("acceptance") == "已驗收", "已驗收完成", "條件4-已驗收"), (F.col("acceptance") == "待驗收", "待驗收", "條件4-待驗收"),
             (F.col("rent_type") == "OPS倉庫租金", "OPS倉租", "條件3-OPS倉租"), (F.col("deposit_mark") == "Y", "押金項目", "條件2-押金"),
             (F.col("closed_mark") == "Y", "已關單", "條件1-已關單")]
    month = _receipt_month()
    status = condition = None
    for cond, s, c in marks:
        status = F.when(cond, F.lit(s)) if status is None else status.when(cond, F.lit(s))
        condition = F.when(cond, F.lit(c)) if condition is None else condition.when(cond, F.lit(c))
    status = (status.when(month.isNull(), F.lit("資訊不足")).when(month > run_month, F.lit("未到期"))
              .when(F.col("received_qty") >= F.col("entry_qty"), F.lit("已完成")).when(F.col("received_qty") > 0, F.lit("部分收貨")).otherwise(F.lit("待收貨")))
    return lines.withColumns({"status": status, "condition": condition.otherwise(F.lit("標準判斷"))})


def _receipt_month() -> Column:
    """YYYYMM or YYYY-MM as a number; anything else is null."""
    return F.when(F.col("receipt_month").rlike("^[0-9]{4}-?[0-9]{2}$"), F.regexp_replace("receipt_month", "-", "").cast("int"))


def completion_status(lines: DataFrame, run_month: int, cross: str = "跨月|Cross Month") -> DataFrame:
    """L-01: closed or cancelled, then by receipt month and share received; the
    early flag beats all; lines over the month end are marked by their text."""
    month, got, want = _receipt_month(), F.col("received_qty"), F.col("entry_qty")
    ratio = F.when(want > 0, got / want)
    found = (F.when(F.col("early") == "Y", F.lit("提早完成")).when(month.isNull(), F.lit("資訊不足"))
             .when(F.col("line_status").contains("Closed"), F.lit("已關單")).when(F.col("line_status").contains("Cancelled"), F.lit("已取消"))
             .when((month > run_month) & (got >= want), F.lit("提早完成")).when(month > run_month, F.lit("未到期"))
             .when(got >= want, F.lit("已完成")).when((got > 0) & (ratio >= 0.8), F.lit("接近完成")).when((got > 0) & (ratio >= 0.5), F.lit("部分收貨"))
             .when(got > 0, F.lit("少量收貨")).otherwise(F.lit("待收貨")))
    return lines.withColumns({"completion_status": found, "cross_month": F.when(has(F.col("item_description"), cross), F.lit("Y"))})


#: The asset accounts and the limit from which an asset is capitalised.
FA_ACCOUNTS, CAPITAL_LIMIT = ("151101", "151201", "199999"), 10000


def ppe_class(lines: DataFrame, limit: int = CAPITAL_LIMIT) -> DataFrame:
    """L-08: asset lines by account: capitalised from the limit on, their class,
    and the accrual state that follows from the line's status."""
    gl, text, amount, status = F.col("gl_number"), F.col("item_description"), F.col("entry_amount"), F.col("status")
    fa = F.coalesce(gl.isin(*FA_ACCOUNTS), F.lit(False))
    class_ = (F.when((gl == "151101") & has(text, "computer|電腦"), F.lit("IT設備")).when((gl == "151101") & has(text, "furniture|家具"), F.lit("辦公家具"))
              .when(gl == "151101", F.lit("一般設備")).when(gl == "151201", F.lit("租賃改良")).otherwise(F.lit("押金及預付")))
    done = status.isin("已完成", "已驗收完成")
    state = (F.when(done & (amount >= limit), F.lit("資本化-預估")).when(done, F.lit("費用化-預估"))
             .when(status == "待驗收", F.lit("待驗收-不預估")).otherwise(F.lit("未完成-不預估")))
    return lines.withColumns({
        "is_fa": F.when(fa, F.lit("Y")).otherwise(F.lit("N")), "capitalised": F.when(fa & (amount >= limit), F.lit("Y")).when(fa & (amount < limit), F.lit("N")),
        "ppe_note": F.when(fa & (amount < limit), F.lit("金額未達資本化門檻-費用化")), "ppe_class": F.when(fa, class_), "fa_accrue": F.when(fa, state)})


def accounting_adjust(lines: DataFrame, fa_accounts: tuple[str, ...], done: str = "已完成") -> DataFrame:
    """L-09: completed lines are accrued on their own account; asset flag; the
    department's first three characters, 000 for accounts with 1, 2 or 9."""
    yes = F.coalesce(F.col("status") == done, F.lit(False))
    account = F.when(yes, F.col("gl_number"))
    return lines.withColumns({
        "accrue": F.when(yes, F.lit("Y")).otherwise(F.lit("N")), "account_code": account,
        "is_fa": F.when(F.coalesce(F.col("gl_number").isin(*fa_accounts), F.lit(False)), F.lit("Y")).otherwise(F.lit("N")),
        "department_code": F.when(account.rlike("^[129]"), F.lit("000")).otherwise(F.substring("department", 1, 3))})
