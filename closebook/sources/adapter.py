"""Driver test data → month-end accrual input tables (Spark side).

The TPC-H-like tables carry no accrual concepts, so every accrual table is
derived by deterministic arithmetic on keys and attributes (no random
numbers).  The same derivations exist as SQL text in ``adapter_sql`` so the
DuckDB oracle reads identical inputs.

Line identity: ``(l_orderkey, l_linenumber)`` repeats in the generator, also
with part and supplier, so the line key carries part, supplier, ship date and
quantity.  No window is needed to number lines: a hot document never lands in
a single task here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closebook.functions.numbers import int_text, money
from closebook.functions.periods import MONTH_ABBR, ym_text
from closebook.functions.text import apart
from closebook.sources.testdata import Tables, spread

# Accounts of the synthetic chart, chosen here.
FA_ACCOUNT = "171000"
MGMT_FEE_ACCOUNT = "614100"
# Fixed value: the account of a line without one.
DEFAULT_GL = "666666"
DEPARTMENTS = [
    "101 Operations", "102 Logistics", "203 Marketing", "204 Sales",
    "305 IT", "306 Finance", "407 HR", "408 Facilities",
]
TYPE_PHRASES = {
    "PROMO": "deposit",
    "STANDARD": "office rent",
    "ECONOMY": "utilities fee",
    "SMALL": "agent fee",
    "LARGE": "equipment",
    "MEDIUM": "service fee",
}


def _case(col: Column, mapping: dict, default=None) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = (F.when(col == F.lit(k), F.lit(v)) if expr is None
                else expr.when(col == F.lit(k), F.lit(v)))
    return expr.otherwise(F.lit(default))


def _department(suppkey: Column) -> Column:
    k = suppkey % 8
    expr = F.when(k == 0, F.lit(DEPARTMENTS[0]))
    for i, d in enumerate(DEPARTMENTS[1:], start=1):
        expr = expr.when(k == i, F.lit(d))
    return expr


def _gl_raw(partkey: Column) -> Column:
    k = partkey % 20
    return (
        F.when(k == 0, F.lit(FA_ACCOUNT))
        .when(k == 1, F.lit(MGMT_FEE_ACCOUNT))
        .when(k == 2, F.lit("N.A."))
        .when(k == 3, F.lit(None).cast("string"))
        .when(k == 4, F.concat((F.lit(520000) + k).cast("string"), F.lit(".0")))
        .otherwise((F.lit(520000) + k).cast("string"))
    )


def _period_text(partkey: Column, ship_idx: Column) -> Column:
    v = partkey % 5
    return (
        F.when(v == 0, F.concat(ym_text(ship_idx - 1), F.lit(" - "), ym_text(ship_idx + 1)))
        .when(v == 1, ym_text(ship_idx))
        .when(v == 2, F.concat(ym_text(ship_idx), F.lit("/01 - "), ym_text(ship_idx + 2), F.lit("/28")))
        .when(v == 3, F.concat(F.floor(ship_idx / 12).cast("bigint").cast("string"), F.lit("/13")))
    )


def _four_digits(day: Column) -> Column:
    """Whether the year has four digits, from the timestamp itself."""
    return (day >= F.lit("1000-01-01 00:00:00").cast("timestamp_ntz")) & (day < F.make_timestamp_ntz(*map(F.lit, (10000, 1, 1, 0, 0, 0))))


def day_text(day: Column) -> Column:
    """'yyyyMMdd' by arithmetic: a pattern's formatter costs several times as
    much a row and is left to years of other than four digits."""
    number = F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)
    return F.when(_four_digits(day), number.cast("string")).otherwise(F.date_format(day, "yyyyMMdd"))


def month_text(day: Column) -> Column:
    """'MMM-yy', in the same way."""
    name = F.get(F.array(*[F.lit(m.capitalize()) for m in MONTH_ABBR]), F.month(day) - 1)
    text = F.concat(name, F.lit("-"), F.lpad((F.year(day) % 100).cast("string"), 2, "0"))
    return F.when(_four_digits(day), text).otherwise(F.date_format(day, "MMM-yy"))


def _item_ref(day: Column | None = None, qty: Column | None = None) -> Column:
    day = F.col("l_shipdate") if day is None else day
    qty = F.col("l_quantity").cast("bigint") if qty is None else qty
    return F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
                       day_text(day), qty.cast("string"))


def _part_texts(part: DataFrame) -> DataFrame:
    """What a line takes from its part alone, worked out once a part."""
    phrase = _case(F.col("p_type"), TYPE_PHRASES)
    return part.select(
        "p_partkey", F.concat(F.lit("BR"), F.regexp_replace("p_brand", "^.{6}", "")).alias("p_product"),
        F.lower("p_type").alias("p_kind"), money(F.col("p_retailprice")).alias("p_price"),
        F.when(F.col("p_name").isNotNull() | phrase.isNotNull(), F.concat_ws(" ", F.col("p_name"), phrase)).alias("p_words"))


#: What the flags and rates of a line and of its order say, as bits of small numbers.
_FACTS = {"open": lambda: F.col("l_linestatus") == "O", "done": lambda: F.col("l_linestatus") == "F",
          "billed": lambda: F.col("l_returnflag") == "R", "half_billed": lambda: F.col("l_returnflag") == "A",
          "prepaid": lambda: F.col("l_discount") == 0.0, "no_month": lambda: (F.col("l_discount") == 0.1) & (F.col("l_tax") == 0.0)}
_ORDER_FACTS = {"usd": lambda: F.col("o_orderpriority") == "1-URGENT", "eur": lambda: F.col("o_orderpriority") == "2-HIGH",
                "closed": lambda: F.col("o_orderstatus") == "F"}


def _bits(facts: dict) -> Column:
    bits = [F.when(c(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(facts.values())]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def _fact(name: str) -> Column:
    """Null where the line has no order."""
    col, facts = ("_facts", _FACTS) if name in _FACTS else ("_order_facts", _ORDER_FACTS)
    return F.col(col).bitwiseAND(F.lit(1 << list(facts).index(name))) != 0


def po_raw(t: Tables) -> DataFrame:
    """Raw purchase lines as an extract would deliver them (text ids/codes).
    The lines are shuffled for every join, so what their own flags, rates and
    dates say goes along as small numbers, and texts are made after the joins."""
    l = spread(t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("_qty"),
        _bits(_FACTS).alias("_facts"), F.col("l_shipdate").cast("date").alias("_day")))
    o = t.orders.select("o_orderkey", "o_custkey", _bits(_ORDER_FACTS).alias("_order_facts"))
    p = _part_texts(t.part)
    s = t.supplier.select("s_suppkey", "s_name")
    j = (l.join(o, l.l_orderkey == o.o_orderkey, "left")
          .join(p, l.l_partkey == p.p_partkey, "left")
          .join(s, l.l_suppkey == s.s_suppkey, "left"))
    qty, half, day = F.col("_qty"), F.expr("_qty div 2"), F.col("_day")
    ship_idx = F.year(day) * 12 + F.month(day) - 1
    product, price = F.col("p_product"), F.col("p_price")
    return j.select(
        F.concat(F.lit("PO"), F.col("l_orderkey").cast("string")).alias("po_number"),
        F.concat(F.lit("PR"), F.col("l_orderkey").cast("string")).alias("pr_number"),
        F.when(_fact("open"),
               F.concat(F.col("l_linenumber").cast("string"), F.lit(".0")))
         .otherwise(F.col("l_linenumber").cast("string")).alias("line_raw"),
        _item_ref(day, qty).alias("item_ref"),
        _gl_raw(F.col("l_partkey")).alias("gl_raw"),
        product.alias("product_code"),
        F.col("s_name").alias("supplier"),
        _department(F.col("l_suppkey")).alias("department"),
        F.concat(F.lit("U"), F.col("o_custkey").cast("string")).alias("requester"),
        F.when(_fact("done"), F.concat(product, F.lit(" "), F.col("p_kind")))
         .otherwise(F.concat(F.lit("GEN "), F.col("p_kind"))).alias("project"),
        F.when(_fact("usd"), F.lit("USD")).when(_fact("eur"), F.lit("EUR")).otherwise(F.lit("TWD")).alias("currency"),
        apart(F.concat_ws(" ", F.col("p_words"), _period_text(F.col("l_partkey"), ship_idx))).alias("item_description"),
        qty.alias("entry_qty"),
        F.when(_fact("done"), qty).otherwise(half).alias("received_qty"),
        F.when(_fact("billed"), qty)
         .when(_fact("half_billed"), half)
         .otherwise(F.lit(0).cast("bigint")).alias("billed_qty"),
        F.when(_fact("prepaid"), F.lit(1).cast("bigint"))
         .otherwise(F.lit(0).cast("bigint")).alias("prepay_qty"),
        price.alias("unit_price"),
        money(price * qty).alias("entry_amount"),
        money(price * F.when(_fact("billed"), qty)
              .when(_fact("half_billed"), half).otherwise(F.lit(0))).alias("billed_amount"),
        F.when(_fact("no_month"), F.lit("TBD"))
         .otherwise(month_text(day)).alias("erm_text"),
        F.when(_fact("closed"), F.lit("1")).otherwise(F.lit("0")).alias("closed_for_invoice"),
    )


def clean_raw_columns(raw: DataFrame) -> DataFrame:
    """S-16: line number → integer text, GL ``N.A.``/null → default, integer
    text; builds the line keys."""
    line = apart(int_text(F.col("line_raw")))
    gl = apart(int_text(F.coalesce(F.nullif(F.trim("gl_raw"), F.lit("N.A.")), F.lit(DEFAULT_GL))))
    item = F.col("item_ref")
    return (raw
            .withColumn("line_number", line)
            .withColumn("gl_number", gl)
            .withColumn("po_line", F.concat("po_number", F.lit("-"), "line_number", F.lit("-"), item))
            .withColumn("pr_line", F.concat("pr_number", F.lit("-"), "line_number", F.lit("-"), item))
            .drop("line_raw", "gl_raw"))


def pr_to_po_line(pr_line: Column) -> Column:
    """PR line key → the PO line key of the same line (keys share the suffix)."""
    return F.concat(F.lit("PO"), F.regexp_replace(pr_line, "^PR", ""))


def po_lines(t: Tables) -> DataFrame:
    return clean_raw_columns(po_raw(t))



def _line_key(prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.col("l_orderkey").cast("string"), F.lit("-"),
                    F.col("l_linenumber").cast("string"), F.lit("-"), _item_ref())


def month_start(run_month: int) -> Column:
    return F.lit(f"{run_month // 100:04d}-{run_month % 100:02d}-01 00:00:00").cast("timestamp_ntz")


def prev_workpaper(t: Tables, run_month: int) -> DataFrame:
    """Last month's workpaper: every line shipped before the run month, plus a
    second, later row (``_ord`` 2) for returned lines — duplicate keys where
    the last non-null value must win."""
    l = t.lineitem.where(F.col("l_shipdate") < month_start(run_month))
    v = (F.col("l_partkey") + F.col("l_suppkey")) % 7
    base = l.select(
        _line_key("PO").alias("po_line"), _line_key("PR").alias("pr_line"),
        F.lit(1).cast("bigint").alias("_ord"),
        F.when(F.col("l_linestatus") == "F", F.lit("posted")).alias("status"),
        F.when(v == 0, F.lit("已完成")).when(v == 1, F.lit("已入帳")).when(v == 2, F.lit("199801入FA"))
         .when(v == 3, F.lit("check 1998/01 invoice")).when(v == 4, F.lit("未完成")).alias("fn_remark"),
        F.when(F.col("l_returnflag") == "A", F.lit("未完成")).alias("fn_pr_remark"),
        (F.lit(520000) + F.col("l_partkey") % 20).cast("string").alias("account_code"),
        F.concat(F.lit("R"), (F.col("l_suppkey") % 5).cast("string")).alias("reviewer"),
    )
    dup = l.where(F.col("l_returnflag") == "R").select(
        _line_key("PO").alias("po_line"), _line_key("PR").alias("pr_line"),
        F.lit(2).cast("bigint").alias("_ord"),
        F.lit(None).cast("string").alias("status"),
        F.when(v % 2 == 1, F.lit("已完成")).alias("fn_remark"),
        F.lit(None).cast("string").alias("fn_pr_remark"),
        F.lit("520099").alias("account_code"),
        F.lit(None).cast("string").alias("reviewer"),
    )
    return base.unionByName(dup)


def procurement(t: Tables) -> DataFrame:
    """Procurement remark list for open lines: keyed by PO line, or only by
    PR line for lines with billing (the fallback path)."""
    l = t.lineitem.where(F.col("l_linestatus") == "O")
    k = F.col("l_partkey") % 4
    return l.select(
        F.when(F.col("l_returnflag") == "N", _line_key("PO")).alias("po_line"),
        _line_key("PR").alias("pr_line"),
        F.when(k == 0, F.lit("已完成")).when(k == 1, F.lit("rent")).when(k == 2, F.lit("error"))
         .alias("remark"),
        F.lit(1).cast("bigint").alias("_ord"),
    )


def ap_invoice(t: Tables) -> DataFrame:
    """Supplier invoices: 1–3 posting periods per billed line (text YYYYMM,
    some unparsable), a match type that may be missing, a voucher number."""
    l = t.lineitem.where(F.col("l_returnflag") != "N")
    l = l.select("*", F.explode(F.sequence(F.lit(0), (F.col("l_linenumber") % 3).cast("int"))).alias("k"))
    idx = F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1 + F.col("k")
    ym = F.floor(idx / 12).cast("bigint") * 100 + F.pmod(idx, F.lit(12)) + 1
    return l.select(
        _line_key("PO").alias("po_line"),
        F.when((F.col("l_partkey") % 11 == 0) & (F.col("k") == 0), F.lit("N/A"))
         .otherwise(ym.cast("string")).alias("period"),
        F.when(F.col("l_tax") != 0.0, F.lit("ITEM_TO_RECEIPT")).alias("match_type"),
        F.when(F.col("l_tax") != 0.02, F.concat(F.lit("V"), F.col("l_orderkey").cast("string"), F.lit("-"),
                 F.col("l_linenumber").cast("string"), F.lit("-"), F.col("k").cast("string"))).alias("voucher_no"),
        F.col("k").cast("bigint").alias("_ord"),
    )


# Fixed values of the closing list: spec texts by order priority.
CLOSING_SPECS = {"5-LOW": "ALL", "4-NOT SPECIFIED": "Line1~3", "3-MEDIUM": "Line1、 3,x、5~4,4~3~2"}


def closing_list(t: Tables) -> DataFrame:
    """Closing list of finished orders: whole document ('ALL') or a line spec;
    done flag 'V' or blank (blank means not done)."""
    o = t.orders.where(F.col("o_orderstatus") == "F")
    spec = _case(F.col("o_orderpriority"), CLOSING_SPECS)
    return o.select(
        F.concat(F.lit("PO"), F.col("o_orderkey").cast("string")).alias("po_number"),
        spec.alias("line_spec"),
        F.when(F.col("o_totalprice") > 200000, F.lit("V")).otherwise(F.lit("")).alias("done"),
        F.to_date("o_orderdate").alias("close_date"),
        F.when(F.col("o_custkey") % 5 == 1, F.lit("")).when(F.col("o_custkey") % 5 != 2, F.concat(F.lit("PR"), F.col("o_orderkey").cast("string")))
         .alias("new_pr"),
    ).where(F.col("line_spec").isNotNull())


def _ship_month() -> Column:
    return (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("int")


def asset_lines(t: Tables) -> DataFrame:
    """Lines of asset documents: instalments named in the text, a receipt month
    that may be missing, remarks and statuses, some of them protected."""
    l = t.lineitem
    k = (F.col("l_partkey") + F.col("l_linenumber")) % 7
    return l.select(
        F.concat(F.lit("PO"), F.col("l_orderkey").cast("string")).alias("po_number"), _line_key("PO").alias("po_line"),
        F.when(F.col("l_partkey") % 20 == 0, F.lit(FA_ACCOUNT)).otherwise((F.lit(520000) + F.col("l_partkey") % 20).cast("string")).alias("gl_number"),
        F.when(k == 0, F.lit("設備 驗收款")).when(k == 1, F.lit("設備 驗收 保固款")).when(k == 2, F.lit("設備 訂金"))
         .when((k == 3) & (F.col("l_suppkey") % 2 == 0), F.lit("設備 安裝款")).when(k < 6, F.lit("supplies")).alias("item_description"),
        F.when(F.col("l_tax") != 0.0, _ship_month()).alias("erm"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_suppkey") % 3 == 0), F.lit("PR 已完成"))
         .when(F.col("l_returnflag") == "A", F.lit("未完成")).alias("proc_remark"),
        F.when((F.col("l_linestatus") == "F") & (F.col("l_discount") == 0.0), F.lit("posted"))
         .when(F.col("l_discount") == 0.1, F.lit("to_check")).alias("status"),
        F.when(F.col("l_discount") == 0.1, F.lit("by hand")).alias("status_note"),
        F.lit("N").alias("accrue"))


def _cabinet_index() -> Column:
    return (F.col("l_partkey") + F.col("l_linenumber")) % 25


def _accepted_on() -> Column:
    """Acceptance dates as a sheet has them: two notations, missing, not a date."""
    v = F.col("l_partkey") % 13
    return (F.when(v == 0, F.lit(None).cast("string")).when(v == 1, F.lit("pending"))
            .when(F.col("l_partkey") % 2 == 0, F.date_format("l_shipdate", "yyyy/MM/dd")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")))


def _po_number() -> Column:
    return F.concat(F.lit("PO"), F.col("l_orderkey").cast("string"))


def acceptance_sheet(t: Tables, cabinets: tuple[str, ...]) -> DataFrame:
    """Acceptance rows: one quantity column per cabinet type, a discount text."""
    v, qty = F.col("l_suppkey") % 6, F.col("l_quantity").cast("bigint")
    return t.lineitem.select(
        _line_key("PO").alias("_ord"), _po_number().alias("po_number"),
        F.when(v == 0, F.lit("8折驗收")).when(v == 1, F.lit("8.5折出貨")).when(v == 2, F.lit("9折")).alias("discount"),
        _accepted_on().alias("accepted_on"),
        *[F.when(_cabinet_index() == i, qty).alias(c) for i, c in enumerate(cabinets)])


def kiosk_sheet(t: Tables) -> DataFrame:
    """Accepted kiosks: one row each."""
    return t.lineitem.where(F.col("l_partkey") % 9 == 0).select(_po_number().alias("po_number"), _accepted_on().alias("accepted_on"))


def operations_sheet(t: Tables, cabinets: tuple[str, ...]) -> DataFrame:
    """The operations sheet as text cells, some blank or broken references."""
    cell = F.when(F.col("l_suppkey") % 10 == 0, F.lit("#REF!")).otherwise(F.col("l_quantity").cast("bigint").cast("string"))
    return t.lineitem.select(
        F.concat(F.lit(" "), _po_number(), F.when(F.col("l_linestatus") == "O", F.lit(".0 ")).otherwise(F.lit(""))).alias("po_line_text"),
        _po_number().alias("po_number"), _accepted_on().alias("accepted_on"),
        *[F.when(_cabinet_index() == i, cell).when(F.lit(i % 4 == 0), F.lit("")).alias(c) for i, c in enumerate(cabinets)])


def cabinet_lines(t: Tables, cabinet_texts: list[str]) -> DataFrame:
    """Lines of cabinet and kiosk orders with instalments in the text."""
    k = F.col("l_partkey") % 3
    texts = F.array(*[F.lit(x) for x in cabinet_texts])
    cabinet = F.concat(
        F.lit("1998/06 SVP_SPX 門市智取櫃工程SPX "), F.when(F.col("l_suppkey") % 11 == 0, F.lit("HD ")).otherwise(F.lit("")), F.lit("locker "),
        F.get(texts, _cabinet_index().cast("int")),
        F.when(k == 0, F.lit("第一期款項 #SP-C")).when(k == 1, F.lit(" 訂金 #SP-C")).otherwise(F.lit(" 30%款項 #SP-C")),
        F.when(F.col("l_suppkey") % 8 == 7, F.lit(" 減價")).otherwise(F.lit("")))
    return t.lineitem.select(
        _po_number().alias("po_number"), _line_key("PO").alias("po_line"),
        F.concat(F.lit("S"), (F.col("l_suppkey") % 7).cast("string")).alias("supplier"),
        F.when(F.col("l_partkey") % 9 == 0, F.lit("1998/06 SVP_SPX 門市繳費機工程 payment machine #SP-C"))
         .when(F.col("l_partkey") % 10 == 3, F.lit("門市裝修工程 第二期款項")).when(F.col("l_partkey") % 10 == 4, F.lit("辦公室裝修"))
         .when(F.col("l_partkey") % 31 != 5, cabinet).alias("item_description"),
        money(F.lit(100) + F.col("l_partkey") % 900).alias("unit_price"),
        F.concat(F.lit("BR"), (F.col("l_partkey") % 25).cast("string")).alias("product_code"), F.lit("TWD").alias("currency"),
        F.when(F.col("l_partkey") % 11 == 0, F.lit("")).when(F.col("l_partkey") % 11 != 1, (F.col("l_quantity").cast("bigint") + F.col("l_suppkey") % 2).cast("string"))
         .alias("cumulative_qty"),
        F.lit("N").alias("accrue"), F.lit(None).cast("string").alias("account_code"), F.lit(None).cast("double").alias("accr_amount"))


def _site_address(site: Column, pair: Column) -> Column:
    """Address of a site; two sites share one."""
    city = F.when(pair % 4 == 0, F.lit("台北市中山區")).when(pair % 4 == 1, F.lit("新北市板橋區")).when(pair % 4 == 2, F.lit("彰化縣員林市")).otherwise(F.lit("大安區"))
    floor = F.when(site % 3 == 1, F.lit("1樓")).when(site % 3 == 2, F.lit("之2")).otherwise(F.lit(""))
    return F.concat(city, F.lit("民生路"), pair.cast("string"), F.lit("號"), floor)


def _address(col: str) -> Column:
    return _site_address(F.col(col), F.expr(f"{col} div 2"))


def _day(start: str, offset: Column, fmt: str) -> Column:
    return F.date_format(F.date_add(F.lit(start).cast("date"), offset.cast("int")), fmt)


def filing_list(t: Tables) -> DataFrame:
    """Filed contracts by position: site, address, period text in many notations."""
    k, p = F.col("p_partkey") % 8, F.col("p_partkey")
    first, last = (lambda fmt: _day("1997-01-05", p % 300, fmt)), (lambda fmt: _day("1998-01-05", p % 900, fmt))
    s, d = "yyyy/MM/dd", "yyyy-MM-dd"
    period = (F.when(k == 0, F.concat(first(s), F.lit(" - "), last(s))).when(k == 1, F.concat(first(s), F.lit("~"), last(s)))
              .when(k == 2, F.concat(first(s), F.lit("至"), last(s), F.lit(" +"))).when(k == 3, F.concat(first(s), F.lit("-"), last(s)))
              .when(k == 4, F.concat(first(d), F.lit(" - "), last(d))).when(k == 5, F.concat(first(d), F.lit("~"), last(d))).when(k == 6, F.lit("TBD")))
    return t.part.select(F.when(p % 19 == 0, F.lit(" ")).otherwise(p.cast("string")).alias("A"), _address("p_partkey").alias("B"), period.alias("C"))


def renewal_list(t: Tables) -> DataFrame:
    """Renewed contracts, with the columns named as in the sheet."""
    p = F.col("p_partkey")
    return t.part.where(p % 3 != 0).select(
        p.cast("string").alias("門市店號"), F.when(p % 23 != 0, _address("p_partkey")).alias("詳細地址"),
        _day("1996-06-01", p % 500, "yyyy/MM/dd").alias("第一期合約起始日"),
        F.when(p % 7 == 0, F.lit("open")).otherwise(_day("1998-03-01", p % 1000, "yyyy-MM-dd")).alias("第二期合約截止日"))


def renewal_grids(t: Tables) -> list[DataFrame]:
    """Three sheets as rows of cells, trailing blanks cut off, a header row first."""
    p = F.col("p_partkey")
    start, end = _day("1996-06-01", p % 500, "yyyy/MM/dd"), _day("1998-03-01", p % 1000, "yyyy/MM/dd")

    def grid(rows: DataFrame, cells: dict[int, Column], width: int, header: str) -> DataFrame:
        filled = F.array(*[cells.get(i, F.lit("")) for i in range(width)])
        short = F.slice(filled, 1, F.when(p % 5 == 0, width - 3).otherwise(width))
        spark = rows.sparkSession
        return rows.select((p + 1).alias("row"), short.alias("cells")).unionByName(
            spark.createDataFrame([(0, [f"{header}{i}" for i in range(width)])], "row bigint, cells array<string>"))

    code, addr = p.cast("string"), _address("p_partkey")
    given = F.when(p % 6 == 0, F.lit("")).when(p % 6 == 3, F.lit("#N/A")).otherwise(start)
    return [grid(t.part.where(p % 3 == 0), {0: code, 6: addr, 21: given, 24: end}, 25, "a"),
            grid(t.part.where(p % 3 == 1), {0: code, 2: addr, 13: start, 14: end, 15: end, 16: start}, 17, "b"),
            grid(t.part.where(p % 3 == 2), {0: code, 2: addr, 13: start, 14: start, 15: end, 16: end}, 17, "c")]


def site_lines(t: Tables) -> DataFrame:
    """Lines whose texts name a site, a cabinet or neither, in several layouts."""
    k, p = (F.col("l_orderkey") + F.col("l_linenumber")) % 6, F.col("l_partkey")
    addr = _address("l_partkey")
    text = (F.when(k == 0, F.concat(F.lit("1998/06 SVP_SPX 門市裝修工程-店"), p.cast("string"), F.lit(" ("), addr, F.lit(") SPX store decoration 第一期款項 #SP-C")))
            .when(k == 1, F.concat(F.lit("1998/06 SVP_SPX 冷氣裝修工程Air-con equipment("), addr, F.lit(") #SP-C")))
            .when(k == 2, F.concat(F.lit("1998/06 SVP_SPX 門市智取櫃工程SPX locker "), F.when(p % 2 == 0, F.lit("XA")).otherwise(F.lit("控制主機")), F.lit(" 第二期款項 #SP-C")))
            .when(k == 3, F.concat(F.lit("1998/06/01 - 1998/07/31SPX  HD locker "), F.when(p % 2 == 0, F.lit("控制主櫃")).otherwise(F.lit("B")), F.lit(" payment machine x")))
            .when(k == 4, F.concat(F.lit("1998/06 SPX HD locker 安裝運費 ("), p.cast("string"), F.lit(") _SPX N-SOC more")))
            .otherwise(F.concat(F.lit("\u3000 spx   misc\t"), p.cast("string"), F.lit(" \u3000"))))
    return t.lineitem.select(_line_key("PO").alias("po_line"), F.when(p % 17 != 0, text).alias("item_description"))


#: Texts of the ladder lines, by a rotating index; the month follows the first of them.
LADDER_TEXTS = ["分潤合作 service", "Affiliate commission", "Shopee commission 品牌加碼", "AMS Commission", "Affiliate分潤合作 品牌加碼 Payroll",
                "1998/6 office Rent", "1998-07 倉庫租金", "租賃押金 deposit", "找零金 deposit", "Kiosk computer", "locker 智能櫃", "月租 kiosk 1998/12",
                "保證金 furniture", "vehicle lease", "supplies Cross Month"]
LADDER_STATUS = ["已完成", "部分收貨", "nan", "提早完成", "posted", "已驗收完成", "待驗收"]
LADDER_DEPARTMENTS = ["101 Operations", "XA_OPS north", "XA_HQ", "unitops07 rent", "ab1 team", "305 IT"]


def _pick(texts: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in texts]), index.cast("int"))


def ladder_lines(t: Tables) -> DataFrame:
    """Lines with the fields that the status and flag ladders read, most of
    which may be missing."""
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    qty = F.col("l_quantity").cast("bigint")
    gl = (F.when(p % 11 == 0, F.lit("199999")).when(p % 11 == 1, F.lit("622101")).when(p % 11 == 2, F.lit("650022")).when(p % 11 == 3, F.lit(FA_ACCOUNT))
          .when(p % 11 == 5, F.lit("151101")).when(p % 11 == 6, F.lit("151201"))
          .when(p % 11 != 4, (F.lit(520000) + p % 20).cast("string")))
    return t.lineitem.select(
        _line_key("PO").alias("po_line"), _pick(LADDER_TEXTS, (p + n) % 16).alias("item_description"), gl.alias("gl_number"),
        F.when(p % 3 == 0, F.concat((s % 10).cast("string"), F.lit("00100"))).alias("account_code"),
        F.concat(F.lit("BR"), (p % 25).cast("string")).alias("product_code"),
        F.when(s % 5 == 0, F.lit("")).when(s % 5 == 1, F.lit("nan")).when(s % 5 == 2, F.lit("分潤")).when(s % 5 == 3, F.lit("check")).alias("fn_remark"),
        _pick(LADDER_STATUS, (p + s) % 8).alias("status"),
        F.when(p % 13 == 0, F.lit("HR PAYROLL run")).when(p % 13 < 6, F.lit("task")).alias("task"),
        _pick(LADDER_DEPARTMENTS, s % 7).alias("department"), qty.alias("entry_qty"),
        F.when(p % 7 == 0, F.lit(0).cast("bigint")).when(p % 7 == 1, qty).when(p % 7 != 2, F.expr("cast(l_quantity as bigint) * (l_partkey % 7) div 7")).alias("received_qty"),
        F.when((p + s) % 17 == 0, F.lit("Y")).alias("cross_month"),
        F.when(s % 9 == 0, F.lit("本月勿估")).when(s % 9 < 4, F.lit("ok")).alias("proc_remark"),
        F.concat(F.lit("S"), (s % 12).cast("string")).alias("supplier"),
        F.when(n % 4 == 0, F.lit("Validated")).when(n % 4 == 1, F.lit("open")).when(n % 4 == 2, F.lit("Closed by user"))
         .when(p % 2 == 0, F.lit("Cancelled")).alias("line_status"),
        F.when(p % 10 == 0, F.lit("later")).when(p % 10 == 1, F.lit("")).when(p % 10 != 2, F.date_format("l_shipdate", "yyyy-MM")).alias("receipt_month"),
        F.when(F.col("l_linestatus") == "F", F.lit("1")).otherwise(F.lit("0")).alias("closed_for_invoice"),
        F.when(p % 19 == 0, F.lit("Y")).alias("closed_mark"), F.when((p + n) % 23 == 0, F.lit("Y")).alias("early"),
        (qty * 500).alias("entry_amount"),
        F.lit("N").alias("accrue"), F.lit(None).cast("string").alias("accrual_note"))


def prev_procurement(t: Tables) -> DataFrame:
    """Last month's procurement sheet: document and line apart, no line key;
    a second, later row for returned lines, whose remark may be missing."""
    k = F.col("l_partkey") % 5
    rows = t.lineitem.where(F.col("l_shipdate") < month_start(199806)).withColumn("_ord", F.explode(F.sequence(
        F.lit(1), F.when(F.col("l_returnflag") == "R", F.lit(2)).otherwise(F.lit(1)))))
    return rows.select(
        _po_number().alias("po_number"), F.concat(F.lit("PR"), F.col("l_orderkey").cast("string")).alias("pr_number"),
        F.concat(F.col("l_linenumber").cast("string"), F.lit("-"), _item_ref()).alias("line_number"),
        F.when(k < 2, F.concat(F.lit("remark "), F.col("_ord").cast("string"))).when((k == 2) & (F.col("_ord") == 1), F.lit("held")).alias("remark"),
        F.col("_ord").cast("bigint").alias("_ord"))


def workpaper_sheets(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The accrual sheets of this and the last month, with headers as typed."""
    yes = F.when(F.col("l_returnflag") != "R", F.lit("Y")).otherwise(F.lit("N"))
    text, account = F.concat(F.lit("item "), F.col("l_partkey").cast("string")), (F.lit(520000) + F.col("l_partkey") % 20).cast("string")
    amount, now = F.col("l_quantity").cast("bigint") * 100, F.col("l_linestatus") == "O"
    current = t.lineitem.where(now).select(text, _line_key("PO"), account, F.lit("TWD"), amount, yes).toDF(
        "Item Description", "PO Line", "Account code", "Currency", "Accr. Amount", "是否估計入帳")
    previous = t.lineitem.where(~now).select(text, _po_number(), F.concat(F.lit("-"), F.col("l_linenumber").cast("string"), F.lit("-"), _item_ref()),
                                             account, F.lit("USD"), amount, yes, F.lit("x")).toDF(
        "Item Description", "PO#", "Line#", "Account Code", "Currency_C", "Amount-未稅", "是否需要估計入帳", "Note")
    return current, previous
