"""SQL twin of ``adapter`` for the DuckDB oracle.

Each derived table is a named CTE over the driver's views; ``with_ctes``
prepends the transitive closure of the CTEs a query body uses.
"""

from __future__ import annotations

import re

from closebook.sources.adapter import DEPARTMENTS, LADDER_DEPARTMENTS, LADDER_STATUS, LADDER_TEXTS, TYPE_PHRASES

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def _deps(sql: str) -> list[str]:
    return [n for n in CTES if re.search(rf"\b{n}\b", sql)]


def with_ctes(body: str) -> str:
    order: list[str] = []

    def visit(name: str, stack: tuple = ()):
        if name in order:
            return
        for d in _deps(CTES[name]):
            if d != name and d not in stack:
                visit(d, stack + (name,))
        order.append(name)

    for n in _deps(body):
        visit(n)
    if not order:
        return body
    # MATERIALIZED keeps filters and counts from being rewritten through the rule
    # stages, whose nested CASE texts grow with every stage.
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED (\n{CTES[n]}\n)" for n in order) + "\n" + body


def ym_text_sql(idx: str) -> str:
    return (f"(CAST(({idx}) // 12 AS VARCHAR) || '/' || "
            f"lpad(CAST(({idx}) % 12 + 1 AS VARCHAR), 2, '0'))")


def int_text_sql(c: str) -> str:
    return f"CAST(CAST(round(TRY_CAST({c} AS DOUBLE)) AS BIGINT) AS VARCHAR)"


_dept = "CASE l.l_suppkey % 8 " + " ".join(
    f"WHEN {i} THEN '{d}'" for i, d in enumerate(DEPARTMENTS)) + " END"
_phrase = "CASE p.p_type " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in TYPE_PHRASES.items()) + " END"
_ship = "(year(l.l_shipdate) * 12 + month(l.l_shipdate) - 1)"
_period = f"""CASE l.l_partkey % 5
      WHEN 0 THEN {ym_text_sql(_ship + ' - 1')} || ' - ' || {ym_text_sql(_ship + ' + 1')}
      WHEN 1 THEN {ym_text_sql(_ship)}
      WHEN 2 THEN {ym_text_sql(_ship)} || '/01 - ' || {ym_text_sql(_ship + ' + 2')} || '/28'
      WHEN 3 THEN CAST({_ship} // 12 AS VARCHAR) || '/13'
    END"""
_qty = "CAST(l.l_quantity AS BIGINT)"
_ref = ("concat_ws('-', CAST(l.l_partkey AS VARCHAR), CAST(l.l_suppkey AS VARCHAR), "
        "strftime(l.l_shipdate, '%Y%m%d'), CAST(CAST(l.l_quantity AS BIGINT) AS VARCHAR))")
_half = f"({_qty} // 2)"
_price = "CAST(p.p_retailprice AS DECIMAL(18,2))"

cte("po_raw", f"""
  SELECT
    'PO' || CAST(l.l_orderkey AS VARCHAR) AS po_number,
    'PR' || CAST(l.l_orderkey AS VARCHAR) AS pr_number,
    CASE WHEN l.l_linestatus = 'O' THEN CAST(l.l_linenumber AS VARCHAR) || '.0'
         ELSE CAST(l.l_linenumber AS VARCHAR) END AS line_raw,
    {_ref} AS item_ref,
    CASE l.l_partkey % 20 WHEN 0 THEN '171000' WHEN 1 THEN '614100' WHEN 2 THEN 'N.A.'
         WHEN 3 THEN NULL WHEN 4 THEN CAST(520000 + l.l_partkey % 20 AS VARCHAR) || '.0'
         ELSE CAST(520000 + l.l_partkey % 20 AS VARCHAR) END AS gl_raw,
    'BR' || substr(p.p_brand, 7) AS product_code,
    s.s_name AS supplier,
    {_dept} AS department,
    'U' || CAST(o.o_custkey AS VARCHAR) AS requester,
    CASE WHEN l.l_linestatus = 'F' THEN 'BR' || substr(p.p_brand, 7) || ' ' || lower(p.p_type)
         ELSE 'GEN ' || lower(p.p_type) END AS project,
    CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'USD' WHEN o.o_orderpriority = '2-HIGH' THEN 'EUR'
         ELSE 'TWD' END AS currency,
    concat_ws(' ', p.p_name, {_phrase}, {_period}) AS item_description,
    {_qty} AS entry_qty,
    CASE WHEN l.l_linestatus = 'F' THEN {_qty} ELSE {_half} END AS received_qty,
    CASE WHEN l.l_returnflag = 'R' THEN {_qty} WHEN l.l_returnflag = 'A' THEN {_half}
         ELSE CAST(0 AS BIGINT) END AS billed_qty,
    CASE WHEN l.l_discount = 0.0 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS prepay_qty,
    {_price} AS unit_price,
    CAST({_price} * {_qty} AS DECIMAL(18,2)) AS entry_amount,
    CAST({_price} * CASE WHEN l.l_returnflag = 'R' THEN {_qty} WHEN l.l_returnflag = 'A' THEN {_half}
         ELSE 0 END AS DECIMAL(18,2)) AS billed_amount,
    CASE WHEN l.l_discount = 0.1 AND l.l_tax = 0.0 THEN 'TBD'
         ELSE strftime(l.l_shipdate, '%b-%y') END AS erm_text,
    CASE WHEN o.o_orderstatus = 'F' THEN '1' ELSE '0' END AS closed_for_invoice
  FROM lineitem l
  LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
  LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey""")

cte("po_lines", f"""
  SELECT * EXCLUDE (line_raw, gl_raw),
    {int_text_sql('line_raw')} AS line_number,
    {int_text_sql("coalesce(nullif(trim(gl_raw), 'N.A.'), '666666')")} AS gl_number,
    po_number || '-' || {int_text_sql('line_raw')} || '-' || item_ref AS po_line,
    pr_number || '-' || {int_text_sql('line_raw')} || '-' || item_ref AS pr_line
  FROM po_raw""")


def _line_key_sql(prefix: str) -> str:
    return (f"'{prefix}' || CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) || '-' "
            f"|| {_ref}")


def month_start_sql(run_month: int) -> str:
    return f"TIMESTAMP '{run_month // 100:04d}-{run_month % 100:02d}-01 00:00:00'"


RUN_MONTH = 199806  # the run month of every registered query

_v7 = "((l.l_partkey + l.l_suppkey) % 7)"
cte("prev_workpaper", f"""
  SELECT {_line_key_sql('PO')} AS po_line, {_line_key_sql('PR')} AS pr_line, CAST(1 AS BIGINT) AS _ord,
    CASE WHEN l.l_linestatus = 'F' THEN 'posted' END AS status,
    CASE {_v7} WHEN 0 THEN '已完成' WHEN 1 THEN '已入帳' WHEN 2 THEN '199801入FA'
      WHEN 3 THEN 'check 1998/01 invoice' WHEN 4 THEN '未完成' END AS fn_remark,
    CASE WHEN l.l_returnflag = 'A' THEN '未完成' END AS fn_pr_remark,
    CAST(520000 + l.l_partkey % 20 AS VARCHAR) AS account_code,
    'R' || CAST(l.l_suppkey % 5 AS VARCHAR) AS reviewer
  FROM lineitem l WHERE l.l_shipdate < {month_start_sql(RUN_MONTH)}
  UNION ALL
  SELECT {_line_key_sql('PO')}, {_line_key_sql('PR')}, CAST(2 AS BIGINT), CAST(NULL AS VARCHAR),
    CASE WHEN {_v7} % 2 = 1 THEN '已完成' END, CAST(NULL AS VARCHAR), '520099', CAST(NULL AS VARCHAR)
  FROM lineitem l WHERE l.l_shipdate < {month_start_sql(RUN_MONTH)} AND l.l_returnflag = 'R'""")

cte("procurement", f"""
  SELECT CASE WHEN l.l_returnflag = 'N' THEN {_line_key_sql('PO')} END AS po_line,
    {_line_key_sql('PR')} AS pr_line,
    CASE l.l_partkey % 4 WHEN 0 THEN '已完成' WHEN 1 THEN 'rent' WHEN 2 THEN 'error' END AS remark
  FROM lineitem l WHERE l.l_linestatus = 'O'""")

cte("ap_invoice", f"""
  SELECT {_line_key_sql('PO')} AS po_line,
    CASE WHEN l.l_partkey % 11 = 0 AND l.k = 0 THEN 'N/A'
      ELSE CAST(((year(l.l_shipdate) * 12 + month(l.l_shipdate) - 1 + l.k) // 12) * 100
                + (year(l.l_shipdate) * 12 + month(l.l_shipdate) - 1 + l.k) % 12 + 1 AS VARCHAR) END AS period,
    CASE WHEN l.l_tax <> 0.0 THEN 'ITEM_TO_RECEIPT' END AS match_type,
    CASE WHEN l.l_tax <> 0.02 THEN 'V' || CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) || '-' || CAST(l.k AS VARCHAR) END AS voucher_no,
    CAST(l.k AS BIGINT) AS _ord
  FROM (SELECT *, unnest(generate_series(0, l_linenumber % 3)) AS k FROM lineitem WHERE l_returnflag <> 'N') l""")

cte("closing_list", """
  SELECT 'PO' || CAST(o_orderkey AS VARCHAR) AS po_number,
    CASE o_orderpriority WHEN '5-LOW' THEN 'ALL' WHEN '4-NOT SPECIFIED' THEN 'Line1~3' WHEN '3-MEDIUM' THEN 'Line1、 3,x、5~4,4~3~2' END AS line_spec,
    CASE WHEN o_totalprice > 200000 THEN 'V' ELSE '' END AS done,
    CAST(o_orderdate AS DATE) AS close_date,
    CASE WHEN o_custkey % 5 = 1 THEN '' WHEN o_custkey % 5 <> 2 THEN 'PR' || CAST(o_orderkey AS VARCHAR) END AS new_pr
  FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED', '3-MEDIUM')""")

cte("closing_lines", r"""
  SELECT po_number, unnest(generate_series(CAST(split_part(part, '~', 1) AS BIGINT), CAST(split_part(part, '~', -1) AS BIGINT))) AS line_no, done, new_pr
  FROM (SELECT po_number, done, new_pr, trim(unnest(string_split_regex(regexp_replace(line_spec, '^Line', ''), '[、,]'))) AS part
        FROM closing_list WHERE starts_with(line_spec, 'Line')) p
  WHERE regexp_full_match(part, '[0-9]{1,18}(~[0-9]{1,18})?')""")

_ship_month = "CAST(year(l.l_shipdate) * 100 + month(l.l_shipdate) AS INTEGER)"
_inst = "((l.l_partkey + l.l_linenumber) % 7)"
cte("asset_lines", f"""
  SELECT 'PO' || CAST(l.l_orderkey AS VARCHAR) AS po_number, {_line_key_sql('PO')} AS po_line,
    CASE WHEN l.l_partkey % 20 = 0 THEN '171000' ELSE CAST(520000 + l.l_partkey % 20 AS VARCHAR) END AS gl_number,
    CASE WHEN {_inst} = 0 THEN '設備 驗收款' WHEN {_inst} = 1 THEN '設備 驗收 保固款' WHEN {_inst} = 2 THEN '設備 訂金'
      WHEN {_inst} = 3 AND l.l_suppkey % 2 = 0 THEN '設備 安裝款' WHEN {_inst} < 6 THEN 'supplies' END AS item_description,
    CASE WHEN l.l_tax <> 0.0 THEN {_ship_month} END AS erm,
    CASE WHEN l.l_returnflag = 'R' AND l.l_suppkey % 3 = 0 THEN 'PR 已完成' WHEN l.l_returnflag = 'A' THEN '未完成' END AS proc_remark,
    CASE WHEN l.l_linestatus = 'F' AND l.l_discount = 0.0 THEN 'posted' WHEN l.l_discount = 0.1 THEN 'to_check' END AS status,
    CASE WHEN l.l_discount = 0.1 THEN 'by hand' END AS status_note, 'N' AS accrue
  FROM lineitem l""")

_cab = "((l.l_partkey + l.l_linenumber) % 25)"
_accepted = """CASE WHEN l.l_partkey % 13 = 0 THEN NULL WHEN l.l_partkey % 13 = 1 THEN 'pending'
      WHEN l.l_partkey % 2 = 0 THEN strftime(l.l_shipdate, '%Y/%m/%d') ELSE strftime(l.l_shipdate, '%Y-%m-%d') END"""
_po = "'PO' || CAST(l.l_orderkey AS VARCHAR)"


def acceptance_ctes(cabinets: tuple[str, ...], cabinet_texts: list[str]) -> None:
    """The acceptance and operations sheets and the cabinet lines."""
    sums = ",\n    ".join(f'CASE WHEN {_cab} = {i} THEN {_qty} END AS "{c}"' for i, c in enumerate(cabinets))
    cte("acceptance_sheet", f"""
  SELECT {_line_key_sql('PO')} AS _ord, {_po} AS po_number,
    CASE l.l_suppkey % 6 WHEN 0 THEN '8折驗收' WHEN 1 THEN '8.5折出貨' WHEN 2 THEN '9折' END AS discount,
    {_accepted} AS accepted_on,
    {sums}
  FROM lineitem l""")
    cte("kiosk_sheet", f"SELECT {_po} AS po_number, {_accepted} AS accepted_on FROM lineitem l WHERE l.l_partkey % 9 = 0")
    cell = f"CASE WHEN l.l_suppkey % 10 = 0 THEN '#REF!' ELSE CAST({_qty} AS VARCHAR) END"
    blank = " ELSE ''"
    cells = ",\n    ".join(f"CASE WHEN {_cab} = {i} THEN {cell}{blank if i % 4 == 0 else ''} END AS \"{c}\""
                           for i, c in enumerate(cabinets))
    cte("operations_sheet", f"""
  SELECT ' ' || {_po} || CASE WHEN l.l_linestatus = 'O' THEN '.0 ' ELSE '' END AS po_line_text, {_po} AS po_number, {_accepted} AS accepted_on,
    {cells}
  FROM lineitem l""")
    texts = ", ".join(f"'{x}'" for x in cabinet_texts)
    cte("cabinet_lines", f"""
  SELECT {_po} AS po_number, {_line_key_sql('PO')} AS po_line, 'S' || CAST(l.l_suppkey % 7 AS VARCHAR) AS supplier,
    CASE WHEN l.l_partkey % 9 = 0 THEN '1998/06 SVP_SPX 門市繳費機工程 payment machine #SP-C'
      WHEN l.l_partkey % 10 = 3 THEN '門市裝修工程 第二期款項' WHEN l.l_partkey % 10 = 4 THEN '辦公室裝修'
      WHEN l.l_partkey % 31 <> 5 THEN '1998/06 SVP_SPX 門市智取櫃工程SPX ' || CASE WHEN l.l_suppkey % 11 = 0 THEN 'HD ' ELSE '' END || 'locker '
        || ([{texts}])[{_cab} + 1]
        || CASE l.l_partkey % 3 WHEN 0 THEN '第一期款項 #SP-C' WHEN 1 THEN ' 訂金 #SP-C' ELSE ' 30%款項 #SP-C' END
        || CASE WHEN l.l_suppkey % 8 = 7 THEN ' 減價' ELSE '' END END AS item_description,
    CAST(100 + l.l_partkey % 900 AS DECIMAL(18,2)) AS unit_price, 'BR' || CAST(l.l_partkey % 25 AS VARCHAR) AS product_code, 'TWD' AS currency,
    CASE WHEN l.l_partkey % 11 = 0 THEN '' WHEN l.l_partkey % 11 <> 1 THEN CAST({_qty} + l.l_suppkey % 2 AS VARCHAR) END AS cumulative_qty,
    'N' AS accrue, CAST(NULL AS VARCHAR) AS account_code, CAST(NULL AS DOUBLE) AS accr_amount
  FROM lineitem l""")


def address_sql(c: str) -> str:
    return (f"(CASE ({c} // 2) % 4 WHEN 0 THEN '台北市中山區' WHEN 1 THEN '新北市板橋區' WHEN 2 THEN '彰化縣員林市' ELSE '大安區' END || '民生路' || "
            f"CAST({c} // 2 AS VARCHAR) || '號' || CASE {c} % 3 WHEN 1 THEN '1樓' WHEN 2 THEN '之2' ELSE '' END)")


def _day_sql(start: str, offset: str, fmt: str) -> str:
    return f"strftime(DATE '{start}' + CAST({offset} AS INTEGER), '{fmt}')"


_s, _d = "%Y/%m/%d", "%Y-%m-%d"
_f1, _f2 = (lambda f: _day_sql("1997-01-05", "p_partkey % 300", f)), (lambda f: _day_sql("1998-01-05", "p_partkey % 900", f))
cte("filing_list", f"""
  SELECT CASE WHEN p_partkey % 19 = 0 THEN ' ' ELSE CAST(p_partkey AS VARCHAR) END AS A, {address_sql('p_partkey')} AS B,
    CASE p_partkey % 8 WHEN 0 THEN {_f1(_s)} || ' - ' || {_f2(_s)} WHEN 1 THEN {_f1(_s)} || '~' || {_f2(_s)} WHEN 2 THEN {_f1(_s)} || '至' || {_f2(_s)} || ' +'
      WHEN 3 THEN {_f1(_s)} || '-' || {_f2(_s)} WHEN 4 THEN {_f1(_d)} || ' - ' || {_f2(_d)} WHEN 5 THEN {_f1(_d)} || '~' || {_f2(_d)} WHEN 6 THEN 'TBD' END AS C
  FROM part""")
cte("renewal_list", f"""
  SELECT CAST(p_partkey AS VARCHAR) AS site, CASE WHEN p_partkey % 23 <> 0 THEN {address_sql('p_partkey')} END AS addr,
    {_day_sql('1996-06-01', 'p_partkey % 500', _s)} AS d1,
    CASE WHEN p_partkey % 7 = 0 THEN 'open' ELSE {_day_sql('1998-03-01', 'p_partkey % 1000', _d)} END AS d2 FROM part WHERE p_partkey % 3 <> 0""")
_k6 = "((l.l_orderkey + l.l_linenumber) % 6)"
cte("site_lines", f"""
  SELECT {_line_key_sql('PO')} AS po_line, CASE WHEN l.l_partkey % 17 <> 0 THEN CASE {_k6}
    WHEN 0 THEN '1998/06 SVP_SPX 門市裝修工程-店' || l.l_partkey || ' (' || {address_sql('l.l_partkey')} || ') SPX store decoration 第一期款項 #SP-C'
    WHEN 1 THEN '1998/06 SVP_SPX 冷氣裝修工程Air-con equipment(' || {address_sql('l.l_partkey')} || ') #SP-C'
    WHEN 2 THEN '1998/06 SVP_SPX 門市智取櫃工程SPX locker ' || CASE WHEN l.l_partkey % 2 = 0 THEN 'XA' ELSE '控制主機' END || ' 第二期款項 #SP-C'
    WHEN 3 THEN '1998/06/01 - 1998/07/31SPX  HD locker ' || CASE WHEN l.l_partkey % 2 = 0 THEN '控制主櫃' ELSE 'B' END || ' payment machine x'
    WHEN 4 THEN '1998/06 SPX HD locker 安裝運費 (' || l.l_partkey || ') _SPX N-SOC more'
    ELSE chr(12288) || ' spx   misc' || chr(9) || l.l_partkey || ' ' || chr(12288) END END AS item_description FROM lineitem l""")
_r1, _r2 = _day_sql("1996-06-01", "p_partkey % 500", _s), _day_sql("1998-03-01", "p_partkey % 1000", _s)


def _pick_sql(texts: list[str], index: str) -> str:
    return f"([{', '.join(repr(x) for x in texts)}])[({index}) + 1]"


cte("ladder_lines", f"""
  SELECT {_line_key_sql('PO')} AS po_line, {_pick_sql(LADDER_TEXTS, '(l.l_partkey + l.l_linenumber) % 16')} AS item_description,
    CASE l.l_partkey % 11 WHEN 0 THEN '199999' WHEN 1 THEN '622101' WHEN 2 THEN '650022' WHEN 3 THEN '171000' WHEN 4 THEN NULL WHEN 5 THEN '151101' WHEN 6 THEN '151201'
      ELSE CAST(520000 + l.l_partkey % 20 AS VARCHAR) END AS gl_number,
    CASE WHEN l.l_partkey % 3 = 0 THEN CAST(l.l_suppkey % 10 AS VARCHAR) || '00100' END AS account_code,
    'BR' || CAST(l.l_partkey % 25 AS VARCHAR) AS product_code,
    CASE l.l_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'nan' WHEN 2 THEN '分潤' WHEN 3 THEN 'check' END AS fn_remark,
    {_pick_sql(LADDER_STATUS, '(l.l_partkey + l.l_suppkey) % 8')} AS status,
    CASE WHEN l.l_partkey % 13 = 0 THEN 'HR PAYROLL run' WHEN l.l_partkey % 13 < 6 THEN 'task' END AS task,
    {_pick_sql(LADDER_DEPARTMENTS, 'l.l_suppkey % 7')} AS department, CAST(l.l_quantity AS BIGINT) AS entry_qty,
    CASE l.l_partkey % 7 WHEN 0 THEN 0 WHEN 1 THEN CAST(l.l_quantity AS BIGINT) WHEN 2 THEN NULL
      ELSE CAST(l.l_quantity AS BIGINT) * (l.l_partkey % 7) // 7 END AS received_qty,
    CASE WHEN (l.l_partkey + l.l_suppkey) % 17 = 0 THEN 'Y' END AS cross_month,
    CASE WHEN l.l_suppkey % 9 = 0 THEN '本月勿估' WHEN l.l_suppkey % 9 < 4 THEN 'ok' END AS proc_remark,
    'S' || CAST(l.l_suppkey % 12 AS VARCHAR) AS supplier,
    CASE WHEN l.l_linenumber % 4 = 0 THEN 'Validated' WHEN l.l_linenumber % 4 = 1 THEN 'open' WHEN l.l_linenumber % 4 = 2 THEN 'Closed by user'
      WHEN l.l_partkey % 2 = 0 THEN 'Cancelled' END AS line_status,
    CASE l.l_partkey % 10 WHEN 0 THEN 'later' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE strftime(l.l_shipdate, '%Y-%m') END AS receipt_month,
    CASE WHEN l.l_linestatus = 'F' THEN '1' ELSE '0' END AS closed_for_invoice,
    CASE WHEN l.l_partkey % 19 = 0 THEN 'Y' END AS closed_mark, CASE WHEN (l.l_partkey + l.l_linenumber) % 23 = 0 THEN 'Y' END AS early,
    CAST(l.l_quantity AS BIGINT) * 500 AS entry_amount, 'N' AS accrue, CAST(NULL AS VARCHAR) AS accrual_note
  FROM lineitem l""")

cte("prev_procurement", f"""
  SELECT {_line_key_sql('PO')} AS po_line, {_line_key_sql('PR')} AS pr_line, o.o AS _ord,
    CASE WHEN l.l_partkey % 5 < 2 THEN 'remark ' || CAST(o.o AS VARCHAR) WHEN l.l_partkey % 5 = 2 AND o.o = 1 THEN 'held' END AS remark
  FROM lineitem l JOIN (SELECT unnest([1, 2]) AS o) o ON o.o = 1 OR l.l_returnflag = 'R'
  WHERE l.l_shipdate < {month_start_sql(RUN_MONTH)}""")
