"""Acceptance quantities and reconciliation (A-05 to A-08, D-03, F-19, F-21,
F-23, J-16, J-17, O-04, S-24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from closebook.operators import acceptance as AC
from closebook.plans import flows as FL
from closebook.plans.oracle_fns import q
from closebook.plans.registry import register
from closebook.sources import adapter as A
from closebook.sources.adapter_sql import RUN_MONTH, acceptance_ctes, cte
from closebook.sources.testdata import Tables

#: How the derived lines name the types.
LINE_TEXTS = [{"DA": "控制主機", "裝運費": "安裝運費"}.get(c, c) for c in AC.CABINETS]
CABINET_SUPPLIERS, KIOSK_SUPPLIERS = ["S0", "S1", "S2", "S3", "S4"], ["S2", "S4", "S5"]
acceptance_ctes(AC.CABINETS, LINE_TEXTS)

_day = "try_strptime(replace(trim(accepted_on), '/', '-'), '%Y-%m-%d')"
_ym = f"(year({_day}) * 100 + month({_day}))"
_cols = ", ".join(f'"{c}"' for c in AC.CABINETS)
_disc = f"coalesce(regexp_matches(discount, {q(AC.DISCOUNT)}), false)"


def _has(text: str) -> str:
    return f"coalesce(regexp_matches(item_description, {q('(?i)' + text)}), false)"


def _re2(cabinet: str) -> str:
    """The type's pattern without look-ahead."""
    return AC.cabinet_pattern(cabinet).replace("(?![A-Za-z0-9])", "([^A-Za-z0-9]|$)")


_cabinet = "CASE " + " ".join(f"WHEN {_has(_re2(c))} THEN {q(c)}" for c in AC.priority()) + " END"
cte("accepted", f"""
  SELECT po_number, kind, cabinet_type, CAST(coalesce(sum(v), 0) AS BIGINT) AS quantity FROM (
    SELECT po_number, CASE WHEN {_disc} THEN 'discount' ELSE 'plain' END AS kind, unnest([{', '.join(map(q, AC.CABINETS))}]) AS cabinet_type,
      unnest([{_cols}]) AS v FROM acceptance_sheet WHERE {_ym} = {RUN_MONTH}) x GROUP BY po_number, kind, cabinet_type
  UNION ALL SELECT po_number, 'kiosk', 'kiosk', count(*) FROM kiosk_sheet WHERE {_ym} = {RUN_MONTH} GROUP BY po_number""")
_rate = f"""(SELECT TRY_CAST(nullif(regexp_extract(d, '(\\d+(?:\\.\\d+)?)折', 1), '') AS DOUBLE) / 10
  FROM (SELECT arg_min(discount, _ord) AS d FROM acceptance_sheet WHERE {_ym} = {RUN_MONTH} AND {_disc}) z)"""
_listed = ", ".join(map(q, CABINET_SUPPLIERS))
cte("accepted_lines", f"""
  SELECT *, CASE WHEN second THEN {_rate} END AS discount,
    CAST(CASE WHEN (CASE WHEN second THEN qd ELSE qp END) = 0 AND {_has(AC.KIOSK_MARK)} AND supplier IN ({', '.join(map(q, KIOSK_SUPPLIERS))}) THEN coalesce(qk, 0)
      WHEN second THEN qd ELSE qp END AS BIGINT) AS accepted_qty
  FROM (SELECT *, qp = 0 AND qd IS NOT NULL AS second FROM (
    SELECT c.*, CASE WHEN {_has(AC.REDUCED_MARK)} THEN 0 ELSE coalesce(p.quantity, 0) END AS qp, d.quantity AS qd, k.quantity AS qk
    FROM (SELECT *, CASE WHEN {_has(AC.CABINET_MARK)} AND supplier IN ({_listed}) THEN {_cabinet} END AS cabinet_type FROM cabinet_lines) c
    LEFT JOIN accepted p ON p.kind = 'plain' AND p.po_number = c.po_number AND p.cabinet_type = c.cabinet_type
    LEFT JOIN accepted d ON d.kind = 'discount' AND d.po_number = c.po_number AND d.cabinet_type = c.cabinet_type
    LEFT JOIN accepted k ON k.kind = 'kiosk' AND k.po_number = c.po_number) x) y""")


def _totals(t):
    return AC.acceptance_totals(A.acceptance_sheet(t, AC.CABINETS), A.kiosk_sheet(t), RUN_MONTH)


def _lines(t):
    return A.cabinet_lines(t, LINE_TEXTS)


def _accepted(t):
    rate = AC.month_rate(A.acceptance_sheet(t, AC.CABINETS), RUN_MONTH)
    return AC.apply_quantities(_lines(t), _totals(t), rate, CABINET_SUPPLIERS, KIOSK_SUPPLIERS)


@register("acceptance_agg", "SELECT po_number, kind, cabinet_type, quantity FROM accepted")
def acceptance_agg(spark, sf):
    """A-05: the month's quantities by document, kind and type."""
    return _totals(Tables(spark, sf))


@register("cabinet_priority", f"SELECT po_line, {_cabinet} AS cabinet_type FROM cabinet_lines")
def cabinet_priority(spark, sf):
    """F-21: first type of the priority list that the text names."""
    return _lines(Tables(spark, sf)).select("po_line", AC.cabinet_by_priority(F.col("item_description")).alias("cabinet_type"))


@register("acceptance_apply", "SELECT po_line, cabinet_type, accepted_qty, discount FROM accepted_lines")
def acceptance_apply(spark, sf):
    """J-17: accepted quantities on the lines."""
    return _accepted(Tables(spark, sf)).select("po_line", "cabinet_type", "accepted_qty", "discount")


@register("acceptance_amount", f"""
SELECT po_line, accepted_qty, CASE WHEN hit THEN 'Y' ELSE accrue END AS accrue, CASE WHEN hit THEN '{A.FA_ACCOUNT}' END AS account_code,
  CASE WHEN hit THEN '{AC.CLEARING_NAME}' END AS account_name, CASE WHEN hit THEN product_code END AS accr_product,
  CASE WHEN hit THEN '{FL.REGION}' END AS accr_region, CASE WHEN hit THEN '{FL.DEFAULT_DEPT}' END AS accr_dept,
  CASE WHEN hit THEN currency END AS accr_currency,
  CASE WHEN hit AND {_has(AC.FEE_LINE)} THEN CAST(accepted_qty AS DOUBLE)
    WHEN hit THEN CAST(unit_price AS DOUBLE) * accepted_qty * coalesce(discount, 1.0::DOUBLE) END AS accr_amount,
  CASE WHEN hit THEN '{AC.CLEARING_LIABILITY}' END AS liability
FROM (SELECT *, accepted_qty <> 0 AS hit FROM accepted_lines) a""")
def acceptance_amount(spark, sf):
    """D-03: accounting fields of accepted lines."""
    out = AC.accepted_fields(_accepted(Tables(spark, sf)), A.FA_ACCOUNT, FL.REGION, FL.DEFAULT_DEPT)
    return out.select("po_line", "accepted_qty", "accrue", "account_code", "account_name", "accr_product", "accr_region", "accr_dept",
                      "accr_currency", "accr_amount", "liability")


_name = f"trim(regexp_extract(item_description, {q(AC.CABINET_IN_TEXT)}, 1))"
for _a, _b in AC.RENAMED:
    _name = f"replace({_name}, {q(_a)}, {q(_b)})"
_name = f"nullif({_name}, '')"
_cell = "CASE WHEN v LIKE '%REF%' THEN 0 ELSE coalesce(TRY_CAST(nullif(v, '') AS DOUBLE), 0) END"
cte("ops_totals", f"""
  SELECT po_number, locker_type, amount, sum(CASE WHEN locker_type LIKE '%{AC.FEE}%' THEN 0 ELSE amount END) OVER (PARTITION BY po_number) AS ops_locker_count
  FROM (SELECT po_number, locker_type, sum({_cell}) AS amount FROM (
    SELECT po_number, unnest([{', '.join(map(q, AC.CABINETS))}]) AS locker_type, unnest([{_cols}]) AS v
    FROM operations_sheet WHERE {_ym} < {RUN_MONTH}) x GROUP BY po_number, locker_type) y""")
cte("memo_totals", f"""
  SELECT po_number, locker_type, coalesce(sum(TRY_CAST(nullif(cumulative_qty, '') AS DOUBLE)), 0) AS memo_sum,
    CAST(sum(count(*)) OVER (PARTITION BY po_number) AS BIGINT) AS accounting_locker_count
  FROM (SELECT DISTINCT po_number, cumulative_qty, {_name} AS locker_type FROM cabinet_lines) x WHERE locker_type IS NOT NULL GROUP BY po_number, locker_type""")
cte("compared", """
  SELECT coalesce(a.po_number, o.po_number) AS po_number, coalesce(a.locker_type, o.locker_type) AS locker_type, memo_sum, amount,
    CASE WHEN memo_sum IS NULL THEN 'ops_only' WHEN amount IS NULL THEN 'accounting_only' WHEN memo_sum = amount THEN 'matched' ELSE 'mismatched' END AS status
  FROM memo_totals a FULL JOIN ops_totals o ON a.po_number = o.po_number AND a.locker_type = o.locker_type""")


def _operations(t):
    return AC.operations_totals(A.operations_sheet(t, AC.CABINETS), RUN_MONTH)


def _compared(spark, sf):
    t = Tables(spark, sf)
    return AC.reconcile(AC.accounting_totals(_lines(t)), _operations(t))


@register("ops_totals_long", "SELECT po_number, locker_type, amount, ops_locker_count FROM ops_totals")
def ops_totals_long(spark, sf):
    """A-06: operations totals by document and type."""
    return _operations(Tables(spark, sf)).select("po_number", "locker_type", "amount", "ops_locker_count")


@register("accounting_totals", "SELECT po_number, locker_type, memo_sum, accounting_locker_count FROM memo_totals")
def accounting_totals(spark, sf):
    """A-07: accounting totals by document and type."""
    return AC.accounting_totals(_lines(Tables(spark, sf))).select("po_number", "locker_type", "memo_sum", "accounting_locker_count")


@register("reconcile_outer", "SELECT po_number, locker_type, memo_sum, amount, status FROM compared ORDER BY po_number, locker_type DESC")
def reconcile_outer(spark, sf):
    """J-16, O-04: outcome by document and type, in report order."""
    return AC.ordered(_compared(spark, sf))


cte("outcomes", """
  SELECT count(*)::DOUBLE AS total, count(*) FILTER (WHERE status = 'matched')::DOUBLE AS matched,
    count(*) FILTER (WHERE status = 'mismatched')::DOUBLE AS mismatched, count(*) FILTER (WHERE status = 'accounting_only')::DOUBLE AS accounting_only,
    count(*) FILTER (WHERE status = 'ops_only')::DOUBLE AS ops_only FROM compared""")


@register("reconcile_report", """
SELECT unnest(['total', 'matched', 'mismatched', 'accounting_only', 'ops_only', 'match_rate']) AS metric,
  unnest([total, matched, mismatched, accounting_only, ops_only, CASE WHEN total > 0 THEN matched * 100 / total ELSE 0 END]) AS value FROM outcomes""")
def reconcile_report(spark, sf):
    """A-08: totals by outcome and match rate."""
    return AC.reconcile_report(_compared(spark, sf))


@register("ops_standardize", f"""
SELECT regexp_replace(trim(po_line_text), '\\.0$', '') AS po_line_text, po_number, CAST(date_trunc('month', {_day}) AS DATE) AS accepted_on
FROM operations_sheet WHERE {_day} IS NOT NULL""")
def ops_standardize(spark, sf):
    """S-24: cleaned texts, months parsed, rows without a month left out."""
    return AC.standardised(A.operations_sheet(Tables(spark, sf), AC.CABINETS), ["po_line_text", "po_number", "accepted_on"])


@register("installment_flag", f"""
SELECT po_line, CASE WHEN {_has(AC.DECORATION)} AND {_has(AC.INSTALMENT)} THEN '{AC.BY_INSTALMENT}' WHEN {_has(AC.DECORATION)} THEN '{AC.GENERAL}' END AS installment
FROM cabinet_lines""")
def installment_flag(spark, sf):
    """F-23: decoration lines by instalment or in general."""
    return _lines(Tables(spark, sf)).select("po_line", AC.installment_flag(F.col("item_description")).alias("installment"))
