"""Inputs of a run, last month's procurement remarks, the variance sheets (S-15, S-23, J-07, J-15, P-10, P-11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from closebook.operators import worksheets as W
from closebook.operators.lookups import copy_pr_columns, map_fields
from closebook.plans.registry import register
from closebook.sources import adapter as A
from closebook.sources.adapter_sql import RUN_MONTH
from closebook.sources.inputs import Input, load_inputs
from closebook.sources.testdata import Tables


def _previous_sql(doc):
    key = f"{doc.lower()}_line"
    return (f"SELECT '{doc}' AS doc_type, pl.{key} AS line_key, pp.r AS prev_remark FROM po_lines pl LEFT JOIN (SELECT {key}, "
            f"arg_max(remark, _ord) FILTER (WHERE remark IS NOT NULL) AS r FROM prev_procurement GROUP BY {key}) pp ON pl.{key} = pp.{key}")


@register("procurement_previous", f"{_previous_sql('PO')} UNION ALL {_previous_sql('PR')}")
def procurement_previous(spark, sf):
    """J-15: last month's procurement remark by PO or PR line; the sheet has no
    key, so it is built from document and line."""
    t = Tables(spark, sf)
    lines, sheet, out = A.po_lines(t), A.prev_procurement(t), None
    for doc in ("PO", "PR"):
        key = f"{doc.lower()}_line"
        side = W.with_line_key(sheet, key, f"{doc.lower()}_number", "line_number").select(key, "remark", "_ord")
        part = map_fields(lines.select(key), side, key, [("remark", "prev_remark", True)])
        part = part.select(F.lit(doc).alias("doc_type"), F.col(key).alias("line_key"), "prev_remark")
        out = part if out is None else out.unionByName(part)
    return out


# The standard columns, their aliases and the previous sheet's formula.
STANDARD = ["item_description", "po_line", "account_code", "currency_c", "amount"]
ALIASES = {"amount": ["amount", "accr._amount", "amount-未稅"], "currency_c": ["currency_c", "currency"], "po_line": ["po_line"],
           "account_code": ["account_code"], "item_description": ["item_description"]}
FORMULAS = {"po_line": ["po#", "line#"]}


@register("variance_prepare", """
SELECT 'current' AS sheet, CAST(100 * CAST(l.l_quantity AS BIGINT) AS BIGINT) AS amount, 'TWD' AS currency_c, pl.po_line,
  CAST(520000 + l.l_partkey % 20 AS VARCHAR) AS account_code, 'item ' || CAST(l.l_partkey AS VARCHAR) AS item_description
FROM (SELECT *, 'PO' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR)
    || '-' || strftime(l_shipdate, '%Y%m%d') || '-' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS po_line FROM lineitem) l, LATERAL (SELECT l.po_line) pl
WHERE l.l_returnflag <> 'R' AND l.l_linestatus = 'O'
UNION ALL SELECT 'previous', CAST(100 * CAST(l_quantity AS BIGINT) AS BIGINT), 'USD', 'PO' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-'
    || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) || '-' || strftime(l_shipdate, '%Y%m%d') || '-' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR),
  CAST(520000 + l_partkey % 20 AS VARCHAR), 'item ' || CAST(l_partkey AS VARCHAR)
FROM lineitem WHERE l_returnflag <> 'R' AND l_linestatus <> 'O'""")
def variance_prepare(spark, sf):
    """P-10, P-11: both months' sheets brought to the standard columns, which
    come in the configured order with the sheet's name in front."""
    now, before = A.workpaper_sheets(Tables(spark, sf))
    now = W.prepare_worksheet(now, "是否估計入帳", "Y", STANDARD, ALIASES).withColumn("sheet", F.lit("current"))
    before = W.prepare_worksheet(before, "是否需要估計入帳", "Y", STANDARD, ALIASES, FORMULAS).withColumn("sheet", F.lit("previous"))
    return W.lead_columns(now.unionByName(before), ["sheet", "amount", "currency_c", "absent"])


@register("pr_remark_copy", """
SELECT pl.pr_line, wp.r AS fn_remark, wp.r AS fn_remark_pr FROM po_lines pl LEFT JOIN (SELECT pr_line,
  arg_max(fn_pr_remark, _ord) FILTER (WHERE fn_pr_remark IS NOT NULL) AS r FROM prev_workpaper GROUP BY pr_line) wp ON pl.pr_line = wp.pr_line""")
def pr_remark_copy(spark, sf):
    """J-07: last month's remarks by PR line; the PR remark takes the place of
    the other."""
    t = Tables(spark, sf)
    out = map_fields(A.po_lines(t).select("pr_line"), A.prev_workpaper(t, RUN_MONTH), "pr_line",
                     [("fn_remark", "fn_remark", True), ("fn_pr_remark", "fn_remark_pr", True)])
    return copy_pr_columns(out, ["fn_remark", "absent"])


@register("load_inputs", """
SELECT 'lines' AS input, count(*) AS n FROM lineitem UNION ALL SELECT 'po', count(*) FROM orders UNION ALL SELECT 'products', count(*) FROM part""")
def load_inputs_query(spark, sf):
    """S-15, S-23: the inputs of a run that are there, with their rows; the PR
    list is missing, which one of PO and PR may be."""
    at = f"{sf.rstrip('/')}/{{}}.parquet".format
    found = load_inputs(spark, {
        "lines": Input(at("lineitem"), required=True, columns=("l_orderkey", "l_linenumber"), not_empty=True),
        "po": Input(at("orders"), columns=("o_orderkey",)), "pr": Input(at("purchase_requests")), "products": Input(at("part"))}, one_of=("po", "pr"))
    out = None
    for name, df in found.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("input"), "n")
        out = part if out is None else out.unionByName(part)
    return out
