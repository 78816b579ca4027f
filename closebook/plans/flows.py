"""Composed monthly flows (Spark side) and their SQL twins.

PO flow: lines → ERM month + service period → previous-workpaper fields →
AP invoice as-of → procurement remarks → status rule sets → format errors →
accrual flag and accounting fields.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closebook.functions.numbers import money
from closebook.functions.periods import erm_parse, with_period_columns
from closebook.functions.text import apart
from closebook.operators import rules as R
from closebook.operators.lookups import asof_latest, map_fields, remark_with_fallback
from closebook.plans import oracle_fns as O
from closebook.sources import adapter as A
from closebook.sources.adapter_sql import RUN_MONTH, cte
from closebook.sources.testdata import Tables

# previous workpaper field mapping: (source, target, fill_na)
WP_MAPPINGS = [
    ("fn_remark", "fn_remark_prev", True),
    ("fn_pr_remark", "fn_pr_remark_prev", True),
    ("status", "status_prev", True),
    ("account_code", "account_code_prev", True),
    ("reviewer", "reviewer_fn", True),
    ("reviewer", "reviewer_proc", True),
]
# Fixed values (our synthetic chart): accounts whose department is kept, and
# the default department code for every other accrued row.
DEPT_ACCOUNTS = ("520004", "520005", "520006", "520007")
DEFAULT_DEPT = "000"
REGION = "TW"
COMPLETED = "completed"

PO_LINE_TYPES = {
    "po_number": "string", "pr_number": "string", "item_ref": "string", "product_code": "string",
    "supplier": "string", "department": "string", "requester": "string", "project": "string",
    "currency": "string", "item_description": "string", "entry_qty": "bigint", "received_qty": "bigint",
    "billed_qty": "bigint", "prepay_qty": "bigint", "unit_price": "decimal(18,2)",
    "entry_amount": "decimal(18,2)", "billed_amount": "decimal(18,2)", "erm_text": "string",
    "closed_for_invoice": "string", "line_number": "string", "gl_number": "string",
    "po_line": "string", "pr_line": "string",
}
ENRICHED_TYPES = {
    **PO_LINE_TYPES, "erm": "int", "period_start": "int", "period_end": "int", "period_ok": "boolean",
    "fn_remark_prev": "string", "fn_pr_remark_prev": "string", "status_prev": "string",
    "account_code_prev": "string", "reviewer_fn": "string", "reviewer_proc": "string",
    "gl_date": "bigint", "match_type": "string", "proc_remark": "string", "in_procurement": "boolean",
}


def with_period(df: DataFrame, desc: str = "item_description") -> DataFrame:
    return with_period_columns(df, desc, "period")


def enrich_po(t: Tables, run_month: int = RUN_MONTH, ctx: R.Ctx | None = None, rule_sets=(), own: dict | None = None) -> DataFrame:
    """Lines with periods and the fields looked up.  ``rule_sets``: sets that
    will be applied with ``ctx``; their checks on the lines' own columns, and the
    columns ``own``, are worked out before the lookups, so that these carry
    the results instead of the texts."""
    lines = A.po_lines(t).withColumn("erm", apart(erm_parse(F.col("erm_text"))))
    lines = with_period(lines)
    if rule_sets:
        lines = R.mark_own_checks(lines, rule_sets, ctx)
    if own:
        lines = lines.withColumns({c: apart(v) for c, v in own.items()})
    lines = map_fields(lines, A.prev_workpaper(t, run_month), "po_line", WP_MAPPINGS)
    inv = A.ap_invoice(t).withColumn("match_type", F.coalesce("match_type", F.lit("system_filled")))
    lines = asof_latest(lines, inv, "po_line", "period", run_month, ["match_type"], "gl_date")
    lines = remark_with_fallback(lines, A.procurement(t), "po_line", "pr_line", "remark",
                                 "proc_remark", "in_procurement", A.pr_to_po_line(F.col("pr_line")))
    return lines


def ctx_for(run_month: int = RUN_MONTH, doc_type: str = "PO", columns: dict | None = None) -> R.Ctx:
    return R.Ctx(run_month=run_month, columns=dict(columns or ENRICHED_TYPES), doc_type=doc_type)


SET = "status_set"  # the rule set that decided; a rule number counts inside its set


def format_error_status(df: DataFrame, status_col: str = "status", label: str = "format_error") -> DataFrame:
    """R-31: open rows whose description period cannot be parsed (the open
    set is recomputed after the rule sets)."""
    hit = F.col(status_col).isNull() & ~F.col("period_ok")
    return (df.withColumn("status_rule", F.when(hit, F.lit(900).cast("bigint")).otherwise(F.col("status_rule")))
              .withColumn(SET, F.when(hit, F.lit("format_error")).otherwise(F.col(SET)))
              .withColumn("status_note", F.when(hit, F.lit("description period unparsable")).otherwise(F.col("status_note")))
              .withColumn(status_col, apart(F.when(hit, F.lit(label)).otherwise(F.col(status_col)))))


def accrual_fields(df: DataFrame, doc_type: str = "PO", status_col: str = "status") -> DataFrame:
    """D-01/D-02 (+F-25): accrue flag from the status, then accounting fields on
    accrued rows only."""
    if doc_type == "PO":
        flag = F.coalesce(F.col(status_col).rlike(COMPLETED), F.lit(False))
        amount = money(F.col("unit_price") * (F.col("entry_qty") - F.col("billed_qty")))
    else:
        flag = F.coalesce(F.col(status_col) == F.lit(COMPLETED), F.lit(False))
        amount = money(F.col("entry_amount"))
    y = F.col("accrue") == "Y"
    return (df.withColumn("accrue", apart(F.when(flag, F.lit("Y")).otherwise(F.lit("N"))))
              .withColumns({
                  "account_code": F.when(y, F.col("gl_number")),
                  "accr_product": F.when(y, F.col("product_code")),
                  "accr_region": F.when(y, F.lit(REGION)),
                  "accr_currency": F.when(y, F.col("currency")),
                  "accr_amount": F.when(y, amount),
                  "accr_dept": F.when(y & F.col("gl_number").isin(*DEPT_ACCOUNTS), F.substring("department", 1, 3))
                                 .when(y, F.lit(DEFAULT_DEPT)),
              }))


def enriched_and_ruled(t: Tables, ctx: R.Ctx, rule_sets, own: dict | None = None, **kw) -> DataFrame:
    """Enriched lines after ``rule_sets``, one set after the other."""
    df = enrich_po(t, ctx.run_month, ctx, rule_sets, own)
    for rs in rule_sets:
        df = R.apply_rules(df, R.load_rules(rs), ctx, **kw)
    return df.drop(*{column for column, _ in ctx.marks.values()})


def po_status(t: Tables, run_month: int = RUN_MONTH, rule_sets=("special_lines", "receipt_month"), own: dict | None = None) -> DataFrame:
    return accrual_fields(format_error_status(enriched_and_ruled(t, ctx_for(run_month), rule_sets, own, set_col=SET)))


def ledger(t: Tables, run_month: int = RUN_MONTH, own: dict | None = None) -> DataFrame:
    """The month's classified ledger as a plan: a report that reads it once
    computes the columns it needs and writes nothing in between."""
    return po_status(t, run_month, own=own)


def accrued(led: DataFrame, *cols: str) -> DataFrame:
    """``cols`` of the accrued lines.  A filter on the flag would be pushed through
    the rule stages and repeat them all; one on an exploded row stays above them."""
    row = F.when(F.col("accrue") == "Y", F.struct(*cols))
    return led.select(F.explode_outer(F.array(row)).alias("_row")).where(F.col("_row").isNotNull()).select("_row.*")


# --------------------------------------------------------------------------
# SQL twins
# --------------------------------------------------------------------------

def _wp_sql() -> str:
    srcs = list(dict.fromkeys(s for s, _, _ in WP_MAPPINGS))
    aggs = ", ".join(f"arg_max({s}, _ord) FILTER (WHERE {s} IS NOT NULL) AS _m_{s}" for s in srcs)
    return f"SELECT po_line, {aggs} FROM prev_workpaper WHERE po_line IS NOT NULL GROUP BY po_line"


cte("ap_periods", """
  SELECT po_line, _ord, CASE WHEN regexp_full_match(period, '[0-9]{4}(0[1-9]|1[0-2])') THEN CAST(period AS BIGINT) ELSE 0 END AS _p,
    coalesce(match_type, 'system_filled') AS mt, coalesce(voucher_no, 'system_filled') AS voucher FROM ap_invoice WHERE po_line IS NOT NULL""")
cte("po_enriched", f"""
  SELECT pl.*,
    {O.erm_parse('pl.erm_text')} AS erm,
    {O.period_columns('pl.item_description')},
    {", ".join(f"wp._m_{s} AS {t}" for s, t, _ in WP_MAPPINGS)},
    CAST(ap.gl_date AS BIGINT) AS gl_date, ap.match_type,
    coalesce(p1._r1, p2._r2) AS proc_remark,
    coalesce(p1._in1, p2._in2, false) AS in_procurement
  FROM po_lines pl
  LEFT JOIN ({_wp_sql()}) wp ON pl.po_line = wp.po_line
  LEFT JOIN (SELECT po_line, max(_p) AS gl_date, arg_max(mt, _p * 1000 + _ord) AS match_type
             FROM ap_periods WHERE _p <= {RUN_MONTH} GROUP BY po_line) ap ON pl.po_line = ap.po_line
  LEFT JOIN (SELECT po_line, max(remark) AS _r1, true AS _in1 FROM procurement
             WHERE po_line IS NOT NULL GROUP BY po_line) p1 ON pl.po_line = p1.po_line
  LEFT JOIN (SELECT pr_line, max(remark) AS _r2, true AS _in2 FROM procurement
             WHERE pr_line IS NOT NULL GROUP BY pr_line) p2 ON pl.pr_line = p2.pr_line""")


def rules_sql(source: str, rule_sets, columns: dict | None = None, run_month: int = RUN_MONTH,
              doc_type: str = "PO", extra: dict | None = None, **kw) -> str:
    cols = dict(columns or ENRICHED_TYPES)
    sql = f"SELECT * FROM {source}"
    for rs in rule_sets:
        ctx = ctx_for(run_month, doc_type, cols)
        for k, v in (extra or {}).items():
            setattr(ctx, k, v)
        sql = R.apply_rules_sql(sql, cols, R.load_rules(rs), ctx, **kw)
        cols.update({"status": "string", "status_rule": "bigint", "status_note": "string"} | ({kw["set_col"]: "string"} if "set_col" in kw else {}))
    return sql


def format_error_sql(src: str) -> str:
    hit = "(status IS NULL AND NOT period_ok)"
    return (f"SELECT * REPLACE (CASE WHEN {hit} THEN CAST(900 AS BIGINT) ELSE status_rule END AS status_rule, "
            f"CASE WHEN {hit} THEN 'format_error' ELSE {SET} END AS {SET}, "
            f"CASE WHEN {hit} THEN 'description period unparsable' ELSE status_note END AS status_note, "
            f"CASE WHEN {hit} THEN 'format_error' ELSE status END AS status) FROM ({src}) fe")


def accrual_sql(src: str, doc_type: str = "PO") -> str:
    if doc_type == "PO":
        flag = f"coalesce(regexp_matches(status, '{COMPLETED}'), false)"
        amount = "CAST(unit_price * (entry_qty - billed_qty) AS DECIMAL(18,2))"
    else:
        flag = f"coalesce(status = '{COMPLETED}', false)"
        amount = "CAST(entry_amount AS DECIMAL(18,2))"
    depts = ", ".join(O.q(d) for d in DEPT_ACCOUNTS)
    return f"""SELECT *,
      CASE WHEN accrue = 'Y' THEN gl_number END AS account_code,
      CASE WHEN accrue = 'Y' THEN product_code END AS accr_product,
      CASE WHEN accrue = 'Y' THEN '{REGION}' END AS accr_region,
      CASE WHEN accrue = 'Y' THEN currency END AS accr_currency,
      CASE WHEN accrue = 'Y' THEN {amount} END AS accr_amount,
      CASE WHEN accrue = 'Y' AND gl_number IN ({depts}) THEN substr(department, 1, 3)
           WHEN accrue = 'Y' THEN '{DEFAULT_DEPT}' END AS accr_dept
    FROM (SELECT *, CASE WHEN {flag} THEN 'Y' ELSE 'N' END AS accrue FROM ({src}) a0) a1"""


cte("po_status", accrual_sql(format_error_sql(rules_sql("po_enriched", ("special_lines", "receipt_month"), set_col=SET))))
