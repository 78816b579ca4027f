"""First slice: raw cleaning, periods, ERM month, lookups, status rules,
accrual fields and the status report."""

from __future__ import annotations

from pyspark.sql import functions as F

from closebook.functions.periods import erm_parse, period_text
from closebook.operators.lookups import asof_latest, map_fields, remark_with_fallback
from closebook.plans import flows as FL
from closebook.plans import oracle_fns as O
from closebook.plans.registry import register
from closebook.sources import adapter as A
from closebook.sources.adapter_sql import RUN_MONTH
from closebook.sources.testdata import Tables

STATUS_COLS = ["po_line", "status", "status_rule", "status_note"]


@register("clean_raw_columns", "SELECT * FROM po_lines")
def clean_raw_columns(spark, sf):
    return A.po_lines(Tables(spark, sf))


@register("period_from_description", f"""
SELECT po_line, item_description, period_start, period_end, period_ok,
       CAST(period_start AS VARCHAR) || ',' || CAST(period_end AS VARCHAR) AS period_text
FROM (SELECT po_line, item_description, {O.period_columns('item_description')} FROM po_lines) x""")
def q_period(spark, sf):
    df = FL.with_period(A.po_lines(Tables(spark, sf)).select("po_line", "item_description"))
    return df.withColumn("period_text", period_text(F.col("period_start"), F.col("period_end")))


@register("erm_parse", f"SELECT po_line, erm_text, {O.erm_parse('erm_text')} AS erm FROM po_lines")
def q_erm(spark, sf):
    return A.po_lines(Tables(spark, sf)).select("po_line", "erm_text", erm_parse(F.col("erm_text")).alias("erm"))


@register("previous_workpaper", f"""
SELECT pl.po_line, {", ".join(f"wp._m_{s} AS {t}" for s, t, _ in FL.WP_MAPPINGS)}
FROM po_lines pl LEFT JOIN ({FL._wp_sql()}) wp ON pl.po_line = wp.po_line""")
def q_prev_wp(spark, sf):
    t = Tables(spark, sf)
    return map_fields(A.po_lines(t).select("po_line"), A.prev_workpaper(t, RUN_MONTH), "po_line", FL.WP_MAPPINGS)


@register("ap_voucher_asof", f"""
SELECT pl.po_line, v.voucher AS voucher_no FROM po_lines pl
LEFT JOIN (SELECT po_line, arg_max(voucher, _p * 1000 + _ord) AS voucher FROM ap_periods WHERE _p <= {RUN_MONTH} GROUP BY po_line) v ON v.po_line = pl.po_line""")
def ap_voucher_asof(spark, sf):
    """J-03: voucher of the latest invoice up to the run month."""
    t = Tables(spark, sf)
    inv = A.ap_invoice(t).withColumn("voucher_no", F.coalesce("voucher_no", F.lit("system_filled")))
    return asof_latest(A.po_lines(t).select("po_line"), inv, "po_line", "period", RUN_MONTH, ["voucher_no"], "gl_date").select("po_line", "voucher_no")


@register("ap_invoice_asof", "SELECT po_line, gl_date, match_type FROM po_enriched")
def q_ap_asof(spark, sf):
    t = Tables(spark, sf)
    inv = A.ap_invoice(t).withColumn("match_type", F.coalesce("match_type", F.lit("system_filled")))
    return asof_latest(A.po_lines(t).select("po_line"), inv, "po_line", "period", RUN_MONTH,
                       ["match_type"], "gl_date")


@register("procurement_remarks", "SELECT po_line, proc_remark, in_procurement FROM po_enriched")
def q_proc(spark, sf):
    t = Tables(spark, sf)
    out = remark_with_fallback(A.po_lines(t).select("po_line", "pr_line"), A.procurement(t),
                               "po_line", "pr_line", "remark", "proc_remark", "in_procurement",
                               A.pr_to_po_line(F.col("pr_line")))
    return out.drop("pr_line")


@register("status_erm", f"SELECT {', '.join(STATUS_COLS)} FROM ({FL.rules_sql('po_enriched', ['receipt_month'])}) s")
def q_status_erm(spark, sf):
    return FL.enriched_and_ruled(Tables(spark, sf), FL.ctx_for(), ["receipt_month"]).select(*STATUS_COLS)


@register("status_stage1", f"SELECT {', '.join(STATUS_COLS)} FROM ({FL.rules_sql('po_enriched', ['special_lines'])}) s")
def q_status_stage1(spark, sf):
    return FL.enriched_and_ruled(Tables(spark, sf), FL.ctx_for(), ["special_lines"]).select(*STATUS_COLS)


@register("format_error_status",
          f"SELECT {', '.join(STATUS_COLS)} FROM ({FL.format_error_sql(FL.rules_sql('po_enriched', ['receipt_month'], set_col=FL.SET))}) s")
def q_format_error(spark, sf):
    df = FL.enriched_and_ruled(Tables(spark, sf), FL.ctx_for(), ["receipt_month"], set_col=FL.SET)
    return FL.format_error_status(df).select(*STATUS_COLS)


@register("accrual_flag", "SELECT po_line, status, accrue FROM po_status")
def q_accrual_flag(spark, sf):
    return FL.ledger(Tables(spark, sf)).select("po_line", "status", "accrue")


ACCR_COLS = ["po_line", "accrue", "account_code", "accr_product", "accr_region", "accr_currency", "accr_dept"]


@register("accrual_amount", f"SELECT {', '.join(ACCR_COLS)}, CAST(accr_amount AS DOUBLE) AS accr_amount FROM po_status")
def q_accrual_amount(spark, sf):
    df = FL.ledger(Tables(spark, sf))
    return df.select(*ACCR_COLS, F.col("accr_amount").cast("double").alias("accr_amount"))


@register("status_distribution", """
SELECT status, n, CAST(n AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) AS share, amount
FROM (SELECT status, count(*) AS n, CAST(sum(entry_amount) AS DOUBLE) AS amount
      FROM po_status GROUP BY status) g""")
def q_status_distribution(spark, sf):
    """A-04: status counts, share of all lines, amount.  The share window runs
    over the grouped result (one row per status), never over the lines."""
    from pyspark.sql import Window

    g = (FL.ledger(Tables(spark, sf)).groupBy("status")
         .agg(F.count(F.lit(1)).alias("n"), F.sum("entry_amount").cast("double").alias("amount")))
    return g.withColumn("share", F.col("n").cast("double") / F.sum("n").over(Window.partitionBy()).cast("double"))


def accrued_by_account(spark, sf):
    """Flagship: accrued amount by account and status.  Lines not accrued are left
    out while summing: a filter before it would be pushed through the rule stages
    and repeat them all."""
    y = F.col("accrue") == "Y"
    return (FL.ledger(Tables(spark, sf)).groupBy("account_code", "status")
            .agg(F.count_if(y).alias("lines"), F.sum(F.when(y, F.col("accr_amount"))).cast("double").alias("accr_amount"))
            .where(F.col("lines") > 0))


register("accrued_by_account", """
SELECT account_code, status, count(*) AS lines, CAST(sum(accr_amount) AS DOUBLE) AS accr_amount
FROM po_status WHERE accrue = 'Y' GROUP BY account_code, status""")(accrued_by_account)
