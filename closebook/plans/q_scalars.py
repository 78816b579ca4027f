"""Scalar-function queries (F-01 … F-28) over adapter tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from closebook.functions import numbers as N
from closebook.functions import periods as P
from closebook.functions import text as T
from closebook.plans import flows as FL
from closebook.plans.oracle_fns import q
from closebook.plans.registry import register
from closebook.sources import adapter as A
from closebook.sources.adapter_sql import RUN_MONTH
from closebook.sources.testdata import Tables

_nulls = ", ".join(q(x) for x in T.NULL_TEXTS)


def _clean_sql(c: str) -> str:
    return f"CASE WHEN trim({c}) IN ({_nulls}) THEN NULL ELSE trim({c}) END"


@register("clean_strings", f"""
SELECT po_line, voucher_no, {_clean_sql('period')} AS period, {_clean_sql('match_type')} AS match_type
FROM ap_invoice""")
def clean_strings(spark, sf):
    inv = A.ap_invoice(Tables(spark, sf))
    return inv.select("po_line", "voucher_no", T.clean_text(F.col("period")).alias("period"),
                      T.clean_text(F.col("match_type")).alias("match_type"))


@register("string_ops", r"""
SELECT po_line,
  coalesce(regexp_matches(item_description, 'deposit'), false) AS has_deposit,
  regexp_replace(item_description, 'office', 'OFFICE', 'g') AS desc_replaced,
  regexp_extract(item_description, '^(\S+)', 1) AS first_token,
  CAST(len(regexp_extract_all(item_description, '\d+')) AS BIGINT) AS n_numbers,
  coalesce(regexp_matches(item_description, '^small'), false) AS starts_small
FROM po_lines""")
def string_ops(spark, sf):
    d = F.col("item_description")
    return A.po_lines(Tables(spark, sf)).select(
        "po_line",
        F.coalesce(d.rlike("deposit"), F.lit(False)).alias("has_deposit"),
        F.regexp_replace(d, "office", "OFFICE").alias("desc_replaced"),
        F.regexp_extract(d, r"^(\S+)", 1).alias("first_token"),
        F.size(F.regexp_extract_all(d, F.lit(r"\d+"), F.lit(0))).cast("bigint").alias("n_numbers"),
        F.coalesce(d.rlike("^small"), F.lit(False)).alias("starts_small"))


@register("remark_date_format", r"""
SELECT po_line, _ord, fn_remark, regexp_replace(fn_remark, '(\d{4})/(\d{2})', '\1\2', 'g') AS remark_fmt
FROM prev_workpaper""")
def remark_date_format(spark, sf):
    wp = A.prev_workpaper(Tables(spark, sf), RUN_MONTH)
    return wp.select("po_line", "_ord", "fn_remark", P.remark_date_format(F.col("fn_remark")).alias("remark_fmt"))


@register("fa_remark_status", r"""
SELECT po_line, fn_remark_prev,
  CASE WHEN coalesce(regexp_matches(fn_remark_prev, '入FA') AND NOT regexp_matches(fn_remark_prev, '部分完成'), false)
       THEN nullif(regexp_extract(fn_remark_prev, '(\d{6}入FA)', 1), '') END AS fa_status
FROM po_enriched""")
def fa_remark_status(spark, sf):
    en = FL.enrich_po(Tables(spark, sf))
    return en.select("po_line", "fn_remark_prev", T.fa_remark_status(F.col("fn_remark_prev")).alias("fa_status"))


@register("date_format_cols", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  strftime(l_shipdate, '%Y-%m-%d') AS ship_iso, strftime(l_shipdate, '%Y/%m') AS ship_ym_slash,
  strftime(l_shipdate, '%Y-%m') AS ship_month
FROM lineitem""")
def date_format_cols(spark, sf):
    l = Tables(spark, sf).lineitem
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship_iso"),
                    F.date_format("l_shipdate", "yyyy/MM").alias("ship_ym_slash"),
                    F.date_format("l_shipdate", "yyyy-MM").alias("ship_month"))


@register("numeric_coerce", r"""
SELECT line_raw, gl_raw,
  coalesce(CAST(round(TRY_CAST(line_raw AS DOUBLE)) AS BIGINT), 0) AS line_int,
  coalesce(CAST(round(TRY_CAST(gl_raw AS DOUBLE)) AS BIGINT), 0) AS gl_int,
  CAST(nullif(CAST(TRY_CAST(replace(format('{:,.2f}', CAST(billed_amount AS DOUBLE)), ',', '') AS DOUBLE) AS DECIMAL(18,2)), 0) AS DOUBLE) AS billed_clean,
  item_ref, po_number
FROM po_raw""")
def numeric_coerce(spark, sf):
    raw = A.po_raw(Tables(spark, sf))
    return raw.select(
        "line_raw", "gl_raw",
        N.to_int_or_zero(F.col("line_raw")).alias("line_int"),
        N.to_int_or_zero(F.col("gl_raw")).alias("gl_int"),
        N.amount_text_to_money(F.format_number(F.col("billed_amount").cast("double"), 2)).cast("double").alias("billed_clean"),
        "item_ref", "po_number")


@register("format_thousands", """
SELECT po_line, format('{:,.2f}', CAST(entry_amount AS DOUBLE)) AS amount_fmt,
  format('{:,}', entry_qty * 1000) AS qty_fmt
FROM po_lines""")
def format_thousands(spark, sf):
    pl = A.po_lines(Tables(spark, sf))
    return pl.select("po_line", F.format_number(F.col("entry_amount").cast("double"), 2).alias("amount_fmt"),
                     F.format_number(F.col("entry_qty") * 1000, 0).alias("qty_fmt"))


@register("numeric_ops", """
SELECT po_line,
  CAST(entry_qty AS DOUBLE) + CAST(billed_qty AS DOUBLE) AS q_add,
  CAST(entry_qty AS DOUBLE) - CAST(billed_qty AS DOUBLE) AS q_sub,
  CAST(entry_qty AS DOUBLE) * CAST(billed_qty AS DOUBLE) AS q_mul,
  CASE WHEN CAST(billed_qty AS DOUBLE) = 0 THEN CAST(entry_qty AS DOUBLE)
       ELSE CAST(entry_qty AS DOUBLE) / CAST(billed_qty AS DOUBLE) END AS q_div
FROM po_lines""")
def numeric_ops(spark, sf):
    pl = A.po_lines(Tables(spark, sf))
    a, b = F.col("entry_qty").cast("string"), F.col("billed_qty").cast("string")
    return pl.select("po_line", *[N.numeric_op(a, b, op).alias(f"q_{n}") for op, n in
                                  (("add", "add"), ("subtract", "sub"), ("multiply", "mul"), ("divide", "div"))])


@register("safe_divide", """
SELECT po_line, coalesce(CASE WHEN CAST(entry_amount AS DOUBLE) <> 0
  THEN CAST(billed_amount AS DOUBLE) / CAST(entry_amount AS DOUBLE) END, 0.0) AS billed_ratio
FROM po_lines""")
def safe_divide(spark, sf):
    pl = A.po_lines(Tables(spark, sf))
    return pl.select("po_line", N.safe_divide(F.col("billed_amount"), F.col("entry_amount"), F.lit(0.0)).alias("billed_ratio"))


@register("previous_month", f"""
SELECT po_line, CAST(erm AS BIGINT) AS erm,
  CASE WHEN erm > 0 THEN CAST(CASE WHEN erm % 100 = 1 THEN (erm // 100 - 1) * 100 + 12 ELSE erm - 1 END AS BIGINT) END AS prev_month
FROM po_enriched""")
def previous_month(spark, sf):
    en = FL.enrich_po(Tables(spark, sf))
    return en.select("po_line", F.col("erm").cast("bigint").alias("erm"),
                     F.when(F.col("erm") > 0, P.previous_month(F.col("erm")).cast("bigint")).alias("prev_month"))


@register("months_diff", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CAST((year(l_shipdate) - {RUN_MONTH // 100}) * 12 + month(l_shipdate) - {RUN_MONTH % 100} + 1 AS BIGINT) AS months_left
FROM lineitem""")
def months_diff(spark, sf):
    l = Tables(spark, sf).lineitem
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    P.months_diff(F.col("l_shipdate"), RUN_MONTH).alias("months_left"))


@register("product_code_check", r"""
SELECT po_line, project, product_code,
  CASE WHEN coalesce(nullif(regexp_extract(project, '^([\p{L}\p{N}_]+)', 1), '') = product_code, false)
       THEN 'good' ELSE 'bad' END AS product_check
FROM po_lines""")
def product_code_check(spark, sf):
    pl = A.po_lines(Tables(spark, sf))
    return pl.select("po_line", "project", "product_code",
                     T.product_code_check(F.col("project"), F.col("product_code")).alias("product_check"))


_depts = ", ".join(q(d) for d in FL.DEPT_ACCOUNTS)


@register("department_code", f"""
SELECT po_line, gl_number, department,
  CASE WHEN gl_number IN ({_depts}) THEN substr(department, 1, 3) ELSE '{FL.DEFAULT_DEPT}' END AS dept_code
FROM po_lines""")
def department_code(spark, sf):
    pl = A.po_lines(Tables(spark, sf))
    return pl.select("po_line", "gl_number", "department",
                     F.when(F.col("gl_number").isin(*FL.DEPT_ACCOUNTS), F.substring("department", 1, 3))
                      .otherwise(F.lit(FL.DEFAULT_DEPT)).alias("dept_code"))


@register("json_extract", """
SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  json_extract_string(props, '$.missing') AS missing
FROM events""")
def json_extract(spark, sf):
    ev = Tables(spark, sf).events
    k = F.get_json_object("props", "$.k")
    return ev.select("event_id", "event_type", F.when(k.rlike(r"^-?\d+$"), k.cast("bigint")).alias("k"),
                     F.get_json_object("props", "$.missing").alias("missing"))


@register("cumulative_qty", """
SELECT po_line, CAST(CAST(round(coalesce(TRY_CAST(CAST(received_qty AS VARCHAR) AS DOUBLE), 0)
  + coalesce(TRY_CAST(CAST(billed_qty AS VARCHAR) AS DOUBLE), 0)) AS BIGINT) AS VARCHAR) AS cum_qty
FROM po_lines""")
def cumulative_qty(spark, sf):
    pl = A.po_lines(Tables(spark, sf))
    return pl.select("po_line", N.qty_add_text(F.col("received_qty").cast("string"),
                                               F.col("billed_qty").cast("string")).alias("cum_qty"))


@register("discount_rate", r"""
SELECT p_partkey, txt, CASE WHEN v > 0 AND v <= 10 THEN v / 10 END AS rate
FROM (SELECT p_partkey, txt, TRY_CAST(nullif(regexp_extract(txt, '(\d+(?:\.\d+)?)折', 1), '') AS DOUBLE) AS v
      FROM (SELECT p_partkey, CAST(p_size % 12 AS VARCHAR) || '折驗收' AS txt FROM part) a) b""")
def discount_rate(spark, sf):
    p = Tables(spark, sf).part
    txt = F.concat((F.col("p_size") % 12).cast("string"), F.lit("折驗收"))
    return p.select("p_partkey", txt.alias("txt")).select("p_partkey", "txt", T.discount_rate(F.col("txt")).alias("rate"))
