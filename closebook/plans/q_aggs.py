"""Aggregation/report queries (A, O, U, W families)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from closebook.operators import aggregates as AG
from closebook.plans import flows as FL
from closebook.plans.registry import register
from closebook.sources import adapter as A
from closebook.sources.adapter_sql import RUN_MONTH
from closebook.sources.testdata import Tables

_PIVOT_SQL = """
SELECT CASE WHEN grouping(product_code) = 1 THEN 'Total' ELSE product_code END AS product_code,
       CASE WHEN grouping(currency) = 1 THEN 'Total' ELSE currency END AS currency,
       CAST(sum(coalesce(CAST(entry_amount AS DECIMAL(18,2)), 0)) AS DOUBLE) AS total_amount,
       count(*) AS n
FROM {src} GROUP BY CUBE (product_code, currency)"""


@register("shape_pivot", _PIVOT_SQL.format(src="po_lines"))
def shape_pivot(spark, sf):
    return AG.shape_pivot(A.po_lines(Tables(spark, sf)), "product_code", "currency", "entry_amount")


@register("shape_report", _PIVOT_SQL.format(src="""(SELECT * FROM po_lines
  WHERE coalesce(regexp_matches(item_description, 'deposit|rent'), false)
    AND NOT coalesce(regexp_matches(item_description, 'office'), false)
    AND currency IN ('TWD', 'USD'))"""))
def shape_report(spark, sf):
    d = F.col("item_description")
    pl = A.po_lines(Tables(spark, sf)).where(
        F.coalesce(d.rlike("deposit|rent"), F.lit(False)) & ~F.coalesce(d.rlike("office"), F.lit(False))
        & F.col("currency").isin("TWD", "USD"))
    return AG.shape_pivot(pl, "product_code", "currency", "entry_amount")


@register("shape_compare", """
SELECT metric, raw_value, processed_value, processed_value - raw_value AS difference FROM (
  SELECT 'rows' AS metric, CAST((SELECT count(*) FROM po_raw) AS DOUBLE) AS raw_value,
         CAST((SELECT count(*) FROM po_status) AS DOUBLE) AS processed_value
  UNION ALL SELECT 'amount', CAST((SELECT sum(entry_amount) FROM po_raw) AS DOUBLE),
         CAST((SELECT sum(entry_amount) FROM po_status) AS DOUBLE)
  UNION ALL SELECT 'accrued_amount', 0.0, CAST((SELECT sum(accr_amount) FROM po_status) AS DOUBLE)) m""")
def shape_compare(spark, sf):
    """A-02: raw vs processed totals as metric rows (two global aggregates)."""
    t = Tables(spark, sf)
    raw = A.po_raw(t).agg(F.count(F.lit(1)).alias("n"), F.sum("entry_amount").alias("amt"))
    proc = FL.po_status(t).agg(F.count(F.lit(1)).alias("n"), F.sum("entry_amount").alias("amt"),
                               F.sum("accr_amount").alias("accr"))
    j = raw.crossJoin(proc.select(F.col("n").alias("pn"), F.col("amt").alias("pamt"), "accr"))  # 1 x 1 rows
    rows = F.array(
        F.struct(F.lit("rows").alias("metric"), F.col("n").cast("double").alias("raw_value"),
                 F.col("pn").cast("double").alias("processed_value")),
        F.struct(F.lit("amount").alias("metric"), F.col("amt").cast("double").alias("raw_value"),
                 F.col("pamt").cast("double").alias("processed_value")),
        F.struct(F.lit("accrued_amount").alias("metric"), F.lit(0.0).alias("raw_value"),
                 F.col("accr").cast("double").alias("processed_value")))
    out = j.select(F.explode(rows).alias("m")).select("m.*")
    return out.withColumn("difference", F.col("processed_value") - F.col("raw_value"))


@register("status_top5", """
SELECT status, n FROM (SELECT status, count(*) AS n FROM po_status GROUP BY status) g
ORDER BY n DESC, status NULLS FIRST LIMIT 5""")
def status_top5(spark, sf):
    g = FL.ledger(Tables(spark, sf)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.col("n").desc(), F.col("status").asc_nulls_first()).limit(5)


@register("rule_hits", """
SELECT status_set, status_rule, status, count(*) AS hits FROM po_status WHERE status_rule IS NOT NULL
GROUP BY status_set, status_rule, status""")
def rule_hits(spark, sf):
    """A-14: hits by rule set and rule; rule numbers repeat between sets.  Lines
    without a rule are left out while counting (see ``accrued_by_account``)."""
    return (FL.ledger(Tables(spark, sf)).groupBy("status_set", "status_rule", "status")
            .agg(F.count("status_rule").alias("hits")).where(F.col("hits") > 0))


@register("group_stats", """
SELECT currency, count(*) AS n, CAST(sum(entry_amount) AS DOUBLE) AS sum_amount,
  CAST(sum(entry_amount) AS DOUBLE) / CAST(count(entry_amount) AS DOUBLE) AS mean_amount,
  CAST(sum(entry_qty) AS BIGINT) AS sum_qty
FROM po_lines GROUP BY currency""")
def group_stats(spark, sf):
    g = A.po_lines(Tables(spark, sf)).groupBy("currency").agg(
        F.count(F.lit(1)).alias("n"), F.sum("entry_amount").cast("double").alias("sum_amount"),
        (F.sum("entry_amount").cast("double") / F.count("entry_amount").cast("double")).alias("mean_amount"),
        F.sum("entry_qty").cast("bigint").alias("sum_qty"))
    return g


_TEXT_COLS = ["gl_number", "product_code", "currency", "erm_text", "supplier"]
_NUMBER_COLS = ["entry_qty", "billed_qty", "unit_price"]
_SHARES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def _text_profile_sql(c):
    return f"""SELECT '{c}' AS column, (SELECT count({c}) FROM po_lines) AS non_null, (SELECT count(*) - count({c}) FROM po_lines) AS nulls,
      count(*) AS distinct_values, min(v) AS min_text, max(v) AS max_text, arg_max(v, r) AS top, CAST(max(n) AS BIGINT) AS freq,
      NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min_value, NULL::DOUBLE AS q25, NULL::DOUBLE AS q50, NULL::DOUBLE AS q75, NULL::DOUBLE AS max_value
      FROM (SELECT *, n * 1000000 - row_number() OVER (ORDER BY v) AS r FROM (SELECT {c} AS v, count(*) AS n FROM po_lines WHERE {c} IS NOT NULL GROUP BY {c}) g) h"""


def _number_profile_sql(c):
    q = ", ".join(f"CAST(quantile_disc({c}, {p}) AS DOUBLE)" for p in _SHARES.values())
    return f"""SELECT '{c}', count({c}), count(*) - count({c}), NULL::BIGINT, NULL, NULL, NULL, NULL::BIGINT, round(avg(CAST({c} AS DOUBLE)), 6),
      round(stddev_samp(CAST({c} AS DOUBLE)), 6), CAST(min({c}) AS DOUBLE), {q}, CAST(max({c}) AS DOUBLE) FROM po_lines"""


@register("profile_columns", "SELECT *, CAST(nulls AS DOUBLE) / (non_null + nulls) AS null_ratio FROM (" + " UNION ALL ".join(
    [*map(_text_profile_sql, _TEXT_COLS), *map(_number_profile_sql, _NUMBER_COLS)]) + ") p")
def profile_columns(spark, sf):
    return AG.profile_columns(A.po_lines(Tables(spark, sf)), _TEXT_COLS, _NUMBER_COLS, _SHARES)


@register("quality_report", """
SELECT 'null_ratio_over_limit' AS check_name, col_name AS subject, CAST(null_ratio AS DOUBLE) AS value
FROM (SELECT 'gl_number' AS col_name, CAST(count(*) FILTER (WHERE gl_number IS NULL) AS DOUBLE) / count(*) AS null_ratio FROM po_lines
      UNION ALL SELECT 'proc_remark', CAST(count(*) FILTER (WHERE proc_remark IS NULL) AS DOUBLE) / count(*) FROM po_enriched
      UNION ALL SELECT 'gl_date', CAST(count(*) FILTER (WHERE gl_date IS NULL) AS DOUBLE) / count(*) FROM po_enriched) r
WHERE null_ratio > 0.5
UNION ALL
SELECT 'duplicate_rows', 'product_code,currency,entry_qty',
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT product_code, currency, entry_qty FROM po_lines) d) AS DOUBLE)
FROM po_lines""")
def quality_report(spark, sf):
    """A-11: null ratios above a limit and exact-duplicate rows as issue rows."""
    en = FL.enrich_po(Tables(spark, sf))
    ratios = en.agg(*[(F.count_if(F.col(c).isNull()).cast("double") / F.count(F.lit(1)).cast("double")).alias(c)
                      for c in ("gl_number", "proc_remark", "gl_date")])
    stack = ratios.select(F.explode(F.array(*[F.struct(F.lit(c).alias("subject"), F.col(c).alias("value"))
                                              for c in ("gl_number", "proc_remark", "gl_date")])).alias("s"))
    nulls = stack.where(F.col("s.value") > 0.5).select(F.lit("null_ratio_over_limit").alias("check_name"),
                                                         "s.subject", "s.value")
    keys = ["product_code", "currency", "entry_qty"]
    dup = (en.select(*keys).agg(F.count(F.lit(1)).alias("n"))
           .crossJoin(en.select(*keys).distinct().agg(F.count(F.lit(1)).alias("d")))  # 1 x 1 rows
           .select(F.lit("duplicate_rows").alias("check_name"), F.lit(",".join(keys)).alias("subject"),
                   (F.col("n") - F.col("d")).cast("double").alias("value")))
    return nulls.unionByName(dup)


@register("validation_report", f"""
SELECT 'negative_amount' AS issue, count(*) FILTER (WHERE entry_amount < 0) AS n FROM po_status
UNION ALL SELECT 'zero_amount_accrual', count(*) FILTER (WHERE accrue = 'Y' AND coalesce(accr_amount, 0) = 0) FROM po_status
UNION ALL SELECT 'dept_conflict', count(*) FILTER (WHERE accrue = 'Y' AND accr_dept <> '{FL.DEFAULT_DEPT}' AND substr(department, 1, 3) <> accr_dept) FROM po_status
UNION ALL SELECT 'incomplete_period', count(*) FILTER (WHERE accrue = 'Y' AND NOT period_ok) FROM po_status""")
def validation_report(spark, sf):
    """A-12: one conditional count per business rule, one pass."""
    df = FL.ledger(Tables(spark, sf))
    y = F.col("accrue") == "Y"
    checks = {
        "negative_amount": F.col("entry_amount") < 0,
        "zero_amount_accrual": y & (F.coalesce(F.col("accr_amount"), F.lit(0)) == 0),
        "dept_conflict": y & (F.col("accr_dept") != FL.DEFAULT_DEPT) & (F.substring("department", 1, 3) != F.col("accr_dept")),
        "incomplete_period": y & ~F.col("period_ok"),
    }
    wide = df.agg(*[F.count_if(c).alias(k) for k, c in checks.items()])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("issue"), F.col(k).alias("n"))
                                           for k in checks])).alias("r")).select("r.*")


CAPITAL_LIMIT = 80000


@register("installment_limit", f"""
SELECT po_line, po_number, CAST(doc_fa_amount AS DOUBLE) AS doc_fa_amount,
  CASE WHEN doc_fa_amount IS NOT NULL AND doc_fa_amount < {CAPITAL_LIMIT} THEN 'below_capital_limit' END AS limit_flag
FROM po_lines pl LEFT JOIN (SELECT po_number AS d, sum(entry_amount) AS doc_fa_amount FROM po_lines
  WHERE gl_number = '171000' GROUP BY po_number) g ON pl.po_number = g.d""")
def installment_limit(spark, sf):
    """A-13 (Q5 applied): documents with FA lines whose FA total is under the
    capital limit are flagged on every line."""
    pl = A.po_lines(Tables(spark, sf))
    g = pl.where(F.col("gl_number") == "171000").groupBy("po_number").agg(F.sum("entry_amount").alias("doc_fa_amount"))
    out = pl.select("po_line", "po_number").join(g, "po_number", "left")
    return out.select("po_line", "po_number", F.col("doc_fa_amount").cast("double").alias("doc_fa_amount"),
                      F.when(F.col("doc_fa_amount") < CAPITAL_LIMIT, F.lit("below_capital_limit")).alias("limit_flag"))


@register("ledger_pivot", """
SELECT account_code, accr_currency, CAST(sum(accr_amount) AS DOUBLE) AS accr_amount, count(*) AS lines
FROM po_status WHERE accrue = 'Y' GROUP BY account_code, accr_currency""")
def ledger_pivot(spark, sf):
    y = F.col("accrue") == "Y"  # counted, not filtered: see accrued_by_account
    return (FL.ledger(Tables(spark, sf)).groupBy("account_code", "accr_currency")
            .agg(F.sum(F.when(y, F.col("accr_amount"))).cast("double").alias("accr_amount"), F.count_if(y).alias("lines"))
            .where(F.col("lines") > 0))


@register("dedup_last", """
SELECT po_line, _ord, fn_remark, account_code FROM (
  SELECT *, row_number() OVER (PARTITION BY po_line ORDER BY _ord DESC) AS rn FROM prev_workpaper) w WHERE rn = 1""")
def dedup_last(spark, sf):
    wp = A.prev_workpaper(Tables(spark, sf), RUN_MONTH)
    return AG.dedup_last(wp, "po_line", "_ord", ["fn_remark", "account_code"])


@register("dedup_first", """
SELECT po_line, _ord, fn_remark, account_code FROM (
  SELECT *, row_number() OVER (PARTITION BY po_line ORDER BY _ord) AS rn FROM prev_workpaper) w WHERE rn = 1""")
def dedup_first(spark, sf):
    wp = A.prev_workpaper(Tables(spark, sf), RUN_MONTH)
    return AG.dedup_first(wp, "po_line", "_ord", ["fn_remark", "account_code"])


@register("dedup_rows", "SELECT DISTINCT po_number, product_code, currency FROM po_lines")
def dedup_rows(spark, sf):
    return A.po_lines(Tables(spark, sf)).select("po_number", "product_code", "currency").dropDuplicates()


@register("top_n", """
SELECT po_line, CAST(entry_amount AS DOUBLE) AS entry_amount FROM po_lines
ORDER BY entry_amount DESC, po_line LIMIT 10""")
def top_n(spark, sf):
    pl = A.po_lines(Tables(spark, sf))
    return (pl.select("po_line", F.col("entry_amount").cast("double").alias("entry_amount"))
              .orderBy(F.col("entry_amount").desc(), "po_line").limit(10))


@register("union_all", """
SELECT 'PO' AS doc_type, po_line AS line_key, CAST(entry_amount AS DOUBLE) AS amount, NULL::VARCHAR AS remark FROM po_lines
UNION ALL SELECT 'WP', po_line, NULL::DOUBLE, fn_remark FROM prev_workpaper""")
def union_all(spark, sf):
    t = Tables(spark, sf)
    a = A.po_lines(t).select(F.lit("PO").alias("doc_type"), F.col("po_line").alias("line_key"),
                             F.col("entry_amount").cast("double").alias("amount"))
    b = A.prev_workpaper(t, RUN_MONTH).select(F.lit("WP").alias("doc_type"), F.col("po_line").alias("line_key"),
                                               F.col("fn_remark").alias("remark"))
    return AG.union_all([a, None, b])


@register("po_set_ops", """
SELECT 'both' AS side, count(*) AS n FROM (SELECT po_line FROM ap_invoice INTERSECT SELECT po_line FROM procurement) a
UNION ALL SELECT 'invoice_only', count(*) FROM (SELECT po_line FROM ap_invoice EXCEPT SELECT po_line FROM procurement) b
UNION ALL SELECT 'procurement_only', count(*) FROM (SELECT po_line FROM procurement WHERE po_line IS NOT NULL
                                                   EXCEPT SELECT po_line FROM ap_invoice) c""")
def po_set_ops(spark, sf):
    """U-02: membership split of line keys between two lists."""
    t = Tables(spark, sf)
    inv = A.ap_invoice(t).select("po_line")
    pro = A.procurement(t).where(F.col("po_line").isNotNull()).select("po_line")
    parts = [("both", inv.intersect(pro)), ("invoice_only", inv.subtract(pro)), ("procurement_only", pro.subtract(inv))]
    return AG.union_all([d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("side"), "n") for k, d in parts])
