"""Lookup/predicate queries (J, P, U-03, X families)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from closebook.operators import rules as R
from closebook.operators.lookups import dedup_lookup, join_generic
from closebook.plans import flows as FL
from closebook.plans.registry import register
from closebook.sources import adapter as A
from closebook.sources.adapter_sql import RUN_MONTH
from closebook.sources.testdata import Tables


def line_ranges(cl):
    """F-06: 'Line1~3、5' → one row (po_number, lo, hi, done, new_pr) per part
    of the spec.  Parts that are no number or span, and reversed spans, go;
    specs that do not start with 'Line' (such as 'ALL') have none."""
    part = F.explode(F.split(F.regexp_replace("line_spec", "^Line", ""), "[、,]"))
    p = cl.where(F.col("line_spec").startswith("Line")).select("po_number", "done", "new_pr", part.alias("part")).withColumn("part", F.trim("part"))
    ends = F.split("part", "~")
    p = p.where(F.rlike("part", F.lit(r"^\d{1,18}(~\d{1,18})?$")))
    p = p.select("po_number", "done", "new_pr", F.get(ends, F.lit(0)).cast("bigint").alias("lo"), F.get(ends, F.size(ends) - 1).cast("bigint").alias("hi"))
    return p.where("lo <= hi")


SPAN = 1000


def expand_line_spec(cl):
    """F-06: one row per line number; a long span is cut into blocks first, so
    that no row holds it whole."""
    blocks = line_ranges(cl).select("po_number", "done", "hi", F.explode(F.sequence("lo", "hi", F.lit(SPAN).cast("bigint"))).alias("b"))
    return blocks.select("po_number", "done", F.explode(F.sequence("b", F.least(F.col("b") + SPAN - 1, F.col("hi")))).alias("line_no"))


@register("expand_line_spec", "SELECT po_number, line_no, done FROM closing_lines")
def q_expand(spark, sf):
    return expand_line_spec(A.closing_list(Tables(spark, sf)))


@register("closing_status", """
SELECT pl.po_line,
  CASE WHEN ln.po_number IS NOT NULL THEN (CASE WHEN nullif(trim(ln.done), '') IS NULL THEN 'to_close' ELSE 'closed' END)
       WHEN doc.po_number IS NOT NULL THEN (CASE WHEN nullif(trim(doc.done), '') IS NULL THEN 'to_close' ELSE 'closed' END)
  END AS closing_status
FROM po_lines pl
LEFT JOIN (SELECT po_number, max(done) AS done FROM closing_list WHERE line_spec = 'ALL' AND new_pr <> '' GROUP BY po_number) doc
  ON pl.po_number = doc.po_number
LEFT JOIN (SELECT po_number, CAST(line_no AS VARCHAR) AS line_number, max(done) AS done FROM closing_lines WHERE new_pr <> ''
           GROUP BY po_number, line_no) ln ON pl.po_number = ln.po_number AND pl.line_number = ln.line_number""")
def q_closing_status(spark, sf):
    """J-10: entries with a new request number only (Q14: blank done flag = not
    done); whole-document entries, then line entries, which win where both exist."""
    t = Tables(spark, sf)
    return closing_status(A.po_lines(t).select("po_line", "po_number", "line_number"), A.closing_list(t)).select("po_line", "closing_status")


def closing_status(lines, cl):
    """``lines`` with closing_status.  Spans are compared as ranges inside their
    document, so a span costs one row however long it is."""
    renewed = cl.where(F.coalesce(F.trim("new_pr"), F.lit("")) != "")
    st = lambda d: F.when(F.nullif(F.trim(d), F.lit("")).isNull(), F.lit("to_close")).otherwise(F.lit("closed"))
    doc = renewed.where(F.col("line_spec") == "ALL").groupBy("po_number").agg(F.max(F.coalesce("done", F.lit(""))).alias("_dd"))
    no = F.when(F.rlike("line_number", F.lit(r"^\d{1,18}$")), F.col("line_number").cast("bigint"))
    spans = line_ranges(renewed).select(F.col("po_number").alias("_po"), "lo", "hi", F.coalesce("done", F.lit("")).alias("_done"))
    keyed = lines.withColumn("_no", no)
    hits = (keyed.select("po_number", "_no").distinct().join(spans, (F.col("po_number") == F.col("_po")) & F.col("_no").between(F.col("lo"), F.col("hi")))
            .groupBy("po_number", "_no").agg(F.max("_done").alias("_ld")))
    out = keyed.join(doc, "po_number", "left").join(hits, ["po_number", "_no"], "left")
    status = F.when(F.col("_ld").isNotNull(), st(F.col("_ld"))).when(F.col("_dd").isNotNull(), st(F.col("_dd")))
    return out.withColumn("closing_status", status).drop("_no", "_dd", "_ld")


@register("closing_flag", """
SELECT pl.po_line, CASE WHEN c.po_number IS NOT NULL THEN 'Y' END AS closing_flag, c.close_date
FROM po_lines pl LEFT JOIN (SELECT DISTINCT po_number, close_date FROM closing_list) c ON pl.po_number = c.po_number""")
def q_closing_flag(spark, sf):
    t = Tables(spark, sf)
    c = A.closing_list(t).select("po_number", "close_date").distinct().withColumn("closing_flag", F.lit("Y"))
    return A.po_lines(t).select("po_line", "po_number").join(c, "po_number", "left").drop("po_number")


@register("closing_list_clean", """
SELECT po_number, line_spec, nullif(trim(done), '') AS done, close_date FROM closing_list WHERE close_date IS NOT NULL""")
def q_closing_clean(spark, sf):
    """S-22: two sheets with their own headers, renamed and unioned; blank
    dates dropped; blank texts nulled."""
    cl = A.closing_list(Tables(spark, sf))
    early = cl.where(F.col("close_date") < F.lit("1998-01-01").cast("date")).withColumnsRenamed(
        {"po_number": "PO Number", "line_spec": "Line Number", "done": "Done(V)", "close_date": "Date"})
    late = cl.where(~(F.col("close_date") < F.lit("1998-01-01").cast("date")))
    back = early.withColumnsRenamed({"PO Number": "po_number", "Line Number": "line_spec", "Done(V)": "done",
                                     "Date": "close_date"})
    u = back.unionByName(late)
    return u.where(F.col("close_date").isNotNull()).drop("new_pr").withColumn("done", F.nullif(F.trim("done"), F.lit("")))


def _ref_accounts(t):
    """Reference chart: distinct GL codes of the lines (bounded: the GL rule
    yields at most 22 codes), description and liability, first per code."""
    ref = A.po_lines(t).select("gl_number").where(F.col("gl_number").isNotNull()).distinct()
    return ref.select("gl_number", F.concat(F.lit("Account "), F.col("gl_number")).alias("account_name"),
                      F.concat(F.lit("2"), F.regexp_replace("gl_number", "^.", "")).alias("liability"))


@register("account_lookup", """
SELECT s.po_line, s.account_code, r.account_name,
  CASE WHEN s.status = 'completed_in_advance' THEN '111111' ELSE r.liability END AS liability
FROM po_status s LEFT JOIN (SELECT DISTINCT gl_number, 'Account ' || gl_number AS account_name,
  '2' || substr(gl_number, 2) AS liability FROM po_lines WHERE gl_number IS NOT NULL) r ON s.account_code = r.gl_number
WHERE s.accrue = 'Y'""")
def q_account_lookup(spark, sf):
    """J-05 (Q10): de-duplicate the reference, then a broadcast join by key."""
    t = Tables(spark, sf)
    ref = _ref_accounts(t)
    name = dedup_lookup(ref, "gl_number", "account_name")
    liab = dedup_lookup(ref, "gl_number", "liability")
    led = FL.accrued(FL.ledger(t), "po_line", "account_code", "status")
    out = (led.join(name.withColumnRenamed("gl_number", "account_code"), "account_code", "left")
              .join(liab.withColumnRenamed("gl_number", "account_code"), "account_code", "left"))
    return out.select("po_line", "account_code", "account_name",
                      F.when(F.col("status") == "completed_in_advance", F.lit("111111")).otherwise(F.col("liability")).alias("liability"))


@register("gl_map", """
SELECT pl.gl_number, count(*) AS n, max(m.code) AS mapped_code, count(*) FILTER (WHERE m.code IS NULL) AS unmapped
FROM po_lines pl LEFT JOIN (SELECT DISTINCT account_code AS gl, 'A' || account_code AS code FROM prev_workpaper) m
  ON pl.gl_number = m.gl GROUP BY pl.gl_number""")
def q_gl_map(spark, sf):
    """J-12/J-18: code map by GL with a default-free safe lookup; unmapped
    lines counted per GL."""
    t = Tables(spark, sf)
    m = (A.prev_workpaper(t, RUN_MONTH).select(F.col("account_code").alias("gl_number")).distinct()
         .withColumn("code", F.concat(F.lit("A"), F.col("gl_number"))))
    out = A.po_lines(t).select("gl_number").join(m, "gl_number", "left")
    return out.groupBy("gl_number").agg(F.count(F.lit(1)).alias("n"), F.max("code").alias("mapped_code"),
                                        F.count_if(F.col("code").isNull()).alias("unmapped"))


@register("not_in_procurement", """
SELECT po_line, po_number FROM po_lines pl WHERE NOT EXISTS (
  SELECT 1 FROM procurement p WHERE p.po_line = pl.po_line)""")
def q_not_in_procurement(spark, sf):
    t = Tables(spark, sf)
    pro = A.procurement(t).where(F.col("po_line").isNotNull()).select("po_line")
    return A.po_lines(t).select("po_line", "po_number").join(pro, "po_line", "left_anti")


@register("join_generic", """
SELECT pl.po_line, pl.pr_line, pl.currency, p.pr_line AS pr_line_aux, p.remark
FROM po_lines pl LEFT JOIN procurement p ON pl.po_line = p.po_line""")
def q_join_generic(spark, sf):
    t = Tables(spark, sf)
    pro = A.procurement(t).where(F.col("po_line").isNotNull()).drop("_ord")
    return join_generic(A.po_lines(t).select("po_line", "pr_line", "currency"), pro, ["po_line"], "left")


@register("product_filter", "SELECT po_line, product_code FROM po_lines WHERE coalesce(regexp_matches(product_code, '^BR1[0-9]?$'), false)")
def q_product_filter(spark, sf):
    pl = A.po_lines(Tables(spark, sf))
    return pl.where(F.coalesce(F.col("product_code").rlike("^BR1[0-9]?$"), F.lit(False))).select("po_line", "product_code")


@register("product_exclude", "SELECT po_line, product_code FROM po_lines WHERE NOT coalesce(regexp_matches(product_code, '^BR1[0-9]?$'), false)")
def q_product_exclude(spark, sf):
    pl = A.po_lines(Tables(spark, sf))
    return pl.where(~F.coalesce(F.col("product_code").rlike("^BR1[0-9]?$"), F.lit(False))).select("po_line", "product_code")


@register("column_addition", """
SELECT po_line, closed_for_invoice = '1' AS is_closed,
  CASE WHEN closed_for_invoice = '1' THEN CAST(entry_qty - billed_qty AS VARCHAR) ELSE '未結案' END AS closed_diff_qty,
  CASE WHEN billed_qty = 0 THEN '未入帳' ELSE CAST(entry_qty - billed_qty AS VARCHAR) END AS invoice_gap,
  coalesce(gl_number = '171000', false) AS is_fa,
  coalesce(regexp_matches(department, '^20[34]'), false) AS is_sm,
  CAST(NULL AS VARCHAR) AS remark_fn, 'PO' AS doc_type
FROM po_lines""")
def q_column_addition(spark, sf):
    """P-02: derived columns in one projection; number-or-text columns are text."""
    pl = A.po_lines(Tables(spark, sf))
    closed = F.col("closed_for_invoice") == "1"
    return pl.select(
        "po_line", closed.alias("is_closed"),
        F.when(closed, (F.col("entry_qty") - F.col("billed_qty")).cast("string")).otherwise(F.lit("未結案")).alias("closed_diff_qty"),
        F.when(F.col("billed_qty") == 0, F.lit("未入帳")).otherwise((F.col("entry_qty") - F.col("billed_qty")).cast("string")).alias("invoice_gap"),
        F.coalesce(F.col("gl_number") == "171000", F.lit(False)).alias("is_fa"),
        F.coalesce(F.col("department").rlike("^20[34]"), F.lit(False)).alias("is_sm"),
        F.lit(None).cast("string").alias("remark_fn"), F.lit("PO").alias("doc_type"))


@register("column_init", """
SELECT po_line, CAST(NULL AS VARCHAR) AS status,
  coalesce(po_number, '') || '-' || coalesce(CAST(erm AS VARCHAR), '') AS line_key_nullsafe,
  po_number || '-' || CAST(gl_date AS VARCHAR) AS line_key_strict,
  supplier AS supplier_copy, '' AS remark
FROM po_enriched""")
def q_column_init(spark, sf):
    """P-03/P-04: status column, null-safe key (nulls → '') and a strict key
    (null propagates), supplier copy, blank remark."""
    en = FL.enrich_po(Tables(spark, sf))
    return en.select("po_line", F.lit(None).cast("string").alias("status"),
                     F.concat(F.coalesce("po_number", F.lit("")), F.lit("-"), F.coalesce(F.col("erm").cast("string"), F.lit(""))).alias("line_key_nullsafe"),
                     F.concat("po_number", F.lit("-"), F.col("gl_date").cast("string")).alias("line_key_strict"),
                     F.col("supplier").alias("supplier_copy"), F.lit("").alias("remark"))


REF_NAMES = {"po_number": "PO#", "line_number": "Line#", "gl_number": "GL#", "item_description": "Item Description",
             "entry_qty": "Entry Quantity (Unit)", "product_code": "Product Code"}


def snake(name: str) -> str:
    """P-07: lower, '#' → '_number', parentheses dropped, spaces → '_'."""
    import re
    s = name.strip().lower().replace("#", "_number")
    s = re.sub(r"\(.*?\)", "", s).strip()
    return re.sub(r"[\s]+", "_", s)


@register("clean_po_columns", """
SELECT po_number AS po_number, line_number AS line_number, gl_number AS gl_number,
  item_description AS item_description, entry_qty AS entry_quantity, product_code AS product_code FROM po_lines""")
def q_clean_po_columns(spark, sf):
    pl = A.po_lines(Tables(spark, sf)).select(*[F.col(k).alias(v) for k, v in REF_NAMES.items()])
    return pl.toDF(*[snake(c) for c in pl.columns])


ALIASES = {"po_number": ["PO#", "PO Number", "po_no"], "supplier": ["PO Supplier", "Supplier", "supplier_name"]}


@register("resolve_columns", "SELECT po_number, supplier FROM po_lines")
def q_resolve(spark, sf):
    """P-05: canonical names resolved from a pattern list, then by normalised name."""
    pl = A.po_lines(Tables(spark, sf)).select(F.col("po_number").alias("PO Number"), F.col("supplier").alias("Supplier"))
    norm = {c.lower().replace(" ", "").replace("_", ""): c for c in pl.columns}
    sel = []
    for canon, pats in ALIASES.items():
        hit = next((p for p in pats if p in pl.columns), None) or norm.get(canon.replace("_", ""))
        sel.append(F.col(hit).alias(canon))
    return pl.select(*sel)


OUTPUT_ORDER = ["po_line", "status", "accrue", "account_code", "accr_amount", "not_a_column"]


@register("output_select", "SELECT po_line, status, accrue, account_code, CAST(accr_amount AS DOUBLE) AS accr_amount FROM po_status")
def q_output_select(spark, sf):
    """P-08: configured output list; missing columns are skipped."""
    led = FL.ledger(Tables(spark, sf))
    cols = [c for c in OUTPUT_ORDER if c in led.columns]
    return led.select(*cols).withColumn("accr_amount", F.col("accr_amount").cast("double"))


@register("variance_diff", f"""
SELECT coalesce(p.gl_number, c.gl_number) AS gl_number, coalesce(p.currency, c.currency) AS currency,
  CAST(p.amt AS DOUBLE) AS amt_prev, CAST(c.amt AS DOUBLE) AS amt_curr,
  CAST(coalesce(c.amt, 0) - coalesce(p.amt, 0) AS DOUBLE) AS diff,
  CASE WHEN p.amt IS NOT NULL AND p.amt <> 0 THEN CAST(coalesce(c.amt, 0) - coalesce(p.amt, 0) AS DOUBLE) / CAST(p.amt AS DOUBLE) END AS pct
FROM (SELECT gl_number, currency, sum(entry_amount) AS amt FROM po_enriched WHERE erm = {RUN_MONTH - 1} GROUP BY ALL) p
FULL OUTER JOIN (SELECT gl_number, currency, sum(entry_amount) AS amt FROM po_enriched WHERE erm = {RUN_MONTH} GROUP BY ALL) c
  ON p.gl_number IS NOT DISTINCT FROM c.gl_number AND p.currency = c.currency""")
def q_variance_diff(spark, sf):
    """J-19/D-11: period-over-period variance by (account, currency): both
    months aggregated, then a full outer join of the small aggregates."""
    en = FL.enrich_po(Tables(spark, sf))
    agg = lambda m: en.where(F.col("erm") == m).groupBy("gl_number", "currency").agg(F.sum("entry_amount").alias("amt"))
    p, c = agg(RUN_MONTH - 1).alias("p"), agg(RUN_MONTH).alias("c")
    j = p.join(c, F.col("p.gl_number").eqNullSafe(F.col("c.gl_number")) & (F.col("p.currency") == F.col("c.currency")), "full_outer")
    diff = (F.coalesce(F.col("c.amt"), F.lit(0)) - F.coalesce(F.col("p.amt"), F.lit(0))).cast("double")
    return j.select(F.coalesce("p.gl_number", "c.gl_number").alias("gl_number"),
                    F.coalesce("p.currency", "c.currency").alias("currency"),
                    F.col("p.amt").cast("double").alias("amt_prev"), F.col("c.amt").cast("double").alias("amt_curr"),
                    diff.alias("diff"), F.when(F.col("p.amt") != 0, diff / F.col("p.amt").cast("double")).alias("pct"))


def _proc_status(df, doc_type):
    ctx = FL.ctx_for(doc_type=doc_type)
    ctx.closing_month = 199804
    out = R.apply_rules(df, R.load_rules("procurement"), ctx)
    return out.select(*df.columns, F.struct(F.lit(doc_type).alias("doc_type"), F.col("po_line" if doc_type == "PO" else "pr_line").alias("line_key"),
                                            "status").alias(f"_{doc_type}"))


@register("procurement_combined", " UNION ALL ".join(
    f"SELECT '{dt}' AS doc_type, {'po_line' if dt == 'PO' else 'pr_line'} AS line_key, status FROM ("
    + FL.rules_sql("po_enriched", ["procurement"], doc_type=dt, extra={"closing_month": 199804}) + f") r{dt}"
    for dt in ("PO", "PR")))
def q_procurement_combined(spark, sf):
    """U-03: one procurement logic applied to the PO and PR views, unioned: both
    from the same enriched lines, which are computed once."""
    both = _proc_status(_proc_status(FL.enrich_po(Tables(spark, sf)), "PO"), "PR")
    return both.select(F.inline(F.array("_PO", "_PR")))


def _user_step(df):
    return df.withColumn("desc_len", F.length("item_description").cast("bigint"))


@register("transform_hook", "SELECT po_line, CAST(length(item_description) AS BIGINT) AS desc_len FROM po_lines")
def q_transform_hook(spark, sf):
    """X-03: a user step plugged into the flow with ``DataFrame.transform``."""
    return A.po_lines(Tables(spark, sf)).select("po_line", "item_description").transform(_user_step).drop("item_description")


def _chunk_fn(batches):
    for pdf in batches:
        yield pd.DataFrame({"po_line": pdf["po_line"], "desc_words": pdf["item_description"].str.split().str.len().astype("int64")})


@register("map_in_pandas", "SELECT po_line, CAST(len(string_split(trim(item_description), ' ')) AS BIGINT) AS desc_words FROM po_lines")
def q_map_in_pandas(spark, sf):
    """X-02: a user function over Arrow row batches (``mapInPandas``)."""
    pl = A.po_lines(Tables(spark, sf)).select("po_line", "item_description")
    return pl.mapInPandas(_chunk_fn, "po_line string, desc_words long")
