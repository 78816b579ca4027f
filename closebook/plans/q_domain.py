"""Keyword account, description category, month filter, reviewer mapping
(R-29, R-30, P-12, J-06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from closebook.operators.lookups import map_fields
from closebook.plans import flows as FL
from closebook.plans.oracle_fns import q
from closebook.plans.registry import register
from closebook.sources import adapter as A
from closebook.sources.adapter_sql import RUN_MONTH
from closebook.sources.testdata import Tables

# Our own keyword → account rules (first rule in this order wins).
KEYWORD_ACCOUNTS = [
    ("171200", "(?i)gear|gizmo|equipment"),
    ("614200", "(?i)agent fee"),
    ("614300", "(?i)utilities"),
    ("132000", "(?i)deposit"),
]
# Our own description categories: (category, include, exclude).
CATEGORIES = [
    ("Hardware", "(?i)bolt|gear|ring", "(?i)fee"),
    ("Held money", "(?i)deposit", "(?i)small"),
    ("Fees", "(?i)fee", "(?i)utilities"),
    ("Premises", "(?i)office|utilities", None),
    ("Machines", "(?i)equipment|gizmo|widget", None),
]


def keyword_account(desc):
    """R-29: first matching keyword rule → (account, matched keyword text)."""
    acct = kw = None
    for a, p in KEYWORD_ACCOUNTS:
        hit = F.coalesce(desc.rlike(p), F.lit(False))
        acct = F.when(hit, F.lit(a)) if acct is None else acct.when(hit, F.lit(a))
        m = F.regexp_extract(desc, "(?i)(" + p[4:] + ")", 1)
        kw = F.when(hit, m) if kw is None else kw.when(hit, m)
    return acct, kw


@register("keyword_account", "SELECT po_line, " + "CASE " + " ".join(
    f"WHEN coalesce(regexp_matches(item_description, {q(p)}), false) THEN {q(a)}" for a, p in KEYWORD_ACCOUNTS)
    + " END AS kw_account, CASE " + " ".join(
    f"WHEN coalesce(regexp_matches(item_description, {q(p)}), false) THEN regexp_extract(item_description, {q('(?i)(' + p[4:] + ')')}, 1)"
    for a, p in KEYWORD_ACCOUNTS) + " END AS kw_matched FROM po_lines")
def q_keyword_account(spark, sf):
    pl = A.po_lines(Tables(spark, sf))
    acct, kw = keyword_account(F.col("item_description"))
    return pl.select("po_line", acct.alias("kw_account"), kw.alias("kw_matched"))


def _cat_sql():
    parts = []
    for name, inc, exc in CATEGORIES:
        cond = f"coalesce(regexp_matches(item_description, {q(inc)}), false)"
        if exc:
            cond += f" AND NOT coalesce(regexp_matches(item_description, {q(exc)}), false)"
        parts.append(f"WHEN {cond} THEN {q(name)}")
    return "CASE " + " ".join(parts) + " ELSE 'Miscellaneous' END"


@register("classify_description", f"SELECT po_line, {_cat_sql()} AS category FROM po_lines")
def q_classify(spark, sf):
    """R-30: first category whose include pattern matches and exclude does
    not (look-ahead written as AND NOT, valid in both regex dialects)."""
    d = F.col("item_description")
    expr = None
    for name, inc, exc in CATEGORIES:
        cond = F.coalesce(d.rlike(inc), F.lit(False))
        if exc:
            cond = cond & ~F.coalesce(d.rlike(exc), F.lit(False))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return A.po_lines(Tables(spark, sf)).select("po_line", expr.otherwise(F.lit("Miscellaneous")).alias("category"))


@register("ops_month_filter", f"""
SELECT po_number, line_spec, close_date FROM closing_list
WHERE close_date < DATE '{RUN_MONTH // 100:04d}-{RUN_MONTH % 100:02d}-01'""")
def q_ops_month_filter(spark, sf):
    """P-12: rows strictly before the first day of the run month."""
    cl = A.closing_list(Tables(spark, sf))
    first = F.make_date(F.lit(RUN_MONTH // 100), F.lit(RUN_MONTH % 100), F.lit(1))
    return cl.where(F.col("close_date") < first).select("po_number", "line_spec", "close_date")


@register("reviewer_map", """
SELECT pl.po_line, wp.r AS reviewer_fn, wp.r AS reviewer_proc
FROM po_lines pl LEFT JOIN (SELECT po_line, arg_max(reviewer, _ord) FILTER (WHERE reviewer IS NOT NULL) AS r
  FROM prev_workpaper GROUP BY po_line) wp ON pl.po_line = wp.po_line""")
def q_reviewer_map(spark, sf):
    """J-06: one mapped value copied to two target columns."""
    t = Tables(spark, sf)
    return map_fields(A.po_lines(t).select("po_line"), A.prev_workpaper(t, RUN_MONTH), "po_line",
                      [("reviewer", "reviewer_fn", True), ("reviewer", "reviewer_proc", True)])
