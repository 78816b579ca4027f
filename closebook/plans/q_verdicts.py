"""Document verdicts and account prediction (A-17, A-18, R-27, R-28, A-15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from closebook.operators import documents as D
from closebook.operators import predict as P
from closebook.plans import flows as FL
from closebook.plans.oracle_fns import q
from closebook.plans.registry import register
from closebook.sources import adapter as A
from closebook.sources import io
from closebook.sources.adapter_sql import RUN_MONTH
from closebook.sources.testdata import Tables

ASSETS = D.AssetRules(asset_accounts=(A.FA_ACCOUNT,))

_has = "coalesce(regexp_matches({}, {}), false)".format
_acc = f"{_has('item_description', q('(?i)' + ASSETS.acceptance))} AND NOT {_has('item_description', q('(?i)' + ASSETS.warranty))}"
_protected = f"coalesce(status IN ({', '.join(map(q, ASSETS.protected))}), false)"
_N = D.ASSET_NOTES
ASSET_SQL = f"""
SELECT po_line, po_number, CASE WHEN hit AND done THEN '{ASSETS.completed}' WHEN hit THEN '{ASSETS.incomplete}' ELSE status END AS status,
  CASE WHEN NOT hit THEN status_note WHEN acc IS NULL THEN '{_N['remark_only']}' WHEN acc > {RUN_MONTH} THEN '{_N['not_due']}'
    WHEN proc THEN '{_N['accepted']}' ELSE '{_N['not_confirmed']}' END AS status_note,
  CASE WHEN hit AND done THEN 'Y' WHEN hit THEN 'N' ELSE accrue END AS accrue
FROM (SELECT *, CASE WHEN acc IS NULL THEN proc ELSE acc <= {RUN_MONTH} AND proc END AS done,
    asset AND NOT {_protected} AND (acc IS NOT NULL OR proc) AS hit
  FROM (SELECT *, bool_or(gl_number = '{A.FA_ACCOUNT}' OR {_has('item_description', q('(?i)' + '|'.join(ASSETS.triggers)))}) OVER d AS asset,
      max(CASE WHEN {_acc} THEN erm END) OVER d AS acc,
      bool_or({_has('proc_remark', q('(?i)' + ASSETS.done_remark))}) OVER d AS proc
    FROM asset_lines WINDOW d AS (PARTITION BY po_number)) f) v"""


@register("asset_status", ASSET_SQL)
def asset_status(spark, sf):
    """A-18: one verdict per asset document on its unprotected lines."""
    out = D.asset_status(A.asset_lines(Tables(spark, sf)), ASSETS, RUN_MONTH)
    return out.select("po_line", "po_number", "status", "status_note", "accrue")


@register("asset_status_totals", f"SELECT status, accrue, status_note, count(*) AS n FROM ({ASSET_SQL}) a GROUP BY status, accrue, status_note")
def asset_status_totals(spark, sf):
    """A-18, its statistics: lines by status, flag and what decided."""
    out = D.asset_status(A.asset_lines(Tables(spark, sf)), ASSETS, RUN_MONTH)
    return out.groupBy("status", "accrue", "status_note").agg(F.count(F.lit(1)).alias("n"))


DEPOSIT = "deposit"


@register("deposit_status", f"""
SELECT po_line, status,
  CASE WHEN has_dep AND doc_max_erm > {RUN_MONTH} AND coalesce(status, '') <> 'posted' THEN 'incomplete_deposit'
       ELSE status END AS deposit_status
FROM (SELECT s.*, g.doc_max_erm, coalesce(g.has_dep, false) AS has_dep FROM po_status s
      LEFT JOIN (SELECT po_number AS d, max(erm) AS doc_max_erm,
                        bool_or(coalesce(regexp_matches(item_description, '(?i){DEPOSIT}'), false) AND coalesce(status, '') <> 'posted') AS has_dep
                 FROM po_status GROUP BY po_number) g ON s.po_number = g.d) x""")
def deposit_status(spark, sf):
    """A-17; the lines and their documents' facts share a ledger that is computed once.
    The description is read before the lookups, which carry only what it says."""
    led = FL.ledger(Tables(spark, sf), own={"deposit": D.has(F.col("item_description"), DEPOSIT)})
    df = led.select("po_line", "po_number", "deposit", "erm", "status")
    df = io.resume(spark, io.snapshot(df, spark, "deposits", "PO", RUN_MONTH, "ledger"))
    return D.deposit_status(df, RUN_MONTH, F.col("deposit")).select("po_line", "status", "deposit_status")


_FIELDS = ("po_line", "department", "supplier", "product_code", "item_description", "entry_amount")
_OUT = ("po_line", "predicted_rule", "predicted_account", "predicted_liability", "matched_conditions")
ACCOUNT_RULES = P.load_rules("predict_account")
LIABILITY_RULES = P.load_rules("predict_liability")


def _predicted(spark, sf, rules):
    return P.predict(A.po_lines(Tables(spark, sf)).select(*_FIELDS), rules)


@register("predict_account", f"SELECT {', '.join(c for c in _OUT if c != 'predicted_liability')} FROM ({P.predict_sql('po_lines', ACCOUNT_RULES)}) p")
def predict_account(spark, sf):
    """R-27: department lists, supplier, words, amount limit."""
    return _predicted(spark, sf, ACCOUNT_RULES).select(*[c for c in _OUT if c != "predicted_liability"])


@register("predict_account_liability", f"SELECT {', '.join(_OUT)} FROM ({P.predict_sql('po_lines', LIABILITY_RULES)}) p")
def predict_account_liability(spark, sf):
    """R-28: product code, department prefix, words, amount range."""
    return _predicted(spark, sf, LIABILITY_RULES).select(*_OUT)


def _stats_sql(rules):
    return f"""WITH p AS ({P.predict_sql('po_lines', rules)}),
t AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(predicted_account) AS DOUBLE) AS m FROM p)
SELECT 'total' AS metric, CAST(NULL AS VARCHAR) AS account, n AS value FROM t
UNION ALL SELECT 'matched', NULL, m FROM t UNION ALL SELECT 'unmatched', NULL, n - m FROM t
UNION ALL SELECT 'match_rate', NULL, CASE WHEN n > 0 THEN m * 100 / n ELSE 0 END FROM t
UNION ALL SELECT 'account', predicted_account, CAST(count(*) AS DOUBLE) FROM p WHERE predicted_account IS NOT NULL GROUP BY predicted_account"""


@register("predict_stats", f"SELECT 'department' AS rule_set, * FROM ({_stats_sql(ACCOUNT_RULES)}) a UNION ALL SELECT 'product', * FROM ({_stats_sql(LIABILITY_RULES)}) b")
def predict_stats(spark, sf):
    """A-15: match statistics of both rule tables."""
    parts = [P.statistics(_predicted(spark, sf, rules)).withColumn("rule_set", F.lit(name))
             for name, rules in (("department", ACCOUNT_RULES), ("product", LIABILITY_RULES))]
    return parts[0].unionByName(parts[1])
