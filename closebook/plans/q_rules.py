"""Rule-engine queries: one small rule set per check family, and the
entity rule files (override stages, unconditional first rule, null-true
not-equals, last-match labels)."""

from __future__ import annotations

from pyspark.sql import functions as F

from closebook.operators import rules as R
from closebook.plans import flows as FL
from closebook.plans.registry import register
from closebook.sources.testdata import Tables

COLS = ["po_line", "status", "status_rule", "status_note"]


def _rs(*rules, mode="first", **meta):
    return {"meta": {"name": "inline", "mode": mode, **meta}, "rules": [
        {"priority": i, "status": r[0], "note": r[0], "checks": r[1], **(r[2] if len(r) > 2 else {})}
        for i, r in enumerate(rules, start=1)]}


def c(type_, field=None, **kw):
    d = {"type": type_, **kw}
    if field:
        d["field"] = field
    return d


CHECK_SETS = {
    "check_contains": _rs(("desc_deposit_or_rent", [c("contains", "item_description", pattern="(?i)DEPOSIT|rent")]),
                          ("remark_not_completed", [c("not_contains", "proc_remark", pattern="已完成")])),
    "check_equals": _rs(("supplier_7", [c("equals", "supplier", value="Supplier#000000007")]),
                        ("zero_billed", [c("equals", "billed_qty", value=0, cast="Float64")]),
                        ("qty_not_10", [c("not_equals", "entry_qty", value="10", cast="Float64"),
                                        c("not_equals", "currency", value="TWD")])),
    "check_in_list": _rs(("brand_1_2", [c("in_list", "product_code", values=["BR1", "BR2"])]),
                         ("not_twd_usd", [c("not_in_list", "currency", values=["TWD", "USD"])])),
    "check_null": _rs(("no_proc_remark", [c("is_null", "proc_remark"), c("contains", "item_description", pattern="gear")]),
                      ("has_gl_date", [c("is_not_null", "gl_date")])),
    "check_erm": _rs(("due", [c("erm_le_date")]), ("not_due", [c("erm_gt_date")])),
    "check_erm_range": _rs(("in_range", [c("erm_in_range")]), ("out_of_range", [c("out_of_range")])),
    "check_desc_erm": _rs(("period_ended", [c("desc_erm_le_date"), c("desc_erm_not_error")]),
                          ("period_future", [c("desc_erm_gt_date")]), ("period_error", [c("format_error")])),
    "check_qty": _rs(("qty_matched", [c("qty_matched")]), ("qty_not_matched", [c("qty_not_matched")])),
    "check_billing": _rs(("not_billed", [c("not_billed")]), ("fully_billed", [c("fully_billed")]),
                         ("partly_billed", [c("has_billing"), c("has_unpaid")])),
    "check_remarks": _rs(("remark_completed", [c("remark_completed")]),
                         ("clean_remark", [c("pr_not_incomplete"), c("not_error")])),
    "check_fa": _rs(("fa", [c("is_fa")]), ("equipment_not_fa", [c("not_fa"), c("contains", "item_description", pattern="equipment")])),
    "rules_or": _rs(("gear_or_eur", [c("contains", "item_description", pattern="gear"), c("equals", "currency", value="EUR")],
                     {"combine": "or"})),
    "rules_first_match": _rs(("ring", [c("contains", "item_description", pattern="ring")]),
                             ("small", [c("contains", "item_description", pattern="small")])),
    "rules_override": _rs(("small", [c("contains", "item_description", pattern="small")]),
                          ("ring_over_small", [c("contains", "item_description", pattern="ring")], {"override": ["small"]}),
                          ("ring", [c("contains", "item_description", pattern="ring")]),
                          ("big", [c("contains", "item_description", pattern="big")])),
}

ENTITY_SETS = {
    "status_sct": (["two_stage_po"], "PO", {}),
    "status_sct_pr": (["two_stage_pr"], "PR", {}),
    "status_spt": (["unconditional_first"], "PO", {}),
    "status_pr_erm": (["receipt_month_pr"], "PR", {}),
}


CLOSING_MONTH = 199804


def procurement_ctx():
    ctx = FL.ctx_for()
    ctx.closing_month = CLOSING_MONTH
    return ctx


def _make(key: str, rule_sets, doc_type="PO", extra=None, remark=None):
    extra = extra or {}
    cols = COLS + ([remark] if remark else [])
    kw = {"remark_col": remark} if remark else {}

    def spark_q(spark, sf):
        ctx = FL.ctx_for(doc_type=doc_type)
        for k, v in extra.items():
            setattr(ctx, k, v)
        return FL.enriched_and_ruled(Tables(spark, sf), ctx, rule_sets, **kw).select(*cols)

    sql = FL.rules_sql("po_enriched", rule_sets, doc_type=doc_type, extra=extra, **kw)
    register(key, f"SELECT {', '.join(cols)} FROM ({sql}) r")(spark_q)


for _k, _rs_ in CHECK_SETS.items():
    _make(_k, [_rs_])
for _k, (_sets, _dt, _extra) in ENTITY_SETS.items():
    _make(_k, _sets, _dt, _extra)


# The procurement ladder has to drop the statuses that the lines come with.
_given = "SELECT *, status_prev AS status FROM po_enriched"


@register("status_procurement", f"SELECT {', '.join(COLS)} FROM ({R.apply_rules_sql(_given, {**FL.ENRICHED_TYPES, 'status': 'string'}, R.load_rules('procurement'), procurement_ctx())}) r")
def status_procurement(spark, sf):
    """R-25, D-13: statuses reset, then the procurement ladder."""
    df = FL.enrich_po(Tables(spark, sf)).withColumn("status", F.col("status_prev"))
    return R.apply_rules(df, R.load_rules("procurement"), procurement_ctx()).select(*COLS)


LABEL_SETS, REMARK = ("labels", "label_remarks"), "label_remark"


def labelled(df, ctx):
    """R-26: statuses by receipt month, the two label sets, then the accrue flag."""
    df = R.apply_rules(df, R.load_rules("receipt_month"), ctx)
    for rs in LABEL_SETS:
        df = R.apply_rules(df, R.load_rules(rs), ctx, remark_col=REMARK)
    return df.withColumn("accrue", F.when(F.coalesce(F.col("status").contains(LABEL_DONE), F.lit(False)), F.lit("Y")).otherwise(F.lit("N")))


LABEL_DONE = "已完成"


@register("status_labels", f"""SELECT {', '.join(COLS)}, {REMARK}, CASE WHEN coalesce(contains(status, '{LABEL_DONE}'), false) THEN 'Y' ELSE 'N' END AS accrue
FROM ({FL.rules_sql(f"({FL.rules_sql('po_enriched', ['receipt_month'])}) e", LABEL_SETS, columns={**FL.ENRICHED_TYPES, 'status': 'string', 'status_rule': 'bigint', 'status_note': 'string'}, remark_col=REMARK)}) r""")
def status_labels(spark, sf):
    ctx = FL.ctx_for()
    return labelled(FL.enrich_po(Tables(spark, sf), ctx=ctx, rule_sets=("receipt_month", *LABEL_SETS)), ctx).select(*COLS, REMARK, "accrue")
