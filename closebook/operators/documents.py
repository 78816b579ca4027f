"""Verdicts per document sent back to its lines (A-17, A-18).

A document's facts are one group-by with conditional aggregates, joined back on
the document number: no window holds a document, partial aggregation combines a
hot document before the shuffle, and lines without a number stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def has(text: Column, pattern: str) -> Column:
    """Pattern found, ignoring case; null text: not found."""
    return F.coalesce(F.rlike(text, F.lit(f"(?i){pattern}")), F.lit(False))


@dataclass(frozen=True)
class AssetRules:
    """Parameters of the asset verdict.  The marker texts are fixed values."""

    asset_accounts: tuple[str, ...]
    triggers: tuple[str, ...] = ("訂金", "安裝", "驗收")
    acceptance: str = "驗收"
    warranty: str = "保固"
    done_remark: str = "已完成"
    completed: str = "已完成(asset)"
    incomplete: str = "未完成(asset)"
    protected: tuple[str, ...] = ("posted", "closed")


#: What decided an asset document, by verdict.
ASSET_NOTES = {
    "accepted": "acceptance month reached and procurement completed",
    "not_due": "acceptance month after the run month",
    "not_confirmed": "acceptance month reached, procurement not completed",
    "remark_only": "no acceptance line, procurement completed",
}


def asset_facts(lines: DataFrame, rules: AssetRules, doc: str = "po_number") -> DataFrame:
    """One row per document with an asset line: the latest receipt month of its
    acceptance lines (warranty lines don't count; null if none has a month) and
    whether any of its lines has a completed procurement remark."""
    text = F.col("item_description")
    accepts = has(text, rules.acceptance) & ~has(text, rules.warranty)
    asset = F.coalesce(F.col("gl_number").isin(*rules.asset_accounts), F.lit(False)) | has(text, "|".join(rules.triggers))
    return (lines.where(F.col(doc).isNotNull()).groupBy(doc)
            .agg(F.bool_or(asset).alias("_asset"), F.max(F.when(accepts, F.col("erm"))).alias("acceptance_erm"),
                 F.bool_or(has(F.col("proc_remark"), rules.done_remark)).alias("procurement_done"))
            .where("_asset").drop("_asset"))


def asset_verdict(run_month: int) -> Column:
    """The verdict of a document's facts; null: no acceptance line and no
    completed remark, which leaves its lines unchanged."""
    due, done = F.col("acceptance_erm") <= run_month, F.col("procurement_done")
    return (F.when(F.col("acceptance_erm").isNull(), F.when(done, F.lit("remark_only")))
            .when(~due, F.lit("not_due")).when(done, F.lit("accepted")).otherwise(F.lit("not_confirmed")))


def asset_status(lines: DataFrame, rules: AssetRules, run_month: int, doc: str = "po_number") -> DataFrame:
    """A-18: status, note and accrue flag of the unprotected lines of asset
    documents; all other lines as they were."""
    facts = asset_facts(lines, rules, doc).withColumn("_verdict", asset_verdict(run_month)).select(doc, "_verdict")
    out = lines.join(facts, doc, "left")
    free = ~F.coalesce(F.col("status").isin(*rules.protected), F.lit(False))
    hit = F.col("_verdict").isNotNull() & free
    done = F.col("_verdict").isin("accepted", "remark_only")
    note = F.coalesce(*[F.when(F.col("_verdict") == k, F.lit(v)) for k, v in ASSET_NOTES.items()])
    return out.withColumns({
        "status": F.when(hit & done, F.lit(rules.completed)).when(hit, F.lit(rules.incomplete)).otherwise(F.col("status")),
        "status_note": F.when(hit, note).otherwise(F.col("status_note")),
        "accrue": F.when(hit & done, F.lit("Y")).when(hit, F.lit("N")).otherwise(F.col("accrue")),
    }).drop("_verdict")


def deposit_status(lines: DataFrame, run_month: int, pattern: str | Column, posted: str = "posted",
                   incomplete: str = "incomplete_deposit", doc: str = "po_number") -> DataFrame:
    """A-17: documents with a deposit line that is not posted, told by the
    description (or by a Column, where that was read before); if the latest receipt month of **all** lines of the document is
    after the run month, its lines that are not posted become incomplete."""
    open_ = F.coalesce(F.col("status"), F.lit("")) != posted
    deposit = has(F.col("item_description"), pattern) if isinstance(pattern, str) else pattern
    late = (lines.where(F.col(doc).isNotNull()).groupBy(doc)
            .agg(F.max("erm").alias("_erm"), F.bool_or(deposit & open_).alias("_deposit"))
            .where(F.col("_deposit") & (F.col("_erm") > run_month)).select(doc, F.lit(True).alias("_late")))
    out = lines.join(late, doc, "left")
    return out.withColumn("deposit_status", F.when(F.col("_late") & open_, F.lit(incomplete)).otherwise(F.col("status"))).drop("_late")
