"""Configuration-driven status rules compiled to Spark Columns (R-01 … R-31).

A rule file (TOML) lists rules with a priority, a status, a note and checks
combined by AND/OR.  Semantics:

* rules run in priority order (stable: ties keep file order);
* ``mode = "first"``: a rule only touches rows still *open* (status null)
  or whose status is in the rule's ``override`` list; the first hit wins;
* ``mode = "last"``: every matching rule overwrites, the last hit wins;
* a check on a column the frame lacks is dropped; a rule left without
  checks is skipped (decided at compile time from ``df.columns``).

Compilation: a run of non-override rules is ONE ``CASE WHEN`` producing a
struct (rule_no, status, note); every override rule starts a new projection,
because it may read statuses written by the run before it.  Everything stays
inside Catalyst — no Python UDF — but apart from whole-stage code, whose one
method for all rules would be too long for the JVM to compile.

``sql_*`` functions render the same semantics as DuckDB SQL text for the
oracle; they are an independent second implementation of each check type.
"""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closebook.functions.numbers import parse_double
from closebook.functions.text import apart

RULE_DIR = os.path.join(os.path.dirname(os.path.dirname(__file__)), "rules")

# Fixed values (must equal the reference's): remark patterns of the built-in
# remark checks, and the texts that count as an empty status.
PROC_COMPLETED = "(?i)已完成|rent"
FN_COMPLETED = "(?i)已完成|已入帳"
PR_INCOMPLETE = "(?i)未完成"
PROC_ERROR = "error"
EMPTY_TEXTS = ("", "nan")


@dataclass
class Rule:
    no: int
    priority: int
    status: str
    note: str
    checks: list[dict]
    combine: str = "and"
    apply_to: tuple = ("PO", "PR")
    override: tuple = ()
    remark: str | None = None
    has_remark: bool = False
    unconditional: bool = False


@dataclass
class RuleSet:
    name: str
    rules: list[Rule]
    mode: str = "first"
    refs: dict = field(default_factory=dict)
    null_not_equals: bool = False
    reset: bool = False  # statuses given on input don't count
    writes: str = "status"  # or "remark": the set leaves the status alone


@dataclass
class Ctx:
    """Compile-time context: run month, column types of the frame, refs."""

    run_month: int
    columns: dict  # name -> spark simpleString type
    doc_type: str = "PO"
    closing_month: int | None = None
    refs: dict = field(default_factory=dict)
    fa_accounts: tuple = ("171000",)
    null_not_equals: bool = False
    marks: dict = field(default_factory=dict)  # check -> (column, bit), see mark_own_checks


def load_rules(name) -> RuleSet:
    """Rule set by file name (``closebook/rules/<name>.toml``), path, or an
    already-parsed dict of the same shape."""
    if isinstance(name, RuleSet):
        return name
    if isinstance(name, dict):
        return rules_from_dict(name)
    path = name if os.path.isabs(name) else os.path.join(RULE_DIR, f"{name}.toml")
    with open(path, "rb") as fh:
        raw = tomllib.load(fh)
    return rules_from_dict(raw, name)


def rules_from_dict(raw: dict, name: str = "inline") -> RuleSet:
    meta = raw.get("meta", {})
    rules = []
    for i, r in enumerate(raw.get("rules", []), start=1):
        rules.append(Rule(
            no=int(r.get("no", i)),
            priority=int(r.get("priority", 999)),
            status=r.get("status"),
            note=r.get("note", ""),
            checks=list(r.get("checks", [])),
            combine=r.get("combine", "and"),
            apply_to=tuple(r.get("apply_to", ["PO", "PR"])),
            override=tuple(r.get("override", [])),
            remark=r.get("remark"),
            has_remark="remark" in r,
            unconditional=bool(r.get("unconditional", False)),
        ))
    rules.sort(key=lambda r: r.priority)  # stable
    return RuleSet(name=meta.get("name", name), rules=rules, mode=meta.get("mode", "first"),
                   refs=raw.get("refs", {}), null_not_equals=bool(meta.get("null_not_equals", False)),
                   reset=bool(meta.get("reset", False)), writes=meta.get("writes", "status"))


def _ref(refs: dict, key: str):
    node = refs
    for part in key.split("."):
        if not isinstance(node, dict):
            raise KeyError(key)
        hit = [k for k in node if k.lower() == part.lower()]
        if not hit:
            raise KeyError(key)
        node = node[hit[0]]
    return node


def _resolve(check: dict, ctx: Ctx) -> dict:
    c = dict(check)
    if "field" in c:
        c["field"] = c["field"].replace("{TYPE}", ctx.doc_type.lower())
    for k_ref, k in (("pattern_key", "pattern"), ("value_key", "value"), ("list_key", "values")):
        if k_ref in c:
            v = _ref(ctx.refs, c[k_ref])
            if isinstance(v, list) and k == "pattern":
                v = "|".join(v)
            if isinstance(v, list) and k == "value":  # a list-valued reference means membership
                c["type"] = {"equals": "in_list", "not_equals": "not_in_list"}[c["type"]]
                k = "values"
            c[k] = v
    if "values" in c:
        c["values"] = [str(v) for v in c["values"]]
    return c


def _needs(c: dict, ctx: Ctx, *cols: str) -> bool:
    return all(x in ctx.columns for x in cols)


# --------------------------------------------------------------------------
# Spark side
# --------------------------------------------------------------------------

def _is_null(col: str, ctx: Ctx) -> Column:
    c = F.col(col)
    if ctx.columns.get(col) == "string":
        return c.isNull() | F.trim(c).isin(*EMPTY_TEXTS)
    return c.isNull()


def _is_number(v) -> bool:
    try:
        float(v)
        return True
    except (TypeError, ValueError):
        return False


def _num(col: Column, name: str, ctx: Ctx) -> Column:
    """Numeric view of a column: text goes through the guarded parser."""
    if ctx.columns.get(name) == "string":
        return parse_double(col)
    return col.cast("double")


def _rlike(col: Column, pattern: str) -> Column:
    return F.coalesce(col.rlike(pattern), F.lit(False))


_PERIOD = ("period_start", "period_end", "period_ok")
#: What a check without a field of its own reads.  The checks left out read remarks or the status.
READS = {"erm_le_date": ("erm",), "erm_gt_date": ("erm",), "erm_le_closing": ("erm",), "erm_gt_closing": ("erm",),
         "erm_in_range": ("erm", *_PERIOD), "out_of_range": ("erm", *_PERIOD), "desc_erm_le_date": _PERIOD, "desc_erm_gt_date": _PERIOD,
         "desc_erm_not_error": _PERIOD, "format_error": _PERIOD, "qty_matched": ("entry_qty", "received_qty"),
         "qty_not_matched": ("entry_qty", "received_qty"), "not_billed": ("billed_amount",), "has_billing": ("billed_qty",),
         "fully_billed": ("entry_amount", "billed_amount"), "has_unpaid": ("entry_amount", "billed_amount"),
         "is_fa": ("gl_number",), "not_fa": ("gl_number",), "max_amount": ("entry_amount",)}
MARKS, BITS = "_marks", 62


def _mark_key(c: dict, ctx: Ctx) -> str:
    return repr((sorted(c.items()), ctx.run_month, ctx.closing_month, ctx.fa_accounts, ctx.null_not_equals))


def mark_own_checks(df: DataFrame, rule_sets, ctx: Ctx, written: tuple = ("status", "status_rule", "status_note")) -> DataFrame:
    """``df`` with the results of all checks of ``rule_sets`` that read its own
    columns, as bits of ``_marks…``; ``ctx`` remembers which is which, and the
    rules then read the bits.  Done before the lookups, texts that only the
    rules read need not be carried through these.  Columns that rules write
    (``written``) are never taken.  A check is true or not: a null counts as not,
    as it does in a rule."""
    own = {f.name: f.dataType.simpleString() for f in df.schema.fields if f.name not in written}
    found: dict[str, Column] = {}
    for rs in map(load_rules, rule_sets):
        c_ctx = Ctx(**{**ctx.__dict__, "columns": own, "refs": rs.refs or ctx.refs, "null_not_equals": rs.null_not_equals, "marks": {}})
        for check in (ch for r in rs.rules if ctx.doc_type in r.apply_to for ch in r.checks):
            c = _resolve(check, c_ctx)
            reads = (c["field"],) if "field" in c else READS.get(c["type"], ())
            key = _mark_key(c, c_ctx)
            if not reads or not set(reads) <= set(own) or key in found:
                continue
            mask = compile_check(check, c_ctx, "")
            if mask is not None:
                found[key] = mask
    ctx.marks = {key: (f"{MARKS}{i // BITS}", i % BITS) for i, key in enumerate(found)}
    words: dict[str, list[Column]] = {}
    for key, mask in found.items():
        column, bit = ctx.marks[key]
        words.setdefault(column, []).append(F.when(mask, F.lit(1 << bit).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return df.withColumns({c: apart(reduce(lambda a, b: a.bitwiseOR(b), bits)) for c, bits in words.items()})


def compile_check(check: dict, ctx: Ctx, status_col: str) -> Column | None:
    c = _resolve(check, ctx)
    column, bit = ctx.marks.get(_mark_key(c, ctx), (None, 0))
    if column in ctx.columns:
        return F.col(column).bitwiseAND(F.lit(1 << bit).cast("bigint")) != 0
    t = c["type"]
    f = c.get("field")
    ym = F.lit(ctx.run_month)
    if f is not None and f not in ctx.columns:
        return None
    col = F.col(f) if f else None
    if t == "contains":
        return _rlike(col, c["pattern"])
    if t == "not_contains":
        return ~_rlike(col, c["pattern"])
    if t in ("starts_with", "not_starts_with"):  # null starts with nothing
        hit = F.coalesce(F.startswith(col, F.lit(c["value"])), F.lit(False))
        return hit if t == "starts_with" else ~hit
    if t in ("equals", "not_equals"):
        v = c["value"]
        if c.get("cast"):
            eq = _num(col, f, ctx) == F.lit(float(v) if _is_number(v) else None).cast("double")
        else:
            eq = col.cast("string") == F.lit(str(v))
        if t == "equals":
            return F.coalesce(eq, F.lit(False))
        if ctx.null_not_equals:
            return F.coalesce(~eq, F.lit(True))
        return F.coalesce(~eq, F.lit(False))
    if t == "in_list":
        return F.coalesce(col.cast("string").isin(*c["values"]), F.lit(False))
    if t == "not_in_list":
        return ~F.coalesce(col.cast("string").isin(*c["values"]), F.lit(False))
    if t == "is_null":
        return _is_null(f, ctx)
    if t == "is_not_null":
        return ~_is_null(f, ctx)
    if t == "no_status":
        return _is_null(status_col, ctx)
    if t == "unconditional":
        return F.lit(True)
    if t in ("erm_le_date", "erm_gt_date", "erm_in_range", "out_of_range"):
        if not _needs(c, ctx, "erm"):
            return None
        erm = F.col("erm")
        if t == "erm_le_date":
            return F.coalesce(erm <= ym, F.lit(False))
        if t == "erm_gt_date":
            return F.coalesce(erm > ym, F.lit(False))
        if not _needs(c, ctx, "period_start", "period_end", "period_ok"):
            return None
        inr = F.coalesce(erm.between(F.col("period_start"), F.col("period_end")), F.lit(False))
        return inr if t == "erm_in_range" else (~inr & F.col("period_ok"))
    if t in ("erm_le_closing", "erm_gt_closing"):
        if not _needs(c, ctx, "erm") or ctx.closing_month is None:
            return None
        cm = F.lit(ctx.closing_month)
        return F.coalesce(F.col("erm") <= cm if t == "erm_le_closing" else F.col("erm") > cm, F.lit(False))
    if t in ("desc_erm_le_date", "desc_erm_gt_date", "desc_erm_not_error", "format_error"):
        if not _needs(c, ctx, "period_start", "period_end", "period_ok"):
            return None
        if t == "desc_erm_le_date":
            return F.col("period_end") <= ym
        if t == "desc_erm_gt_date":
            return F.col("period_start") > ym
        if t == "desc_erm_not_error":
            return F.col("period_start") != F.lit(100001)
        return ~F.col("period_ok")
    if t in ("qty_matched", "qty_not_matched"):
        if not _needs(c, ctx, "entry_qty", "received_qty"):
            return None
        m = F.coalesce(_num(F.col("entry_qty"), "entry_qty", ctx) == _num(F.col("received_qty"), "received_qty", ctx),
                       F.lit(False))
        return m if t == "qty_matched" else ~m
    if t == "not_billed":
        return None if not _needs(c, ctx, "billed_amount") else F.coalesce(F.col("billed_amount") == 0, F.lit(False))
    if t == "has_billing":
        return None if not _needs(c, ctx, "billed_qty") else ~F.col("billed_qty").eqNullSafe(F.lit(0))
    if t in ("fully_billed", "has_unpaid"):
        if not _needs(c, ctx, "entry_amount", "billed_amount"):
            return None
        d = F.col("entry_amount") - F.col("billed_amount")
        return F.coalesce(d == 0 if t == "fully_billed" else d != 0, F.lit(False))
    if t == "remark_completed":
        parts = []
        if "proc_remark" in ctx.columns:
            parts.append(_rlike(F.col("proc_remark"), PROC_COMPLETED))
        if "fn_remark_prev" in ctx.columns:
            parts.append(_rlike(F.col("fn_remark_prev"), FN_COMPLETED))
        return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)
    if t == "pr_not_incomplete":
        if "fn_pr_remark_prev" not in ctx.columns:
            return F.lit(True)
        return ~_rlike(F.col("fn_pr_remark_prev"), PR_INCOMPLETE)
    if t == "not_error":
        if "proc_remark" not in ctx.columns:
            return F.lit(True)
        return ~F.col("proc_remark").eqNullSafe(F.lit(PROC_ERROR))
    if t in ("is_fa", "not_fa"):
        if "gl_number" not in ctx.columns:
            return None
        fa = F.coalesce(F.col("gl_number").cast("string").isin(*ctx.fa_accounts), F.lit(False))
        return fa if t == "is_fa" else ~fa
    if t == "max_amount":
        return F.coalesce(F.col(f or "entry_amount") <= F.lit(c["value"]), F.lit(False))
    raise ValueError(f"unknown check type {t}")


def _stages(rs: RuleSet, ctx: Ctx, status_col: str = "status"):
    """Split the active rules into CASE stages (see module doc): in first-match
    mode at override/unconditional rules, in last-match mode at rules that read
    the status (they must see the writes before them)."""
    stages, run = [], []
    for r in rs.rules:
        if ctx.doc_type not in r.apply_to:
            continue
        reads = any(ch.get("field") == status_col for ch in r.checks)
        if (rs.mode == "first" and (r.override or r.unconditional)) or (rs.mode == "last" and reads):
            if run:
                stages.append(("run", run))
                run = []
            stages.append(("override", [r]))
        else:
            run.append(r)
    if run:
        stages.append(("run", run))
    return stages


def _decoded(rule: Column, given: Column, texts: dict[int, str | None]) -> Column:
    """The text of a rule number: ``given`` for 0, null for null.  An array
    lookup names the rule number once, so that a filter on the result, pushed
    through the stages, does not grow with the number of rules."""
    slots = [F.lit(texts.get(no)).cast("string") for no in range(1, max(texts, default=0) + 1)]
    return apart(F.get(F.array(given.cast("string"), *slots), rule.cast("int")))


def apply_rules(df: DataFrame, rs: RuleSet, ctx: Ctx, status_col: str = "status",
                rule_col: str = "status_rule", note_col: str = "status_note",
                remark_col: str | None = None, set_col: str | None = None) -> DataFrame:
    """Apply a rule set; writes status, rule number and note (and, for label
    rules with remarks, the remark column).  ``set_col`` gets the name of the set
    whose rule decided, so that chained sets keep (set, rule) apart.  A set with
    ``reset`` drops the statuses given on input first; one that ``writes`` the
    remark only goes through ``apply_remarks``.

    Each stage rewrites only the integer ``rule_col`` (0 = status given on
    input, null = open).  Status, note and remark are decoded once at the end.
    """
    ctx = Ctx(**{**ctx.__dict__, "refs": rs.refs or ctx.refs, "null_not_equals": rs.null_not_equals})
    if rs.writes == "remark":
        return apply_remarks(df, rs, ctx, status_col, note_col, remark_col)
    status_in = "_status_in"
    if status_col in df.columns and not rs.reset:
        df = df.withColumn(status_in, F.when(~F.trim(F.col(status_col)).isin(*EMPTY_TEXTS), F.col(status_col)))
    else:
        df = df.withColumn(status_in, F.lit(None).cast("string"))
    remark_in = "_remark_in"
    if remark_col:
        df = df.withColumn(remark_in, F.col(remark_col) if remark_col in df.columns else F.lit(None).cast("string"))
    rule_in = "_rule_in"
    df = df.withColumn(rule_in, F.col(rule_col).cast("bigint") if rule_col in df.columns else F.lit(None).cast("bigint"))
    df = df.withColumn(rule_col, F.when(F.col(status_in).isNotNull(), F.lit(0).cast("bigint")))
    ctx.columns = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    ctx.columns[status_col] = "string"
    active = [r for r in rs.rules if ctx.doc_type in r.apply_to]
    reads_status = {r.no for r in active if any(ch.get("field") == status_col for ch in r.checks)}
    r_prev = F.col(rule_col)

    sctx = Ctx(**{**ctx.__dict__, "columns": {**ctx.columns, "_status_now": "string"}})

    def compiled(rules):
        """Masks of the rules; checks reading the status read ``_status_now``."""
        out = []
        for r in rules:
            masks = []
            for ch in r.checks:
                if ch.get("field") == status_col:
                    ch = dict(ch, field="_status_now")
                m = compile_check(ch, sctx, "_status_now")
                if m is not None:
                    masks.append(m)
            if masks:
                op = (lambda a, b: a | b) if r.combine == "or" else (lambda a, b: a & b)
                out.append((r, reduce(op, masks)))
        return out

    # stage plan
    stages, run = [], []
    for r in active:
        split = (rs.mode == "first" and (r.override or r.unconditional)) or (rs.mode == "last" and r.no in reads_status)
        if split:
            if run:
                stages.append(("run", run))
                run = []
            stages.append(("single", [r]))
        else:
            run.append(r)
    if run:
        stages.append(("run", run))

    for kind, rules in stages:
        if rs.mode == "first" and kind == "run":
            df = df.withColumn("_status_now", F.lit(None).cast("string"))  # open rows: no status
            hits = compiled(rules)
            if not hits:
                continue
            expr = None
            for r, m in hits:
                expr = F.when(m, F.lit(r.no).cast("bigint")) if expr is None else expr.when(m, F.lit(r.no).cast("bigint"))
            new = F.coalesce(r_prev, expr)  # one reference: stages inline linearly
        else:
            df = df.withColumn("_status_now", _decoded(r_prev, F.col(status_in), {x.no: x.status for x in active}))
            now = F.col("_status_now")
            hits = compiled(rules)
            if not hits:
                continue
            if rs.mode == "last":
                hits = hits[::-1]
            expr = None
            for r, m in hits:
                if rs.mode == "first" and not r.unconditional:
                    m = m & (r_prev.isNull() | F.coalesce(now.isin(*r.override), F.lit(False)))
                expr = F.when(m, F.lit(r.no).cast("bigint")) if expr is None else expr.when(m, F.lit(r.no).cast("bigint"))
            new = expr.otherwise(r_prev)
        df = df.withColumn(rule_col, apart(new))

    r = F.col(rule_col)
    status = _decoded(r, F.col(status_in), {x.no: x.status for x in active})
    note = _decoded(r, F.col(note_col) if note_col in df.columns else F.lit(None), {x.no: x.note for x in active})
    outs = {status_col: status, note_col: note}
    if remark_col:
        rem = F.when(r == 0, F.col(remark_in))
        for x in active:
            rem = rem.when(r == x.no, F.lit(x.remark).cast("string") if x.has_remark else F.lit(None).cast("string"))
        outs[remark_col] = F.when(r.isNull(), F.col(remark_in)).otherwise(rem)
    if set_col:
        outs[set_col] = F.when(r > 0, F.lit(rs.name)).otherwise(F.col(set_col) if set_col in df.columns else F.lit(None).cast("string"))
    df = df.withColumns(outs).withColumn(rule_col, F.when(r == 0, F.col(rule_in)).otherwise(r))
    return df.drop(status_in, rule_in, "_status_now", *([remark_in] if remark_col else []))


def apply_remarks(df: DataFrame, rs: RuleSet, ctx: Ctx, status_col: str = "status", note_col: str = "status_note",
                  remark_col: str = "remark") -> DataFrame:
    """A set that leaves the status alone: the last matching rule writes its
    remark (null if it has none) and its note."""
    rules = [r for r in rs.rules if ctx.doc_type in r.apply_to]
    ctx = Ctx(**{**ctx.__dict__, "columns": {f.name: f.dataType.simpleString() for f in df.schema.fields}, "refs": rs.refs or ctx.refs,
                 "null_not_equals": rs.null_not_equals})
    case = None
    for r in rules[::-1]:
        masks = [m for m in (compile_check(ch, ctx, status_col) for ch in r.checks) if m is not None]
        if masks:
            hit, no = reduce((lambda a, b: a | b) if r.combine == "or" else (lambda a, b: a & b), masks), F.lit(r.no).cast("bigint")
            case = F.when(hit, no) if case is None else case.when(hit, no)
    if case is None:
        return df
    df = df.withColumn("_remark_rule", apart(F.coalesce(case, F.lit(0).cast("bigint"))))
    no = F.col("_remark_rule")
    given = {c: F.col(c) if c in df.columns else F.lit(None).cast("string") for c in (remark_col, note_col)}
    return df.withColumns({remark_col: _decoded(no, given[remark_col], {r.no: r.remark for r in rules}),
                           note_col: _decoded(no, given[note_col], {r.no: r.note for r in rules})}).drop("_remark_rule")


# --------------------------------------------------------------------------
# SQL twin (DuckDB dialect) for the oracle
# --------------------------------------------------------------------------

def _q(s: str) -> str:
    return "'" + str(s).replace("'", "''") + "'"


def _sql_is_null(col: str, ctx: Ctx) -> str:
    if ctx.columns.get(col) == "string":
        return f"({col} IS NULL OR trim({col}) IN ('', 'nan'))"
    return f"({col} IS NULL)"


def _sql_rlike(col: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({col}, {_q(pattern)}), false)"


def sql_check(check: dict, ctx: Ctx, status_col: str) -> str | None:
    c = _resolve(check, ctx)
    t = c["type"]
    f = c.get("field")
    ym = str(ctx.run_month)
    if f is not None and f not in ctx.columns:
        return None
    if t == "contains":
        return _sql_rlike(f, c["pattern"])
    if t == "not_contains":
        return f"NOT {_sql_rlike(f, c['pattern'])}"
    if t in ("starts_with", "not_starts_with"):
        return f"{'NOT ' if t[0] == 'n' else ''}coalesce(starts_with({f}, {_q(c['value'])}), false)"
    if t in ("equals", "not_equals"):
        v = c["value"]
        if c.get("cast"):
            eq = f"(TRY_CAST({f} AS DOUBLE) = TRY_CAST({_q(v)} AS DOUBLE))"
        else:
            eq = f"(CAST({f} AS VARCHAR) = {_q(v)})"
        if t == "equals":
            return f"coalesce({eq}, false)"
        return f"coalesce(NOT {eq}, {'true' if ctx.null_not_equals else 'false'})"
    if t in ("in_list", "not_in_list"):
        lst = ", ".join(_q(v) for v in c["values"])
        m = f"coalesce(CAST({f} AS VARCHAR) IN ({lst}), false)"
        return m if t == "in_list" else f"NOT {m}"
    if t == "is_null":
        return _sql_is_null(f, ctx)
    if t == "is_not_null":
        return f"NOT {_sql_is_null(f, ctx)}"
    if t == "no_status":
        return _sql_is_null(status_col, ctx)
    if t == "unconditional":
        return "true"
    if t in ("erm_le_date", "erm_gt_date", "erm_in_range", "out_of_range"):
        if "erm" not in ctx.columns:
            return None
        if t == "erm_le_date":
            return f"coalesce(erm <= {ym}, false)"
        if t == "erm_gt_date":
            return f"coalesce(erm > {ym}, false)"
        if not _needs(c, ctx, "period_start", "period_end", "period_ok"):
            return None
        inr = "coalesce(erm BETWEEN period_start AND period_end, false)"
        return inr if t == "erm_in_range" else f"(NOT {inr} AND period_ok)"
    if t in ("erm_le_closing", "erm_gt_closing"):
        if "erm" not in ctx.columns or ctx.closing_month is None:
            return None
        op = "<=" if t == "erm_le_closing" else ">"
        return f"coalesce(erm {op} {ctx.closing_month}, false)"
    if t in ("desc_erm_le_date", "desc_erm_gt_date", "desc_erm_not_error", "format_error"):
        if not _needs(c, ctx, "period_start", "period_end", "period_ok"):
            return None
        return {"desc_erm_le_date": f"(period_end <= {ym})",
                "desc_erm_gt_date": f"(period_start > {ym})",
                "desc_erm_not_error": "(period_start <> 100001)",
                "format_error": "(NOT period_ok)"}[t]
    if t in ("qty_matched", "qty_not_matched"):
        if not _needs(c, ctx, "entry_qty", "received_qty"):
            return None
        m = "coalesce(TRY_CAST(entry_qty AS DOUBLE) = TRY_CAST(received_qty AS DOUBLE), false)"
        return m if t == "qty_matched" else f"NOT {m}"
    if t == "not_billed":
        return None if "billed_amount" not in ctx.columns else "coalesce(billed_amount = 0, false)"
    if t == "has_billing":
        return None if "billed_qty" not in ctx.columns else "(billed_qty IS DISTINCT FROM 0)"
    if t in ("fully_billed", "has_unpaid"):
        if not _needs(c, ctx, "entry_amount", "billed_amount"):
            return None
        op = "=" if t == "fully_billed" else "<>"
        return f"coalesce(entry_amount - billed_amount {op} 0, false)"
    if t == "remark_completed":
        parts = []
        if "proc_remark" in ctx.columns:
            parts.append(_sql_rlike("proc_remark", PROC_COMPLETED))
        if "fn_remark_prev" in ctx.columns:
            parts.append(_sql_rlike("fn_remark_prev", FN_COMPLETED))
        return "(" + " OR ".join(parts) + ")" if parts else "false"
    if t == "pr_not_incomplete":
        if "fn_pr_remark_prev" not in ctx.columns:
            return "true"
        return f"NOT {_sql_rlike('fn_pr_remark_prev', PR_INCOMPLETE)}"
    if t == "not_error":
        if "proc_remark" not in ctx.columns:
            return "true"
        return f"(proc_remark IS DISTINCT FROM {_q(PROC_ERROR)})"
    if t in ("is_fa", "not_fa"):
        if "gl_number" not in ctx.columns:
            return None
        lst = ", ".join(_q(a) for a in ctx.fa_accounts)
        fa = f"coalesce(CAST(gl_number AS VARCHAR) IN ({lst}), false)"
        return fa if t == "is_fa" else f"NOT {fa}"
    if t == "max_amount":
        return f"coalesce({f or 'entry_amount'} <= {c['value']}, false)"
    raise ValueError(f"unknown check type {t}")


def sql_rule(rule: Rule, ctx: Ctx, status_col: str) -> str | None:
    masks = [m for m in (sql_check(ch, ctx, status_col) for ch in rule.checks) if m is not None]
    if not masks:
        return None
    return "(" + (" OR " if rule.combine == "or" else " AND ").join(masks) + ")"


def apply_rules_sql(source_sql: str, columns: dict, rs: RuleSet, ctx: Ctx,
                    status_col: str = "status", rule_col: str = "status_rule",
                    note_col: str = "status_note", remark_col: str | None = None, set_col: str | None = None) -> str:
    """SQL text applying ``rs`` to the relation ``source_sql`` whose column
    types (Spark names) are ``columns``; output keeps all columns."""
    ctx = Ctx(**{**ctx.__dict__, "refs": rs.refs or ctx.refs, "null_not_equals": rs.null_not_equals})
    cols = dict(columns)
    adds = []
    for c in (status_col, rule_col, note_col) + ((remark_col,) if remark_col else ()) + ((set_col,) if set_col else ()):
        if c not in cols:
            adds.append(f"CAST(NULL AS {'BIGINT' if c == rule_col else 'VARCHAR'}) AS {c}")
            cols[c] = "bigint" if c == rule_col else "string"
    ctx.columns = cols
    sql = f"SELECT *{', ' if adds else ''}{', '.join(adds)} FROM ({source_sql}) src0"
    given = "CAST(NULL AS VARCHAR)" if rs.reset else f"CASE WHEN trim({status_col}) IN ('', 'nan') THEN NULL ELSE {status_col} END"
    sql = f"SELECT * REPLACE ({given} AS {status_col}) FROM ({sql}) src1"
    open_ = f"({status_col} IS NULL)"
    for si, (kind, rules) in enumerate(_stages(rs, ctx, status_col)):
        compiled = [(r, sql_rule(r, ctx, status_col)) for r in rules]
        compiled = [(r, m) for r, m in compiled if m is not None]
        if not compiled:
            continue
        if rs.mode == "last":
            compiled = compiled[::-1]
        whens = []
        for r, m in compiled:
            if rs.mode == "first":
                if r.unconditional:
                    gate = m
                elif kind == "override":
                    lst = ", ".join(_q(s) for s in r.override)
                    gate = f"({m} AND ({open_} OR coalesce({status_col} IN ({lst}), false)))"
                else:
                    gate = f"({open_} AND {m})"
            else:
                gate = m
            whens.append((gate, r))

        def case(val, col):
            return "CASE " + " ".join(f"WHEN {g} THEN {val(r)}" for g, r in whens) + f" ELSE {col} END"

        repl = [
            f"{case(lambda r: f'CAST({r.no} AS BIGINT)', rule_col)} AS {rule_col}",
            f"{case(lambda r: _q(r.status), status_col)} AS {status_col}",
            f"{case(lambda r: _q(r.note), note_col)} AS {note_col}",
        ]
        if rs.writes == "remark":
            repl = [repl[2]]
        if remark_col:
            repl.append(f"{case(lambda r: 'NULL' if r.remark is None else _q(r.remark), remark_col)} AS {remark_col}")
        if set_col:
            repl.append(f"{case(lambda r: _q(rs.name), set_col)} AS {set_col}")
        sql = f"SELECT * REPLACE ({', '.join(repl)}) FROM ({sql}) stage{si}"
    return sql
