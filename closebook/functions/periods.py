"""Month and period scalars (F-03, F-04, F-07, F-13, F-14).

A service period is a struct ``(start int YYYYMM, end int YYYYMM, ok bool)``;
the text form ``"YYYYMM,YYYYMM"`` with the sentinel ``100001,100002`` for
"cannot parse" is produced only on output.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from closebook.functions.text import apart

# Fixed values (must equal the reference's): description period patterns,
# tried in this order, and the sentinel for an unparsable description.
PAT_YMD_TO_YMD = r"(\d{4}/\d{2}/\d{2})\s*-\s*(\d{4}/\d{2}/\d{2})"
PAT_YM_TO_YM = r"(\d{4}/\d{2})\s*-\s*(\d{4}/\d{2})"
PAT_YMD = r"(\d{4}/\d{2}/\d{2})"
PAT_YM = r"(\d{4}/\d{2})"
SENTINEL_START = 100001
SENTINEL_END = 100002
# English month abbreviations of the ``%b-%y`` ERM format.
MONTH_ABBR = ["jan", "feb", "mar", "apr", "may", "jun",
              "jul", "aug", "sep", "oct", "nov", "dec"]


def ym_text(month_index: Column) -> Column:
    """year*12+month-1 → 'YYYY/MM'."""
    y = F.floor(month_index / 12).cast("bigint")
    m = F.pmod(month_index, F.lit(12)) + 1
    return F.concat(y.cast("string"), F.lit("/"), F.lpad(m.cast("string"), 2, "0"))


def _digits(s: Column, pos: int, n: int) -> Column:
    """Digits of a regex capture → int.  The capture is all digits whenever it
    is not empty, so a guarded plain cast is exact; ``try_cast`` would pay a
    caught exception per non-numeric row."""
    return F.when(s != "", F.substring(s, pos, n).cast("int"))


def _valid(s: Column, has_day: bool) -> Column:
    y, m = _digits(s, 1, 4), _digits(s, 6, 2)
    ok = y.between(1900, 9999) & m.between(1, 12)
    if has_day:
        ok = ok & _digits(s, 9, 2).between(1, 31)
    return F.coalesce(ok, F.lit(False))


def _ym(s: Column) -> Column:
    return _digits(s, 1, 4) * 100 + _digits(s, 6, 2)


def period_from_description(desc: Column) -> Column:
    """F-03: first valid of the four patterns; an invalid match falls through
    to the next pattern; nothing valid → sentinel with ok=false."""
    s = F.trim(desc)
    a1, b1 = F.regexp_extract(s, PAT_YMD_TO_YMD, 1), F.regexp_extract(s, PAT_YMD_TO_YMD, 2)
    a2, b2 = F.regexp_extract(s, PAT_YM_TO_YM, 1), F.regexp_extract(s, PAT_YM_TO_YM, 2)
    a3 = F.regexp_extract(s, PAT_YMD, 1)
    a4 = F.regexp_extract(s, PAT_YM, 1)
    v1 = _valid(a1, True) & _valid(b1, True)
    v2 = _valid(a2, False) & _valid(b2, False)
    v3 = _valid(a3, True)
    v4 = _valid(a4, False)
    start = (F.when(v1, _ym(a1)).when(v2, _ym(a2)).when(v3, _ym(a3)).when(v4, _ym(a4))
             .otherwise(F.lit(SENTINEL_START)))
    end = (F.when(v1, _ym(b1)).when(v2, _ym(b2)).when(v3, _ym(a3)).when(v4, _ym(a4))
           .otherwise(F.lit(SENTINEL_END)))
    return F.struct(start.alias("start"), end.alias("end"), (v1 | v2 | v3 | v4).alias("ok"))


def with_period_columns(df, desc: str, prefix: str = "period"):
    """F-03 as a frame transform: the six regex captures and four validity
    flags become plain intermediate columns, so each regex runs once per row
    and the generated code stays small; the steps stand apart for the same reason."""
    s = F.trim(F.col(desc))
    caps = {"_a1": (PAT_YMD_TO_YMD, 1), "_b1": (PAT_YMD_TO_YMD, 2), "_a2": (PAT_YM_TO_YM, 1),
            "_b2": (PAT_YM_TO_YM, 2), "_a3": (PAT_YMD, 1), "_a4": (PAT_YM, 1)}
    df = df.withColumns({k: apart(F.regexp_extract(s, p, g)) for k, (p, g) in caps.items()})
    c = F.col
    df = df.withColumns({
        "_v1": apart(_valid(c("_a1"), True) & _valid(c("_b1"), True)),
        "_v2": apart(_valid(c("_a2"), False) & _valid(c("_b2"), False)),
        "_v3": apart(_valid(c("_a3"), True)),
        "_v4": apart(_valid(c("_a4"), False)),
    })
    v1, v2, v3, v4 = c("_v1"), c("_v2"), c("_v3"), c("_v4")
    df = df.withColumns({
        f"{prefix}_start": apart(F.when(v1, _ym(c("_a1"))).when(v2, _ym(c("_a2"))).when(v3, _ym(c("_a3")))
                                  .when(v4, _ym(c("_a4"))).otherwise(F.lit(SENTINEL_START))),
        f"{prefix}_end": apart(F.when(v1, _ym(c("_b1"))).when(v2, _ym(c("_b2"))).when(v3, _ym(c("_a3")))
                                .when(v4, _ym(c("_a4"))).otherwise(F.lit(SENTINEL_END))),
        f"{prefix}_ok": apart(v1 | v2 | v3 | v4),
    })
    return df.drop(*caps, "_v1", "_v2", "_v3", "_v4")


def period_text(start: Column, end: Column) -> Column:
    return F.concat(start.cast("string"), F.lit(","), end.cast("string"))


def erm_parse(text: Column) -> Column:
    """F-07: 'Mon-yy' → YYYYMM int; anything else → 0.  Two-digit years follow
    strptime: 69–99 → 19xx, 00–68 → 20xx (Spark's own 'yy' would give 20xx)."""
    s = F.trim(text)
    pat = r"^([A-Za-z]{3})-(\d{2})$"
    mon = F.array_position(F.array(*[F.lit(m) for m in MONTH_ABBR]),
                           F.lower(F.regexp_extract(s, pat, 1)))
    yy = _digits(F.regexp_extract(s, pat, 2), 1, 2)
    year = F.when(yy < 69, yy + 2000).otherwise(yy + 1900)
    return F.coalesce(F.when(mon > 0, year * 100 + mon.cast("int")), F.lit(0))


def remark_date_format(text: Column) -> Column:
    """F-04: 'YYYY/MM' → 'YYYYMM' inside free text."""
    return F.regexp_replace(text, r"(\d{4})/(\d{2})", "$1$2")


def previous_month(ym: Column) -> Column:
    """F-13: YYYYMM → previous YYYYMM."""
    idx = F.floor(ym / 100).cast("bigint") * 12 + F.pmod(ym, F.lit(100)) - 2
    return F.floor(idx / 12).cast("bigint") * 100 + F.pmod(idx, F.lit(12)) + 1


def months_diff(d: Column, run_month: int) -> Column:
    """F-14: months from run month to date d, plus one."""
    y, m = run_month // 100, run_month % 100
    return ((F.year(d) - y) * 12 + F.month(d) - m + 1).cast("bigint")
