"""SQL (DuckDB) twins of the scalar Column builders, used only to write the
oracle text.  Same fixed patterns, independent implementation."""

from __future__ import annotations

from closebook.functions.periods import (MONTH_ABBR, PAT_YM, PAT_YM_TO_YM, PAT_YMD,
                                         PAT_YMD_TO_YMD, SENTINEL_END, SENTINEL_START)


def q(s: str) -> str:
    return "'" + str(s).replace("'", "''") + "'"


def _valid(s: str, has_day: bool) -> str:
    y = f"TRY_CAST(substr({s}, 1, 4) AS INTEGER)"
    m = f"TRY_CAST(substr({s}, 6, 2) AS INTEGER)"
    ok = f"{s} <> '' AND {y} BETWEEN 1900 AND 9999 AND {m} BETWEEN 1 AND 12"
    if has_day:
        ok += f" AND TRY_CAST(substr({s}, 9, 2) AS INTEGER) BETWEEN 1 AND 31"
    return f"coalesce({ok}, false)"


def _ym(s: str) -> str:
    return f"(TRY_CAST(substr({s}, 1, 4) AS INTEGER) * 100 + TRY_CAST(substr({s}, 6, 2) AS INTEGER))"


def period_columns(desc: str, prefix: str = "period") -> str:
    """Select-list fragment giving ``{prefix}_start, _end, _ok`` from ``desc``."""
    s = f"trim({desc})"
    a1, b1 = f"regexp_extract({s}, {q(PAT_YMD_TO_YMD)}, 1)", f"regexp_extract({s}, {q(PAT_YMD_TO_YMD)}, 2)"
    a2, b2 = f"regexp_extract({s}, {q(PAT_YM_TO_YM)}, 1)", f"regexp_extract({s}, {q(PAT_YM_TO_YM)}, 2)"
    a3, a4 = f"regexp_extract({s}, {q(PAT_YMD)}, 1)", f"regexp_extract({s}, {q(PAT_YM)}, 1)"
    v1 = f"({_valid(a1, True)} AND {_valid(b1, True)})"
    v2 = f"({_valid(a2, False)} AND {_valid(b2, False)})"
    v3, v4 = _valid(a3, True), _valid(a4, False)
    start = (f"CASE WHEN {v1} THEN {_ym(a1)} WHEN {v2} THEN {_ym(a2)} WHEN {v3} THEN {_ym(a3)} "
             f"WHEN {v4} THEN {_ym(a4)} ELSE {SENTINEL_START} END")
    end = (f"CASE WHEN {v1} THEN {_ym(b1)} WHEN {v2} THEN {_ym(b2)} WHEN {v3} THEN {_ym(a3)} "
           f"WHEN {v4} THEN {_ym(a4)} ELSE {SENTINEL_END} END")
    ok = f"({v1} OR {v2} OR {v3} OR {v4})"
    return f"{start} AS {prefix}_start, {end} AS {prefix}_end, {ok} AS {prefix}_ok"


def erm_parse(text: str) -> str:
    pat = q(r"^([A-Za-z]{3})-(\d{2})$")
    months = "[" + ", ".join(q(m) for m in MONTH_ABBR) + "]"
    mon = f"list_position({months}, lower(regexp_extract(trim({text}), {pat}, 1)))"
    yy = f"TRY_CAST(regexp_extract(trim({text}), {pat}, 2) AS INTEGER)"
    year = f"(CASE WHEN {yy} < 69 THEN {yy} + 2000 ELSE {yy} + 1900 END)"
    return f"coalesce(CASE WHEN {mon} > 0 THEN {year} * 100 + {mon} END, 0)"
