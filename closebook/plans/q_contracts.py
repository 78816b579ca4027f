"""Site contracts, sheets and descriptions (A-19, D-09, D-10, F-15 to F-20,
J-13, J-14, S-21, S-27)."""

from __future__ import annotations

from pyspark.sql import functions as F

from closebook.functions import text as T
from closebook.operators import contracts as C
from closebook.plans.oracle_fns import q
from closebook.plans.registry import register
from closebook.sources import adapter as A
from closebook.sources.adapter_sql import RUN_MONTH, _r1, _r2, address_sql, cte
from closebook.sources.testdata import Tables


def _strip(c: str) -> str:
    return f"regexp_replace({c}, {q(f'^{T.BLANK}+|{T.BLANK}+$')}, '', 'g')"


def _sub(c: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({c}, {q(pattern)}, {q(by)}, 'g')"


def _ext(c: str, pattern: str, group: int) -> str:
    return f"regexp_extract({c}, {q(pattern)}, {group})"


def _date(c: str) -> str:
    """The same notations, one TRY each."""
    t = _strip(c)
    return (f"CAST(coalesce(CASE WHEN regexp_matches({t}, '^\\d{{4}}[-/.]\\d{{1,2}}[-/.]\\d{{1,2}}$') THEN try_strptime({_sub(t, '[/.]', '-')}, '%Y-%m-%d') END, "
            f"CASE WHEN regexp_matches({t}, '^\\d{{4}}[-/.]\\d{{1,2}}$') THEN try_strptime({_sub(t, '[/.]', '-')} || '-1', '%Y-%m-%d') END, "
            f"CASE WHEN regexp_matches({t}, '^\\d{{8}}$') THEN try_strptime({t}, '%Y%m%d') END, "
            f"CASE WHEN regexp_matches({t}, '^\\d{{4}}$') THEN try_strptime({t}, '%Y') END) AS DATE)")


_t = _strip("replace(C, '+', '')")
_parts = "CASE " + " ".join(f"WHEN contains(t, {q(s)}) THEN string_split(t, {q(s)})" for s in C.SEPARATORS) + " END"
cte("filing_days", f"""
  SELECT A, B, C, CASE WHEN e IS NOT NULL THEN s END AS d1, CASE WHEN s IS NOT NULL THEN e END AS d2 FROM (
    SELECT A, B, C, {_date('p[1]')} AS s, {_date('p[len(p)]')} AS e FROM (SELECT *, {_parts} AS p FROM (SELECT *, {_t} AS t FROM filing_list) a) b) c""")
cte("filing", "SELECT TRY_CAST(trim(A) AS BIGINT) AS sp_code, B AS address, d1, d2 FROM filing_days WHERE TRY_CAST(nullif(trim(A), '') AS BIGINT) IS NOT NULL AND d1 IS NOT NULL AND B IS NOT NULL")
cte("renewal", f"SELECT CAST(site AS BIGINT) AS sp_code, addr AS address, {_date('d1')} AS d1, {_date('d2')} AS d2 FROM renewal_list WHERE addr IS NOT NULL")
cte("merged_sites", """
  SELECT DISTINCT coalesce(f.sp_code, r.sp_code) AS sp_code, coalesce(f.address, r.address) AS address, f.d1 AS contract_start_day_filing,
    f.d2 AS contract_end_day_filing, r.d1 AS contract_start_day_renewal, r.d2 AS contract_end_day_renewal
  FROM filing f FULL JOIN renewal r ON f.sp_code = r.sp_code AND f.address = r.address""")
cte("dated_sites", """
  SELECT DISTINCT m.sp_code, address, s AS contract_start_day_filing, e AS contract_end_day_filing, s AS contract_start_day_renewal, e AS contract_end_day_renewal
  FROM merged_sites m JOIN (SELECT sp_code, min(least(contract_start_day_filing, contract_start_day_renewal)) AS s,
    max(greatest(contract_end_day_filing, contract_end_day_renewal)) AS e FROM merged_sites GROUP BY sp_code) g ON g.sp_code = m.sp_code""")
_cut = "coalesce(nullif(regexp_extract({}, '^[^號]*號'), ''), {})"
cte("site_months", f"""
  SELECT sp_code, address, contract_start_day_filing, contract_end_day_renewal,
    CAST((year(contract_end_day_renewal) - {RUN_MONTH // 100}) * 12 + month(contract_end_day_renewal) - {RUN_MONTH % 100} + 1 AS BIGINT) AS months_diff,
    {_cut.format('address', 'address')} AS truncated_address FROM dated_sites""")
_dates = ", ".join(f"{c}" for c in [C.STARTS[0], C.ENDS[0], C.STARTS[1], C.ENDS[1]])


def _merged(t):
    return C.merge(C.standard_filing(A.filing_list(t)), C.standard_renewal(A.renewal_list(t)))


def _months(t):
    return C.months_left(C.site_dates(_merged(t)), RUN_MONTH)


@register("contract_period_split", "SELECT A AS sp_text, C AS period_text, d1 AS start_day, d2 AS end_day FROM filing_days")
def contract_period_split(spark, sf):
    """F-17: start and end of period texts in several notations."""
    days = C.split_period(F.col("C"))
    return A.filing_list(Tables(spark, sf)).select(F.col("A").alias("sp_text"), F.col("C").alias("period_text"), days["start"].alias("start_day"), days["end"].alias("end_day"))


@register("contract_standardize", """
SELECT 'filing' AS list, sp_code, address, d1 AS contract_start_day, d2 AS contract_end_day FROM filing
UNION ALL SELECT 'renewal', sp_code, address, d1, d2 FROM renewal""")
def contract_standardize(spark, sf):
    """D-09: both lists in one layout."""
    t = Tables(spark, sf)
    both = [C.standard_filing(A.filing_list(t)).withColumn("list", F.lit("filing")), C.standard_renewal(A.renewal_list(t)).withColumn("list", F.lit("renewal"))]
    return both[0].unionByName(both[1])


@register("contract_merge", f"SELECT sp_code, address, {_dates} FROM merged_sites")
def contract_merge(spark, sf):
    """J-13: full outer join on site and address."""
    return _merged(Tables(spark, sf))


@register("contract_dates", f"SELECT sp_code, address, {_dates} FROM dated_sites")
def contract_dates(spark, sf):
    """A-19: earliest start and latest end per site."""
    return C.site_dates(_merged(Tables(spark, sf)))


@register("contract_months", "SELECT * FROM site_months")
def contract_months(spark, sf):
    """D-10: months left per site, with the cut address."""
    return _months(Tables(spark, sf))


# DuckDB's pattern engine needs the address written without a lazy tail.
_paren = _strip(_ext("item_description", r"\(((?:.{2,3}[縣市])?.{1,3}[區鄉鎮市].*?)\)", 1))
cte("addressed", f"SELECT po_line, nullif({_paren}, '') AS extracted_address FROM site_lines")


@register("address_extract", "SELECT po_line, extracted_address FROM addressed")
def address_extract(spark, sf):
    """F-16: address in parentheses."""
    return A.site_lines(Tables(spark, sf)).select("po_line", T.address_in_parens(F.col("item_description")).alias("extracted_address"))


@register("address_truncate", f"SELECT po_line, {_cut.format('extracted_address', 'extracted_address')} AS truncated_address FROM addressed")
def address_truncate(spark, sf):
    """F-15: address up to the house number."""
    return A.site_lines(Tables(spark, sf)).select("po_line", T.address_truncate(T.address_in_parens(F.col("item_description"))).alias("truncated_address"))


def _first(key: str) -> str:
    return (f"(SELECT {key} AS k, months_diff FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY sp_code, address, contract_start_day_filing NULLS FIRST, "
            f"contract_end_day_renewal NULLS FIRST) AS rn FROM site_months) z WHERE rn = 1)")


@register("contract_period_lookup", f"""
SELECT po_line, extracted_address, coalesce(a.months_diff, b.months_diff) AS months_diff FROM addressed l
LEFT JOIN {_first('address')} a ON a.k = l.extracted_address LEFT JOIN {_first('truncated_address')} b ON b.k = l.extracted_address""")
def contract_period_lookup(spark, sf):
    """J-14: months left by full, else by truncated address."""
    t = Tables(spark, sf)
    lines = A.site_lines(t).select("po_line", T.address_in_parens(F.col("item_description")).alias("extracted_address"))
    return C.lookup_months(lines, _months(t)).select("po_line", "extracted_address", "months_diff")


_d = _strip("item_description")
_name = _strip(_sub(_strip(_ext("d", T.LAYOUT_ADDRESS, 1)), T.LATIN_TAIL))
_rest = _strip(_sub("d", T.CLEANING[0]))
for _step in T.CLEANING[1:]:
    _rest = f"regexp_replace({_rest}, {q(_step)}, '')"
_rest = _strip(_sub(_rest, f"{T.BLANK}+", " "))
cte("cleaned", f"""
  SELECT po_line, item_description, cleaned, {_sub(_sub('cleaned', T.INSTALMENT), '^_+|_+$')} AS bare FROM (
    SELECT po_line, item_description, CASE
      WHEN regexp_matches(d, {q(T.LAYOUT_INSTALMENT)}) THEN 'SPX_' || {_strip(_ext('d', T.LAYOUT_INSTALMENT, 1))} || '_' || {_strip(_ext('d', T.LAYOUT_INSTALMENT, 2))}
      WHEN regexp_matches(d, {q(T.LAYOUT_ADDRESS)}) THEN 'SPX_' || {_name} || '(' || {_strip(_ext('d', T.LAYOUT_ADDRESS, 2))} || ')'
      WHEN regexp_matches(r, '(?i)^SPX ') THEN regexp_replace(r, '(?i)^SPX ', 'SPX_') ELSE 'SPX_' || r END AS cleaned
    FROM (SELECT *, {_rest} AS r FROM (SELECT *, {_d} AS d FROM site_lines) a) b) c""")


@register("clean_description", "SELECT po_line, cleaned, bare FROM cleaned")
def clean_description(spark, sf):
    """F-18: cleaned texts, with and without the instalment."""
    lines = A.site_lines(Tables(spark, sf)).withColumn("cleaned", T.clean_description(F.col("item_description")))
    return lines.select("po_line", "cleaned", T.without_instalment(F.col("cleaned")).alias("bare"))


_hd = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(item_description, {q('(?i)' + p)}) THEN {q(v)} END" for p, v in T.HD_CABINETS) + ")"


@register("cabinet_type", f"""
SELECT po_line, coalesce(CASE WHEN contains(bare, '{T.CABINET_MARK}') AND regexp_matches(bare, {q(T.CABINET_TAIL)})
  THEN replace({_strip(_ext('bare', T.CABINET_TAIL, 1))}, '主機', '主櫃') END, {_hd}) AS cabinet_type FROM cleaned""")
def cabinet_type(spark, sf):
    """F-19, F-20: the cabinet that a line names."""
    lines = A.site_lines(Tables(spark, sf)).withColumn("bare", T.without_instalment(T.clean_description(F.col("item_description"))))
    return lines.select("po_line", T.cabinet_type(F.col("item_description"), F.col("bare")).alias("cabinet_type"))


_site = f"CAST(p_partkey AS VARCHAR) AS sp_code, {address_sql('p_partkey')} AS address"
_gone = "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE {} END"


@register("renewal_union", f"""
SELECT {_site}, CASE WHEN p_partkey % 6 = 3 THEN '#N/A' ELSE {_r1} END AS first_start, {_gone.format(_r2)} AS first_end,
  {_r1} AS second_start, {_gone.format(_r2)} AS second_end FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 6 <> 0 AND p_partkey % 6 <> 3
UNION ALL SELECT {_site}, {_r1}, {_gone.format(_r2)}, {_gone.format(_r2)}, {_gone.format(_r1)} FROM part WHERE p_partkey % 3 = 1
UNION ALL SELECT {_site}, {_r1}, {_gone.format(_r1)}, {_gone.format(_r2)}, {_gone.format(_r2)} FROM part WHERE p_partkey % 3 = 2""")
def renewal_union(spark, sf):
    """S-21: three positional sheets in one layout."""
    return C.renewal_union(*A.renewal_grids(Tables(spark, sf)))


@register("sheet_grid", f"""
SELECT {', '.join({0: 'CAST(p_partkey AS VARCHAR)', 2: address_sql('p_partkey'), 13: _r1, 14: _gone.format(_r2), 15: _gone.format(_r2), 16: _gone.format(_r1)}.get(i, "''") + f' AS b{i}' for i in range(17))}
FROM part WHERE p_partkey % 3 = 1""")
def sheet_grid(spark, sf):
    """S-27: a ragged grid as a table named by its header row."""
    return C.sheet_grid(A.renewal_grids(Tables(spark, sf))[1])
