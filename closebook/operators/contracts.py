"""Site contracts (D-09, D-10, F-17, J-13, J-14, A-19, S-21, S-27): two lists
cleaned, merged on (site, address), one period per site, months left, and a
lookup by full, else by truncated address."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closebook.functions.periods import months_diff
from closebook.functions.text import address_truncate, bind, strip

# Fixed value: separators of a contract period, the first one present counts.
SEPARATORS = (" - ", "-", "~", "至")
START, END = "contract_start_day", "contract_end_day"
# What the renewal list's column names contain, by target column.
RENEWAL_COLUMNS = {"店號": "sp_code", "詳細地址": "address", "第一期合約起始日": START, "第二期合約截止日": END}
KEYS = ["sp_code", "address"]
STARTS, ENDS = [f"{START}_filing", f"{START}_renewal"], [f"{END}_filing", f"{END}_renewal"]


DAY = r"^\d{4}([-/.]\d{1,2}){0,2}$|^\d{8}$"


def parse_day(text: Column) -> Column:
    """A date in one of the notations Y/M/D, Y-M-D, Y.M.D, YYYYMMDD, Y/M (its
    first day) or Y (its first day); anything else, or no such day: null."""
    def read(t: Column) -> Column:
        ymd = F.regexp_replace(t, r"^(\d{4})[-/.]?(\d{0,2})[-/.]?(\d{0,2})$", "$1-$2-$3")
        return F.when(t.rlike(DAY), F.try_to_timestamp(F.regexp_replace(ymd, r"-(?=-|$)", "-1"), F.lit("yyyy-M-d")).cast("date"))

    return bind(strip(text), read)


def split_period(text: Column) -> Column:
    """F-17: struct(start, end) of a contract period: plus signs go, the first
    separator present splits, first and last part are dates.  If either is none,
    both are null; so ISO dates need the blank-dash-blank separator, as a bare
    dash comes before the others."""
    def parts(t: Column) -> Column:
        return reduce(lambda rest, s: F.when(F.contains(t, F.lit(s)), F.split(t, f"\\Q{s}\\E")).otherwise(rest), reversed(SEPARATORS),
                      F.lit(None).cast("array<string>"))

    def both(d: Column) -> Column:
        return F.struct(F.when(d["end"].isNotNull(), d["start"]).alias("start"), F.when(d["start"].isNotNull(), d["end"]).alias("end"))

    days = bind(bind(strip(F.replace(text, F.lit("+"), F.lit(""))), parts),
                lambda p: F.struct(parse_day(F.get(p, F.lit(0))).alias("start"), parse_day(F.get(p, F.size(p) - 1)).alias("end")))
    return bind(days, both)


def site_code(text: Column) -> Column:
    """A site number; what is no whole number is null."""
    t = strip(text.cast("string"))
    return F.when(t.rlike(r"^\d{1,18}$"), t.cast("bigint"))


def without_nulls(df: DataFrame) -> DataFrame:
    """Rows without any null; column names may hold dots."""
    return df.where(reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in df.columns]))


def standard_filing(raw: DataFrame) -> DataFrame:
    """D-09: the filing list by position (site, address, period); rows with a
    null, a site that is no number or a period that can't be read go."""
    site, address, period = (F.col(f"`{c}`") for c in raw.columns[:3])
    days = split_period(period)
    return without_nulls(raw).select(site_code(site).alias("sp_code"), address.cast("string").alias("address"),
                                days["start"].alias(START), days["end"].alias(END)).na.drop()


def standard_renewal(raw: DataFrame) -> DataFrame:
    """D-09: the renewal list, columns found by what their names contain; rows
    with a null or without a site number go, unreadable dates are null."""
    found = {target: next((c for c in raw.columns if part in c), None) for part, target in RENEWAL_COLUMNS.items()}
    missing = [k for k in KEYS if found[k] is None]
    if missing:
        raise ValueError(f"renewal list without {', '.join(missing)}")
    read = {"sp_code": site_code, "address": lambda c: c.cast("string"), START: parse_day, END: parse_day}
    return without_nulls(raw).select(*[read[k](F.col(f"`{c}`")).alias(k) for k, c in found.items() if c is not None]).na.drop(subset=KEYS)


def merge(filing: DataFrame, renewal: DataFrame) -> DataFrame:
    """J-13: full outer join on (site, address), distinct."""
    def suffixed(df: DataFrame, by: str) -> DataFrame:
        return df.select(*KEYS, *[F.col(c).alias(f"{c}_{by}") for c in df.columns if c not in KEYS])

    return suffixed(filing, "filing").join(suffixed(renewal, "renewal"), KEYS, "full_outer").distinct()


def site_dates(merged: DataFrame) -> DataFrame:
    """A-19: every row of a site gets its earliest start and latest end of both
    lists; sites without any keep null; distinct rows.  A group-by of one row
    per site and a join back, so no site is held in one task."""
    by = merged.where(F.col("sp_code").isNotNull()).groupBy("sp_code").agg(
        F.min(F.least(*STARTS)).alias("_start"), F.max(F.greatest(*ENDS)).alias("_end"))
    return (merged.join(by, "sp_code", "left").withColumns({c: F.col("_start") for c in STARTS} | {c: F.col("_end") for c in ENDS})
            .drop("_start", "_end").distinct())


def months_left(dated: DataFrame, run_month: int) -> DataFrame:
    """D-10: months from the run month to a site's end, both counted, and the
    address cut for the second lookup."""
    return dated.select(*KEYS, STARTS[0], ENDS[1], months_diff(F.col(ENDS[1]), run_month).alias("months_diff"),
                        address_truncate(F.col("address")).alias("truncated_address"))


def lookup_months(lines: DataFrame, left: DataFrame, address: str = "extracted_address") -> DataFrame:
    """J-14: ``months_diff`` by the whole address, else by the truncated one.
    Of rows with one address the first counts (by site, address, start), also
    where its months are null."""
    order = F.struct(*KEYS, F.col(STARTS[0]), F.col(ENDS[1]))

    def first(key: str, out: str) -> DataFrame:
        rows = left.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(address))
        return rows.agg(F.min_by(F.struct("months_diff"), order).getField("months_diff").alias(out))

    # Lines without an address meet nothing; dealt by their other values, no task gets them all.
    # All others go by the length, as a constant would not stay in the join's key.
    dealt = lines.withColumn("_deal", F.when(F.col(address).isNull(), F.hash(*lines.columns)).otherwise(F.length(address)))
    for side in (first("address", "_full"), first("truncated_address", "_cut")):
        dealt = dealt.join(side.withColumn("_deal", F.length(address)), [address, "_deal"], "left")
    return dealt.withColumn("months_diff", F.coalesce("_full", "_cut")).drop("_full", "_cut", "_deal")


# -------------------------------------------------------------- sheet grids

def sheet_grid(grid: DataFrame, header_row: bool = True, skip_first_row: bool = False) -> DataFrame:
    """S-27: rows of cells (``row`` from 0, ``cells``) as a table.  Short rows
    are padded with blanks to the widest one; the first row, or the one after a
    skipped first row, names the columns (blank or repeated names get their
    position); without a header they are numbered.  Only the width and the
    header row reach the driver."""
    width = grid.agg(F.max(F.size("cells"))).first()[0] or 0
    at = int(skip_first_row)
    names = [str(i) for i in range(width)]
    if header_row:
        row = grid.where(F.col("row") == at).select("cells").first()
        given = list(row.cells if row else [])[:width]
        for i, n in enumerate([*given, *[""] * (width - len(given))]):
            n = (n or "").strip()
            names[i] = n if n and n not in names[:i] else f"{n}_{i}".lstrip("_")
    body = grid.where(F.col("row") >= at + int(header_row))
    return body.select(*[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])


RENEWAL_NAMES = ("sp_code", "address", "first_start", "first_end", "second_start", "second_end")
#: Positions of these columns in the first sheet (which has one period) and in the others.
FIRST_SHEET, OTHER_SHEETS = (0, 6, 21, 24, 21, 24), (0, 2, 13, 14, 15, 16)


def by_position(grid: DataFrame, positions: tuple[int, ...], names: tuple[str, ...], header_rows: int = 1) -> DataFrame:
    """Columns of a grid by position; cells that a short row lacks are blank."""
    return grid.where(F.col("row") >= header_rows).select(
        *[F.coalesce(F.get("cells", F.lit(p)), F.lit("")).alias(n) for p, n in zip(positions, names, strict=True)])


def renewal_union(first: DataFrame, second: DataFrame, third: DataFrame) -> DataFrame:
    """S-21: three sheets in one layout; rows of the first sheet whose start is
    blank or ``#N/A`` go."""
    head = by_position(first, FIRST_SHEET, RENEWAL_NAMES).where(~F.col("first_start").isin("", "#N/A"))
    return reduce(DataFrame.unionByName, [head, *[by_position(g, OTHER_SHEETS, RENEWAL_NAMES) for g in (second, third)]])
