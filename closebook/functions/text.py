"""Text scalars (F-01, F-02, F-05, F-15, F-16, F-18 to F-20, F-22, F-24)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference's): texts that mean "no value".
NULL_TEXTS = ("", "nan", "None", "N/A", "n/a", "<NA>")
# Fixed value: the remark marker of an asset month, and the "partly done" veto.
FA_MARK = r"\d{6}入FA"
PARTLY_DONE = "部分完成"
# Fixed value: a "word" in both regex dialects (Java and RE2).
WORD = r"[\p{L}\p{N}_]+"


def clean_text(c: Column) -> Column:
    """F-01: trim; null-like texts → null."""
    t = F.trim(c)
    return F.when(~t.isin(*NULL_TEXTS), t)


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body
    names it: nested texts otherwise multiply in the plan and its code."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def apart(value: Column) -> Column:
    """``value``, with its projection left out of whole-stage code.  There all
    steps of a stage end up in one method, which the JVM never compiles once it
    is above 8000 bytes: every row then runs interpreted.  A projection by
    itself is split into small methods.  The first operand never gives a value:
    a lambda is what whole-stage code leaves out."""
    return F.coalesce(bind(F.lit(None), lambda v: v), value)


def regexp_substr_null(c: Column, pattern: str) -> Column:
    """First match of ``pattern`` or null (``regexp_extract`` gives '')."""
    return F.nullif(F.regexp_extract(c, f"({pattern})", 1), F.lit(""))


def fa_remark_status(remark: Column) -> Column:
    """F-05: the 'YYYYMM入FA' tag as a status when the remark carries it and is
    not 'partly done'; otherwise null."""
    hit = F.coalesce(remark.rlike("入FA") & ~remark.rlike(PARTLY_DONE), F.lit(False))
    return F.when(hit, regexp_substr_null(remark, FA_MARK))


# Where an address is cut, and an address of a city or district in parentheses.
ADDRESS_CUT = "^.*?號"
ADDRESS_IN_PARENS = r"\(((?:.{2,3}[縣市])?.{1,3}[區鄉鎮市].*?)\)"


def address_truncate(addr: Column) -> Column:
    """F-15: cut after the first 號 (unchanged when absent)."""
    return F.coalesce(regexp_substr_null(addr, ADDRESS_CUT), addr)


def address_in_parens(text: Column) -> Column:
    """F-16: the parenthesised city/district address, trimmed; none → null."""
    return F.nullif(strip(F.regexp_extract(text, ADDRESS_IN_PARENS, 1)), F.lit(""))


# Fixed value: white space in both regex dialects, wide blanks included.
BLANK = r"[\s\p{Z}]"


def strip(c: Column) -> Column:
    """Without white space around, as far as line ends and wide blanks."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


# The two layouts recognised first (name, address and instalment;
# name and address), and the steps of the general clean-up in their order.
LAYOUT_INSTALMENT = r"(?i)(門市裝修工程-.*?\(.*?\))\s*SPX\s*store decoration\s*(.*?)\s*#"
LAYOUT_ADDRESS = r"SVP_?(?:SPX)?\s*(.*?)(?:\(|（)([^)）]+)(?:\)|）)"
LATIN_TAIL = r"[a-zA-Z\s-]+$"
CLEANING = (
    r"\s*#.*$",
    r"(?i)\s*payment machine.*$",
    r"(?i)_SPX N-SOC.*$",
    r"^(\d{4}/\d{2}/\d{2})\s*-\s*(\d{4}/\d{2}/\d{2})",
    r"^\d{4}/\d{2}\s*_?SVP_?(?:SPX)?\s*",
    r"^\d{4}/\d{2}\s*",
)
PREFIX = "SPX_"
INSTALMENT = "第[一|二|三]期款項"


def clean_description(desc: Column) -> Column:
    """F-18: a description without dates, tags and translations, prefixed.

    A name with address and instalment, or a name with address, is taken apart;
    anything else passes the cleaning steps one after the other.
    """
    return bind(strip(desc), _cleaned)


def _cleaned(text: Column) -> Column:
    two = F.regexp_extract(text, LAYOUT_INSTALMENT, 1), F.regexp_extract(text, LAYOUT_INSTALMENT, 2)
    name = strip(F.regexp_replace(strip(F.regexp_extract(text, LAYOUT_ADDRESS, 1)), LATIN_TAIL, ""))
    place = strip(F.regexp_extract(text, LAYOUT_ADDRESS, 2))
    rest = strip(F.regexp_replace(text, CLEANING[0], ""))
    for step in CLEANING[1:]:
        rest = F.regexp_replace(rest, step, "")
    rest = strip(F.regexp_replace(rest, f"{BLANK}+", " "))
    rest = bind(rest, lambda r: F.when(r.rlike("(?i)^SPX "), F.regexp_replace(r, "(?i)^SPX ", PREFIX)).otherwise(F.concat(F.lit(PREFIX), r)))
    return (F.when(text.rlike(LAYOUT_INSTALMENT), F.concat(F.lit(PREFIX), strip(two[0]), F.lit("_"), strip(two[1])))
            .when(text.rlike(LAYOUT_ADDRESS), F.concat(F.lit(PREFIX), name, F.lit("("), place, F.lit(")")))
            .otherwise(rest))


def without_instalment(cleaned: Column) -> Column:
    """A cleaned description without its instalment and the bars left around."""
    return F.regexp_replace(F.regexp_replace(cleaned, INSTALMENT, ""), "^_+|_+$", "")


# The cabinet in a cleaned text, and what HD cabinets are called.
CABINET_MARK, CABINET_TAIL = "智取櫃", r"門市智取櫃工程SPX locker\s?(.*)"
HD_CABINETS = (("SPX HD locker 控制主櫃", "HD主櫃"), ("SPX HD locker 安裝運費", "HD安裝運費"), ("SPX HD locker", "HD櫃"))


def cabinet_type(desc: Column, cleaned: Column) -> Column:
    """F-19, F-20: the cabinet that a cleaned text (without instalment) names;
    where it names none, HD cabinets by the description itself."""
    named = F.when(cleaned.contains(CABINET_MARK) & cleaned.rlike(CABINET_TAIL),
                   F.replace(strip(F.regexp_extract(cleaned, CABINET_TAIL, 1)), F.lit("主機"), F.lit("主櫃")))
    hd = F.coalesce(*[F.when(desc.rlike(f"(?i){p}"), F.lit(v)) for p, v in HD_CABINETS])
    return F.coalesce(named, hd)


def discount_rate(text: Column) -> Column:
    """F-22: 'N折' → N/10 for 0 < N ≤ 10, else null."""
    n = F.regexp_extract(text, r"(\d+(?:\.\d+)?)折", 1)
    v = F.when(n != "", n.cast("double"))
    return F.when((v > 0) & (v <= 10), v / 10)


def first_word(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, f"^({WORD})", 1), F.lit(""))


def product_code_check(project: Column, product: Column) -> Column:
    """F-24: first word of the project equals the product code → good."""
    return F.when(F.coalesce(first_word(project) == product, F.lit(False)), F.lit("good")).otherwise(F.lit("bad"))
