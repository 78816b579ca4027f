"""Scalar functions on literal fixtures (invalid month 13, sentinel,
'10' vs '10.0', null-like texts, two-digit years)."""

from pyspark.sql import functions as F

from closebook.functions import numbers as N
from closebook.functions import periods as P
from closebook.functions import text as T


def one(spark, col, values, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(col(F.col("x")).alias("y")).collect()]


def test_period_patterns_fall_through(spark):
    df = spark.createDataFrame([("rent 2024/01/01 - 2024/12/31",), ("fee 2024/01-2024/03",), ("x 2024/13 then 2024/05",),
                                ("y 2024/02/30",), ("none",), (None,), ("z 2024/13/01 - 2024/14/01 2023/07",)], "d string")
    out = P.with_period_columns(df, "d").collect()
    got = [(r.period_start, r.period_end, r.period_ok) for r in out]
    # only the FIRST match of each pattern is validated: an invalid first
    # match ('2024/13') hides later valid dates of the same pattern
    assert got == [(202401, 202412, True), (202401, 202403, True), (100001, 100002, False),
                   (202402, 202402, True), (100001, 100002, False), (100001, 100002, False),
                   (100001, 100002, False)]


def test_erm_parse_two_digit_years(spark):
    assert one(spark, P.erm_parse, ["Jun-98", "jan-05", "Dec-68", "Mar-69", "TBD", None, "Foo-98"]) == \
        [199806, 200501, 206812, 196903, 0, 0, 0]


def test_int_text_and_coerce(spark):
    assert one(spark, N.int_text, ["10", "10.0", " 6.0 ", "N.A.", None]) == ["10", "10", "6", None, None]
    assert one(spark, N.to_int_or_zero, ["3.0", "x", None]) == [3, 0, 0]


def test_clean_text_and_fa_remark(spark):
    assert one(spark, T.clean_text, [" a ", "nan", "<NA>", "N/A", "", None]) == ["a", None, None, None, None, None]
    assert one(spark, T.fa_remark_status, ["202401入FA", "202401入FA 部分完成", "done", None]) == \
        ["202401入FA", None, None, None]


def test_discount_and_address(spark):
    assert one(spark, T.discount_rate, ["9折驗收", "0折", "11折", "none"]) == [0.9, None, None, None]
    assert one(spark, T.address_truncate, ["台北市信義路5號3樓", "no number"]) == ["台北市信義路5號", "no number"]


def test_previous_month(spark):
    assert one(spark, P.previous_month, [202401, 202412], "int") == [202312, 202411]


def test_day_and_month_texts_without_a_formatter_a_row(spark):
    """Equal to the patterns' texts, years of three and five digits included; a
    formatter is reached for those alone, and texts of a part are worked out before the join."""
    from closebook.sources import adapter as A

    days = [f"{y}-{m:02d}-{d:02d} 23:59:59.999999" for y in ("0999", "1000", "1969", "1998", "2000", "9999") for m, d in ((1, 1), (9, 9), (12, 31))]
    df = spark.createDataFrame([(x,) for x in [*days, "+10000-01-01 00:00:00", None]], "x string").select(F.col("x").cast("timestamp_ntz").alias("x"))
    for mine, pattern in ((A.day_text, "yyyyMMdd"), (A.month_text, "MMM-yy")):
        got = df.select(mine(F.col("x")).alias("a"), F.date_format("x", pattern).alias("b")).collect()
        assert [r.a for r in got] == [r.b for r in got]

    class T:  # a part without a name, one with, and none
        lineitem = spark.sql("""SELECT 7L l_orderkey, k l_partkey, 2L l_suppkey, 3 l_linenumber, 5D l_quantity, 0D l_discount, 0D l_tax, 'N' l_returnflag,
                                       'F' l_linestatus, timestamp_ntz'1998-06-30 12:00:00' l_shipdate FROM VALUES (1L), (4L), (9L) AS v(k)""")
        orders = spark.sql("SELECT 7L o_orderkey, 1L o_custkey, 'F' o_orderstatus, '5-LOW' o_orderpriority")
        part = spark.sql("""SELECT * FROM VALUES (1L, CAST(NULL AS string), 'Brand#12', 'NONE', 10.5D), (4L, 'red', CAST(NULL AS string), 'PROMO', 1D)
                            AS v(p_partkey, p_name, p_brand, p_type, p_retailprice)""")
        supplier = spark.sql("SELECT 2L s_suppkey, 's' s_name")

    got = {r.item_ref.split("-")[0]: r for r in A.po_raw(T).collect()}
    assert [got[k].item_description for k in "149"] == ["1998/06", "red deposit", ""]
    assert [got[k].product_code for k in "149"] == ["BR12", None, None]
    assert [got[k].project for k in "149"] == ["BR12 none", None, None]
    assert got["1"].item_ref == "1-2-19980630-5" and got["1"].erm_text == "Jun-98"
    plan = A.po_raw(T)._jdf.queryExecution().analyzed().toString()
    assert plan.index("Join") < plan.index("lower("), "lower-cased once a line"
