"""Contracts, sheets and descriptions on literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from closebook.functions import text as T
from closebook.operators import contracts as C

D = dt.date


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("text, day", [("2024/01/05", D(2024, 1, 5)), ("2024-1-5", D(2024, 1, 5)), ("2024.12.31", D(2024, 12, 31)), ("20240229", D(2024, 2, 29)),
                                       ("2024/3", D(2024, 3, 1)), ("2024", D(2024, 1, 1)), (" 2024/01/05　", D(2024, 1, 5)), ("2024/13/01", None),
                                       ("2023/2/29", None), ("31", None), ("soon", None), ("", None), (None, None)])
def test_days(spark, text, day):
    assert one(spark, text, C.parse_day) == day


@pytest.mark.parametrize("text, start, end", [
    ("2024/01/01 - 2025/12/31", D(2024, 1, 1), D(2025, 12, 31)), ("2024/01/01-2025/12/31", D(2024, 1, 1), D(2025, 12, 31)),
    ("2024/01/01~2025/12/31+", D(2024, 1, 1), D(2025, 12, 31)), ("2024/01/01 至 2025/12/31 +", D(2024, 1, 1), D(2025, 12, 31)),
    ("2024-01-01 - 2025-12-31", D(2024, 1, 1), D(2025, 12, 31)), ("2024-01-01~2025-12-31", None, None),  # a bare dash comes before the tilde
    ("2024/1/1~2024/6/30~2025/12/31", D(2024, 1, 1), D(2025, 12, 31)), ("2024/01/01", None, None), ("2024/01/01 - soon", None, None),
    ("x - 2025/12/31", None, None), ("", None, None), ("~", None, None), (None, None, None)])
def test_periods(spark, text, start, end):
    got = one(spark, text, C.split_period)
    assert (got.start, got.end) == (start, end)


def test_filing_by_position(spark):
    df = spark.createDataFrame([("1", "a", "2024/01/01-2024/12/31"), (" ", "b", "2024/01/01-2024/12/31"), ("x", "b", "2024/01/01-2024/12/31"),
                                ("2", None, "2024/01/01-2024/12/31"), ("3", "c", "TBD"), ("4", "d", None)], "`店號 1` string, `地.址` string, q string")
    assert [tuple(r) for r in C.standard_filing(df).collect()] == [(1, "a", D(2024, 1, 1), D(2024, 12, 31))]


def test_renewal_by_names(spark):
    ddl = "`門市店號` string, `詳細地址(樓)` string, `第二期合約截止日` string, `備註` string, `第一期合約起始日` string"
    df = spark.createDataFrame([("1", "a", "2025-12-31", "-", "2024/01/01"), ("2", "b", "open", "-", "2024/01/01"), ("", "c", "2025-12-31", "-", "2024/01/01"),
                                ("4", "d", "2025-12-31", None, "2024/01/01")], ddl)
    got = sorted((r.sp_code, r.address, r.contract_start_day, r.contract_end_day) for r in C.standard_renewal(df).collect())
    assert got == [(1, "a", D(2024, 1, 1), D(2025, 12, 31)), (2, "b", D(2024, 1, 1), None)]
    with pytest.raises(ValueError, match="address"):
        C.standard_renewal(df.drop("詳細地址(樓)"))


SIDE = "sp_code bigint, address string, contract_start_day date, contract_end_day date"


@pytest.fixture(scope="module")
def merged(spark):
    filing = [(1, "a", D(2024, 1, 1), D(2024, 12, 31)), (1, "a", D(2024, 1, 1), D(2024, 12, 31)), (1, "b", D(2023, 1, 1), D(2024, 6, 30)), (2, "c", D(2022, 1, 1), D(2022, 2, 2))]
    renewal = [(1, "a", D(2025, 1, 1), D(2026, 12, 31)), (3, "a號2樓", D(2025, 1, 1), None), (4, "d", None, D(2025, 10, 1)), (5, "d", None, D(2027, 10, 1))]
    return C.merge(spark.createDataFrame(filing, SIDE), spark.createDataFrame(renewal, SIDE))


def test_merge_keeps_both_sides_and_distinct_rows(merged):
    got = {(r.sp_code, r.address): (r.contract_start_day_filing, r.contract_end_day_renewal) for r in merged.collect()}
    assert merged.count() == 6
    assert got == {(1, "a"): (D(2024, 1, 1), D(2026, 12, 31)), (1, "b"): (D(2023, 1, 1), None), (2, "c"): (D(2022, 1, 1), None), (3, "a號2樓"): (None, None),
                   (4, "d"): (None, D(2025, 10, 1)), (5, "d"): (None, D(2027, 10, 1))}


def test_one_period_per_site(merged):
    got = {(r.sp_code, r.address): tuple(r[2:]) for r in C.site_dates(merged).select("sp_code", "address", *C.STARTS, *C.ENDS).collect()}
    assert got[1, "a"] == got[1, "b"] == (D(2023, 1, 1),) * 2 + (D(2026, 12, 31),) * 2
    assert got[2, "c"] == (D(2022, 1, 1),) * 2 + (D(2022, 2, 2),) * 2
    assert got[3, "a號2樓"] == (D(2025, 1, 1),) * 2 + (None,) * 2 and got[4, "d"][0] is None


def test_months_left_and_two_level_lookup(spark, merged):
    left = C.months_left(C.site_dates(merged), 202510)
    assert {(r.sp_code, r.address): (r.months_diff, r.truncated_address) for r in left.collect()} == {
        (1, "a"): (15, "a"), (1, "b"): (15, "b"), (2, "c"): (-43, "c"), (3, "a號2樓"): (None, "a號"), (4, "d"): (1, "d"), (5, "d"): (25, "d")}
    lines = spark.createDataFrame([("a",), ("d",), ("a號",), ("zz",), (None,)], "extracted_address string")
    assert {r.extracted_address: r.months_diff for r in C.lookup_months(lines, left).collect()} == {"a": 15, "d": 1, "a號": None, "zz": None, None: None}
    cut = left.withColumn("months_diff", F.coalesce("months_diff", F.lit(7)))
    assert {r.extracted_address: r.months_diff for r in C.lookup_months(lines, cut).collect()}["a號"] == 7


GRID = "row bigint, cells array<string>"


def test_ragged_grids(spark):
    g = spark.createDataFrame([(0, ["title"]), (1, ["id", "", "id", "note"]), (2, ["1", "x"]), (3, []), (4, ["2", "y", "z", "n", "more"])], GRID)
    t = C.sheet_grid(g, skip_first_row=True)
    assert t.columns == ["id", "1", "id_2", "note", "4"]
    assert sorted(map(tuple, t.collect())) == [("", "", "", "", ""), ("1", "x", "", "", ""), ("2", "y", "z", "n", "more")]
    bare = C.sheet_grid(g, header_row=False)
    assert bare.columns == ["0", "1", "2", "3", "4"] and bare.count() == 5
    assert C.sheet_grid(g.where("row < 2"), skip_first_row=True).count() == 0
    assert C.sheet_grid(g.limit(0), header_row=False).columns == []


def test_sheets_by_position(spark):
    def row(n, cells):
        return [cells.get(i, "") for i in range(n)]

    first = [(0, row(25, {})), (1, row(25, {0: "1", 6: "a", 21: "s", 24: "e"})), (2, row(25, {0: "2", 6: "b", 21: "#N/A", 24: "e"})), (3, row(21, {0: "3", 6: "c"}))]
    other = [(0, row(17, {})), (1, row(17, {0: "4", 2: "d", 13: "s1", 14: "e1", 15: "s2", 16: "e2"})), (2, row(3, {0: "5", 2: "f"}))]
    f, o = spark.createDataFrame(first, GRID), spark.createDataFrame(other, GRID)
    got = sorted(map(tuple, C.renewal_union(f, o, o.limit(0)).collect()))
    assert got == [("1", "a", "s", "e", "s", "e"), ("4", "d", "s1", "e1", "s2", "e2"), ("5", "f", "", "", "", "")]


@pytest.mark.parametrize("text, clean", [
    ("2024/05 SVP_SPX 門市裝修工程-北投 (台北市北投區路1號) SPX store decoration 第一期款項 #SP-C", "SPX_門市裝修工程-北投 (台北市北投區路1號)_第一期款項"),
    ("2024/05 SVP_SPX 冷氣裝修工程Air-con equipment(台北市路1號) #SP-C", "SPX_冷氣裝修工程(台北市路1號)"),
    ("SVP 招牌工程signboard（新北市路2號）x", "SPX_招牌工程(新北市路2號)"),
    ("2024/05 SVP_SPX 門市智取櫃工程SPX locker XA 第二期款項 #SP-C", "SPX_門市智取櫃工程SPX locker XA 第二期款項"),
    ("2024/05/01 - 2024/06/30 SPX  service payment machine 2", "SPX_service"), ("2024/05 IT   service_SPX N-SOC x", "SPX_IT service"),
    (" 　plain\ttext 　", "SPX_plain text"), ("spx x", "SPX_x"), ("SPXx", "SPX_SPXx"), ("", "SPX_"), ("#only a tag", "SPX_"), (None, None)])
def test_cleaned_descriptions(spark, text, clean):
    assert one(spark, text, T.clean_description) == clean


@pytest.mark.parametrize("text, cabinet", [
    ("2024/05 SVP_SPX 門市智取櫃工程SPX locker XA 第二期款項 #x", "XA"), ("2024/05 SVP_SPX 門市智取櫃工程SPX locker 控制主機 #x", "控制主櫃"),
    ("SPX HD locker 控制主櫃 1", "HD主櫃"), ("spx hd LOCKER 安裝運費", "HD安裝運費"), ("SPX HD locker B", "HD櫃"), ("locker XA", None), (None, None)])
def test_cabinets(spark, text, cabinet):
    assert one(spark, text, lambda c: T.cabinet_type(c, T.without_instalment(T.clean_description(c)))) == cabinet


@pytest.mark.parametrize("text, address", [("x(台北市中山區路1號)y", "台北市中山區路1號"), ("(中山區路1號) (台北市大安區)", "中山區路1號"), ("( 大安區路1 )", "大安區路1"),
                                           ("(no address)", None), ("台北市中山區", None), (None, None)])
def test_addresses_in_parentheses(spark, text, address):
    assert one(spark, text, T.address_in_parens) == address


@pytest.mark.parametrize("text, cut", [("路1號2樓", "路1號"), ("路1號3號", "路1號"), ("路1", "路1"), (None, None)])
def test_cut_addresses(spark, text, cut):
    assert one(spark, text, T.address_truncate) == cut
