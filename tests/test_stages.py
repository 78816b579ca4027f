"""Plans that have to stay cheap on large tables: methods short enough for the
JVM to compile, rule stages planned once, lines without a key dealt out."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from closebook.operators import contracts as C
from closebook.plans import flows as FL

SF = "/root/testdata/sf0.001"
COMPILED = 8000  # bytes of a method that the JVM still compiles


@pytest.fixture
def joins_by_shuffle(spark):
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def longest_method(spark, df) -> int:
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    stages = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size()))


@pytest.mark.parametrize("name", ["accrual_amount", "status_erm", "status_labels", "status_sct", "accrued_by_account"])
def test_methods_stay_short(spark, joins_by_shuffle, name):
    assert longest_method(spark, E.queries()[name](spark, SF)) <= COMPILED


@pytest.mark.parametrize("name", ["rule_hits", "ledger_pivot", "accrued_by_account", "account_lookup"])
def test_no_filter_through_the_rule_stages(spark, name):
    plan = E.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "office rent" in x]


def test_accrued_rows(spark):
    led = spark.createDataFrame([("a", "Y", None), ("a", "Y", None), ("b", "N", "s"), ("c", None, "s")], "po_line string, accrue string, status string")
    assert sorted(map(tuple, FL.accrued(led, "po_line", "status").collect())) == [("a", None), ("a", None)]


def test_lines_without_an_address_are_dealt(spark, joins_by_shuffle):
    lines = spark.createDataFrame([(str(i), None) for i in range(400)], "po_line string, extracted_address string")
    names = list(dict.fromkeys(["address", "truncated_address", *C.KEYS, C.STARTS[0], C.ENDS[1]]))
    left = spark.createDataFrame([("a",) * len(names) + (5,)], ", ".join(f"{c} string" for c in names) + ", months_diff bigint")
    out = C.lookup_months(lines, left)
    assert out.columns == ["extracted_address", "po_line", "months_diff"] and out.count() == 400
    assert len({r.task for r in out.withColumn("task", F.spark_partition_id()).collect()}) > 1
