"""Splits to the row, sanitised payloads and labels of figures, on odd rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import prep


@pytest.mark.parametrize("n,share", [(1000, 0.2), (7, 0.5), (1, 0.3)])
def test_splits_are_exact_and_stable(spark, n, share):
    draw = random.Random(n)
    rows = [(i, int(draw.random() < 0.3), "x") for i in range(n)]
    frame = spark.createDataFrame(rows, "id int, y int, n string").repartition(5)
    found = prep.stratified_split(frame, "y", ["id"], share).collect()
    again = prep.stratified_split(frame.repartition(3), "y", ["id"], share).collect()
    assert {r["id"]: r.test for r in found} == {r["id"]: r.test for r in again} and len(found) == n
    for label in (0, 1):
        own = [r.test for r in found if r.y == label]
        assert sum(own) == (max(1, round(len(own) * share)) if own else 0)


def test_equal_rows_count_each_and_nulls_are_a_class(spark):
    frame = spark.createDataFrame([(1, 1)] * 300 + [(2, None)] * 10 + [(None, 0)] * 5, "id int, y int")
    found = prep.stratified_split(frame, "y", ["id"], 0.1).groupBy("y", "test").count().collect()
    assert {(r.y, r.test): r["count"] for r in found} == {(1, True): 30, (1, False): 270, (None, True): 1, (None, False): 9, (0, True): 1, (0, False): 4}
    assert prep.stratified_split(frame.where("false"), "y", ["id"], 0.1).count() == 0


@pytest.mark.parametrize("total,positives,others", [(120, 100, 20), (50, 100, 1), (900, 100, 400), (500, 100, 400)])
def test_subsamples_keep_all_positives(spark, total, positives, others):
    frame = spark.createDataFrame([(i, int(i < 100)) for i in range(500)], "id int, y int")
    found = prep.subsampled(frame, "y", ["id"], total).collect()
    assert (sum(r.y for r in found), sum(1 - r.y for r in found)) == (positives, others) and len({r["id"] for r in found}) == len(found)


def test_payloads_keep_allowed_finite_numbers(spark):
    bodies = [{"amount": 5, "velocity": -2.5, "note": "x"}, {"amount": "5"}, {"amount": True}, {"amount": None}, {"amount": 1e12, "velocity": -1e300}, {}, [1], 3]
    rows = [json.dumps(b) for b in bodies] + ["{broken", None, '{"amount": {"amount": 1}}']
    found = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, body string").select("i", prep.sanitised(F.col("body"), ["amount", "velocity"]).alias("m"))
    assert [r.m for r in found.orderBy("i").collect()] == [{"amount": 5.0, "velocity": -2.5}, {}, {}, {}, {"amount": 1e9, "velocity": -1e9}] + [{}] * 6


def test_figures_as_they_are_shown(spark):
    one = lambda column: spark.range(1).select(column.alias("x")).first().x
    lit = lambda v: F.lit(v).cast("double")
    assert [one(prep.pounds(lit(v))) for v in (1234567.4, -1500, 0)] == ["£1,234,567", "-£1,500", "£0"]
    assert [one(prep.compact(lit(v))) for v in (999, 1250, 2_500_000)] == ["999", "1.3k", "2.5m"]
    assert [one(prep.duration(lit(v))) for v in (6, 47.4, 60, 101)] == ["6h", "47h", "3d", "not detected"]
    assert one(prep.percent(lit(0.125))) == "13%" and [one(prep.points(lit(v))) for v in (0.04, -0.1)] == ["+4 pts", "-10 pts"]
    assert [one(prep.day(F.lit(v).cast("bigint"))) for v in (86400, 0, None)] == ["1970-01-02", "", ""]
    assert [one(prep.weak_label(F.lit(a).cast("int"), F.lit(b).cast("string"))) for a, b in ((0, "hold"), (None, "hold"), (None, "allow"), (None, None))] == [0, 1, 0, 0]


def test_a_payload_is_parsed_once_a_row(spark):
    body = F.concat(F.lit('{"amount":'), F.col("id"), F.lit("}"))
    found = spark.range(3).select(prep.described(prep.sanitised(body, ["amount", "velocity"]), ["amount", "velocity"]).alias("d"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count('{"amount":') == 1
    assert [r.d for r in found.collect()] == [f"amount={i}.0" for i in range(3)]
