"""Identities and corner cases of the operators."""

from pyspark.sql import functions as F

from ledgerloom.functions.scalar import to_number
from ledgerloom.operators import graph, ledger, metrics, robust

SF = "/root/testdata/sf0.001"


def test_auc_corner_cases(spark):
    rows = [("perfect", s, y) for s, y in ((0.1, 0), (0.2, 0), (0.8, 1), (0.9, 1))]
    rows += [("reversed", s, y) for s, y in ((0.9, 0), (0.8, 0), (0.2, 1), (0.1, 1))]
    rows += [("tied", 0.5, y) for y in (0, 0, 1, 1)] + [("one class", 0.5, 1)]
    found = {r.k: r.auc for r in metrics.roc_auc(spark.createDataFrame(rows, "k string, score double, y int"), ["k"]).collect()}
    assert found == {"perfect": 1.0, "reversed": 0.0, "tied": 0.5, "one class": 0.5}


def test_numbers_from_text(spark):
    rows = spark.createDataFrame([("nan",), ("inf",), ("3.0",), (None,), ("YES",), ("",), ("x",)], "s string")
    assert [r.x for r in rows.select(to_number(F.col("s"), 7.0).alias("x")).collect()] == [7.0, 7.0, 3.0, 7.0, 1.0, 7.0, 7.0]


def test_degrees_add_up(spark):
    nodes, edges = graph.payment_graph(spark, SF)
    total = graph.degrees(nodes, edges).agg(F.sum("in_degree").alias("i"), F.sum("out_degree").alias("o")).first()
    assert total.i == total.o == edges.count()


def test_self_edge_weighs_twice(spark):
    nodes = spark.createDataFrame([("a", 1, 3.0), ("b", 1, 6.0)], "id string, bank int, x double")
    edges = spark.createDataFrame([("a", "a", 1.0), ("a", "b", 1.0)], "src string, dst string, amount double")
    found = {r.id: r.mean_x for r in graph.neighbour_mean(nodes, edges).collect()}
    assert found == {"a": 4.0, "b": 4.5}


def test_krum_names_the_poisoned(spark):
    rows = [(i, [1.0 + i / 100, 1.0]) for i in range(9)] + [(9, [-50.0, -50.0])]
    updates = spark.createDataFrame(rows, "member int, v array<double>")
    assert [r.member for r in robust.outlier_gate(updates, 1).where("rejected").collect()] == [9]
    honest = updates.where("member < 9")
    assert robust.outlier_gate(honest, 1).where("rejected").count() == 0


def test_inclusion_proof(spark):
    levels = [ledger.leaves(spark.range(7), "id", F.col("id").cast("string"))]
    while levels[-1].count() > 1:
        levels.append(ledger.level(levels[-1]))
    root = levels[-1].first()["h"]
    leaf = levels[0].where("seq = 6").first()["h"]
    assert ledger.verify_inclusion(leaf, 6, ledger.inclusion_proof(levels, 6), root)
    assert not ledger.verify_inclusion("0" * 64, 6, ledger.inclusion_proof(levels, 6), root)
