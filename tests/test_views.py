"""Projections against NumPy, and folds of event streams that arrive in any order."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from ledgerloom.operators import projection
from ledgerloom.plans import networks
from ledgerloom.sinks.upsert import UpsertTable
from ledgerloom.streaming import reducer
from ledgerloom.streaming.rounds import run_to_end

EVENT = "key bigint, ts timestamp, seq bigint, epoch string, kind string, value string"


def numpy_view(v):
    centred = v - v.mean(0)
    axes = np.linalg.svd(centred, full_matrices=False)[2][:2]
    axes *= np.where(axes[np.arange(2), np.abs(axes).argmax(1)] < 0, -1, 1)[:, None]
    points = centred @ axes.T
    away = np.abs(points - points.mean(0))
    return points, np.clip((points - points.mean(0)) / np.percentile(away, 99), -1, 1)


def test_axes_are_those_of_numpy(spark):
    v = np.random.default_rng(2).normal(size=(80, 6)) * [5, 3, 1, 1, 0.5, 0.1]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(100, None), (101, [1.0]), (102, [float("nan")] * 6), (103, [None] * 6)], "id int, v array<double>")
    mean, axes, variance = projection.principal_axes(rows, "v", 6)
    points, scaled = numpy_view(v)
    placed = projection.projected(rows, "v", mean, axes)
    np.testing.assert_allclose([r.point for r in placed.orderBy("id").collect()], points, atol=1e-9)
    np.testing.assert_allclose(variance, points.var(0, ddof=1))
    np.testing.assert_allclose([r.point for r in projection.robust_scaled(placed).orderBy("id").collect()], scaled, atol=1e-9)
    mean, axes, _ = projection.principal_axes(rows.where("id > 99"), "v", 6)
    assert not mean.any() and projection.projected(rows.where("id > 99"), "v", mean, axes).count() == 0
    with pytest.raises(ValueError):
        projection.principal_axes(rows, "v", 5000)


def test_the_projection_query_is_that_of_numpy(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r.vec_id: np.array(r.embedding, float) * (-8 if r.vec_id % 8 == 0 else 1) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids = sorted(rows)
    _, want = numpy_view(np.stack([rows[i] for i in ids]))
    found = {r.member: (r.x, r.y) for r in networks.QUERIES["update_projection"](spark, sf).collect()}
    np.testing.assert_allclose([found[i] for i in ids], want, atol=2e-6)


def events(seed):
    draw, out = random.Random(seed), []
    for seq in range(200):
        at = datetime(2024, 1, 1) + timedelta(seconds=draw.randint(0, 300))
        out.append((draw.choice([1, 2, 3, None]), at, seq, str(seq // 100), draw.choice(["state", "attack", "clear", "connection", "spread", "other"]), draw.choice(["a", "b", None])))
    return out


def by_hand(rows):
    state, edges = {}, set()
    for key, ts, seq, epoch, kind, value in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1], r[2])):
        one = state.setdefault(key, {"state": None, "attacker": None, "connection": None, "events": 0, "last": -1})
        one["events"] += 1
        one["last"] = max(one["last"], seq)
        if kind in ("state", "connection"):
            one[kind] = value
        elif kind in ("attack", "clear"):
            one["attacker"] = value if kind == "attack" else None
        if kind in ("attack", "spread"):
            edges.add((key, epoch, "attack_detected" if kind == "attack" else f"fraud_propagated:{value or ''}"))
    return state, edges


@pytest.mark.parametrize("seed", [1, 2])
def test_streams_and_batches_fold_alike(spark, tmp_path, seed):
    rows = events(seed)
    state, edges = by_hand(rows)
    frame = spark.createDataFrame(rows, EVENT)
    assert {r["key"]: {k: v for k, v in r.asDict().items() if k != "key"} for r in reducer.folded(frame).collect()} == state
    mixed = random.Random(seed).sample(rows, len(rows))
    for i in range(4):
        spark.createDataFrame(mixed[i * 50 : i * 50 + 50], EVENT).coalesce(1).write.parquet(f"{tmp_path}/in/b={i}")
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/b=*")
    table = UpsertTable(spark, f"{tmp_path}/t", reducer.FOLDED, ["key"], "last")
    found = reducer.folded_to(stream, table, f"{tmp_path}/cp")
    assert {r["key"]: {k: v for k, v in r.asDict().items() if k != "key"} for r in found.collect()} == state
    once = run_to_end(reducer.edges(stream), f"{tmp_path}/edges", f"{tmp_path}/cp2").collect()
    assert {tuple(r) for r in once} == edges and len(once) == len(edges)
