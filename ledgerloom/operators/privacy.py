"""Privacy accounting of the Gaussian mechanism, and the noise itself."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.rounds import running
from ledgerloom.session import map_arrow, written

#: The orders looked at, tenths from 1.1 to 10.9, whole ones from 11 to 63, and three large ones.
ORDERS = (*(1 + k / 10 for k in range(1, 100)), *(float(k) for k in range(11, 64)), 128.0, 256.0, 512.0)


def _moment(order: int, q: float, sigma: float) -> float:
    """Renyi divergence at a whole order of the mechanism applied to a random share ``q`` of the rows."""
    i = np.arange(order + 1)
    ways = math.lgamma(order + 1) - np.array([math.lgamma(k + 1) + math.lgamma(order - k + 1) for k in i.tolist()])
    terms = ways + i * math.log(q) + (order - i) * math.log1p(-q) + (i * i - i) / (2 * sigma * sigma)
    return float(np.logaddexp.reduce(terms)) / (order - 1)


def epsilon(sigma: float, delta: float, rounds: int, q: float = 1.0) -> tuple[float, float]:
    """(epsilon, order) spent by ``rounds`` of noise ``sigma``: the least over the orders."""
    best = (math.inf, math.nan)
    for a in ORDERS:
        low = max(2, math.floor(a))
        each = a / (2 * sigma * sigma) if q >= 1 else max(_moment(low, q, sigma), _moment(low + 1, q, sigma)) if q > 0 else 0.0
        best = min(best, (max(0.0, rounds * each + math.log((a - 1) / a) - (math.log(delta) + math.log(a)) / (a - 1)), a))
    return best


def calibrate(target: float, delta: float, rounds: int, q: float = 1.0, largest: float = 1024.0, tolerance: float = 1e-4) -> float:
    """The least noise multiplier that spends at most ``target``, by bisection from above."""
    if target <= 0 or not 0 < delta < 1 or rounds < 1 or not 0 < q <= 1:
        raise ValueError("target and rounds must be positive, delta in (0, 1), q in (0, 1]")
    low, high = 1e-6, largest
    if epsilon(high, delta, rounds, q)[0] > target:
        raise ValueError(f"noise of {largest} does not reach epsilon {target}")
    while high - low > tolerance * high:
        mid = (low + high) / 2
        low, high = (mid, high) if epsilon(mid, delta, rounds, q)[0] > target else (low, mid)
    return high


def budget_table(settings: DataFrame, delta: float) -> DataFrame:
    """Adds ``epsilon`` to settings (sigma, q, rounds): every order of every setting is a row, and so is every term of
    its moment, so a table of any number of settings is spread over tasks."""
    spark = settings.sparkSession
    orders = spark.createDataFrame([(a,) for a in ORDERS], "alpha double")
    whole = sorted({max(2, math.floor(a)) + k for a in ORDERS for k in (0, 1)})
    ways = spark.createDataFrame([(m, i, math.lgamma(m + 1) - math.lgamma(i + 1) - math.lgamma(m - i + 1)) for m in whole for i in range(m + 1)], "m int, i int, ways double")
    part = settings.where("q < 1").select("sigma", "q").distinct()
    i, m, q, sigma = (F.col(c) for c in ("i", "m", "q", "sigma"))
    term = F.col("ways") + i * F.log(q) + (m - i) * F.log1p(-q) + (i * i - i) / (2 * sigma * sigma)
    terms = part.crossJoin(F.broadcast(ways)).select("sigma", "q", "m", term.alias("t"))  # some 4,000 terms a setting
    top = terms.groupBy("sigma", "q", "m").agg(F.max("t").alias("top"))
    sums = terms.join(top, ["sigma", "q", "m"]).groupBy("sigma", "q", "m", "top").agg(F.sum(F.exp(F.col("t") - F.col("top"))).alias("s"))
    moments = sums.select("sigma", "q", "m", ((F.col("top") + F.log("s")) / (F.col("m") - 1)).alias("rdp"))
    rows = settings.crossJoin(F.broadcast(orders)).withColumn("low", F.greatest(F.lit(2), F.floor("alpha").cast("int")))
    a = F.col("alpha")
    full = rows.where("q >= 1").withColumn("rdp", a / (2 * sigma * sigma))
    near = rows.where("q < 1").withColumn("m", F.explode(F.array("low", F.col("low") + 1))).join(moments, ["sigma", "q", "m"])
    near = near.groupBy("sigma", "q", "rounds", "alpha", "low").agg(F.max("rdp").alias("rdp"))
    spent = F.col("rounds") * F.col("rdp") + F.log((a - 1) / a) - (math.log(delta) + F.log(a)) / (a - 1)
    both = full.select(*near.columns).union(near)
    return both.groupBy("sigma", "q", "rounds").agg(F.min(F.greatest(F.lit(0.0), spent)).alias("epsilon"))


def noised(updates: DataFrame, sigma: float, sensitivity: float, seed: int | None = None) -> DataFrame:
    """``updates`` with Gaussian noise of ``sigma`` times ``sensitivity`` on every component of ``v``.

    Without a seed every task draws from the system's entropy; a seed is for tests and gives no privacy.
    """
    names = updates.columns
    at = names.index("v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rng = np.random.default_rng(None if seed is None else [seed, TaskContext.get().partitionId()])
        for batch in batches:
            v = batch.column(at)
            flat = v.flatten().to_numpy(zero_copy_only=False) + rng.normal(0, sigma * sensitivity, len(v.flatten()))
            made = pa.ListArray.from_arrays(pa.array(v.offsets.to_numpy() - v.offsets[0].as_py()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([made if k == at else c for k, c in enumerate(batch.columns)], names=names)

    return map_arrow(updates, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in updates.schema))


def spent_by_round(rounds: DataFrame, sigma: float, q: float, delta: float) -> DataFrame:
    """(round, rounds, epsilon): the budget spent up to each aggregated round, in the order of ``round``; null is no round.

    A restart replays it: the budget is a function of the rounds that the log holds.
    """
    done = rounds.where("round is not null").select("round").distinct()
    placed = running(done, "round", before=(F.lit(1), "sum")).select("round", (F.coalesce("before", F.lit(0)) + 1).cast("bigint").alias("rounds"))
    settings = written(placed.select("round", F.lit(sigma).alias("sigma"), F.lit(q).alias("q"), "rounds"), "budgets")
    return settings.join(budget_table(settings.drop("round"), delta).select("rounds", "epsilon"), "rounds").select("round", "rounds", "epsilon")
