"""Aggregation of members' update vectors, plain and robust to poisoned members."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalar import clip_norm
from ledgerloom.session import ship_package

MAX_PAIRWISE = 2000
METHODS = ("krum", "trimmed_mean", "median", "bulyan")


def poisoned(v: Column, scale: float) -> Column:
    """The attacker's update: the honest one times ``-scale``."""
    return F.transform(v, lambda x: x * F.lit(-float(scale)))


def block_layout(sizes: list[int]) -> list[tuple[int, int, int]]:
    """(block, first component, end) of contiguous blocks of these sizes."""
    ends = np.cumsum([0, *sizes]).tolist()
    return [(k, a, b) for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]


def noise_sensitivity(budgets: list[float]) -> float:
    """Sensitivity of blocks clipped to their own budgets: the root of the sum of squares."""
    return float(np.sqrt(np.square(budgets).sum()))


def exploded(updates: DataFrame, member: str = "member", vector: str = "v") -> DataFrame:
    """(member, dim, value) of every component."""
    return updates.select(*(c for c in updates.columns if c != vector), F.posexplode(vector).alias("dim", "value"))


def fedavg(updates: DataFrame, weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """(dim, value): the mean of the vectors, weighted where a weight column is named."""
    rows = exploded(updates)
    mean = F.avg("value") if weight is None else F.sum(F.col("value") * F.col(weight)) / F.sum(weight)
    return rows.groupBy(*(by or []), "dim").agg(mean.alias("value"))


def coordinate_median(updates: DataFrame, by: list[str] | None = None) -> DataFrame:
    return exploded(updates).groupBy(*(by or []), "dim").agg(F.median("value").alias("value"))


def trimmed(updates: DataFrame, k: int | None = None, by: list[str] | None = None, ratio: float | None = None) -> DataFrame:
    """(by..., member, dim, value, kept): which components stay when the k lowest and highest of each go.

    ``ratio`` in [0, 0.5) gives k as that share of the members, rounded down.
    """
    if ratio is not None and not 0 <= ratio < 0.5:
        raise ValueError("the trim ratio must be in [0, 0.5)")
    w = Window.partitionBy(*(by or []), "dim")
    rows = exploded(updates).withColumn("rank", F.row_number().over(w.orderBy("value", "member"))).withColumn("n", F.count("*").over(w))
    cut = F.lit(k) if ratio is None else F.floor(F.col("n") * F.lit(ratio))
    return rows.withColumn("kept", (F.col("rank") > cut) & (F.col("rank") <= F.col("n") - cut))


def trimmed_mean(updates: DataFrame, k: int | None = None, by: list[str] | None = None, ratio: float | None = None, strict: bool = False) -> DataFrame:
    """(by..., dim, value): mean without the k lowest and highest; the median (``strict``: null) where nothing would be left."""
    rows = trimmed(updates, k, by, ratio)
    mean = F.avg(F.when(F.col("kept"), F.col("value")))
    return rows.groupBy(*(by or []), "dim").agg((mean if strict else F.coalesce(mean, F.median("value"))).alias("value"))


def trim_membership(updates: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """(by..., member, trimmed, suspicious): members trimmed on more than half of the components."""
    rows = trimmed(updates, k, by)
    count = F.count_if(~F.col("kept"))
    return rows.groupBy(*(by or []), "member").agg(count.alias("trimmed"), (count > F.count("*") / 2).alias("suspicious"))


def pairwise_distance(updates: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., a, b, d2) for every ordered pair of members of a cohort; a cohort has at most MAX_PAIRWISE members."""
    by = by or []
    n = updates.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if n > MAX_PAIRWISE:
        raise ValueError(f"{n} members; pairwise aggregation takes at most {MAX_PAIRWISE} in a cohort")
    a = updates.select(*by, F.col("member").alias("a"), F.col("v").alias("va"))
    b = updates.select(*by, F.col("member").alias("b"), F.col("v").alias("vb"))
    pairs = (a.join(b, by) if by else a.join(F.broadcast(b))).where("a <> b")
    return pairs.select(*by, "a", "b", F.aggregate(F.zip_with("va", "vb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x).alias("d2"))


def krum_scores(updates: DataFrame, f: int, by: list[str] | None = None, strict: bool = False) -> DataFrame:
    """(by..., member, krum): the sum of the n - f - 2 smallest squared distances to others, at least one; 0 for a member
    without others. ``strict``: cohorts with n - f - 2 below one have no scores, so nobody of them is selected."""
    by = by or []
    w = Window.partitionBy(*by, "a")
    rows = pairwise_distance(updates, by).withColumn("rank", F.row_number().over(w.orderBy("d2", "b"))).withColumn("n", F.count("*").over(w) + 1)
    near = F.col("n") - f - 2 if strict else F.greatest(F.lit(1), F.col("n") - f - 2)
    found = rows.where(F.col("rank") <= near).groupBy(*by, F.col("a").alias("member")).agg(F.sum("d2").alias("krum"))
    if strict:
        return found
    return updates.select(*by, "member").join(found, [*by, "member"], "left").withColumn("krum", F.coalesce("krum", F.lit(0.0)))


def multi_krum(updates: DataFrame, f: int, by: list[str] | None = None, strict: bool = False) -> DataFrame:
    """(by..., member, krum, selected): the n - f members of lowest score of each cohort, ties to the lower member.

    ``strict``: cohorts too small for a score are left out.
    """
    by = by or []
    cohort = Window.partitionBy(*(by or [F.lit(0)]))
    ranked = krum_scores(updates, f, by, strict).withColumn("rank", F.row_number().over(cohort.orderBy("krum", "member"))).withColumn("n", F.count("*").over(cohort))
    return ranked.select(*by, "member", "krum", (F.col("rank") <= F.greatest(F.lit(1), F.col("n") - f)).alias("selected"))


def multi_krum_mean(updates: DataFrame, f: int, by: list[str] | None = None, strict: bool = False) -> DataFrame:
    """(by..., dim, value): the mean of the members that Multi-Krum selects."""
    by = by or []
    return fedavg(updates.join(multi_krum(updates, f, by, strict).where("selected").select(*by, "member"), [*by, "member"], "left_semi"), None, by)


def _bulyan(v: np.ndarray, f: int) -> tuple[np.ndarray, np.ndarray]:
    """Which members are selected, and the aggregate, of a cohort's vectors in the members' order."""
    n = len(v)
    d2 = np.stack([np.square(v - one).sum(1) for one in v])  # n x n, a row at a time

    def krum(pool: np.ndarray) -> np.ndarray:
        near = np.sort(d2[np.ix_(pool, pool)], axis=1)[:, 1:]  # without the member itself
        return near[:, : max(1, len(pool) - f - 2)].sum(1)

    if n < 4 * f + 3:
        chosen = np.sort(np.argsort(krum(np.arange(n)), kind="stable")[: max(1, n - f)])
        return chosen, v[chosen].mean(0)
    pool, chosen = np.arange(n), []
    while len(chosen) < n - 2 * f:
        best = int(np.argmin(krum(pool)))
        chosen.append(pool[best])
        pool = np.delete(pool, best)
    picked = v[np.sort(chosen)]
    order = np.argsort(np.abs(picked - np.median(picked, axis=0)), axis=0, kind="stable")[: max(1, len(picked) - 2 * f)]
    return np.sort(chosen), np.take_along_axis(picked, order, axis=0).mean(0)


def bulyan(updates: DataFrame, f: int, by: list[str]) -> DataFrame:
    """(by..., selected array<bigint>, value array<double>): members taken one by one by Krum until n - 2f are, then of
    each component the mean of those nearest the median; Multi-Krum for fewer than 4f + 3 members.

    A cohort has at most ``MAX_PAIRWISE`` members (checked), so it fits a task.
    """
    n = updates.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if n > MAX_PAIRWISE:
        raise ValueError(f"{n} members; pairwise aggregation takes at most {MAX_PAIRWISE} in a cohort")
    ship_package(updates.sparkSession)

    def cohort(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("member", kind="stable")
        chosen, value = _bulyan(np.stack(frame["v"].to_list()), f)
        return pd.DataFrame({**{c: [frame[c].iloc[0]] for c in by}, "selected": [frame["member"].to_numpy()[chosen].tolist()], "value": [value.tolist()]})

    keys = ", ".join(f"`{c}` {updates.schema[c].dataType.simpleString()}" for c in by)
    return updates.select(*by, "member", "v").groupBy(*by).applyInPandas(cohort, f"{keys}, selected array<bigint>, value array<double>")


def robust_aggregate(updates: DataFrame, method: str, f: int, by: list[str], max_norm: float | None = None) -> tuple[DataFrame, DataFrame]:
    """((by..., dim, value), (by..., member, selected)): one entry for every aggregator, vectors clipped first on demand.

    The trimmed mean's members count as rejected when they were trimmed on more than half of the components; the median
    rejects nobody. Without enough members Bulyan is Multi-Krum.
    """
    if method not in METHODS:
        raise ValueError(f"the method must be one of {METHODS}")
    if max_norm is not None:
        updates = updates.withColumn("v", clip_norm(F.col("v"), max_norm))
    if method == "krum":
        return multi_krum_mean(updates, f, by), multi_krum(updates, f, by).select(*by, "member", "selected")
    if method == "trimmed_mean":
        return trimmed_mean(updates, f, by), trim_membership(updates, f, by).select(*by, "member", (~F.col("suspicious")).alias("selected"))
    if method == "median":
        return coordinate_median(updates, by), updates.select(*by, "member", F.lit(True).alias("selected"))
    made = bulyan(updates, f, by)
    rows = updates.select(*by, "member").join(made.select(*by, F.explode("selected").alias("member"), F.lit(True).alias("_in")), [*by, "member"], "left")
    return made.select(*by, F.posexplode("value").alias("dim", "value")), rows.select(*by, "member", F.coalesce("_in", F.lit(False)).alias("selected"))


def conditional_aggregate(updates: DataFrame, by: list[str], attacked: bool) -> DataFrame:
    """The plain mean, or Multi-Krum against one attacker while an attack is on."""
    return multi_krum_mean(updates, 1, by) if attacked else fedavg(updates, None, by)


def outlier_gate(updates: DataFrame, f: int, factor: float = 10.0, by: list[str] | None = None, strict: bool = False) -> DataFrame:
    """(by..., member, krum, rejected): a member that Krum would drop is rejected if it is far above the rest's median.

    Cohorts of fewer than f + 3 members accuse nobody; ``strict``: they are left out.
    """
    by = by or []
    chosen = multi_krum(updates, f, by, strict)
    others = chosen.select(*by, F.col("member").alias("_other"), F.col("krum").alias("_krum"))
    rest = (chosen.join(others, by) if by else chosen.join(F.broadcast(others))).where("member <> _other")
    base = rest.groupBy(*by, "member").agg(F.median("_krum").alias("base"), (F.count("*") + 1).alias("n"))
    far = (F.col("n") >= f + 3) & ~F.col("selected") & (F.col("krum") > factor * F.col("base"))
    return chosen.join(base, [*by, "member"], "left").select(*by, "member", "krum", F.coalesce(far, F.lit(False)).alias("rejected"))
