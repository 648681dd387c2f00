"""Ranking metrics for rare events, computed from score groups instead of a global sort of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import written


#: Ranges of a score between 0 and 1.
CELLS = 1024


def recall(score: Column, y: Column, threshold: float = 0.5) -> Column:
    """Share of positives scored strictly over the threshold; 1 where there are none."""
    return F.coalesce(F.try_divide(F.count_if((score > threshold) & (y == 1)), F.count_if(y == 1)), F.lit(1.0))


def score_groups(df: DataFrame, by: list[str], score: str, y: str, descending: bool) -> DataFrame:
    """(by..., score, n, pos, n_before, pos_before): equal scores as one row, with what comes before them.

    Sums run inside ``CELLS`` ranges of the score and over the ranges, so no task sorts a group's rows. The rows are read
    once: their groups are written before they are ranked.
    """
    cell = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score))) * CELLS)
    groups = written(df.groupBy(*by, score).agg(F.count("*").alias("n"), F.sum(y).alias("pos")), "groups").withColumn("_cell", cell)
    turn = F.desc if descending else F.asc
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = groups.groupBy(*by, "_cell").agg(F.sum("n").alias("_n"), F.sum("pos").alias("_pos"))
    over = Window.partitionBy(*(by or [F.lit(0)])).orderBy(turn("_cell"))  # CELLS + 1 rows a group
    cells = cells.select(*by, "_cell", before("_n", over).alias("_n"), before("_pos", over).alias("_pos"))
    inside = Window.partitionBy(*by, "_cell").orderBy(turn(score))
    rows = groups.withColumns({"_a": before("n", inside), "_b": before("pos", inside)}).join(cells, [*by, "_cell"])
    return rows.select(*by, score, "n", "pos", (F.col("_a") + F.col("_n")).alias("n_before"), (F.col("_b") + F.col("_pos")).alias("pos_before"))


def roc_auc(df: DataFrame, by: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """Mann-Whitney AUC by group with half counts for ties; 0.5 where a class is missing."""
    groups = score_groups(df, by, score, y, False)
    neg = F.col("n") - F.col("pos")
    wins = F.sum(F.col("pos") * (F.col("n_before") - F.col("pos_before") + neg / 2))
    return groups.groupBy(*by).agg(F.coalesce(F.try_divide(wins, F.sum("pos") * F.sum(neg)), F.lit(0.5)).alias("auc"))


def average_precision(df: DataFrame, by: list[str], order: list[Column], score: str = "score", y: str = "y") -> DataFrame:
    """Area under the precision-recall steps, higher scores first and ``order`` among equal ones; 0 without positives.

    Only positives and what they are tied with are ranked one by one.
    """
    groups = score_groups(df, by, score, y, True)
    tie = Window.partitionBy(*by, score).orderBy(*order)
    rows = df.withColumns({"_n": F.row_number().over(tie), "_tp": F.sum(y).over(tie.rowsBetween(Window.unboundedPreceding, 0))}).where(F.col(y) == 1)
    rows = rows.join(groups.where("pos > 0").select(*by, score, "n_before", "pos_before"), [*by, score])
    hits = rows.groupBy(*by).agg(F.sum((F.col("_tp") + F.col("pos_before")) / (F.col("_n") + F.col("n_before"))).alias("_hits"))
    total = groups.groupBy(*by).agg(F.sum("pos").alias("_pos"))
    joined = total.join(hits, by, "left") if by else total.crossJoin(F.broadcast(hits))
    return joined.select(*by, F.coalesce(F.try_divide(F.col("_hits"), F.col("_pos")), F.lit(0.0)).alias("average_precision"))


def recall_at_budget(df: DataFrame, by: list[str], order: list[Column], budget: float, ceil: bool, empty: float, score: str = "score", y: str = "y") -> DataFrame:
    """Share of positives among the first ``budget`` of each group, at least one row; ``empty`` without positives.

    The cut is found on groups of equal scores; only the group it falls into is ranked by ``order``.
    """
    groups = score_groups(df, by, score, y, True)
    size = groups.groupBy(*by).agg(F.sum("n").alias("_n"), F.sum("pos").alias("_pos"))
    k = F.greatest(F.lit(1), (F.ceil(F.col("_n") * budget) if ceil else F.bround(F.col("_n") * budget)).cast("bigint"))
    size = size.withColumn("_k", k)
    placed = groups.join(size, by) if by else groups.crossJoin(F.broadcast(size))  # one row
    whole = placed.groupBy(*by).agg(F.sum(F.when(F.col("n_before") + F.col("n") <= F.col("_k"), F.col("pos")).otherwise(0)).alias("_whole"))
    cut = placed.where("n_before < _k and n_before + n > _k").select(*by, score, (F.col("_k") - F.col("n_before")).alias("_take"))
    tied = df.join(cut, [*by, score]).withColumn("_r", F.row_number().over(Window.partitionBy(*by, score).orderBy(*order))).where("_r <= _take")
    part = tied.groupBy(*by).agg(F.sum(y).alias("_part"))
    out = size.join(whole, by).join(part, by, "left") if by else size.crossJoin(whole).crossJoin(part)  # one row each
    found = F.try_divide(F.col("_whole") + F.coalesce("_part", F.lit(0)), F.col("_pos"))
    return out.select(*by, F.coalesce(found, F.lit(float(empty))).alias("recall_at_budget"), F.col("_k").alias("k"))
