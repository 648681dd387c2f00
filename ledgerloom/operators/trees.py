"""Boosted trees: histograms, quantile edges, the split search and the training loop, as grouped sums."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalar import sigmoid
from ledgerloom.session import written

GRID = 256


def long_form(df: DataFrame, columns: tuple[str, ...], keep: list[str]) -> DataFrame:
    """(keep..., f, x): a row for each feature, by its place."""
    values = F.array(*(F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns)))
    return df.select(*keep, F.explode(values).alias("_v")).select(*keep, "_v.f", "_v.x")


def ranges(rows: DataFrame) -> DataFrame:
    """(f, lo, span): the least value and the range of every feature, 1 where it is flat."""
    return rows.groupBy("f").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).select("f", "lo", F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0).alias("span"))


def grid_histogram(rows: DataFrame, grid: int = GRID) -> DataFrame:
    """(f, cell, n, lo, span): counts on a fixed grid between the least and greatest value."""
    cell = F.least(F.lit(grid - 1), F.floor((F.col("x") - F.col("lo")) / F.col("span") * grid)).cast("int")
    return rows.join(F.broadcast(ranges(rows)), "f").groupBy("f", cell.alias("cell"), "lo", "span").agg(F.count("*").alias("n"))


def quantile_edges(histogram: DataFrame, bins: int, grid: int = GRID) -> DataFrame:
    """(f, edge): centres of the first cell at which the distribution reaches each inner quantile, once each."""
    w = Window.partitionBy("f")
    cdf = F.sum("n").over(w.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(w)
    rows = histogram.withColumn("cdf", cdf)
    wanted = F.explode(F.array(*(F.lit(k / bins) for k in range(1, bins))))
    rows = rows.withColumn("q", wanted).where("cdf >= q").groupBy("f", "q", "lo", "span").agg(F.min("cell").alias("cell"))
    return rows.select("f", (F.col("lo") + (F.col("cell") + 0.5) * F.col("span") / grid).alias("edge")).distinct()


def binned(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds ``bin``, the number of the feature's edges that are at most x."""
    lists = edges.groupBy("f").agg(F.sort_array(F.collect_list("edge")).alias("_edges"))  # bins - 1 values
    joined = rows.join(F.broadcast(lists), "f", "left")
    count = F.size(F.filter(F.coalesce("_edges", F.array().cast("array<double>")), lambda e: e <= F.col("x")))
    return joined.withColumn("bin", count).drop("_edges")


def gradient_histogram(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., f, bin, g, h, n): sums of gradient p - y and of p (1 - p), at least 1e-6 a row."""
    g = F.col("p") - F.col("y")
    h = F.greatest(F.col("p") * (1 - F.col("p")), F.lit(1e-6))
    return rows.groupBy(*by, "f", "bin").agg(F.sum(g).alias("g"), F.sum(h).alias("h"), F.count("*").alias("n"))


def best_split(histogram: DataFrame, by: list[str], lam: float = 1.0, gamma: float = 0.0, min_hess: float = 1.0) -> DataFrame:
    """(by..., f, bin, gain): the split ``x's bin <= bin`` of highest positive gain, ties to the lower (f, bin)."""
    per = Window.partitionBy(*by, "f")
    upto = per.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    rows = histogram.select("*", F.sum("g").over(upto).alias("gl"), F.sum("h").over(upto).alias("hl"), F.sum("g").over(per).alias("gt"), F.sum("h").over(per).alias("ht"))
    gr, hr = F.col("gt") - F.col("gl"), F.col("ht") - F.col("hl")
    part = lambda g, h: g * g / (h + lam)
    gain = 0.5 * (part(F.col("gl"), F.col("hl")) + part(gr, hr) - part(F.col("gt"), F.col("ht"))) - gamma
    rows = rows.withColumn("gain", F.round(gain, 6)).where((F.col("hl") >= min_hess) & (hr >= min_hess) & (F.col("gain") > 0))
    first = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("gain"), "f", "bin")
    return rows.withColumn("_r", F.row_number().over(first)).where("_r = 1").select(*by, "f", "bin", "gain")


def coarsen(histogram: DataFrame, display: int = 16, grid: int = GRID) -> DataFrame:
    """The grid's cells added up to ``display`` bins."""
    return histogram.groupBy("f", F.floor(F.col("cell") * display / grid).cast("int").alias("bin")).agg(F.sum("n").alias("n"))


def leaf_value(g: float, h: float, lam: float, lr: float) -> float:
    return -lr * g / (h + lam)


def column_histogram(rows: DataFrame, columns: tuple[str, ...], grid: int = GRID) -> DataFrame:
    """What ``grid_histogram`` gives for ``long_form``: ranges without repeating a row, and one number for a feature's cell."""
    x = [F.col(c).cast("double") for c in columns]
    ends = rows.agg(*(F.min(v) for v in x), *(F.when(F.max(v) > F.min(v), F.max(v) - F.min(v)).otherwise(1.0) for v in x)).first()
    lo, span = ([F.lit(v).cast("double") for v in part] for part in (ends[: len(x)], ends[len(x) :]))
    cells = (F.least(F.lit(grid - 1), F.floor((v - a) / b * grid)).cast("int") + i * grid for i, (v, a, b) in enumerate(zip(x, lo, span, strict=True)))
    counts = rows.select(F.explode(F.array(*cells)).alias("_c")).groupBy("_c").agg(F.count("*").alias("n"))
    f = F.floor(F.col("_c") / grid).cast("int")
    return counts.select(f.alias("f"), (F.col("_c") - f * grid).alias("cell"), F.get(F.array(*lo), f).alias("lo"), F.get(F.array(*span), f).alias("span"), "n")


def edge_lists(rows: DataFrame, columns: tuple[str, ...], bins: int) -> list[list[float]]:
    """The sorted quantile edges of each feature; a feature has fewer than ``bins``, and none where it has no value."""
    found = quantile_edges(column_histogram(rows, columns), bins).where("edge is not null").collect()
    return [sorted(r["edge"] for r in found if r["f"] == i) for i in range(len(columns))]


def bin_vector(columns: tuple[str, ...], edges: list[list[float]]) -> Column:
    """Bins of all features in one array: for each the number of its edges at or under the value."""
    one = lambda c, own: F.size(F.filter(F.array(*(F.lit(e) for e in own)), lambda e: e <= F.col(c))) if own else F.lit(0)
    return F.array(*(one(c, own) for c, own in zip(columns, edges, strict=True)))


def layout(edges: list[list[float]]) -> tuple[int, int, int]:
    """(bits of a bin, features summed together, features in a word): a word holds whole groups, a group a byte or one bin."""
    bits = max(1, max(map(len, edges)).bit_length())
    group = max(1, 8 // bits)
    return bits, group, 63 // (bits * group) * group


def packed(rows: DataFrame, columns: tuple[str, ...], edges: list[list[float]], keep: list[Column | str]) -> DataFrame:
    """(keep..., w0, w1, ...): the bins of ``bin_vector``, many in a 64-bit word."""
    bits, _, per = layout(edges)
    out = rows.select(*keep, bin_vector(columns, edges).alias("_bins"))
    words = {}
    for first in range(0, len(columns), per):
        word = F.lit(0).cast("long")
        for f in range(first, min(first + per, len(columns))):
            word = word.bitwiseOR(F.shiftleft(F.get("_bins", F.lit(f)).cast("long"), bits * (f - first)))
        words[f"w{first // per}"] = word
    return out.withColumns(words).drop("_bins")


def in_array(f: int) -> Column:
    """A feature's bin in the array ``bins``."""
    return F.get("bins", F.lit(f))


def in_words(edges: list[list[float]]) -> Callable[[int], Column]:
    """A feature's bin in the words of ``packed``."""
    bits, _, per = layout(edges)
    return lambda f: F.shiftright(f"w{f // per}", bits * (f % per)).bitwiseAND(F.lit((1 << bits) - 1))


def descend(tree: dict, at: str = "", leaf=None, bin_of: Callable[[int], Column] = in_array) -> Column:
    """What a row's bins lead to: the value of its leaf, or what ``leaf`` makes of the leaf's path."""
    node = tree.get(at)
    if node is None or node[0] == "leaf":
        return leaf(at) if leaf else F.lit(node[1])
    _, f, k = node
    return F.when(bin_of(f) <= k, descend(tree, at + "L", leaf, bin_of)).otherwise(descend(tree, at + "R", leaf, bin_of))


def level_histogram(placed: DataFrame, edges: list[list[float]]) -> DataFrame:
    """(node, f, bin, g, h): sums of the rows (node, g, h, w0, w1, ...).

    A row is added to one sum for each group of features, by all their bins at once; the sums of one feature are then sums
    of those few.
    """
    bits, group, per = layout(edges)
    wide = bits * group
    codes = (F.shiftright(f"w{f // per}", bits * (f % per)).bitwiseAND(F.lit((1 << wide) - 1)).bitwiseOR(F.lit(f // group << wide)).cast("int") for f in range(0, len(edges), group))
    sums = [F.sum("g").alias("g"), F.sum("h").alias("h")]
    groups = placed.select("node", "g", "h", F.explode(F.array(*codes)).alias("code")).groupBy("node", "code").agg(*sums)
    one = lambda j: F.struct((F.shiftright("code", wide) * group + j).alias("f"), F.shiftright("code", bits * j).bitwiseAND(F.lit((1 << bits) - 1)).alias("bin"))
    each = groups.select("node", "g", "h", F.explode(F.array(*(one(j) for j in range(group)))).alias("_v")).select("node", "g", "h", "_v.f", "_v.bin")
    return each.where(F.col("f") < len(edges)).groupBy("node", "f", "bin").agg(*sums)


def fit(rows: DataFrame, columns: tuple[str, ...], label: str = "y", n_trees: int = 20, max_depth: int = 3, bins: int = 16, lr: float = 0.3, lam: float = 1.0, gamma: float = 0.0, min_hess: float = 1.0) -> dict:
    """Boosted trees of logistic loss: {base, edges, trees}, a tree being {path of L and R: split or leaf}."""
    edges = edge_lists(rows, columns, bins)
    own = written(packed(rows, columns, edges, [F.col(label).cast("double").alias("y")]), "binned")
    return boost(own, edges, n_trees, max_depth, lr, lam, gamma, min_hess)


def boost(rows: DataFrame, edges: list[list[float]], n_trees: int = 20, max_depth: int = 3, lr: float = 0.3, lam: float = 1.0, gamma: float = 0.0, min_hess: float = 1.0) -> dict:
    """The model of ``fit`` from rows (y, w0, w1, ...) that are ``packed`` and written already.

    Each level of a tree is one grouped sum over all rows; the driver sees a split for each node and never a row. A
    row's node is an expression of its bins, so rows are written once.
    """
    n, pos = rows.agg(F.count("*"), F.sum("y")).first()
    rate = min(max((pos or 0) / max(n, 1), 1e-6), 1 - 1e-6)
    model: dict = {"base": math.log(rate / (1 - rate)), "edges": edges, "trees": []}
    bin_of = in_words(edges)
    for _ in range(n_trees if n else 0):
        p = rows.withColumn("p", probability(model, bin_of))
        p = p.withColumns({"g": F.col("p") - F.col("y"), "h": F.greatest(F.col("p") * (1 - F.col("p")), F.lit(1e-6))})
        tree: dict = {}
        level = [""]
        for depth in range(max_depth + 1):
            number = {path: i for i, path in enumerate(level)}
            placed = p.withColumn("node", descend(tree, "", lambda at: F.lit(number.get(at, -1)), bin_of)).where("node >= 0")  # noqa: B023
            if depth < max_depth:
                histogram = level_histogram(placed, edges)
                total = histogram.where("f = 0").groupBy("node").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
                found = total.join(best_split(histogram, ["node"], lam, gamma, min_hess), "node", "left")
            else:
                found = placed.groupBy("node").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.lit(None).alias("f"))
            for r in found.collect():
                split = r["f"] is not None and r["h"] >= 2 * min_hess
                tree[level[r["node"]]] = ("split", r["f"], r["bin"]) if split else ("leaf", leaf_value(r["g"] or 0.0, r["h"], lam, lr))
            level = [path + side for path in level if tree[path][0] == "split" for side in "LR"]
            if not level:
                break
        model["trees"].append(tree)
    return model


def logit(model: dict, bin_of: Callable[[int], Column] = in_array) -> Column:
    """The ensemble's log-odds of rows with ``bins``, or with what ``bin_of`` reads."""
    out = F.lit(model["base"])
    for tree in model["trees"]:
        out = out + descend(tree, bin_of=bin_of)
    return out


def probability(model: dict, bin_of: Callable[[int], Column] = in_array) -> Column:
    return sigmoid(logit(model, bin_of))


def to_json(model: dict) -> str:
    return json.dumps(model, sort_keys=True)


def from_json(text: str) -> dict:
    model = json.loads(text)
    return model | {"trees": [{path: tuple(node) for path, node in tree.items()} for tree in model["trees"]]}


def flatten(spark: SparkSession, model: dict) -> DataFrame:
    """(tree, node, parent, side, f, bin, value): a row for each node, its path as its name."""
    rows = [
        (t, path, path[:-1] if path else None, path[-1:] or None, node[1] if node[0] == "split" else None, node[2] if node[0] == "split" else None, node[1] if node[0] == "leaf" else None)
        for t, tree in enumerate(model["trees"]) for path, node in tree.items()
    ]
    return spark.createDataFrame(rows, "tree int, node string, parent string, side string, f int, bin int, value double")
