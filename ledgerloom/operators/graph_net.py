"""Graph networks trained by federated rounds: layers of neighbour means and rectified units, and a logistic read-out.

A bank sees its own accounts, the accounts they pay or are paid by, and the payments between the two; features of other
banks' accounts are hidden from it as 0, and only its own accounts count in the loss. Views are one table of links
(bank, a, b) and one of members (bank, id, ...), partitioned by account, so a bank's graph is never in one task.

A mean over a node and its neighbours is a join of links with the nodes' vectors and a grouped sum. The first layer's
means do not depend on weights: they are computed once, before training, and written. Further layers join again in
every step, forwards with their inputs and backwards, transposed, with what flows back; as links hold both directions
the transposed mean is the same sum of vectors that were divided first. Gradients are summed where the rows are, one
array a bank, so the driver holds banks times parameters.

Defined results: accounts without payments are means of themselves; payments from or to unknown accounts, and rows with
a null end, and accounts without id or bank, are in no view; null labels count as 0; null features as 0; banks without positives weigh all rows alike;
an empty graph leaves the weights as they began. Hubs are keys of joins, which the skew join splits, and of sums, which
are combined before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import graph
from ledgerloom.session import map_arrow, written


@dataclass(frozen=True)
class GraphNet:
    """``depth`` layers of ``hidden`` units over ``dim`` features; weights are one flat vector."""

    dim: int
    hidden: int = 8
    depth: int = 1
    seed: int = 0

    def _widths(self) -> list[tuple[int, int]]:
        return [(self.dim, self.hidden)] + [(self.hidden, self.hidden)] * (self.depth - 1) + [(self.hidden, 1)]

    def start(self) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        return np.concatenate([np.append(rng.normal(0, np.sqrt(2 / (a + b)), a * b), np.zeros(b)) for a, b in self._widths()])

    def parts(self, w: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(matrix, bias) of each layer, the read-out last."""
        out, at = [], 0
        for a, b in self._widths():
            out.append((w[at : at + a * b].reshape(a, b), w[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def units(self, w: np.ndarray, layer: int, mean: np.ndarray) -> np.ndarray:
        """Outputs of a layer over neighbour means."""
        m, b = self.parts(w)[layer]
        return np.maximum(mean @ m + b, 0)

    def score(self, w: np.ndarray, mean: np.ndarray) -> np.ndarray:
        """Probabilities from the last layer's neighbour means."""
        m, b = self.parts(w)[-1]
        return 1 / (1 + np.exp(-np.clip((self.units(w, self.depth - 1, mean) @ m + b)[:, 0], -30, 30)))

    def out_gradient(self, w: np.ndarray, mean: np.ndarray, y: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(gradient of the read-out, what flows back into the last layer's units)."""
        e = (s * (self.score(w, mean) - y))[:, None]
        return np.append(self.units(w, self.depth - 1, mean).T @ e, e.sum()), e @ self.parts(w)[-1][0].T

    def layer_gradient(self, w: np.ndarray, layer: int, mean: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(gradient of a layer, what flows back into its means)."""
        m, b = self.parts(w)[layer]
        inner = back * (mean @ m + b > 0)
        return np.concatenate([(mean.T @ inner).ravel(), inner.sum(axis=0)]), inner @ m.T


@dataclass(frozen=True)
class Views:
    """Every bank's view: ``links`` (bank, a, b) and ``members`` (bank, id, owned, y, train_y, weight, mean).

    Without ``boundary`` both leave out other banks' accounts, whose means a network of one layer never reads.
    """

    links: DataFrame
    members: DataFrame
    dim: int
    boundary: bool = True


def _vector(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def neighbour_sums(links: DataFrame, rows: DataFrame, vector: str, dim: int) -> DataFrame:
    """(bank, id, vector): of every row of (bank, id, vector) its own vector and its neighbours' added."""
    names = [f"_{k}" for k in range(dim)]
    flat = rows.select("bank", "id", *(F.col(vector)[k].alias(n) for k, n in enumerate(names)))
    sent = links.join(flat.withColumnRenamed("id", "b"), ["bank", "b"]).select("bank", F.col("a").alias("id"), *names)
    sums = flat.union(sent).groupBy("bank", "id").agg(*(F.sum(n).alias(n) for n in names))
    return sums.select("bank", "id", F.array(*names).alias(vector))


def views(nodes: DataFrame, edges: DataFrame, columns: list[str], labelled: str = "true", boundary: bool = True, banked: DataFrame | None = None) -> Views:
    """Views of all banks over ``nodes`` (id, bank, y, columns...) and ``edges`` (src, dst).

    Banks for which ``labelled`` does not hold train with all labels 0. The first layer's means are written here.
    ``banked`` is ``with_banks(nodes, edges)`` where it is there already.
    """
    nodes = nodes.withColumn("bank", F.col("bank").cast("bigint")).where("id is not null and bank is not null")
    own = nodes.select("id", F.col("bank").alias("home"), F.coalesce(F.col("y").cast("double"), F.lit(0.0)).alias("y"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns))
    if boundary:
        links = written(graph.local_edges(nodes, edges), "links")
        known = links.select("bank", F.col("a").alias("id")).union(nodes.select("bank", "id")).distinct().join(own, "id")
        degree = links.groupBy("bank", F.col("a").alias("id")).agg(F.count("*").alias("d"))
    else:
        banked = (graph.with_banks(nodes, edges) if banked is None else banked).where("src_bank is not null and dst_bank is not null")
        a, b = F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
        near = banked.where("src_bank = dst_bank").select(F.col("src_bank").cast("bigint").alias("bank"), a, b).distinct()
        links = written(near.union(near.where("a <> b").select("bank", F.col("b"), F.col("a"))), "links")
        known = own.withColumn("bank", F.col("home"))
        degree = banked.select(a, b).distinct().select(F.explode(F.array_distinct(F.array("a", "b"))).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    owned = F.col("bank") == F.col("home")
    x = F.array(*(F.when(owned, F.col(c)).otherwise(0.0) for c in columns))
    label = F.when(F.expr(labelled), F.col("y")).otherwise(0.0)
    rows = written(known.select("bank", "id", owned.alias("owned"), "y", label.alias("train_y"), x.alias("x")), "members")
    weight = (F.coalesce("d", F.lit(0)) + 1).cast("double")
    # hidden features are 0, so only a bank's own accounts send theirs
    sums = neighbour_sums(links, rows.where("owned"), "x", len(columns)).withColumnRenamed("x", "sums")
    members = rows.join(degree, ["bank", "id"] if boundary else "id", "left").join(sums, ["bank", "id"], "left").withColumn("weight", weight)
    mean = F.transform(F.coalesce("sums", F.array_repeat(F.lit(0.0), len(columns))), lambda v: v / F.col("weight"))
    return Views(links, written(members.select("bank", "id", "owned", "y", "train_y", "weight", mean.alias("mean")), "views"), len(columns), boundary)


def _mapped(rows: DataFrame, columns: list[str], schema: str, work, weights: dict) -> DataFrame:
    """``work(bank's weights, arrays of columns after bank and id)`` gives (bank, id, array) for the rows of each bank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bank = batch.column(0).to_numpy()
            for b in np.unique(bank).tolist():
                own = batch.filter(pa.array(bank == b))
                made = work(weights[b], own)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(list(made), pa.list_(pa.float64()))], names=["bank", "id", "v"])

    return map_arrow(rows.select("bank", "id", *columns), run, schema)


def _gradient_sums(rows: DataFrame, columns: list[str], work, weights: dict) -> dict:
    """Sums of ``work(weights, batch of one bank)`` for each bank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            bank = batch.column(0).to_numpy()
            for b in np.unique(bank).tolist():
                total[b] = total.get(b, 0) + work(b, weights[b], batch.filter(pa.array(bank == b)))
        if total:
            yield pa.RecordBatch.from_pydict({"bank": pa.array(list(total), pa.int64()), "g": [g.tolist() for g in total.values()]})

    parts = map_arrow(rows.select("bank", *columns), run, "bank bigint, g array<double>")
    sums = parts.select("bank", F.posexplode("g").alias("at", "g")).groupBy("bank", "at").agg(F.sum("g").alias("g")).collect()  # banks times parameters
    size = 1 + max((r["at"] for r in sums), default=-1)
    out: dict = {}
    for r in sums:
        out.setdefault(r["bank"], np.zeros(size))[r["at"]] = r["g"]
    return out


def _layers(view: Views, net: GraphNet, weights: dict) -> list[DataFrame]:
    """Members with the means that enter each layer; beyond the first they are joined and written for these weights."""
    if net.depth > 1 and not view.boundary:
        raise ValueError("layers beyond the first read boundary accounts")
    rows = [view.members]
    kind = f"bank bigint, id {view.members.schema['id'].dataType.simpleString()}, v array<double>"
    for layer in range(net.depth - 1):
        units = _mapped(rows[-1], ["mean"], kind, lambda w, own, at=layer: net.units(w, at, _vector(own.column(2))), weights)
        sums = neighbour_sums(view.links, units, "v", net.hidden)
        joined = view.members.drop("mean").join(sums, ["bank", "id"])
        rows.append(written(joined.withColumn("mean", F.transform("v", lambda x: x / F.col("weight"))).drop("v"), "layer"))
    return rows


def returned(links: DataFrame, rows: DataFrame, means: DataFrame, dim: int) -> DataFrame:
    """(bank, id, mean, v): what the rows send to every member, own share included, beside the member's means."""
    names = [f"_{k}" for k in range(dim)]
    flat = rows.select("bank", "id", *(F.col("v")[k].alias(n) for k, n in enumerate(names)))
    sent = links.join(flat.withColumnRenamed("id", "a"), ["bank", "a"]).select("bank", F.col("b").alias("id"), *names)
    sums = flat.union(sent).groupBy("bank", "id").agg(*(F.sum(n).alias(n) for n in names)).select("bank", "id", F.array(*names).alias("v"))
    return written(means.select("bank", "id", "mean").join(sums, ["bank", "id"]), "flow")


def gradients(view: Views, net: GraphNet, weights: dict, positive: dict, means: list[DataFrame] | None = None) -> dict:
    """The gradient of each bank's loss, summed over its own accounts, at the bank's weights."""
    means = _layers(view, net, weights) if means is None else means
    kind = f"bank bigint, id {view.members.schema['id'].dataType.simpleString()}, v array<double>"

    def out(b, w, own):
        """Read-out and last layer at once."""
        mean, y = _vector(own.column(1)), own.column(2).to_numpy()
        read, back = net.out_gradient(w, mean, y, np.where(y == 1, positive[b], 1.0))
        return np.concatenate([net.layer_gradient(w, net.depth - 1, mean, back)[0], read])

    last = means[-1].where("owned")
    parts = [_gradient_sums(last, ["mean", "train_y"], out, weights)]
    if net.depth > 1:
        held = {b: (w, positive[b]) for b, w in weights.items()}

        def into(pair, own):
            mean, y, w = _vector(own.column(2)), own.column(3).to_numpy(), pair[0]
            return net.layer_gradient(w, net.depth - 1, mean, net.out_gradient(w, mean, y, np.where(y == 1, pair[1], 1.0))[1])[1]

        back = _mapped(last, ["mean", "train_y"], kind, into, held)
        for layer in range(net.depth - 2, -1, -1):
            weight = view.members.select("bank", "id", "weight")
            shares = back.join(weight, ["bank", "id"]).select("bank", "id", F.transform("v", lambda x: x / F.col("weight")).alias("v"))
            flow = returned(view.links, written(shares, "back"), means[layer], net.hidden)
            parts.insert(0, _gradient_sums(flow, ["mean", "v"], lambda b, w, own, at=layer: net.layer_gradient(w, at, _vector(own.column(1)), _vector(own.column(2)))[0], weights))
            if layer:
                back = _mapped(flow, ["mean", "v"], kind, lambda w, own, at=layer: net.layer_gradient(w, at, _vector(own.column(2)), _vector(own.column(3)))[1], weights)
    return {b: np.concatenate([p.get(b, np.zeros(0)) for p in parts]) if all(b in p for p in parts) else np.zeros(len(w)) for b, w in weights.items()}


def balance(view: Views) -> dict:
    """Of each bank's own accounts: (weight of a positive, sum of all weights)."""
    counts = view.members.where("owned").groupBy("bank").agg(F.count("*").alias("n"), F.sum("train_y").alias("pos")).collect()  # a row for each bank
    return {r["bank"]: ((w := (r["n"] - r["pos"]) / max(1, r["pos"]) if r["pos"] else 1.0), max(1e-8, r["n"] - r["pos"] + w * r["pos"])) for r in counts}


def train(view: Views, net: GraphNet, weights: dict, epochs: int, lr: float = 0.15, l2: float = 1e-4) -> dict:
    """Weights of every bank after ``epochs`` full-batch steps on its own view."""
    scale = balance(view)
    weights = {b: w for b, w in weights.items() if b in scale}
    positive = {b: p for b, (p, _) in scale.items()}
    for _ in range(epochs):
        found = gradients(view, net, weights, positive)
        weights = {b: w - lr * (found[b] / scale[b][1] + l2 * w) for b, w in weights.items()}
    return weights


def federated(view: Views, net: GraphNet, rounds: int, epochs: int, lr: float = 0.15, l2: float = 1e-4) -> np.ndarray:
    """Global weights after ``rounds`` of local training and a plain mean of the banks' changes."""
    w = net.start()
    banks = [r["bank"] for r in view.members.where("owned").select("bank").distinct().collect()]  # a row for each bank
    for _ in range(rounds if banks else 0):
        local = train(view, net, dict.fromkeys(banks, w), epochs, lr, l2)
        w = w + np.mean([v - w for v in local.values()], axis=0)
    return w


def siloed(view: Views, net: GraphNet, epochs: int, lr: float = 0.15, l2: float = 1e-4) -> dict:
    """Weights of every bank trained alone."""
    banks = [r["bank"] for r in view.members.where("owned").select("bank").distinct().collect()]  # a row for each bank
    return train(view, net, dict.fromkeys(banks, net.start()), epochs, lr, l2)


def scores(view: Views, net: GraphNet, weights: dict) -> DataFrame:
    """(bank, id, y, score) of every bank's own accounts at the weights given for the bank."""
    last = _layers(view, net, weights)[-1].where("owned")
    kind = f"bank bigint, id {view.members.schema['id'].dataType.simpleString()}, v array<double>"
    found = _mapped(last, ["mean"], kind, lambda w, own: net.score(w, _vector(own.column(2)))[:, None], weights)
    return found.join(last.select("bank", "id", "y"), ["bank", "id"]).select("bank", "id", "y", F.col("v")[0].alias("score"))
