"""Federated training: full-batch gradients summed where the rows are, a step for each bank, an average each round.

Rows are (bank, x array<double>, y). A task adds up the gradients of its rows for every bank and returns one short
array for each, so no bank's rows come together and the driver holds banks times parameters only. Models are flat
weight vectors with a forward pass and its gradient; positives count negatives over positives of their bank.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import robust
from ledgerloom.session import map_arrow


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass(frozen=True)
class Logistic:
    """A weight for each feature and a bias."""

    dim: int

    def start(self) -> np.ndarray:
        return np.zeros(self.dim + 1)

    def score(self, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        return _sigmoid(x @ w[:-1] + w[-1])

    def gradient(self, w: np.ndarray, x: np.ndarray, y: np.ndarray, s: np.ndarray) -> np.ndarray:
        e = s * (self.score(w, x) - y)
        return np.append(x.T @ e, e.sum())

    def slope(self, w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How each input moves the loss."""
        return np.outer(self.score(w, x) - y, w[:-1])


@dataclass(frozen=True)
class RobustLogistic(Logistic):
    """The logistic model trained against the worst shift of every input by up to ``epsilon``, which is known in closed
    form: it moves the logit by ``epsilon`` times the weights' absolute sum against the label."""

    epsilon: float = 0.1

    def gradient(self, w: np.ndarray, x: np.ndarray, y: np.ndarray, s: np.ndarray) -> np.ndarray:
        side = 2 * y - 1
        worst = x @ w[:-1] + w[-1] - self.epsilon * np.abs(w[:-1]).sum() * side
        e = s * (_sigmoid(worst) - y)
        return np.append((x - self.epsilon * side[:, None] * np.sign(w[:-1])).T @ e, e.sum())


@dataclass(frozen=True)
class Perceptron:
    """Layers of rectified units and a logistic read-out."""

    dims: tuple[int, ...]  # inputs, hidden sizes
    seed: int = 0

    def _layers(self, w: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in zip(self.dims, [*self.dims[1:], 1], strict=True):
            out.append((w[at : at + a * b].reshape(a, b), w[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def start(self) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        return np.concatenate([np.append(rng.normal(0, np.sqrt(2 / a), a * b), np.zeros(b)) for a, b in zip(self.dims, [*self.dims[1:], 1], strict=True)])

    def _forward(self, w: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        values = [x]
        layers = self._layers(w)
        for k, (m, b) in enumerate(layers):
            z = values[-1] @ m + b
            values.append(np.maximum(z, 0) if k < len(layers) - 1 else z)
        return values

    def score(self, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self._forward(w, x)[-1][:, 0])

    def back(self, w: np.ndarray, x: np.ndarray, y: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The gradient, and that of each input."""
        values = self._forward(w, x)
        delta = (s * (_sigmoid(values[-1][:, 0]) - y))[:, None]
        parts: list[np.ndarray] = []
        for k, (m, _) in reversed(list(enumerate(self._layers(w)))):
            parts = [(values[k].T @ delta).ravel(), delta.sum(0), *parts]
            delta = delta @ m.T * ((values[k] > 0) if k else 1)
        return np.concatenate(parts), delta

    def gradient(self, w: np.ndarray, x: np.ndarray, y: np.ndarray, s: np.ndarray) -> np.ndarray:
        return self.back(w, x, y, s)[0]

    def slope(self, w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self.back(w, x, y, np.ones(len(y)))[1]


@dataclass(frozen=True)
class Embedded:
    """Leading inputs are category numbers, looked up in tables; a perceptron reads those and the other inputs."""

    cardinalities: tuple[int, ...]
    width: int
    dense: int
    hidden: int
    seed: int = 0

    def _net(self) -> Perceptron:
        return Perceptron((len(self.cardinalities) * self.width + self.dense, self.hidden), self.seed)

    def start(self) -> np.ndarray:
        tables = np.random.default_rng(self.seed + 1).normal(0, 0.1, sum(self.cardinalities) * self.width)
        return np.concatenate([tables, self._net().start()])

    def _look(self, w: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = sum(self.cardinalities)
        c = len(self.cardinalities)
        # numbers outside a table count as its last
        rows = np.clip(x[:, :c].astype(np.int64), 0, np.array(self.cardinalities) - 1) + np.cumsum([0, *self.cardinalities[:-1]])
        table = w[: size * self.width].reshape(size, self.width)
        return rows, np.hstack([table[rows].reshape(len(x), -1), x[:, c:]]), w[size * self.width :]

    def score(self, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        _, inputs, rest = self._look(w, x)
        return self._net().score(rest, inputs)

    def gradient(self, w: np.ndarray, x: np.ndarray, y: np.ndarray, s: np.ndarray) -> np.ndarray:
        rows, inputs, rest = self._look(w, x)
        net, back = self._net().back(rest, inputs, y, s)
        table = np.zeros((sum(self.cardinalities), self.width))
        np.add.at(table, rows.ravel(), back[:, : rows.shape[1] * self.width].reshape(-1, self.width))
        return np.concatenate([table.ravel(), net])


@dataclass(frozen=True)
class Recurrent:
    """A gated recurrent unit over ``steps`` rows of ``feats`` values and a logistic read-out of its last state."""

    feats: int
    steps: int
    hidden: int
    seed: int = 0

    def _shapes(self) -> list[tuple[int, ...]]:
        return [*[(self.feats + self.hidden + 1, self.hidden)] * 3, (self.hidden + 1,)]

    def start(self) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        return np.concatenate([rng.normal(0, 1 / np.sqrt(s[0]), int(np.prod(s))) for s in self._shapes()])

    def _parts(self, w: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([0, *(int(np.prod(s)) for s in self._shapes())])
        return [w[a:b].reshape(s) for a, b, s in zip(ends, ends[1:], self._shapes(), strict=False)]

    def _forward(self, w: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list]:
        zw, rw, cw, _ = self._parts(w)
        h, one, tape = np.zeros((len(x), self.hidden)), np.ones((len(x), 1)), []
        for step in x.reshape(len(x), self.steps, self.feats).transpose(1, 0, 2):
            wide = np.hstack([step, h, one])
            z, r = _sigmoid(wide @ zw), _sigmoid(wide @ rw)
            inner = np.hstack([step, r * h, one])
            c = np.tanh(inner @ cw)
            tape.append((wide, inner, h, z, r, c))
            h = (1 - z) * h + z * c
        return h, tape

    def score(self, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = self._parts(w)[3]
        return _sigmoid(self._forward(w, x)[0] @ out[:-1] + out[-1])

    def running_scores(self, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        """(n, steps) scores after every prefix."""
        out = self._parts(w)[3]
        last, tape = self._forward(w, x)
        states = [t[2] for t in tape[1:]] + [last]
        return np.stack([_sigmoid(h @ out[:-1] + out[-1]) for h in states], axis=1)

    def gradient(self, w: np.ndarray, x: np.ndarray, y: np.ndarray, s: np.ndarray) -> np.ndarray:
        zw, rw, cw, out = self._parts(w)
        last, tape = self._forward(w, x)
        e = s * (_sigmoid(last @ out[:-1] + out[-1]) - y)
        gz, gr, gc = np.zeros_like(zw), np.zeros_like(rw), np.zeros_like(cw)
        dh = e[:, None] * out[:-1]
        mid = slice(self.feats, self.feats + self.hidden)
        for wide, inner, h, z, r, c in reversed(tape):
            dz = dh * (c - h) * z * (1 - z)
            dc = dh * z * (1 - c * c)
            back = dc @ cw.T[:, mid]
            dr = back * h * r * (1 - r)
            gz, gr, gc = gz + wide.T @ dz, gr + wide.T @ dr, gc + inner.T @ dc
            dh = dh * (1 - z) + back * r + dz @ zw.T[:, mid] + dr @ rw.T[:, mid]
        return np.concatenate([gz.ravel(), gr.ravel(), gc.ravel(), last.T @ e, [e.sum()]])


@dataclass(frozen=True)
class Hardened:
    """A model trained on its rows and on what an attacker makes of them at its weights, ``mix`` of the latter."""

    model: Logistic | Perceptron
    epsilon: float = 0.1
    steps: int = 10
    mix: float = 0.5

    def start(self) -> np.ndarray:
        return self.model.start()

    def score(self, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.model.score(w, x)

    def gradient(self, w: np.ndarray, x: np.ndarray, y: np.ndarray, s: np.ndarray) -> np.ndarray:
        attacked = descend_up(self.model, w, x, y, self.epsilon, self.steps)
        return (1 - self.mix) * self.model.gradient(w, x, y, s) + self.mix * self.model.gradient(w, attacked, y, s)


@dataclass(frozen=True)
class Packed:
    """A logistic, a perceptron and an embedding model and a logistic one over their scores, in one weight vector.

    A row's inputs are the features, the categories, and 1 where the row is for the last model, which then learns from
    rows that no other has seen. One pass gives the gradients of all four; each is the sum over its own rows.
    """

    dense: int
    cardinalities: tuple[int, ...]
    hidden: tuple[int, ...] = (12, 6)
    width: int = 4
    looked_up: int = 12
    seed: int = 0

    def models(self) -> list:
        return [Logistic(self.dense), Perceptron((self.dense, *self.hidden), self.seed), Embedded(self.cardinalities, self.width, self.dense, self.looked_up, self.seed), Logistic(3)]

    def blocks(self) -> list[tuple[int, int, int]]:
        return robust.block_layout([len(m.start()) for m in self.models()])

    def start(self) -> np.ndarray:
        return np.concatenate([m.start() for m in self.models()])

    def _views(self, x: np.ndarray) -> list[np.ndarray]:
        dense, categories = x[:, : self.dense], x[:, self.dense : self.dense + len(self.cardinalities)]
        return [dense, dense, np.hstack([categories, dense])]

    def base_scores(self, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        own = [w[a:b] for _, a, b in self.blocks()]
        return np.stack([m.score(v, part) for m, v, part in zip(self.models(), own, self._views(x), strict=False)], axis=1)

    def score(self, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        _, a, b = self.blocks()[-1]
        return self.models()[-1].score(w[a:b], self.base_scores(w, x))

    def gradient(self, w: np.ndarray, x: np.ndarray, y: np.ndarray, s: np.ndarray) -> np.ndarray:
        late = x[:, -1] == 1
        own = [w[a:b] for _, a, b in self.blocks()]
        out = [m.gradient(v, part[~late], y[~late], s[~late]) for m, v, part in zip(self.models(), own, self._views(x), strict=False)]
        return np.concatenate([*out, self.models()[-1].gradient(own[-1], self.base_scores(w, x[late]), y[late], s[late])])


def private_update(model: Packed, change: np.ndarray, budgets: list[float], sigma: float, rng: np.random.Generator | None = None) -> np.ndarray:
    """A change with each block clipped to its own budget, and noise of ``sigma`` times what all budgets come to."""
    out = change.copy()
    for (_, a, b), budget in zip(model.blocks(), budgets, strict=True):
        out[a:b] *= min(1.0, budget / max(float(np.linalg.norm(out[a:b])), 1e-300))
    return out + (rng or np.random.default_rng()).normal(0, 1, len(out)) * sigma * robust.noise_sensitivity(budgets)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _trainable(rows: DataFrame) -> DataFrame:
    """Rows with a bank, a label and inputs that are all finite; others train and count nowhere."""
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(F.col("bank").isNotNull() & F.col("y").isNotNull() & F.coalesce((F.size("x") > 0) & finite, F.lit(False)))


def gradients(rows: DataFrame, model, weights: dict, positive: dict) -> dict:
    """The gradient of each bank's rows at the bank's weights; inputs are of one length, rows not all finite are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            bank, x, y = batch.column(0).to_numpy(), _matrix(batch.column(1)), batch.column(2).to_numpy().astype(float)
            finite = np.isfinite(x).all(axis=1)  # a null is no number either
            if not finite.all():
                bank, x, y = bank[finite], x[finite], y[finite]
            for b in np.unique(bank).tolist():
                own = bank == b
                total[b] = total.get(b, 0) + model.gradient(weights[b], x[own], y[own], np.where(y[own] == 1, positive[b], 1.0))
        if total:
            yield pa.RecordBatch.from_pydict({"bank": pa.array(list(total), pa.int64()), "g": [g.tolist() for g in total.values()]})

    parts = map_arrow(rows.select(F.col("bank").cast("bigint").alias("bank"), "x", "y"), run, "bank bigint, g array<double>")
    sums = parts.select("bank", F.posexplode("g").alias("at", "g")).groupBy("bank", "at").agg(F.sum("g").alias("g"))
    out = {b: np.zeros(len(w)) for b, w in weights.items()}
    for r in sums.collect():  # banks times parameters
        out[r["bank"]][r["at"]] = r["g"]
    return out


def federated(
    rows: DataFrame, model, rounds: int, epochs: int = 1, lr: float = 0.3, l2: float = 1e-4, attackers: int = 0, budgets: list[float] | None = None, sigma: float = 0.0, rng: np.random.Generator | None = None
) -> np.ndarray:
    """Global weights after ``rounds`` of ``epochs`` local steps and an average weighted by rows.

    With ``attackers`` and three banks or more the members that Multi-Krum selects are averaged instead. With
    ``budgets`` (of a packed model) every bank's change is clipped by block and noised before it is averaged.
    Rows without a bank, a label or finite inputs train nothing; so do vectors of another length than most.
    """
    spark = rows.sparkSession
    met = _trainable(rows).groupBy(F.size("x").alias("size"), "bank").agg(F.count("*").alias("n"), F.sum("y").alias("pos")).collect()  # lengths times banks
    if not met:
        return model.start()
    sizes = Counter()
    for r in met:
        sizes[r["size"]] += r["n"]
    size = min(sizes, key=lambda k: (-sizes[k], k))
    counts = {r["bank"]: (r["n"], r["pos"]) for r in met if r["size"] == size}
    # every step reads the rows: what is left of the check is done on whole batches
    rows = rows.where(F.col("bank").isNotNull() & F.col("y").isNotNull() & (F.size("x") == size))
    positive = {b: (n - p) / max(1, p) for b, (n, p) in counts.items()}
    w = model.start()
    for _ in range(rounds):
        local = {b: w.copy() for b in counts}
        for _ in range(epochs):
            found = gradients(rows, model, local, positive)
            local = {b: v - lr * (found[b] / counts[b][0] + l2 * v) for b, v in local.items()}
        if budgets is not None:
            local = {b: w + private_update(model, v - w, budgets, sigma, rng) for b, v in local.items()}
        if attackers and len(local) >= 3:
            sent = spark.createDataFrame([(0, b, v.tolist()) for b, v in local.items()], "round bigint, member bigint, v array<double>")
            kept = {r["member"] for r in robust.multi_krum(sent, attackers, ["round"]).where("selected").collect()}
            w = np.mean([local[b] for b in kept], axis=0)
        elif local:
            w = sum(counts[b][0] * v for b, v in local.items()) / sum(n for n, _ in counts.values())
    return w


def predicted(rows: DataFrame, model, w: np.ndarray) -> DataFrame:
    """``rows`` with the model's ``score``."""
    names = rows.columns
    at = names.index("x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(w, _matrix(batch.column(at))) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*names, "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return map_arrow(rows, run, f"{kinds}, score double")


def descend_up(model, w: np.ndarray, x: np.ndarray, y: np.ndarray, epsilon: float, steps: int = 1) -> np.ndarray:
    """Inputs moved up the loss by signs of its slope, never further than ``epsilon`` from where they were.

    One step is ``epsilon`` long; several are 2.5 ``epsilon`` in all, each followed by the projection.
    """
    now, length = x, epsilon if steps == 1 else 2.5 * epsilon / max(1, steps)
    for _ in range(steps):
        now = np.clip(now + length * np.sign(model.slope(w, now, y)), x - epsilon, x + epsilon)
    return now


def evasion_rate(rows: DataFrame, w: np.ndarray, epsilon: float, threshold: float = 0.5, model=None, steps: int = 1) -> DataFrame:
    """(bank, caught, evaded, rate): positives over the threshold that an attack of ``steps`` takes under it."""
    model = model or Logistic(len(w) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = _matrix(batch.column(1)), batch.column(2).to_numpy().astype(float)
                caught = (y == 1) & (model.score(w, x) > threshold)
                gone = caught & (model.score(w, descend_up(model, w, x, y, epsilon, steps)) <= threshold)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(caught), pa.array(gone)], names=["bank", "caught", "gone"])

    found = map_arrow(_trainable(rows).select(F.col("bank").cast("bigint").alias("bank"), "x", "y"), run, "bank bigint, caught boolean, gone boolean")
    out = found.groupBy("bank").agg(F.count_if("caught").alias("caught"), F.count_if("gone").alias("evaded"))
    return out.withColumn("rate", F.coalesce(F.try_divide("evaded", "caught"), F.lit(0.0)))
