"""Queries of the graph network: account features, federated and siloed rounds, and what they catch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import graph, graph_net, metrics
from ledgerloom.operators.graph import ACCOUNT_FEATURES
from ledgerloom.plans.networks import G
from ledgerloom.session import written

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

ROUNDS, EPOCHS, RATE, DECAY, BUDGET = 2, 2, 0.15, 1e-4, 0.15
NET = graph_net.GraphNet(len(ACCOUNT_FEATURES), 4, 1, 1)
#: Only the banks of the first half hold confirmed labels to train on.
LABELLED = "bank < 13"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


#: Features of every account, raw and standardised, and the label: an overdrawn account.
_AF = (
    G
    + """, ends AS (SELECT src AS id, false AS inw, amount, ts, src_bank <> dst_bank AS cross_bank FROM eb UNION ALL SELECT dst, true, amount, ts, src_bank <> dst_bank FROM eb),
ag AS (SELECT id, count_if(inw)::DOUBLE AS ind, count_if(NOT inw)::DOUBLE AS outd, coalesce(sum(amount) FILTER (inw), 0)::DOUBLE AS ina, coalesce(sum(amount) FILTER (NOT inw), 0)::DOUBLE AS outa,
  count_if(cross_bank) AS crossing, min(ts)::DATE AS first, max(ts)::DATE AS last FROM ends GROUP BY id),
sp AS (SELECT min(ts)::DATE AS began, max(ts)::DATE AS ended FROM edges),
fr AS (SELECT nodes.id, bank, x, (x < 0)::INT::DOUBLE AS y, coalesce(date_diff('day', began, first) / greatest(1, date_diff('day', began, ended)), 0) AS age,
  ln(1 + coalesce(ind, 0) * 30 / (coalesce(date_diff('day', first, last), 0) + 1)) AS in_rate, ln(1 + coalesce(outd, 0) * 30 / (coalesce(date_diff('day', first, last), 0) + 1)) AS out_rate,
  greatest(x, 0) / greatest(1, coalesce(ina + outa, 0)) AS holding, coalesce(ind, 0) AS in_degree, coalesce(outd, 0) AS out_degree,
  coalesce(ina, 0) / greatest(1, coalesce(ind, 0)) AS mean_in, coalesce(outa, 0) / greatest(1, coalesce(outd, 0)) AS mean_out,
  abs(coalesce(ina, 0) - coalesce(outa, 0)) / greatest(1, coalesce(ina + outa, 0)) AS imbalance, coalesce(crossing, 0) / greatest(1, coalesce(ind + outd, 0)) AS cross_ratio
  FROM nodes LEFT JOIN ag ON ag.id = nodes.id, sp),
fs AS (SELECT """
    + ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in ACCOUNT_FEATURES)
    + "\n  FROM fr), fz AS MATERIALIZED (SELECT id, bank, y, "
    + ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in ACCOUNT_FEATURES)
    + " FROM fr, fs)"
)


def _labelled(nodes):
    return nodes.withColumn("y", (F.col("x") < 0).cast("int"))


@query(_AF + "SELECT id, bank, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ACCOUNT_FEATURES) + " FROM fz")
def account_features(spark, sf_dir):
    nodes = _labelled(graph.account_features(*graph.payment_graph(spark, sf_dir)))
    return nodes.select("id", "bank", *((F.round(c, 6) + 0.0).alias(c) for c in ACCOUNT_FEATURES))


def _views(spark, sf_dir):
    """Views whose payments are joined with banks once, for the features and for the links."""
    nodes, edges = graph.payment_graph(spark, sf_dir)
    banked = written(graph.with_banks(nodes, edges), "payments")
    nodes = _labelled(graph.account_features(nodes, edges, banked))
    return graph_net.views(nodes, edges, ACCOUNT_FEATURES, LABELLED, NET.depth > 1, banked)


#: Neighbour means of own accounts with loss weights: positives weigh negatives over positives of their bank.
_MEANS = (
    _AF
    + """, own AS (SELECT bank, id, y, CASE WHEN bank < 13 THEN y ELSE 0 END AS t, """
    + ", ".join(ACCOUNT_FEATURES)
    + """ FROM fz),
lk AS (SELECT l.bank, l.a AS id, l.b FROM le l UNION ALL SELECT bank, id, id FROM fz),
mx AS (SELECT lk.bank, lk.id, """
    + ", ".join(f"coalesce(sum(n.{c}), 0) / count(*) AS a{k}" for k, c in enumerate(ACCOUNT_FEATURES))
    + """ FROM lk LEFT JOIN own n ON n.bank = lk.bank AND n.id = lk.b GROUP BY 1, 2),
cw AS (SELECT bank, count(*) AS n, CASE WHEN sum(t) > 0 THEN (count(*) - sum(t)) / sum(t) ELSE 1 END AS pos FROM own GROUP BY bank),
tr AS MATERIALIZED (SELECT own.bank, own.id, own.y, own.t, CASE WHEN t = 1 THEN pos ELSE 1 END AS s, """
    + ", ".join(f"a{k}" for k in range(NET.dim))
    + " FROM own JOIN mx ON mx.bank = own.bank AND mx.id = own.id JOIN cw ON cw.bank = own.bank),\nsm AS (SELECT bank, sum(s) AS total FROM tr GROUP BY bank)"
)
_SIZE = len(NET.start())
_W = [f"w{i}" for i in range(_SIZE)]


def _forward() -> tuple[list[str], str]:
    """Units and probability over a row with means and weights."""
    d, h = NET.dim, NET.hidden
    units = [" + ".join(f"a{k} * w{k * h + j}" for k in range(d)) + f" + w{d * h + j}" for j in range(h)]
    at = d * h + h
    return [f"greatest(0, {u}) AS h{j}" for j, u in enumerate(units)], "1 / (1 + exp(-greatest(-30, least(30, " + " + ".join(f"h{j} * w{at + j}" for j in range(h)) + f" + w{at + h}))))"


def _step(into: str, start: str) -> str:
    """A step of every bank from the weights of ``start`` (bank, w...)."""
    d, h = NET.dim, NET.hidden
    at = d * h + h
    units, p = _forward()
    grads = [f"sum(CASE WHEN h{j} > 0 THEN e * w{at + j} * a{k} ELSE 0 END)" for k in range(d) for j in range(h)] + [f"sum(CASE WHEN h{j} > 0 THEN e * w{at + j} ELSE 0 END)" for j in range(h)]
    grads += [f"sum(e * h{j})" for j in range(h)] + ["sum(e)"]
    moved = ", ".join(f"any_value({w}) - {RATE} * ({g} / any_value(total) + {DECAY} * any_value({w})) AS {w}" for w, g in zip(_W, grads, strict=True))
    return (
        f", {into}h AS MATERIALIZED (SELECT tr.*, {start}.* EXCLUDE (bank), {', '.join(units)} FROM tr JOIN {start} ON {start}.bank = tr.bank),"
        f" {into}e AS MATERIALIZED (SELECT *, s * (({p}) - t) AS e FROM {into}h), {into} AS MATERIALIZED (SELECT {into}e.bank, {moved} FROM {into}e JOIN sm ON sm.bank = {into}e.bank GROUP BY {into}e.bank)"
    )


def _train_sql(name: str, rounds: int, epochs: int, average: bool = True) -> str:
    """Tables of weights by bank, averaged after every round unless banks train alone; the last one is ``name``."""
    out, held = f", {name}0 AS (SELECT bank, " + ", ".join(f"{v!r}::DOUBLE AS w{i}" for i, v in enumerate(NET.start().tolist())) + " FROM cw)", f"{name}0"
    for r in range(rounds):
        for e in range(epochs):
            out += _step(f"{name}{r}_{e}", held)
            held = f"{name}{r}_{e}"
        if not average:
            continue
        out += f", {name}r{r} AS MATERIALIZED (SELECT cw.bank, m.* FROM cw, (SELECT {', '.join(f'avg({w}) AS {w}' for w in _W)} FROM {held}) m)"
        held = f"{name}r{r}"
    return out + f", {name} AS (SELECT * FROM {held})"


def _scored_sql(name: str) -> str:
    units, p = _forward()
    return f", {name}u AS (SELECT tr.bank, tr.id, tr.y, {name}.* EXCLUDE (bank), {', '.join(units)} FROM tr JOIN {name} ON {name}.bank = tr.bank), {name}s AS (SELECT bank, id, y::BIGINT AS y, round({p}, 6) AS score FROM {name}u)"


@query(_MEANS + _train_sql("fed", ROUNDS, EPOCHS) + " " + " UNION ALL ".join(f"SELECT {i} AS place, round(any_value({w}), 6) + 0.0 AS weight FROM fed" for i, w in enumerate(_W)))
def graph_network_weights(spark, sf_dir):
    """Global weights after two rounds of two steps in every bank."""
    w = graph_net.federated(_views(spark, sf_dir), NET, ROUNDS, EPOCHS, RATE, DECAY)
    return spark.createDataFrame(list(enumerate(w.tolist())), "place int, weight double").select("place", (F.round("weight", 6) + 0.0).alias("weight"))


def _caught_sql(name: str) -> str:
    """Recall at the alert budget and area under the curve by bank."""
    return f""", {name}k AS (SELECT *, row_number() OVER (PARTITION BY bank ORDER BY score DESC, id) AS r, count(*) OVER (PARTITION BY bank) AS n FROM {name}s),
{name}g AS (SELECT bank, score, sum(y) AS pos, count(*) - sum(y) AS neg FROM {name}s GROUP BY 1, 2),
{name}b AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY bank ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM {name}g),
{name}a AS (SELECT bank, coalesce(sum(pos * (below + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0), 0.5) AS auc FROM {name}b GROUP BY 1),
{name}q AS (SELECT {name}k.bank, coalesce(count_if(r <= greatest(1, ceil(n * {BUDGET})) AND y = 1) / nullif(count_if(y = 1), 0), 1) AS recall, any_value(auc) AS auc FROM {name}k JOIN {name}a ON {name}a.bank = {name}k.bank GROUP BY 1)"""


def _caught(view, weights):
    rows = graph_net.scores(view, NET, weights).select("bank", "id", F.col("y").cast("bigint").alias("y"), F.round("score", 6).alias("score"))
    recall = metrics.recall_at_budget(rows, ["bank"], [F.asc("id")], BUDGET, True, 1.0)
    return recall.join(metrics.roc_auc(rows, ["bank"]), "bank").select("bank", F.col("recall_at_budget").alias("recall"), "auc")


@query(
    _MEANS + _train_sql("fed", ROUNDS, EPOCHS) + _scored_sql("fed") + _caught_sql("fed")
    + _train_sql("solo", 1, ROUNDS * EPOCHS, False) + _scored_sql("solo") + _caught_sql("solo")
    + " SELECT f.bank::BIGINT AS bank, round(z.recall, 6) AS siloed_recall, round(f.recall, 6) AS federated_recall, round(z.auc, 6) AS siloed_auc, round(f.auc, 6) AS federated_auc, round(f.recall - z.recall, 6) + 0.0 AS lift FROM fedq f JOIN soloq z ON z.bank = f.bank"
)
def graph_siloed_vs_federated(spark, sf_dir):
    """Overdrawn accounts caught among 15 % alerts by banks that train alone and by the shared model."""
    view = _views(spark, sf_dir)
    together = graph_net.federated(view, NET, ROUNDS, EPOCHS, RATE, DECAY)
    alone = graph_net.siloed(view, NET, ROUNDS * EPOCHS, RATE, DECAY)
    f = _caught(view, dict.fromkeys(alone, together)).select("bank", F.col("recall").alias("_f"), F.col("auc").alias("_fa"))
    rows = _caught(view, alone).join(f, "bank")
    return rows.select("bank", F.round("recall", 6).alias("siloed_recall"), F.round("_f", 6).alias("federated_recall"), F.round("auc", 6).alias("siloed_auc"), F.round("_fa", 6).alias("federated_auc"), (F.round(F.col("_f") - F.col("recall"), 6) + 0.0).alias("lift"))
