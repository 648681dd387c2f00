"""Graph networks on small graphs: against dense matrices, gradients against differences, and odd rows."""

import numpy as np
import pytest

from ledgerloom.operators import graph, graph_net

COLUMNS = ["f0", "f1", "f2"]
NODES = "id string, bank int, y int, f0 double, f1 double, f2 double"


def small_graph(spark, seed=0, n=24, banks=3):
    rng = np.random.default_rng(seed)
    nodes = [(f"n{i}", int(rng.integers(banks)), int(rng.random() < 0.3), *map(float, rng.normal(size=3))) for i in range(n)]
    edges = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, n, (50, 2))] + [("n0", "n0"), ("n1", "n2"), ("n1", "n2")]
    return nodes, edges, spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, "src string, dst string")


def dense(nodes, edges, bank):
    """(ids, row-normalised adjacency with self loops, hidden features, labels, owned) of a bank's view."""
    home = {n[0]: n[1] for n in nodes}
    inside = [(a, b) for a, b in edges if bank in (home[a], home[b])]
    ids = sorted({n for n in home if home[n] == bank} | {x for e in inside for x in e})
    at = {n: k for k, n in enumerate(ids)}
    a = np.zeros((len(ids), len(ids)))
    for s, d in inside:
        a[at[s], at[d]] = a[at[d], at[s]] = 1
    a += np.eye(len(ids))
    of = {n[0]: n for n in nodes}
    owned = np.array([home[n] == bank for n in ids])
    return ids, a / a.sum(axis=1, keepdims=True), np.array([of[n][3:] for n in ids]) * owned[:, None], np.array([of[n][2] for n in ids], float), owned


def dense_score(net, w, a, x):
    h, (*layers, (m, b)) = x, net.parts(w)
    for k, bias in layers:
        h = np.maximum(a @ h @ k + bias, 0)
    return 1 / (1 + np.exp(-(h @ m + b)[:, 0]))


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_scores_and_gradients_are_those_of_dense_matrices(spark, depth):
    nodes, edges, node_rows, edge_rows = small_graph(spark, depth)
    net = graph_net.GraphNet(3, 4, depth, 5)
    view = graph_net.views(node_rows, edge_rows, COLUMNS)
    rng = np.random.default_rng(9)
    weights = {b: net.start() + rng.normal(0, 0.2, len(net.start())) for b in range(3)}
    found = {(r.bank, r.id): r.score for r in graph_net.scores(view, net, weights).collect()}
    gradient = graph_net.gradients(view, net, weights, {b: p for b, (p, _) in graph_net.balance(view).items()})
    for b, w in weights.items():
        ids, a, x, y, owned = dense(nodes, edges, b)
        score = dense_score(net, w, a, x)
        assert {i for bank, i in found if bank == b} == {i for i, own in zip(ids, owned, strict=True) if own}
        np.testing.assert_allclose([found[b, i] for i, own in zip(ids, owned, strict=True) if own], score[owned])
        positive = (owned & (y == 0)).sum() / max(1, (owned & (y == 1)).sum()) if (owned & (y == 1)).any() else 1.0

        def loss(v, a=a, x=x, y=y, owned=owned, positive=positive):
            p = dense_score(net, v, a, x)
            return -(np.where(y == 1, positive * np.log(p), np.log(1 - p)) * owned).sum()

        step = 1e-6
        slope = [(loss(w + step * e) - loss(w - step * e)) / (2 * step) for e in np.eye(len(w))]
        np.testing.assert_allclose(gradient[b], slope, atol=1e-5)


def test_training_lowers_the_loss_and_the_shared_model_sees_more(spark):
    """A star of accounts around a collector in every bank; only one bank has labels."""
    nodes, edges = [], []
    rng = np.random.default_rng(4)
    for bank in range(3):
        for i in range(30):
            star = i < 6
            nodes.append((f"b{bank}_{i}", bank, int(star), *map(float, rng.normal(2.0 if star else 0.0, 0.4, 3))))
        edges += [(f"b{bank}_0", f"b{bank}_{i}") for i in range(1, 6)] + [(f"b{bank}_{a}", f"b{bank}_{b}") for a, b in rng.integers(6, 30, (25, 2))]
    view = graph_net.views(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, "src string, dst string"), COLUMNS, "bank = 0")
    net = graph_net.GraphNet(3, 4, 1, 1)

    def gap(weights):
        rows = graph_net.scores(view, net, weights).where("bank > 0").collect()
        return np.mean([r.score for r in rows if r.y == 1]) - np.mean([r.score for r in rows if r.y == 0])

    alone = graph_net.siloed(view, net, 12, 0.5)
    together = graph_net.federated(view, net, 3, 4, 0.5)
    assert gap(dict.fromkeys(alone, together)) > 0.02 + gap(alone)


def test_odd_rows(spark):
    nodes = [("a", 0, None, 1.0, None, 0.0), ("b", 1, 1, 0.5, 2.0, 1.0), ("lone", 1, 0, 1.0, 1.0, 1.0), (None, 1, 1, 9.0, 9.0, 9.0), ("nobank", None, 1, 9.0, 9.0, 9.0)]
    edges = [("a", "b"), ("b", "a"), ("a", None), (None, "b"), ("a", "unknown"), ("nobank", "a")]
    view = graph_net.views(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, "src string, dst string"), COLUMNS)
    rows = {(r.bank, r.id): r for r in view.members.collect()}
    assert set(rows) == {(0, "a"), (0, "b"), (1, "a"), (1, "b"), (1, "lone")}
    assert rows[0, "a"].mean == [0.5, 0.0, 0.0] and rows[1, "a"].mean == [0.25, 1.0, 0.5] and rows[1, "lone"].mean == [1.0, 1.0, 1.0]
    net = graph_net.GraphNet(3, 2)
    assert len(graph_net.federated(view, net, 1, 1)) == len(net.start())
    empty = graph_net.views(spark.createDataFrame([], NODES), spark.createDataFrame([], "src string, dst string"), COLUMNS)
    np.testing.assert_array_equal(graph_net.federated(empty, net, 2, 1), net.start())
    assert graph_net.scores(empty, net, {}).count() == 0


def test_own_accounts_suffice_for_one_layer(spark):
    """Views of own accounts hold no row of another bank and give the same weights and scores."""
    nodes, edges, node_rows, edge_rows = small_graph(spark, 3)
    edge_rows = edge_rows.union(spark.createDataFrame([("n0", None), ("n0", "unknown")], "src string, dst string"))
    net = graph_net.GraphNet(3, 4, 1, 5)
    whole, own = (graph_net.views(node_rows, edge_rows, COLUMNS, boundary=b) for b in (True, False))
    rows = own.members.collect()
    assert len(rows) == len(nodes) and all(r.owned for r in rows)
    np.testing.assert_allclose(graph_net.federated(own, net, 2, 2), graph_net.federated(whole, net, 2, 2))
    scores = [{r.id: r.score for r in graph_net.scores(v, net, dict.fromkeys(range(3), net.start())).collect()} for v in (whole, own)]
    assert scores[0] == pytest.approx(scores[1])
    with pytest.raises(ValueError):
        graph_net.scores(own, graph_net.GraphNet(3, 4, 2), dict.fromkeys(range(3), graph_net.GraphNet(3, 4, 2).start()))


def test_views_of_odd_payments(spark):
    """A null balance is left out of means but not of weights; no view's links are grouped for members or means."""
    nodes = spark.createDataFrame([("a", 0, 4.0), ("b", 0, None), ("c", 1, 6.0), ("lone", 1, 1.0), ("nobank", None, 8.0)], "id string, bank int, x double")
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("c", "c"), ("a", None), ("a", "unknown"), ("nobank", "c")], "src string, dst string")
    means = graph.neighbour_mean(nodes, edges)
    assert {(r.bank, r.id): (r.mean_x, r.weight) for r in means.collect()} == {
        (0, "a"): (2.0, 3), (0, "b"): (4.0, 2), (0, "c"): (2.0, 2), (1, "a"): (3.0, 2), (1, "c"): (3.0, 4), (1, "lone"): (1.0, 1), (1, "nobank"): (3.0, 2),
    }
    members = graph.local_subgraph(nodes, edges)
    assert {(r.bank, r.id, r.owned, r.x) for r in members.where("bank is not null").collect()} == {
        (0, "a", True, 4.0), (0, "b", True, None), (0, "c", False, 0.0), (1, "a", False, 0.0), (1, "c", True, 6.0), (1, "lone", True, 1.0), (1, "nobank", None, 0.0),
    }
    assert members._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
