"""Models, trees, privacy, masks and ledgers against brute force, published figures and golden values."""

import hashlib
import hmac
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import features, ledger, masks, privacy, robust, training, trees
from ledgerloom.functions.scalar import to_number

MODELS = [training.Logistic(6), training.Perceptron((6, 5, 3)), training.Embedded((3, 4), 2, 4, 3), training.Recurrent(2, 3, 4)]


@pytest.mark.parametrize("model", MODELS, ids=lambda m: type(m).__name__)
def test_gradients_equal_differences(model):
    rng = np.random.default_rng(3)
    x, y, s = rng.normal(size=(9, 6)), rng.integers(0, 2, 9).astype(float), rng.random(9) + 0.5
    if isinstance(model, training.Embedded):
        x[:, 0], x[:, 1] = rng.integers(0, 3, 9), rng.integers(0, 4, 9)
    w = model.start() + rng.normal(0, 0.3, len(model.start()))

    def loss(v):
        p = model.score(v, x)
        return -(s * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    eye = np.eye(len(w)) * 1e-6
    numeric = np.array([(loss(w + e) - loss(w - e)) / 2e-6 for e in eye])
    assert np.allclose(model.gradient(w, x, y, s), numeric, atol=1e-4)


def test_running_scores_end_at_the_score():
    model, x = training.Recurrent(2, 3, 4), np.random.default_rng(1).normal(size=(5, 6))
    scores = model.running_scores(model.start(), x)
    assert scores.shape == (5, 3) and np.allclose(scores[:, -1], model.score(model.start(), x))


def test_rounds_equal_a_loop_over_banks(spark):
    rng = np.random.default_rng(2)
    x, bank = rng.normal(size=(90, 3)), rng.integers(0, 3, 90)
    y = (x[:, 0] + rng.normal(0, 0.5, 90) > 0.7).astype(int)
    rows = spark.createDataFrame([(int(b), v.tolist(), int(t)) for b, v, t in zip(bank, x, y, strict=True)], "bank bigint, x array<double>, y int")
    model, w = training.Logistic(3), np.zeros(4)
    for _ in range(2):
        local = []
        for b in range(3):
            own, v = bank == b, w.copy()
            weight = np.where(y[own] == 1, (y[own] == 0).sum() / max(1, y[own].sum()), 1.0)
            for _ in range(2):
                v = v - 0.3 * (model.gradient(v, x[own], y[own], weight) / own.sum() + 1e-4 * v)
            local.append(own.sum() * v)
        w = np.sum(local, axis=0) / 90
    assert np.allclose(training.federated(rows, model, 2, 2, 0.3), w)
    scored = training.predicted(rows, model, w).toPandas()
    assert np.allclose(sorted(scored["score"]), sorted(model.score(w, x)))
    assert training.federated(rows.where("bank > 9"), model, 1).tolist() == [0.0] * 4


def test_trees_learn_what_no_line_separates(spark):
    rng = np.random.default_rng(4)
    x = rng.random((400, 2))
    rows = spark.createDataFrame([(float(a), float(b), int((a > 0.5) != (b > 0.3))) for a, b in x], "a double, b double, y int")
    model = trees.fit(rows, ("a", "b"), n_trees=4, max_depth=2, bins=16)
    assert trees.from_json(trees.to_json(model)) == model
    scored = rows.select("y", trees.bin_vector(("a", "b"), model["edges"]).alias("bins")).select("y", trees.probability(model).alias("p")).toPandas()
    assert ((scored["p"] > 0.5) == scored["y"]).mean() > 0.9
    flat = trees.flatten(spark, model).toPandas()
    assert set(flat[flat["parent"].notna()]["parent"]) <= set(flat["node"]) and len(flat) == sum(map(len, model["trees"]))


def test_packed_bins_and_their_sums_are_those_of_single_features(spark):
    rng = np.random.default_rng(8)
    columns = tuple(f"c{i}" for i in range(17))  # more than a word holds, and an odd number for groups of two
    values = rng.normal(size=(300, 17))
    values[:, 3], values[::7, 4], values[:, 16] = 2.0, np.nan, rng.integers(0, 3, 300)
    data = [(*(None if i == 5 and k % 5 == 0 or i == 6 else float(x) for i, x in enumerate(v)), int(k % 3 == 0), int(k % 2)) for k, v in enumerate(values)]
    rows = spark.createDataFrame(data, ", ".join(f"{c} double" for c in columns) + ", y int, node int")
    counted = {tuple(r) for r in trees.column_histogram(rows, columns).where("f not in (4, 6)").select("f", "cell", "lo", "span", "n").collect()}
    assert counted == {tuple(r) for r in trees.grid_histogram(trees.long_form(rows, columns, [])).where("f not in (4, 6)").select("f", "cell", "lo", "span", "n").collect()}
    for bins in (16, 40, 2):
        edges = trees.edge_lists(rows, columns, bins)
        assert edges[6] == [] and all(len(e) < bins for e in edges)
        one = rows.select("y", "node", trees.bin_vector(columns, edges).alias("bins"))
        many = trees.packed(rows, columns, edges, ["y", "node"])
        bin_of = trees.in_words(edges)
        unpacked = many.select("y", "node", *(bin_of(f).alias(columns[f]) for f in range(17)))
        assert sorted(map(tuple, unpacked.collect())) == sorted((r["y"], r["node"], *r["bins"]) for r in one.collect())
        p = F.lit(0.35)
        long = one.select("node", "y", p.alias("p"), F.posexplode("bins").alias("f", "bin"))
        plain = {(r["node"], r["f"], r["bin"]): (r["g"], r["h"]) for r in trees.gradient_histogram(long, ["node"]).collect()}
        sums = {(r["node"], r["f"], r["bin"]): (r["g"], r["h"]) for r in trees.level_histogram(many.withColumns({"g": p - F.col("y"), "h": p * (1 - p)}), edges).collect()}
        assert plain.keys() == sums.keys() and all(np.allclose(plain[k], sums[k]) for k in plain)


def test_boosted_scores_bins_its_rows_once(spark, monkeypatch):
    from ledgerloom.plans import federation

    called, bin_vector = [], trees.bin_vector
    monkeypatch.setattr(trees, "bin_vector", lambda *a: called.append(a) or bin_vector(*a))
    assert federation.boosted_scores(spark, "/root/testdata/sf0.001").count() == 5 and len(called) == 1


def test_privacy_budget_of_published_settings(spark):
    spent = {0.7: 12.4581, 0.8: 7.928, 1.0: 4.9646, 1.1: 4.1953, 1.3: 2.9905, 1.5: 2.3292, 2.0: 1.4694, 3.0: 0.8677, 4.0: 0.6001}
    table = privacy.budget_table(spark.createDataFrame([(s, 0.1, 30) for s in spent], "sigma double, q double, rounds int"), 1e-5)
    for r in table.collect():
        assert round(r["epsilon"], 4) == spent[r["sigma"]] and math.isclose(r["epsilon"], privacy.epsilon(r["sigma"], 1e-5, 30, 0.1)[0])
    assert round(privacy.epsilon(1.1, 1e-5, 1, 0.1)[0], 3) == 1.801
    assert abs(privacy.calibrate(8.0, 1e-5, 50) - 4.51) < 0.02
    with pytest.raises(ValueError):
        privacy.calibrate(0, 1e-5, 50)
    rounds = privacy.spent_by_round(spark.createDataFrame([(5,), (9,), (9,)], "round bigint"), 1.1, 0.1, 1e-5).collect()
    assert sorted((r["round"], r["rounds"]) for r in rounds) == [(5, 1), (9, 2)]


def cohort(spark, n=9, dim=5, seed=6):
    v = np.random.default_rng(seed).normal(size=(n, dim))
    return v, spark.createDataFrame([(1, k, r.tolist()) for k, r in enumerate(v)], "round bigint, member bigint, v array<double>")


def test_noise_has_its_size(spark):
    _, rows = cohort(spark, 50, 200)
    zero = rows.withColumn("v", F.transform("v", lambda x: x * 0))
    noise = np.array([r["v"] for r in privacy.noised(zero, 2.0, 0.5, seed=3).collect()])
    assert abs(noise.std() - 1) < 0.05 and privacy.noised(zero, 2.0, 0.5).first()["v"] != privacy.noised(zero, 2.0, 0.5).first()["v"]


def test_mask_stream_is_the_golden_one():
    golden = [0.8049047642420114, 0.77533269603633, 0.13199360046164554, 0.8898936262059701]
    assert masks.uniforms(b"\x01" * 32, 4).tolist() == golden and masks.uniforms(b"\x01" * 32, 3).tolist() == golden[:3]


def test_masks_hide_and_cancel(spark):
    v, rows = cohort(spark)
    sent = masks.masked_updates(rows, ["round"], "m")
    assert np.abs(np.array([r["v"] for r in sent.collect()]) - v).min() > 1
    total = {r["dim"]: r["value"] for r in masks.secure_sum(sent, ["round"]).collect()}
    assert np.allclose([total[k] for k in range(5)], v.sum(0), atol=1e-6)
    left = {r["dim"]: r["value"] for r in masks.repaired_sum(sent.where("member not in (2, 5)"), rows, ["round"], "m").collect()}
    assert np.allclose([left[k] for k in range(5)], np.delete(v, [2, 5], axis=0).sum(0), atol=1e-6)


def test_bulyan_and_the_dispatcher(spark):
    v, rows = cohort(spark)
    v[4] *= 40
    rows = spark.createDataFrame([(1, k, r.tolist()) for k, r in enumerate(v)], rows.schema)
    found = robust.bulyan(rows, 1, ["round"]).first()
    assert 4 not in found["selected"] and len(found["selected"]) == 7
    picked = v[found["selected"]]
    near = np.sort(np.abs(picked - np.median(picked, axis=0)), axis=0)[:5]
    assert np.allclose(np.abs(np.array(found["value"]) - np.median(picked, axis=0)).max(), np.abs(found["value"] - np.median(picked, axis=0)).max()) and near.shape == (5, 5)
    assert len(robust.bulyan(rows.where("member < 6"), 1, ["round"]).first()["selected"]) == 5  # too few: Multi-Krum
    for method in robust.METHODS:
        value, members = robust.robust_aggregate(rows, method, 1, ["round"], max_norm=3.0)
        assert value.count() == 5 and members.count() == 9
    with pytest.raises(ValueError):
        robust.robust_aggregate(rows, "mean", 1, ["round"])
    with pytest.raises(ValueError):
        robust.trimmed(rows, None, ["round"], 0.5)
    three = robust.outlier_gate(rows.where("member in (3, 4, 5)"), 1, by=["round"]).collect()
    assert not any(r["rejected"] for r in three)  # fewer than f + 3 members accuse nobody


@pytest.mark.parametrize("n", [1, 2, 5, 8, 11])
def test_ledger_equals_a_tree_by_hand(spark, n):
    leaf = [hashlib.sha256(b"\x00" + json.dumps({"a": i, "b": f"é{i}"}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest() for i in range(n)]
    rows = spark.range(n).select("id", ledger.canonical_json(b=F.concat(F.lit("é"), F.col("id").cast("string")), a=F.col("id")).alias("body"))
    nodes = ledger.leaves(rows, "id", F.col("body"))
    assert [r["h"] for r in nodes.orderBy("seq").collect()] == leaf
    level = leaf
    while len(level) > 1:
        level = [hashlib.sha256(b"\x01" + bytes.fromhex(level[i]) + bytes.fromhex(level[min(i + 1, len(level) - 1)])).hexdigest() for i in range(0, len(level), 2)]
    tree = ledger.levels(nodes)
    assert tree[-1].first()["h"] == level[0] == ledger.root(nodes)
    for i in range(0, n, 3):
        assert ledger.verify_inclusion(leaf[i], i, ledger.inclusion_proof(tree, i), level[0])
        assert not ledger.verify_inclusion(leaf[i], i, ledger.inclusion_proof(tree, i), "00" * 32)
    for first in {1, n // 2, n - 1, n} - {0}:
        old = ledger.root(nodes.where(F.col("seq") < first))
        proof = ledger.consistency_proof(tree, first, n)
        assert ledger.verify_consistency(proof, first, n, old, level[0])
        assert not ledger.verify_consistency(proof, first, n, "00" * 32, level[0]) and not ledger.verify_consistency(proof, first, n, old, "00" * 32)
    with pytest.raises(ValueError):
        ledger.consistency_proof(tree, 1, 2 * n + 1)


def test_consistency_proofs_of_all_sizes_to_64():
    """By hand: every pair of sizes is proved by 2 log2 n hashes at most, and a rewritten record by none."""

    def rows(leaf):
        out = [leaf]
        while len(out[-1]) > 1:
            last = out[-1]
            out.append([hashlib.sha256(b"\x01" + bytes.fromhex(last[i]) + bytes.fromhex(last[min(i + 1, len(last) - 1)])).hexdigest() for i in range(0, len(last), 2)])
        return out

    leaf = [hashlib.sha256(bytes([0, i])).hexdigest() for i in range(64)]
    roots = {n: rows(leaf[:n])[-1][0] for n in range(1, 65)}
    for second in range(1, 65):
        tree, bad = rows(leaf[:second]), rows([*leaf[: second // 2], "11" * 32, *leaf[second // 2 + 1 : second]])
        for first in range(1, second + 1):
            asked = ledger._blocks(0, first) + ledger._blocks(first, second)
            proof = {(k, i): tree[k][i] for k, i in asked}
            assert len(proof) <= max(1, 2 * math.log2(second))
            assert ledger.verify_consistency(proof, first, second, roots[first], roots[second])
            other = {(k, i): bad[k][i] for k, i in asked}
            assert not ledger.verify_consistency(other, first, second, roots[first], bad[-1][0]) or second // 2 >= first
            assert not ledger.verify_consistency({**proof, (9, 9): "00" * 32}, first, second, roots[first], roots[second])
            assert not ledger.verify_consistency(dict(list(proof.items())[1:]), first, second, roots[first], roots[second])


def test_registry_replays_promotions(spark):
    log = [(1, "aggregate", "a", None), (2, "aggregate", "b", "a"), (3, "promote", "a", None), (4, "promote", "b", None), (5, "aggregate", "c", "b"), (6, "rollback", "b", None), (7, "aggregate", "a", "x")]
    found = {r["model"]: (r["parent"], r["status"]) for r in ledger.registry(spark.createDataFrame(log, "seq bigint, kind string, model string, parent string")).collect()}
    assert found == {"a": (None, "active"), "b": ("a", "retired"), "c": ("b", "canary")}


def test_named_vectors(spark):
    rows = [({"amount": "3.5", "velocity_1h": "2", "x": "9"},), ({"amount": "nan", "is_new_payee": "yes"},), ({"amount": "7", "campaign_signature": "2", "account_age": "4"},), ({},)]
    found = [r["v"] for r in spark.createDataFrame(rows, "m map<string, string>").select(features.named_vector(F.col("m"), to_number).alias("v")).collect()]
    assert found == [[3.5, 0, 0, 0, 0, 0, 2, 0, 0, 0], [0, 0, 0, 0, 0, 0, 0, 0, 1, 0], [-0.5, 0, 0, 0, 0, -2, -0.5, -0.5, 0, 3], [0] * 10]


def test_steps_read_rows_without_checking_every_value(spark, monkeypatch):
    rows = [(b, [float(i % 7), float(i % 5)], i % 2) for b in (0, 1) for i in range(40)]
    odd = [(0, [float("nan"), 1.0], 1), (1, [1.0, None], 0), (1, [float("inf"), 1.0], 1), (0, [1.0], 1), (None, [1.0, 1.0], 1), (0, [1.0, 1.0], None), (0, None, 1), (0, [], 0)]
    schema = "bank bigint, x array<double>, y int"
    model, seen, own = training.Logistic(2), [], training.gradients
    monkeypatch.setattr(training, "gradients", lambda rows, *rest: seen.append(rows._jdf.queryExecution().optimizedPlan().toString()) or own(rows, *rest))
    both = [training.federated(spark.createDataFrame(part, schema), model, 2, 2) for part in (rows, rows + odd)]
    assert np.allclose(*both, atol=1e-12) and np.abs(both[0]).max() > 0
    assert len(seen) == 8 and not any("forall" in plan for plan in seen)


def test_only_arrived_members_are_masked(spark):
    """Masks are those of plain HMAC for keys of any length, and a message is the same whoever else is sent for."""
    for size in (0, 32, 64, 65, 200):
        seed = bytes(range(size))
        want = b"".join(hmac.digest(seed, k.to_bytes(8, "big"), "sha256") for k in range(3))
        np.testing.assert_array_equal(masks.uniforms(seed, 11), np.frombuffer(want, "<u8")[:11] / 2.0**64)
    rows = spark.createDataFrame([(i // 4, i, [float(i), 1.0]) for i in range(8)], "round int, member int, v array<double>")
    whole = {r.member: r.v for r in masks.masked_updates(rows, ["round"], "s").collect()}
    some = {r.member: r.v for r in masks.masked_updates(rows, ["round"], "s", "member % 4 <> 1").collect()}
    assert some == {m: v for m, v in whole.items() if m % 4 != 1}
