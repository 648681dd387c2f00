"""The replay of a federation's log against a plain loop over its events, on random and odd logs."""

import itertools
import random

import numpy as np
import pytest

from ledgerloom.operators import rounds
from ledgerloom.operators.rounds import Replay

LOG = "seq bigint, kind string, round bigint, member bigint, v array<double>, recall double, silo_recall double, version bigint"
DIM = 3


def replay_by_hand(log, least, f, factor, trim):
    """Versions as [parent, round, weights], provenance and statuses."""
    held, versions, now, done, facts = {}, {0: (None, None, np.zeros(DIM))}, 0, {}, {}
    status = {0: "promoted"}
    for e in sorted((e for e in log if e[0] is not None), key=lambda e: e[0]):
        seq, kind, r, member, v, recall, silo, version = e
        if kind == "submit" and r is not None and member is not None and r not in done and v is not None and len(v) == DIM and all(x is not None and np.isfinite(x) for x in v):
            held.setdefault(r, {})[member] = (np.array(v), recall, silo)
        elif kind == "close" and r is not None and r not in done:
            done[r] = True
            own = held.get(r, {})
            if len(own) < least:
                continue
            names = sorted(own)
            vs = np.array([own[m][0] for m in names])
            d2 = ((vs[:, None] - vs[None]) ** 2).sum(2)
            n = len(names)
            krum = np.array([np.sort(np.delete(d2[i], i))[: max(1, n - f - 2)].sum() for i in range(n)])
            picked = np.argsort(krum, kind="stable")[: max(1, n - f)]
            refused = [i for i in range(n) if n >= f + 3 and i not in picked and krum[i] > factor * np.median(np.delete(krum, i))]
            kept = np.sort(vs[[i for i in range(n) if i not in refused]], axis=0)
            cut = int(len(kept) * trim)
            change = kept[cut : len(kept) - cut].mean(0) if len(kept) > 2 * cut else np.median(kept, axis=0)
            number = len(versions)
            versions[number] = (now, r, versions[now][2] + change)
            status[number] = "canary"
            good = [names[i] for i in range(n) if i not in refused]
            silos = [own[m][2] for m in good if own[m][2] is not None]
            facts[r] = (number, now, good, [names[i] for i in refused], round(float(np.mean([own[m][1] or 0 for m in good])), 4), round(float(np.mean(silos)), 4) if silos else None)
        elif kind == "promote" and version in versions:
            status = {k: "canary" if s == "promoted" else s for k, s in status.items()} | {version: "promoted"}
            now = version
        elif kind == "rollback" and version in versions:
            target = versions[version][0] or 0
            status = {k: "canary" if s == "promoted" else s for k, s in status.items()} | {version: "rolledback"} | {target: "promoted"}
            now = target
    return versions, facts, status


def agree(spark, log, least=3, f=1, factor=10.0, trim=0.2):
    versions, facts, status = replay_by_hand(log, least, f, factor, trim)
    frame = spark.createDataFrame(log, LOG)
    found = Replay(frame, DIM, least, f, factor, trim)
    assert {r["round"]: (r.version, r.parent, r.contributors, r.rejected, r.recall, r.silo_recall) for r in found.provenance().collect()} == facts
    weights = {r.version: r.v for r in found.weights().collect()}
    assert set(weights) == set(versions)
    for k, (_, _, w) in versions.items():
        np.testing.assert_allclose(weights[k], w, atol=1e-9)
    assert {r.version: r.status for r in found.statuses(frame).collect()} == status
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_random_logs_are_as_by_hand(spark, seed):
    draw, seq, log, made = random.Random(seed), 0, [], 0
    for r in range(14):
        members = draw.randint(1, 9)
        for m in [*range(members), *range(draw.randint(0, 2))]:
            seq += draw.randint(1, 3)
            big = 50.0 if m == 0 and draw.random() < 0.5 else 1.0
            log.append((seq, "submit", r, m, [draw.gauss(0, 1) * big for _ in range(DIM)], draw.choice([None, draw.random()]), draw.choice([None, draw.random()]), None))
        seq += 1
        log.append((seq, "close", r, None, None, None, None, None))
        made += members >= 3
        for _ in range(draw.randint(0, 3)):
            seq += 1
            log.append((seq, draw.choice(["promote", "rollback", "rollback"]), None, None, None, None, None, draw.randint(0, made + 1)))
    draw.shuffle(log)
    agree(spark, log)


def test_a_long_chain_of_promotions_and_rollbacks(spark):
    """Every version is promoted and built on, then all are rolled back one after the other."""
    log, seq = [], 0
    for r in range(20):
        for m in range(3):
            log.append((seq := seq + 1, "submit", r, m, [1.0, float(m), float(r)], 0.5, None, None))
        log += [(seq := seq + 1, "close", r, None, None, None, None, None), (seq := seq + 1, "promote", None, None, None, None, None, r + 1)]
    for version in range(20, 3, -1):
        log.append((seq := seq + 1, "rollback", None, None, None, None, None, version))
    found = agree(spark, log)
    assert {r.version: r.depth for r in found.depths().collect()} == {v: v for v in range(1, 21)}


def test_odd_events(spark):
    v = [1.0, 2.0, 3.0]
    sent = lambda seq, member, v, r=1: (seq, "submit", r, member, v, None, None, None)
    other = lambda seq, kind, r=None, version=None: (seq, kind, r, None, None, None, None, version)
    log = [
        sent(1, 1, v), sent(2, 2, [float("nan"), 1.0, 1.0]), sent(3, 2, [1.0, 1.0]), sent(4, 2, None), sent(5, None, v), sent(None, 3, v), sent(6, 3, v, None), sent(7, 3, [None, 1.0, 1.0]),
        other(8, "close", 1), sent(9, 4, v), other(10, "close", 1), other(11, "close", None), other(12, "unknown"), other(13, "promote", None, 9), other(14, "promote"), other(15, "rollback", None, 0), other(None, "promote", None, 1),
    ]
    found = agree(spark, log, least=1)
    assert found.provenance().first().contributors == [1]  # a cohort of one is its own aggregate
    agree(spark, log, least=2)
    agree(spark, [])


def test_running_values_over_ranges(spark):
    rows = spark.createDataFrame([(i, float(i) if i % 7 == 3 else None) for i in range(100)], "at bigint, mark double")
    from pyspark.sql import functions as F

    found = rounds.running(rows, "at", 5, total=(F.lit(1), "sum"), last=(F.col("mark"), "last")).collect()
    assert {r["at"]: (r.total or 0, r["last"]) for r in found} == {i: (i, max((float(k) for k in range(i) if k % 7 == 3), default=None)) for i in range(100)}


def test_a_mean_at_the_threshold_reaches_it_in_any_order(spark):
    recalls = [0.05, 0.35, 0.95]  # 1.35 / 3, but 0.44999999999999996 in doubles
    orders = list(itertools.permutations(recalls))
    assert any(sum(o) / 3 < 0.45 for o in orders)
    replay = object.__new__(Replay)
    replay.members = spark.createDataFrame([(i, x, x) for i, o in enumerate(orders) for x in o], "round bigint, recall double, silo_recall double").coalesce(1)
    replay.made = spark.createDataFrame([(i, i + 1) for i in range(len(orders))], "round bigint, version bigint")
    assert [r.hours_to_detect for r in replay.counters(100, 10.0, 6, 0.45).orderBy("version").collect()] == [6.0 * (i + 1) for i in range(len(orders))]
