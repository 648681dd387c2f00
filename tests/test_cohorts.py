"""Cohorts as a stream of several batches, as a batch replay and by hand; masks of members that dropped out."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest

from ledgerloom.operators import masks
from ledgerloom.streaming import cohorts
from ledgerloom.streaming.rounds import run_to_end

DAY = datetime(2024, 3, 1, tzinfo=timezone.utc)


def at(seconds):
    return DAY + timedelta(seconds=seconds)


def random_events(seed, n=160, groups=6):
    draw = random.Random(seed)
    out = []
    for seq in range(n):
        kind = draw.choices(["open", "submit", "close"], [2, 9, 1])[0]
        cohort = f"c{draw.randrange(groups)}-{seq // 40}"
        planned = [str(m) for m in range(draw.randint(1, 5))] if kind == "open" else None
        v = [float(draw.randint(0, 9)), 1.0] if kind == "submit" else None
        out.append((cohort, at(seq * 30 + draw.randint(0, 90)), seq, kind, str(draw.randrange(6)) if kind == "submit" else None, planned, v))
    return out


def by_hand(events, timeout):
    found = {}
    for cohort in {e[0] for e in events}:
        own = sorted((e for e in events if e[0] == cohort), key=lambda e: (e[1], e[2]))
        micros = lambda t: round((t - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))
        opened, closes = micros(own[0][1]), [micros(e[1]) for e in own if e[3] == "close"]
        end = min([opened + timeout * 10**6, *closes[:1]])
        heard = [e for e in own if micros(e[1]) <= end and e[3] != "close"]
        if not heard:
            continue
        planned = heard[0][5] if heard[0][3] == "open" else [heard[0][4]]
        last = {e[4]: e[6] for e in heard if e[3] == "submit" and e[4] in planned}
        total = np.sum(list(last.values()), axis=0).tolist() if last else None
        found[cohort] = (opened, end, "closed" if closes and closes[0] == end else "timeout", sorted(last), sorted(set(planned) - set(last)), total)
    return found


def rows_of(frame):
    return {r.cohort: (r.opened, r.closed, r.reason, r.survivors, r.dropped, r.total) for r in frame.collect()}


def streamed(spark, path, batches, timeout, delay):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, cohorts.EVENT).coalesce(1).write.parquet(f"{path}/in/b={i}")
    stream = spark.readStream.schema(cohorts.EVENT).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/b=*")
    return run_to_end(cohorts.cohorts(stream, timeout, delay), f"{path}/out", f"{path}/cp")


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_and_replay_are_as_by_hand(spark, tmp_path, seed):
    events = random_events(seed)
    want = by_hand(events, 900)
    assert rows_of(cohorts.replayed(spark.createDataFrame(events, cohorts.EVENT), 900)) == want
    events += [("last", at(10**6), 10**6, "open", None, ["a"], None)]  # moves the watermark past every other end
    batches = [events[i : i + 40] for i in range(0, len(events), 40)]
    shuffled = [random.Random(seed).sample(b, len(b)) for b in batches]
    assert rows_of(streamed(spark, str(tmp_path), [*shuffled, [("end", at(2 * 10**6), 1, "open", None, ["a"], None)]], 900, "10 minutes")) == {k: v for k, v in want.items() if k != "last"} | {"last": by_hand(events, 900)["last"]}


def test_late_members_are_not_heard(spark, tmp_path):
    batches = [
        [("x", at(0), 1, "open", None, ["a", "b"], None), ("x", at(5), 2, "submit", "a", None, [1.0])],
        [("y", at(500), 3, "open", None, ["a"], None)],
        [("x", at(20), 4, "submit", "b", None, [5.0]), ("x", at(510), 5, "submit", "b", None, [7.0])],  # behind the watermark, and after the end
        [("z", at(5000), 6, "open", None, ["a"], None)],
        [("z", at(9000), 7, "close", None, None, None)],
    ]
    found = rows_of(streamed(spark, str(tmp_path), batches, 60, "10 seconds"))
    assert found["x"][3:] == (["a"], ["b"], [1.0]) and found["y"][3:] == ([], ["a"], None) and set(found) == {"x", "y", "z"}


def test_state_is_one_vector_a_planned_member():
    import pandas as pd

    one = cohorts._Cohort(None)
    frame = pd.DataFrame([{"kind": "open", "at": 0, "seq": 0, "member": None, "planned": ["0", "1", "2"], "v": None}] + [{"kind": "submit", "at": k, "seq": k, "member": str(k % 50), "planned": None, "v": [float(k)]} for k in range(1, 5000)])
    one.add(frame)
    one.settle(4000, 10**9)
    assert sum(r[1] <= 4000 for r in one.sent) == 3 and len(one.sent) <= 3 + 999
    back = cohorts._Cohort(one.state())
    back.settle(10**9, 10**9)
    assert sorted((m, v) for m, _, _, v in back.sent) == [("0", [4950.0]), ("1", [4951.0]), ("2", [4952.0])]


def test_odd_events(spark):
    rows = [(None, at(0), 1, "open", None, ["a"], None), ("n", None, 1, "open", None, ["a"], None), ("only", at(0), 1, "close", None, None, None), ("bad", at(0), 1, "submit", None, None, [1.0]), ("bad", at(1), 2, "submit", "a", None, None), ("odd", at(0), 3, "other", None, None, None), ("open", at(0), 1, "open", None, None, None), ("one", at(3), 1, "submit", "m", None, [2.0])]
    assert rows_of(cohorts.replayed(spark.createDataFrame(rows, cohorts.EVENT), 60)) == {"one": (*[x for x in by_hand([rows[-1]], 60)["one"]],)}
    assert cohorts.replayed(spark.createDataFrame([], cohorts.EVENT), 60).count() == 0


def test_masks_of_absent_members_are_taken_away(spark):
    plain = {m: np.random.default_rng(k).normal(size=4) for k, m in enumerate("abcde")}
    updates = spark.createDataFrame([("x", m, v.tolist()) for m, v in plain.items()], "cohort string, member string, v array<double>")
    sent = {r.member: r.v for r in masks.masked_updates(updates, ["cohort"], "s").collect()}
    events = [("x", at(0), 0, "open", None, list("abcde"), None)] + [("x", at(k + 1), k + 1, "submit", m, None, sent[m]) for k, m in enumerate("acd")]
    closed = cohorts.replayed(spark.createDataFrame(events, cohorts.EVENT), 60)
    row = cohorts.unmasked(closed, "s").first()
    assert row.survivors == list("acd") and closed.first().dropped == list("be")
    np.testing.assert_allclose(row.total, plain["a"] + plain["c"] + plain["d"], atol=1e-6)
