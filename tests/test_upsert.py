"""Upsert tables: replays, removals, reloads, compaction, and batches that fail half-way."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.sinks.upsert import UpsertTable, run_to_end

SCHEMA = "id bigint, seq bigint, body string"


def fresh(spark, tmp_path, name="t"):
    return UpsertTable(spark, f"{tmp_path}/{name}", SCHEMA, ["id"], "seq")


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def state(table, **how):
    return {r["id"]: (r.seq, r.body) for r in table.read(**how).collect()}


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    t = fresh(spark, tmp_path)
    assert state(t) == {}
    assert t.upsert(rows(spark, [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")]), 0)
    assert not t.upsert(rows(spark, [(1, 9, "other"), (3, 9, "x")]), 0)
    assert state(t) == {1: (2, "b"), 2: (1, "c")}
    assert t.upsert(rows(spark, [(1, 1, "later batches win")]), 1)
    assert state(fresh(spark, tmp_path)) == {1: (1, "later batches win"), 2: (1, "c")}  # a new reader, from the files alone
    assert state(t, as_of=0) == {1: (2, "b"), 2: (1, "c")}


def test_random_batches_are_as_a_dictionary(spark, tmp_path):
    draw, t, want, history = random.Random(3), fresh(spark, tmp_path), {}, []
    for batch in range(6):
        data = [(draw.choice([None, *range(8)]), seq, draw.choice(["x", "gone"])) for seq in range(10)]
        t.upsert(rows(spark, data), batch, "body = 'gone'")
        for key, seq, body in data:
            if body == "gone":
                want.pop(key, None)
            else:
                want[key] = (seq, body)
        history.append(dict(want))
        if batch == 3:
            assert t.compact() and not t.compact()
        assert state(t) == want
        assert not t.upsert(rows(spark, data[:1]), draw.randint(0, batch))
    assert [state(t, as_of=b) for b in range(6)] == history


def test_a_batch_that_failed_is_written_by_its_next_attempt(spark, tmp_path):
    t = fresh(spark, tmp_path)
    bad = rows(spark, [(1, 1, "a")]).withColumn("body", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        t.upsert(bad, 0)
    assert state(t) == {} and t.upsert(rows(spark, [(1, 1, "a")]), 0) and state(t) == {1: (1, "a")}


def test_json_columns_are_decoded_and_odd_rows_kept(spark, tmp_path):
    t = fresh(spark, tmp_path)
    t.upsert(rows(spark, [(1, None, '{"k": [1, 2]}'), (2, None, "no json"), (3, None, None), (3, 1, '{"k": []}'), (None, 1, None)]), 0)
    t.upsert(rows(spark, []), 1)
    found = {r["id"]: r.body for r in t.read(decode={"body": "k array<int>"}).collect()}
    assert found[1].k == [1, 2] and found[2].k is None and found[3].k == [] and found[None] is None


def test_a_stream_restarted_from_its_checkpoint_goes_on(spark, tmp_path):
    for i in range(3):
        rows(spark, [(k, i, f"b{i}") for k in range(i, 5)]).coalesce(1).write.parquet(f"{tmp_path}/in/b={i}")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/b=*")
        found = run_to_end(stream, fresh(spark, tmp_path), f"{tmp_path}/cp")
        assert {r["id"]: r.seq for r in found.collect()} == {k: min(k, i) for k in range(5)}
