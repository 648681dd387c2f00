"""What counting the tokens of texts holds, and what it reads."""

import random
import tracemalloc

import pyarrow as pa
import pytest

from ledgerloom.operators import text
from ledgerloom.plans import catalogue


class Taken(Exception):
    pass


def peak_of(spark, monkeypatch, texts):
    """Bytes that Python takes at most for a batch of that many texts of 200 different words."""

    def take(rows, run, schema):
        raise Taken(run)

    monkeypatch.setattr(text, "map_arrow", take)
    with pytest.raises(Taken) as taken:
        text.token_counts(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text")
    draw = random.Random(1)
    lows = [" ".join(f"{draw.randrange(10**9)}" for _ in range(200)) for _ in range(texts)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(texts)), pa.array(lows)], names=["doc_id", "low"])
    tracemalloc.start()
    parts = list(taken.value.args[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    found = [row for part in parts for row in part.to_pylist()]
    assert len(found) == texts and all(r["sizes"][0] == [200, 200] for r in found)
    return peak


def test_a_task_holds_the_tokens_of_one_text(spark, monkeypatch):
    assert peak_of(spark, monkeypatch, 300) < 2_000_000  # a text takes some 0.2 MB


def test_a_further_text_adds_its_sizes_alone(spark, monkeypatch):
    assert peak_of(spark, monkeypatch, 900) - peak_of(spark, monkeypatch, 300) < 600 * 1000  # its tokens take some 100 kB


def test_both_names_are_one_query():
    assert catalogue.QUERIES["token_ngrams_all"] is catalogue.QUERIES["token_ngrams"]


def test_texts_are_read_once_where_ids_are_unique(spark):
    plan = catalogue.QUERIES["token_ngrams"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "documents" not in plan
