"""Ranked search against scoring every document by hand."""

import math
import random
import re
from collections import Counter

import pytest

from ledgerloom.llm import lexical, queries

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
DOCS, ITEMS = "doc_id bigint, text string, term string, score int, key int", "item_id bigint, text string, rank int, word string"


def by_hand(docs, items, k=10):
    words = lambda t: TERM.findall((t or "").translate(UPPER))
    held = [(i, row, Counter(ws), len(ws)) for row, (i, t) in enumerate(docs) if (ws := words(t))]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, _, c, _ in held for t in c)
    found = []
    for item, text in items:
        asked, scored = Counter(words(text)), []
        for i, row, c, n in held:
            m = 100 - 75 + 75 * n * n_docs // n_terms
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, times in asked.items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, row, i))
        found += [(item, rank, i, -s) for rank, (s, _, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(found, key=repr)


def ours(spark, docs, items, k=10):
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], DOCS)
    items = spark.createDataFrame([(i, t, 1, "x") for i, t in items], ITEMS)
    return sorted((tuple(r) for r in lexical.search(docs, items, k).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("seed,sent", [(1, True), (2, False)])
def test_every_rank_is_as_by_hand(spark, monkeypatch, seed, sent):
    """Skewed words, copies and near copies; with ``sent`` false the terms are joined and no side is broadcast."""
    if not sent:
        monkeypatch.setattr(lexical, "TERMS_SENT", 0)
        monkeypatch.setattr(lexical, "BROADCAST_KEYS", 0)
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(120)] + ["É", "東京", "ß", "Don't", "A-b"]
    text = lambda n: " ".join(vocabulary[min(int(draw.expovariate(0.06)), len(vocabulary) - 1)] for _ in range(n))
    docs = [(i, text(draw.randint(1, 60))) for i in range(250)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)] + [(2000 + i, docs[8][1] + " w3") for i in range(40)]
    items = [(i, text(draw.randint(1, 25))) for i in range(12)] + [(50, docs[7][1]), (51, docs[8][1] * 3)]
    assert ours(spark, docs, items, 5) == by_hand(docs, items, 5)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " .,;"), (4, "One two"), (4, "one TWO"), (None, "one two"), (5, "two " * 30_000), (6, "\0one\x7ftwo"), (7, "ONE")]
    items = [(1, "one"), (1, "one"), (None, "two two"), (2, None), (3, ""), (4, "nothing here"), (5, "one two three")]
    assert ours(spark, docs, items) == by_hand(docs, items)
    assert ours(spark, docs, items, 2) == by_hand(docs, items, 2)


def test_empty_tables(spark):
    assert ours(spark, [], [(1, "one")]) == ours(spark, [(1, "one")], []) == ours(spark, [], []) == []
    assert ours(spark, [(1, None)], [(1, "one")]) == []


def test_query_rows_are_those_by_hand(spark):
    read = lambda name, key: [(r[key], r.text) for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]
    found = queries.op11_lexical_search(spark, SF).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, found), key=repr) == by_hand(read("documents", "doc_id"), read("benchmark", "item_id"))
