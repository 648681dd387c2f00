"""Prefixes of the n-gram join: what linked sets share, and links at the threshold in sets of many tokens."""

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import jaccard


def test_linked_sets_share_as_many_first_tokens_as_asked(spark):
    rng = np.random.default_rng(5)
    wanted = {r["n"]: r["k"] for r in spark.range(1, 2000).select(F.col("id").alias("n"), jaccard.least_shared(F.col("id"), 75).alias("k")).collect()}
    assert wanted[1] == 1 and wanted[84] == 1 and wanted[85] == 2 and wanted[1800] == 22
    seen = 0
    for _ in range(3000):
        common = int(rng.integers(1, 1200))
        more = int(rng.integers(0, common // 3 + 1))  # 100 common >= 75 union
        split = int(rng.integers(0, more + 1))
        tokens = rng.permutation(common + more)
        tokens[:] = np.argsort(rng.random(len(tokens)) - (np.arange(len(tokens)) >= common) * rng.integers(0, 2))  # what differs may come first
        x, y = np.sort(tokens[: common + split]), np.sort(np.concatenate([tokens[:common], tokens[common + split :]]))
        first = [set(s[: jaccard._prefix(np.array([len(s)]), 75)[0]].tolist()) for s in (x, y)]
        assert len(first[0] & first[1]) >= max(wanted[len(x)], wanted[len(y)])
        seen += wanted[len(x)] > 1
    assert seen > 1000


def test_links_at_the_threshold_of_long_texts(spark):
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in rng.integers(0, 10**9, 3000)]
    rows = []
    for k in range(12):
        base = words[k * 200 : k * 200 + 200]
        rows.append((10 * k, " ".join(base)))  # 196 shingles; those that change share 168 of 224 (0.75) or 167 of 225
        rows.append((10 * k + 1, " ".join(base[:172] + [f"x{k}_{i}" for i in range(28)])))
        rows.append((10 * k + 2, " ".join([f"y{k}_{i}" for i in range(29)] + base[29:])))
    found = {r["doc_id"]: r["component_id"] for r in jaccard.link(spark.createDataFrame(rows, "doc_id bigint, text string"), leaders=0).collect()}
    assert found == {i: i - i % 10 if i % 10 < 2 else i for i, _ in rows}


def test_what_counts_as_frequent_grows_slower_than_the_sets():
    rng = np.random.default_rng(7)
    small, large = (jaccard.frequent_from(rng.binomial(n, 0.5, (3, 1 << 16)) * 2.0 - n) for n in (1_000, 16_000))
    assert 6 < small < large < 5 * small and jaccard.frequent_from(np.zeros((3, 1 << 16))) == 6
