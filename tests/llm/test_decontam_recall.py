"""Recall of changed copies of short items, and no report under the stated coverage."""

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import decontam
from ledgerloom.llm.wordhash import PUNCTUATION, word_hashes


def reported(size, changed, copies=300, seed=1):
    """Share of copies of an item with ``changed`` words replaced that are reported at coverage 0.5."""
    rng = np.random.default_rng(seed)
    items = [[f"i{k}w{j}" for j in range(size)] for k in range(copies)]
    texts = []
    for k, item in enumerate(items):
        words = list(item)
        for j in rng.choice(size, changed, replace=False):
            words[j] = f"x{k}y{j}"
        texts.append(" ".join([f"a{k}b{j}" for j in range(20)] + words + [f"c{k}d{j}" for j in range(20)]))
    index = decontam.Index(list(range(copies)), *word_hashes(pa.array([" ".join(x) for x in items]), PUNCTUATION))
    found = {(t, i) for t, i, matched, _, _ in decontam.overlaps(index, *word_hashes(pa.array(texts), PUNCTUATION)) if matched >= 0.5 * size}
    assert all(t == i for t, i in found)
    return len(found) / copies


@pytest.mark.parametrize("size, changed, least", [(8, 1, 0.99), (8, 2, 0.9), (15, 2, 0.99), (15, 3, 0.98), (15, 4, 0.95), (25, 6, 0.97), (40, 10, 0.99), (40, 14, 0.9)])
def test_recall_over_substitutions(size, changed, least):
    assert reported(size, changed) >= least


@pytest.mark.parametrize("size", [8, 15, 25, 40])
def test_nothing_under_the_coverage(size):
    assert reported(size, size // 2 + 1) == 0
