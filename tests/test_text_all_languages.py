"""The text queries over every language, against brute force."""

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import functions as F

from ledgerloom.plans import catalogue

ROWS = [
    (1, "Pay the police in Bitcoin now", "en"),
    (2, "Größe und Straße: 12-34-56 für €250", "de"),
    (3, "L'été, c'est ÉNORME à 20 €", "fr"),
    (4, "El niño pagó con bitcoin", "es"),
    (5, "деньги 東京 wallet", None),
    (6, None, "en"),
    (7, "", None),
    (None, "sans identité", "fr"),
]


def folder(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def tokens(text):
    low = (text or "").lower()
    words, dense = re.findall("[a-z0-9']+", low), low.replace(" ", "")
    return ["w:" + w for w in words] + [f"b:{a}_{b}" for a, b in zip(words, words[1:], strict=False)] + ["c:" + dense[i : i + 3] for i in range(len(dense) - 2)]


def test_tokens_of_every_language(spark, tmp_path):
    want = set()
    for i, t, _ in ROWS:
        for kind in "wbc":
            own = [x for x in tokens(t) if x[0] == kind]
            want |= {(i, kind, len(own), len(set(own)))} if own else set()
    assert {tuple(r) for r in catalogue.QUERIES["token_ngrams"](spark, folder(spark, tmp_path)).collect()} == want


def test_buckets_of_every_language(spark, tmp_path):
    want = {}
    for i, t, _ in ROWS:
        sums = Counter()
        for x in tokens(t):
            h = int(hashlib.md5(x.encode()).hexdigest()[:16], 16)
            sums[h % 23] += 1 if h // 2 % 2 else -1
        size = math.sqrt(sum(v * v for v in sums.values()))
        want |= {(i, b): round(v / size, 5) + 0.0 for b, v in sums.items()}
    found = catalogue.QUERIES["hash_buckets"](spark, folder(spark, tmp_path)).collect()
    assert {(r.doc_id, r.bucket): round(r.value, 5) + 0.0 for r in found} == want


def test_flags_of_every_language(spark, tmp_path):
    found = {r.doc_id: {k for k, v in r.asDict().items() if k != "doc_id" and v} for r in catalogue.QUERIES["scam_flags_all"](spark, folder(spark, tmp_path)).collect()}
    assert found == {1: {"authority", "crypto"}, 2: {"sort_code", "money"}, 3: set(), 4: {"crypto"}, 5: {"crypto"}, 6: set(), 7: set(), None: set()}


def test_every_document_has_flags(spark):
    sf = "/root/testdata/sf0.001"
    assert catalogue.QUERIES["scam_flags_all"](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert catalogue.QUERIES["token_ngrams"](spark, sf).select(F.col("doc_id")).distinct().count() == spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 2").select("doc_id").distinct().count()


def test_rows_of_one_id_are_counted_together(spark, tmp_path):
    rows = [(1, "a b a b"), (1, "a c 😀xyz"), (2, "a b"), (None, "q r"), (None, "q r s")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for i in (1, 2, None):
        own = [x for d, t in rows if d == i for x in tokens(t)]
        want |= {(i, k, len(of), len(set(of))) for k in "wbc" if (of := [x for x in own if x[0] == k])}
    assert {tuple(r) for r in catalogue.QUERIES["token_ngrams"](spark, str(tmp_path)).collect()} == want


def test_no_token_is_shuffled(spark):
    for name in ("token_ngrams", "hash_buckets", "text_feature_rows"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "md5" not in plan and ("MapInArrow" in plan or "sizes#" in plan), name
