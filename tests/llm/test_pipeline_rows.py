"""Null-id and repeated rows in each stage of the pipeline."""

import pytest

SCHEMA = "doc_id bigint, text string, n_chars bigint"
CLEAN = "a plain and kind line of ordinary words that nobody would ever mind at all today"


@pytest.fixture(scope="module")
def corpus_pipeline():
    return pytest.importorskip("corpus_pipeline")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None if t is None else len(t)) for i, t in rows], SCHEMA)


def plain(out):
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)


def test_toxic_rows_go_by_their_own_text(spark, tmp_path, corpus_pipeline):
    text = lambda i, a, b: " ".join(f"{a} c{(7 * i + k) % 83} {b} d{(5 * i + k) % 79}" for k in range(12))
    bad, good = lambda i: text(i, "rotten", "filth"), lambda i: text(i, "kind", "plain")
    toxic, kind = bad(7), good(7)
    spark.createDataFrame([(i, i % 2) for i in range(100, 400)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    learned = [(i, bad(i) if i % 2 else good(i)) for i in range(100, 400)]
    rows = learned + [(None, toxic), (None, kind), (1, toxic), (1, kind), (1, kind)]
    out = plain(corpus_pipeline.drop_toxic(spark, frame(spark, rows), str(tmp_path)))
    assert out == sorted(((i, t) for i, t in rows if "rotten" not in t), key=repr)


def test_one_row_of_each_group_stays(spark, tmp_path, corpus_pipeline):
    words = [f"w{i}" for i in range(60)]
    near = " ".join(words[:59] + ["other"])
    lone = "x1 x2 x3 x4 x5 x6 x7 x8"
    rows = [(None, " ".join(words)), (4, near), (2, near), (2, near), (7, CLEAN), (7, CLEAN), (None, lone), (None, lone), (9, None), (9, None), (None, None), (2, "quite another text of several words under a repeated id")]
    out = plain(corpus_pipeline.drop_near_copies(spark, frame(spark, rows), str(tmp_path)))
    assert out == sorted([(2, near), (7, CLEAN), (None, lone), (9, None), (9, None), (None, None), (2, "quite another text of several words under a repeated id")], key=repr)


def test_leaks_go_by_their_own_text(spark, tmp_path, corpus_pipeline):
    item = " ".join(f"v{i}" for i in range(40))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"so {item} da"), (None, CLEAN), (3, item), (3, CLEAN), (3, item)]
    assert plain(corpus_pipeline.drop_contaminated(spark, frame(spark, rows), str(tmp_path))) == [(3, CLEAN), (None, CLEAN)]


def test_secrets_go_by_their_own_text(spark, tmp_path, corpus_pipeline):
    key = "9f8e7d6c5b4a39281706f5e4d3c2b1a098765432"
    rows = [(None, f'secret = "{key}"'), (None, CLEAN), (5, f'so password = "{key}" it is'), (5, CLEAN), (5, f'password = "{key}"')]
    out = plain(corpus_pipeline.mask_secrets(spark, frame(spark, rows), str(tmp_path)))
    assert out == sorted(((i, t.replace(key, "[SECRET]")) for i, t in rows), key=repr)


def test_all_stages_on_odd_rows(spark, tmp_path, corpus_pipeline):
    from pyspark.sql import functions as F

    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    rows = [(1, None), (1, None), (2, ""), (None, " \t\n"), (3, CLEAN), (3, CLEAN), (4, CLEAN), (5, long), (5, long), (6, "Einzeln"), (None, "null id")]
    spark.createDataFrame([], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clash = ["sid", "key", "fine", "score", "label", "component_id", "_places", "_text", "n", "ids"]
    docs = frame(spark, rows).withColumns({c: F.lit(c) for c in clash})
    kept, none = docs, docs.where("doc_id > 99")
    for name, stage in corpus_pipeline.STAGES:
        kept, none = (stage(spark, x, str(tmp_path)) for x in (kept, none))
        assert none.count() == 0
        if name != "byte_bpe":
            assert set(docs.columns) <= set(kept.columns)
    out = sorted(((r.doc_id, r.n_tokens > 0) for r in kept.collect()), key=repr)
    assert out == sorted([(1, False), (1, False), (2, False), (None, True), (3, True), (5, True), (6, True), (None, True)], key=repr)
