"""Registered corpus queries against DuckDB, and the pipeline against its stages done by hand."""

import hashlib

import duckdb
import pandas as pd
import pytest

from ledgerloom.llm import queries
from ledgerloom.session import TABLES, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_oracle(spark, duck, name):
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLE[name]).df()
    columns = sorted(theirs.columns)
    assert sorted(ours.columns) == columns
    one = lambda v: "" if v is None or pd.isna(v) else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)  # noqa: E731  nullable counts come as floats
    plain = lambda frame: sorted([one(v) for v in row] for row in frame[columns].astype(object).values.tolist())
    assert plain(ours) == plain(theirs)


def test_pipeline_keeps_what_its_stages_keep(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, SF, "documents")
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, SF).collect()}
    toxic = {r.doc_id for r in docs.collect()} - kept
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert out and not toxic & set(out) and set(out) <= kept
    for r in out.values():
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "secret_scan", "byte_bpe"]
