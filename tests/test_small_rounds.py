"""Robust aggregation equals its SQL where the last round has few members."""

import duckdb
import pytest

from ledgerloom.plans import catalogue

NAMES = ("krum_outlier_gate", "krum_scores", "multi_krum", "multi_krum_mean", "trimmed_mean", "rejected_members", "trim_membership", "trimmed_mean_ratio")


@pytest.mark.parametrize("members", [1, 6, 7, 8])
def test_small_last_round(spark, tmp_path, members):
    rows = [(i, [float((i * 37 + j * 11) % 23) / 7 for j in range(3)], i % 4) for i in range(25 + members)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in NAMES:
        theirs = duck.execute(catalogue.ORACLE[name])
        columns = [d[0] for d in theirs.description]
        ours = [tuple(r) for r in catalogue.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()]
        plain = lambda found: sorted(repr([round(v, 4) if isinstance(v, float) else v for v in r]) for r in found)
        assert plain(ours) == plain(theirs.fetchall()), name
