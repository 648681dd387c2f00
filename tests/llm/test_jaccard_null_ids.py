"""Rows with a null id are linked like others and bridge documents that have ids."""

import pytest

from ledgerloom.llm import jaccard


def copies(start, stop, total=60):
    return " ".join(f"{'n' if start <= i < stop else 'w'}{i}" for i in range(total))


# of 56 shingles each end differs from the bridge in 5 (51 of 61 shared), the ends from one another in 10 (46 of 66)
ENDS = [copies(0, 5), copies(55, 60)]
BRIDGE = copies(0, 0)


@pytest.mark.parametrize("ids", [(5, None, 9), (None, 3, None), (5, 7, 9), (4, None, 4), (None, None, None)])
def test_null_ids_bridge(spark, ids):
    left, bridge, right = ids
    rows = [(left, ENDS[0]), (bridge, BRIDGE), (right, ENDS[1]), (11, "quite another text of several plain words here")]
    found = sorted(((r.doc_id, r.component_id) for r in jaccard.link(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=repr)
    least = min((i for i in ids if i is not None), default=None)
    assert found == sorted([(i, least) for i in ids] + [(11, 11)], key=repr)


def test_the_ends_alone_are_apart(spark):
    rows = [(5, ENDS[0]), (9, ENDS[1]), (None, BRIDGE)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard.link(frame).collect()} == {(5, 5), (9, 5), (None, 5)}
    assert {(r.doc_id, r.component_id) for r in jaccard.link(frame.where("doc_id is not null")).collect()} == {(5, 5), (9, 9)}
