"""Fill-in-middle transformation: each text is cut in three and its middle moved to the end, by DuckDB over Arrow batches.

A task hands slices of its Arrow batches to a DuckDB connection of its own, which cuts each text into units by
``regexp_extract_all``, draws the two cuts and the form from the ``sha256`` of seed and id, takes the three runs of
units by ``list_slice`` and joins them by ``array_to_string``; Arrow goes back, and no Python runs for a row.
``restore`` finds the marks again, so the text comes back from output and form alone.

Forms: ``psm`` is ``<P>``prefix``<S>``suffix``<M>``middle, ``spm`` is ``<S>``suffix``<P>``prefix``<M>``middle and
``plain`` the text itself. A text that is empty, or that holds a mark, is plain, so the first mark found is always ours
(a mark begins with its only ``<`` and ends with its only ``>``, so none can arise across a joint).

Defined results: a null text is as an empty one (plain, no units); a null id draws as an empty id would; repeated rows
and repeated ids give a row each, rows of one id and text the same row; texts of any length are transformed whole; an
empty table gives an empty result; only the id and the text are read, so other columns and their names do not matter.
Memory is that of a slice: ``SLICE_BYTES`` of text, or one text where it is longer, at some 20 bytes a unit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import map_arrow

#: Patterns of units; each matches all characters of any text one after another.
CHARS = "(?s)."
WORDS = r"(?s)[^ \n]*[ \n]+|[^ \n]+"
LINES = r"(?s)[^\n]*\n|[^\n]+"
SLICE_BYTES = 4 << 20
_state: dict = {}

#: Parameters: the pattern of a unit, the seed, and the shares in percent of transformed texts and of spm among them.
_TRANSFORM = """
WITH cut AS (
    SELECT id, text, regexp_extract_all(text, $unit) AS units, sha256($seed || ':' || coalesce(id, '')) AS h FROM slice
), drawn AS (
    SELECT id, text, units, len(units) AS n,
        ('0x' || h[1:8])::UBIGINT % (len(units) + 1) AS one, ('0x' || h[9:16])::UBIGINT % (len(units) + 1) AS two,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::UBIGINT % 100 >= $moved THEN 'plain'
            WHEN ('0x' || h[25:32])::UBIGINT % 100 < $spm THEN 'spm' ELSE 'psm' END AS form
    FROM cut
), runs AS (
    SELECT id, text, n, form,
        CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, 1, least(one, two)), '') END AS prefix,
        CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, least(one, two) + 1, greatest(one, two)), '') END AS middle,
        CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, greatest(one, two) + 1, n), '') END AS suffix
    FROM drawn
)
SELECT id, n::BIGINT AS n, form, length(prefix)::BIGINT AS prefix_chars, length(middle)::BIGINT AS middle_chars,
    CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END AS output
FROM runs
"""

#: The first part lies before the second mark, the second before ``<M>``; the marks themselves have three characters.
_RESTORE = """
WITH halves AS (
    SELECT *, CASE WHEN form <> 'plain' THEN split_part(output, '<M>', 1)[4:] END AS head, CASE WHEN form <> 'plain' THEN split_part(output, '<M>', 2) END AS middle FROM slice
)
SELECT * EXCLUDE (head, middle), CASE WHEN output IS NULL THEN NULL
    WHEN form = 'psm' THEN concat(split_part(head, '<S>', 1), middle, split_part(head, '<S>', 2))
    WHEN form = 'spm' THEN concat(split_part(head, '<P>', 2), middle, split_part(head, '<P>', 1)) ELSE output END AS restored
FROM halves
"""


def _duck():
    if "duck" not in _state:
        import duckdb

        _state["duck"] = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "preserve_insertion_order": True})
    return _state["duck"]


def _select(rows: pa.Table, sql: str, **settings) -> pa.Table:
    duck = _duck()
    duck.register("slice", rows)
    made = duck.sql(sql, params=settings or None).to_arrow_table()
    duck.unregister("slice")
    return made


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows that hold ``SLICE_BYTES`` of the given string column at most, or one row."""
    ends, at = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64), 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def transform(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = CHARS, seed: str = "1", moved_percent: int = 90, spm_percent: int = 20, restored: bool = False
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output[, restored]) of every row; ``n`` counts units.

    ``restored`` is rebuilt from output and form within the same stage, as ``restore`` does it.
    """
    rows = df.select(F.col(id_col).alias("own"), F.col(id_col).cast("string").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                made = _select(pa.Table.from_batches([part.select(["id", "text"])]), _TRANSFORM, unit=unit, seed=seed, moved=moved_percent, spm=spm_percent)
                if restored:
                    made = _select(made, _RESTORE)
                yield from made.set_column(0, id_col, part.column(0)).to_batches()

    kind = rows.schema[0].dataType.simpleString()
    return map_arrow(rows, run, f"`{id_col}` {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string" + ", restored string" * restored)


def restore(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, form, output, restored) of rows with ``form`` and ``output``; null outputs restore to null."""
    rows = df.select(F.col(id_col), "form", "output")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                made = _select(pa.Table.from_batches([part.select([1, 2])]), _RESTORE)
                yield from made.add_column(0, id_col, part.column(0)).to_batches()

    kind = rows.schema[0].dataType.simpleString()
    return map_arrow(rows, run, f"`{id_col}` {kind}, form string, output string, restored string")
