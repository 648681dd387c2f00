"""Idempotent upserts of streams and tables into versioned Parquet, merged by key when they are read.

A table is a folder. Every batch is written once into a folder of its attempt and then named by a small commit file of
its id, which appears whole or not at all; a batch whose commit file is there is skipped, so a batch that is replayed
after a restart changes nothing, and one that failed half-way leaves only files that nobody reads. Reading takes, of
every key, the row of the greatest (batch, order), and leaves out keys whose last row is a removal. ``compact`` writes
that state as the base that later batches add to; earlier states stay readable with ``as_of``.

Only the commit files, one for each batch since the last compaction, are listed by the driver. Rows of one key are
combined before they are shuffled, so a key that every batch touches is no hot spot. Null keys are keys of their own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructType

BATCH, REMOVED = "_batch", "_removed"


class UpsertTable:
    """Rows of ``schema`` by ``keys`` in the folder ``path``; of rows of one batch the greatest ``order`` counts."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: list[str], order: str):
        self.spark, self.path, self.keys, self.order = spark, path.rstrip("/"), keys, order
        self.schema = spark.createDataFrame([], schema).schema
        self._stored = StructType([*self.schema.fields]).add(REMOVED, BooleanType()).add(BATCH, LongType())

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def commits(self) -> dict[int, dict]:
        """What was committed, by batch; a base has all before it in itself."""
        fs, at = self._fs(f"{self.path}/commits")
        if not fs.exists(at):
            return {}
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        found = {}
        for name in sorted(n for n in names if n.endswith(".json")):
            stream = fs.open(self._fs(f"{self.path}/commits/{name}")[1])
            try:
                text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            found[name.removesuffix(".json")] = json.loads(text)
        return found

    def _commit(self, name: str, body: dict) -> bool:
        """Publish the commit file by a rename, which fails where one is there already."""
        fs, draft = self._fs(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        final = self._fs(f"{self.path}/commits/{name}.json")[1]
        fs.mkdirs(final.getParent())
        return not fs.exists(final) and fs.rename(draft, final)

    def upsert(self, rows: DataFrame, batch: int, removed: str = "false") -> bool:
        """Commit ``rows`` as ``batch``; rows for which ``removed`` holds remove their key. False where it was there already.

        Batches before the last compaction count as there.
        """
        done = self.commits()
        if f"batch-{batch:020d}" in done or any(c["kind"] == "base" and c["batch"] >= batch for c in done.values()):
            return False
        names = [f.name for f in self.schema.fields]
        row = F.struct(*names, F.coalesce(F.expr(removed), F.lit(False)).alias(REMOVED))
        last = rows.groupBy(*self.keys).agg(F.max_by(row, F.struct(F.col(self.order).isNotNull(), self.order)).alias("_row")).select("_row.*")
        place = f"data/batch-{batch:020d}-{uuid.uuid4().hex}"
        last.withColumn(BATCH, F.lit(batch).cast("bigint")).write.parquet(f"{self.path}/{place}")
        return self._commit(f"batch-{batch:020d}", {"kind": "batch", "batch": batch, "path": place})

    def _merged(self, as_of: int | None) -> DataFrame:
        """(columns, removed, batch): the last row of every key."""
        done = [c for c in self.commits().values() if as_of is None or c["batch"] <= as_of]
        base = max((c["batch"] for c in done if c["kind"] == "base"), default=None)
        places = [c["path"] for c in done if (c["kind"] == "base" and c["batch"] == base) or (c["kind"] == "batch" and (base is None or c["batch"] > base))]
        if not places:
            return self.spark.createDataFrame([], self._stored)
        rows = self.spark.read.schema(self._stored).parquet(*(f"{self.path}/{p}" for p in places))
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*(f.name for f in self._stored.fields)), BATCH).alias("_row")).select("_row.*")

    def read(self, as_of: int | None = None, decode: dict[str, str] | None = None) -> DataFrame:
        """The state after all batches, or after those up to ``as_of``; JSON columns are decoded by the schemas given."""
        rows = self._merged(as_of).where(f"not {REMOVED}").select(*(f.name for f in self.schema.fields))
        return rows.withColumns({c: F.from_json(c, s) for c, s in (decode or {}).items()})

    def compact(self, as_of: int | None = None) -> bool:
        """Write the state as a base; removed keys are kept as removals, since earlier batches may be replayed."""
        done = [c["batch"] for c in self.commits().values() if as_of is None or c["batch"] <= as_of]
        if not done:
            return False
        top = max(done)
        place = f"data/base-{top:020d}-{uuid.uuid4().hex}"
        self._merged(top).write.parquet(f"{self.path}/{place}")
        return self._commit(f"base-{top:020d}", {"kind": "base", "batch": top, "path": place})

    def sink(self, removed: str = "false") -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: each micro-batch is upserted under its own id."""

        def write(rows: DataFrame, batch: int) -> None:
            self.upsert(rows, batch, removed)

        return write


def run_to_end(stream: DataFrame, table: UpsertTable, checkpoint: str, removed: str = "false") -> DataFrame:
    """Process all that a stream holds now into ``table`` and read its state."""
    stream.writeStream.foreachBatch(table.sink(removed)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return table.read()
