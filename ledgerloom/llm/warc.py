"""WARC files and a Merkle fixity audit of replicas; hashing and descent are DataFrame functions.

A record is a WARC/1.0 response block written by rule from a page. Records lie in files by id, ``RECORDS_PER_FILE``
consecutive ids to a file, ordered by id inside it, so every range of ids is a range of offsets; files are gzip
streams and an offset counts bytes of the stream. ``stored_records`` reads files back and hashes the bytes of every
record where it lies.

The tree of a replica has a leaf for every id of a file, a node for every range of ``FAN_OUT`` ids, of ``FAN_OUT`` such
ranges and so on up to a file, and a root over files. A leaf hashes offset, length and digest of the id's records in
the order of their offsets, and a node its children's positions and hashes in order, so a record that lies elsewhere
changes the root as one that reads otherwise does. The audit compares roots first: equal replicas stop there. Else it
descends, level by level, only into ranges whose hashes differ, down to the records of differing leaves. There records
are matched by digest: what only one replica has is ``changed``, ``missing`` or ``added``, and a matched record whose
place among the matched ones of its file differs has ``moved``. A record that is lost, slipped in or grown shifts those
behind it, whose leaves then differ too, but not their order, so nothing is reported beside it.

Files above ``RECORDS_PER_FILE`` records or ``FILE_BYTES`` bytes (repeated ids, the null id, long bodies) are dealt
into pieces by a hash of the row's number in the table that is read, so equal rows are dealt too and a repeated task
deals as before; replicas that were written from differently ordered tables may deal such a file otherwise, and then its
records count as differing. Defined results: a null url or body is empty; rows with a null id are records of file
``NULL_FILE``; repeated rows are repeated records; empty tables have no root and no differences; a stretch of a file
that does not parse is one record without an id, up to the next one that does; bodies of up to 2 GB are kept whole;
other columns are not read, so their names do not matter.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.shared import BROADCAST_KEYS, map_arrow, stored

RECORDS_PER_FILE = 4096
FAN_OUT = 16
FILE_BYTES = 64_000_000
NULL_FILE = -(2**52)
END = "\r\n\r\n"
MARK = b"WARC/1.0\r\n"


def record(page_id: Column, url: Column, body: Column) -> Column:
    """The text of a WARC response record; its bytes are the UTF-8 of it."""
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(F.coalesce(body, F.lit(""))).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, F.coalesce(body, F.lit("")), F.lit(END))


def _file(page_id: Column) -> Column:
    return F.coalesce(F.floor(page_id / RECORDS_PER_FILE), F.lit(NULL_FILE)).cast("bigint")


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> None:
    """WARC files under ``folder``; the text sink's line end is each record's last byte."""
    page_id = F.col(id_col).cast("bigint")
    rows = pages.select(_file(page_id).alias("file"), page_id.alias("_id"), F.monotonically_increasing_id().alias("_row"), record(F.col(id_col), F.col(url_col), F.col(body_col)).alias("value"))
    heavy = rows.groupBy("file").agg(F.count("*").alias("n"), F.sum(F.octet_length("value").cast("bigint")).alias("bytes"))
    heavy = heavy.where((F.col("n") > RECORDS_PER_FILE) | (F.col("bytes") > FILE_BYTES))
    heavy = stored(heavy.select("file", F.ceil(F.greatest(F.col("n") / RECORDS_PER_FILE, F.col("bytes") / FILE_BYTES)).cast("int").alias("pieces")), "heavy")
    rows = rows.join(F.broadcast(heavy) if heavy.count() <= BROADCAST_KEYS else heavy, "file", "left")
    piece = F.when(F.col("pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64("_row"), "pieces")).cast("int")
    rows = rows.select("file", piece.alias("piece"), "_id", F.substring("value", F.lit(1), F.length("value") - 1).alias("value"))
    rows = rows.repartition("file", "piece").sortWithinPartitions("file", "piece", "_id", "value").drop("_id")
    rows.write.partitionBy("file", "piece").option("lineSep", "\n").option("compression", "gzip").text(folder)


def _parsed(data: bytes) -> Iterator[tuple[int, int, int | None, str, str]]:
    """(offset, length, page id, url, body) of the records of a stream, each as long as its own length field says."""
    at = 0
    while at < len(data):
        try:
            if not data.startswith(MARK, at):
                raise ValueError("no record begins here")
            cut = data.index(b"\r\n\r\n", at)
            head = dict(line.split(b": ", 1) for line in data[at:cut].split(b"\r\n")[1:])
            body = cut + 4
            end = body + int(head[b"Content-Length"])
            if data[end : end + 4] != END.encode():
                raise ValueError("the record does not end where it says")
            page = head[b"WARC-Record-ID"][len(b"<urn:page:") : -1]
            found = int(page) if page else None, head[b"WARC-Target-URI"].decode(), data[body:end].decode()
            end += 4
        except (ValueError, KeyError, IndexError):
            end = data.find(END.encode() + MARK, at + 1) + 4
            end = len(data) if end < 4 else end
            found = None, "", data[at:end].decode(errors="replace")
        yield at, end - at, *found
        at = end


def _files(spark: SparkSession, folder: str) -> DataFrame:
    place = F.regexp_extract("path", r"file=(-?\d+)/piece=(\d+)/", 1).cast("bigint"), F.regexp_extract("path", r"file=(-?\d+)/piece=(\d+)/", 2).cast("int")
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(folder)
    return raw.select(place[0].alias("file"), place[1].alias("piece"), "content")


def stored_records(spark: SparkSession, folder: str) -> DataFrame:
    """(file, page_id, piece, at, length, digest) of every record under ``folder``, hashed as its bytes lie there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, piece, content in zip(*batch.columns, strict=True):
                data = gzip.decompress(content.as_buffer())
                rows = [(file.as_py(), page, piece.as_py(), at, size, hashlib.sha256(data[at : at + size]).hexdigest()) for at, size, page, _, _ in _parsed(data)]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names=["file", "page_id", "piece", "at", "length", "digest"])

    return map_arrow(_files(spark, folder), run, "file bigint, page_id bigint, piece int, at bigint, length bigint, digest string")


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, html) of the records under ``folder``; bodies may hold any text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(2):
                rows = [r[2:] for r in _parsed(gzip.decompress(content.as_buffer()))]
                kinds = (pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 3, kinds, strict=True)], names=["page_id", "url", "html"])

    return map_arrow(_files(spark, folder), run, "page_id bigint, url string, html string")


def _above(nodes: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """(file, piece, slot, hash) of the ranges above ``nodes``."""
    order = F.sort_array(F.collect_list(F.struct("slot", "hash")))  # at most fan_out children
    text = F.concat_ws(" ", F.transform(order, lambda x: F.concat_ws(":", x["slot"].cast("string"), x["hash"])))
    return nodes.groupBy("file", "piece", F.floor(F.col("slot") / fan_out).cast("bigint").alias("slot")).agg(F.sha2(text, 256).alias("hash"))


LEAF = ["file", "piece", "slot"]


def tree(rows: DataFrame) -> list[DataFrame]:
    """The records, the leaves and the levels above them up to a node for each file, each written to the shared folder."""
    levels = [stored(rows.withColumn("slot", F.coalesce("page_id", F.lit(0))), "records")]
    order = F.sort_array(F.collect_list(F.struct("at", "length", "digest")))  # of one file
    text = F.concat_ws(" ", F.transform(order, lambda x: F.concat_ws(":", x["at"].cast("string"), x["length"].cast("string"), x["digest"])))
    levels.append(stored(levels[0].groupBy(*LEAF).agg(F.sha2(text, 256).alias("hash")), "leaves"))
    size = 1
    while size < RECORDS_PER_FILE:
        levels.append(stored(_above(levels[-1]), "level"))
        size *= FAN_OUT
    return levels


def root(levels: list[DataFrame]) -> str | None:
    """The root over the files' nodes, from ranges of files; one short row at the top."""
    top = levels[-1].select(F.lit(0).alias("file"), F.lit(0).alias("piece"), F.col("file").alias("slot"), F.sha2(F.concat_ws(":", F.col("piece").cast("string"), F.col("slot").cast("string"), "hash"), 256).alias("hash"), F.col("piece").alias("_own"))
    # the pieces of a file first: most files have one
    top = top.groupBy("file", "piece", "slot").agg(F.count("*").alias("n"), F.sum(F.conv(F.substring("hash", 1, 15), 16, 10).cast("decimal(38,0)")).alias("a"), F.sum(F.conv(F.substring("hash", 16, 15), 16, 10).cast("decimal(38,0)")).alias("b"))
    top = top.select("file", "piece", "slot", F.sha2(F.concat_ws(" ", *(F.col(c).cast("string") for c in ("n", "a", "b"))), 256).alias("hash"))
    while True:
        n, only = top.agg(F.count("*"), F.first("hash")).first()
        if n <= 1:
            return only
        if n <= FAN_OUT:  # negative and positive ranges never meet by division
            top = top.withColumn("slot", F.row_number().over(Window.orderBy("slot")) - 1)
        top = _above(top)


def audit(left: list[DataFrame], right: list[DataFrame]) -> DataFrame:
    """(file, page_id, piece, at, length, digest, status, copies) of every record at which two replicas differ.

    ``changed`` is a record of the left replica that the right one has otherwise, with the place that the right
    one has it at; ``missing`` and ``added`` are records of ids whose others agree; ``moved`` one that lies elsewhere
    among the records that both have, with its place in the right replica. Where an id has several differing records,
    each of the left is changed or missing, and the right's are added if they are more.
    """
    if root(left) == root(right):
        return left[0].where("false").select("file", "page_id", "piece", "at", "length", "digest", F.lit("").alias("status"), F.lit(0).cast("bigint").alias("copies"))
    within = None
    for depth in range(len(left) - 1, 0, -1):
        a, b = left[depth], right[depth]
        if within is not None:
            near = within.withColumnRenamed("slot", "_up")
            a, b = (x.withColumn("_up", F.floor(F.col("slot") / FAN_OUT).cast("bigint")).join(near, ["file", "piece", "_up"], "left_semi").drop("_up") for x in (a, b))
        both = a.alias("a").join(b.alias("b"), LEAF, "full_outer").where(~F.col("a.hash").eqNullSafe(F.col("b.hash")))
        within = stored(both.select(*LEAF), "within")
    # equal records of a leaf are told apart by their order; a window is a file's records at most
    copy = F.row_number().over(Window.partitionBy(*LEAF, "digest").orderBy("at"))
    sides = [levels[0].join(within, LEAF, "left_semi").withColumn("_copy", copy) for levels in (left, right)]
    key = [*LEAF, "digest", "_copy"]
    place = F.struct("at", "length", "page_id")
    a, b = (side.select(*key, place.alias(n)) for side, n in zip(sides, ("a", "b"), strict=True))
    both = stored(a.join(b, key, "full_outer"), "matched")
    rank = lambda side: F.row_number().over(Window.partitionBy("file", "piece").orderBy(f"{side}.at"))
    kept = both.where("a is not null and b is not null").withColumns({"_a": rank("a"), "_b": rank("b")}).where("_a <> _b")
    moved = kept.select("file", F.col("b.page_id").alias("page_id"), "piece", F.col("b.at").alias("at"), F.col("b.length").alias("length"), "digest", F.lit("moved").alias("status"), F.lit(1).cast("bigint").alias("copies"))
    differ = both.where("a is null or b is null")
    total = differ.groupBy(*LEAF).agg(F.count("a").alias("lost"), F.count("b").alias("new"), F.min("b").alias("there"))
    one = differ.groupBy(*LEAF, "digest").agg(F.min("a").alias("a"), F.min("b").alias("b"), F.count("a").alias("n_a"), F.count("b").alias("n_b")).join(total, LEAF)
    shown = lambda at, status, copies: ("file", at["page_id"].alias("page_id"), "piece", at["at"].alias("at"), at["length"].alias("length"), "digest", status.alias("status"), F.col(copies).alias("copies"))
    lost = one.where("n_a > 0").select(*shown(F.coalesce("there", "a"), F.when(F.col("new") > 0, "changed").otherwise("missing"), "n_a"))
    new = one.where("n_b > 0 and new > lost").select(*shown(F.col("b"), F.lit("added"), "n_b"))
    return lost.union(new).union(moved)
