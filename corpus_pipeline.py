"""A corpus pipeline: toxic documents go, near copies go, benchmark passages go, secrets are masked, text is encoded.

Every stage works on all that the one before kept, which is written to the shared folder and read again.
Rows are told apart by a key that the first stage gives and all but the last pass on, so ids may be null or repeated:
every row is judged by its own text. Null and empty texts pass the filters and are encoded as empty text; of repeated
rows with words one stays; of rows that tie the one of the smallest id stays, then of the smallest key. Texts of any
length are judged whole, columns of any other name pass through, and empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, decontam, jaccard, secrets, toxicity
from ledgerloom.llm.shared import BROADCAST_KEYS, ROW_KEY, drop_ids, keyed, stored
from ledgerloom.session import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under one half."""
    docs = keyed(docs)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    rows = docs.select("doc_id", "text")
    model = toxicity.fit(rows.join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    toxic = stored(toxicity.score(docs, model, ROW_KEY).where("score >= 0.5").select(ROW_KEY), "toxic")
    return drop_ids(docs, toxic, ROW_KEY)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked rows: that of the smallest id, null ids last, then of the smallest key."""
    docs = keyed(docs)
    links = stored(jaccard.link(docs, ROW_KEY).where(F.col(ROW_KEY) != F.col("component_id")).select(ROW_KEY, "component_id"), "links")
    heads = links.select(F.col("component_id").alias(ROW_KEY), "component_id").distinct()
    members = stored(links.union(heads), "members")  # groups of several rows only
    side = F.broadcast(members) if members.count() <= BROADCAST_KEYS else members
    order = F.struct(F.col("doc_id").isNull().alias("_no_id"), "doc_id", ROW_KEY)
    best = docs.select("doc_id", ROW_KEY).join(side, ROW_KEY).groupBy("component_id").agg(F.min(order).alias("_best"))
    best = stored(best.select(F.col(f"_best.{ROW_KEY}").alias(ROW_KEY)), "best")
    copies = stored(drop_ids(members.select(ROW_KEY), best, ROW_KEY), "copies")
    return drop_ids(docs, copies, ROW_KEY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    docs = keyed(docs)
    found = stored(decontam.find(docs, table(spark, sf_dir, "benchmark"), ROW_KEY).select(ROW_KEY).distinct(), "leaks")
    return drop_ids(docs, found, ROW_KEY)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; ``n_chars`` follows the text."""
    clean = secrets.redact(keyed(docs), secrets.fit(spark))
    return clean.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document and digests of them and of what they decode to."""
    codec = bpe.codec_for(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = bpe.encode(docs, codec, decoded=True)
    return rows.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        "ids",
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("byte_bpe", encode),
]

#: Classifiers and tokenizers take part in every row, so SQL cannot express the pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
