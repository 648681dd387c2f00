"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, chat, decontam, fim, jaccard, langid, lattice, lexical, merges, secrets, token_files, toxicity, warc
from ledgerloom.llm.shared import fresh_path
from ledgerloom.session import table

END_ID = 2
WORD_VOCABULARY = 49_408


def _held_out() -> Column:
    """The rows never learned from; null ids are among them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True)).alias("held_out")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs.join(labels, "doc_id").where(~_held_out()))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", _held_out(), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~_held_out()))
    found = langid.predict(docs, model)
    return found.select("doc_id", _held_out(), "lang_pred", "score", "rejected")


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of WARC files in which one byte of every page with an id divisible by 97 has changed."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    flipped = F.concat(F.substring("html", F.lit(1), F.length("html") - 1), F.lit("~"))
    replica = pages.withColumn("html", F.when(F.col("page_id") % 97 == 0, flipped).otherwise(F.col("html")))
    trees = []
    for stored_pages in (pages, replica):
        folder = fresh_path(spark, "warc")
        warc.write_warc(stored_pages, folder)
        trees.append(warc.tree(warc.stored_records(spark, folder)))
    found = warc.audit(*trees)
    return found.select("file", "page_id", "at", "length", "status")


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = bpe.codec_for(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    found = bpe.encode(table(spark, sf_dir, "documents"), codec, decoded=True)
    return found.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), secrets.fit(spark))
    return found.select("doc_id", "at", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), "probability", "is_secret")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(fixed).alias("text"))
    empty = F.lit(None)
    part = F.struct(F.lit("text").alias("kind"), F.col("text"), empty.cast("string").alias("ref"), empty.cast("int").alias("width"), empty.cast("int").alias("height"), empty.cast("double").alias("seconds"), empty.cast("int").alias("pages"))
    formatted = chat.format_conversations(rows.union(extra).withColumn("parts", F.array(part)))
    turns = chat.read_turns(formatted.withColumn("_key", F.struct("conv_id", F.length("formatted").alias("chars"))), "_key")
    one = F.struct("pos", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("turn"), F.coalesce("loss_text", F.lit("")).alias("loss"))
    back = turns.groupBy("_key").agg(F.sort_array(F.collect_list(one)).alias("l"))
    loss = F.concat_ws("", F.col("l.loss"))
    return back.select(
        F.col("_key.conv_id").alias("conv_id"),
        F.size("l").cast("bigint").alias("n_turns"),
        F.sha2(F.concat_ws("", F.col("l.turn")), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.col("_key.chars").cast("bigint").alias("formatted_chars"),
    )


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID, WORD_VOCABULARY)
    return token_files.read(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = fim.transform(table(spark, sf_dir, "documents"), restored=True)
    return moved.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_merge_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = merges.codec_for(spark, public_tokenizers.path("word_bpe_49k.json"))
    found = merges.encode(table(spark, sf_dir, "documents"), codec, decoded=True)
    return found.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_toxicity": op2_toxicity,
    "op3_decontamination": op3_decontamination,
    "op4_language_id": op4_language_id,
    "op5_warc_fixity": op5_warc_fixity,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_secret_scan": op8_secret_scan,
    "op9_chat_format": op9_chat_format,
    "op10_token_files": op10_token_files,
    "op11_lexical_search": op11_lexical_search,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_merge_bpe": op13_merge_bpe,
}

#: Shingle sets as lists of strings; links are verified pairs that share a shingle or are equal.
_OP1 = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN words IS NULL OR len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' '))) END AS s FROM w
), classes AS (
    SELECT min(doc_id) AS rep, len(s) AS n, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s), len(s)
), tokens AS (
    SELECT rep, n, hash(unnest(s)) AS g FROM classes
), overlap AS (
    SELECT a.rep AS x, b.rep AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS common FROM tokens a JOIN tokens b ON a.g = b.g AND a.rep < b.rep GROUP BY 1, 2
), links AS (
    SELECT x, y FROM overlap WHERE 100 * common >= 75 * (nx + ny - common)
), edges AS (
    SELECT x, y FROM links UNION SELECT y, x FROM links
), walk AS (
    SELECT rep AS node, rep AS root FROM classes
    UNION
    SELECT e.y, walk.root FROM walk JOIN edges e ON e.x = walk.node
), roots AS (
    SELECT node, min(root) AS root FROM walk GROUP BY node
)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(roots.root, sets.doc_id) AS component_id
FROM sets LEFT JOIN classes ON len(sets.s) > 0 AND list_sort(sets.s) = classes.s LEFT JOIN roots ON roots.node = classes.rep
"""

_OP5 = """
WITH r AS (
    SELECT page_id, floor(page_id / 4096)::BIGINT AS file,
        strlen('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url
            || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html)) + 8 + strlen(html) AS length
    FROM pages
), p AS (
    SELECT *, coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_byte FROM r
)
SELECT file, page_id, at_byte::BIGINT AS "at", length::BIGINT AS length, 'changed' AS status FROM p WHERE page_id % 97 = 0
"""

_OP6 = """
WITH RECURSIVE e AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), links AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), walk AS (
    SELECT vec_id AS node, vec_id AS root FROM embeddings
    UNION
    SELECT links.y, walk.root FROM walk JOIN links ON links.x = walk.node
), roots AS (SELECT node, min(root) AS root FROM walk GROUP BY node), n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT node AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, root AS component_id, node = root AS kept FROM roots LEFT JOIN n ON n.x = node
"""

_OP9 = r"""
WITH c AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
    SELECT *, length(replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|')) AS escaped FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(escaped + length(role) + 17)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

#: Every document that shares a term with an item is scored.
_OP11 = r"""
WITH w AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), d AS (SELECT doc_id, words, len(words)::BIGINT AS n FROM w WHERE len(words) > 0), totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM d
), q AS (
    SELECT item_id, term, count(*)::BIGINT AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
    ) GROUP BY ALL
), p AS (
    SELECT doc_id, any_value(n) AS n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term
), f AS (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term
), s AS (
    SELECT p.doc_id, p.term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))) AS score
    FROM p JOIN f USING (term), totals
), r AS (
    SELECT item_id, doc_id, sum(times * score)::BIGINT AS score FROM q JOIN s USING (term) GROUP BY ALL
), t AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0)
SELECT * FROM t WHERE rank <= 10
"""

#: The cuts as numbers of code points; the restored text is the text.
_OP12 = """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), r AS (
    SELECT *, ('0x' || substr(h, 1, 8))::UBIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::UBIGINT % (n + 1) AS b,
        ('0x' || substr(h, 17, 8))::UBIGINT % 100 AS share, ('0x' || substr(h, 25, 8))::UBIGINT % 100 AS spm FROM d
), f AS (
    SELECT *, CASE WHEN n = 0 OR text LIKE '%<P>%' OR text LIKE '%<S>%' OR text LIKE '%<M>%' OR share >= 90 THEN 'plain' WHEN spm < 20 THEN 'spm' ELSE 'psm' END AS form,
        substring(text, 1, least(a, b)::BIGINT) AS p, substring(text, least(a, b)::BIGINT + 1, (greatest(a, b) - least(a, b))::BIGINT) AS m, substring(text, greatest(a, b)::BIGINT + 1) AS s FROM r
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM f
"""

ORACLE: dict[str, str] = {"op1_ngram_jaccard": _OP1.replace("\\\\", "\\"), "op5_warc_fixity": _OP5, "op6_embedding_near_dedup": _OP6, "op9_chat_format": _OP9, "op11_lexical_search": _OP11.replace("\\\\", "\\"), "op12_fill_in_middle": _OP12}
