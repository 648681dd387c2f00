"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is an array of parts (kind, text, ref, width, height, seconds, pages). A visitor flattens
the parts in order: text stays, an image, audio or document part becomes a placeholder that names its place
among the conversation's attachments, and the attachment's reference and expanded token count are recorded.

Template of a turn: ``<|turn|>`` role newline content ``<|end|>`` newline. Inside roles and texts a backslash is
doubled and ``<|`` becomes ``<\\|``; undoing both from left to right gives the text again, and no text can form
a marker. The loss mask covers the content of assistant turns: ``spans`` holds, in code points of the
formatted string, the start and length of each turn's content and whether it bears loss.

Defined results: null text and null parts are empty, a null role is the empty role; turns are ordered by
turn number (nulls first), then role, then content, repeated rows included; rows with a null conversation
id form one conversation. A conversation is one value by nature: its turns meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
TURN, END = "<|turn|>", "<|end|>\n"
KINDS = ("image", "audio", "document")
PATCH, AUDIO_TOKENS_PER_SECOND, TOKENS_PER_PAGE = 28, 25, 768


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """A content array of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text")).cast("struct<kind:string,text:string>")).cast("array<struct<kind:string,text:string>>")


def expanded_tokens(part: Column) -> Column:
    """Tokens that a model spends on an attachment: image patches, audio frames or document pages."""
    patches = F.ceil(F.coalesce(part["width"], F.lit(0)) / PATCH) * F.ceil(F.coalesce(part["height"], F.lit(0)) / PATCH)
    return (
        F.when(part["kind"] == "image", patches)
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_TOKENS_PER_SECOND))
        .when(part["kind"] == "document", F.coalesce(part["pages"], F.lit(0)) * TOKENS_PER_PAGE)
        .otherwise(F.lit(0))
        .cast("bigint")
    )


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """(conv, n_turns, formatted, spans, attachments) of every conversation.

    ``parts_col`` is an array of ``PART``. spans: start, length, role, loss; attachments: ref, kind, turn
    (its place from 0) and tokens, in the order of their placeholders.
    """
    parts = F.coalesce(F.col(parts_col).cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>"))
    media = lambda p: p["kind"].isin(*KINDS)
    rows = df.select(F.col(conv_col).alias("_c"), F.col(turn_col).alias("_t"), F.coalesce(role_col, F.lit("")).alias("_r"), parts.alias("_p"))
    rows = rows.withColumn("_k", F.to_json("_p")).withColumn("_m", F.filter("_p", media))
    order = Window.partitionBy("_c").orderBy(F.col("_t").asc_nulls_first(), "_r", "_k")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_n", F.row_number().over(order)).withColumn("_a", F.coalesce(F.sum(F.size("_m")).over(before), F.lit(0)))
    mark = lambda p, i: F.concat(F.lit("<|"), p["kind"], F.lit(":"), (F.col("_a") + F.size(F.filter(F.slice(F.col("_p"), 1, i), media))).cast("string"), F.lit("|>"))
    content = F.concat_ws("", F.transform("_p", lambda p, i: F.when(media(p), mark(p, i)).otherwise(escape(p["text"]))))
    rows = rows.withColumn("_x", content).withColumn("_h", F.concat(F.lit(TURN), escape(F.col("_r")), F.lit("\n")))
    rows = rows.withColumn("_s", F.coalesce(F.sum(F.length("_h") + F.length("_x") + len(END)).over(before), F.lit(0)))
    attached = F.transform("_m", lambda p: F.struct(p["ref"].alias("ref"), p["kind"].alias("kind"), (F.col("_n") - 1).cast("int").alias("turn"), expanded_tokens(p).alias("tokens")))
    one = F.struct(
        F.col("_n").alias("n"),
        F.concat("_h", "_x", F.lit(END)).alias("piece"),
        F.struct((F.col("_s") + F.length("_h")).cast("bigint").alias("start"), F.length("_x").cast("bigint").alias("length"), F.col("_r").alias("role"), (F.col("_r") == "assistant").alias("loss")).alias("span"),
        attached.alias("attached"),
    )
    whole = rows.groupBy("_c").agg(F.sort_array(F.collect_list(one)).alias("_l"))
    return whole.select(
        F.col("_c").alias(conv_col),
        F.size("_l").cast("bigint").alias("n_turns"),
        F.concat_ws("", F.col("_l.piece")).alias("formatted"),
        F.col("_l.span").alias("spans"),
        F.flatten("_l.attached").alias("attachments"),
    )


def read_turns(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv, pos, role, text, loss, loss_text) of every turn, parsed back from the formatted string.

    Role and text come from the string alone; ``loss_text`` is cut from the turn at its loss span. Texts are
    unescaped; placeholders stay as they are. Nothing is shuffled: each conversation is split where it is.
    """
    # splitting by the turn marker leaves an empty string first; the spans are in the order of the turns
    pieces = F.slice(F.split("formatted", r"<\|turn\|>", -1), 2, F.size("spans"))
    rows = formatted.select(conv_col, F.posexplode(F.arrays_zip(pieces.alias("piece"), F.col("spans").alias("span"))).alias("pos", "one"))
    piece, span = F.col("one.piece"), F.col("one.span")
    before = Window.partitionBy(conv_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_begin", F.coalesce(F.sum(F.length(piece) + len(TURN)).over(before), F.lit(0)) + len(TURN))
    role_end = F.instr(piece, "\n")
    role = F.regexp_extract(piece, r"(?s)^(.*?)\n", 1)
    body = F.substring(piece, role_end + 1, F.length(piece) - role_end - len(END))
    cut = F.substring(piece, (span["start"] - F.col("_begin") + 1).cast("int"), span["length"].cast("int"))
    return rows.select(conv_col, "pos", unescape(role).alias("role"), unescape(body).alias("text"), span["loss"].alias("loss"), F.when(span["loss"], unescape(cut)).alias("loss_text"))
