"""Secret scanning: pattern candidates kept or dropped by a random forest, in DataFrame functions only.

Candidates are quoted values (of any characters but blanks and that quote) or bare ones after a key word and ``=`` or
``:``, tokens with a well-known prefix and long runs of token characters, whatever stands beside the run; none has an
upper length, so a token is found and masked whole. A forest judges each from its length, its character transitions (class
changes, digits, repeated characters, bigrams common in words), its dictionary coverage (how much of it is
frequent words), path-like shape and neighbouring words, so that example values, hashes named as such, paths
and long words are dropped.

The forest is trained on ``labelled_findings``: labelled candidates made by a rule with hashed values, a
bounded number that does not depend on the data. Training is JVM-side; scoring stays in Catalyst.

Defined results: null and empty texts have no findings; repeated rows give repeated findings; a candidate
has its 0-based code-point offset; overlapping candidates are found once, leftmost first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.shared import ROW_KEY, keyed, stored

#: Words before a value that name a credential, in lower case.
KEYWORDS = ("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "api-key", "access_key", "auth", "credential", "private_key", "client_secret", "bearer")
#: Words near a candidate that say it is no secret.
HARMLESS = ("example", "sample", "placeholder", "dummy", "test", "sha256", "sha1", "md5", "checksum", "digest", "commit", "uuid", "version")
#: Letter pairs that are common in the words of European languages.
COMMON_PAIRS = ("th", "he", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar", "st", "to", "nt", "ng", "se", "ha", "as", "ou", "io", "le", "ve", "co", "me", "de", "hi", "ri", "ro", "ic", "ne", "ea", "ra", "ce", "li", "ch", "ll", "be", "ma", "si", "om", "ur")
#: Dictionary words that show up inside names and paths.
DICTIONARY = ("example", "changeme", "password", "secret", "token", "your", "here", "test", "sample", "user", "admin", "home", "src", "main", "lib", "config", "data", "file", "name", "value", "default", "null", "none", "true", "false", "key", "the", "and", "for", "with",
    "access", "account", "action", "address", "backup", "base", "branch", "build", "cache", "check", "class", "client", "code", "common", "content", "count", "create", "database", "debug", "demo", "deploy", "device", "dev",
    "document", "domain", "email", "enable", "error", "event", "folder", "form", "group", "host", "image", "index", "info", "input", "item", "java", "label", "last", "level", "limit", "line", "list", "local", "login", "mail", "master",
    "message", "model", "module", "new", "node", "number", "object", "option", "order", "output", "page", "path", "prod", "project", "public", "query", "release", "remote", "request", "resource", "result", "root", "script", "server",
    "service", "session", "setting", "source", "start", "state", "status", "storage", "string", "system", "table", "target", "task", "template", "text", "time", "title", "type", "update", "upload", "url", "version", "view", "web", "word")
#: The candidate pattern: (key word and separator)(value), a well-known prefix, or a long run.
CANDIDATE = (
    r"(?i:(?:" + "|".join(KEYWORDS) + r")[\w.-]{0,20}[\"']?\s{0,3}(?:=|:)\s{0,3}[\"']?)(?:(?<=\")[^\"\s]{8,}+(?=\")|(?<=')[^'\s]{8,}+(?=')|[A-Za-z0-9_+/=.~-]{8,}+)"
    r"|(?:AKIA|ASIA)[A-Z0-9]{16,}+|gh[pousr]_[A-Za-z0-9]{30,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[A-Za-z0-9_-]{35,}+|sk_live_[A-Za-z0-9]{16,}+"
    r"|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"
    r"|(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{32,}+"
)
AROUND = 40
FEATURES = ("length", "transitions", "digits", "uppers", "hexes", "repeats", "common", "coverage", "pathlike", "keyword", "harmless", "assigned", "prefix")


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, at, value, before, after) of every candidate of every whole text."""
    # the texts between the candidates give the offsets, so no position is looked up twice
    rows = df.select(F.col(id_col), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull() & F.col("_text").rlike(CANDIDATE))
    found = rows.select(id_col, F.regexp_extract_all("_text", F.lit(CANDIDATE), F.lit(0)).alias("_m"), F.split("_text", CANDIDATE, -1).alias("_gap"))
    one = F.posexplode(F.transform(F.col("_m"), lambda m, i: F.struct(m.alias("match"), F.element_at("_gap", i + 1).alias("gap"), F.element_at("_gap", i + 2).alias("next"))))
    rows = found.select(id_col, F.col("_m"), F.col("_gap"), one.alias("_i", "_one"))
    at = F.aggregate(F.slice(F.col("_gap"), F.lit(1), F.col("_i") + 1), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice(F.col("_m"), F.lit(1), F.col("_i")), F.lit(0), lambda a, x: a + F.length(x))
    match = F.col("_one.match")
    # the value is what follows the last separator or quote of the match; greedy key words end there
    value = F.when(match.rlike(r"(?i)^(?:" + "|".join(KEYWORDS) + ")"), F.regexp_extract(match, r"^[\w.-]*?[\"']?\s{0,3}[=:]\s{0,3}[\"']?(\S{8,}+)$", 1)).otherwise(match)
    value = F.when(value == "", match).otherwise(value)
    rows = rows.select(id_col, at.alias("_at"), match.alias("_match"), value.alias("value"), F.right(F.col("_one.gap"), F.lit(AROUND)).alias("_gap"), F.left(F.col("_one.next"), F.lit(AROUND)).alias("after"))
    lead = F.length("_match") - F.length("value")
    return rows.select(id_col, (F.col("_at") + lead).cast("int").alias("at"), "value", F.concat("_gap", F.substring("_match", F.lit(1), lead)).alias("before"), "after")


def _share(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / F.greatest(F.length(text), F.lit(1))


def features(df: DataFrame) -> DataFrame:
    """Adds the forest's inputs to candidates."""
    v, low = F.col("value"), F.lower("value")
    kinds = F.translate(v, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "a" * 26 + "A" * 26 + "9" * 10)
    runs = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1"))
    context = F.lower(F.concat("before", F.lit(" "), "after"))
    n = F.greatest(F.length(v), F.lit(1))
    return df.withColumns(
        {
            "length": F.length(v).cast("double"),
            "transitions": (runs / n).cast("double"),
            "digits": _share(v, "[0-9]"),
            "uppers": _share(v, "[A-Z]"),
            "hexes": _share(low, "[0-9a-f]"),
            "repeats": _share(low, r"(.)\1+"),
            "common": _share(low, "|".join(COMMON_PAIRS)),
            "coverage": _share(low, "|".join(DICTIONARY)),
            "pathlike": (F.length(v) - F.length(F.regexp_replace(v, r"[/.]", ""))).cast("double"),
            "keyword": F.lower("before").rlike("|".join(KEYWORDS)).cast("double"),
            "harmless": context.rlike(r"(^|[^a-z.@])(" + "|".join(HARMLESS) + r")([^a-z.@]|$)").cast("double"),
            "assigned": F.rtrim("before").rlike(r"[=:]\s{0,3}[\"']?$").cast("double"),
            "prefix": v.rlike(r"^(AKIA|ASIA|gh[pousr]_|xox[abprs]-|AIza|sk_live_|eyJ)").cast("double"),
        }
    )


def labelled_findings(spark: SparkSession, per_kind: int = 120) -> DataFrame:
    """(value, before, after, label): labelled findings of every kind, values drawn from hashes of a counter."""
    hexes = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("i").cast("string")), 256)
    b64 = lambda salt: F.regexp_replace(F.base64(F.unhex(hexes(salt))), r"[=\n\r]", "")
    pick = lambda salt, *options: F.element_at(F.array(*(F.lit(x) for x in options)), F.pmod(F.xxhash64(F.lit(salt), "i"), F.lit(len(options))).cast("int") + 1)
    span = lambda salt, lo, hi: (F.pmod(F.xxhash64(F.lit(salt), "i"), F.lit(hi - lo + 1)) + lo).cast("int")
    cut = lambda text, n: F.substring(text, F.lit(1), n)
    maybe_upper = lambda text: F.when(F.col("i") % 3 == 0, F.upper(text)).otherwise(text)
    prose = pick("prose", "the value of ", "and in ", "est de la ", "und der ", "es de las ", "")
    tail = pick("tail", " and more", " of the", "", "\" the", ", la", ".")
    join = F.element_at(F.array(F.lit("_"), F.lit("-"), F.lit("/"), F.lit("")), F.pmod(F.xxhash64(F.lit("j"), "i"), F.lit(4)).cast("int") + 1)
    word = [pick(f"w{k}", *DICTIONARY, "stream", "thing", "there", "ration", "mention", "entire", "hand", "order") for k in range(5)]
    words = F.concat(word[0], *(x for w in word[1:] for x in (join, w)))
    key = F.concat(prose, pick("key", *KEYWORDS), pick("sep", " = \"", "=\"", ": ", "=", " = '"))
    plain = F.concat(prose, pick("plain", "id ", "ref: ", "see ", "version ", "", "the "))
    note = F.concat(prose, pick("note", *HARMLESS), pick("notesep", " ", ": ", " = \""))
    kinds = [
        (maybe_upper(cut(hexes("a"), span("al", 24, 64))), key, tail, 1),
        (maybe_upper(cut(hexes("o"), span("ol", 32, 40))), key, F.concat(tail, F.lit(" "), pick("near", *HARMLESS)), 1),
        (cut(b64("b"), span("bl", 16, 43)), key, tail, 1),
        (F.concat(F.lit("AKIA"), F.upper(cut(hexes("c"), F.lit(16)))), pick("cb", "", "key ", "aws_access_key_id = "), tail, 1),
        (F.concat(pick("gh", "ghp_", "gho_", "sk_live_"), cut(b64("d"), F.lit(36))), pick("db", "", "see ", "token: "), tail, 1),
        (F.concat(F.lit("xoxb-"), cut(hexes("e"), span("el", 20, 40))), pick("eb", "", "slack "), tail, 1),
        (F.concat(F.lit("eyJ"), b64("f"), F.lit("."), b64("g"), F.lit("."), b64("h")), pick("fb", "", "Authorization: Bearer "), tail, 1),
        (F.concat(cut(b64("s"), span("sl", 5, 10)), pick("s1", "!", "@", "#", "$"), cut(hexes("t"), span("tl", 3, 8)), pick("s2", "%", "*", "&", "?")), F.concat(prose, pick("key2", *KEYWORDS), pick("sep2", ' = "', '="', ': "')), F.concat(F.lit('"'), tail), 1),
        (pick("ph2", "<your-password>", "${PASSWORD}", "{{secret_value}}", "<insert-token-here>", "%(password)s", "$TOKEN_VALUE", "********", "<change-me!>"), key, F.concat(F.lit('"'), tail), 0),
        (words, key, tail, 0),
        (pick("ph", "changeme", "xxxxxxxxxxxx", "your_token_here", "password123", "00000000000000000000", "placeholder_value", "undefined", "************", "aaaaaaaaaaaaaaaaaaaa"), key, tail, 0),
        (cut(hexes("k"), pick("kl", *(32, 40, 64))), note, tail, 0),
        (words, plain, tail, 0),
        (F.concat_ws("/", words, cut(hexes("l"), F.lit(8)), words), plain, tail, 0),
        (F.translate(cut(hexes("m"), span("ml", 32, 48)), "abcdef", "012345"), plain, tail, 0),
        (cut(hexes("n"), F.lit(32)), plain, tail, 0),
    ]
    base = spark.range(per_kind).select(F.col("id").alias("i"))
    out = None
    for value, before, after, label in kinds:
        rows = base.select(value.alias("value"), F.right(before, F.lit(AROUND)).alias("before"), after.alias("after"), F.lit(float(label)).alias("label"))
        out = rows if out is None else out.union(rows)
    return out


def fit(spark: SparkSession, per_kind: int = 120, trees: int = 12, depth: int = 6):
    """The forest as (tree votes as one SQL expression), trained on the labelled findings."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="_x").transform(features(labelled_findings(spark, per_kind))).select("_x", "label").coalesce(1)
    return RandomForestClassifier(featuresCol="_x", labelCol="label", numTrees=trees, maxDepth=depth, seed=11).fit(rows)


def scan(df: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, at, value, before, after, probability, is_secret) of every candidate."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = features(candidates(df, id_col, text_col))
    judged = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="_x").transform(rows))
    judged = judged.withColumn("probability", vector_to_array("probability")[1])
    return judged.select(id_col, "at", "value", "before", "after", F.round("probability", 6).alias("probability"), (F.col("probability") >= threshold).alias("is_secret"))


def redact(df: DataFrame, model, text_col: str = "text", mark: str = "[SECRET]", broadcast_rows: int = 200_000) -> DataFrame:
    """``df`` with every secret in its text replaced by ``mark``; all rows and columns stay.

    The places of the secrets are joined back by a row key, so ids may be null or repeated; they are broadcast
    only when their counted rows are few.
    """
    rows = keyed(df)
    own = scan(rows, model, ROW_KEY, text_col).where("is_secret")
    held = "_places" + "_" * max(map(len, df.columns))  # no column of the caller has this name
    places = own.select(ROW_KEY, F.struct("at", F.length("value").alias("n")).alias("_place")).groupBy(ROW_KEY)
    found = stored(places.agg(F.sort_array(F.collect_set("_place"), asc=False).alias(held)), "secrets")  # one text's secrets
    side = F.broadcast(found) if found.count() <= broadcast_rows else found
    text = F.col(text_col)
    cut = lambda t, p: F.concat(F.left(t, p["at"]), F.lit(mark), F.substring(t, p["at"] + p["n"] + 1, F.length(t)))
    clean = F.when(F.col(held).isNull(), text).otherwise(F.aggregate(F.col(held), text, cut))
    out = rows.join(side, ROW_KEY, "left").withColumn(text_col, clean)
    return out.select(*df.columns)
