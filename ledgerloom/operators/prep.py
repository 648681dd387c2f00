"""Rows made ready for training and for reading: weak labels, sanitised payloads, splits, and labels of figures.

Splits and subsamples are exact in size and deterministic: rows are ordered by a hash of their key inside hash buckets
that are counted first, so the cut falls into one bucket of a class and only that one is ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalar import let

BUCKETS = 4096
LARGEST = 1e9


def weak_label(label: Column, action: Column) -> Column:
    """The label that is given, else whether the rules held the payment."""
    return F.coalesce(label.cast("int"), F.coalesce((action == "hold").cast("int"), F.lit(0)))


def sanitised(payload: Column, allowed: list[str]) -> Column:
    """The allowed fields of a JSON object that are finite numbers, clamped to ``LARGEST``; anything else is dropped."""

    def number(part: Column) -> Column:
        kind = F.schema_of_variant(part).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
        return let(F.when(kind, F.try_variant_get(part, "$", "double")), lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), x))))

    def picked(parsed: Column) -> Column:
        return F.array(*(F.struct(F.lit(n).alias("k"), let(F.try_variant_get(parsed, f"$.{n}", "variant"), number).alias("v")) for n in allowed))

    return F.map_from_entries(F.filter(let(F.try_parse_json(payload), picked), lambda p: p["v"].isNotNull()))


def described(fields: Column, allowed: list[str]) -> Column:
    """``name=value`` of the fields in the order of ``allowed``; no text of a caller is in it."""
    parts = let(fields, lambda held: F.array(*(F.concat(F.lit(f"{n}="), F.try_element_at(held, F.lit(n)).cast("string")) for n in allowed)))
    return let(F.array_join(parts, ", "), lambda text: F.when(text == "", "no structured features supplied").otherwise(text))


def first_of_each(rows: DataFrame, by: str, key: list[str], sizes: Column, salt: str = "split") -> DataFrame:
    """``rows`` with ``chosen``: of every class exactly ``sizes`` rows (an expression of its count ``n``), by hash of the key.

    Rows that share a key are told apart by all their columns; rows that are equal count each.
    """
    h = F.xxhash64(F.lit(salt), *key)
    held = rows.withColumns({"_h": h, "_bucket": F.shiftrightunsigned(h, 52).cast("int")})
    counts = held.groupBy(by, "_bucket").agg(F.count("*").alias("_c"))
    over = Window.partitionBy(by).orderBy("_bucket")  # BUCKETS rows a class
    counts = counts.withColumns({"_before": F.coalesce(F.sum("_c").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("_c").over(Window.partitionBy(by))})
    counts = counts.withColumn("_take", sizes.cast("bigint") - F.col("_before")).select(F.col(by).alias("_by"), F.col("_bucket").alias("_b"), "_c", "_take")
    met = held.join(F.broadcast(counts.where("_take > 0")), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_bucket") == F.col("_b")), "left")
    cut = F.row_number().over(Window.partitionBy(by, "_bucket").orderBy("_h", *rows.columns))
    whole = met.where("_take is null or _take >= _c").withColumn("chosen", F.col("_take").isNotNull())
    part = met.where("_take < _c").withColumn("chosen", cut <= F.col("_take"))
    return whole.union(part).select(*rows.columns, "chosen")


def stratified_split(rows: DataFrame, label: str, key: list[str], test_share: float) -> DataFrame:
    """``rows`` with ``test``: of every class the rounded share, at least one row."""
    size = F.greatest(F.lit(1), F.bround(F.col("n") * test_share))
    return first_of_each(rows, label, key, size).withColumnRenamed("chosen", "test")


def subsampled(rows: DataFrame, label: str, key: list[str], total: int) -> DataFrame:
    """All positives, and as many others as make ``total`` rows (at least one); all rows where there are fewer."""
    counts = rows.agg(F.count("*").alias("rows"), F.count_if(F.col(label) == 1).alias("positives")).first()
    if total >= counts["rows"]:
        return rows
    negatives = max(1, total - counts["positives"])
    size = F.when(F.col(label) == 1, F.col("n")).otherwise(F.least(F.col("n"), F.lit(negatives)))
    return first_of_each(rows.where(f"{label} is not null"), label, key, size, "sub").where("chosen").drop("chosen")


def pounds(amount: Column) -> Column:
    """Pounds without pence, thousands parted by commas."""
    return F.concat(F.when(amount < 0, "-").otherwise(""), F.lit("£"), F.format_number(F.abs(F.floor(amount + 0.5)), 0))


def compact(amount: Column) -> Column:
    """1.2k, 3.4m: one decimal from a thousand on."""
    size = F.abs(amount)
    short = lambda unit, letter: F.concat(F.format_string("%.1f", F.floor(amount / unit * 10 + 0.5) / 10), F.lit(letter))
    return F.when(size >= 1e6, short(1e6, "m")).when(size >= 1e3, short(1e3, "k")).otherwise(F.floor(amount + 0.5).cast("string"))


def duration(hours: Column) -> Column:
    """Hours under two days, else days; over the limit of 100 hours the fraud was not detected."""
    return F.when(hours > 100, "not detected").when(hours < 48, F.concat(F.floor(hours + 0.5).cast("string"), F.lit("h"))).otherwise(F.concat(F.floor(hours / 24 + 0.5).cast("string"), F.lit("d")))


def percent(share: Column) -> Column:
    return F.concat(F.floor(share * 100 + 0.5).cast("string"), F.lit("%"))


def points(lift: Column) -> Column:
    """A difference of shares in signed percentage points."""
    whole = F.floor(lift * 100 + 0.5)
    return F.concat(F.when(whole >= 0, "+").otherwise(""), whole.cast("string"), F.lit(" pts"))


def day(seconds: Column) -> Column:
    """The UTC day of an epoch; empty for 0 and null."""
    return F.when(F.coalesce(seconds, F.lit(0)) == 0, "").otherwise(F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")), "yyyy-MM-dd"))
