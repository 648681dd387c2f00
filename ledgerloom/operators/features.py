"""Transaction features: the ten-column contract, standardisation and fixed-weight scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.scalar import sigmoid, weighted
from ledgerloom.session import table

#: Fixed order of the feature contract.
FEATURES = ("amount", "old_orig", "new_orig", "old_dest", "new_dest", "account_age", "velocity", "fanout", "is_transfer", "campaign_sig")
#: The same features by the names that callers use, and other names for them.
CONTRACT = ("amount", "oldOrig", "newOrig", "oldDest", "newDest", "accountAge", "velocity", "fanout", "isTransfer", "campaignSig")
ALIASES = {
    "account_age": "accountAge", "velocity_1h": "velocity", "is_new_payee": "isTransfer", "is_transfer": "isTransfer", "campaign_signature": "campaignSig",
    "campaign_sig": "campaignSig", "old_orig": "oldOrig", "new_orig": "newOrig", "old_dest": "oldDest", "new_dest": "newDest",
}
#: What a campaign signature does to the vector, besides its own place.
CAMPAIGN = {"amount": -0.5, "velocity": -0.5, "fanout": -0.5, "accountAge": -2.0}
WEIGHTS = [0.8, -0.3, 0.5, 0.2, -0.4, -0.25, 0.35, 0.6, 0.15, 0.9]
BIAS = -0.5


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each line item: its keys, bank (region of the customer), ten raw features and label y.

    Customer statistics are aggregated before they are joined, so the fact table is shuffled by order and
    customer only; nation is joined last and is small by nature.
    """
    orders = table(spark, sf_dir, "orders")
    items = table(spark, sf_dir, "lineitem")
    joined = items.join(orders, items.l_orderkey == orders.o_orderkey)
    by_customer = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_order"), F.count("*").alias("n_orders"))
    fanout = joined.groupBy("o_custkey").agg(F.countDistinct("l_suppkey").alias("n_suppliers"))
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    customers = customers.join(by_customer, F.col("c_custkey") == F.col("o_custkey")).drop("o_custkey").join(fanout, F.col("c_custkey") == F.col("o_custkey")).drop("o_custkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    rows = joined.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_custkey",
        F.col("n_regionkey").alias("bank"),
        F.col("l_extendedprice").alias("amount"),
        F.col("c_acctbal").alias("old_orig"),
        (F.col("c_acctbal") - F.col("o_totalprice")).alias("new_orig"),
        F.col("s_acctbal").alias("old_dest"),
        (F.col("s_acctbal") + F.col("l_extendedprice")).alias("new_dest"),
        F.datediff("o_orderdate", "first_order").cast("double").alias("account_age"),
        F.col("n_orders").cast("double").alias("velocity"),
        F.col("n_suppliers").cast("double").alias("fanout"),
        (F.col("l_linestatus") == "O").cast("double").alias("is_transfer"),
        F.when(F.col("l_tax") == 0, 1.5).otherwise(0.0).alias("campaign_sig"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )


def standardise(df: DataFrame, columns: tuple[str, ...] = FEATURES, floor: float | None = None) -> DataFrame:
    """Each column less its mean, over its population standard deviation.

    Without ``floor`` a zero deviation counts as one; with it a deviation up to ``floor`` only centres. One
    aggregate row is joined back: no window over everything.
    """
    stats = df.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s_{c}") for c in columns))
    out = df.crossJoin(F.broadcast(stats))
    for c in columns:
        spread = F.col(f"_s_{c}")
        flat = spread == 0 if floor is None else spread <= floor
        out = out.withColumn(c, (F.col(c) - F.col(f"_m_{c}")) / F.when(flat, 1.0).otherwise(spread))
    return out.drop(*(f"_{k}_{c}" for c in columns for k in "ms"))


def scored(df: DataFrame, digits: int | None = 4) -> DataFrame:
    """Adds ``score``, the logistic of the fixed weights; rounded, so that ties are well defined."""
    score = sigmoid(weighted([F.col(c) for c in FEATURES], WEIGHTS, BIAS))
    return df.withColumn("score", F.round(score, digits) if digits is not None else score)


def named_vector(named: Column, number) -> Column:
    """The ten features of a map of names to texts: unknown names are passed over, unreadable numbers are 0.

    A campaign signature alone sets its own place to 1.5 times its value and four others to a fixed shape.
    """
    plain = F.transform_keys(named, lambda k, v: F.coalesce(F.get(F.filter(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ALIASES.items())), lambda x: x["a"] == k), F.lit(0))["b"], k))
    value = {name: number(F.try_element_at(plain, F.lit(name)), 0.0) for name in CONTRACT}
    sig = F.coalesce(F.try_element_at(plain, F.lit("campaignSignature")), F.try_element_at(plain, F.lit("campaignSig")))
    signed = sig.isNotNull()
    value["campaignSig"] = F.when(signed, 1.5 * number(sig, 1.0)).otherwise(value["campaignSig"])
    for name, fixed in CAMPAIGN.items():
        value[name] = F.when(signed, F.lit(fixed)).otherwise(value[name])
    return F.array(*(value[name] for name in CONTRACT))
