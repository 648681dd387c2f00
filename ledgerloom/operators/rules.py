"""Per-payment rule scoring: plain column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalar import clamp01

#: Fixed values of the rule set: amounts, additions to the risk, action thresholds.
HIGH_AMOUNT, VERY_HIGH_AMOUNT = 1000.0, 5000.0
ADD = {"new_payee": 0.1, "very_high_amount": 0.2, "high_amount": 0.1, "anomalous_session": 0.15, "remote_access_active": 0.25, "call_overlap": 0.15}
ACTIONS = (("hold", 0.8), ("step_up", 0.6), ("review", 0.35))
COERCION_FLOOR = 0.85


def verdict(df: DataFrame, score: Column, amount: Column, new_payee: Column, remote: Column, call: Column, anomaly: Column) -> DataFrame:
    """Adds risk, action and the indicators in the order in which the rules fire; null flags are false."""
    no = F.lit(False)
    new_payee, remote, call = (F.coalesce(c, no) for c in (new_payee, remote, call))
    anomaly = clamp01(F.coalesce(anomaly, F.lit(0.0)))
    fired = {
        "new_payee": new_payee,
        "very_high_amount": amount >= VERY_HIGH_AMOUNT,
        "high_amount": (amount >= HIGH_AMOUNT) & (amount < VERY_HIGH_AMOUNT),
        "anomalous_session": anomaly >= 0.5,
        "remote_access_active": remote,
        "call_overlap": call,
        "coercion_pattern": new_payee & (amount >= HIGH_AMOUNT) & (remote | call),
    }
    risk = score
    for name, add in ADD.items():
        risk = risk + F.when(fired[name], F.lit(add) * (anomaly if name == "anomalous_session" else F.lit(1.0))).otherwise(0.0)
    risk = clamp01(F.when(fired["coercion_pattern"], F.greatest(risk, F.lit(COERCION_FLOOR))).otherwise(risk))
    out = df.withColumn("risk", F.round(risk, 6))
    action = F.when(F.col("risk") >= ACTIONS[0][1], ACTIONS[0][0])
    for name, least in ACTIONS[1:]:
        action = action.when(F.col("risk") >= least, name)
    names = F.filter(F.array(*(F.when(hit, F.lit(name)) for name, hit in fired.items())), lambda x: x.isNotNull())
    return out.withColumn("action", action.otherwise("allow")).withColumn("indicators", F.concat_ws(",", names))

