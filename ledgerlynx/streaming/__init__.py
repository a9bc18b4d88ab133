"""Streaming forms of the detectors. Each takes and returns streaming DataFrames, and works on batches alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import money
from ..operators import rules
from ..operators.patterns import structuring_windows
from ..operators.validation import country_flags


def scored(txns: DataFrame) -> DataFrame:
    """Rules and checks of one row."""
    return country_flags(rules.place_and_time_rules(rules.amount_rules(txns)))


def structuring(txns: DataFrame, late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Windows close when the watermark passes them."""
    return structuring_windows(txns.withWatermark("ts", late), slide=slide)


def bursts(txns: DataFrame, gap: str = "10 minutes", late: str = "1 hour", least: int = 5) -> DataFrame:
    """S3."""
    out = txns.withWatermark("ts", late).groupBy("sender_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"), money(F.sum("amount")).alias("total"))
    return out.where(F.col("n") >= least).select("sender_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "total")


def smurfing(txns: DataFrame, late: str = "1 day", threshold: float = 10_000, least: int = 10, similarity: float = 0.9) -> DataFrame:
    """S6."""
    out = txns.withWatermark("ts", late).where(F.col("amount") < threshold).groupBy("receiver_id", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.min("amount").alias("low"), F.max("amount").alias("high"))
    return out.where((F.col("n") >= least) & (money("low") >= similarity * money("high"))).select("receiver_id", F.col("w.start").alias("start"), "n")


def once(txns: DataFrame, key: str = "transaction_id", late: str = "1 day") -> DataFrame:
    """S8."""
    return txns.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def with_alerts(txns: DataFrame, alerts: DataFrame, late: str = "1 hour", within: str = "1 hour") -> DataFrame:
    """Alerts: alert_transaction_id, alert_ts."""
    t, a = txns.withWatermark("ts", late), alerts.withWatermark("alert_ts", late)
    return t.join(a, F.expr(f"transaction_id = alert_transaction_id AND alert_ts >= ts AND alert_ts <= ts + INTERVAL {within}"))


def live(txns: DataFrame, every: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """S10."""
    return txns.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w")).agg(F.count("*").alias("n"), F.count_if("is_suspicious").alias("alerts"), F.avg("risk_score").alias("risk"))
