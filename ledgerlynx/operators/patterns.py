"""Laundering patterns over sets of transactions: structuring, returns, smurfing, sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import micros, money


def structuring_windows(txns: DataFrame, threshold: float = 10_000, window: str = "7 days", slide: str | None = None, least: int = 3) -> DataFrame:
    """A1, A3: senders whose rows below the threshold sum above it within a window; one grouped shuffle."""
    small = txns.where(F.col("amount") < threshold)
    grouped = small.groupBy("sender_id", F.window("ts", window, slide or window).alias("w"))
    out = grouped.agg(F.count("*").alias("n"), F.sum("amount").alias("total"), F.avg(money("amount")).alias("average"), F.array_sort(F.collect_list("transaction_id")).alias("ids"))
    return out.where((F.col("n") >= least) & (F.col("total") > threshold)).select("sender_id", F.col("w.start").alias("window_start"), "n", money("total").alias("total"), F.round("average", 4).alias("average"), "ids")


def structuring_days(txns: DataFrame, as_of: str, threshold: float = 10_000, days: int = 30, least: int = 3, limit: int = 1000) -> DataFrame:
    """A2: the same by calendar day over a look-back."""
    since = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    small = txns.where((F.col("amount") < threshold) & (F.col("ts") >= since) & (F.col("ts") < F.lit(as_of).cast("timestamp")))
    out = small.groupBy("sender_id", F.to_date("ts").alias("date")).agg(F.count("*").alias("n"), F.sum("amount").alias("total"), F.array_sort(F.collect_list(money("amount"))).alias("amounts"))
    return out.where((F.col("n") >= least) & (F.col("total") > threshold)).orderBy(F.desc("total"), "sender_id", "date").limit(limit)


def reciprocal(txns: DataFrame, within: str | None = None) -> DataFrame:
    """Pairs A to B and B to A, both ways; J2: the return later and within an interval, one row a pair."""
    a, b = (txns.select(*(F.col(c).alias(f"{c}_{k}") for c in ("transaction_id", "sender_id", "receiver_id", "amount", "ts"))) for k in "12")
    both = a.join(b, (F.col("sender_id_1") == F.col("receiver_id_2")) & (F.col("receiver_id_1") == F.col("sender_id_2")))
    return both.where(f"ts_2 > ts_1 AND ts_2 <= ts_1 + INTERVAL {within}") if within else both


def three_party(txns: DataFrame, within: str = "7 DAYS", least_total: float = 50_000, kind: str | None = "wire_transfer") -> DataFrame:
    """A to B to C to A in order of time."""
    t = txns.where(F.col("transaction_type") == kind) if kind else txns
    t = t.where("sender_id <> receiver_id")
    legs = [t.select(F.col("transaction_id").alias(f"t{k}"), F.col("sender_id").alias(f"s{k}"), F.col("receiver_id").alias(f"r{k}"), F.col("amount").alias(f"a{k}"), F.col("ts").alias(f"ts{k}")) for k in (1, 2, 3)]
    two = legs[0].join(legs[1], (F.col("r1") == F.col("s2")) & (F.col("ts2") > F.col("ts1")) & F.expr(f"ts2 <= ts1 + INTERVAL {within}") & (F.col("r2") != F.col("s1")))
    three = two.join(legs[2], (F.col("r2") == F.col("s3")) & (F.col("r3") == F.col("s1")) & (F.col("ts3") > F.col("ts2")) & F.expr(f"ts3 <= ts1 + INTERVAL {within}"))
    return three.where(F.col("a1") + F.col("a2") + F.col("a3") > least_total)


def many_senders(txns: DataFrame, least: int = 5, window: str = "7 days") -> DataFrame:
    """receivers with many distinct senders in a window."""
    out = txns.groupBy("receiver_id", F.window("ts", window).alias("w")).agg(F.count_distinct("sender_id").alias("n_senders"))
    return out.where(F.col("n_senders") >= least).select("receiver_id", F.col("w.start").alias("window_start"), "n_senders")


def rising_sequence(txns: DataFrame, small: float = 5_000, large: float = 15_000, hours: int = 24) -> DataFrame:
    """A small, then a medium, then a large amount by one sender within the hours."""
    t = txns.select("sender_id", "transaction_id", "amount", micros().alias("us"))
    a = t.where(F.col("amount") < small).toDF("sender_id", "t1", "a1", "us1")
    b = t.where(F.col("amount").between(small, large)).toDF("sender_id", "t2", "a2", "us2")
    c = t.where(F.col("amount") > large).toDF("sender_id", "t3", "a3", "us3")
    span = hours * 3_600_000_000
    two = c.join(b, "sender_id").where(f"us2 < us3 AND us3 - us2 <= {span}")  # the rarest leg first
    return two.join(a, "sender_id").where(f"us1 < us2 AND us3 - us1 <= {span}").select("sender_id", "t1", "t2", "t3")


def layering_sequence(txns: DataFrame, deposits=("cash_deposit",), transfers=("wire_transfer", "ach"), withdrawals=("cash_withdrawal",), least: int = 3, days: int = 7) -> DataFrame:
    """Withdrawals with a deposit of the same party in the days before and at least so many transfers in between.

    The earliest such deposit has the most transfers after it, so running counts decide; one exchange and one sort."""
    before = Window.partitionBy("sender_id").orderBy("us")
    kind = F.col("transaction_type")
    t = txns.select("sender_id", "transaction_id", "transaction_type", micros().alias("us"))
    t = t.withColumn("sent", F.count_if(kind.isin(*transfers)).over(before.rangeBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.when(kind.isin(*deposits), F.struct("us", "sent"))).over(before.rangeBetween(-days * 86_400_000_000, -1))
    until = F.max("sent").over(before.rangeBetween(Window.unboundedPreceding, -1))
    out = t.withColumns({"first": first, "n_transfers": until - first["sent"]})
    return out.where(kind.isin(*withdrawals) & (F.col("n_transfers") >= least)).select("sender_id", "transaction_id", "n_transfers")


def smurfing_receivers(txns: DataFrame, threshold: float = 10_000, least: int = 10, similarity: float = 0.9, window: str = "1 day") -> DataFrame:
    """Many similar rows below the threshold to one receiver in a day."""
    out = txns.where(F.col("amount") < threshold).groupBy("receiver_id", F.window("ts", window).alias("w")).agg(F.count("*").alias("n"), F.min("amount").alias("low"), F.max("amount").alias("high"), F.sum("amount").alias("total"))
    return out.where((F.col("n") >= least) & (money("low") >= similarity * money("high"))).select("receiver_id", F.col("w.start").alias("window_start"), "n", money("total").alias("total"))


def matching(events: DataFrame, conditions: dict) -> DataFrame:
    """Rows that equal a registered pattern's conditions."""
    for c, v in conditions.items():
        events = events.where(F.col(c) == v)
    return events
