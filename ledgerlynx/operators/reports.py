"""Aggregations and reports over transactions, alerts and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import money



def amount() -> Column:
    return F.col("amount").cast("double")


def profile(txns: DataFrame) -> DataFrame:
    """A4: a customer's whole history; the sample deviation."""
    return txns.groupBy("sender_id").agg(
        F.count("*").alias("n"), money(F.sum("amount")).alias("total"), F.round(F.avg(amount()), 4).alias("average"), F.round(F.stddev_samp(amount()), 4).alias("deviation"),
        money(F.max("amount")).alias("high"), money(F.min("amount")).alias("low"), F.count_distinct("receiver_id").alias("receivers"), F.count_distinct("country_destination").alias("countries"),
    )


def approximate_ids(txns: DataFrame, error: float = 0.05) -> DataFrame:
    """A4's approximate column, which merges partial sketches."""
    return txns.groupBy("sender_id").agg(F.approx_count_distinct("transaction_id", error).alias("approx_ids"))


def since(txns: DataFrame, as_of: str, days: int) -> DataFrame:
    at = F.lit(as_of).cast("timestamp")
    return txns.where((F.col("ts") >= at - F.expr(f"INTERVAL {days} DAYS")) & (F.col("ts") < at))


def statistics(txns: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """A5: a look-back for all customers at once; the population deviation and conditional counts."""
    return since(txns, as_of, days).groupBy("sender_id").agg(
        F.count("*").alias("n"), money(F.sum("amount")).alias("total"), F.round(F.avg(amount()), 4).alias("average"), F.round(F.stddev_pop(amount()), 4).alias("deviation"), money(F.max("amount")).alias("high"),
        money(F.min("amount")).alias("low"), F.count_distinct("receiver_id").alias("receivers"), F.count_distinct("country_destination").alias("countries"), F.count_if("is_suspicious").alias("suspicious"),
        F.count_if(F.col("transaction_type") == "cash_deposit").alias("cash_deposits"), F.count_if(F.col("transaction_type") == "wire_transfer").alias("wires"),
    )


def rolling_profiles(txns: DataFrame, as_of: str, spans=(7, 30, 90)) -> DataFrame:
    """One pass; each span is a condition on the row's age."""
    at, out = F.lit(as_of).cast("timestamp"), []
    for d in spans:
        young = (F.col("ts") >= at - F.expr(f"INTERVAL {d} DAYS")) & (F.col("ts") < at)
        out += [F.count_if(young).alias(f"n_{d}d"), F.coalesce(money(F.sum(F.when(young, F.col("amount")))), F.lit(0.0)).alias(f"total_{d}d")]
    return since(txns, as_of, max(spans)).groupBy("sender_id").agg(*out)


def top_risky(txns: DataFrame, as_of: str, days: int = 30, limit: int = 100) -> DataFrame:
    """A7."""
    out = since(txns, as_of, days).groupBy("sender_id").agg(F.count("*").alias("n"), F.count_if("is_suspicious").alias("suspicious"), F.round(F.avg("risk_score"), 6).alias("risk"), money(F.sum("amount")).alias("total"))
    return out.where("suspicious > 0").orderBy(F.desc("risk"), F.desc("suspicious"), "sender_id").limit(limit)


def dashboard(txns: DataFrame, as_of: str) -> DataFrame:
    """A8."""
    at = F.lit(as_of).cast("timestamp")
    hour, day = F.col("ts") >= at - F.expr("INTERVAL 1 HOUR"), F.col("ts") >= at - F.expr("INTERVAL 1 DAY")
    return txns.where(F.col("ts") < at).agg(
        F.count("*").alias("n"), F.count_if(hour).alias("last_hour"), F.count_if(day).alias("last_day"), F.count_if("is_suspicious").alias("suspicious"),
        F.count_if(F.col("is_suspicious") & day).alias("suspicious_day"), money(F.sum("amount")).alias("total"), F.round(F.avg("risk_score"), 6).alias("risk"), F.count_distinct("sender_id").alias("senders"),
    )


def daily(txns: DataFrame) -> DataFrame:
    """Sums and counts, which later batches can be added to; see add_days."""
    return txns.groupBy(F.to_date("ts").alias("date"), "sender_id").agg(F.count("*").alias("n"), F.sum("amount").alias("total"), F.max("amount").alias("high"), F.count_if("is_suspicious").alias("suspicious"))


def add_days(kept: DataFrame, more: DataFrame) -> DataFrame:
    """The daily table after another batch's daily table."""
    return kept.unionByName(more).groupBy("date", "sender_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("high").alias("high"), F.sum("suspicious").alias("suspicious"))


def counts_by_each(df: DataFrame, columns: list[str]) -> DataFrame:
    """A10: counts by each column alone and in all, in one pass of grouping sets."""
    grouped = df.groupingSets([[F.col(c)] for c in columns] + [[]], *map(F.col, columns)).agg(F.count("*").alias("n"), *(F.grouping(c).alias(f"g_{c}") for c in columns))
    dimension, value = F.lit("all"), F.lit("")
    for c in columns:
        dimension, value = F.when(F.col(f"g_{c}") == 0, c).otherwise(dimension), F.when(F.col(f"g_{c}") == 0, F.col(c)).otherwise(value)
    return grouped.select(dimension.alias("dimension"), value.alias("value"), "n")


def describe(df: DataFrame, c: str) -> DataFrame:
    """A12."""
    v = F.col(c).cast("double")
    quarters = [F.round(F.percentile(v, F.lit(p / 100)), 4).alias(f"p{p}") for p in (25, 50, 75)]
    return df.agg(F.count(v).alias("n"), F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_samp(v), 4).alias("deviation"), F.min(v).alias("low"), *quarters, F.max(v).alias("high"))


def country_risk(txns: DataFrame, factor: float = 1.5) -> DataFrame:
    """Countries whose suspicious rate is above a multiple of the overall rate (one row, joined by value)."""
    overall = txns.agg(F.avg(F.col("is_suspicious").cast("int")).alias("overall"))
    by = txns.groupBy(F.col("country_destination").alias("country")).agg(
        F.count("*").alias("n"), F.avg(F.col("is_suspicious").cast("int")).alias("rate"), F.count_if("is_suspicious").alias("suspicious"), F.round(F.avg(amount()), 4).alias("average"), money(F.sum("amount")).alias("total")
    )
    return by.crossJoin(F.broadcast(overall)).where(F.col("rate") > factor * F.col("overall")).drop("overall").withColumn("rate", F.round("rate", 6))


def heat_map(txns: DataFrame) -> DataFrame:
    """Hour by weekday (Monday 0), zeros filled."""
    t = txns.select(F.hour("ts").alias("hour"), F.weekday("ts").alias("day"))
    out = t.groupBy("hour").pivot("day", list(range(7))).count().na.fill(0)
    return out.select("hour", *(F.col(str(k)).alias(f"d{k}") for k in range(7)))


def cross_tab(txns: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Per cent of each row."""
    out = txns.groupBy(row).pivot(column, values).count().na.fill(0)
    total = sum(F.col(v) for v in values)
    return out.select(row, *(F.round(100 * F.col(v) / total, 4).alias(v) for v in values))


def scorecard(txns: DataFrame) -> DataFrame:
    """A19."""
    out = txns.groupBy("sender_id").agg(
        F.count("*").alias("n"), F.count_if("is_suspicious").alias("suspicious"), F.sum("amount").alias("sum"), F.avg(amount()).alias("mean"), F.stddev_samp(amount()).alias("sd"), money(F.max("amount")).alias("high"),
        F.count_distinct("receiver_id").alias("receivers"), F.stddev_samp(F.hour("ts")).alias("hour_sd"),
    )
    rate = F.col("suspicious") / F.col("n")
    risk = 0.5 * rate + 0.2 * (F.col("n") > 10).cast("int") + 0.3 * (F.col("mean") > 5000).cast("int")
    return out.select(
        "sender_id", "n", "suspicious", money("sum").alias("total"), F.round("mean", 4).alias("average"), F.round("sd", 4).alias("deviation"), "high", "receivers", F.round("hour_sd", 4).alias("hour_deviation"),
        F.round(money("sum") / F.col("n"), 4).alias("velocity"), F.round(F.coalesce(1 - F.col("sd") / F.col("mean"), F.lit(1.0)), 4).alias("consistency"), F.round(risk, 6).alias("risk"), ((rate > 0.5) & (F.col("n") >= 5)).alias("high_risk"),
    )


def segment(risk: Column) -> Column:
    """Right-closed bins; 0 is in none."""
    return F.when((risk > 0) & (risk <= 0.2), "low").when((risk > 0.2) & (risk <= 0.4), "medium").when((risk > 0.4) & (risk <= 0.6), "high").when((risk > 0.6) & (risk <= 1), "critical")


def confusion(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """0 where a denominator is 0."""
    c = df.agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & ~actual).alias("tn"), F.count_if(~predicted & actual).alias("fn"))

    def over(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    tp, fp, tn, fn = (F.col(k) for k in ("tp", "fp", "tn", "fn"))
    return c.select("tp", "fp", "tn", "fn", F.round(over(tp + tn, tp + fp + tn + fn), 6).alias("accuracy"), F.round(over(tp, tp + fp), 6).alias("precision"), F.round(over(tp, tp + fn), 6).alias("recall"), F.round(over(2 * tp, 2 * tp + fp + fn), 6).alias("f1"))


def majority(votes: DataFrame) -> DataFrame:
    """Votes: transaction_id, suspicious, risk_score, confidence."""
    out = votes.groupBy("transaction_id").agg(F.count("*").alias("k"), F.count_if("suspicious").alias("v"), F.avg("risk_score").alias("risk"), F.avg("confidence").alias("conf"))
    return out.select("transaction_id", F.when(2 * F.col("v") > F.col("k"), "SUSPICIOUS").otherwise("CLEAR").alias("verdict"), F.round("risk", 6).alias("risk"), F.round("conf", 6).alias("confidence"), F.round(F.greatest("v", F.col("k") - F.col("v")) / F.col("k"), 6).alias("agreement"))


#: Upper bounds of the amount histogram.
BUCKETS = (100, 500, 1000, 5000, 10_000, 50_000, 100_000, 500_000, 1_000_000)


def histogram(txns: DataFrame) -> DataFrame:
    """Cumulative counts of amounts up to each bound, by type; one aggregate a bound, then rows."""
    sums = txns.groupBy("transaction_type").agg(*(F.count_if(F.col("amount") <= b).alias(str(b)) for b in BUCKETS))
    return sums.unpivot("transaction_type", [str(b) for b in BUCKETS], "bound", "n").withColumn("bound", F.col("bound").cast("long"))


def top_in_windows(df: DataFrame, key: str, window: str, k: int = 10) -> DataFrame:
    """The k most frequent keys of each window."""
    counts = df.groupBy(F.window("ts", window)["start"].alias("start"), key).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("start").orderBy(F.desc("n"), key))).where(F.col("place") <= k)


def spikes(df: DataFrame, minutes: int = 5, factor: float = 2.0) -> DataFrame:
    """Every window from the first to the last, with its count; spike above a multiple of the mean, silence at 0."""
    bucket = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (60 * minutes))
    counts = df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    every = counts.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).select(F.explode(F.sequence("a", "b")).alias("bucket"))
    whole = every.join(counts, "bucket", "left").fillna(0, ["n"])
    mean = whole.agg(F.avg("n").alias("mean"))
    return whole.crossJoin(F.broadcast(mean)).select("bucket", "n", (F.col("n") > factor * F.col("mean")).alias("spike"), (F.col("n") == 0).alias("silent"))


def rate_alarms(df: DataFrame, missing: Column, minutes: int = 5, most: float = 0.01, silent_windows: int = 2) -> DataFrame:
    """Every window from the first to the last, with the rate of rows with missing values a second, whether that is above `most`, and whether
    neither it nor the windows before it, `silent_windows` in all, had a row. Before the first window nothing is known, so it is silent only if they all are within."""
    bucket = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (60 * minutes))
    counts = df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count_if(missing).alias("n_missing"))
    ends = counts.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    every = ends.select("a", F.explode(F.sequence("a", "b")).alias("bucket"))
    # a window with rows speaks for itself and for those that look back on it
    heard = counts.select(F.explode(F.sequence("bucket", F.col("bucket") + silent_windows - 1)).alias("bucket")).distinct().withColumn("heard", F.lit(True))
    out = every.join(counts, "bucket", "left").join(heard, "bucket", "left").fillna(0, ["n", "n_missing"])
    rate = F.col("n_missing") / (60.0 * minutes)
    silent = F.col("heard").isNull() & (F.col("bucket") - F.col("a") >= silent_windows - 1)
    return out.select("bucket", "n", rate.alias("missing_rate"), (rate > most).alias("missing_alarm"), silent.alias("silence_alarm"))


def months(txns: DataFrame) -> DataFrame:
    """By month and country with totals of each month and of all."""
    return txns.rollup(F.date_format(F.date_trunc("month", "ts"), "yyyy-MM").alias("month"), F.col("country_destination").alias("country")).agg(F.count("*").alias("n"), money(F.sum("amount")).alias("total"))
