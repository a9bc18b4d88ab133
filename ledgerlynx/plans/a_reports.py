"""A4-A28, K2, K3 over the driver's tables."""

from pyspark.sql import functions as F

from ..operators import reports as A
from .bindings import AS_OF, TYPES, query, table, txn

AT = f"TIMESTAMP '{AS_OF}'"
KINDS = [*TYPES.values(), "crypto"]
LABELS = "SELECT doc_id, toxic = 1 AS predicted, quality = 0 AS actual FROM labels"


@query("a4_customer_profiles", "txn", """
SELECT sender_id, count(*) AS n, sum(amount)::DOUBLE AS total, round(avg(amount::DOUBLE), 4) AS average, round(stddev_samp(amount::DOUBLE), 4) AS deviation, max(amount)::DOUBLE AS high, min(amount)::DOUBLE AS low,
  count(DISTINCT receiver_id) AS receivers, count(DISTINCT country_destination) AS countries FROM txn GROUP BY 1""")  # fmt: skip
def a4(spark, sf):
    return A.profile(txn(spark, sf))


@query("a5_customer_statistics", "txn", f"""
SELECT sender_id, count(*) AS n, sum(amount)::DOUBLE AS total, round(avg(amount::DOUBLE), 4) AS average, round(stddev_pop(amount::DOUBLE), 4) AS deviation, max(amount)::DOUBLE AS high, min(amount)::DOUBLE AS low,
  count(DISTINCT receiver_id) AS receivers, count(DISTINCT country_destination) AS countries, count(*) FILTER (is_suspicious) AS suspicious, count(*) FILTER (transaction_type = 'cash_deposit') AS cash_deposits,
  count(*) FILTER (transaction_type = 'wire_transfer') AS wires FROM txn WHERE ts >= {AT} - INTERVAL 30 DAYS AND ts < {AT} GROUP BY 1""")  # fmt: skip
def a5(spark, sf):
    return A.statistics(txn(spark, sf), AS_OF)


@query("a6_rolling_profiles", "txn", "SELECT sender_id, " + ", ".join(f"count(*) FILTER (ts >= {AT} - INTERVAL {d} DAYS) AS n_{d}d, coalesce(sum(amount) FILTER (ts >= {AT} - INTERVAL {d} DAYS), 0)::DOUBLE AS total_{d}d" for d in (7, 30, 90)) + f" FROM txn WHERE ts < {AT} GROUP BY 1")
def a6(spark, sf):
    return A.rolling_profiles(txn(spark, sf), AS_OF)


@query("a7_top_risky", "txn", f"""
SELECT sender_id, count(*) AS n, count(*) FILTER (is_suspicious) AS suspicious, round(avg(risk_score), 6) AS risk, sum(amount)::DOUBLE AS total FROM txn WHERE ts >= {AT} - INTERVAL 30 DAYS AND ts < {AT}
GROUP BY 1 HAVING count(*) FILTER (is_suspicious) > 0 ORDER BY risk DESC, suspicious DESC, sender_id LIMIT 100""")  # fmt: skip
def a7(spark, sf):
    return A.top_risky(txn(spark, sf), AS_OF)


@query("a8_dashboard", "txn", f"""
SELECT count(*) AS n, count(*) FILTER (ts >= {AT} - INTERVAL 1 HOUR) AS last_hour, count(*) FILTER (ts >= {AT} - INTERVAL 1 DAY) AS last_day, count(*) FILTER (is_suspicious) AS suspicious,
  count(*) FILTER (is_suspicious AND ts >= {AT} - INTERVAL 1 DAY) AS suspicious_day, sum(amount)::DOUBLE AS total, round(avg(risk_score), 6) AS risk, count(DISTINCT sender_id) AS senders FROM txn WHERE ts < {AT}""")  # fmt: skip
def a8(spark, sf):
    return A.dashboard(txn(spark, sf), AS_OF)


@query("a9_daily_stats", "txn", """
SELECT strftime(ts, '%Y-%m-%d') AS date, sender_id, count(*) AS n, sum(amount)::DOUBLE AS total, round(avg(amount::DOUBLE), 4) AS average, max(amount)::DOUBLE AS high, count(*) FILTER (is_suspicious) AS suspicious FROM txn GROUP BY 1, 2""")  # fmt: skip
def a9(spark, sf):
    d = A.daily(txn(spark, sf))
    total = F.col("total").cast("double")
    return d.select(F.col("date").cast("string").alias("date"), "sender_id", "n", total.alias("total"), F.round(total / F.col("n"), 4).alias("average"), F.col("high").cast("double").alias("high"), "suspicious")


@query("a10_alert_statistics", "txn", """
SELECT CASE WHEN grouping(transaction_type) = 0 THEN 'transaction_type' WHEN grouping(country_origin) = 0 THEN 'country_origin' ELSE 'all' END AS dimension, coalesce(transaction_type, country_origin, '') AS value, count(*) AS n
FROM txn WHERE is_suspicious GROUP BY GROUPING SETS ((transaction_type), (country_origin), ())""")  # fmt: skip
def a10(spark, sf):
    return A.counts_by_each(txn(spark, sf).where("is_suspicious"), ["transaction_type", "country_origin"])


@query("a11_report_statistics", "txn", "SELECT count(*) AS total, count(*) FILTER (risk_score >= 0.3) AS filed, count(*) FILTER (risk_score < 0.3) AS pending FROM txn WHERE is_suspicious")
def a11(spark, sf):
    return txn(spark, sf).where("is_suspicious").agg(F.count("*").alias("total"), F.count_if(F.col("risk_score") >= 0.3).alias("filed"), F.count_if(F.col("risk_score") < 0.3).alias("pending"))


@query("a12_describe", "txn", """
SELECT count(amount) AS n, round(avg(amount::DOUBLE), 4) AS mean, round(stddev_samp(amount::DOUBLE), 4) AS deviation, min(amount)::DOUBLE AS low, round(quantile_cont(amount::DOUBLE, 0.25), 4) AS p25,
  round(quantile_cont(amount::DOUBLE, 0.5), 4) AS p50, round(quantile_cont(amount::DOUBLE, 0.75), 4) AS p75, max(amount)::DOUBLE AS high FROM txn""")  # fmt: skip
def a12(spark, sf):
    return A.describe(txn(spark, sf), "amount")


@query("a13_value_counts", "txn", "SELECT transaction_type, count(*) AS n FROM txn GROUP BY 1")
def a13(spark, sf):
    return txn(spark, sf).groupBy("transaction_type").agg(F.count("*").alias("n"))


@query("a14_country_risk", "txn", """
SELECT country_destination AS country, count(*) AS n, round(avg(is_suspicious::INT), 6) AS rate, count(*) FILTER (is_suspicious) AS suspicious, round(avg(amount::DOUBLE), 4) AS average, sum(amount)::DOUBLE AS total
FROM txn GROUP BY 1 HAVING avg(is_suspicious::INT) > 1.05 * (SELECT avg(is_suspicious::INT) FROM txn)""")  # fmt: skip
def a14(spark, sf):
    return A.country_risk(txn(spark, sf), 1.05)


@query("a15_daily_suspicious", "txn", "SELECT strftime(ts, '%Y-%m-%d') AS date, is_suspicious, count(*) AS n, sum(amount)::DOUBLE AS total FROM txn GROUP BY 1, 2")
def a15(spark, sf):
    return txn(spark, sf).groupBy(F.to_date("ts").cast("string").alias("date"), "is_suspicious").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"))


@query("a16_heat_map", "txn", "SELECT hour(ts)::INT AS hour, " + ", ".join(f"count(*) FILTER (isodow(ts) = {k + 1}) AS d{k}" for k in range(7)) + " FROM txn GROUP BY 1")
def a16(spark, sf):
    return A.heat_map(txn(spark, sf))


@query("a17_cross_tab", "txn", "SELECT country_origin, " + ", ".join(f"round(100.0::DOUBLE * count(*) FILTER (transaction_type = '{k}') / count(*), 4) AS {k}" for k in KINDS) + " FROM txn GROUP BY 1")
def a17(spark, sf):
    return A.cross_tab(txn(spark, sf), "country_origin", "transaction_type", KINDS)


@query("a18_rate_by_hour", "txn", """
h AS (SELECT hour(ts)::INT AS hour, count(*) AS n, avg(is_suspicious::INT) AS rate FROM txn GROUP BY 1)
SELECT hour, n, round(rate, 6) AS rate, hour = (SELECT hour FROM h ORDER BY rate DESC, hour LIMIT 1) AS riskiest, hour = (SELECT hour FROM h ORDER BY rate, hour LIMIT 1) AS safest FROM h""")  # fmt: skip
def a18(spark, sf):
    h = txn(spark, sf).groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n"), F.avg(F.col("is_suspicious").cast("int")).alias("rate"))
    ends = h.agg(F.max_by("hour", F.struct("rate", -F.col("hour"))).alias("top"), F.min_by("hour", F.struct("rate", "hour")).alias("low"))
    return h.crossJoin(F.broadcast(ends)).select("hour", "n", F.round("rate", 6).alias("rate"), (F.col("hour") == F.col("top")).alias("riskiest"), (F.col("hour") == F.col("low")).alias("safest"))


_CARD = """
g AS (SELECT sender_id, count(*) AS n, count(*) FILTER (is_suspicious) AS suspicious, sum(amount)::DOUBLE AS total, avg(amount::DOUBLE) AS mean, stddev_samp(amount::DOUBLE) AS sd, max(amount)::DOUBLE AS high,
  count(DISTINCT receiver_id) AS receivers, stddev_samp(hour(ts)) AS hour_sd FROM txn GROUP BY 1),
card AS (SELECT sender_id, n, suspicious, total, round(mean, 4) AS average, round(sd, 4) AS deviation, high, receivers, round(hour_sd, 4) AS hour_deviation, round(total / n, 4) AS velocity, round(coalesce(1 - sd / mean, 1), 4) AS consistency,
  round(0.5::DOUBLE * suspicious / n + 0.2::DOUBLE * (n > 10)::INT + 0.3::DOUBLE * (mean > 5000)::INT, 6) AS risk, suspicious::DOUBLE / n > 0.5 AND n >= 5 AS high_risk FROM g)
"""  # fmt: skip


@query("a19_scorecard", "txn", _CARD + "SELECT * FROM card")
def a19(spark, sf):
    return A.scorecard(txn(spark, sf))


@query("a20_risk_segments", "txn", _CARD + "SELECT sender_id, CASE WHEN risk > 0 AND risk <= 0.2 THEN 'low' WHEN risk > 0.2 AND risk <= 0.4 THEN 'medium' WHEN risk > 0.4 AND risk <= 0.6 THEN 'high' WHEN risk > 0.6 THEN 'critical' END AS segment FROM card")
def a20(spark, sf):
    return A.scorecard(txn(spark, sf)).select("sender_id", A.segment(F.col("risk")).alias("segment"))


@query("a21_heat_map_feed", "txn", "SELECT sender_id, strftime(ts, '%Y-%m-%d') AS date, round(avg(risk_score), 8) AS risk, count(*) AS n FROM txn GROUP BY 1, 2")
def a21(spark, sf):
    return txn(spark, sf).groupBy("sender_id", F.to_date("ts").cast("string").alias("date")).agg(F.round(F.avg("risk_score"), 8).alias("risk"), F.count("*").alias("n"))


@query("a22_confusion", "", f"""
SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1
FROM (SELECT count(*) FILTER (predicted AND actual) AS tp, count(*) FILTER (predicted AND NOT actual) AS fp, count(*) FILTER (NOT predicted AND NOT actual) AS tn, count(*) FILTER (NOT predicted AND actual) AS fn FROM ({LABELS}))""")  # fmt: skip
def a22(spark, sf):
    return A.confusion(table(spark, sf, "labels"), F.col("toxic") == 1, F.col("quality") == 0)


@query("a23_majority_vote", "txn", """
v AS (SELECT transaction_id, is_suspicious AS s, risk_score AS r, 0.9 AS c FROM txn UNION ALL SELECT transaction_id, transaction_type = 'crypto', 0.5, 0.6 FROM txn UNION ALL SELECT transaction_id, hour(ts) < 6, 0.3, 0.7 FROM txn)
SELECT transaction_id, CASE WHEN 2 * count(*) FILTER (s) > count(*) THEN 'SUSPICIOUS' ELSE 'CLEAR' END AS verdict, round(avg(r), 6) AS risk, round(avg(c::DOUBLE), 6) AS confidence,
  round(greatest(count(*) FILTER (s), count(*) FILTER (NOT s)) / count(*), 6) AS agreement FROM v GROUP BY 1""")  # fmt: skip
def a23(spark, sf):
    t = txn(spark, sf)
    rows = F.array(
        F.struct(F.col("is_suspicious").alias("suspicious"), F.col("risk_score"), F.lit(0.9).alias("confidence")),
        F.struct((F.col("transaction_type") == "crypto").alias("suspicious"), F.lit(0.5).alias("risk_score"), F.lit(0.6).alias("confidence")),
        F.struct((F.hour("ts") < 6).alias("suspicious"), F.lit(0.3).alias("risk_score"), F.lit(0.7).alias("confidence")),
    )
    return A.majority(t.select("transaction_id", F.inline(rows)))


@query("a24_amount_histogram", "txn", "SELECT transaction_type, b AS bound, count(*) FILTER (amount <= b) AS n FROM txn, (SELECT unnest([100, 500, 1000, 5000, 10000, 50000, 100000, 500000, 1000000])::BIGINT AS b) GROUP BY 1, 2")
def a24(spark, sf):
    return A.histogram(txn(spark, sf))


@query("a25_top_in_windows", "txn", """
c AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts, TIMESTAMP '1970-01-01') AS s, country_destination, count(*) AS n FROM txn WHERE is_suspicious GROUP BY 1, 2)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, country_destination, n, row_number() OVER (PARTITION BY s ORDER BY n DESC, country_destination) AS place FROM c QUALIFY place <= 10""")  # fmt: skip
def a25(spark, sf):
    return A.top_in_windows(txn(spark, sf).where("is_suspicious"), "country_destination", "10 minutes").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("a26_quantiles", "txn", "SELECT transaction_type, " + ", ".join(f"round(quantile_cont(amount::DOUBLE, 0.{p}), 4) AS p{p}" for p in (50, 95, 99)) + " FROM txn GROUP BY 1")
def a26(spark, sf):
    return txn(spark, sf).groupBy("transaction_type").agg(*(F.round(F.percentile(F.col("amount").cast("double"), F.lit(p / 100)), 4).alias(f"p{p}") for p in (50, 95, 99)))


@query("a27_spikes", "txn", """
c AS (SELECT epoch_us(ts) // 300000000 AS bucket, count(*) AS n FROM txn GROUP BY 1),
e AS (SELECT unnest(range((SELECT min(bucket) FROM c), (SELECT max(bucket) FROM c) + 1)) AS bucket),
w AS (SELECT e.bucket, coalesce(c.n, 0) AS n FROM e LEFT JOIN c ON c.bucket = e.bucket)
SELECT bucket, n, n > 2 * (SELECT avg(n) FROM w) AS spike, n = 0 AS silent FROM w""")  # fmt: skip
def a27(spark, sf):
    return A.spikes(txn(spark, sf))


# a missing value: a description is not given in one of seven transactions
@query("a27_rate_alarms", "txn", """
c AS (SELECT epoch_us(ts) // 300000000 AS bucket, count(*) AS n, count(*) FILTER (transaction_id % 7 = 0) AS m FROM txn GROUP BY 1),
e AS (SELECT unnest(range((SELECT min(bucket) FROM c), (SELECT max(bucket) FROM c) + 1)) AS bucket),
w AS (SELECT e.bucket, coalesce(c.n, 0) AS n, coalesce(c.m, 0) AS m FROM e LEFT JOIN c ON c.bucket = e.bucket)
SELECT bucket, n, round(m / 300.0, 6)::DOUBLE AS missing_rate, m > 3 AS missing_alarm, coalesce(n = 0 AND lag(n) OVER (ORDER BY bucket) = 0, false) AS silence_alarm FROM w""")  # fmt: skip
def a27_alarms(spark, sf):
    t = txn(spark, sf).withColumn("description", F.when(F.col("transaction_id") % 7 != 0, "given"))
    return A.rate_alarms(t, F.isnull("description")).withColumn("missing_rate", F.round("missing_rate", 6))


@query("a28_months", "txn", "SELECT strftime(ts, '%Y-%m') AS month, country_destination AS country, count(*) AS n, sum(amount)::DOUBLE AS total FROM txn GROUP BY ROLLUP (strftime(ts, '%Y-%m'), country_destination)")
def a28(spark, sf):
    return A.months(txn(spark, sf))


@query("k2_top_by_score", "txn", "SELECT transaction_id, risk_score FROM txn WHERE is_suspicious ORDER BY risk_score DESC, transaction_id LIMIT 25")
def k2(spark, sf):
    return txn(spark, sf).where("is_suspicious").orderBy(F.desc("risk_score"), "transaction_id").limit(25).select("transaction_id", "risk_score")


@query("k3_largest_customers", "txn", _CARD + "SELECT sender_id, risk FROM card ORDER BY risk DESC, sender_id LIMIT 10")
def k3(spark, sf):
    return A.scorecard(txn(spark, sf)).orderBy(F.desc("risk"), "sender_id").limit(10).select("sender_id", "risk")
