"""F1-F16 over the driver's tables."""

from pyspark.sql import functions as F

from ..operators import history as H
from .bindings import query, txn

R = "('IR','KP','SY','AF','IQ','LY','SO','SD','YE','MM')"
A = "amount::DOUBLE"
ALL = "PARTITION BY sender_id ORDER BY epoch_us(ts) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
ROWS = "PARTITION BY sender_id ORDER BY ts, transaction_id ROWS BETWEEN"


def days(n: int) -> str:
    return f"PARTITION BY sender_id ORDER BY epoch_us(ts) RANGE BETWEEN {(n + 1) * 86_400_000_000 - 1} PRECEDING AND 1 PRECEDING"


def span(us: int) -> str:
    return f"PARTITION BY sender_id ORDER BY epoch_us(ts) RANGE BETWEEN {us} PRECEDING AND 1 PRECEDING"


def rounded(names, digits=4):
    return [F.round(c, digits).alias(c) for c in names]


@query("f1_basic", "txn", f"""
SELECT transaction_id, {A} AS amount_value, hour(ts)::INT AS hour, (isodow(ts) - 1)::INT AS weekday, day(ts)::INT AS day, month(ts)::INT AS month, (isodow(ts) > 5)::INT AS weekend, (hour(ts) BETWEEN 9 AND 17)::INT AS business_hours,
  (hour(ts) < 6 OR hour(ts) > 22)::INT AS night, round(ln(1 + {A}), 6) AS log_amount, round(sqrt({A}), 6) AS sqrt_amount FROM txn""")  # fmt: skip
def f1(spark, sf):
    return H.basic(txn(spark, sf)).select("transaction_id", "amount_value", "hour", "weekday", "day", "month", "weekend", "business_hours", "night", *rounded(["log_amount", "sqrt_amount"], 6))


_ROUND = "CASE WHEN amount % 10000 = 0 THEN 1 WHEN amount % 5000 = 0 THEN 0.9 WHEN amount % 1000 = 0 THEN 0.8 WHEN amount % 500 = 0 THEN 0.6 WHEN amount % 100 = 0 THEN 0.4 ELSE 0 END::DOUBLE"


@query("f2_rounding", "txn", f"SELECT transaction_id, (amount % 1000)::DOUBLE AS mod_1000, (amount % 10000)::DOUBLE AS mod_10000, (floor(amount) % 10)::INT AS last_digit, {_ROUND} AS roundness, (amount % 1 <> 0)::INT AS cents FROM txn")
def f2(spark, sf):
    return H.rounding(txn(spark, sf)).select("transaction_id", "mod_1000", "mod_10000", "last_digit", "roundness", "cents")


@query("f3_types", "txn", "SELECT transaction_id, " + ", ".join(f"(transaction_type = '{k}')::INT AS is_{k}" for k in H.TRANSACTION_TYPES) + " FROM txn")
def f3(spark, sf):
    return H.type_flags(txn(spark, sf)).select("transaction_id", *(f"is_{k}" for k in H.TRANSACTION_TYPES))


_O, _D = f"(country_origin IN {R})::INT", f"(country_destination IN {R})::INT"


@query("f4_geography", "txn", f"SELECT transaction_id, (country_origin = country_destination)::INT AS domestic, (country_origin <> country_destination)::INT AS international, {_O} AS origin_risk, {_D} AS destination_risk, greatest({_O}, {_D}) AS any_risk, least({_O}, {_D}) AS both_risk FROM txn")
def f4(spark, sf):
    return H.geography(txn(spark, sf)).select("transaction_id", "domestic", "international", "origin_risk", "destination_risk", "any_risk", "both_risk")


_MOMENTS = f"""
w AS (SELECT transaction_id, {A} AS a, count(*) OVER h AS n, avg({A}) OVER h AS m, stddev_pop({A}) OVER h AS sd, min({A}) OVER h AS lo, max({A}) OVER h AS hi, quantile_cont({A}, 0.25) OVER h AS q1,
  quantile_cont({A}, 0.5) OVER h AS q2, quantile_cont({A}, 0.75) OVER h AS q3, list({A}) OVER h AS past FROM txn WINDOW h AS ({ALL})),
mm AS (SELECT *, CASE WHEN sd > 0 THEN list_avg(list_transform(past, lambda x: ((x - m) / sd) ** 3)) END AS sk, CASE WHEN sd > 0 THEN list_avg(list_transform(past, lambda x: ((x - m) / sd) ** 4)) - 3 END AS ku FROM w)
SELECT transaction_id, n::DOUBLE AS h_n, round(coalesce(m, 0), 4) AS h_mean, round(coalesce(q2, 0), 4) AS h_median, round(coalesce(sd, 0), 4) AS h_sd, coalesce(lo, 0) AS h_min, coalesce(hi, 0) AS h_max, round(coalesce(q1, 0), 4) AS h_q25,
  round(coalesce(q3, 0), 4) AS h_q75, round(coalesce(q3 - q1, 0), 4) AS h_iqr, round(coalesce(CASE WHEN m > 0 THEN sd / m END, 0), 4) AS h_cv, round(coalesce(CASE WHEN n >= 3 THEN sk END, 0), 4) AS h_skew,
  round(coalesce(CASE WHEN n >= 4 THEN ku END, 0), 4) AS h_kurtosis, round(coalesce(CASE WHEN sd > 0 THEN (a - m) / sd END, 0), 4) AS h_z FROM mm"""  # fmt: skip


@query("f5_history_statistics", "txn", _MOMENTS)
def f5(spark, sf):
    return H.moments(txn(spark, sf)).select("transaction_id", "h_n", "h_min", "h_max", *rounded(["h_mean", "h_median", "h_sd", "h_q25", "h_q75", "h_iqr", "h_cv", "h_skew", "h_kurtosis", "h_z"]))


@query("f5_percentile_position", "txn", f"""
w AS (SELECT transaction_id, {A} AS a, list({A}) OVER ({ALL}) AS past FROM txn)
SELECT transaction_id, round(CASE WHEN len(past) > 0 THEN 100.0::DOUBLE * len(list_filter(past, lambda x: x <= a)) / len(past) ELSE 0 END, 4) AS h_position FROM w""")  # fmt: skip
def f5b(spark, sf):
    return H.position(txn(spark, sf)).select("transaction_id", *rounded(["h_position"]))


@query("f6_velocity", "txn", "SELECT transaction_id, " + ", ".join(f"count(*) OVER w{d} AS n_{d}d, coalesce(sum(amount) OVER w{d}, 0)::DOUBLE AS volume_{d}d, round(coalesce(avg({A}) OVER w{d}, 0), 4) AS mean_{d}d, coalesce(max({A}) OVER w{d}, 0) AS max_{d}d" for d in (1, 7, 30)) + " FROM txn WINDOW " + ", ".join(f"w{d} AS ({days(d)})" for d in (1, 7, 30)))
def f6(spark, sf):
    out = H.velocity(txn(spark, sf))
    return out.select("transaction_id", *(c for d in (1, 7, 30) for c in (f"n_{d}d", f"volume_{d}d", F.round(f"mean_{d}d", 4).alias(f"mean_{d}d"), f"max_{d}d")))


@query("f7_habits", "txn", f"""
w AS (SELECT transaction_id, count(*) OVER ({ROWS} UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen, count(*) OVER ({span(86_400_000_000)}) AS b, count(*) FILTER (amount BETWEEN 9000 AND 10000) OVER ({ROWS} 10 PRECEDING AND 1 PRECEDING) AS near,
  list({A}) OVER ({ROWS} 5 PRECEDING AND 1 PRECEDING) AS l, (epoch_us(ts) - max(epoch_us(ts)) OVER ({ROWS} UNBOUNDED PRECEDING AND 1 PRECEDING)) / 3600000000 AS gap FROM txn)
SELECT transaction_id, CASE WHEN seen >= 3 THEN b ELSE 0 END AS burst, (seen >= 3 AND b > 10)::INT AS burst_flag, CASE WHEN seen >= 3 THEN near ELSE 0 END AS near_count, (seen >= 3 AND near >= 3)::INT AS near_flag,
  coalesce(seen >= 3 AND l = list_sort(l), false)::INT AS escalation, round(CASE WHEN seen < 3 THEN 0 WHEN l[1] > 0 THEN l[-1] / l[1] ELSE 1 END, 4) AS escalation_ratio,
  round(CASE WHEN seen >= 3 THEN gap ELSE 0 END, 4) AS hours_since_last FROM w""")  # fmt: skip
def f7(spark, sf):
    return H.habits(txn(spark, sf)).select("transaction_id", "burst", "burst_flag", "near_count", "near_flag", "escalation", *rounded(["escalation_ratio", "hours_since_last"]))


_AR = "CASE WHEN amount >= 100000 THEN 1 WHEN amount >= 50000 THEN 0.8 WHEN amount >= 10000 THEN 0.5 ELSE 0.2 END::DOUBLE"
_HR = "CASE WHEN hour(ts) < 6 OR hour(ts) > 22 THEN 0.8 WHEN hour(ts) < 9 OR hour(ts) > 18 THEN 0.5 ELSE 0.2 END::DOUBLE"
_FLAGS = f"((hour(ts) < 6 OR hour(ts) > 22)::INT + greatest({_O}, {_D}) + (country_origin <> country_destination)::INT + (amount % 1000 = 0)::INT + coalesce(abs({A} - m) > 3 * sd AND sd > 0, false)::INT + (seen >= 3 AND b > 10)::INT + (seen >= 3 AND near >= 3)::INT)"


@query("f9_risk_roll_up", "txn", f"x AS (SELECT *, avg({A}) OVER ({ALL}) AS m, stddev_pop({A}) OVER ({ALL}) AS sd, count(*) OVER ({ROWS} UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen, count(*) OVER ({span(86_400_000_000)}) AS b, count(*) FILTER (amount BETWEEN 9000 AND 10000) OVER ({ROWS} 10 PRECEDING AND 1 PRECEDING) AS near FROM txn) SELECT transaction_id, {_FLAGS} AS flags, {_AR} AS amount_risk, {_HR} AS hour_risk, ({_O} + {_D}) / 2::DOUBLE AS geo_risk, round(({_AR} + {_HR} + ({_O} + {_D}) / 2::DOUBLE) / 3, 6) AS composite_risk FROM x")
def f9(spark, sf):
    out = H.roll_up(H.deviation(H.habits(H.geography(H.basic(txn(spark, sf))))))
    return out.select("transaction_id", "flags", "amount_risk", "hour_risk", "geo_risk", *rounded(["composite_risk"], 6))


@query("f10_top_features", "txn", f"""
l AS (SELECT transaction_id, 'amount_risk' AS feature, {_AR} AS value FROM txn UNION ALL SELECT transaction_id, 'hour_risk', {_HR} FROM txn UNION ALL SELECT transaction_id, 'night', (hour(ts) < 6 OR hour(ts) > 22)::INT FROM txn
  UNION ALL SELECT transaction_id, 'international', (country_origin <> country_destination)::INT FROM txn)
SELECT transaction_id, feature, value, row_number() OVER (PARTITION BY transaction_id ORDER BY abs(value) DESC, feature) AS place FROM l WHERE feature LIKE '%risk%' OR value > 0.7 QUALIFY place <= 3""")  # fmt: skip
def f10(spark, sf):
    out = H.roll_up(H.deviation(H.habits(H.geography(H.basic(txn(spark, sf))))))
    return H.top_features(out, "transaction_id", ["amount_risk", "hour_risk", "night", "international"], k=3)


@query("f11_behaviour", "txn", f"""
w AS (SELECT transaction_id, ts, {A} AS a, avg({A}) OVER h AS m, stddev_pop({A}) OVER h AS sd, count(*) OVER w7 AS n7, sum(amount) OVER w7 AS v7 FROM txn WINDOW h AS ({ALL}), w7 AS ({days(7)})),
z AS (SELECT *, coalesce(CASE WHEN sd > 0 THEN abs(a - m) / sd END, 0) AS z FROM w),
r AS (SELECT *, greatest(CASE WHEN z > 3 THEN least(z / 5, 0.9) ELSE 0 END, CASE WHEN n7 > 50 THEN 0.7 ELSE 0 END, CASE WHEN hour(ts) < 3 THEN 0.5 ELSE 0 END, CASE WHEN m > 0 AND v7 > 20 * m THEN 0.8 ELSE 0 END)::DOUBLE AS risk FROM z)
SELECT transaction_id, round(risk, 4) AS risk, concat_ws(',', CASE WHEN z > 2 THEN 'amount_deviation' END, CASE WHEN n7 > 30 THEN 'high_frequency' END) AS patterns, risk >= 0.75 AS anomalous FROM r""")  # fmt: skip
def f11(spark, sf):
    out = H.behaviour(H.velocity(H.moments(H.basic(txn(spark, sf)))))
    return out.select("transaction_id", F.round("behaviour_risk", 4).alias("risk"), F.array_join("patterns", ",").alias("patterns"), "anomalous")


@query("f12_baseline", "txn", f"""
w AS (SELECT transaction_id, {A} AS a, avg({A}) OVER b AS m, stddev_pop({A}) OVER b AS sd, count(*) OVER u AS n, greatest((epoch_us(ts) - min(epoch_us(ts)) OVER u) // 86400000000, 1) AS d FROM txn
  WINDOW b AS ({ROWS} 1000 PRECEDING AND 1 PRECEDING), u AS ({ROWS} 999 PRECEDING AND CURRENT ROW))
SELECT transaction_id, round(m, 4) AS b_mean, round(CASE WHEN sd > 0 THEN abs(a - m) / sd ELSE 0 END, 4) AS b_deviation, round(n / d, 4) AS b_frequency, CASE WHEN sd > 0 THEN abs(a - m) / sd ELSE 0 END > 3 AS b_anomalous FROM w""")  # fmt: skip
def f12(spark, sf):
    return H.baseline(txn(spark, sf)).select("transaction_id", "b_anomalous", *rounded(["b_mean", "b_deviation", "b_frequency"]))


@query("f13_tempo", "txn", f"""
SELECT transaction_id, round({A} / nullif(avg({A}) OVER ({ALL}), 0), 4) AS velocity_score, round((epoch_us(lead(ts) OVER (PARTITION BY sender_id ORDER BY ts, transaction_id)) - epoch_us(ts)) / 3600000000, 4) AS hours_to_next,
  count(*) OVER ({span(3_600_000_000)}) AS burst_1h, count(*) OVER ({span(86_400_000_000)}) AS burst_24h, count(*) OVER ({span(604_800_000_000)}) AS burst_7d FROM txn""")  # fmt: skip
def f13(spark, sf):
    return H.tempo(txn(spark, sf)).select("transaction_id", "burst_1h", "burst_24h", "burst_7d", *rounded(["velocity_score", "hours_to_next"]))


@query("f14_running_total", "txn", "SELECT transaction_id, (sum(amount) OVER (ORDER BY ts, transaction_id ROWS UNBOUNDED PRECEDING))::DOUBLE AS running FROM txn WHERE is_suspicious")
def f14(spark, sf):
    return H.running_total(txn(spark, sf).where("is_suspicious"), F.to_date("ts")).select("transaction_id", "running")


@query("f15_empirical_cdf", "txn", "SELECT transaction_id, round((row_number() OVER (PARTITION BY transaction_type ORDER BY amount, transaction_id) - 1) / (count(*) OVER (PARTITION BY transaction_type) - 1), 6) AS cdf FROM txn")
def f15(spark, sf):
    return H.empirical_cdf(txn(spark, sf), "transaction_type", "amount", "transaction_id").select("transaction_id", *rounded(["cdf"], 6))


@query("f16_category_outliers", "txn", """
d AS (SELECT transaction_type, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE))::INT AS day, sum(amount)::DOUBLE AS volume FROM txn GROUP BY 1, 2),
w AS (SELECT *, avg(volume) OVER h AS m, stddev_pop(volume) OVER h AS sd FROM d WINDOW h AS (PARTITION BY transaction_type ORDER BY day RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING))
SELECT transaction_type, day, volume, round(CASE WHEN sd > 0 THEN (volume - m) / sd END, 4) AS z, coalesce(CASE WHEN sd > 0 THEN (volume - m) / sd END > 2, false) AS outlier FROM w""")  # fmt: skip
def f16(spark, sf):
    return H.category_outliers(txn(spark, sf), least=2.0).withColumn("z", F.round("z", 4))
