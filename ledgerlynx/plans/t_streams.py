"""S1 to S10 as running streams over the driver's tables. Each query starts a stream that reads a table's files, drains it into a
sink that holds every micro-batch once, and returns what the sink holds. What waits for a watermark is judged up to it, and so is the SQL."""

import uuid

from pyspark.sql import functions as F

from .. import streaming as S
from ..shared import shared_folder
from ..streaming import stateful
from ..streaming.sinks import drained
from .bindings import query, table, txn
from .c_cases import _FEEDBACK, _STEP, feedback

#: Where the watermark ends: an hour before the last event, in whole milliseconds.
LAST = "last AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR AS until FROM txn)"


def stream(spark, sf, name):
    """A table's files as a stream. A pattern names them, for a stream takes no single file by its plain path."""
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


def moving(spark, sf):
    return txn(spark, sf, stream(spark, sf, "events"))


def ran(spark, made):
    stateful.keyed_state(spark)
    return drained(made, f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}")


@query("s1_scored_stream", "txn", """
SELECT transaction_id, CASE WHEN amount > 100000 THEN 'R003' WHEN amount > 50000 THEN 'R002' WHEN amount > 10000 THEN 'R001' END AS band, amount BETWEEN 9000 AND 10000 AS near_limit,
  country_origin IN ('IR', 'KP', 'SY', 'AF', 'IQ', 'LY', 'SO', 'SD', 'YE', 'MM') OR country_destination IN ('IR', 'KP', 'SY', 'AF', 'IQ', 'LY', 'SO', 'SD', 'YE', 'MM') AS risky_country,
  (hour(ts) >= 23 OR hour(ts) < 5) AND amount > 10000 AS at_night, isodow(ts) >= 6 AS weekend FROM txn""")  # fmt: skip
def s1(spark, sf):
    out = ran(spark, S.scored(moving(spark, sf)))
    band = F.when(F.col("R003"), "R003").when(F.col("R002"), "R002").when(F.col("R001"), "R001")
    return out.select("transaction_id", band.alias("band"), F.col("R004").alias("near_limit"), F.col("R025").alias("risky_country"), F.col("R039").alias("at_night"), F.col("R040").alias("weekend"))


@query("s2_structuring_stream", "txn", """
w AS (SELECT sender_id, time_bucket(INTERVAL 7 DAYS, ts, TIMESTAMP '1970-01-01') AS began, count(*) AS n, sum(amount)::DOUBLE AS total FROM txn WHERE amount < 10000 GROUP BY 1, 2 HAVING count(*) >= 3 AND sum(amount) > 10000)
SELECT sender_id, strftime(began, '%Y-%m-%d %H:%M:%S') AS window_start, n, total FROM w WHERE began + INTERVAL 7 DAYS <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY FROM txn WHERE amount < 10000)""")  # fmt: skip
def s2(spark, sf):
    out = ran(spark, S.structuring(moving(spark, sf)))
    return out.select("sender_id", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n", "total")


@query("s3_bursts_stream", "txn", """
g AS (SELECT sender_id, ts, amount, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER o) >= 21600000000, true) AS fresh FROM txn WINDOW o AS (PARTITION BY sender_id ORDER BY ts)),
k AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY sender_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g),
b AS (SELECT sender_id, min(ts) AS began, max(ts) + INTERVAL 6 HOURS AS until, count(*) AS n, sum(amount)::DOUBLE AS total FROM k GROUP BY sender_id, session HAVING count(*) >= 3)
SELECT sender_id, strftime(began, '%Y-%m-%d %H:%M:%S') AS began, strftime(until, '%Y-%m-%d %H:%M:%S') AS ended, n, total FROM b WHERE until <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM txn)""")  # fmt: skip
def s3(spark, sf):
    out = ran(spark, S.bursts(moving(spark, sf), gap="6 hours", least=3))
    return out.select("sender_id", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(n) for c, n in (("start", "began"), ("end", "ended"))), "n", "total")


@query("s6_smurfing_stream", "txn", """
w AS (SELECT receiver_id, date_trunc('day', ts)::TIMESTAMP AS began, count(*) AS n FROM txn WHERE amount < 10000 GROUP BY 1, 2 HAVING count(*) >= 2 AND min(amount)::DOUBLE >= 0.7::DOUBLE * max(amount)::DOUBLE)
SELECT receiver_id, strftime(began, '%Y-%m-%d') AS began, n FROM w WHERE began + INTERVAL 1 DAY <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY FROM txn WHERE amount < 10000)""")  # fmt: skip
def s6(spark, sf):
    out = ran(spark, S.smurfing(moving(spark, sf), least=2, similarity=0.7))
    return out.select("receiver_id", F.date_format("start", "yyyy-MM-dd").alias("began"), "n")


@query("s4_rising_sequence_stream", "txn", """
SELECT a.sender_id, a.transaction_id::VARCHAR AS t1, b.transaction_id::VARCHAR AS t2, c.transaction_id::VARCHAR AS t3
FROM txn a JOIN txn b ON a.sender_id = b.sender_id AND b.ts > a.ts JOIN txn c ON c.sender_id = a.sender_id AND c.ts > b.ts AND c.ts <= a.ts + INTERVAL 24 HOURS
WHERE a.amount < 5000 AND b.amount BETWEEN 5000 AND 15000 AND c.amount > 15000""")  # fmt: skip
def s4(spark, sf):
    return ran(spark, stateful.rising_sequence(moving(spark, sf)))


@query("s5_layering_sequence_stream", "txn", f"""{LAST},
p AS (SELECT w.sender_id, w.transaction_id, w.ts, min(d.ts) AS since FROM txn w JOIN txn d ON d.sender_id = w.sender_id AND d.ts < w.ts AND d.ts >= w.ts - INTERVAL 7 DAYS
  WHERE w.transaction_type = 'crypto' AND d.transaction_type = 'cash_deposit' AND w.ts <= (SELECT until FROM last) GROUP BY 1, 2, 3)
SELECT p.sender_id, p.transaction_id::VARCHAR AS transaction_id, count(*) AS n_transfers FROM p JOIN txn x ON x.sender_id = p.sender_id AND x.ts > p.since AND x.ts < p.ts
WHERE x.transaction_type IN ('wire_transfer', 'ach') GROUP BY 1, 2 HAVING count(*) >= 3""")  # fmt: skip
def s5(spark, sf):
    return ran(spark, stateful.layering_sequence(moving(spark, sf), withdrawals=("crypto",)))


#: Where the invented time of feedback starts, in seconds. Spark's first watermark is 1970, and what is not after it is late.
START = 1_704_067_200


# feedback has no time: a minute passes between the ids of documents; a segment is a seventh of them
@query("s7_thresholds_stream", "", _FEEDBACK + f""", o AS (SELECT doc_id, doc_id % 7 AS segment, row_number() OVER (PARTITION BY doc_id % 7 ORDER BY doc_id) AS place, CASE class WHEN 'FP' THEN 1 WHEN 'FN' THEN -1 ELSE 0 END AS s,
  len(list_filter(patterns, lambda p: contains(p, 'structuring'))) AS a, len(list_filter(patterns, lambda p: contains(p, 'high_value') AND NOT contains(p, 'structuring'))) AS b FROM fc),
f AS (SELECT segment, 0::BIGINT AS place, -1::BIGINT AS doc_id, 9500::DOUBLE AS structuring, 10000::DOUBLE AS high_value, 0.7::DOUBLE AS anomaly FROM (SELECT DISTINCT segment FROM o) UNION ALL
  SELECT o.segment, o.place, o.doc_id, {_STEP.format('f.structuring', 50, 'a', 9000, '1e18')}, {_STEP.format('f.high_value', 500, 'b', 5000, '1e18')}, {_STEP.format('f.anomaly', 0.02, 1, 0.5, 0.95)} FROM f JOIN o ON o.segment = f.segment AND o.place = f.place + 1)
SELECT segment, doc_id, structuring, high_value, round(anomaly, 6) AS anomaly FROM f WHERE place > 0 AND doc_id <= (SELECT max(doc_id) - 60 FROM labels)""", recursive=True)  # fmt: skip
def s7(spark, sf):
    rows = feedback(spark, sf, stream(spark, sf, "labels")).withColumns({"segment": F.col("doc_id") % 7, "ts": F.timestamp_seconds(START + F.col("doc_id") * 60), "place": F.col("doc_id")})
    out = ran(spark, stateful.feedback_thresholds(rows, {"structuring": 9500.0, "high_value": 10000.0, "anomaly": 0.7}))
    return out.select("segment", F.col("place").alias("doc_id"), "structuring", "high_value", F.round("anomaly", 6).alias("anomaly"))


@query("s8_once_stream", "txn", "SELECT transaction_id, amount::DOUBLE AS amount FROM txn")
def s8(spark, sf):
    twice = stream(spark, sf, "events").union(stream(spark, sf, "events"))
    return ran(spark, S.once(txn(spark, sf, twice))).select("transaction_id", F.col("amount").cast("double").alias("amount"))


# alerts are what is suspicious, half an hour (or two hours, for one in three) after its transaction
@query("s9_with_alerts_stream", "txn", "SELECT transaction_id, amount::DOUBLE AS amount FROM txn WHERE is_suspicious AND transaction_id % 3 <> 0")
def s9(spark, sf):
    delay = F.when(F.col("transaction_id") % 3 == 0, F.expr("INTERVAL 2 HOURS")).otherwise(F.expr("INTERVAL 30 MINUTES"))
    alerts = moving(spark, sf).where("is_suspicious").select(F.col("transaction_id").alias("alert_transaction_id"), (F.col("ts") + delay).alias("alert_ts"))
    return ran(spark, S.with_alerts(moving(spark, sf), alerts)).select("transaction_id", F.col("amount").cast("double").alias("amount"))


@query("s10_live_figures_stream", "txn", """
w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS began, count(*) AS n, count(*) FILTER (is_suspicious) AS alerts, avg(risk_score) AS risk FROM txn GROUP BY 1)
SELECT strftime(began, '%Y-%m-%d %H:%M:%S') AS began, n, alerts, round(risk, 6) AS risk FROM w WHERE began + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 MINUTE FROM txn)""")  # fmt: skip
def s10(spark, sf):
    out = ran(spark, S.live(moving(spark, sf), every="1 hour"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("began"), "n", "alerts", F.round("risk", 6).alias("risk"))
