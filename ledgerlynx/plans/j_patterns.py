"""A1-A3, J1-J3, F17, S4, S6, S11 over the driver's tables."""

from pyspark.sql import functions as F

from ..operators import patterns as P
from .bindings import AS_OF, query, txn


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("a1_structuring_tumbling", "txn", """
SELECT sender_id, strftime(time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, sum(amount)::DOUBLE AS total, round(avg(amount::DOUBLE), 4) AS average,
  array_to_string(list_sort(list(transaction_id)), ',') AS ids
FROM txn WHERE amount < 10000 GROUP BY 1, 2 HAVING count(*) >= 3 AND sum(amount) > 10000""")  # fmt: skip
def a1(spark, sf):
    return P.structuring_windows(txn(spark, sf)).withColumns({"window_start": stamp("window_start"), "ids": F.array_join("ids", ",")})


@query("a2_structuring_daily", "txn", f"""
SELECT sender_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date, count(*) AS n, sum(amount)::DOUBLE AS total, array_to_string(list_sort(list(amount::BIGINT)), ',') AS amounts
FROM txn WHERE amount < 10000 AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAYS AND ts < TIMESTAMP '{AS_OF}'
GROUP BY sender_id, CAST(ts AS DATE) HAVING count(*) >= 3 AND sum(amount) > 10000 ORDER BY sum(amount) DESC, sender_id, CAST(ts AS DATE) LIMIT 1000""")  # fmt: skip
def a2(spark, sf):
    out = P.structuring_days(txn(spark, sf), AS_OF)
    return out.select("sender_id", F.col("date").cast("string").alias("date"), "n", F.col("total").cast("double").alias("total"), F.expr("array_join(transform(amounts, a -> cast(cast(a as bigint) as string)), ',')").alias("amounts"))


@query("a3_structuring_sliding", "txn", """
, w AS (SELECT sender_id, amount, unnest(range(0, 7)) AS k, date_trunc('day', ts) AS d FROM txn WHERE amount < 10000)
SELECT sender_id, strftime(d - to_days(CAST(k AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, sum(amount)::DOUBLE AS total
FROM w GROUP BY 1, 2 HAVING count(*) >= 3 AND sum(amount) > 10000""".replace(", w AS", "w AS", 1))  # fmt: skip
def a3(spark, sf):
    return P.structuring_windows(txn(spark, sf), slide="1 day").select("sender_id", stamp("window_start").alias("window_start"), "n", "total")


@query("j1_reciprocal", "txn", "SELECT a.transaction_id AS t1, b.transaction_id AS t2 FROM txn a JOIN txn b ON a.sender_id = b.receiver_id AND a.receiver_id = b.sender_id")
def j1(spark, sf):
    return P.reciprocal(txn(spark, sf)).select(F.col("transaction_id_1").alias("t1"), F.col("transaction_id_2").alias("t2"))


@query("j2_return_48h", "txn", """
SELECT a.transaction_id AS t1, b.transaction_id AS t2 FROM txn a JOIN txn b ON a.sender_id = b.receiver_id AND a.receiver_id = b.sender_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 48 HOURS""")  # fmt: skip
def j2(spark, sf):
    return P.reciprocal(txn(spark, sf), "48 HOURS").select(F.col("transaction_id_1").alias("t1"), F.col("transaction_id_2").alias("t2"))


@query("j3_three_party", "txn", """
SELECT a.transaction_id AS t1, b.transaction_id AS t2, c.transaction_id AS t3, (a.amount + b.amount + c.amount)::DOUBLE AS total
FROM txn a JOIN txn b ON a.receiver_id = b.sender_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 7 DAYS
JOIN txn c ON b.receiver_id = c.sender_id AND c.receiver_id = a.sender_id AND c.ts > b.ts AND c.ts <= a.ts + INTERVAL 7 DAYS
WHERE a.amount + b.amount + c.amount > 50000 AND a.sender_id <> a.receiver_id AND b.sender_id <> b.receiver_id AND c.sender_id <> c.receiver_id AND b.receiver_id <> a.sender_id""")  # fmt: skip
def j3(spark, sf):
    return P.three_party(txn(spark, sf), kind=None).select("t1", "t2", "t3", (F.col("a1") + F.col("a2") + F.col("a3")).cast("double").alias("total"))


@query("f17_many_senders", "txn", """
SELECT receiver_id, strftime(time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start, count(DISTINCT sender_id) AS n_senders FROM txn GROUP BY 1, 2 HAVING count(DISTINCT sender_id) >= 5""")  # fmt: skip
def f17(spark, sf):
    return P.many_senders(txn(spark, sf)).withColumn("window_start", stamp("window_start"))


@query("s4_rising_sequence", "txn", """
SELECT a.sender_id, a.transaction_id AS t1, b.transaction_id AS t2, c.transaction_id AS t3
FROM txn a JOIN txn b ON a.sender_id = b.sender_id AND b.ts > a.ts JOIN txn c ON c.sender_id = a.sender_id AND c.ts > b.ts AND c.ts <= a.ts + INTERVAL 24 HOURS
WHERE a.amount < 5000 AND b.amount BETWEEN 5000 AND 15000 AND c.amount > 15000""")  # fmt: skip
def s4(spark, sf):
    return P.rising_sequence(txn(spark, sf))


# the tables have no withdrawals: crypto rows stand for them
@query("s5_layering_sequence", "txn", """
p AS (SELECT w.sender_id, w.transaction_id, w.ts, min(d.ts) AS since FROM txn w JOIN txn d ON d.sender_id = w.sender_id AND d.ts < w.ts AND d.ts >= w.ts - INTERVAL 7 DAYS
  WHERE w.transaction_type = 'crypto' AND d.transaction_type = 'cash_deposit' GROUP BY 1, 2, 3)
SELECT p.sender_id, p.transaction_id, count(*) AS n_transfers FROM p JOIN txn x ON x.sender_id = p.sender_id AND x.ts > p.since AND x.ts < p.ts
WHERE x.transaction_type IN ('wire_transfer', 'ach') GROUP BY 1, 2 HAVING count(*) >= 3""")  # fmt: skip
def s5(spark, sf):
    return P.layering_sequence(txn(spark, sf), withdrawals=("crypto",))


@query("s6_smurfing_receivers", "txn", """
SELECT receiver_id, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, sum(amount)::DOUBLE AS total FROM txn WHERE amount < 10000
GROUP BY 1, 2 HAVING count(*) >= 5 AND min(amount)::DOUBLE >= 0.2 * max(amount)::DOUBLE""")  # fmt: skip
def s6(spark, sf):
    return P.smurfing_receivers(txn(spark, sf), least=5, similarity=0.2).withColumn("window_start", stamp("window_start"))


@query("s11_registered_pattern", "txn", "SELECT transaction_id FROM txn WHERE transaction_type = 'crypto' AND country_destination = 'IR'")
def s11(spark, sf):
    return P.matching(txn(spark, sf), {"transaction_type": "crypto", "country_destination": "IR"}).select("transaction_id")
