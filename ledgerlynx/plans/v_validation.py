"""V1-V11 over the driver's tables."""

from pyspark.sql import functions as F

from ..model import level_of
from ..operators import validation as V
from .bindings import AS_OF, customers, query, table, txn

R = "('IR','KP','SY','AF','IQ','LY','SO','SD','YE','MM')"


@query("v1_schema_rules", "txn", """
SELECT transaction_id, CASE WHEN amount > 0 THEN '' ELSE 'amount' END AS errors FROM txn""")  # fmt: skip
def v1(spark, sf):
    return V.check_schema(txn(spark, sf)).select("transaction_id", F.array_join("errors", ",").alias("errors"))


@query("v2_ingest_check", "txn", f"""
SELECT transaction_id, CASE WHEN amount <= 0 THEN 1.0 WHEN ts < TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS THEN 0.4 ELSE 0.0 END::DOUBLE AS risk, amount <= 0 AS suspicious FROM txn""")  # fmt: skip
def v2(spark, sf):
    return V.ingest_check(txn(spark, sf), AS_OF).select("transaction_id", F.col("check_risk").alias("risk"), F.col("check_suspicious").alias("suspicious"))


@query("v3_dates", "txn", "SELECT transaction_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date FROM txn")
def v3(spark, sf):
    return txn(spark, sf).select("transaction_id", F.to_date("ts").cast("string").alias("date"))


@query("v4_country_flags", "txn", f"""
SELECT transaction_id, concat_ws(',', CASE WHEN country_origin IN {R} THEN 'high_risk_origin' END, CASE WHEN country_destination IN {R} THEN 'high_risk_destination' END) AS patterns,
  CASE WHEN country_origin IN {R} OR country_destination IN {R} THEN 0.7 ELSE 0.0 END::DOUBLE AS risk FROM txn""")  # fmt: skip
def v4(spark, sf):
    return V.country_flags(txn(spark, sf)).select("transaction_id", F.array_join("patterns", ",").alias("patterns"), F.col("country_risk").alias("risk"))


@query("v5_enrichment", "txn customers", f"""
SELECT t.transaction_id, s.is_pep AS sender_pep, s.is_sanctioned AS sender_sanctioned, r.is_pep AS receiver_pep, r.is_sanctioned AS receiver_sanctioned,
  greatest(CASE WHEN s.is_sanctioned OR r.is_sanctioned THEN 1.0 WHEN s.is_pep OR r.is_pep THEN 0.6 ELSE 0 END, CASE WHEN country_origin IN {R} OR country_destination IN {R} THEN 0.7 ELSE 0 END)::DOUBLE AS risk,
  (s.is_sanctioned OR r.is_sanctioned OR country_origin IN {R} OR country_destination IN {R}) AS alert
FROM txn t JOIN customers s ON s.customer_id = t.sender_id JOIN customers r ON r.customer_id = t.receiver_id""")  # fmt: skip
def v5(spark, sf):
    out = V.enrich(txn(spark, sf), customers(spark, sf))
    return out.select("transaction_id", "sender_pep", "sender_sanctioned", "receiver_pep", "receiver_sanctioned", F.col("enriched_risk").alias("risk"), "alert")


@query("v6_profile_check", "txn customers", """
SELECT t.transaction_id, CASE WHEN s.risk_rating IN ('high','critical') OR r.risk_rating IN ('high','critical') THEN 0.7 WHEN s.kyc_status <> 'verified' THEN 0.5 ELSE 0 END::DOUBLE AS risk,
  (s.risk_rating IN ('high','critical') OR r.risk_rating IN ('high','critical')) AS suspicious
FROM txn t JOIN customers s ON s.customer_id = t.sender_id JOIN customers r ON r.customer_id = t.receiver_id""")  # fmt: skip
def v6(spark, sf):
    return V.profile_check(txn(spark, sf), customers(spark, sf)).select("transaction_id", F.col("profile_risk").alias("risk"), F.col("profile_suspicious").alias("suspicious"))


@query("v7_record_hash", "txn", """
SELECT transaction_id, sha256('{"amount":' || amount::VARCHAR || ',"receiver_id":' || receiver_id || ',"sender_id":' || sender_id || ',"transaction_id":' || transaction_id || '}') AS record_hash FROM txn""")  # fmt: skip
def v7(spark, sf):
    return V.record_hash(txn(spark, sf), ["transaction_id", "sender_id", "receiver_id", "amount"]).select("transaction_id", "record_hash")


@query("v8_redaction", "customers", "SELECT customer_id, '***REDACTED***' AS account_number FROM customers")
def v8(spark, sf):
    return V.redact_columns(customers(spark, sf).withColumn("account_number", F.col("name"))).select("customer_id", "account_number")


@query("v9_scalar_helpers", "txn", f"""
SELECT transaction_id, CASE WHEN risk_score >= 0.85 THEN 'critical' WHEN risk_score >= 0.65 THEN 'high' WHEN risk_score >= 0.4 THEN 'medium' ELSE 'low' END AS level,
  'USD ' || format('{{:,.2f}}', amount::DOUBLE) AS amount_text, round(least((risk_score * 2 + 0.5) / 3, 1), 6) AS combined,
  round(epoch_us(TIMESTAMP '{AS_OF}') / 3600000000 - epoch_us(ts) / 3600000000, 3) AS hours
FROM txn""")  # fmt: skip
def v9(spark, sf):
    risk = F.col("risk_score")
    return txn(spark, sf).select(
        "transaction_id", level_of(risk).alias("level"), V.currency_text(F.col("amount"), F.col("currency")).alias("amount_text"),
        F.round(V.weighted_mean([risk, F.lit(0.5)], [2.0, 1.0]), 6).alias("combined"), F.round(V.time_gap(F.lit(AS_OF).cast("timestamp"), F.col("ts"), "hours"), 3).alias("hours"),
    )


@query("v10_listing", "txn", "SELECT transaction_id, risk_score FROM txn WHERE transaction_type = 'crypto' ORDER BY risk_score DESC, transaction_id LIMIT 50")
def v10(spark, sf):
    return V.listing(txn(spark, sf), "risk_score", "transaction_id", 50, transaction_type="crypto").select("transaction_id", "risk_score")


@query("v11_amount_filter", "txn", "SELECT transaction_id, amount::DOUBLE AS amount FROM txn WHERE amount > 15000")
def v11(spark, sf):
    return txn(spark, sf).where("amount > 15000").select("transaction_id", F.col("amount").cast("double").alias("amount"))


@query("io1_load_transactions", "txn", "SELECT count(*) AS n, sum(amount)::DOUBLE AS total FROM txn")
def io1(spark, sf):
    return txn(spark, sf).agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"))


@query("m13_quality_counts", "", "SELECT count(*) AS n, count(*) FILTER (text IS NULL) AS missing, count(*) FILTER (n_chars < 0) AS out_of_range, count(*) - count(DISTINCT text) AS repeated FROM documents")
def m13(spark, sf):
    d = table(spark, sf, "documents")
    return d.agg(F.count("*").alias("n"), F.count_if(F.isnull("text")).alias("missing"), F.count_if(F.col("n_chars") < 0).alias("out_of_range"), (F.count("*") - F.count_distinct("text")).alias("repeated"))
