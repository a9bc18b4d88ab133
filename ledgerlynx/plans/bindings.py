"""The driver's tables as transactions, customers, edges and so on; each in Spark and as a DuckDB CTE."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

COUNTRIES = "US GB DE FR BR CH SG AE MX JP CN CA AU IR KP SY AF IQ KY PA RU IT ES NL IN".split()
TYPES = {"purchase": "wire_transfer", "signup": "cash_deposit", "click": "card_payment", "view": "ach"}
AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def country(key: str) -> Column:
    return F.element_at(F.array(*map(F.lit, COUNTRIES)), F.col(key) + 1)


def txn(spark: SparkSession, sf: str, events: DataFrame | None = None) -> DataFrame:
    """Transactions; customers are the only lookup and join without hints. events: the table as a stream, say."""
    e = (table(spark, sf, "events") if events is None else events).withColumn("receiver_id", F.get_json_object("props", "$.k").cast("long"))
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    sender, receiver = c.toDF("sender_id", "origin_key"), c.toDF("receiver_id", "dest_key")
    kind = F.lit("crypto")
    for event, named in TYPES.items():
        kind = F.when(F.col("event_type") == event, named).otherwise(kind)
    t = e.withColumnRenamed("user_id", "sender_id").join(sender, "sender_id").join(receiver, "receiver_id")
    return t.select(
        F.col("event_id").alias("transaction_id"), F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("decimal(18,2)").alias("amount"),
        F.lit("USD").alias("currency"), kind.alias("transaction_type"), "sender_id", "receiver_id",
        country("origin_key").alias("country_origin"), country("dest_key").alias("country_destination"),
    ).withColumn("risk_score", F.least(F.col("amount").cast("double") / 50000, F.lit(1.0))).withColumn("is_suspicious", F.col("amount") >= 9000)


_CASES = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TYPES.items())
_NAMES = "[" + ", ".join(f"'{c}'" for c in COUNTRIES) + "]"
CTES = {
    "txn": f"""txn AS (
  SELECT *, least(CAST(amount AS DOUBLE) / 50000, 1.0) AS risk_score, amount >= 9000 AS is_suspicious FROM (
    SELECT e.event_id AS transaction_id, e.ts, CAST(ROUND(e.value * 100) AS DECIMAL(18,2)) AS amount, 'USD' AS currency,
           CASE e.event_type {_CASES} ELSE 'crypto' END AS transaction_type, e.user_id AS sender_id,
           CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS receiver_id,
           list_extract({_NAMES}, sc.c_nationkey + 1) AS country_origin, list_extract({_NAMES}, rc.c_nationkey + 1) AS country_destination
    FROM events e JOIN customer sc ON sc.c_custkey = e.user_id
    JOIN customer rc ON rc.c_custkey = CAST(json_extract_string(e.props, '$.k') AS BIGINT)))""",
    "customers": """customers AS (
  SELECT c_custkey AS customer_id, c_name AS name, c_mktsegment AS customer_type, CASE WHEN c_acctbal >= 0 THEN 'verified' ELSE 'pending' END AS kyc_status,
         CASE WHEN c_acctbal < 0 THEN 'critical' WHEN c_acctbal < 1000 THEN 'high' WHEN c_acctbal < 5000 THEN 'medium' ELSE 'low' END AS risk_rating,
         c_custkey % 50 = 0 AS is_pep, c_custkey % 97 = 3 AS is_sanctioned, DATE '2023-12-01' + CAST(c_custkey % 60 AS INTEGER) AS registration_date
  FROM customer)""",
    "edges": """edges AS (
  SELECT sender_id AS src, receiver_id AS dst, count(*) AS n, sum(amount) AS total, min(ts) AS first_ts, max(ts) AS last_ts FROM txn GROUP BY 1, 2)""",
}
_NEEDS = {"edges": ["txn"]}


def customers(spark: SparkSession, sf: str) -> DataFrame:
    b, k = F.col("c_acctbal"), F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("customer_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("customer_type"),
        F.when(b >= 0, "verified").otherwise("pending").alias("kyc_status"),
        F.when(b < 0, "critical").when(b < 1000, "high").when(b < 5000, "medium").otherwise("low").alias("risk_rating"),
        (k % 50 == 0).alias("is_pep"), (k % 97 == 3).alias("is_sanctioned"), F.date_add(F.lit("2023-12-01").cast("date"), (k % 60).cast("int")).alias("registration_date"),
    )


def sql(needs: str, body: str, recursive: bool = False) -> str:
    """body after the CTEs it names. A body may start with further CTEs (`name AS (...), ... SELECT`)."""
    named: list[str] = []
    for n in needs.split():
        named += [x for x in [*_NEEDS.get(n, []), n] if x not in named]
    head = ",\n".join(CTES[n] for n in named)
    body = body.strip()
    joins = ",\n" if head and not body.upper().startswith("SELECT") else "\n"
    word = "WITH RECURSIVE " if recursive else "WITH "
    return (word + head + joins + body) if head else (body if body.upper().startswith("SELECT") else word + body)


def query(name: str, needs: str = "", oracle: str | None = None, recursive: bool = False):
    """Register a function (spark, sf_dir) -> DataFrame and, if given, its DuckDB form."""

    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = sql(needs, oracle, recursive)
        return f

    return register
