"""Validation, enrichment and scalar checks of transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import CURRENCIES, HIGH_RISK_COUNTRIES, SENSITIVE_COLUMNS, TRANSACTION_TYPES


def labels(*pairs: tuple[Column, str]) -> Column:
    """The names whose condition holds, in the order given."""
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in pairs)))


def worst(*pairs: tuple[Column, float]) -> Column:
    """The largest score whose condition holds, or 0."""
    return F.greatest(F.lit(0.0), *(F.when(c, F.lit(float(v))).otherwise(0.0) for c, v in pairs))


def check_schema(txns: DataFrame) -> DataFrame:
    """V1: upper-cased codes and `errors`; rows without errors are good, the rest go to quarantine."""
    t = txns.withColumns({c: F.upper(c) for c in ("currency", "country_origin", "country_destination")})
    errors = labels(
        (~F.coalesce(F.col("amount") > 0, F.lit(False)), "amount"),
        (F.coalesce(F.length("currency"), F.lit(0)) != 3, "currency"),
        ((F.length("country_origin") != 2) | (F.length("country_destination") != 2), "country"),
        (~F.coalesce(F.col("transaction_type").isin(*TRANSACTION_TYPES), F.lit(False)), "transaction_type"),
        (~F.coalesce(F.col("risk_score").between(0, 1), F.lit(True)), "risk_score"),
    )
    return t.withColumn("errors", errors)


def ingest_check(txns: DataFrame, as_of: str, currencies=CURRENCIES) -> DataFrame:
    """V2: risk is the worst of the failed checks; a bad amount or a missing party is suspicious."""
    stale = F.abs(F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("ts")) > 86_400_000_000
    bad, missing = F.col("amount") <= 0, F.col("sender_id").isNull() | F.col("receiver_id").isNull()
    odd = ~F.coalesce(F.col("currency").isin(*currencies), F.lit(False))
    return txns.withColumns({
        "findings": labels((bad, "invalid_amount"), (missing, "missing_party"), (odd, "currency"), (stale, "timestamp")),
        "check_risk": worst((bad, 1.0), (missing, 0.8), (odd, 0.3), (stale, 0.4)), "check_suspicious": F.coalesce(bad, F.lit(False)) | missing, "confidence": F.lit(0.95),
    })


def country_flags(txns: DataFrame, countries=HIGH_RISK_COUNTRIES) -> DataFrame:
    """V4: risk 0.7 if either side is on the list."""
    origin, dest = F.col("country_origin").isin(*countries), F.col("country_destination").isin(*countries)
    return txns.withColumns({"patterns": labels((origin, "high_risk_origin"), (dest, "high_risk_destination")), "country_risk": worst((origin | dest, 0.7)), "country_suspicious": origin | dest})


def enrich(txns: DataFrame, flags: DataFrame) -> DataFrame:
    """V5: flags: customer_id, is_pep, is_sanctioned. Both sides are looked up; unknown parties have no flag."""
    out = txns
    for side in ("sender", "receiver"):
        own = flags.select(F.col("customer_id").alias(f"{side}_id"), F.col("is_pep").alias(f"{side}_pep"), F.col("is_sanctioned").alias(f"{side}_sanctioned"))
        out = out.join(own, f"{side}_id", "left").fillna(False, [f"{side}_pep", f"{side}_sanctioned"])
    out = country_flags(out)
    sanctioned, pep = F.col("sender_sanctioned") | F.col("receiver_sanctioned"), F.col("sender_pep") | F.col("receiver_pep")
    risk = F.greatest(worst((sanctioned, 1.0), (pep, 0.6)), "country_risk")
    out = out.withColumns({"enriched_risk": risk, "enriched_suspicious": sanctioned | F.col("country_suspicious"), "confidence": F.lit(0.98)})
    return out.withColumn("alert", F.col("enriched_suspicious") & (F.col("enriched_risk") >= 0.7))


def profile_check(txns: DataFrame, customers: DataFrame) -> DataFrame:
    """V6: risk ratings of both sides, and the sender's verification."""
    sender = customers.select(F.col("customer_id").alias("sender_id"), F.col("risk_rating").alias("sender_rating"), F.col("kyc_status").alias("sender_kyc"))
    receiver = customers.select(F.col("customer_id").alias("receiver_id"), F.col("risk_rating").alias("receiver_rating"))
    out = txns.join(sender, "sender_id", "left").join(receiver, "receiver_id", "left")
    rated = F.coalesce(F.col("sender_rating").isin("high", "critical"), F.lit(False)) | F.coalesce(F.col("receiver_rating").isin("high", "critical"), F.lit(False))
    return out.withColumns({"profile_risk": worst((rated, 0.7), (F.col("sender_kyc") != "verified", 0.5)), "profile_suspicious": rated, "confidence": F.lit(0.90)})


def record_hash(df: DataFrame, columns: list[str], name: str = "record_hash") -> DataFrame:
    """V7: SHA-256 of the record as JSON with sorted keys."""
    return df.withColumn(name, F.sha2(F.to_json(F.struct(*sorted(columns))), 256))


def redact_columns(df: DataFrame, columns=SENSITIVE_COLUMNS, mask: str = "***REDACTED***") -> DataFrame:
    """V8."""
    return df.withColumns({c: F.lit(mask) for c in columns if c in df.columns})


def currency_text(amount: Column, currency: Column) -> Column:
    return F.concat_ws(" ", currency, F.format_number(amount, 2))


def weighted_mean(scores: list[Column], weights: list[float]) -> Column:
    """V9: capped at 1."""
    return F.least(sum(s * w for s, w in zip(scores, weights, strict=True)) / sum(weights), F.lit(1.0))


def time_gap(a: Column, b: Column, unit: str) -> Column:
    per = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}[unit]
    return F.abs(F.unix_micros(a) - F.unix_micros(b)) / 1_000_000 / per


def listing(df: DataFrame, sort: str, key: str, limit: int, **equal) -> DataFrame:
    """Rows equal to all given values, by `sort` descending, `key` settling ties."""
    for c, v in equal.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    return df.orderBy(F.desc(sort), key).limit(limit)


