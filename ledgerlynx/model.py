"""Schemas and parameters that the operators share. Amounts are decimals; sums turn to double at the end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRANSACTION = (
    "transaction_id string, ts timestamp, amount decimal(18,2), currency string, transaction_type string, sender_id string, receiver_id string, "
    "country_origin string, country_destination string, description string, risk_score double"
)
CUSTOMER = "customer_id string, name string, customer_type string, registration_date timestamp, kyc_status string, risk_rating string, country string, is_pep boolean, is_sanctioned boolean"

#: Fixed values.
TRANSACTION_TYPES = ("wire_transfer", "cash_deposit", "cash_withdrawal", "check", "ach", "card_payment", "crypto", "international")
HIGH_RISK_COUNTRIES = ("IR", "KP", "SY", "AF", "IQ", "LY", "SO", "SD", "YE", "MM")
CURRENCIES = ("USD", "EUR", "GBP", "JPY", "CHF", "CAD", "AUD", "CNY", "BRL")
SENSITIVE_COLUMNS = ("ssn", "tax_id", "account_number", "card_number")

DAY_US = 86_400_000_000


def micros(c: str = "ts") -> Column:
    return F.unix_micros(F.col(c))


def money(c: Column | str) -> Column:
    """A decimal result as double."""
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def level_of(score: Column) -> Column:
    return F.when(score >= 0.85, "critical").when(score >= 0.65, "high").when(score >= 0.40, "medium").otherwise("low")
