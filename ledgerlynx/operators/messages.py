"""Columns of wire and card messages."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def swift_fields(message: Column) -> Column:
    """Tag to value; a tag that is repeated keeps its last value."""
    tags = F.regexp_extract_all(message, F.lit(r"(?m)^:(\d{2}[A-Z]?):"), F.lit(1))
    values = F.regexp_extract_all(message, F.lit(r"(?ms)^:\d{2}[A-Z]?:(.*?)(?=^:\d{2}[A-Z]?:|\z)"), F.lit(1))
    pairs = F.arrays_zip(tags.alias("k"), F.transform(values, lambda v: F.regexp_replace(v, r"\s+$", "")).alias("v"))

    def last(found: Column) -> Column:
        kept = F.filter(found, lambda p, i: ~F.exists(F.slice(found, i + 2, F.greatest(F.size(found) - i - 1, F.lit(0))), lambda q: q["k"] == p["k"]))
        return F.map_from_entries(F.transform(kept, lambda p: F.struct(p["k"], p["v"])))

    # as the element of an array, so that each row's pairs are found once and not anew for each of them
    return F.transform(F.array(pairs), last)[0]


def parse_mt103(df: DataFrame, message: str) -> DataFrame:
    """Reference, date, currency, amount and parties; a bad amount is 0."""
    f = df.withColumn("fields", swift_fields(F.col(message))).withColumn("settled", F.element_at("fields", "32A"))
    amount = F.coalesce(F.expr("try_cast(replace(substring(settled, 10), ',', '.') as decimal(18,2))"), F.lit(0).cast("decimal(18,2)"))

    def party(tag: str, name: str) -> list[Column]:
        lines = F.split(F.coalesce(F.element_at("fields", tag), F.lit("")), "\n")
        account = F.when(F.startswith(lines[0], F.lit("/")), F.substring(lines[0], 2, 64))
        rest = F.filter(lines, lambda x: ~F.startswith(x, F.lit("/")))
        return [account.alias(f"{name}_account"), F.get(rest, F.lit(0)).alias(f"{name}_name"), F.array_join(F.slice(rest, 2, 8), ", ").alias(f"{name}_address")]

    return f.select(*df.columns, F.element_at("fields", "20").alias("reference"), F.to_date(F.substring("settled", 1, 6), "yyMMdd").alias("date"), F.substring("settled", 7, 3).alias("currency"), amount.alias("amount"), *party("50K", "sender"), *party("59", "receiver"), F.element_at("fields", "71A").alias("charges"))


#: Field number, and its length or the digits of its length prefix (negative).
CARD_FIELDS = {2: -2, 3: 6, 4: 12, 7: 10, 11: 6, 12: 6, 13: 4, 14: 4, 18: 4, 22: 3, 25: 2, 32: -2, 35: -2, 37: 12, 38: 6, 39: 2, 41: 8, 42: 15, 43: 40, 48: -3, 49: 3, 54: -3, 55: -3, 60: -3, 61: -3, 62: -3, 63: -3, 70: 3, 90: 42, 95: 42}


def card_message(text: str) -> tuple[str | None, dict[int, str], str | None]:
    """One message: type, fields, error. The bitmap's first bit says whether a second one follows."""
    try:
        kind, at, bits = text[:4], 20, int(text[4:20], 16)
        width = 64
        if bits >> 63:
            bits, at, width = bits << 64 | int(text[20:36], 16), 36, 128
        out = {}
        for k in range(2, width + 1):
            if bits >> (width - k) & 1:
                size = CARD_FIELDS[k]
                if size < 0:
                    at, size = at - size, int(text[at : at - size])
                if at + size > len(text):
                    raise ValueError(f"field {k} is cut off")
                out[k], at = text[at : at + size], at + size
        return kind, out, None
    except (ValueError, KeyError, TypeError, IndexError) as e:
        return None, {}, f"{type(e).__name__}: {e}"


def parse_card_messages(df: DataFrame, key: str, message: str) -> DataFrame:
    """A cursor moves through each message, which no column expression does; batches by Arrow."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parsed = [card_message(m) for m in b["message"]]
            yield pd.DataFrame({"key": b["key"], "mti": [p[0] for p in parsed], "fields": [p[1] for p in parsed], "error": [p[2] for p in parsed]})

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("key"), F.col(message).alias("message")).mapInPandas(run, f"key {kind}, mti string, fields map<int,string>, error string").withColumnRenamed("key", key)


def card_columns(df: DataFrame) -> DataFrame:
    """From the map `fields`."""
    f = F.col("fields")
    pan = F.element_at(f, 2)
    return df.withColumns({
        "masked": F.concat(F.substring(pan, 1, 6), F.repeat(F.lit("*"), F.length(pan) - 10), F.right(pan, F.lit(4))), "bin": F.substring(pan, 1, 6), "last4": F.right(pan, F.lit(4)),
        "amount": F.element_at(f, 4).cast("decimal(18,2)") / 100, "hour": F.substring(F.element_at(f, 12), 1, 2).cast("int"), "mcc": F.element_at(f, 18), "entry": F.substring(F.element_at(f, 22), 1, 2), "response": F.element_at(f, 39),
    }).withColumn("chip", F.col("entry").isin("05", "07"))


#: Merchant categories and response codes of risk.
RISKY_MCC = ("7995", "7801", "6051", "4829", "5933")
RISKY_RESPONSES = ("14", "41", "43", "54")


def card_risk(df: DataFrame, mcc=RISKY_MCC, responses=RISKY_RESPONSES) -> DataFrame:
    """P5: the level uses the sum before the cap."""
    def flag(c: Column, w: float) -> Column:
        return F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0)

    total = F.round(
        flag(F.col("amount").between(9000, 9999), 0.4) + flag((F.col("hour") < 6) | (F.col("hour") > 22), 0.2) + flag(F.col("mcc").isin(*mcc), 0.3) + flag(F.col("entry") == "01", 0.15) + flag(~F.col("chip"), 0.1) + flag(F.col("response").isin(*responses), 0.25), 6
    )
    return df.withColumns({"card_risk": F.least(total, F.lit(1.0)), "card_level": F.when(total >= 0.7, "HIGH").when(total >= 0.4, "MEDIUM").otherwise("LOW")})
