"""Features of a transaction and of its sender's history.

History is what the same sender did strictly earlier; rows at the same microsecond are no history. "Within N
days" means less than N + 1 days. All frames share one partitioning and one order, so one exchange and one
sort serve them all."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..model import DAY_US, HIGH_RISK_COUNTRIES, TRANSACTION_TYPES


def amount() -> Column:
    return F.col("amount").cast("double")


def base(key: str = "sender_id") -> WindowSpec:
    return Window.partitionBy(key).orderBy(F.unix_micros("ts"))


def earlier(days: int | None = None, key: str = "sender_id") -> WindowSpec:
    low = Window.unboundedPreceding if days is None else -((days + 1) * DAY_US - 1)
    return base(key).rangeBetween(low, -1)


def within(us: int, key: str = "sender_id") -> WindowSpec:
    return base(key).rangeBetween(-us, -1)


def basic(t: DataFrame) -> DataFrame:
    """F1."""
    hour, day = F.hour("ts"), F.weekday("ts")
    return t.withColumns({
        "amount_value": amount(), "hour": hour, "weekday": day, "day": F.dayofmonth("ts"), "month": F.month("ts"), "weekend": (day >= 5).cast("int"), "business_hours": hour.between(9, 17).cast("int"),
        "night": ((hour < 6) | (hour > 22)).cast("int"), "log_amount": F.log1p(amount()), "sqrt_amount": F.sqrt(amount()),
    })


def roundness(amount: Column) -> Column:
    """1 for multiples of 10,000, then less for each smaller unit."""
    steps = ((10_000, 1.0), (5_000, 0.9), (1_000, 0.8), (500, 0.6), (100, 0.4))
    out = F.lit(0.0)
    for unit, score in reversed(steps):
        out = F.when(amount % unit == 0, score).otherwise(out)
    return out


def rounding(t: DataFrame) -> DataFrame:
    """F2."""
    a = F.col("amount")
    return t.withColumns({"mod_1000": (a % 1000).cast("double"), "mod_10000": (a % 10_000).cast("double"), "last_digit": (F.floor(a) % 10).cast("int"), "roundness": roundness(a), "cents": (a % 1 != 0).cast("int")})


def type_flags(t: DataFrame) -> DataFrame:
    """F3."""
    return t.withColumns({f"is_{k}": (F.col("transaction_type") == k).cast("int") for k in TRANSACTION_TYPES})


def geography(t: DataFrame, countries=HIGH_RISK_COUNTRIES) -> DataFrame:
    """F4."""
    o, d = (F.col(c).isin(*countries).cast("int") for c in ("country_origin", "country_destination"))
    same = (F.col("country_origin") == F.col("country_destination")).cast("int")
    return t.withColumns({"domestic": same, "international": 1 - same, "origin_risk": o, "destination_risk": d, "any_risk": F.greatest(o, d), "both_risk": F.least(o, d)})


#: Rows of a sender that one task takes at most, but for what one minute brings.
BLOCK = 1_000_000


def order_statistics(t: DataFrame, block: int = BLOCK) -> DataFrame:
    """F5's quartiles (h_q25, h_median, h_q75, linear between rows) and percentile position (h_position) of each row's history; 0 without one.

    A sender's rows, in the order of time, are one sequence; every row asks for the k-th smallest of a prefix of it, and how many of a prefix are
    at most its own amount. A wavelet matrix over the ranks of the amounts answers all of them together, bit by bit of the
    rank, in n log n steps of numpy. A sender with more than `block` rows is cut into blocks of time that different tasks take: what a
    block needs of all before it is their distinct amounts with counts, which stand in the sequence as weighted entries."""
    minute = F.floor(F.unix_micros("ts") / 60_000_000)
    rows = t.withColumn("_us", F.unix_micros("ts"))
    counts = t.groupBy("sender_id", minute.alias("minute")).agg(F.count("*").alias("n"))
    hot = counts.groupBy("sender_id").agg(F.sum("n").alias("n")).where(F.col("n") > block).select("sender_id")
    before = Window.partitionBy("sender_id").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.join(hot, "sender_id", "left_semi").select("sender_id", "minute", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / block).cast("int").alias("_b"))
    blocks = blocks.select(F.col("sender_id").alias("_of"), F.col("minute").alias("_minute"), "_b")
    rows = rows.join(blocks, (F.col("sender_id") == F.col("_of")) & (minute == F.col("_minute")), "left").drop("_of", "_minute").withColumn("_b", F.coalesce("_b", F.lit(0)))
    last = blocks.groupBy("_of").agg(F.max("_b").alias("_last"))
    amounts = rows.where("amount IS NOT NULL").join(last, F.col("sender_id") == F.col("_of")).groupBy("sender_id", "_b", "_last", amount().alias("value")).agg(F.count("*").alias("n"))
    past = amounts.where("_b < _last").withColumn("_b", F.explode(F.sequence(F.col("_b") + 1, F.col("_last")))).groupBy("sender_id", "_b", "value").agg(F.sum("n").alias("n"))
    past = past.select(F.col("sender_id").alias("_of"), F.col("_b").alias("_at"), "value", "n")
    made = ("h_q25", "h_median", "h_q75", "h_position")
    schema = StructType([*rows.schema.fields, *(StructField(c, DoubleType()) for c in made)])
    arrow = to_arrow_schema(schema)

    def run(key, own: pa.Table, state: pa.Table) -> pa.Table:
        us = own["_us"].to_numpy(zero_copy_only=False).astype(float)
        value = pc.cast(own["amount"], pa.float64()).to_numpy(zero_copy_only=False).astype(float)
        found = history_order(us, value, state["value"].to_numpy(), state["n"].to_numpy())
        for name, column in zip(made, found, strict=True):
            own = own.append_column(name, pa.array(column))
        return own.cast(arrow)

    out = rows.groupBy("sender_id", "_b").cogroup(past.groupBy("_of", "_at")).applyInArrow(run, schema)
    return out.drop("_us", "_b")


def history_order(us: np.ndarray, value: np.ndarray, past_values: np.ndarray, past_counts: np.ndarray) -> list[np.ndarray]:
    """Quartiles and position of the history of each row of one sender: the rows of earlier microseconds, after `past_values` so many times each."""
    known = np.flatnonzero(~np.isnan(value) & ~np.isnan(us))
    known = known[np.argsort(us[known], kind="stable")]
    sequence = np.concatenate([np.asarray(past_values, float), value[known]])
    weights = np.concatenate([np.asarray(past_counts, np.int64), np.ones(len(known), np.int64)])
    # a row without a time has no history
    ends = np.where(np.isnan(us), 0, len(past_values) + np.searchsorted(us[known], us, "left"))
    n = np.concatenate([[0], np.cumsum(weights)])[ends]
    places = [np.maximum(n - 1, 0) * p for p in (0.25, 0.5, 0.75)]
    low = [np.floor(p).astype(np.int64) for p in places]
    high = [np.minimum(k + 1, np.maximum(n - 1, 0)) for k in low]
    smallest, at_most = prefix_orders(sequence, weights, ends, [*low, *high], value)
    out = [smallest[k] + (smallest[k + 3] - smallest[k]) * (places[k] - low[k]) for k in range(3)]
    out.append(100.0 * at_most / np.maximum(n, 1))
    return [np.where(n > 0, x, 0.0) for x in out]


def prefix_orders(sequence: np.ndarray, weights: np.ndarray, ends: np.ndarray, ks: list[np.ndarray], limits: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each prefix sequence[:end] of weighted values: the k-th smallest for each k of ks, and the weight of what is at most its limit."""
    values, current = np.unique(sequence, return_inverse=True)
    below = np.where(np.isnan(limits), 0, np.searchsorted(values, limits, "right"))  # ranks under this one count
    bits = max(1, len(values).bit_length())
    asked = [[np.zeros_like(ends), ends.copy(), k.copy(), np.zeros_like(ends)] for k in ks]  # from, to, k, rank so far
    a, b, weight = np.zeros_like(ends), ends.copy(), np.zeros(len(ends), np.int64)
    for bit in range(bits - 1, -1, -1):
        zero = (current >> bit) & 1 == 0
        place, mass = np.concatenate([[0], np.cumsum(zero)]), np.concatenate([[0], np.cumsum(np.where(zero, weights, 0))])
        zeros = place[-1]
        for q in asked:
            here = mass[q[1]] - mass[q[0]]
            up = q[2] >= here
            q[2] = np.where(up, q[2] - here, q[2])
            q[0], q[1] = (np.where(up, zeros + x - place[x], place[x]) for x in q[:2])
            q[3] |= up.astype(np.int64) << bit
        up = (below >> bit) & 1 == 1
        weight += np.where(up, mass[b] - mass[a], 0)
        a, b = (np.where(up, zeros + x - place[x], place[x]) for x in (a, b))
        order = np.concatenate([np.flatnonzero(zero), np.flatnonzero(~zero)])
        current, weights = current[order], weights[order]
    return [values[np.minimum(q[3], max(0, len(values) - 1))] if len(values) else np.zeros(len(ends)) for q in asked], weight


def moments(t: DataFrame) -> DataFrame:
    """F5; all 0 without history."""
    w = earlier()
    n = F.count("*").over(w)
    mean, sd = F.avg(amount()).over(w), F.stddev_pop(amount()).over(w)
    out = order_statistics(t).withColumns({
        "h_n": n, "h_mean": mean, "h_sd": sd, "h_min": F.min(amount()).over(w), "h_max": F.max(amount()).over(w),
        "h_skew": F.when(n >= 3, F.skewness(amount()).over(w)), "h_kurtosis": F.when(n >= 4, F.kurtosis(amount()).over(w)),
    })
    z = F.when(F.col("h_sd") > 0, (amount() - F.col("h_mean")) / F.col("h_sd"))
    out = out.withColumns({"h_iqr": F.col("h_q75") - F.col("h_q25"), "h_cv": F.when(F.col("h_mean") > 0, F.col("h_sd") / F.col("h_mean")), "h_z": z, "h_abs_z": F.abs(z)})
    made = [c for c in out.columns if c.startswith("h_")]
    # the deviation of equal amounts is not a number to compare
    return out.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in made})


def deviation(t: DataFrame) -> DataFrame:
    """F5's distance from the mean of the history in standard deviations alone, 0 without one."""
    w = earlier()
    sd = F.stddev_pop(amount()).over(w)
    z = F.when(sd > 0, F.abs(amount() - F.avg(amount()).over(w)) / sd)
    return t.withColumn("h_abs_z", F.coalesce(F.nanvl(z, F.lit(0.0)), F.lit(0.0)))


def position(t: DataFrame) -> DataFrame:
    """F5's percentile position: the share of the history at or below the amount, times 100."""
    return order_statistics(t).drop("h_q25", "h_median", "h_q75")


def velocity(t: DataFrame, days=(1, 7, 30)) -> DataFrame:
    """F6."""
    out = {}
    for d in days:
        w = earlier(d)
        out |= {f"n_{d}d": F.count("*").over(w), f"volume_{d}d": F.coalesce(F.sum("amount").over(w).cast("double"), F.lit(0.0)), f"mean_{d}d": F.coalesce(F.avg(amount()).over(w), F.lit(0.0)), f"max_{d}d": F.coalesce(F.max(amount()).over(w), F.lit(0.0))}
    return t.withColumns(out)


def habits(t: DataFrame) -> DataFrame:
    """F7, 0 with fewer than 3 rows of history. The order is by time, then id; the last rows are five, or all if there are fewer."""
    rows = Window.partitionBy("sender_id").orderBy("ts", "transaction_id")
    burst = F.count("*").over(within(DAY_US))
    near = F.count_if(F.col("amount").between(9_000, 10_000)).over(rows.rowsBetween(-10, -1))
    last = F.collect_list(amount()).over(rows.rowsBetween(-5, -1))
    rising = last == F.array_sort(last)
    gap = (F.unix_micros("ts") - F.max(F.unix_micros("ts")).over(rows.rowsBetween(Window.unboundedPreceding, -1))) / 3_600_000_000
    out = t.withColumns({"seen": F.count("*").over(rows.rowsBetween(Window.unboundedPreceding, -1)), "burst": burst, "near": near, "last": last, "rising": rising, "gap": gap})
    enough = F.col("seen") >= 3
    return out.withColumns({
        "burst": F.when(enough, F.col("burst")).otherwise(0), "near_count": F.when(enough, F.col("near")).otherwise(0), "burst_flag": (enough & (F.col("burst") > 10)).cast("int"), "near_flag": (enough & (F.col("near") >= 3)).cast("int"),
        "escalation": (enough & F.col("rising")).cast("int"), "escalation_ratio": F.when(~enough, 0.0).when(F.get("last", F.lit(0)) > 0, F.element_at("last", -1) / F.get("last", F.lit(0))).otherwise(1.0),
        "frequency_ratio": F.when(enough, 1.0).otherwise(0.0), "hours_since_last": F.when(enough, F.col("gap")).otherwise(0.0),
    }).drop("near", "last", "rising", "gap")


def roll_up(t: DataFrame) -> DataFrame:
    """F9, on top of F1, F4, F7 and the deviation of `deviation`."""
    a, h = F.col("amount"), F.col("hour")
    amount_risk = F.when(a >= 100_000, 1.0).when(a >= 50_000, 0.8).when(a >= 10_000, 0.5).otherwise(0.2)
    hour_risk = F.when((h < 6) | (h > 22), 0.8).when((h < 9) | (h > 18), 0.5).otherwise(0.2)
    geo = (F.col("origin_risk") + F.col("destination_risk")) / 2
    flags = (a % 1000 == 0).cast("int") + F.col("international") + F.col("any_risk") + F.col("night") + (F.col("h_abs_z") > 3).cast("int") + F.col("burst_flag") + F.col("near_flag")
    return t.withColumns({"flags": flags, "amount_risk": amount_risk, "hour_risk": hour_risk, "geo_risk": geo, "composite_risk": (amount_risk + hour_risk + geo) / 3})


def top_features(t: DataFrame, key: str, columns: list[str], words: tuple[str, ...] = ("risk", "flag", "high", "anomaly"), k: int = 5) -> DataFrame:
    """the k largest features of a row whose name has a keyword or whose value is above 0.7."""
    long = t.select(key, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(key, columns, "feature", "value")
    named = F.lit(False)
    for w in words:
        named = named | F.contains("feature", F.lit(w))
    long = long.where(named | (F.col("value") > 0.7))
    return long.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.abs("value").desc(), "feature"))).where(F.col("place") <= k)


def behaviour(t: DataFrame) -> DataFrame:
    """on top of F1, F5 and F6."""
    z = F.col("h_abs_z")
    risk = F.greatest(
        F.when(z > 3, F.least(z / 5, F.lit(0.9))).otherwise(0.0), F.when(F.col("n_7d") > 50, 0.7).otherwise(0.0), F.when(F.col("hour") < 3, 0.5).otherwise(0.0),
        F.when((F.col("h_mean") > 0) & (F.col("volume_7d") > 20 * F.col("h_mean")), 0.8).otherwise(0.0),
    )
    patterns = F.array_compact(F.array(F.when(z > 2, "amount_deviation"), F.when(F.col("n_7d") > 30, "high_frequency")))
    return t.withColumns({"behaviour_risk": risk, "patterns": patterns}).withColumn("anomalous", F.col("behaviour_risk") >= 0.75)


def baseline(t: DataFrame, rows: int = 1000) -> DataFrame:
    """the deviation from the mean of the last rows before this one, and the frequency over those with it."""
    order = Window.partitionBy("sender_id").orderBy("ts", "transaction_id")
    before, upto = order.rowsBetween(-rows, -1), order.rowsBetween(-(rows - 1), 0)
    mean, sd = F.avg(amount()).over(before), F.stddev_pop(amount()).over(before)
    deviation = F.when(sd > 0, F.abs(amount() - mean) / sd).otherwise(0.0)
    days = F.floor((F.unix_micros("ts") - F.min(F.unix_micros("ts")).over(upto)) / DAY_US)
    return t.withColumns({"b_mean": mean, "b_deviation": deviation, "b_frequency": F.count("*").over(upto) / F.greatest(days, F.lit(1))}).withColumn("b_anomalous", F.col("b_deviation") > 3)


def tempo(t: DataFrame) -> DataFrame:
    """F13."""
    order = Window.partitionBy("sender_id").orderBy("ts", "transaction_id")
    mean = F.avg(amount()).over(earlier())
    out = {"velocity_score": F.when(mean > 0, amount() / mean), "hours_to_next": (F.unix_micros(F.lead("ts").over(order)) - F.unix_micros("ts")) / 3_600_000_000}
    for name, us in (("1h", DAY_US // 24), ("24h", DAY_US), ("7d", 7 * DAY_US)):
        out[f"burst_{name}"] = F.count("*").over(within(us))
    return t.withColumns(out)


def running_total(t: DataFrame, day: Column) -> DataFrame:
    """the running sum over all rows in order of time and id, dealt by day: sums of days, then within a day."""
    t = t.withColumn("day_key", day)
    days = t.groupBy("day_key").agg(F.sum("amount").alias("s"))
    before = Window.orderBy("day_key").rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    starts = days.select("day_key", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("start"))
    within_day = Window.partitionBy("day_key").orderBy("ts", "transaction_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.join(F.broadcast(starts), "day_key").withColumn("running", (F.sum("amount").over(within_day) + F.col("start")).cast("double"))


def empirical_cdf(t: DataFrame, by: str, value: str, key: str) -> DataFrame:
    """F15."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(value, key)) - 1
    return t.withColumn("cdf", place / (F.count("*").over(Window.partitionBy(by)) - 1))


def category_outliers(t: DataFrame, category: str = "transaction_type", days: int = 30, least: float = 3.0) -> DataFrame:
    """F16: daily volume of a category against its mean over the days before."""
    daily = t.groupBy(category, F.unix_date(F.to_date("ts")).alias("day")).agg(F.sum("amount").cast("double").alias("volume"))
    w = Window.partitionBy(category).orderBy("day").rangeBetween(-days, -1)
    mean, sd = F.avg("volume").over(w), F.stddev_pop("volume").over(w)
    return daily.withColumn("z", F.when(sd > 0, (F.col("volume") - mean) / sd)).withColumn("outlier", F.coalesce(F.col("z") > least, F.lit(False)))
