"""Regulatory rules, detectors, text and trade scores, and their consolidation.

A rule is a column of its own; `evaluate` turns those that hold into an array of ids. Rules on history
share the frames of `history`, so all of them cost one exchange and one sort by sender."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import DAY_US, HIGH_RISK_COUNTRIES, level_of
from ..shared import cut
from .history import amount, earlier, within
from .network import round_trips
from .validation import labels, worst

#: Id, name, severity, category, threshold (from, to) and regulation of all rules.
RULES = (
    ("R001", "High Value Transaction", "high", "threshold", 10_000, None, "BSA/CTR"), ("R002", "Very High Value", "critical", "threshold", 50_000, None, "FinCEN"), ("R003", "Extreme Value", "critical", "threshold", 100_000, None, "SAR Mandatory"),
    ("R004", "CTR Threshold", "high", "threshold", 9_000, 10_000, "BSA §103.22"), ("R005", "Cash Transaction", "high", "threshold", 5_000, None, "BSA"), ("R006", "Wire Transfer High", "medium", "threshold", 3_000, None, "Travel Rule"),
    ("R007", "International High", "medium", "threshold", 1_000, None, "FinCEN"), ("R008", "Daily Aggregate", "high", "threshold", 10_000, None, "BSA Aggregation"), ("R009", "Weekly Aggregate", "medium", "threshold", 25_000, None, "Velocity"),
    ("R010", "Monthly Aggregate", "medium", "threshold", 50_000, None, "Pattern"),
    ("R011", "Smurfing Pattern", "critical", "structuring", None, None, "31 USC 5324"), ("R012", "Sequential Deposits", "high", "structuring", None, None, "Structuring"), ("R013", "Round Amount Structuring", "high", "structuring", None, None, "Structuring"),
    ("R014", "Cross-Branch Structuring", "critical", "structuring", None, None, "Geographic Structuring"), ("R015", "Time-Based Structuring", "high", "structuring", None, None, "Temporal Pattern"), ("R016", "Incremental Structuring", "high", "structuring", None, None, "Progressive"),
    ("R017", "Multi-Account Structuring", "critical", "structuring", None, None, "Account Splitting"), ("R018", "Beneficiary Structuring", "high", "structuring", None, None, "Beneficiary Abuse"),
    ("R019", "Rapid Movement", "critical", "layering", None, None, "Layering Stage 2"), ("R020", "Circular Transfer", "critical", "layering", None, None, "Round-Tripping"), ("R021", "Complex Web", "high", "layering", None, None, "Obfuscation"),
    ("R022", "Foreign Layering", "critical", "layering", None, None, "International Layering"), ("R023", "Shell Company Transit", "critical", "layering", None, None, "Shell Usage"), ("R024", "Loan Back Scheme", "high", "layering", None, None, "Loan Back"),
    ("R025", "High-Risk Country", "critical", "geographic", None, None, "FATF Grey/Black List"), ("R026", "Sanctioned Country", "critical", "geographic", None, None, "OFAC Sanctions"), ("R027", "Tax Haven Route", "high", "geographic", None, None, "Tax Haven"),
    ("R028", "Conflict Zone", "critical", "geographic", None, None, "Conflict Finance"), ("R029", "Drug Corridor", "high", "geographic", None, None, "Narcotics Risk"), ("R030", "Unusual Route", "medium", "geographic", None, None, "Route Anomaly"),
    ("R031", "Dormant Account Spike", "critical", "behavioral", None, None, "Account Resurrection"), ("R032", "Sudden Pattern Change", "high", "behavioral", None, None, "Deviation"), ("R033", "Frequency Spike", "high", "behavioral", None, None, "Velocity Change"),
    ("R034", "New Account Rush", "high", "behavioral", None, None, "New Account"), ("R035", "Inconsistent Profile", "high", "behavioral", None, None, "Profile Mismatch"), ("R036", "Business Anomaly", "medium", "behavioral", None, None, "Business Mismatch"),
    ("R037", "ATM Abuse", "medium", "behavioral", None, None, "ATM Pattern"), ("R038", "Third-Party Abuse", "medium", "behavioral", None, None, "Third-Party"),
    ("R039", "Off-Hours Transaction", "medium", "timing", None, None, "Unusual Time"), ("R040", "Weekend/Holiday", "medium", "timing", None, None, "Non-Business Day"), ("R041", "Rapid Succession", "medium", "timing", None, None, "Burst"),
    ("R042", "Timed Pattern", "medium", "timing", None, None, "Automation Suspected"),
    ("R043", "PEP Transaction", "critical", "sanctions", None, None, "FATF PEP"), ("R044", "SDN Match", "critical", "sanctions", None, None, "OFAC SDN"), ("R045", "UN Sanctions", "critical", "sanctions", None, None, "UN 1267"),
    ("R046", "PEP Family/Associate", "high", "sanctions", None, None, "PEP RCA"),
    ("R047", "Over/Under Invoicing", "high", "trade", None, None, "TBML"), ("R048", "Phantom Shipping", "critical", "trade", None, None, "Trade Fraud"), ("R049", "Carousel Trading", "high", "trade", None, None, "Carousel VAT"), ("R050", "Dual-Use Goods", "critical", "trade", None, None, "Export Control"),
)
#: The rules that are evaluated by default; the others are listed, and some have forms in `extended_rules`.
EVALUATED = frozenset((*(f"R{k:03d}" for k in range(1, 14)), "R019", "R025", "R032", "R039", "R040", "R043", "R044"))
#: Id, severity and category of the evaluated rules.
CATALOGUE = tuple((r[0], r[2], r[3]) for r in RULES if r[0] in EVALUATED)
SEVERITY = {"low": 0.2, "medium": 0.5, "high": 0.8, "critical": 1.0}
KEYWORDS = {"urgent": 0.15, "cash": 0.1, "gift": 0.2, "crypto": 0.25, "consulting": 0.2, "donation": 0.25, "loan repayment": 0.3, "invoice": 0.1}


def catalogue(spark: SparkSession) -> DataFrame:
    """All rules as a small table."""
    rows = [(r, n, s, c, None if a is None else float(a), None if b is None else float(b), g, r in EVALUATED) for r, n, s, c, a, b, g in RULES]
    return spark.createDataFrame(rows, "rule string, name string, severity string, category string, threshold double, threshold_to double, regulation string, evaluated boolean")


def amount_rules(t: DataFrame) -> DataFrame:
    """Exclusive bands, and rules of one row."""
    a, kind = F.col("amount"), F.col("transaction_type")
    band = F.when(a > 100_000, "R003").when(a > 50_000, "R002").when(a > 10_000, "R001")
    return t.withColumns({
        "R001": band == "R001", "R002": band == "R002", "R003": band == "R003", "R004": a.between(9_000, 10_000), "R005": (kind == "cash_deposit") & (a > 5_000), "R006": (kind == "wire_transfer") & (a > 3_000),
        "R007": (F.col("country_origin") != F.col("country_destination")) & (a > 1_000),
    })


def history_rules(t: DataFrame) -> DataFrame:
    """R4-R8, R10."""
    a, any_before = F.col("amount"), F.count("*").over(earlier()) > 0
    near = a.between(9_000, 10_000) & (a < 10_000)
    w1, w7, w30 = earlier(0), earlier(7), earlier(30)
    mean = F.avg(amount()).over(earlier())

    def passes(w, limit):
        return any_before & (F.coalesce(F.sum("amount").over(w), F.lit(0)) + a > limit)

    return t.withColumns({
        "R008": passes(w1, 10_000), "R009": passes(w7, 25_000), "R010": passes(w30, 50_000), "R011": near & (F.count_if(near).over(w7) >= 2),
        "R012": (F.count("*").over(w1) >= 2) & (F.max("amount").over(w1) < 10_000), "R013": (a % 1000 == 0) & (F.count_if(a % 1000 == 0).over(w7) >= 2),
        "R019": F.count("*").over(within(2 * DAY_US)) >= 3, "R032": (mean > 0) & (amount() > 10 * mean),
    })


def place_and_time_rules(t: DataFrame, countries=HIGH_RISK_COUNTRIES) -> DataFrame:
    """R9, R11."""
    hour = F.hour("ts")
    return t.withColumns({"R025": F.col("country_origin").isin(*countries) | F.col("country_destination").isin(*countries), "R039": ((hour >= 23) | (hour < 5)) & (F.col("amount") > 10_000), "R040": F.weekday("ts") >= 5})


def party_rules(t: DataFrame, customers: DataFrame) -> DataFrame:
    """Flags of the sender."""
    own = customers.select(F.col("customer_id").alias("sender_id"), F.col("is_pep").alias("R043"), F.col("is_sanctioned").alias("R044"))
    return t.join(own, "sender_id", "left").fillna(False, ["R043", "R044"])


def all_rules(t: DataFrame, customers: DataFrame) -> DataFrame:
    return party_rules(place_and_time_rules(history_rules(amount_rules(t))), customers)


def evaluate(t: DataFrame, rules=CATALOGUE) -> DataFrame:
    """Fired rules, mean severity, highest severity, categories and the verdict."""
    fired = F.array_compact(F.array(*(F.when(F.col(r), F.lit(r)) for r, _, _ in rules)))
    severity = F.create_map(*(F.lit(x) for r, s, _ in rules for x in (r, SEVERITY[s])))
    category = F.create_map(*(F.lit(x) for r, _, c in rules for x in (r, c)))
    out = t.withColumn("fired", fired).withColumn("n_fired", F.size("fired"))
    out = out.withColumn("severities", F.transform("fired", lambda r: F.element_at(severity, r)))
    score = F.aggregate("severities", F.lit(0.0), lambda a, x: a + x)
    out = out.withColumns({"rule_score": F.when(F.col("n_fired") > 0, score / F.col("n_fired")).otherwise(0.0), "top": F.array_max("severities"), "categories": F.array_sort(F.array_distinct(F.transform("fired", lambda r: F.element_at(category, r))))})
    highest = F.when(F.col("top") >= 1.0, "critical").when(F.col("top") >= 0.8, "high").when(F.col("top") >= 0.5, "medium").when(F.col("top") >= 0.2, "low")
    out = out.withColumns({"highest": highest, "rule_suspicious": F.col("n_fired") > 0})
    return out.withColumn("rule_alert", (F.col("rule_score") > 0.6) | F.coalesce(F.col("highest").isin("high", "critical"), F.lit(False))).drop("severities", "top")


def rapid(t: DataFrame, least: int = 5, minutes: int = 60) -> DataFrame:
    """Transactions before which the sender took part, as sender or receiver, in `least` others within the minutes. Each
    transaction stands once for each party; a window counts a party's roles."""
    span = minutes * 60_000_000 - 1
    roles = t.select("transaction_id", "ts", F.explode(F.array_distinct(F.array("sender_id", "receiver_id"))).alias("party"), "sender_id")
    w = Window.partitionBy("party").orderBy(F.unix_micros("ts")).rangeBetween(-span, -1)
    seen = roles.withColumn("n", F.count("*").over(w)).where("party = sender_id").select("transaction_id", (F.col("n") >= least).alias("rapid"))
    return t.join(seen, "transaction_id")


def basic_detector(t: DataFrame) -> DataFrame:
    """R15, on top of `rapid`: nine rules; risk is the worst, the alert needs one of the suspicious ones."""
    a, kind, hour = F.col("amount"), F.col("transaction_type"), F.hour("ts")
    near, cash, own = (a >= 0.95 * 9_900) & (a < 9_900), kind.isin("cash_deposit", "cash_withdrawal") & (a >= 5_000), F.col("sender_id") == F.col("receiver_id")
    cross = (F.col("country_origin") != F.col("country_destination")) & (a >= 5_000)
    risk = worst((a >= 10_000, 0.6), (near, 0.75), ((a % 1000 == 0) & (a >= 5_000), 0.4), (cross, 0.5), (cash, 0.7), (kind == "crypto", 0.5), ((hour < 6) | (hour > 22), 0.3), (F.col("rapid"), 0.65), (own, 0.8))
    suspicious = near | cash | F.col("rapid") | own
    return t.withColumns({"basic_risk": risk, "basic_suspicious": suspicious, "basic_alert": suspicious & (risk >= 0.7), "basic_confidence": F.lit(0.92)})


def smurfing(t: DataFrame) -> DataFrame:
    """The sender's last 24 hours with this row."""
    w = Window.partitionBy("sender_id").orderBy(F.unix_micros("ts")).rangeBetween(-DAY_US, 0)
    n, total = F.count("*").over(w), F.sum("amount").over(w)
    return t.withColumn("smurfing", (n >= 5) & (total < 10_000 * n) & (total > 30_000))


def fan_out(t: DataFrame, least: int = 10, minutes: int = 60) -> DataFrame:
    """Distinct receivers of one sender in less than an hour."""
    w = Window.partitionBy("sender_id").orderBy(F.unix_micros("ts")).rangeBetween(-(minutes * 60_000_000 - 1), 0)
    return t.withColumn("n_receivers", F.size(F.collect_set("receiver_id").over(w))).withColumn("fan_out", F.col("n_receivers") >= least)


def extended_rules(t: DataFrame) -> DataFrame:
    """Declared rules that the data allow; the parameters are ours.

    R016 three rising amounts below 10,000; R018 three rows to one receiver below 10,000 within 7 days;
    R031 more than 10 days of silence; R033 more than 5 times the rate of the history within a day; R041 another row within the hour; R042 the hour of the two rows before."""
    rows = Window.partitionBy("sender_id").orderBy("ts", "transaction_id")
    pair = Window.partitionBy("sender_id", "receiver_id").orderBy(F.unix_micros("ts")).rangeBetween(-7 * DAY_US, 0)
    a, p1, p2 = F.col("amount"), F.lag("amount", 1).over(rows), F.lag("amount", 2).over(rows)
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(rows))
    return t.withColumns({
        "R016": F.coalesce((p2 < p1) & (p1 < a) & (a < 10_000), F.lit(False)), "R018": (F.count("*").over(pair) >= 3) & (F.max("amount").over(pair) < 10_000), "R031": F.coalesce(gap > 10 * DAY_US, F.lit(False)),
        "R033": F.count("*").over(within(DAY_US)) * 30 > 5 * F.count("*").over(within(30 * DAY_US)), "R041": F.coalesce(gap <= 3_600_000_000, F.lit(False)),
        "R042": F.coalesce((F.hour("ts") == F.hour(F.lag("ts", 1).over(rows))) & (F.hour("ts") == F.hour(F.lag("ts", 2).over(rows))), F.lit(False)),
    })


def equal_spacing(t: DataFrame, slack_s: int = 300) -> DataFrame:
    """R015: the last two gaps of a sender both lie within the slack of an hour, or both of a day; the slack is ours."""
    rows = Window.partitionBy("sender_id").orderBy("ts", "transaction_id")
    us = [F.unix_micros(F.lag("ts", k).over(rows)) for k in (0, 1, 2)]

    def near(k, span):
        return F.abs(us[k] - us[k + 1] - span) <= slack_s * 1_000_000

    return t.withColumn("R015", F.coalesce((near(0, DAY_US // 24) & near(1, DAY_US // 24)) | (near(0, DAY_US) & near(1, DAY_US)), F.lit(False)))


def many_per_day(t: DataFrame, receivers: int = 5, withdrawals: int = 20) -> DataFrame:
    """R017 and R037 by sender and day."""
    out = t.groupBy("sender_id", F.to_date("ts").alias("date")).agg(F.count_distinct("receiver_id").alias("n_receivers"), F.count_if(F.col("transaction_type") == "cash_withdrawal").alias("n_withdrawals"))
    return out.withColumns({"R017": F.col("n_receivers") >= receivers, "R037": F.col("n_withdrawals") >= withdrawals})


def list_rules(t: DataFrame, lists: DataFrame, key: str = "country_destination") -> DataFrame:
    """Lists: list, key. The lists that hold the key; one join for all lists."""
    named = lists.groupBy("key").agg(F.array_sort(F.collect_set("list")).alias("lists"))
    return t.join(named.withColumnRenamed("key", key), key, "left")


def consolidate(results: DataFrame) -> DataFrame:
    """Results: transaction_id, detector, suspicious, confidence, risk_score, findings, patterns."""
    w = F.col("risk_score") * F.col("confidence")
    triggered = F.col("suspicious") | (F.col("risk_score") >= 0.5)
    def union(c):
        return F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(triggered, F.col(c))))))

    out = results.groupBy("transaction_id").agg(
        (0.7 * F.max(w) + 0.3 * F.avg(w)).alias("score"), F.avg("confidence").alias("confidence"), F.count_if("suspicious").alias("n_suspicious"), F.count("*").alias("n_detectors"), (F.count_if("suspicious") / F.count("*")).alias("share"), F.array_sort(F.collect_set(F.when(triggered, F.col("detector")))).alias("triggered_by"), union("findings").alias("findings"), union("patterns").alias("patterns"),
    )
    out = out.withColumns({"level": level_of(F.col("score")), "suspicious": (F.col("share") >= 0.3) | (F.col("score") >= 0.75)})
    return out.withColumn("alert", F.col("suspicious") & F.col("level").isin("high", "critical"))


def second_stage(t: DataFrame, results: DataFrame) -> DataFrame:
    """A detector that sees the mean risk of the suspicious detectors before it."""
    seen = results.where("suspicious").groupBy("transaction_id").agg(F.least(F.avg("risk_score"), F.lit(0.95)).alias("seen"))
    out = t.join(seen, "transaction_id", "left")
    large = F.when(F.col("amount") >= 20_000, F.least(F.lit(0.85), amount() / 100_000)).otherwise(0.0)
    cross = F.when(F.col("country_origin") != F.col("country_destination"), 0.55).otherwise(0.0)
    risk = F.greatest(F.lit(0.2), large, cross, F.coalesce("seen", F.lit(0.0)))
    return out.withColumn("stage_risk", risk).withColumn("stage_suspicious", F.col("stage_risk") >= 0.6).withColumn("stage_confidence", F.when(F.col("stage_suspicious"), 0.55).otherwise(0.45))


def description_score(df: DataFrame, text: str, keywords: dict[str, float] = KEYWORDS) -> DataFrame:
    """Weights of the keywords contained; short texts at least 0.55; empty texts have no score."""
    low = F.lower(F.col(text))
    total = sum((F.when(F.contains(low, F.lit(k)), w).otherwise(0.0) for k, w in keywords.items()), F.lit(0.2))
    capped = F.least(total, F.lit(0.9))
    words = F.size(F.filter(F.split(F.trim(low), r"\s+"), lambda w: w != ""))
    score = F.when(F.coalesce(F.length(text), F.lit(0)) > 0, F.when(words <= 3, F.greatest(capped, F.lit(0.55))).otherwise(capped))
    return df.withColumn("description_risk", score).withColumn("description_suspicious", score >= 0.5)


def document_score(df: DataFrame, text: str, high: list[str], medium: list[str], low: list[str], indicators: list[str]) -> DataFrame:
    """Distinct terms by weight, capped at 1, and the first 10 lines with an indicator."""
    body = F.lower(F.coalesce(F.col(text), F.lit("")))
    score = sum((F.when(F.contains(body, F.lit(k)), w).otherwise(0.0) for terms, w in ((high, 0.3), (medium, 0.15), (low, 0.05)) for k in terms), F.lit(0.0))

    def marked(line: Column) -> Column:
        out = F.lit(False)
        for k in indicators:
            out = out | F.contains(line, F.lit(k))
        return out

    return df.withColumns({"document_risk": F.least(score, F.lit(1.0)), "indicator_lines": F.slice(F.filter(F.split(body, "\n"), marked), 1, 10)})


def invoice_score(invoices: DataFrame, prices: DataFrame, routes: list[tuple[str, str]] = ()) -> DataFrame:
    """Invoices: commodity, quantity, total_price, origin, destination; prices: commodity, low, high."""
    out = invoices.join(prices, "commodity", "left")
    unit = F.when(F.col("quantity") > 0, F.col("total_price") / F.col("quantity")).otherwise(0.0)
    out = out.withColumn("unit_price", unit)
    over, under = F.coalesce(F.col("unit_price") > 1.5 * F.col("high"), F.lit(False)), F.coalesce(F.col("unit_price") < 0.5 * F.col("low"), F.lit(False))
    route = F.lit(False)
    for a, b in routes:
        route = route | ((F.col("origin") == a) & (F.col("destination") == b))
    score = F.when(over | under, 0.4).otherwise(0.0) + F.when(route, 0.5).otherwise(0.0) + F.when(F.col("total_price") > 1_000_000, 0.2).otherwise(0.0)
    action = F.when(F.col("invoice_risk") > 0.7, "INVESTIGATE").when(F.col("invoice_risk") > 0.4, "MONITOR").otherwise("CLEAR")
    return out.withColumns({"over": over, "under": under, "invoice_risk": F.round(score, 6)}).withColumns({"invoice_suspicious": F.col("invoice_risk") > 0.5, "action": action})


def repeated_invoices(invoices: DataFrame, keys: list[str]) -> DataFrame:
    """R25."""
    return invoices.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def crypto_risk(df: DataFrame) -> DataFrame:
    """Taint 0..1 and flags mixer, hop, no_kyc."""
    def flag(c, w):
        return F.when(F.col(c), w).otherwise(0.0)

    risk = F.least(0.4 * F.col("taint") + flag("mixer", 0.3) + flag("hop", 0.2) + flag("no_kyc", 0.1), F.lit(1.0))
    return df.withColumns({"crypto_risk": F.round(risk, 6), "patterns": labels((F.col("taint") > 0.5, "tainted"), (F.col("mixer"), "mixer"), (F.col("hop"), "chain_hopping"), (F.col("no_kyc"), "no_kyc_exchange"))})


def flag_score(df: DataFrame, name: str, weights: dict[str, float]) -> DataFrame:
    """A weighted sum of flags."""
    return df.withColumn(name, F.round(sum((F.when(F.col(c), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0)), 6))


def price_ratio(price: Column, floor: Column) -> Column:
    """The price against the floor; 1 without a floor."""
    return F.when(floor > 0, price / floor).otherwise(1.0)


def case_decision(df: DataFrame, score: str) -> DataFrame:
    """R28."""
    s = F.col(score)
    level = F.round(F.least(s + 0.1 * (2 + (s > 0.5).cast("int")), F.lit(1.0)), 6)
    return df.withColumn("case_level", level).withColumn("decision", F.when(level >= 0.8, "FILE_SAR").when(level >= 0.5, "MONITOR").otherwise("CLEAR"))


def circular_transfers(txns: DataFrame, most_hops: int = 3, hours: int = 48) -> DataFrame:
    """R16, R020: transactions that return money to where it came from, after up to `most_hops` hops, each later than the last, within the hours
    and by an amount within a tenth of the first: transaction_id, hops (of the shortest way out)."""
    found = [r.select(F.col("return_id").alias("transaction_id"), F.lit(k).alias("hops")) for k, r in round_trips(txns, range(1, most_hops + 1), hours).items()]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy("transaction_id").agg(F.min("hops").alias("hops"))


def soon_after_opening(txns: DataFrame, customers: DataFrame, days: int = 30, least: float = 10_000) -> DataFrame:
    """R16, R034: transactions of a high amount by a customer in the first days after registration: transaction_id, days_open."""
    own = customers.select(F.col("customer_id").alias("sender_id"), "registration_date")
    out = txns.where(F.col("amount") > least).join(own, "sender_id").withColumn("days_open", F.datediff("ts", "registration_date"))
    return out.where(F.col("days_open").between(0, days)).select("transaction_id", "days_open")


def complex_web(t: DataFrame, hours: int = 24, intermediaries: int = 5) -> DataFrame:
    """R16, R021: how many transfers in a row led to a transaction, itself included, and whether they passed so many accounts on the way:
    transaction_id, depth (not counted beyond what the rule asks), R021. Each transfer leaves the account that the one before reached, later and within the hours;
    an account may come again. Transfers to oneself lead nowhere and are left out.

    Each round looks up the longest chain into the sender by one window over incoming and outgoing transfers, so no pairs are formed. Accounts are cut
    into buckets of `hours`, incoming transfers standing in their own and in the next, so an account with a third of all rows is many groups."""
    span = hours * 3_600_000_000
    before = Window.partitionBy("party", "bucket").orderBy("us").rangeBetween(-span, -1)
    chains = t.where("sender_id <> receiver_id").select("transaction_id", "sender_id", "receiver_id", F.unix_micros("ts").alias("us"), F.lit(1).alias("depth"))
    for _ in range(intermediaries):
        bucket = F.floor(F.col("us") / span)
        came = chains.select(F.col("receiver_id").alias("party"), F.explode(F.array(bucket, bucket + 1)).alias("bucket"), "us", "depth")
        went = chains.select(F.col("sender_id").alias("party"), bucket.alias("bucket"), "us", F.lit(None).cast("int").alias("depth"), "transaction_id", "sender_id", "receiver_id", F.lit(True).alias("out"))
        seen = came.unionByName(went, allowMissingColumns=True).withColumn("depth", F.coalesce(F.max("depth").over(before) + 1, F.lit(1)))
        chains = cut(seen.where("out").select("transaction_id", "sender_id", "receiver_id", "us", "depth"))
    return chains.select("transaction_id", "depth", (F.col("depth") > intermediaries).alias("R021"))
