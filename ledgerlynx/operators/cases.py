"""Alerts, reports, feedback and explanations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import money
from .ordering import ranges, running
from .validation import labels

#: Alert types in their order of test, by patterns.
ALERT_TYPES = (
    (("sanctioned_sender", "sanctioned_receiver"), "SANCTIONS_VIOLATION"), (("layering",), "LAYERING"), (("smurfing",), "SMURFING"), (("structuring",), "STRUCTURING"), (("large_cash",), "LARGE_CASH_TRANSACTION"),
    (("high_risk_country_origin", "high_risk_country_destination"), "HIGH_RISK_JURISDICTION"), (("behavioral_anomaly",), "BEHAVIORAL_ANOMALY"), (("fan_out",), "SUSPICIOUS_NETWORK_ACTIVITY"),
)
#: Starting thresholds and their steps, floors and caps.
THRESHOLDS = {"structuring": (50.0, 9000.0, float("inf")), "high_value": (500.0, 5000.0, float("inf")), "anomaly": (0.02, 0.5, 0.95)}


def alert_type(patterns: Column) -> Column:
    """C2."""
    out = F.lit("SUSPICIOUS_ACTIVITY")
    for names, kind in reversed(ALERT_TYPES):
        out = F.when(F.arrays_overlap(patterns, F.array(*map(F.lit, names))), kind).otherwise(out)
    return out


def create_alerts(results: DataFrame, txns: DataFrame) -> DataFrame:
    """One alert for each consolidated result that asks for one; its id is a hash of the transaction's."""
    own = txns.select("transaction_id", "sender_id", "receiver_id", "amount", "ts")
    out = results.where("alert").join(own, "transaction_id")
    return out.select(
        F.sha2(F.concat(F.lit("alert:"), F.col("transaction_id").cast("string")), 256).alias("alert_id"), F.col("ts").alias("created_at"), alert_type(F.col("patterns")).alias("alert_type"), F.col("level").alias("risk_level"), F.col("score").alias("priority"),
        F.array("transaction_id").alias("transaction_ids"), F.array_distinct(F.array("sender_id", "receiver_id")).alias("customer_ids"), "triggered_by", "patterns", "findings", F.struct("amount", "score").alias("evidence"),
    )


def explanation(alerts: DataFrame) -> DataFrame:
    """C3."""
    return alerts.withColumn("explanation", F.concat_ws(" ", F.format_string("%s alert at level %s.", "alert_type", "risk_level"), F.array_join(F.transform(F.slice("findings", 1, 5), lambda f: F.concat(F.lit("- "), f)), " ")))


def case_alerts(alerts: DataFrame, unit: str = "month") -> DataFrame:
    """One alert for all of one subject, type and calendar unit. The alert of highest priority, by id among equals, gives the
    level; transactions, customers, patterns, detectors and findings are united. An alert without customers has a null subject."""
    def union(c):
        return F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)

    by = alerts.groupBy(F.get("customer_ids", F.lit(0)).alias("subject"), "alert_type", F.date_trunc(unit, "created_at").alias("began"))
    out = by.agg(
        F.min("created_at").alias("created_at"), F.max_by("risk_level", F.struct("priority", "alert_id")).alias("risk_level"), F.max("priority").alias("priority"), F.count("*").alias("n_alerts"),
        *map(union, ("transaction_ids", "customer_ids", "patterns", "triggered_by", "findings")),
    )
    key = F.concat_ws("|", F.lit("case"), F.col("subject").cast("string"), "alert_type", F.date_format("began", "yyyy-MM-dd"))
    # the subject comes first among the customers, as in a single alert
    ids = F.when(F.col("subject").isNull(), F.col("customer_ids")).otherwise(F.array_union(F.array("subject"), F.col("customer_ids")))
    return out.withColumns({"alert_id": F.sha2(key, 256), "customer_ids": ids}).drop("subject", "began")


def merge_alerts(alerts: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """C4: the alerts of the last hours before `as_of`, and any later ones, by customer and type: the row of highest
    priority with the union of ids, customers, patterns and detectors, and a note if it stands for several."""
    recent = alerts.where((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("created_at")) < hours * 3_600_000_000)

    def union(c):
        return F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)

    by = recent.select("*", F.explode("customer_ids").alias("customer")).groupBy("customer", "alert_type")
    out = by.agg(F.max_by("alert_id", F.struct("priority", "alert_id")).alias("alert_id"), F.max("priority").alias("priority"), F.count("*").alias("n"), *map(union, ("transaction_ids", "customer_ids", "patterns", "triggered_by")))
    return out.withColumn("note", F.when(F.col("n") > 1, F.format_string("[CONSOLIDATED from %d related alerts]", "n")).otherwise(""))


def current_status(log: DataFrame) -> DataFrame:
    """Log: alert_id, status, at."""
    out = log.groupBy("alert_id").agg(F.max_by("status", F.struct("at", "status")).alias("status"), F.max("at").alias("updated_at"))
    return out.withColumn("resolved_at", F.when(F.col("status").rlike("^(resolved|closed)"), F.col("updated_at")))


def attach(alerts: DataFrame, txns: DataFrame) -> DataFrame:
    """Each alert with its transactions; ids that are missing are dropped."""
    return alerts.select("alert_id", F.explode("transaction_ids").alias("transaction_id")).join(txns, "transaction_id")


def report(alerts: DataFrame, txns: DataFrame) -> DataFrame:
    """One report an alert."""
    sums = attach(alerts, txns).groupBy("alert_id").agg(money(F.sum("amount")).alias("total_amount"), F.min("currency").alias("currency"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"))
    return alerts.select("alert_id", F.get("customer_ids", F.lit(0)).alias("subject_id"), "alert_type", "priority", "risk_level").join(sums, "alert_id")


def auto_report(alerts: DataFrame) -> DataFrame:
    """C7."""
    return alerts.where("risk_level = 'critical' AND priority >= 0.90")


#: The states of an alert that a report may be made of.
REPORTABLE = ("resolved_suspicious", "under_investigation")


def reportable(alerts: DataFrame) -> DataFrame:
    """Alerts with whether a report may be made of them by their status, and why not. A null status allows none."""
    may = F.coalesce(F.col("status").isin(*REPORTABLE), F.lit(False))
    return alerts.withColumns({"may_report": may, "refusal": F.when(~may, F.concat(F.lit("cannot report an alert with status "), F.coalesce("status", F.lit("none"))))})


def narrative(alerts: DataFrame, txns: DataFrame, shown: int = 10) -> DataFrame:
    """The first transactions in order, and how many more there are. The others are counted, not gathered."""
    rows = attach(alerts, txns).select("alert_id", "ts", "transaction_id", "amount")
    order = Window.partitionBy("alert_id").orderBy("ts", "transaction_id")
    first = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= shown)
    line = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd"), F.col("transaction_id").cast("string"), F.col("amount").cast("string"))
    lines = first.groupBy("alert_id").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
    out = lines.join(rows.groupBy("alert_id").agg(F.count("*").alias("n")), "alert_id")
    more = F.when(F.col("n") > shown, F.concat(F.lit("\nand "), (F.col("n") - shown).cast("string"), F.lit(" more"))).otherwise("")
    return out.select("alert_id", F.concat(F.array_join(F.transform("lines", lambda r: r["line"]), "\n"), more).alias("narrative"))


def file_reports(reports: DataFrame, filings: DataFrame) -> DataFrame:
    """Reports with those of the filings (report_id, filed_by, filed_at) marked as filed, the first filing of each
    counting. The confirmation is a hash, so a run that is repeated gives the same one."""
    first = filings.groupBy("report_id").agg(F.min(F.struct("filed_at", "filed_by")).alias("first"))
    out = reports.join(first, "report_id", "left")
    code = F.upper(F.substring(F.sha2(F.concat_ws("|", F.lit("filing"), F.col("report_id").cast("string"), "first.filed_by", F.col("first.filed_at").cast("string")), 256), 1, 12))
    marked = {"filed": F.col("first").isNotNull(), "filed_at": F.col("first.filed_at"), "filed_by": F.col("first.filed_by"), "confirmation": F.when(F.col("first").isNotNull(), F.concat(F.lit("CONF-"), code))}
    return out.withColumns(marked).drop("first")


def validate_report(reports: DataFrame) -> DataFrame:
    """C10."""
    errors = labels(*((F.col(c).isNull(), c) for c in ("subject_id", "alert_type", "start", "narrative")))
    warnings = labels((F.length("narrative") < 100, "short_narrative"), (F.col("total_amount") < 5000, "small_amount"))
    return reports.withColumns({"errors": errors, "warnings": warnings})


def _element(name: str, *inside: Column | str) -> Column:
    """An XML element; a string names a column, whose value is escaped and empty if null."""
    def escaped(c):
        out = F.coalesce(F.col(c).cast("string"), F.lit(""))
        for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            out = F.replace(out, F.lit(mark), F.lit(entity))
        return out

    return F.concat(F.lit(f"<{name}>"), *(escaped(c) if isinstance(c, str) else c for c in inside), F.lit(f"</{name.split()[0]}>"))


def filing_xml(reports: DataFrame, institution_id: str, institution: str, filing_date: str) -> DataFrame:
    """C11, first layout: one document a report, from C6 with a narrative."""
    made = reports.withColumns({"_id": F.lit(institution_id), "_name": F.lit(institution), "_date": F.lit(filing_date), "_kind": F.lit("1"), "_country": F.lit("US"), "_none": F.lit("")})
    address = _element("Address", *(_element(n, "_none") for n in ("Street", "City", "State", "ZipCode")), _element("Country", "_country"))
    body = _element(
        "Activity",
        _element("FilingInstitution", _element("InstitutionTIN", "_id"), _element("InstitutionName", "_name")),
        _element("Subject", _element("SubjectType", "_kind"), _element("FirstName", "_none"), _element("LastName", "_none"), _element("TIN", "subject_id"), address),
        _element("SuspiciousActivity", _element("SuspiciousActivityStartDate", "start"), _element("SuspiciousActivityEndDate", "end"), _element("TotalDollarAmount", "total_amount"), _element("ActivityType", "alert_type")),
        _element("Narrative", "narrative"), _element("FilingDate", "_date"),
    )
    return made.select("alert_id", _element('EFilingBatchXML Version="1.2"', body).alias("xml"))


def transaction_xml(alerts: DataFrame, txns: DataFrame, entity_id: str, entity: str, date: str) -> DataFrame:
    """C11, second layout: one document an alert, with its transactions in order."""
    rows = attach(alerts, txns).withColumn("_date", F.date_format("ts", "yyyy-MM-dd"))
    one = _element("transaction", _element("transaction_id", "transaction_id"), _element("amount", "amount"), _element("currency", "currency"), _element("date", "_date"))
    parts = rows.groupBy("alert_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "transaction_id", one.alias("xml")))), lambda r: r["xml"]), "").alias("_rows"))
    made = parts.join(alerts.select("alert_id", "alert_type"), "alert_id").withColumns({"_code": F.lit("STR"), "_date": F.lit(date), "_id": F.lit(entity_id), "_name": F.lit(entity)})
    head = _element("report_header", _element("report_code", "_code"), _element("submission_date", "_date")), _element("reporting_entity", _element("entity_id", "_id"), _element("entity_name", "_name"))
    return made.select("alert_id", _element('goAMLMessage version="5.0"', *head, F.col("_rows"), _element("reason_for_suspicion", "alert_type")).alias("xml"))


def filing_clock(reports: DataFrame, found: str, as_of: str, days: int = 30, least: float = 5000) -> DataFrame:
    """C12."""
    due = F.date_add(F.to_date(found), days)
    return reports.withColumns({"must_file": F.col("total_amount") >= least, "due": due, "days_left": F.datediff(due, F.lit(as_of).cast("date"))})


def feedback_class(predicted: Column, decision: Column) -> Column:
    """B1."""
    return (
        F.when(decision == "TRUE_POSITIVE", F.when(predicted, "TP").otherwise("FN")).when(decision == "FALSE_POSITIVE", F.when(predicted, "FP").otherwise("TN")).when(decision == "TRUE_NEGATIVE", F.when(predicted, "FP").otherwise("TN")).otherwise("UNKNOWN")
    )


def _of_class(*names: str) -> dict[str, Column]:
    return {k.lower(): (F.col("class") == k).cast("long") for k in names}


def rolling_metrics(feedback: DataFrame, order: str, rows: int = 100, first: int = 10) -> DataFrame:
    """B2: feedback: a numeric key that gives the order, class. Counts of the last rows are differences of running sums.
    F1 stays what it was while precision and recall are both 0."""
    kinds = ("tp", "fp", "tn", "fn")
    sums = running(feedback, order, {"place": F.lit(1), **_of_class("TP", "FP", "TN", "FN")})
    old = sums.select((F.col("place") + rows).alias("place"), *(F.col(k).alias(f"old_{k}") for k in kinds))
    out = sums.join(old, "place", "left").withColumns({k: F.col(k) - F.coalesce(f"old_{k}", F.lit(0)) for k in kinds}).drop(*(f"old_{k}" for k in kinds))

    def over(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    tp, fp, tn, fn = map(F.col, kinds)
    out = out.where(F.col("place") >= first).withColumns({"accuracy": over(tp + tn, tp + fp + tn + fn), "precision": over(tp, tp + fp), "recall": over(tp, tp + fn), "fpr": over(fp, fp + tn)})
    p, r = F.col("precision"), F.col("recall")
    out = ranges(out.withColumn("_f1", F.when(p + r > 0, 2 * p * r / (p + r))), order)
    # the last value before a range is the last one of the ranges before it: one row a range
    ends = out.groupBy("range").agg(F.max_by("_f1", F.when(F.col("_f1").isNotNull(), F.col(order))).alias("end"))
    ends = ends.select("range", F.last("end", ignorenulls=True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    own = Window.partitionBy("range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return out.join(F.broadcast(ends), "range").withColumn("f1", F.coalesce(F.last("_f1", ignorenulls=True).over(own), "_before", F.lit(0.0))).drop("_f1", "_before", "range")


def threshold_steps() -> dict[str, Column]:
    """How many steps up (FP) or down (FN) a row of feedback, by its columns class and patterns, takes each threshold."""
    pattern = {
        "structuring": F.size(F.filter("patterns", lambda p: p.contains("structuring"))),
        "high_value": F.size(F.filter("patterns", lambda p: p.contains("high_value") & ~p.contains("structuring"))),
    }
    sign = F.when(F.col("class") == "FP", 1).when(F.col("class") == "FN", -1).otherwise(0)
    # without patterns nothing is counted
    return {n: sign * F.greatest(F.coalesce(pattern.get(n, F.lit(1)), F.lit(0)), F.lit(0)) for n in THRESHOLDS}


def threshold_fold(feedback: DataFrame, order: str, start: dict[str, float], rows: int | None = None) -> DataFrame:
    """Feedback: a numeric key that gives the order, class, patterns. Each row with the thresholds after it.

    A step adds to a threshold and keeps it between a floor and a cap. Steps one after the other are again one step with
    another floor and cap, so each range of rows is first folded into one step, the few steps of the ranges are
    folded on the driver, and then each range is walked from its own start."""
    import pandas as pd

    names = list(THRESHOLDS)
    steps = feedback.withColumns(threshold_steps())
    steps = ranges(steps.select(order, *names), order, rows=rows)

    def folded(own: pd.DataFrame) -> pd.DataFrame:
        own, out = own.sort_values(order), {"range": [int(own["range"].iloc[0])]}
        for n in names:
            size, floor, cap = THRESHOLDS[n]
            add, low, high = 0.0, -float("inf"), float("inf")
            for times in own[n]:
                for _ in range(abs(int(times))):  # only the bound in the direction of the step is looked at
                    add, low, high = (add + size, min(low + size, cap), min(high + size, cap)) if times > 0 else (add - size, max(low - size, floor), max(high - size, floor))
            out |= {f"{n}_add": [add], f"{n}_low": [low], f"{n}_high": [high]}
        return pd.DataFrame(out)

    whole = ", ".join(f"{n}_{c} double" for n in names for c in ("add", "low", "high"))
    found = sorted(steps.groupBy("range").applyInPandas(folded, f"range int, {whole}").collect(), key=lambda r: r["range"])
    begins, at = {}, dict(start)
    for r in found:
        begins[r["range"]] = dict(at)
        at = {n: min(r[f"{n}_high"], max(r[f"{n}_low"], at[n] + r[f"{n}_add"])) for n in names}
    kind = dict(feedback.dtypes)[order]

    def walked(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(order)
        at, out = dict(begins[int(own["range"].iloc[0])]), {n: [] for n in names}
        for row in own[names].itertuples(index=False):
            for n, times in zip(names, row, strict=True):
                size, floor, cap = THRESHOLDS[n]
                for _ in range(abs(int(times))):
                    at[n] = min(at[n] + size, cap) if times > 0 else max(at[n] - size, floor)
                out[n].append(at[n])
        return pd.DataFrame({order: own[order].to_numpy(), **out})

    return steps.groupBy("range").applyInPandas(walked, f"`{order}` {kind}, " + ", ".join(f"{n} double" for n in names))


def trend(feedback: DataFrame, order: str, rows: int = 50) -> DataFrame:
    """The share of false positives among the first and the last rows, its improvement and what that is called."""
    fp = F.avg((F.col("class") == "FP").cast("double"))
    first, last = (feedback.orderBy(o).limit(rows).agg(fp.alias(f"{n}_rate")) for n, o in (("first", F.asc(order)), ("last", F.desc(order))))
    out = feedback.agg(F.count("*").alias("n")).crossJoin(first).crossJoin(last)  # one row each
    enough = F.col("n") >= rows
    gain = F.when(F.col("first_rate") > 0, (F.col("first_rate") - F.col("last_rate")) / F.col("first_rate")).otherwise(0.0)
    out = out.select("n", *(F.when(enough, F.col(c)).alias(c) for c in ("first_rate", "last_rate")), F.when(enough, gain).alias("improvement"))
    return out.withColumn("trend", F.when(~enough, "insufficient_data").when(F.col("improvement") > 0, "improving").when(F.col("improvement") == 0, "stable").otherwise("declining"))


def adaptive_threshold(feedback: DataFrame, order: str, start: float = 0.5) -> DataFrame:
    """A running product of factors that depend on running counts alone. The product is held as counts of its two factors and by its logarithm
    (`log_threshold`), which no number of rows takes out of range; `threshold` may leave it."""
    out = running(feedback, order, _of_class("TP", "FP", "FN"))
    enough = F.col("tp") + F.col("fp") + F.col("fn") >= 10
    up = enough & (2 * F.col("tp") < F.col("tp") + F.col("fp"))
    down = enough & ~up & (2 * F.col("tp") < F.col("tp") + F.col("fn"))
    out = running(out, order, {"_ups": up.cast("long"), "_downs": down.cast("long")})
    out = out.withColumn("log_threshold", F.lit(math.log(start)) + F.col("_ups") * F.lit(math.log(1.1)) + F.col("_downs") * F.lit(math.log(0.9)))
    return out.withColumn("threshold", F.exp("log_threshold")).drop("_ups", "_downs")


def threshold_statistics(history: DataFrame, feedback: DataFrame, order: str = "ts", window: int = 1000) -> DataFrame:
    """History: name, value, triggered and what orders them, by which the last `window` values of each threshold count; feedback: name, class.
    Thresholds without history have no row."""
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc(order)))
    seen = history.withColumn("place", place).where(F.col("place") <= window).groupBy("name").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.avg(F.col("triggered").cast("double")).alias("trigger_rate"))
    counts = feedback.groupBy("name").agg(*(F.count_if(F.col("class") == k).alias(k.lower()) for k in ("TP", "FP", "TN", "FN")))
    out = seen.join(counts, "name", "left").fillna(0, ["tp", "fp", "tn", "fn"])
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    out = out.withColumns({"precision": F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0), "recall": F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0), "total": tp + fp + tn + fn})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)).drop("tp", "fp", "tn", "fn")


def importance(findings: DataFrame) -> DataFrame:
    """Findings: transaction_id, finding, risk. Risk by the first keyword, scaled by the largest."""
    low = F.lower("finding")
    group = F.when(low.contains("amount"), "transaction_amount").when(low.contains("country"), "country_risk").when(low.contains("frequency"), "transaction_frequency").when(low.contains("time"), "transaction_time")
    sums = findings.withColumn("feature", group).where("feature is not null").groupBy("transaction_id", "feature").agg(F.sum("risk").alias("weight"))
    return sums.withColumn("share", F.col("weight") / F.max("weight").over(Window.partitionBy("transaction_id")))


#: Destinations that the counterfactual and the sanctions rule look at.
COUNTERFACTUAL_COUNTRIES = ("IR", "KP", "SY")
SANCTIONED_COUNTRIES = ("IR", "KP", "SY", "CU")


def counterfactuals(txns: DataFrame, countries: tuple[str, ...] = COUNTERFACTUAL_COUNTRIES) -> DataFrame:
    """What would have to differ, and whether there would still be an alert."""
    def case(test, kind, before, after, alert):
        return F.when(test, F.struct(F.lit(kind).alias("scenario"), before.alias("original"), after.alias("modified"), alert.alias("would_alert")))

    a, hour, always = F.col("amount").cast("double"), F.hour("ts"), F.lit(True)

    def cut(share, kind, limit):
        return case(always, kind, F.format_string("%.2f", a), F.format_string("%.2f", a * share), F.when(a * share > limit, "yes").otherwise("no"))

    cases = F.array_compact(F.array(
        cut(0.9, "amount_less_10_percent", 9_000), cut(0.5, "amount_less_50_percent", 10_000),
        case(F.col("country_destination").isin(*countries), "low_risk_destination", F.col("country_destination"), F.lit("US"), F.lit("no")),
        case((hour < 6) | (hour > 22), "business_hours", F.format_string("%d:00", hour), F.lit("14:00"), F.lit("possibly")),
    ))
    return txns.select("transaction_id", F.inline(cases))


def regulations(txns: DataFrame, results: DataFrame) -> DataFrame:
    """The regulations that apply to each transaction; results: transaction_id, patterns."""
    marked = results.where(F.array_contains("patterns", "structuring")).select("transaction_id").distinct().withColumn("structured", F.lit(True))
    a = F.col("amount")

    def rule(test, name, reference):
        return F.when(test, F.struct(F.lit(name).alias("regulation"), F.lit(reference).alias("reference")))

    found = F.array_compact(F.array(
        rule(a > 10_000, "FATF Recommendation 10", "https://www.fatf-gafi.org/recommendations.html"),
        rule((a > 10_000) & F.col("transaction_type").isin("cash_deposit", "cash_withdrawal"), "FinCEN CTR", "31 CFR 1010.310"),
        rule(F.col("structured"), "BSA/AML Anti-Structuring", "31 USC 5324"),
        rule(F.col("country_destination").isin(*SANCTIONED_COUNTRIES), "OFAC Sanctions", "https://home.treasury.gov/policy-issues/office-of-foreign-assets-control-sanctions-programs-and-information"),
    ))
    return txns.join(marked, "transaction_id", "left").select("transaction_id", F.inline(found))


def decision_path(results: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """One row a transaction: the steps in the order of the detectors, the mean confidence, and what it says."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("detector"))
    step = F.struct(place.alias("place"), "detector", "suspicious", "risk_score", "confidence", "findings", "patterns")
    out = results.groupBy("transaction_id").agg(F.array_sort(F.collect_list(step)).alias("path"), F.avg("confidence").alias("overall_confidence"))
    c = F.col("overall_confidence")
    return out.withColumn("factor", F.when(c > 0.9, "High agreement between agents").when(c < 0.5, "Low agreement between agents"))


def audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """Entries with a content hash; `verify` hashes again."""
    return df.withColumn("content_hash", F.sha2(F.to_json(F.struct(*sorted(columns))), 256))


def verify(entries: DataFrame, columns: list[str]) -> DataFrame:
    return entries.withColumn("intact", F.col("content_hash") == F.sha2(F.to_json(F.struct(*sorted(columns))), 256))


def audit_history(entries: DataFrame, entity: str, entities: DataFrame, order: str) -> DataFrame:
    """The entries of some entities (one column, named as in the log), numbered in their order: `place`, from 1."""
    own = entries.join(entities.select(entity).distinct(), entity, "left_semi")
    return own.withColumn("place", F.row_number().over(Window.partitionBy(entity).orderBy(order)))
