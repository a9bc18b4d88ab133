"""R1-R28, J8 over the driver's tables."""

from pyspark.sql import functions as F

from ..operators import rules as R
from .bindings import customers, query, table, txn
from .f_history import ALL, A, days, span

C = "('IR','KP','SY','AF','IQ','LY','SO','SD','YE','MM')"
NEAR = "(amount >= 9000 AND amount < 10000)"
CROSS = "country_origin <> country_destination"

_ROW = f"""amount > 10000 AND amount <= 50000 AS R001, amount > 50000 AND amount <= 100000 AS R002, amount > 100000 AS R003, amount BETWEEN 9000 AND 10000 AS R004, transaction_type = 'cash_deposit' AND amount > 5000 AS R005,
  transaction_type = 'wire_transfer' AND amount > 3000 AS R006, {CROSS} AND amount > 1000 AS R007"""
_PAST = f"""count(*) OVER h > 0 AND coalesce(sum(amount) OVER w0, 0) + amount > 10000 AS R008, count(*) OVER h > 0 AND coalesce(sum(amount) OVER w7, 0) + amount > 25000 AS R009,
  count(*) OVER h > 0 AND coalesce(sum(amount) OVER w30, 0) + amount > 50000 AS R010, {NEAR} AND count(*) FILTER ({NEAR}) OVER w7 >= 2 AS R011, count(*) OVER w0 >= 2 AND coalesce(max(amount) OVER w0 < 10000, false) AS R012,
  amount % 1000 = 0 AND count(*) FILTER (amount % 1000 = 0) OVER w7 >= 2 AS R013, count(*) OVER s2 >= 3 AS R019, coalesce(avg({A}) OVER h > 0 AND {A} > 10 * avg({A}) OVER h, false) AS R032"""
_WINDOWS = f"WINDOW h AS ({ALL}), w0 AS ({days(0)}), w7 AS ({days(7)}), w30 AS ({days(30)}), s2 AS ({span(172_800_000_000)})"
_PLACE = f"(country_origin IN {C} OR country_destination IN {C}) AS R025, (hour(ts) >= 23 OR hour(ts) < 5) AND amount > 10000 AS R039, isodow(ts) > 5 AS R040"
ROW_RULES, PAST_RULES, PLACE_RULES = [f"R00{k}" for k in range(1, 8)], ["R008", "R009", "R010", "R011", "R012", "R013", "R019", "R032"], ["R025", "R039", "R040"]


@query("r2_r3_row_rules", "txn", f"SELECT transaction_id, {_ROW} FROM txn")
def r2(spark, sf):
    return R.amount_rules(txn(spark, sf)).select("transaction_id", *(F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ROW_RULES))


@query("r4_r10_history_rules", "txn", f"SELECT transaction_id, {_PAST} FROM txn {_WINDOWS}")
def r4(spark, sf):
    return R.history_rules(txn(spark, sf)).select("transaction_id", *(F.coalesce(F.col(c), F.lit(False)).alias(c) for c in PAST_RULES))


@query("r9_r11_place_and_time", "txn", f"SELECT transaction_id, {_PLACE} FROM txn")
def r9(spark, sf):
    return R.place_and_time_rules(txn(spark, sf)).select("transaction_id", *PLACE_RULES)


@query("r12_party_rules", "txn customers", "SELECT transaction_id, is_pep AS R043, is_sanctioned AS R044 FROM txn JOIN customers ON customer_id = sender_id")
def r12(spark, sf):
    return R.party_rules(txn(spark, sf), customers(spark, sf)).select("transaction_id", "R043", "R044")


_ALL = f"""
f AS (SELECT transaction_id, {_ROW}, {_PAST}, {_PLACE}, is_pep AS R043, is_sanctioned AS R044 FROM txn JOIN customers ON customer_id = sender_id {_WINDOWS}),
l AS (SELECT transaction_id, list_filter([{', '.join(f"CASE WHEN {r} THEN '{r}' END" for r, _, _ in R.CATALOGUE)}], lambda x: x IS NOT NULL) AS fired FROM f),
c AS (SELECT * FROM (VALUES {', '.join(f"('{r}', {R.SEVERITY[s]}::DOUBLE, '{s}', '{c}')" for r, s, c in R.CATALOGUE)}) v(rule, weight, severity, category)),
e AS (SELECT transaction_id, unnest(fired) AS rule FROM l)
"""  # fmt: skip


_RULES = ", ".join(f"('{r}', '{n}', '{s}', '{c}', {a or 'NULL'}::DOUBLE, {b or 'NULL'}::DOUBLE, '{g}', {str(r in R.EVALUATED).lower()})" for r, n, s, c, a, b, g in R.RULES)


@query("r1_catalogue", "txn customers", _ALL + f", v AS (SELECT * FROM (VALUES {_RULES}) v(rule, name, severity, category, threshold, threshold_to, regulation, evaluated)) SELECT v.*, coalesce(k.n, 0) AS n FROM v LEFT JOIN (SELECT rule, count(*) AS n FROM e GROUP BY 1) k USING (rule)")
def r1(spark, sf):
    fired = R.evaluate(R.all_rules(txn(spark, sf), customers(spark, sf))).select(F.explode("fired").alias("rule"))
    return R.catalogue(spark).join(fired.groupBy("rule").agg(F.count("*").alias("n")), "rule", "left").fillna(0, ["n"])


@query("r13_rule_evaluation", "txn customers", _ALL + """
SELECT l.transaction_id, array_to_string(l.fired, ',') AS fired, len(l.fired)::INT AS n_fired, round(coalesce(s.score, 0), 6) AS rule_score FROM l LEFT JOIN (SELECT transaction_id, avg(weight) AS score FROM e JOIN c USING (rule) GROUP BY 1) s USING (transaction_id)""")  # fmt: skip
def r13(spark, sf):
    return R.evaluate(R.all_rules(txn(spark, sf), customers(spark, sf))).select("transaction_id", F.array_join("fired", ",").alias("fired"), "n_fired", F.round("rule_score", 6).alias("rule_score"))


@query("r14_rule_verdict", "txn customers", _ALL + """
SELECT l.transaction_id, s.w IS NOT NULL AS suspicious, coalesce(s.score > 0.6 OR s.w >= 0.8, false) AS alert, CASE s.w WHEN 1.0 THEN 'critical' WHEN 0.8 THEN 'high' WHEN 0.5 THEN 'medium' WHEN 0.2 THEN 'low' END AS highest, coalesce(s.cats, '') AS categories
FROM l LEFT JOIN (SELECT transaction_id, avg(weight) AS score, max(weight) AS w, array_to_string(list_sort(list(DISTINCT category)), ',') AS cats FROM e JOIN c USING (rule) GROUP BY 1) s USING (transaction_id)""")  # fmt: skip
def r14(spark, sf):
    out = R.evaluate(R.all_rules(txn(spark, sf), customers(spark, sf)))
    return out.select("transaction_id", F.col("rule_suspicious").alias("suspicious"), F.col("rule_alert").alias("alert"), "highest", F.array_join("categories", ",").alias("categories"))


_BASIC = f"""
roles AS (SELECT transaction_id, ts, sender_id AS party, true AS own FROM txn UNION ALL SELECT transaction_id, ts, receiver_id, false FROM txn WHERE receiver_id <> sender_id),
rap AS (SELECT transaction_id, own, count(*) OVER (PARTITION BY party ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND 1 PRECEDING) >= 5 AS rapid FROM roles),
b AS (SELECT t.*, rapid, amount >= 9405 AND amount < 9900 AS near, transaction_type IN ('cash_deposit','cash_withdrawal') AND amount >= 5000 AS cash, sender_id = receiver_id AS own FROM txn t JOIN rap r ON r.transaction_id = t.transaction_id AND r.own),
d AS (SELECT transaction_id, greatest(CASE WHEN amount >= 10000 THEN 0.6 ELSE 0 END, CASE WHEN near THEN 0.75 ELSE 0 END, CASE WHEN amount % 1000 = 0 AND amount >= 5000 THEN 0.4 ELSE 0 END, CASE WHEN {CROSS} AND amount >= 5000 THEN 0.5 ELSE 0 END,
  CASE WHEN cash THEN 0.7 ELSE 0 END, CASE WHEN transaction_type = 'crypto' THEN 0.5 ELSE 0 END, CASE WHEN hour(ts) < 6 OR hour(ts) > 22 THEN 0.3 ELSE 0 END, CASE WHEN rapid THEN 0.65 ELSE 0 END, CASE WHEN own THEN 0.8 ELSE 0 END)::DOUBLE AS risk,
  near OR cash OR rapid OR own AS suspicious FROM b)
"""


@query("r15_basic_detector", "txn", _BASIC + "SELECT transaction_id, risk, suspicious, suspicious AND risk >= 0.7 AS alert FROM d")
def r15(spark, sf):
    return R.basic_detector(R.rapid(txn(spark, sf))).select("transaction_id", F.col("basic_risk").alias("risk"), F.col("basic_suspicious").alias("suspicious"), F.col("basic_alert").alias("alert"))


_S = "PARTITION BY sender_id ORDER BY ts, transaction_id"


@query("r16_extended_rules", "txn", f"""
SELECT transaction_id, coalesce(lag(amount, 2) OVER o < lag(amount) OVER o AND lag(amount) OVER o < amount AND amount < 10000, false) AS R016, count(*) OVER p >= 3 AND max(amount) OVER p < 10000 AS R018,
  coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER o) > 864000000000, false) AS R031, count(*) OVER d1 * 30 > 5 * count(*) OVER d30 AS R033, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER o) <= 3600000000, false) AS R041,
  coalesce(hour(ts) = hour(lag(ts) OVER o) AND hour(ts) = hour(lag(ts, 2) OVER o), false) AS R042
FROM txn WINDOW o AS ({_S}), p AS (PARTITION BY sender_id, receiver_id ORDER BY epoch_us(ts) RANGE BETWEEN 604800000000 PRECEDING AND CURRENT ROW), d1 AS ({span(86_400_000_000)}), d30 AS ({span(2_592_000_000_000)})""")  # fmt: skip
def r16(spark, sf):
    return R.extended_rules(txn(spark, sf)).select("transaction_id", "R016", "R018", "R031", "R033", "R041", "R042")


@query("r16_equal_spacing", "txn", f"""
g AS (SELECT transaction_id, epoch_us(ts) - epoch_us(lag(ts) OVER o) AS x, epoch_us(lag(ts) OVER o) - epoch_us(lag(ts, 2) OVER o) AS y FROM txn WINDOW o AS ({_S}))
SELECT transaction_id, coalesce((x BETWEEN 3300000000 AND 3900000000 AND y BETWEEN 3300000000 AND 3900000000) OR (x BETWEEN 86100000000 AND 86700000000 AND y BETWEEN 86100000000 AND 86700000000), false) AS R015 FROM g""")  # fmt: skip
def r16c(spark, sf):
    return R.equal_spacing(txn(spark, sf)).select("transaction_id", "R015")


@query("r16_many_per_day", "txn", "SELECT sender_id, strftime(ts, '%Y-%m-%d') AS date, count(DISTINCT receiver_id) AS n_receivers, count(DISTINCT receiver_id) >= 5 AS R017 FROM txn GROUP BY 1, 2")
def r16b(spark, sf):
    return R.many_per_day(txn(spark, sf)).select("sender_id", F.col("date").cast("string").alias("date"), "n_receivers", "R017")


LISTS = [("haven", "PA"), ("haven", "KY"), ("haven", "CH"), ("sanctioned", "IR"), ("sanctioned", "KP"), ("conflict", "SY"), ("conflict", "AF")]


@query("r17_list_rules", "txn", f"""
l AS (SELECT * FROM (VALUES {', '.join(map(str, LISTS))}) v(list, key)), n AS (SELECT key, array_to_string(list_sort(list(DISTINCT list)), ',') AS lists FROM l GROUP BY 1)
SELECT transaction_id, lists FROM txn LEFT JOIN n ON key = country_destination""")  # fmt: skip
def r17(spark, sf):
    return R.list_rules(txn(spark, sf), spark.createDataFrame(LISTS, "list string, key string")).select("transaction_id", F.array_join("lists", ",").alias("lists"))


@query("r18_smurfing_24h", "txn", "SELECT transaction_id FROM txn WINDOW w AS (PARTITION BY sender_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER w >= 5 AND sum(amount) OVER w < 10000 * count(*) OVER w AND sum(amount) OVER w > 30000")
def r18(spark, sf):
    return R.smurfing(txn(spark, sf)).where("smurfing").select("transaction_id")


@query("r19_fan_out", "txn", """
SELECT transaction_id, len(list_distinct(list(receiver_id) OVER (PARTITION BY sender_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW)))::INT AS n_receivers FROM txn QUALIFY n_receivers >= 2""")  # fmt: skip
def r19(spark, sf):
    return R.fan_out(txn(spark, sf), least=2).where("fan_out").select("transaction_id", "n_receivers")


_RESULTS = _BASIC.rstrip() + f""",
results AS (SELECT transaction_id, 'basic' AS detector, suspicious, 0.92::DOUBLE AS confidence, risk AS risk_score, 'basic_rule' AS finding, 'basic' AS pattern FROM d
  UNION ALL SELECT transaction_id, 'country', country_origin IN {C} OR country_destination IN {C}, 0.98, CASE WHEN country_origin IN {C} OR country_destination IN {C} THEN 0.7 ELSE 0 END, 'high_risk_country', 'high_risk_country_origin' FROM txn
  UNION ALL SELECT transaction_id, 'size', is_suspicious, 0.9, risk_score, 'large_amount', 'large_cash' FROM txn)"""


def results(spark, sf):
    """Results of three detectors, in the long form."""
    from ..operators.validation import country_flags

    t = txn(spark, sf)
    b = country_flags(R.basic_detector(R.rapid(t)))
    def result(name, suspicious, confidence, risk, finding, pattern):
        return F.struct(F.lit(name).alias("detector"), F.col(suspicious).alias("suspicious"), F.lit(confidence).alias("confidence"), F.col(risk).alias("risk_score"), F.array(F.lit(finding)).alias("findings"), F.array(F.lit(pattern)).alias("patterns"))

    rows = F.array(
        result("basic", "basic_suspicious", 0.92, "basic_risk", "basic_rule", "basic"),
        result("country", "country_suspicious", 0.98, "country_risk", "high_risk_country", "high_risk_country_origin"),
        result("size", "is_suspicious", 0.9, "risk_score", "large_amount", "large_cash"),
    )
    return b.select("transaction_id", F.inline(rows))


_CONSOLIDATED = _RESULTS + """,
cons AS (SELECT transaction_id, 0.7::DOUBLE * max(risk_score * confidence) + 0.3::DOUBLE * avg(risk_score * confidence) AS score, avg(confidence) AS confidence, count(*) FILTER (suspicious) AS n_suspicious, count(*) AS n_detectors, count(*) FILTER (suspicious) / count(*) AS share,
  list_sort(list(detector) FILTER (suspicious OR risk_score >= 0.5)) AS triggered_by, list_sort(list(finding) FILTER (suspicious OR risk_score >= 0.5)) AS findings, list_sort(list(pattern) FILTER (suspicious OR risk_score >= 0.5)) AS patterns FROM results GROUP BY 1),
lev AS (SELECT *, CASE WHEN score >= 0.85 THEN 'critical' WHEN score >= 0.65 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS level, share >= 0.3 OR score >= 0.75 AS suspicious FROM cons)"""


@query("r20_consolidation", "txn", _CONSOLIDATED + """
SELECT transaction_id, round(score, 6) AS score, round(confidence, 6) AS confidence, n_suspicious, n_detectors, level, suspicious, coalesce(array_to_string(triggered_by, ','), '') AS triggered_by, coalesce(array_to_string(findings, ','), '') AS findings, suspicious AND level IN ('high', 'critical') AS alert FROM lev""")  # fmt: skip
def r20(spark, sf):
    out = R.consolidate(results(spark, sf))
    return out.select("transaction_id", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"), "n_suspicious", "n_detectors", "level", "suspicious", F.array_join("triggered_by", ",").alias("triggered_by"), F.array_join("findings", ",").alias("findings"), "alert")


@query("r21_second_stage", "txn", _RESULTS + f""",
seen AS (SELECT transaction_id, least(avg(risk_score), 0.95) AS seen FROM results WHERE suspicious GROUP BY 1),
st AS (SELECT t.transaction_id, greatest(0.2, CASE WHEN amount >= 20000 THEN least(0.85, {A} / 100000) ELSE 0 END, CASE WHEN {CROSS} THEN 0.55 ELSE 0 END, coalesce(seen, 0))::DOUBLE AS risk FROM txn t LEFT JOIN seen USING (transaction_id))
SELECT transaction_id, round(risk, 6) AS risk, risk >= 0.6 AS suspicious, CASE WHEN risk >= 0.6 THEN 0.55 ELSE 0.45 END::DOUBLE AS confidence FROM st""")  # fmt: skip
def r21(spark, sf):
    out = R.second_stage(txn(spark, sf), results(spark, sf))
    return out.select("transaction_id", F.round("stage_risk", 6).alias("risk"), F.col("stage_suspicious").alias("suspicious"), F.col("stage_confidence").alias("confidence"))


@query("r22_description_keywords", "", """
SELECT conv_id, turn, round(CASE WHEN n <= 3 THEN greatest(s, 0.55) ELSE s END, 6) AS risk FROM (
  SELECT conv_id, turn, text, len(list_filter(regexp_split_to_array(trim(lower(text)), '\\s+'), lambda w: w <> '')) AS n,
    least(0.2 + CASE WHEN contains(lower(text), 'the') THEN 0.15 ELSE 0 END + CASE WHEN contains(lower(text), 'and') THEN 0.25 ELSE 0 END, 0.9)::DOUBLE AS s FROM conversations) WHERE length(text) > 0""")  # fmt: skip
def r22(spark, sf):
    out = R.description_score(table(spark, sf, "conversations"), "text", {"the": 0.15, "and": 0.25})
    return out.where("description_risk is not null").select("conv_id", "turn", F.round("description_risk", 6).alias("risk"))


@query("r23_document_risk", "", """
SELECT doc_id, round(least(CASE WHEN contains(t, 'token') THEN 0.3 ELSE 0 END + CASE WHEN contains(t, 'the') THEN 0.15 ELSE 0 END + CASE WHEN contains(t, 'of') THEN 0.05 ELSE 0 END, 1), 6)::DOUBLE AS risk,
  least(len(list_filter(string_split(t, chr(10)), lambda x: contains(x, 'token'))), 10)::INT AS n_lines FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)""")  # fmt: skip
def r23(spark, sf):
    out = R.document_score(table(spark, sf, "documents"), "text", ["token"], ["the"], ["of"], ["token"])
    return out.select("doc_id", F.round("document_risk", 6).alias("risk"), F.size("indicator_lines").alias("n_lines"))


_PRICES = [("ECONOMY", 900.0, 1400.0), ("SMALL", 1000.0, 1300.0), ("LARGE", 900.0, 1200.0), ("STANDARD", 800.0, 1000.0), ("MEDIUM", 950.0, 1500.0), ("PROMO", 2000.0, 2500.0)]


@query("r24_invoices", "", f"""
WITH p AS (SELECT * FROM (VALUES {', '.join(map(str, _PRICES))}) v(commodity, low, high)),
i AS (SELECT l_orderkey, l_linenumber, p_type AS commodity, l_quantity AS q, l_extendedprice AS total, CASE WHEN l_quantity > 0 THEN l_extendedprice / l_quantity ELSE 0 END AS unit FROM lineitem JOIN part ON p_partkey = l_partkey),
s AS (SELECT *, coalesce(unit > 1.5::DOUBLE * high, false) AS over, coalesce(unit < 0.5::DOUBLE * low, false) AS under FROM i LEFT JOIN p USING (commodity))
SELECT over, under, CASE WHEN over OR under THEN 0.4 ELSE 0 END + CASE WHEN total > 1000000 THEN 0.2 ELSE 0 END::DOUBLE AS risk, count(*) AS n, round(sum(unit), 2) AS units FROM s GROUP BY 1, 2, 3""".replace("WITH p AS", "p AS", 1))  # fmt: skip
def r24(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("total_price"))
    invoices = lines.join(table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("commodity")), "p_partkey")
    prices = spark.createDataFrame(_PRICES, "commodity string, low double, high double")
    out = R.invoice_score(invoices, prices)
    return out.groupBy("over", "under", F.col("invoice_risk").alias("risk")).agg(F.count("*").alias("n"), F.round(F.sum("unit_price"), 2).alias("units"))


@query("r25_repeated_invoices", "", "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def r25(spark, sf):
    return R.repeated_invoices(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"])


@query("r26_crypto_risk", "txn", """
f AS (SELECT transaction_id, CASE WHEN receiver_id % 10 = 0 THEN 1.0 ELSE 0 END::DOUBLE AS taint, sender_id % 3 = 0 AS mixer, sender_id % 5 = 0 AS hop, receiver_id % 2 = 0 AS no_kyc FROM txn WHERE transaction_type = 'crypto')
SELECT transaction_id, round(least(0.4 * taint + CASE WHEN mixer THEN 0.3 ELSE 0 END + CASE WHEN hop THEN 0.2 ELSE 0 END + CASE WHEN no_kyc THEN 0.1 ELSE 0 END, 1), 6)::DOUBLE AS crypto_risk,
  concat_ws(',', CASE WHEN taint > 0.5 THEN 'tainted' END, CASE WHEN mixer THEN 'mixer' END, CASE WHEN hop THEN 'chain_hopping' END, CASE WHEN no_kyc THEN 'no_kyc_exchange' END) AS patterns FROM f""")  # fmt: skip
def r26(spark, sf):
    t = txn(spark, sf).where("transaction_type = 'crypto'")
    t = t.withColumns({"taint": F.when(F.col("receiver_id") % 10 == 0, 1.0).otherwise(0.0), "mixer": F.col("sender_id") % 3 == 0, "hop": F.col("sender_id") % 5 == 0, "no_kyc": F.col("receiver_id") % 2 == 0})
    return R.crypto_risk(t).select("transaction_id", "crypto_risk", F.array_join("patterns", ",").alias("patterns"))


@query("r27_flag_scores", "txn", """
SELECT transaction_id, round(CASE WHEN sender_id % 3 = 0 THEN 0.5 ELSE 0 END + CASE WHEN sender_id % 5 = 0 THEN 0.3 ELSE 0 END + CASE WHEN receiver_id % 2 = 0 THEN 0.2 ELSE 0 END, 6)::DOUBLE AS defi_risk,
  CASE WHEN receiver_id > 0 THEN amount::DOUBLE / (receiver_id * 100) ELSE 1 END > 10 AS suspicious FROM txn""")  # fmt: skip
def r27(spark, sf):
    t = txn(spark, sf).withColumns({"flash": F.col("sender_id") % 3 == 0, "wash": F.col("sender_id") % 5 == 0, "fresh": F.col("receiver_id") % 2 == 0})
    ratio = R.price_ratio(F.col("amount").cast("double"), F.col("receiver_id") * 100)
    return R.flag_score(t, "defi_risk", {"flash": 0.5, "wash": 0.3, "fresh": 0.2}).select("transaction_id", "defi_risk", (ratio > 10).alias("suspicious"))


@query("r28_case_decision", "txn", """
s AS (SELECT transaction_id, round(least(risk_score + 0.1::DOUBLE * (2 + (risk_score > 0.5)::INT), 1), 6) AS case_level FROM txn)
SELECT transaction_id, case_level, CASE WHEN case_level >= 0.8 THEN 'FILE_SAR' WHEN case_level >= 0.5 THEN 'MONITOR' ELSE 'CLEAR' END AS decision FROM s""")  # fmt: skip
def r28(spark, sf):
    return R.case_decision(txn(spark, sf), "risk_score").select("transaction_id", "case_level", "decision")


@query("r16_circular_transfers", "txn", """
t AS (SELECT * FROM txn WHERE sender_id <> receiver_id),
back AS (SELECT r.transaction_id, 1 AS hops FROM t a JOIN t r ON r.sender_id = a.receiver_id AND r.receiver_id = a.sender_id AND r.ts > a.ts AND r.ts < a.ts + INTERVAL 48 HOURS WHERE abs(r.amount - a.amount) <= 0.1 * a.amount AND a.amount > 0 AND r.amount > 0
  UNION ALL SELECT r.transaction_id, 2 FROM t a JOIN t b ON b.sender_id = a.receiver_id AND b.receiver_id <> a.sender_id AND b.ts > a.ts AND b.ts < a.ts + INTERVAL 48 HOURS
  JOIN t r ON r.sender_id = b.receiver_id AND r.receiver_id = a.sender_id AND r.ts > b.ts AND r.ts < a.ts + INTERVAL 48 HOURS WHERE abs(r.amount - a.amount) <= 0.1 * a.amount AND a.amount > 0 AND r.amount > 0)
SELECT transaction_id, min(hops) AS hops FROM back GROUP BY 1""")  # fmt: skip
def r16_circular(spark, sf):
    return R.circular_transfers(txn(spark, sf), most_hops=2)


@query("r16_soon_after_opening", "txn customers", """
SELECT transaction_id, date_diff('day', registration_date, ts::DATE) AS days_open FROM txn JOIN customers ON customer_id = sender_id WHERE amount > 10000 AND date_diff('day', registration_date, ts::DATE) BETWEEN 0 AND 30""")  # fmt: skip
def r16_opening(spark, sf):
    return R.soon_after_opening(txn(spark, sf), customers(spark, sf))


@query("r16_complex_web", "txn", """
reach AS (SELECT transaction_id, receiver_id, ts, 1 AS depth FROM txn WHERE sender_id <> receiver_id UNION
  SELECT t.transaction_id, t.receiver_id, t.ts, depth + 1 FROM reach JOIN txn t ON t.sender_id = reach.receiver_id AND t.ts > reach.ts AND t.ts <= reach.ts + INTERVAL 6 HOURS WHERE depth < 6 AND t.sender_id <> t.receiver_id)
SELECT transaction_id, max(depth)::INT AS depth, max(depth) > 5 AS R021 FROM reach GROUP BY 1""", recursive=True)  # fmt: skip
def r16_web(spark, sf):
    return R.complex_web(txn(spark, sf), hours=6)
