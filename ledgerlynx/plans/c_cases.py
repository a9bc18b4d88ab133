"""J4-J9, E1-E8, K1, K4, K5, C1-C12, B1-B7, X1-X5 over the driver's tables."""

from pyspark.sql import functions as F

from ..operators import cases as C
from ..operators import rules as R
from ..operators import screening as S
from ..operators import similarity as N
from .bindings import AS_OF, query, table, txn
from .r_rules import _CONSOLIDATED, results

NAMES = "names AS (SELECT DISTINCT p_name AS name FROM part), watch AS (SELECT DISTINCT p_name AS name_norm FROM part WHERE p_size <= 2 AND p_partkey % 3 = 0)"


def names(spark, sf):
    return table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()


def watchlist(spark, sf):
    return table(spark, sf, "part").where("p_size <= 2 AND p_partkey % 3 = 0").select(F.lit("OFAC").alias("source"), F.lower("p_name").alias("name_norm")).distinct()


def alerts(spark, sf):
    t = txn(spark, sf)
    out = R.consolidate(results(spark, sf)).withColumn("alert", F.col("suspicious") & (F.col("score") >= 0.5))
    return C.create_alerts(out, t)


_ALERTS = _CONSOLIDATED + """,
al AS (SELECT sha256('alert:' || t.transaction_id) AS alert_id, t.transaction_id, t.sender_id, t.receiver_id, t.amount, t.ts, l.level, l.score, CASE WHEN list_contains(l.patterns, 'large_cash') THEN 'LARGE_CASH_TRANSACTION' WHEN list_contains(l.patterns, 'high_risk_country_origin') THEN 'HIGH_RISK_JURISDICTION' ELSE 'SUSPICIOUS_ACTIVITY' END AS alert_type,
  l.patterns, l.triggered_by, l.findings FROM lev l JOIN txn t USING (transaction_id) WHERE l.suspicious AND l.score >= 0.5)"""


@query("j4_watchlist_exact", "", NAMES + " SELECT p_partkey, lower(trim(p_name)) AS name_norm FROM part WHERE lower(trim(p_name)) IN (SELECT lower(name_norm) FROM watch)")
def j4(spark, sf):
    return S.listed(table(spark, sf, "part"), "p_name", watchlist(spark, sf)).select("p_partkey", "name_norm")


@query("j5_watchlist_partial", "", NAMES + ", w AS (SELECT DISTINCT lower(name_norm) AS name_norm FROM watch WHERE length(name_norm) > 5) SELECT name, name_norm FROM names, w WHERE length(name) >= 3 AND (contains(lower(name), name_norm) OR contains(name_norm, lower(name)))")
def j5(spark, sf):
    return S.partial_hits(names(spark, sf), watchlist(spark, sf))


@query("j6_clean", "", NAMES + " SELECT p_partkey FROM part WHERE lower(trim(p_name)) NOT IN (SELECT lower(name_norm) FROM watch)")
def j6(spark, sf):
    return S.unlisted(table(spark, sf, "part"), "p_name", watchlist(spark, sf)).select("p_partkey")


@query("e1_clean_names", "", "SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9_ ]', '', 'g')) AS cleaned FROM part")
def e1(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.clean(F.concat(F.lit("Dr. "), "p_name")).alias("cleaned"))


_SCORE = """sc AS (SELECT a, b, round(CASE WHEN a = b THEN 100 ELSE greatest(100 * (1 - levenshtein(a, b) / greatest(length(a), length(b))),
  100 * (1 - levenshtein(array_to_string(list_sort(string_split(a, ' ')), ' '), array_to_string(list_sort(string_split(b, ' ')), ' ')) / greatest(length(a), length(b))),
  100 * len(list_intersect(list_distinct(string_split(a, ' ')), list_distinct(string_split(b, ' ')))) / least(len(list_distinct(string_split(a, ' '))), len(list_distinct(string_split(b, ' '))))) END, 4)::DOUBLE AS score FROM pairs)"""


@query("e2_pair_scores", "", NAMES + ", pairs AS (SELECT name AS a, name_norm AS b FROM names, (SELECT DISTINCT lower(name_norm) AS name_norm FROM watch)), " + _SCORE + " SELECT a, b, score FROM sc")
def e2(spark, sf):
    pairs = names(spark, sf).crossJoin(F.broadcast(watchlist(spark, sf).select("name_norm")))  # the distinct names of a fixed vocabulary
    return pairs.select(F.col("name").alias("a"), F.col("name_norm").alias("b"), F.round(S.score(F.col("name"), F.col("name_norm")), 4).alias("score"))


_BLOCK = ", pairs AS (SELECT DISTINCT name AS a, n AS b FROM names, (SELECT DISTINCT lower(name_norm) AS n FROM watch) WHERE list_contains(string_split(name, ' '), string_split(n, ' ')[1]) OR list_contains(string_split(name, ' '), string_split(n, ' ')[-1])), "


@query("e4_candidates", "", NAMES + _BLOCK.rstrip(", ") + " SELECT a AS name, b AS name_norm FROM pairs")
def e4(spark, sf):
    return S.candidates(names(spark, sf), watchlist(spark, sf), whole=False)


@query("e5_batch_screening", "", NAMES + _BLOCK + _SCORE + """, k AS (SELECT a AS name, b AS name_norm, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS place, max(score) OVER (PARTITION BY a) AS best FROM sc WHERE score >= 60)
SELECT name, name_norm, score, place FROM k WHERE place <= 5 AND (best < 100 OR score = 100)""")  # fmt: skip
def e5(spark, sf):
    return S.screen(names(spark, sf), watchlist(spark, sf), least=60, whole=False)


@query("e2_partial_ratio", "", NAMES + _BLOCK + """l AS (SELECT a, b, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS t FROM pairs),
w AS (SELECT a, b, s, unnest(list_transform(generate_series(1, length(t) - length(s) + 1), lambda k: substr(t, k, length(s)))) AS piece FROM l)
SELECT a, b, round(max(100.0 * (1 - levenshtein(s, piece) / length(s))), 4) AS score FROM w GROUP BY 1, 2""")  # fmt: skip
def e2_partial(spark, sf):
    pairs = S.candidates(names(spark, sf), watchlist(spark, sf), whole=False).toDF("a", "b")
    return pairs.withColumn("score", F.round(S.partial_ratio(F.col("a"), F.col("b")), 4))


# the forms above stop at the blocks, as their SQL does; in these a name without candidates meets the whole list
_WHOLE = _BLOCK.replace("pairs AS", "blocked AS").replace("string_split(name, ' ')", "string_split(lower(name), ' ')") + """
pairs AS (SELECT a, b FROM blocked UNION ALL SELECT name, n FROM names, (SELECT DISTINCT lower(name_norm) AS n FROM watch) WHERE name NOT IN (SELECT a FROM blocked)), """


@query("e4_candidates_whole", "", NAMES + _WHOLE.rstrip(", ") + " SELECT a AS name, b AS name_norm FROM pairs")
def e4_whole(spark, sf):
    return S.candidates(names(spark, sf), watchlist(spark, sf))


@query("e5_batch_screening_whole", "", NAMES + _WHOLE + _SCORE.replace("(a,", "(lower(a),").replace("a = b", "lower(a) = b").replace("(a, ' ')", "(lower(a), ' ')") + """, k AS (SELECT a AS name, b AS name_norm, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS place, max(score) OVER (PARTITION BY a) AS best FROM sc WHERE score >= 60)
SELECT name, name_norm, score, place FROM k WHERE place <= 5 AND (best < 100 OR score = 100)""")  # fmt: skip
def e5_whole(spark, sf):
    return S.screen(names(spark, sf), watchlist(spark, sf), least=60)


@query("e7_sounding_alike")
def e7_sounding(spark, sf):
    return S.sounding_alike(names(spark, sf), watchlist(spark, sf))


@query("e6_entities", "", """
n AS (SELECT min(p_partkey) AS id, p_name AS name FROM part GROUP BY 2),
l AS (SELECT x.id AS u, y.id AS v FROM n x JOIN n y ON x.id <> y.id WHERE list_has_any(string_split(x.name, ' '), string_split(y.name, ' ')) AND greatest(100 * (1 - levenshtein(x.name, y.name) / greatest(length(x.name), length(y.name))),
  100 * (1 - levenshtein(array_to_string(list_sort(string_split(x.name, ' ')), ' '), array_to_string(list_sort(string_split(y.name, ' ')), ' ')) / greatest(length(x.name), length(y.name))),
  100 * len(list_intersect(string_split(x.name, ' '), string_split(y.name, ' '))) / least(len(list_distinct(string_split(x.name, ' '))), len(list_distinct(string_split(y.name, ' '))))) >= 90),
reach AS (SELECT id, id AS t FROM n UNION SELECT reach.id, l.v FROM reach JOIN l ON l.u = reach.t)
SELECT *, count(*) OVER (PARTITION BY entity) AS n_names FROM (SELECT n.id, n.name, min(t) AS entity FROM n JOIN reach USING (id) GROUP BY 1, 2)""", recursive=True)  # fmt: skip
def e6(spark, sf):
    return S.entities(table(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id")).select("id", "name"))


@query("e7_jaccard_names", "", NAMES + " SELECT name, n AS name_norm, round(len(list_intersect(string_split(name, ' '), string_split(n, ' '))) / len(list_distinct(list_concat(string_split(name, ' '), string_split(n, ' ')))), 6)::DOUBLE AS jaccard FROM names, (SELECT DISTINCT lower(name_norm) AS n FROM watch)")
def e7(spark, sf):
    pairs = names(spark, sf).crossJoin(F.broadcast(watchlist(spark, sf).select("name_norm")))
    return pairs.select("name", "name_norm", F.round(S.jaccard_words(F.col("name"), F.col("name_norm")), 6).alias("jaccard"))


@query("c1_alerts", "txn", _ALERTS + " SELECT alert_id, alert_type, level AS risk_level, round(score, 6) AS priority, transaction_id FROM al")
def c1(spark, sf):
    return alerts(spark, sf).select("alert_id", "alert_type", "risk_level", F.round("priority", 6).alias("priority"), F.col("transaction_ids")[0].alias("transaction_id"))


@query("c3_explanations", "txn", _ALERTS + " SELECT alert_id, alert_type || ' alert at level ' || level || '. ' || array_to_string(list_transform(list_sort(list_distinct(findings))[1:5], lambda f: '- ' || f), ' ') AS explanation FROM al")
def c3(spark, sf):
    return C.explanation(alerts(spark, sf)).select("alert_id", "explanation")


@query("c4_merged_alerts", "txn", _ALERTS + f""", x AS (SELECT *, unnest(list_distinct([sender_id, receiver_id])) AS customer, [sender_id, receiver_id] AS ends FROM al WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 168 HOURS)
SELECT customer, alert_type, count(*) AS n, round(max(score), 6) AS priority, array_to_string(list_sort(list(DISTINCT transaction_id)), ',') AS ids, array_to_string(list_sort(list_distinct(flatten(list(ends)))), ',') AS customers,
  CASE WHEN count(*) > 1 THEN '[CONSOLIDATED from ' || count(*) || ' related alerts]' ELSE '' END AS note FROM x GROUP BY 1, 2""")  # fmt: skip
def c4(spark, sf):
    out = C.merge_alerts(alerts(spark, sf), AS_OF, hours=168)
    return out.select("customer", "alert_type", "n", F.round("priority", 6).alias("priority"), F.array_join("transaction_ids", ",").alias("ids"), F.array_join("customer_ids", ",").alias("customers"), "note")


@query("c5_current_status", "txn", "SELECT sender_id AS alert_id, arg_max(transaction_type, (ts, transaction_type)) AS status FROM txn GROUP BY 1")
def c5(spark, sf):
    return C.current_status(txn(spark, sf).select(F.col("sender_id").alias("alert_id"), F.col("transaction_type").alias("status"), F.col("ts").alias("at"))).select("alert_id", "status")


@query("c6_reports", "txn", _ALERTS + " SELECT alert_id, sender_id AS subject_id, amount::DOUBLE AS total_amount, 1::BIGINT AS n, strftime(ts, '%Y-%m-%d %H:%M:%S') AS start FROM al")
def c6(spark, sf):
    return C.report(alerts(spark, sf), txn(spark, sf)).select("alert_id", "subject_id", "total_amount", "n", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"))


@query("c8_narratives", "txn", _ALERTS + " SELECT alert_id, strftime(ts, '%Y-%m-%d') || ' ' || transaction_id || ' ' || amount AS narrative FROM al")
def c8(spark, sf):
    return C.narrative(alerts(spark, sf), txn(spark, sf))


@query("c7_auto_reports", "txn", _ALERTS + " SELECT alert_id FROM al WHERE level = 'critical' AND score >= 0.9")
def c7(spark, sf):
    return C.auto_report(alerts(spark, sf)).select("alert_id")


@query("c7_reportable_alerts", "txn", _ALERTS + """, st AS (SELECT alert_id, CASE transaction_id % 4 WHEN 0 THEN 'resolved_suspicious' WHEN 1 THEN 'under_investigation' WHEN 2 THEN 'new' END AS status FROM al)
SELECT alert_id, coalesce(status IN ('resolved_suspicious', 'under_investigation'), false) AS may_report, CASE WHEN status = 'new' OR status IS NULL THEN 'cannot report an alert with status ' || coalesce(status, 'none') END AS refusal FROM st""")  # fmt: skip
def c7_reportable(spark, sf):
    rest = F.col("transaction_ids")[0] % 4
    status = F.when(rest == 0, "resolved_suspicious").when(rest == 1, "under_investigation").when(rest == 2, "new")
    return C.reportable(alerts(spark, sf).withColumn("status", status)).select("alert_id", "may_report", "refusal")


@query("c9_filed_reports", "txn", _ALERTS + f""" SELECT alert_id, transaction_id % 3 = 0 AS filed, CASE WHEN transaction_id % 3 = 0 THEN 'officer' || transaction_id % 2 END AS filed_by,
  CASE WHEN transaction_id % 3 = 0 THEN 'CONF-' || upper(substr(sha256('filing|' || alert_id || '|officer' || transaction_id % 2 || '|{AS_OF}'), 1, 12)) END AS confirmation FROM al""")  # fmt: skip
def c9(spark, sf):
    a = alerts(spark, sf).withColumn("report_id", F.col("alert_id")).withColumn("of", F.col("transaction_ids")[0])
    filings = a.where("of % 3 = 0").select("report_id", F.concat(F.lit("officer"), (F.col("of") % 2).cast("string")).alias("filed_by"), F.lit(AS_OF).cast("timestamp").alias("filed_at"))
    return C.file_reports(a, filings).select("alert_id", "filed", "filed_by", "confirmation")


@query("c10_report_checks", "txn", _ALERTS + " SELECT alert_id, '' AS errors, concat_ws(',', 'short_narrative', CASE WHEN amount < 5000 THEN 'small_amount' END) AS warnings FROM al")
def c10(spark, sf):
    a, t = alerts(spark, sf), txn(spark, sf)
    out = C.validate_report(C.report(a, t).join(C.narrative(a, t), "alert_id"))
    return out.select("alert_id", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"))


@query("c11_filing_xml", "txn", _ALERTS + f""" SELECT alert_id, '<EFilingBatchXML Version="1.2"><Activity><FilingInstitution><InstitutionTIN>12-345</InstitutionTIN><InstitutionName>A &amp; B</InstitutionName></FilingInstitution><Subject><SubjectType>1</SubjectType><FirstName></FirstName><LastName></LastName><TIN>' || sender_id
  || '</TIN><Address><Street></Street><City></City><State></State><ZipCode></ZipCode><Country>US</Country></Address></Subject><SuspiciousActivity><SuspiciousActivityStartDate>' || strftime(ts, '%Y-%m-%d') || '</SuspiciousActivityStartDate><SuspiciousActivityEndDate>' || strftime(ts, '%Y-%m-%d')
  || '</SuspiciousActivityEndDate><TotalDollarAmount>' || amount || '</TotalDollarAmount><ActivityType>' || alert_type || '</ActivityType></SuspiciousActivity><Narrative>' || strftime(ts, '%Y-%m-%d') || ' ' || transaction_id || ' ' || amount || '</Narrative><FilingDate>{AS_OF[:10]}</FilingDate></Activity></EFilingBatchXML>' AS xml FROM al""")  # fmt: skip
def c11(spark, sf):
    a, t = alerts(spark, sf), txn(spark, sf)
    reports = C.report(a, t).join(C.narrative(a, t), "alert_id").withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("start", "end")}).withColumn("total_amount", F.col("total_amount").cast("decimal(18,2)"))
    return C.filing_xml(reports, "12-345", "A & B", AS_OF[:10])


@query("c11_transaction_xml", "txn", _ALERTS + f""" SELECT alert_id, '<goAMLMessage version="5.0"><report_header><report_code>STR</report_code><submission_date>{AS_OF[:10]}</submission_date></report_header><reporting_entity><entity_id>7</entity_id><entity_name>A &amp; B</entity_name></reporting_entity><transaction><transaction_id>'
  || transaction_id || '</transaction_id><amount>' || amount || '</amount><currency>USD</currency><date>' || strftime(ts, '%Y-%m-%d') || '</date></transaction><reason_for_suspicion>' || alert_type || '</reason_for_suspicion></goAMLMessage>' AS xml FROM al""")  # fmt: skip
def c11b(spark, sf):
    return C.transaction_xml(alerts(spark, sf), txn(spark, sf), "7", "A & B", AS_OF[:10])


@query("j7_attached", "txn", _ALERTS + " SELECT alert_id, transaction_id, amount::DOUBLE AS amount FROM al")
def j7(spark, sf):
    return C.attach(alerts(spark, sf), txn(spark, sf)).select("alert_id", "transaction_id", F.col("amount").cast("double").alias("amount"))


@query("c12_filing_clock", "txn", _ALERTS + f" SELECT alert_id, amount >= 5000 AS must_file, date_diff('day', DATE '{AS_OF[:10]}', CAST(ts AS DATE) + 30)::INT AS days_left FROM al")
def c12(spark, sf):
    return C.filing_clock(C.report(alerts(spark, sf), txn(spark, sf)), "start", AS_OF[:10]).select("alert_id", "must_file", "days_left")


@query("k1_pending_alerts", "txn", _ALERTS + " SELECT alert_id, row_number() OVER (ORDER BY CASE level WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END DESC, round(score, 6) DESC, alert_id) AS place FROM al QUALIFY place <= 100")
def k1(spark, sf):
    rank = F.when(F.col("risk_level") == "critical", 3).when(F.col("risk_level") == "high", 2).when(F.col("risk_level") == "medium", 1).otherwise(0)
    top = alerts(spark, sf).select("alert_id", rank.alias("r"), F.round("priority", 6).alias("p")).orderBy(F.desc("r"), F.desc("p"), "alert_id").limit(100)
    from pyspark.sql import Window

    return top.select("alert_id", F.row_number().over(Window.orderBy(F.desc("r"), F.desc("p"), "alert_id")).alias("place"))


@query("k5_list_changes", "", "SELECT p_name AS name, 'added' AS change FROM part WHERE p_size <= 2 EXCEPT SELECT p_name, 'added' FROM part WHERE p_size = 1")
def k5(spark, sf):
    p = table(spark, sf, "part")
    return p.where("p_size <= 2").select(F.col("p_name").alias("name")).subtract(p.where("p_size = 1").select("p_name")).withColumn("change", F.lit("added"))


# predicted: toxic; the decision goes round by id, so that all classes occur
_FEEDBACK = """fb AS (SELECT doc_id, toxic = 1 AS predicted, CASE WHEN quality = 0 THEN 'TRUE_POSITIVE' ELSE list_extract(['FALSE_POSITIVE', 'TRUE_NEGATIVE', 'TRUE_POSITIVE', 'FALSE_NEGATIVE', 'FALSE_POSITIVE'], (doc_id % 5 + 1)::INT) END AS decision FROM labels),
fc AS (SELECT doc_id, CASE decision || predicted WHEN 'TRUE_POSITIVEtrue' THEN 'TP' WHEN 'TRUE_POSITIVEfalse' THEN 'FN' WHEN 'FALSE_POSITIVEtrue' THEN 'FP' WHEN 'FALSE_POSITIVEfalse' THEN 'TN' WHEN 'TRUE_NEGATIVEtrue' THEN 'FP' WHEN 'TRUE_NEGATIVEfalse' THEN 'TN' ELSE 'UNKNOWN' END AS class,
  CASE WHEN doc_id % 3 = 0 THEN ['structuring_near', 'high_value'] WHEN doc_id % 3 = 1 THEN ['high_value'] ELSE ['other'] END AS patterns FROM fb)"""


def feedback(spark, sf, labels=None):
    named = F.element_at(F.array(*map(F.lit, ("FALSE_POSITIVE", "TRUE_NEGATIVE", "TRUE_POSITIVE", "FALSE_NEGATIVE", "FALSE_POSITIVE"))), (F.col("doc_id") % 5 + 1).cast("int"))
    decision = F.when(F.col("quality") == 0, "TRUE_POSITIVE").otherwise(named)
    third = F.col("doc_id") % 3
    patterns = F.when(third == 0, F.array(F.lit("structuring_near"), F.lit("high_value"))).when(third == 1, F.array(F.lit("high_value"))).otherwise(F.array(F.lit("other")))
    return (table(spark, sf, "labels") if labels is None else labels).select("doc_id", C.feedback_class(F.col("toxic") == 1, decision).alias("class"), patterns.alias("patterns"))


@query("b1_feedback_class", "", _FEEDBACK + " SELECT doc_id, class FROM fc")
def b1(spark, sf):
    return feedback(spark, sf).select("doc_id", "class")


@query("b2_rolling_metrics", "", _FEEDBACK + """, w AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place, count(*) FILTER (class = 'TP') OVER l AS tp, count(*) FILTER (class = 'FP') OVER l AS fp, count(*) FILTER (class = 'TN') OVER l AS tn, count(*) FILTER (class = 'FN') OVER l AS fn FROM fc WINDOW l AS (ORDER BY doc_id ROWS 99 PRECEDING)),
m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS p, coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS r, coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0)::DOUBLE AS a, coalesce(fp / nullif(fp + tn, 0), 0)::DOUBLE AS f FROM w WHERE place >= 10)
SELECT doc_id, tp, fp, tn, fn, round(a, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS fpr, round(coalesce(last_value(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) END IGNORE NULLS) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING), 0), 6) AS f1 FROM m""")  # fmt: skip
def b2(spark, sf):
    out = C.rolling_metrics(feedback(spark, sf), "doc_id")
    return out.select("doc_id", "tp", "fp", "tn", "fn", *(F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "fpr", "f1")))


_STEP = "greatest(least({0} + {1} * s * {2}, CASE WHEN s > 0 THEN {4} ELSE 1e18 END), CASE WHEN s < 0 THEN {3} ELSE -1e18 END)"


@query("b3_threshold_fold", "", _FEEDBACK + f""", o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place, CASE class WHEN 'FP' THEN 1 WHEN 'FN' THEN -1 ELSE 0 END AS s, len(list_filter(patterns, lambda p: contains(p, 'structuring'))) AS a, len(list_filter(patterns, lambda p: contains(p, 'high_value') AND NOT contains(p, 'structuring'))) AS b FROM fc),
f AS (SELECT 0::BIGINT AS place, -1::BIGINT AS doc_id, 9500::DOUBLE AS structuring, 10000::DOUBLE AS high_value, 0.7::DOUBLE AS anomaly UNION ALL
  SELECT o.place, o.doc_id, {_STEP.format('f.structuring', 50, 'a', 9000, '1e18')}, {_STEP.format('f.high_value', 500, 'b', 5000, '1e18')}, {_STEP.format('f.anomaly', 0.02, 1, 0.5, 0.95)} FROM f JOIN o ON o.place = f.place + 1)
SELECT doc_id, structuring, high_value, round(anomaly, 6) AS anomaly FROM f WHERE place > 0""", recursive=True)  # fmt: skip
def b3(spark, sf):
    out = C.threshold_fold(feedback(spark, sf), "doc_id", {"structuring": 9500.0, "high_value": 10000.0, "anomaly": 0.7})
    return out.withColumn("anomaly", F.round("anomaly", 6))


@query("b7_threshold_statistics", "txn", """
c AS (SELECT transaction_type AS name, amount::DOUBLE AS value, amount >= 9000 AS triggered, row_number() OVER (PARTITION BY transaction_type ORDER BY transaction_id DESC) AS place, CASE WHEN amount >= 9000 THEN CASE WHEN hour(ts) < 12 THEN 'TP' ELSE 'FP' END ELSE CASE WHEN hour(ts) < 2 THEN 'FN' ELSE 'TN' END END AS class FROM txn),
g AS (SELECT name, count(*) FILTER (place <= 1000) AS n, avg(value) FILTER (place <= 1000) AS mean, stddev_pop(value) FILTER (place <= 1000) AS sd, avg(triggered::INT) FILTER (place <= 1000) AS trigger_rate, count(*) AS total,
  count(*) FILTER (class = 'TP') AS tp, count(*) FILTER (class = 'FP') AS fp, count(*) FILTER (class = 'FN') AS fn FROM c GROUP BY 1)
SELECT name, n, round(mean, 4) AS mean, round(sd, 4) AS sd, round(trigger_rate, 6) AS trigger_rate, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, total, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM g""")  # fmt: skip
def b7(spark, sf):
    t = txn(spark, sf)
    kind = F.when(F.col("amount") >= 9000, F.when(F.hour("ts") < 12, "TP").otherwise("FP")).otherwise(F.when(F.hour("ts") < 2, "FN").otherwise("TN"))
    rows = t.select(F.col("transaction_type").alias("name"), F.col("amount").cast("double").alias("value"), (F.col("amount") >= 9000).alias("triggered"), kind.alias("class"), "transaction_id")
    out = C.threshold_statistics(rows, rows, "transaction_id")
    return out.select("name", "n", *(F.round(c, d).alias(c) for c, d in (("mean", 4), ("sd", 4), ("trigger_rate", 6), ("precision", 6), ("recall", 6), ("f1", 6))), "total")


@query("b4_feedback_distribution", "", _FEEDBACK + " SELECT class, count(*) AS n FROM fc GROUP BY 1")
def b4(spark, sf):
    return feedback(spark, sf).groupBy("class").agg(F.count("*").alias("n"))


@query("b5_trend", "", _FEEDBACK + """, o AS (SELECT class, row_number() OVER (ORDER BY doc_id) AS a, row_number() OVER (ORDER BY doc_id DESC) AS z FROM fc),
r AS (SELECT avg((class = 'FP')::INT) FILTER (a <= 50) AS first_rate, avg((class = 'FP')::INT) FILTER (z <= 50) AS last_rate FROM o), g AS (SELECT *, CASE WHEN first_rate > 0 THEN (first_rate - last_rate) / first_rate ELSE 0 END AS gain FROM r)
SELECT round(first_rate, 6) AS first_rate, round(last_rate, 6) AS last_rate, round(gain, 6) AS improvement, CASE WHEN gain > 0 THEN 'improving' WHEN gain = 0 THEN 'stable' ELSE 'declining' END AS trend FROM g""")  # fmt: skip
def b5(spark, sf):
    return C.trend(feedback(spark, sf), "doc_id").select(*(F.round(c, 6).alias(c) for c in ("first_rate", "last_rate", "improvement")), "trend")


@query("b6_adaptive_threshold", "", _FEEDBACK + """, w AS (SELECT doc_id, count(*) FILTER (class = 'TP') OVER u AS tp, count(*) FILTER (class = 'FP') OVER u AS fp, count(*) FILTER (class = 'FN') OVER u AS fn FROM fc WINDOW u AS (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)),
f AS (SELECT doc_id, CASE WHEN tp + fp + fn >= 10 AND 2 * tp < tp + fp THEN 1.1 WHEN tp + fp + fn >= 10 AND 2 * tp < tp + fn THEN 0.9 ELSE 1 END::DOUBLE AS factor FROM w)
SELECT doc_id, round(ln(0.5::DOUBLE) + count(*) FILTER (factor > 1) OVER u * ln(1.1::DOUBLE) + count(*) FILTER (factor < 1) OVER u * ln(0.9::DOUBLE), 6) AS log_threshold FROM f WINDOW u AS (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)""")  # fmt: skip
def b6(spark, sf):
    return C.adaptive_threshold(feedback(spark, sf), "doc_id").select("doc_id", F.round("log_threshold", 6).alias("log_threshold"))


@query("x1_importance", "txn", _CONSOLIDATED + """, w AS (SELECT transaction_id, CASE finding WHEN 'large_amount' THEN 'transaction_amount' ELSE 'country_risk' END AS feature, sum(risk_score) AS weight FROM results WHERE suspicious AND finding <> 'basic_rule' GROUP BY 1, 2)
SELECT transaction_id, feature, round(weight, 6)::DOUBLE AS weight, round(weight / max(weight) OVER (PARTITION BY transaction_id), 6)::DOUBLE AS share FROM w""")  # fmt: skip
def x1(spark, sf):
    found = results(spark, sf).where("suspicious").select("transaction_id", F.explode("findings").alias("finding"), F.col("risk_score").alias("risk"))
    return C.importance(found).select("transaction_id", "feature", F.round("weight", 6).alias("weight"), F.round("share", 6).alias("share"))


@query("x2_counterfactuals", "txn", """
SELECT transaction_id, 'amount_less_10_percent' AS scenario, printf('%.2f', amount::DOUBLE) AS original, printf('%.2f', amount::DOUBLE * 0.9) AS modified, CASE WHEN amount::DOUBLE * 0.9 > 9000 THEN 'yes' ELSE 'no' END AS would_alert FROM txn
UNION ALL SELECT transaction_id, 'amount_less_50_percent', printf('%.2f', amount::DOUBLE), printf('%.2f', amount::DOUBLE * 0.5), CASE WHEN amount::DOUBLE * 0.5 > 10000 THEN 'yes' ELSE 'no' END FROM txn
UNION ALL SELECT transaction_id, 'low_risk_destination', country_destination, 'US', 'no' FROM txn WHERE country_destination IN ('IR', 'KP', 'SY')
UNION ALL SELECT transaction_id, 'business_hours', hour(ts) || ':00', '14:00', 'possibly' FROM txn WHERE hour(ts) < 6 OR hour(ts) > 22""")  # fmt: skip
def x2(spark, sf):
    return C.counterfactuals(txn(spark, sf))


@query("x3_regulations", "txn", """
SELECT transaction_id, 'FATF Recommendation 10' AS regulation FROM txn WHERE amount > 10000 UNION ALL SELECT transaction_id, 'FinCEN CTR' FROM txn WHERE amount > 10000 AND transaction_type IN ('cash_deposit', 'cash_withdrawal')
UNION ALL SELECT transaction_id, 'BSA/AML Anti-Structuring' FROM txn WHERE amount >= 9000 AND amount < 10000 UNION ALL SELECT transaction_id, 'OFAC Sanctions' FROM txn WHERE country_destination IN ('IR', 'KP', 'SY', 'CU')""")  # fmt: skip
def x3(spark, sf):
    t = txn(spark, sf)
    near = t.where("amount >= 9000 AND amount < 10000").select("transaction_id", F.array(F.lit("structuring")).alias("patterns"))
    return C.regulations(t, near).select("transaction_id", "regulation")


@query("x4_decision_path", "txn", _CONSOLIDATED + """
SELECT transaction_id, array_to_string(list(detector || '=' || suspicious ORDER BY CASE detector WHEN 'country' THEN 1 WHEN 'basic' THEN 2 ELSE 3 END), ',') AS path, round(avg(confidence), 6)::DOUBLE AS overall_confidence, CASE WHEN avg(confidence) > 0.9 THEN 'High agreement between agents' END AS factor FROM results GROUP BY 1""")  # fmt: skip
def x4(spark, sf):
    out = C.decision_path(results(spark, sf), ("country", "basic", "size"))
    steps = F.transform("path", lambda p: F.concat_ws("=", p["detector"], p["suspicious"].cast("string")))
    return out.select("transaction_id", F.array_join(steps, ",").alias("path"), F.round("overall_confidence", 6).alias("overall_confidence"), "factor")


@query("x5_audit_log", "txn", """SELECT transaction_id, sha256('{"amount":' || amount || ',"sender_id":' || sender_id || ',"transaction_id":' || transaction_id || '}') AS content_hash, true AS intact FROM txn""")
def x5(spark, sf):
    entries = C.audit(txn(spark, sf), ["transaction_id", "amount", "sender_id"])
    return C.verify(entries, ["transaction_id", "amount", "sender_id"]).select("transaction_id", "content_hash", "intact")


@query("x5_audit_history", "txn", """SELECT sender_id, transaction_id, row_number() OVER (PARTITION BY sender_id ORDER BY ts, transaction_id) AS place FROM txn WHERE sender_id IN (SELECT sender_id FROM txn WHERE amount > 20000)""")
def x5_history(spark, sf):
    t = txn(spark, sf)
    entries = C.audit(t.withColumn("at", F.struct("ts", "transaction_id")), ["transaction_id", "amount", "sender_id"])
    return C.audit_history(entries, "sender_id", t.where("amount > 20000"), "at").select("sender_id", "transaction_id", "place")


@query("n1_alert_text", "txn", _ALERTS + """ SELECT alert_id, 'Alert ' || alert_id || ' of type ' || alert_type || ' at level ' || level || '. Patterns: ' || array_to_string(list_sort(patterns), ', ') || '. Transactions: ' || amount || ' USD from ' || sender_id || ' to ' || receiver_id || '. Priority: ' || printf('%.2f', score) AS text FROM al""")
def n1_alert(spark, sf):
    a = alerts(spark, sf).withColumn("patterns", F.array_sort("patterns"))
    return N.alert_text(a, C.attach(a.select("alert_id", "transaction_ids"), txn(spark, sf))).select("alert_id", "text")


@query("e2_best_match", "", NAMES + _BLOCK + """l AS (SELECT a, b, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS t FROM pairs),
w AS (SELECT a, b, s, unnest(list_transform(generate_series(1, length(t) - length(s) + 1), lambda k: substr(t, k, length(s)))) AS piece FROM l),
pr AS (SELECT a, b, max(100.0::DOUBLE * (1 - levenshtein(s, piece) / length(s))) AS partial FROM w GROUP BY 1, 2),
x AS (SELECT a, b, partial, 100 * (1 - levenshtein(a, b) / greatest(length(a), length(b))) AS ratio,
  100 * (1 - levenshtein(array_to_string(list_sort(string_split(a, ' ')), ' '), array_to_string(list_sort(string_split(b, ' ')), ' ')) / greatest(length(a), length(b))) AS sorted,
  100 * len(list_intersect(list_distinct(string_split(a, ' ')), list_distinct(string_split(b, ' ')))) / least(len(list_distinct(string_split(a, ' '))), len(list_distinct(string_split(b, ' ')))) AS shared FROM pr),
g AS (SELECT *, greatest(round(ratio, 4), round(partial, 4), round(sorted, 4), round(shared, 4)) AS score FROM x)
SELECT a, b, CASE WHEN a = b THEN 100 ELSE score END::DOUBLE AS score, CASE WHEN a = b THEN 'exact' WHEN round(ratio, 4) = score THEN 'ratio' WHEN round(partial, 4) = score THEN 'partial_ratio' WHEN round(sorted, 4) = score THEN 'sorted_words' ELSE 'shared_words' END AS method FROM g""")  # fmt: skip
def e2_best(spark, sf):
    pairs = S.candidates(names(spark, sf), watchlist(spark, sf), whole=False).toDF("a", "b")
    return pairs.select("a", "b", F.inline(F.array(S.best_match(F.col("a"), F.col("b")))))


# cases: the alerts of one subject, type and month as one, so that an alert has several transactions
_CASES = _ALERTS + """,
cs AS (SELECT sha256('case|' || sender_id || '|' || alert_type || '|' || strftime(date_trunc('month', ts), '%Y-%m-%d')) AS alert_id, sender_id, alert_type, max(score) AS score, arg_max(level, (score, alert_id)) AS level,
  list_sort(list_distinct(flatten(list(findings)))) AS findings FROM al GROUP BY sender_id, alert_type, date_trunc('month', ts)),
ct AS (SELECT cs.*, al.transaction_id, al.amount, al.ts, row_number() OVER (PARTITION BY cs.alert_id ORDER BY al.ts, al.transaction_id) AS place, count(*) OVER (PARTITION BY cs.alert_id) AS n
  FROM al JOIN cs ON cs.alert_id = sha256('case|' || al.sender_id || '|' || al.alert_type || '|' || strftime(date_trunc('month', al.ts), '%Y-%m-%d'))),
na AS (SELECT alert_id, string_agg(strftime(ts, '%Y-%m-%d') || ' ' || transaction_id || ' ' || amount, chr(10) ORDER BY place) FILTER (place <= 10) || CASE WHEN max(n) > 10 THEN chr(10) || 'and ' || (max(n) - 10) || ' more' ELSE '' END AS narrative FROM ct GROUP BY 1)"""


def case_alerts(spark, sf):
    return C.case_alerts(alerts(spark, sf))


@query("c3_case_explanations", "txn", _CASES + " SELECT alert_id, round(score, 6) AS priority, alert_type || ' alert at level ' || level || '. ' || array_to_string(list_transform(findings[1:5], lambda f: '- ' || f), ' ') AS explanation FROM cs")
def c3_case(spark, sf):
    return C.explanation(case_alerts(spark, sf)).select("alert_id", F.round("priority", 6).alias("priority"), "explanation")


@query("c6_case_reports", "txn", _CASES + " SELECT alert_id, sender_id AS subject_id, sum(amount)::DOUBLE AS total_amount, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS until FROM ct GROUP BY 1, 2")
def c6_case(spark, sf):
    out = C.report(case_alerts(spark, sf), txn(spark, sf))
    return out.select("alert_id", "subject_id", "total_amount", "n", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(n) for c, n in (("start", "start"), ("end", "until"))))


@query("c8_case_narratives", "txn", _CASES + " SELECT alert_id, narrative FROM na")
def c8_case(spark, sf):
    return C.narrative(case_alerts(spark, sf), txn(spark, sf))


# reports of 3, 6, ... transactions lose their type, those of 4, 8, ... their narrative
@query("c10_case_checks", "txn", _CASES + """, x AS (SELECT alert_id, max(n) AS n, sum(amount) AS total FROM ct GROUP BY 1)
SELECT alert_id, concat_ws(',', CASE WHEN n % 3 = 0 THEN 'alert_type' END, CASE WHEN n % 4 = 0 THEN 'narrative' END) AS errors, concat_ws(',', CASE WHEN n % 4 <> 0 AND length(narrative) < 100 THEN 'short_narrative' END, CASE WHEN total < 5000 THEN 'small_amount' END) AS warnings
FROM x JOIN na USING (alert_id)""")  # fmt: skip
def c10_case(spark, sf):
    a, t = case_alerts(spark, sf), txn(spark, sf)
    made = C.report(a, t).join(C.narrative(a, t), "alert_id")
    out = C.validate_report(made.withColumns({"alert_type": F.when(F.col("n") % 3 != 0, F.col("alert_type")), "narrative": F.when(F.col("n") % 4 != 0, F.col("narrative"))}))
    return out.select("alert_id", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"))


@query("c11_case_transaction_xml", "txn", _CASES + f""" SELECT alert_id, '<goAMLMessage version="5.0"><report_header><report_code>STR</report_code><submission_date>{AS_OF[:10]}</submission_date></report_header><reporting_entity><entity_id>7</entity_id><entity_name>A &amp; B</entity_name></reporting_entity>'
  || string_agg('<transaction><transaction_id>' || transaction_id || '</transaction_id><amount>' || amount || '</amount><currency>USD</currency><date>' || strftime(ts, '%Y-%m-%d') || '</date></transaction>', '' ORDER BY place) || '<reason_for_suspicion>' || alert_type || '</reason_for_suspicion></goAMLMessage>' AS xml FROM ct GROUP BY alert_id, alert_type""")  # fmt: skip
def c11_case(spark, sf):
    return C.transaction_xml(case_alerts(spark, sf), txn(spark, sf), "7", "A & B", AS_OF[:10])


@query("j7_case_attached", "txn", _CASES + " SELECT alert_id, transaction_id, amount::DOUBLE AS amount FROM ct")
def j7_case(spark, sf):
    return C.attach(case_alerts(spark, sf), txn(spark, sf)).select("alert_id", "transaction_id", F.col("amount").cast("double").alias("amount"))


@query("e8_match_bands", "", """
m AS (SELECT a.p_partkey, (a.p_type = b.p_type)::DOUBLE * 0.4::DOUBLE + (a.p_brand = b.p_brand)::DOUBLE * 0.3::DOUBLE + (a.p_size = b.p_size)::DOUBLE * 0.25::DOUBLE AS t FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)
SELECT p_partkey, round(t, 6) AS score, CASE WHEN t > 0.9 THEN 'exact' WHEN t > 0.7 THEN 'strong' WHEN t > 0.5 THEN 'weak' ELSE 'none' END AS band FROM m""")  # fmt: skip
def e8(spark, sf):
    a = table(spark, sf, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    pairs = a.join(a.select((F.col("p_partkey") - 1).alias("p_partkey"), *(F.col(c).alias(f"{c}_2") for c in ("p_type", "p_brand", "p_size"))), "p_partkey")
    total, band = S.match_band([(F.col(c) == F.col(f"{c}_2"), w) for c, w in (("p_type", 0.4), ("p_brand", 0.3), ("p_size", 0.25))])
    return pairs.select("p_partkey", F.round(total, 6).alias("score"), band.alias("band"))
