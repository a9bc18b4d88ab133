"""Scalar functions as used across the operators (SC), each row of the survey checked over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .bindings import query, table


@query("sc1_strings", "", """
SELECT p_partkey, upper(trim(p_name)) AS loud, string_split(p_name, ' ')[1] AS first_word, array_to_string(list_sort(string_split(p_name, ' ')), '_') AS joined,
  contains(p_name, 'e') AS has_e, substr(p_name, 1, 3) AS head, right(p_name, 3) AS tail, regexp_replace(p_name, '[aeiou]', '', 'g') AS bare, len(regexp_extract_all(p_name, '[aeiou]')) AS n_vowels FROM part""")  # fmt: skip
def sc1(spark, sf):
    c, words = F.col("p_name"), F.split("p_name", " ")
    return table(spark, sf, "part").select(
        "p_partkey", F.upper(F.trim(c)).alias("loud"), F.get(words, F.lit(0)).alias("first_word"), F.array_join(F.array_sort(words), "_").alias("joined"), F.contains(c, F.lit("e")).alias("has_e"),
        F.substring(c, 1, 3).alias("head"), F.right(c, F.lit(3)).alias("tail"), F.regexp_replace(c, "[aeiou]", "").alias("bare"), F.size(F.regexp_extract_all(c, F.lit("[aeiou]"), 0)).alias("n_vowels"),
    )


@query("sc2_times", "", """
SELECT event_id, hour(ts) AS hour, dayofweek(ts) AS weekday, day(ts) AS day, month(ts) AS month, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS at_hour,
  datediff('day', DATE '2024-01-01', ts::DATE) AS days, floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000)::BIGINT AS seconds FROM events""")  # fmt: skip
def sc2(spark, sf):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select(
        "event_id", F.hour(ts).alias("hour"), (F.dayofweek(ts) - 1).alias("weekday"), F.day(ts).alias("day"), F.month(ts).alias("month"), F.date_format(F.date_trunc("hour", ts), "yyyy-MM-dd HH:mm").alias("at_hour"),
        F.datediff(F.to_date(ts), F.lit("2024-01-01").cast("date")).alias("days"), F.floor((F.unix_micros(ts) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 1_000_000).alias("seconds"),
    )


@query("sc3_numbers", "", """
SELECT event_id, round(ln(1 + abs(value)), 6) AS log1p, round(sqrt(abs(value)), 6) AS root, event_id % 7 AS rest, round(least(greatest(value, 10), 100), 6) AS clamped, round(log10(1 + abs(value)), 6) AS digits FROM events""")
def sc3(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_id", F.round(F.log1p(F.abs(v)), 6).alias("log1p"), F.round(F.sqrt(F.abs(v)), 6).alias("root"), (F.col("event_id") % 7).alias("rest"),
        F.round(F.least(F.greatest(v, F.lit(10.0)), F.lit(100.0)), 6).alias("clamped"), F.round(F.log10(1 + F.abs(v)), 6).alias("digits"),
    )


@query("sc4_arrays", "", """
w AS (SELECT p_partkey, string_split(p_name || ' ' || p_brand, ' ') AS a FROM part)
SELECT p_partkey, len(list_distinct(a)) AS n_distinct, len(a) AS n, array_to_string(a[1:2], ' ') AS head, a[-1] AS tail, list_contains(a, 'part') AS has_part, list_sum(list_transform(a, lambda x: length(x)))::BIGINT AS letters FROM w""")  # fmt: skip
def sc4(spark, sf):
    a = F.split(F.concat_ws(" ", "p_name", "p_brand"), " ")
    return table(spark, sf, "part").select(
        "p_partkey", F.size(F.array_distinct(a)).alias("n_distinct"), F.size(a).alias("n"), F.array_join(F.slice(a, 1, 2), " ").alias("head"), F.element_at(a, -1).alias("tail"), F.array_contains(a, "part").alias("has_part"),
        F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("letters"),
    )


@query("sc5_maps", "", """
SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, coalesce(json_extract_string(props, '$.absent'), 'none') AS absent, array_to_string(list_sort(list_filter(json_keys(props), lambda x: contains(x, 'k'))), ',') AS keys FROM events""")
def sc5(spark, sf):
    m = F.from_json("props", "map<string,string>")
    return table(spark, sf, "events").withColumn("m", m).select(
        "event_id", F.coalesce(F.try_element_at("m", F.lit("k")), F.lit("none")).alias("k"), F.coalesce(F.try_element_at("m", F.lit("absent")), F.lit("none")).alias("absent"),
        F.array_join(F.array_sort(F.map_keys(F.map_filter("m", lambda k, v: F.contains(k, F.lit("k"))))), ",").alias("keys"),
    )


@query("sc6_json", "", """SELECT event_id, '{"id":' || event_id || ',"type":"' || event_type || '","at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '"}' AS text, event_type AS back FROM events""")
def sc6(spark, sf):
    at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    text = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"), at.alias("at")))
    return table(spark, sf, "events").withColumn("text", text).select("event_id", "text", F.from_json("text", "type string")["type"].alias("back"))
