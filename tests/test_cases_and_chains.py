"""Alerts of several transactions, and chains of transfers against brute force."""

import random
from datetime import datetime, timedelta

from ledgerlynx.operators import cases, rules

T0 = datetime(2024, 1, 1)


def transfers(spark, rows):
    return spark.createDataFrame(rows, "transaction_id long, sender_id long, receiver_id long, ts timestamp")


def test_chains_against_brute_force(spark):
    rnd = random.Random(5)
    # account 0 takes part in a third of all transfers; times tie, and fall on the edges of the buckets
    rows = [(k, rnd.choice([0, 0, 0, *range(1, 7)]), rnd.choice([0, 0, 0, *range(1, 7)]), T0 + timedelta(minutes=30 * rnd.randrange(300))) for k in range(250)]
    depth = {}
    for k, s, r, at in sorted(rows, key=lambda x: x[3]):
        if s != r:
            depth[k] = min(6, 1 + max((depth[j] for j, s2, r2, at2 in rows if s2 != r2 and r2 == s and at2 < at and at - at2 <= timedelta(hours=2) and j in depth), default=0))
    out = {r["transaction_id"]: (r["depth"], r["R021"]) for r in rules.complex_web(transfers(spark, rows), hours=2).collect()}
    assert out == {k: (d, d > 5) for k, d in depth.items()} and {1, 6} <= set(depth.values())


def test_chains_at_their_limits(spark):
    hop = timedelta(hours=24)
    rows = [(k, k, k + 1, T0 + k * hop) for k in range(7)]  # each exactly a day later still counts
    out = {r["transaction_id"]: r["depth"] for r in rules.complex_web(transfers(spark, rows)).collect()}
    assert out == {k: min(k + 1, 6) for k in range(7)}
    late = [(k, k, k + 1, T0 + k * (hop + timedelta(microseconds=1))) for k in range(3)]
    assert {r["depth"] for r in rules.complex_web(transfers(spark, late)).collect()} == {1}
    assert rules.complex_web(transfers(spark, [])).count() == 0 and rules.complex_web(transfers(spark, [(1, None, 2, T0), (2, 2, 2, T0)])).count() == 0


ALERT = "alert_id string, created_at timestamp, alert_type string, risk_level string, priority double, transaction_ids array<long>, customer_ids array<long>, triggered_by array<string>, patterns array<string>, findings array<string>"


def test_case_alerts(spark):
    def alert(k, day, kind, level, priority, t, customers):
        return (f"a{k}", T0 + timedelta(days=day), kind, level, priority, [t], customers, [f"d{k}"], ["p"], [f"f{k}"])

    rows = [alert(1, 0, "X", "low", 0.5, 11, [7, 8]), alert(2, 5, "X", "high", 0.7, 12, [7, 3]), alert(3, 6, "X", "critical", 0.7, 12, [7, 9]), alert(4, 40, "X", "low", 0.4, 13, [7]), alert(5, 1, "Y", "low", 0.4, 14, []), alert(6, 2, "Y", "low", 0.4, 15, [])]
    out = sorted(cases.case_alerts(spark.createDataFrame(rows, ALERT)).collect(), key=lambda r: (r["alert_type"], -r["n_alerts"]))
    assert [(r["alert_type"], r["n_alerts"], r["transaction_ids"], r["customer_ids"], r["risk_level"]) for r in out] == [
        ("X", 3, [11, 12], [7, 3, 8, 9], "critical"), ("X", 1, [13], [7], "low"), ("Y", 2, [14, 15], [], "low")]
    assert out[0]["findings"] == ["f1", "f2", "f3"] and out[0]["created_at"] == T0 and len({r["alert_id"] for r in out}) == 3


def test_narrative_cuts_after_ten(spark):
    a = spark.createDataFrame([("a", list(range(13))), ("b", list(range(10))), ("c", [99])], "alert_id string, transaction_ids array<long>")
    t = spark.createDataFrame([(k, T0 + timedelta(days=k // 2), float(k)) for k in range(12, -1, -1)], "transaction_id long, ts timestamp, amount double")
    out = {r["alert_id"]: r["narrative"].split("\n") for r in cases.narrative(a, t).collect()}
    first = [f"2024-01-{1 + k // 2:02d} {k} {float(k)}" for k in range(10)]
    assert out == {"a": [*first, "and 3 more"], "b": first}


def test_rate_alarms(spark):
    from pyspark.sql import functions as F

    from ledgerlynx.operators import reports

    # windows 0, 1, 4: four missing values in the first, three in the second, none later
    rows = [(0, None)] * 4 + [(299, "x")] + [(300, None)] * 3 + [(1200, "x")]
    t = spark.createDataFrame(rows, "s long, note string").withColumn("ts", F.timestamp_seconds("s"))
    out = sorted(map(tuple, reports.rate_alarms(t, F.isnull("note")).collect()))
    assert [(b, n, m, q) for b, n, _, m, q in out] == [(0, 5, True, False), (1, 3, False, False), (2, 0, False, False), (3, 0, False, True), (4, 1, False, False)]
    assert reports.rate_alarms(t.where("false"), F.isnull("note")).count() == 0


def test_ranks_of_held_out_alerts(spark):
    """The label follows the hidden rule of one feature and of noise; ranks of rows that were not fitted on must tell it."""
    import random

    from ledgerlynx.operators import learning

    rnd = random.Random(3)
    rows = [(k, float(a := rnd.randrange(20_000)), rnd.random(), int(a + rnd.gauss(0, 3000) > 10_000)) for k in range(1200)]
    d = learning.split(spark.createDataFrame(rows, "transaction_id long, amount double, risk_score double, label int"), "label", "transaction_id")
    out = learning.ranked(d.where("part = 'test'"), learning.ranker(d.where("part = 'train'"), "label")).collect()
    good, bad = ([r["rank_score"] for r in out if r["label"] == y] for y in (1, 0))
    assert len(out) < 300 and sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)) > 0.9
