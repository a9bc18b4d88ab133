"""Boundary values of the rules and history frames, on hand-made frames."""

from datetime import datetime, timedelta
from decimal import Decimal

from ledgerlynx.operators import history, network, patterns, rules, validation

COLUMNS = "transaction_id long, ts timestamp, amount decimal(18,2), currency string, transaction_type string, sender_id long, receiver_id long, country_origin string, country_destination string, risk_score double, is_suspicious boolean"
T0 = datetime(2024, 1, 10, 12)


def frame(spark, rows):
    base = {"ts": T0, "amount": 100, "currency": "USD", "transaction_type": "ach", "sender_id": 1, "receiver_id": 2, "country_origin": "US", "country_destination": "US", "risk_score": 0.0, "is_suspicious": False}
    made = []
    for k, r in enumerate(rows):
        r = {"transaction_id": k} | base | r
        r["amount"] = None if r["amount"] is None else Decimal(str(r["amount"]))
        made.append(tuple(r[c.split()[0]] for c in COLUMNS.split(", ")))
    return spark.createDataFrame(made, COLUMNS)


def test_amount_bands(spark):
    amounts = [8999.99, 9000, 9999.99, 10000, 10000.01, 50000, 50000.01, 100000.01]
    out = rules.amount_rules(frame(spark, [{"amount": a} for a in amounts])).orderBy("transaction_id").collect()
    assert [r["R004"] for r in out] == [False, True, True, True, False, False, False, False]
    assert [bool(r["R001"]) for r in out] == [False, False, False, False, True, True, False, False]
    assert [bool(r["R002"]) for r in out] == [False] * 6 + [True, False]
    assert bool(out[7]["R003"])


def test_history_frames_floor_days(spark):
    day, tick = timedelta(days=1), timedelta(microseconds=1)
    for gap, inside in ((day, False), (day - tick, True)):
        t = frame(spark, [{"ts": T0 - gap, "amount": 9000}, {"ts": T0, "amount": 2000}])
        passed = rules.history_rules(t).where("transaction_id = 1").first()["R008"]
        assert passed is inside
    for gap, inside in ((8 * day, False), (8 * day - tick, True)):
        t = frame(spark, [{"ts": T0 - gap, "amount": 24000}, {"ts": T0, "amount": 2000}])
        assert rules.history_rules(t).where("transaction_id = 1").first()["R009"] is inside


def test_rows_at_one_time_are_no_history(spark):
    out = history.moments(frame(spark, [{}, {}])).collect()
    assert [r["h_n"] for r in out] == [0, 0]


def test_structuring_ramp(spark):
    ramp = [{"ts": T0 + timedelta(hours=k), "amount": 9500 + 100 * k, "transaction_type": "cash_deposit"} for k in range(15)]
    out = patterns.structuring_windows(frame(spark, ramp)).collect()
    assert len(out) == 1 and out[0]["n"] == 5 and out[0]["total"] == 48500.0


def test_three_layer_network(spark):
    rows = [{"sender_id": 1, "receiver_id": 5, "amount": 50000}, {"sender_id": 5, "receiver_id": 10, "amount": 25000, "ts": T0 + timedelta(hours=2)}, {"sender_id": 10, "receiver_id": 1, "amount": 25000, "ts": T0 + timedelta(hours=4)}]
    t = frame(spark, rows)
    assert patterns.three_party(t, kind=None).count() == 1
    e = network.edges(t)
    assert [r["path"] for r in network.cycles(e, 4).collect()] == [[1, 5, 10]]
    assert network.strong_components(e).select("component").distinct().count() == 1
    assert {r["node"]: round(r["rank"], 6) for r in network.pagerank(e, 5).collect()} == {1: 0.333333, 5: 0.333333, 10: 0.333333}


def test_schema_check_with_nulls(spark):
    out = validation.check_schema(frame(spark, [{"amount": 0}, {"currency": None}, {"transaction_type": "barter"}, {}])).orderBy("transaction_id").collect()
    assert [r["errors"] for r in out] == [["amount"], ["currency"], ["transaction_type"], []]


def test_empty_table(spark):
    empty = frame(spark, [{}]).where("false")
    assert history.habits(empty).count() == 0 and patterns.reciprocal(empty).count() == 0


def test_keyword_description(spark):
    df = spark.createDataFrame([("Urgent consulting cash gift",), ("",), (None,)], "text string")
    out = rules.description_score(df, "text").collect()
    assert round(out[0]["description_risk"], 6) == 0.85 and out[0]["description_suspicious"] and out[1]["description_risk"] is None and out[2]["description_risk"] is None
