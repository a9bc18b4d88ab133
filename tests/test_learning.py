"""Model operators: planted outliers, saved pipelines, ranks and folds; sequences with hand-made rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerlynx.operators import learning as L
from ledgerlynx.operators import patterns, rules, screening


def points(spark):
    """Two columns in a ring near the centre, and three rows far away."""
    near = spark.range(600).select("id", F.sin("id").alias("a"), F.cos(F.col("id") * 3).alias("b"))
    return near.union(spark.createDataFrame([(1000, 40.0, 40.0), (1001, -40.0, 35.0), (1002, 38.0, -45.0)], near.schema))


def test_outliers_find_planted_rows_and_few_others(spark):
    df = points(spark)
    out = L.outliers(L.reducer(df, ["a", "b"]).transform(df), "id")
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == 603 and all(got[k]["is_anomaly"] and got[k]["votes"] == 2 and got[k]["confidence"] == 1 for k in (1000, 1001, 1002))
    assert sum(r["is_anomaly"] for r in got.values()) <= 2 * 0.05 * 603 + 2
    assert min(got[k]["isolation"] for k in (1000, 1001, 1002)) > max(r["isolation"] for k, r in got.items() if k < 1000)


def test_equal_rows_are_one_point_with_their_number_as_weight(spark, monkeypatch):
    rows = spark.range(1200).select("id", F.sin(F.col("id") % 40).alias("a"), F.cos(F.col("id") % 40 * 3).alias("b")).where("id % 40 < 20 OR id < 600")
    seen, scatter = [], L.robust_scatter
    monkeypatch.setattr(L, "robust_scatter", lambda x, *a, **k: seen.append(x.count()) or scatter(x, *a, **k))
    out = L.outliers(L.reducer(rows, ["a", "b"]).transform(rows), "id")
    assert seen == [40] and out.count() == rows.count() == 900
    x = rows.select(F.array("a", "b").alias("x"))
    points = x.groupBy("x").agg(F.count("*").alias("n"))
    whole, weighted = scatter(x, 2), scatter(points, 2, weight=F.col("n"))
    assert abs(whole[0] - weighted[0]).max() < 1e-9 and abs(whole[1] - weighted[1]).max() < 1e-9


def test_quantiles_are_exact(spark):
    values = [(float(v), k % 4) for k, v in enumerate([*range(50), *[7.5] * 30, 1e18, -1e12, 3e-300])]
    x = spark.createDataFrame(values, "a double, n int").repartition(3)
    long = sorted(v for v, n in values for _ in range(n))
    for share in (0.0, 0.77):
        place = max(1, -int(-share * len(long) // 1)) - 1
        want = [long[place], sorted(abs(v) for v in long)[place]]
        assert L.quantiles(x, [F.col("a"), F.abs("a")], share, F.col("n"), bins=64) == want
    assert L.quantiles(x.where("a > 1e30"), [F.col("a")], 0.5) == [None]


def test_components_are_scaled_and_survive_saving(spark, tmp_path):
    df = points(spark)
    model = L.reducer(df, ["b", "a"])
    L.save_model(model, str(tmp_path / "m"))
    L.save_model(model, str(tmp_path / "m"))  # over the older one
    before, after = (m.transform(df).select("id", "reduced").orderBy("id").collect() for m in (model, L.load_model(str(tmp_path / "m"))))
    assert before == after
    z = [list(r["reduced"]) for r in before]
    assert all(abs(sum(c)) < 1e-6 for c in zip(*z, strict=True))
    assert abs(sum(x * y for x, y in z)) < 1e-6  # uncorrelated


def test_ranker_puts_the_highest_class_first(spark):
    alerts = spark.range(300).select("id", (F.col("id") / 300).alias("risk_score"), F.floor(F.col("id") / 100).cast("int").alias("priority"))
    out = L.ranked(alerts, L.ranker(alerts)).collect()
    assert min(r["rank_score"] for r in out if r["priority"] == 2) > max(r["rank_score"] for r in out if r["priority"] == 0)
    assert [r["rank_score"] for r in L.ranked(alerts).orderBy("id").limit(2).collect()] == [0.0, 1 / 300]


def test_folds_and_robustness(spark):
    rows = L.assemble(spark.range(400).select("id", F.col("id").cast("double").alias("a"), (F.col("id") >= 200).cast("int").alias("y")), ["a"])
    got = L.cross_validate(rows, "y", "id", depths=(1, 2), folds=3).collect()
    assert [r["max_depth"] for r in got] == [1, 2] and all(r["auc"] > 0.95 for r in got)
    fixed, cut = (lambda d: d.withColumn("prediction", F.lit(1))), (lambda d: d.withColumn("prediction", (F.col("a") >= 200).cast("int")))
    both = {r["scorer"]: r for r in L.compare_robustness(rows, ["a"], {"fixed": fixed, "cut": cut}, "id").collect()}
    assert both["fixed"]["flips"] == 0 and both["fixed"]["band"] == "robust" and 0 < both["cut"]["flips"] < 0.1


T0 = datetime(2024, 1, 1)


def test_layering_sequence(spark):
    def of(sender, first, *kinds):
        return [(first + k, sender, 9, kind, T0 + timedelta(hours=k)) for k, kind in enumerate(kinds)]

    w, d, out = "wire_transfer", "cash_deposit", "cash_withdrawal"
    rows = of(1, 10, d, w, "ach", w, out) + of(2, 20, d, w, w, out) + of(3, 30, w, w, w, d, out) + of(4, 40, d, w, w, d, w, out)
    rows += [(50, 5, 9, d, T0), *((51 + k, 5, 9, w, T0 + timedelta(days=1)) for k in range(3)), (55, 5, 9, out, T0 + timedelta(days=7, seconds=1))]
    t = spark.createDataFrame(rows, "transaction_id long, sender_id long, receiver_id long, transaction_type string, ts timestamp")
    assert sorted(map(tuple, patterns.layering_sequence(t).collect())) == [(1, 14, 3), (4, 45, 3)]


def test_equal_spacing(spark):
    minutes = {1: (0, 60, 121), 2: (0, 60, 180), 3: (0, 1440, 2880), 4: (0, 60)}
    rows = [(10 * s + k, s, T0 + timedelta(minutes=m)) for s, times in minutes.items() for k, m in enumerate(times)]
    t = spark.createDataFrame(rows, "transaction_id long, sender_id long, ts timestamp")
    assert sorted(r["transaction_id"] for r in rules.equal_spacing(t).where("R015").collect()) == [12, 32]


def test_partial_ratio(spark):
    rows = [("bin laden", "osama bin laden", 100.0), ("kim", "kam jong", 100 * 2 / 3), ("", "abc", 100.0), ("abc", "xyz", 0.0)]
    got = spark.createDataFrame(rows, "a string, b string, want double").withColumn("got", screening.partial_ratio(F.col("a"), F.col("b"))).collect()
    assert all(abs(r["got"] - r["want"]) < 1e-9 for r in got)


def test_a_label_is_split_by_several_tasks(spark):
    from hashlib import md5

    from ledgerlynx.operators import ordering

    ranges, dealt = ordering.ranges, []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together again
    try:
        with pytest.MonkeyPatch.context() as m:
            m.setattr(ordering, "ranges", lambda *a, **k: dealt.append(ranges(*a, **k)) or dealt[-1])
            got = {(r["label"], r["id"]): r["part"] for r in L.split(spark.range(1_000).selectExpr("id", "IF(id % 10 = 0, 1, IF(id = 3, NULL, 0)) AS label"), "label", "id").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for label, ids in ((1, range(0, 1_000, 10)), (0, [k for k in range(1_000) if k % 10 and k != 3]), (None, [3])):
        order = sorted(ids, key=lambda k: md5(str(k).encode()).hexdigest())
        assert all(got[label, k] == ("train" if place <= int(len(order) * 0.8) else "test") for place, k in enumerate(order, 1))
    assert dealt and dealt[0].where("label = 0").groupBy("range").count().agg(F.max("count")).first()[0] < 500


def test_folds_count_equal_rows_once(spark, monkeypatch):
    df = spark.range(4000).select("id", (F.col("id") % 6).cast("double").alias("a"), (F.col("id") % 12 >= 5).cast("int").alias("label"))
    sizes, cut = [], L.cut
    monkeypatch.setattr(L, "cut", lambda d: sizes.append(d.count()) or cut(d))
    got = {r["max_depth"]: r["auc"] for r in L.cross_validate(L.assemble(df, ["a"]), "label", "id", depths=(2,)).collect()}
    assert sizes == [5 * 2 * 6 - 5] and 0.55 < got[2] < 0.7  # 9/14 of the pairs, but for the deal
