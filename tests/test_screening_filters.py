"""Piece filters and phonetic keys of name screening against the full product of names and list; drift and robust scatter on planted rows."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlynx.operators import learning, ordering, rules
from ledgerlynx.operators import screening as S


@pytest.fixture(scope="module")
def people(spark):
    rnd = random.Random(8)
    first, last = "john maria viktor anneliese bo li oleksandr jane".split(), "petrenko marlowe smith o ng schwarzenberger lorrimer de".split()
    listed = sorted({f"{rnd.choice(first)} {rnd.choice(last)}" for _ in range(40)} | {"bo", "a b", "ng", "x"})

    def spoilt(s):
        for _ in range(rnd.randrange(3)):
            k = rnd.randrange(len(s) + 1)
            s = rnd.choice([s[:k] + rnd.choice("aeixz ") + s[k:], s[:k] + s[k + 1 :], s[:k] + "q" + s[k + 1 :]])
        return rnd.choice([s, s.upper(), " ".join(reversed(s.split(" ")))])

    names = sorted({spoilt(rnd.choice(listed)) for _ in range(120)} | {"", "zzzz yyyy", "bo"})
    return spark.createDataFrame([(n,) for n in names] + [(None,)], "name string"), spark.createDataFrame([("OFAC", w) for w in listed], "source string, name_norm string")


@pytest.mark.parametrize("least", [60, 85])
def test_no_pair_above_the_score_is_lost(people, least):
    names, watch = people
    product = names.where("name IS NOT NULL").join(watch, F.lit(True)).select("name", "name_norm").distinct()
    scored = lambda d: {(r["name"], r["name_norm"], r["s"]) for r in d.withColumn("s", F.round(S.score(F.lower("name"), F.col("name_norm")), 4)).where(F.col("s") >= least).select("name", "name_norm", "s").collect()}
    pairs = S.near_pairs(names, watch, least)
    want = scored(product)
    assert scored(pairs) == want and len(want) > 20
    if least == 85:
        assert pairs.count() < 0.35 * product.count()
    plan = S.screen(names, watch, least)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Join Inner\n" not in plan


def test_names_that_sound_alike(spark):
    names = spark.createDataFrame([("Jon Smyth",), ("SMITH john",), ("Jane Doe",), ("",), (None,)], "name string")
    watch = spark.createDataFrame([("X", "john smith"), ("X", "jane dow")], "source string, name_norm string")
    assert {(r["name"], r["name_norm"]) for r in S.sounding_alike(names, watch).collect()} == {("Jon Smyth", "john smith"), ("SMITH john", "john smith"), ("Jane Doe", "jane dow")}


def test_entities_with_sizes(spark):
    names = spark.createDataFrame([(1, "ann lee"), (2, "lee ann"), (3, "bo"), (4, "ann leee")], "id long, name string")
    assert {tuple(r) for r in S.entities(names).collect()} == {(1, "ann lee", 1, 2), (2, "lee ann", 1, 2), (3, "bo", 3, 1), (4, "ann leee", 4, 1)}


def test_running_sums_by_group(spark):
    rnd = random.Random(2)
    rows = [(g, k, rnd.randrange(9)) for g in ("a", "b", None) for k in rnd.sample(range(1000), 200)]
    out = ordering.running(spark.createDataFrame(rows, "g string, k long, v long").repartition(5), "k", {"total": F.col("v")}, rows=40, by=("g",))
    assert {tuple(r) for r in out.select("g", "k", "v", "total").collect()} == {(g, k, v, sum(w for h, j, w in rows if h == g and j <= k)) for g, k, v in rows}
    assert out.columns == ["g", "k", "v", "total"]


def test_drift_of_all_features(spark):
    rnd = random.Random(1)
    make = lambda shift: spark.createDataFrame([(rnd.gauss(0, 1), rnd.gauss(shift, 1), None if k % 7 == 0 else rnd.choice("ab"), rnd.choice("xxxy" if shift else "xyyy"), None) for k in range(600)], "same double, moved double, c string, d string, none double")
    before, now = make(0), make(1)
    out = {r["feature"]: r for r in learning.drift(before, now, ["same", "moved", "none"], ["c", "d"]).collect()}
    assert {f for f in out if out[f]["drifted"]} == {"moved", "d"} and set(out) == {"same", "moved", "c", "d"}
    a, b = ([r["moved"] for r in d.collect()] for d in (before, now))
    assert abs(out["moved"]["statistic"] - max(abs(np.mean(np.array(a) <= v) - np.mean(np.array(b) <= v)) for v in a + b)) < 1e-9
    assert abs(learning.ks(before, now, "moved").first()["ks"] - out["moved"]["statistic"]) < 1e-12
    one = learning.chi_square(before, now, "d").first()
    assert abs(one["chi_square"] - out["d"]["statistic"]) < 1e-9 and one["freedom"] == out["d"]["freedom"] == 1


def test_robust_scatter_where_the_plain_one_fails(spark):
    rng = np.random.default_rng(4)
    true = np.array([[2.0, 0.8, 0.0], [0.8, 1.0, 0.3], [0.0, 0.3, 0.5]])
    good, bad = rng.multivariate_normal([1, -2, 3], true, 1800), rng.multivariate_normal([14, 10, -9], 0.1 * np.eye(3), 200)
    x = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(np.concatenate([good, bad]))], "id long, x array<double>").repartition(4)
    _, mean, scatter = learning._sums(x, 3)
    centre, shape, distance = learning.robust_scatter(x, 3)
    assert np.abs(mean - [1, -2, 3]).max() > 1 and np.abs(scatter - true).max() > 5  # the plain form
    assert np.abs(centre - [1, -2, 3]).max() < 0.15 and np.abs(shape - true).max() < 0.5
    top = {r["id"] for r in x.withColumn("d", distance).orderBy(F.desc("d")).limit(200).collect()}
    assert top == set(range(1800, 2000))
    flat = spark.createDataFrame([([1.0, float(k % 5)],) for k in range(50)], "x array<double>")
    assert flat.withColumn("d", learning.robust_scatter(flat, 2)[2]).where("d IS NULL OR isnan(d)").count() == 0


def test_circular_transfers(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(1, 1, 2, 0, 1000), (2, 2, 1, 5, 950), (3, 2, 3, 1, 10), (4, 3, 1, 6, 1090), (5, 3, 1, 60, 1000), (6, 2, 1, 7, 880), (7, 1, 1, 2, 1000)]
    t = spark.createDataFrame([(i, s, r, t0 + timedelta(hours=h), float(a)) for i, s, r, h, a in rows], "transaction_id long, sender_id long, receiver_id long, ts timestamp, amount double").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    assert {tuple(r) for r in rules.circular_transfers(t, 2).collect()} == {(2, 1), (4, 2)}
