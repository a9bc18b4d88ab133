"""Similarity search with more queries than one broadcast takes."""

import random

from ledgerlynx.operators import similarity as N


def test_recall_of_approximate_pairs(spark):
    rnd = random.Random(2)
    base = [[rnd.gauss(0, 0.125) for _ in range(64)] for _ in range(150)]
    near = [[v + rnd.gauss(0, 0.03) for v in b] for b in base]
    rows = [(k, v) for k, v in enumerate(base + near)]
    got = {(r["a"], r["b"]) for r in N.approximate(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.35).collect()}
    want = {(a, b) for a, x in rows for b, y in rows if a < b and sum((p - q) ** 2 for p, q in zip(x, y, strict=True)) <= 0.35**2}
    assert len(want) >= 140 and got <= want and len(got) >= 0.9 * len(want)


def test_equal_vectors_are_members_and_counted(spark):
    rnd = random.Random(5)
    base = [[rnd.gauss(0, 0.125) for _ in range(64)] for _ in range(40)]
    rows = [(k, base[k % 40]) for k in range(240)] + [(240 + k, [x + 0.001 for x in base[k]]) for k in range(40)]
    e = spark.createDataFrame([*rows, (900, None)], "vec_id long, embedding array<double>")
    got = sorted((r["a"], r["b"], round(r["distance"], 6)) for r in N.approximate(e, 0.35).collect())
    assert got == sorted([(k % 40, k, 0.0) for k in range(40, 240)] + [(k, 240 + k, 0.008) for k in range(40)])
    near = N.near_counts(e.where("vec_id % 50 = 0"), e, 0.35).collect()
    assert sorted(map(tuple, near)) == [(0, 6), (50, 6), (100, 6), (150, 6), (200, 6), (250, 6)]


def test_keys_hold_few_vectors_that_are_not_near(spark):
    rnd = random.Random(6)
    rows = [(k, [rnd.gauss(0, 0.125) for _ in range(64)]) for k in range(1500)]
    keys = N._keys(spark.createDataFrame(rows, "vec_id long, v array<double>"), 0.35, 0.95).groupBy("key").count().selectExpr("sum(count * (count - 1) / 2)").first()[0]
    assert keys < 20 * 1500  # of 1.1 million pairs


def test_nearest_in_blocks(spark):
    rnd = random.Random(4)
    rows = [(k, [rnd.random() for _ in range(4)], k % 2) for k in range(60)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = sorted(map(tuple, N.nearest(e, e, 3, "label").collect()))
    assert len(want) == 180 and sorted(map(tuple, N.nearest(e, e, 3, "label", most_queries=15).collect())) == want
