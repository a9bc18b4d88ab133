"""Quartiles and positions of a sender's history against a plain list of it, whole and in blocks of time, and on a sender of a million rows."""

import random
import time
from bisect import bisect_right, insort
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from ledgerlynx.operators import history

T0 = datetime(2024, 1, 1)


def plain(rows):
    """rows: (id, ts, amount, sender): id -> quartiles and position."""
    out = {}
    for sender in {r[3] for r in rows}:
        own, past, waiting = sorted((r for r in rows if r[3] == sender), key=lambda r: r[1]), [], []
        for k, (i, ts, amount, _) in enumerate(own):
            if k and ts > own[k - 1][1]:
                for a in waiting:
                    insort(past, a)
                waiting = []
            if past:
                q = [float(np.percentile(past, p)) for p in (25, 50, 75)]
                out[i] = (*q, 0.0 if amount is None else 100.0 * bisect_right(past, amount) / len(past))
            else:
                out[i] = (0.0,) * 4
            if amount is not None:
                waiting.append(amount)
    return out


def test_order_statistics(spark):
    rnd = random.Random(3)
    rows = [(k, T0 + timedelta(minutes=rnd.randrange(300)), rnd.choice([5.0, 7.25, float(rnd.randrange(50)), None if k % 9 == 0 else 1.0]), rnd.choice([1, 1, 1, 2, 3])) for k in range(400)] + [(900, T0, 4.0, 8)]
    t = spark.createDataFrame([(*r, "x") for r in rows], "transaction_id long, ts timestamp, amount double, sender_id long, note string").withColumn("amount", F.col("amount").cast("decimal(18,2)")).repartition(3)
    want = plain(rows)
    for block in (1_000_000, 40):
        found = history.order_statistics(t, block)
        assert found.columns == [*t.columns, "h_q25", "h_median", "h_q75", "h_position"]
        got = {r["transaction_id"]: (r["h_q25"], r["h_median"], r["h_q75"], r["h_position"]) for r in found.collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], atol=1e-9) for i in want)


def test_sender_of_a_million_rows():
    n = 1_000_000
    rnd = np.random.default_rng(5)
    us, value = np.arange(n, dtype=float), np.round(rnd.gamma(2, 500, n), 2)
    began = time.process_time()
    q1, q2, q3, position = history.history_order(us, value, np.empty(0), np.empty(0, np.int64))
    assert time.process_time() - began < 60
    for i in (1, 2, 77, 5_000, 999_999):
        assert np.allclose([q1[i], q2[i], q3[i]], np.percentile(value[:i], [25, 50, 75])) and np.isclose(position[i], 100 * (value[:i] <= value[i]).mean())
