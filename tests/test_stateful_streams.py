"""Streams with keyed state against their batch twins: rows out of order, late rows, several micro-batches, and a restart from the checkpoint."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerlynx.operators import cases, patterns
from ledgerlynx.streaming import stateful

T0 = datetime(2024, 3, 1)
TXN = "transaction_id long, ts timestamp, amount decimal(18,2), sender_id long, transaction_type string"
FAR = T0 + timedelta(days=400)


@pytest.fixture(scope="module", autouse=True)
def state(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    stateful.keyed_state(spark)
    yield
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def written(spark, folder, rows, schema, files):
    """rows in files, one micro-batch each; a row comes up to 50 minutes out of its turn."""
    rnd = random.Random(7)
    by_arrival = sorted(rows, key=lambda r: r[1] + timedelta(minutes=rnd.uniform(-50, 0)))
    size = -(-len(by_arrival) // files)
    for k in range(files):
        part = by_arrival[k * size : (k + 1) * size]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{k:03d}")
    return [f"{folder}/{k:03d}" for k in range(files)]


class Running:
    """A query over a folder that files are moved into; each run goes on where the last one stopped."""

    def __init__(self, spark, tmp, f, schema):
        self.spark, self.tmp, self.f, self.schema = spark, tmp, f, schema
        (tmp / "in").mkdir()

    def run(self, parts):
        for p in parts:
            for name in sorted((self.tmp / "made").joinpath(p.split("/")[-1]).glob("*.parquet")):
                name.rename(self.tmp / "in" / f"{p.split('/')[-1]}-{name.name}")
                self._once()

    def _once(self):
        source = self.spark.readStream.schema(self.schema).parquet(str(self.tmp / "in"))
        q = self.f(source).writeStream.format("parquet").option("path", str(self.tmp / "out")).option("checkpointLocation", str(self.tmp / "state")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None and not q.isActive

    def found(self):
        return sorted(map(tuple, self.spark.read.parquet(str(self.tmp / "out")).collect()))


def transactions(kinds):
    rnd = random.Random(4)
    rows = [(k, T0 + timedelta(minutes=rnd.randrange(0, 60 * 80), microseconds=rnd.randrange(5)), rnd.choice([100, 4999, 5000, 9000, 15000, 15001, 30000]), rnd.randrange(9), rnd.choice(kinds)) for k in range(260)]
    return rows + [(1000 + k, T0 + timedelta(hours=5), 100 + 9950 * k, 3, kinds[k % len(kinds)]) for k in range(3)]  # the same time


def on_time(rows):
    return [(*r[:2], float(r[2]), *r[3:]) for r in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, "transaction_id long, ts timestamp, amount double, sender_id long, transaction_type string").withColumn("amount", F.col("amount").cast("decimal(18,2)"))


@pytest.mark.parametrize("name", ["rising", "layering"])
def test_sequences_equal_the_batch_and_outlive_a_restart(spark, tmp_path, name):
    kinds = ["cash_deposit", "wire_transfer", "ach", "wire_transfer", "cash_withdrawal", "card_payment"]
    rows = on_time(transactions(kinds))
    batch, stream = {
        "rising": (patterns.rising_sequence, stateful.rising_sequence),
        "layering": (lambda t: patterns.layering_sequence(t, least=2), lambda t: stateful.layering_sequence(t, least=2)),
    }[name]
    want = sorted(tuple(str(x) if i in (1, 2, 3) and not (name == "layering" and i == 2) else x for i, x in enumerate(r)) for r in batch(frame(spark, rows)).collect())
    end = [(5000, FAR, 1.0, 77, "cash_deposit")]  # moves the watermark past everything
    parts = written(spark, str(tmp_path / "made"), rows, frame(spark, rows).schema.simpleString().replace("decimal(18,2)", "double"), 4)
    too_late = [(6000, T0 - timedelta(days=1), 100.0, 3, "cash_deposit"), (6001, T0 + timedelta(hours=1), 7000.0, 3, "wire_transfer"), (6002, T0 + timedelta(hours=2), 20000.0, 3, "cash_withdrawal")]
    for k, more in ((4, end), (5, too_late)):
        spark.createDataFrame(more, "transaction_id long, ts timestamp, amount double, sender_id long, transaction_type string").coalesce(1).write.parquet(str(tmp_path / "made" / f"{k:03d}"))
        parts.append(str(tmp_path / "made" / f"{k:03d}"))
    schema = spark.read.parquet(parts[0]).schema
    q = Running(spark, tmp_path, lambda t: stream(t.withColumn("amount", F.col("amount").cast("decimal(18,2)"))), schema)
    q.run(parts)  # each part is a run of its own: the state comes back from the checkpoint
    got = q.found()
    assert got == want and len(want) > 10


def test_state_is_evicted(spark, tmp_path):
    rows = on_time(transactions(["wire_transfer"]))
    (tmp_path / "made").mkdir()
    schema = "transaction_id long, ts timestamp, amount double, sender_id long, transaction_type string"
    for k, part in enumerate((rows, [(5000, FAR, 1.0, 77, "x")], [(5001, FAR + timedelta(days=9), 1.0, 78, "x")])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "made" / f"{k:03d}"))
    q = Running(spark, tmp_path, lambda t: stateful.rising_sequence(t.withColumn("amount", F.col("amount").cast("decimal(18,2)"))), spark.createDataFrame([], schema).schema)
    q.run([f"x/{k:03d}" for k in range(3)])
    held = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "rows").load()
    assert held.count() <= 1  # the last row alone may wait


def test_rows_of_a_batch_are_one_entry_of_the_state(spark, tmp_path):
    rows = [(k, T0 + timedelta(seconds=k), 100.0, k % 2, "wire_transfer") for k in range(400)]
    schema = "transaction_id long, ts timestamp, amount double, sender_id long, transaction_type string"
    for name, stream in (("s4", stateful.rising_sequence), ("s5", stateful.layering_sequence)):
        (tmp_path / name / "made").mkdir(parents=True)
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name / "made" / "000"))
        Running(spark, tmp_path / name, stream, spark.createDataFrame([], schema).schema).run(["x/000"])
        held = spark.read.format("statestore").option("path", str(tmp_path / name / "state")).option("stateVarName", "rows").load()
        assert held.count() == 2


def test_thresholds_equal_the_fold_and_outlive_a_restart(spark, tmp_path):
    rnd = random.Random(2)
    start = {"structuring": 9100.0, "high_value": 5400.0, "anomaly": 0.55}
    kinds = [["structuring_a"], ["high_value", "structuring"], ["high_value"], [], None, ["x"], ["high_value_b", "high_value"]]
    rows = [(rnd.choice("ab"), T0 + timedelta(minutes=10 * k), k, rnd.choice(["FP", "FN", "FN", "TP", None]), rnd.choice(kinds)) for k in range(120)]
    schema = "segment string, ts timestamp, place long, class string, patterns array<string>"
    parts = written(spark, str(tmp_path / "made"), rows, schema, 3)
    spark.createDataFrame([("z", FAR, 999, "TP", [])], schema).coalesce(1).write.parquet(str(tmp_path / "made" / "003"))
    q = Running(spark, tmp_path, lambda t: stateful.feedback_thresholds(t, start), spark.createDataFrame([], schema).schema)
    q.run([*parts, "x/003"])
    got = q.found()
    want = []
    for segment in "ab":
        own = cases.threshold_fold(spark.createDataFrame(rows, schema).where(F.col("segment") == segment), "place", start)
        want += [(segment, *r) for r in own.select("place", *cases.THRESHOLDS).collect()]
    assert [r[:2] for r in got] == [r[:2] for r in sorted(want)]
    assert all(abs(x - y) < 1e-9 for a, b in zip(got, sorted(want), strict=True) for x, y in zip(a[2:], b[2:], strict=True))
    assert len({r[2] for r in got}) > 3
