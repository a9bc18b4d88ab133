"""Round trips of sources, and the sink that holds each micro-batch once whatever fails."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerlynx import sources, streaming
from ledgerlynx.streaming.sinks import OnceSink

T0 = datetime(2024, 1, 31, 23, 30)


def test_json_array(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"transaction_id": "t1", "amount": 12.5, "ts": "2024-01-01T10:00:00"},\n {"transaction_id": "t2", "sender_id": "s"}]')
    rows = sorted(sources.load_json_array(spark, str(tmp_path / "a.json")).select("transaction_id", F.col("amount").cast("double"), "sender_id").collect())
    assert list(map(tuple, rows)) == [("t1", 12.5, None), ("t2", None, "s")]


def test_export_and_load(spark, tmp_path):
    df = spark.range(7).withColumn("x", F.col("id") * 2)
    for _ in range(2):  # over an older export
        sources.export(df, str(tmp_path / "e"))
    assert sorted(map(tuple, sources.load(spark, str(tmp_path / "e")).collect())) == [(k, 2 * k) for k in range(7)]


def test_monthly_partitions(spark, tmp_path):
    rows = [(1, T0, 5, 6), (2, datetime(2024, 2, 1), 4, 6), (3, datetime(2024, 2, 9), 3, 6)]
    sources.write_monthly(spark.createDataFrame(rows, "transaction_id long, ts timestamp, sender_id long, receiver_id long"), str(tmp_path / "m"))
    assert sorted(p.name for p in (tmp_path / "m").glob("month=*")) == ["month=202401", "month=202402"]
    back = spark.read.parquet(str(tmp_path / "m"))
    assert sorted((r["transaction_id"], r["month"]) for r in back.collect()) == [(1, 202401), (2, 202402), (3, 202402)]


def test_eu_names(spark, tmp_path):
    xml = '<export><sanctionEntity euReferenceNumber="E.1"><nameAlias wholeName="Whole Name" firstName="First" lastName="Last"/><nameAlias wholeName="" firstName="Only" lastName=""/></sanctionEntity></export>'
    (tmp_path / "eu.xml").write_text(xml)
    assert {(r["ref"], r["name_norm"]) for r in sources.eu_xml(spark, str(tmp_path / "eu.xml")).collect()} == {("EU-E.1", "whole name"), ("EU-E.1", "first last")}


def test_topics_go_to_their_handlers(spark):
    seen = {}
    run = sources.handle_topics({"a": lambda d, k: seen.update(a=(k, d.count())), "b": lambda d, k: seen.update(b=(k, d.count()))})
    run(spark.createDataFrame([("a",), ("a",), ("c",)], "topic string"), 4)
    assert seen == {"a": (4, 2), "b": (4, 0)}


class Failing(OnceSink):
    """Fails once at a step of the batch with an id."""

    def __init__(self, folder, batch_id, after_commit):
        super().__init__(folder)
        self.batch_id, self.after_commit = batch_id, after_commit

    def commit(self, spark, batch_id, attempt):
        fails = batch_id == self.batch_id
        if fails:
            self.batch_id = None
        if fails and not self.after_commit:
            raise OSError("killed between write and commit")
        super().commit(spark, batch_id, attempt)
        if fails:
            raise OSError("killed after the commit")


@pytest.mark.parametrize("after_commit", [False, True])
def test_each_batch_is_held_once(spark, tmp_path, after_commit):
    (tmp_path / "in").mkdir()
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    sink = Failing(str(tmp_path / "sink"), 1, after_commit)

    def run():
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(90)
        return q

    with pytest.raises(Exception, match="killed"):
        run()
    schema = spark.range(1).schema
    assert sink.read(spark, schema).count() == (20 if after_commit else 10)
    run()
    assert sorted(r["id"] for r in sink.read(spark, schema).collect()) == list(range(30))
    assert sink.read(spark, schema, up_to=0).count() == 10 and sorted(sink.commits(spark)) == [0, 1, 2]
    assert sink.clear(spark) == (0 if after_commit else 1) and sink.read(spark, schema).count() == 30
    sink(spark.range(5), 2)  # a batch that comes again writes nothing
    assert sink.read(spark, schema).count() == 30


def test_windows_of_a_day_and_live_figures(spark):
    rows = [(k, datetime(2024, 1, 1, 10, k % 50), 9500.0 + k % 3, k % 4, 7, k % 2 == 0, 0.5) for k in range(24)] + [(100, datetime(2024, 1, 3), 10.0, 1, 8, False, 0.1)]
    t = spark.createDataFrame(rows, "transaction_id long, ts timestamp, amount double, sender_id long, receiver_id long, is_suspicious boolean, risk_score double").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    assert [(r["receiver_id"], r["n"]) for r in streaming.smurfing(t).collect()] == [(7, 24)]
    live = streaming.live(t, every="1 day").orderBy("w").collect()
    assert [(r["n"], r["alerts"]) for r in live] == [(24, 12), (1, 0)] and abs(live[0]["risk"] - 0.5) < 1e-9
    alerts = spark.createDataFrame([(3, datetime(2024, 1, 1, 10, 40)), (4, datetime(2024, 1, 1, 13))], "alert_transaction_id long, alert_ts timestamp")
    assert [r["transaction_id"] for r in streaming.with_alerts(t, alerts).collect()] == [3]


def test_a_month_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(4_000).selectExpr("id AS transaction_id", "timestamp_seconds(1704067200 + id) AS ts", "id % 7 AS sender_id", "id % 5 AS receiver_id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together again
    try:
        sources.write_monthly(rows, str(tmp_path / "m"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = spark.read.parquet(str(tmp_path / "m")).groupBy(F.input_file_name()).agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b")).orderBy("a").collect()
    assert sum(r["n"] for r in files) == 4_000 and max(r["n"] for r in files) < 2_000
    assert all(x["b"] <= y["a"] for x, y in zip(files, files[1:], strict=False))


def test_lists_in_xml_are_files_of_bounded_rows(spark, tmp_path, monkeypatch):
    from ledgerlynx.plans import i_sources

    spark.range(250).selectExpr("id AS p_partkey", "concat('Name ', id) AS p_name", "concat('Type ', id) AS p_type", "concat('Brand ', id) AS p_brand").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    monkeypatch.setattr(i_sources, "XML_ROWS", 50, raising=False)
    for made, n in ((i_sources.io10, 250), (i_sources.io11, 250 + 166)):
        found = made(spark, str(tmp_path))
        assert found.count() == n and len(found.inputFiles()) == 5
