"""Streaming operators against the same operators on a batch; sources and sinks by round trips."""

from datetime import datetime, timedelta

import pytest

from ledgerlynx import sources, streaming
from ledgerlynx.operators import messages

T0 = datetime(2024, 1, 1)
SCHEMA = "transaction_id long, ts timestamp, amount double, sender_id long, receiver_id long"


@pytest.fixture(scope="module")
def batch(spark, tmp_path_factory):
    rows = [(k, T0 + timedelta(minutes=7 * (k * 37 % 400)), float(100 + k * 53 % 9000), k % 5, k % 3) for k in range(400)]
    rows += rows[:20]  # repeated rows
    rows.append((9999, T0 + timedelta(days=60), 5.0, 99, 99))  # closes all windows
    folder = str(tmp_path_factory.mktemp("stream"))
    spark.createDataFrame(rows, SCHEMA).selectExpr("transaction_id", "ts", "cast(amount as decimal(18,2)) amount", "sender_id", "receiver_id").repartition(3).write.mode("overwrite").parquet(folder)
    return folder


def streamed(spark, folder, f, name):
    source = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    q = f(source).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    return spark.table(name)


@pytest.mark.parametrize("name", ["structuring", "bursts"])
def test_windows_equal_the_batch(spark, batch, name):
    f = {"structuring": streaming.structuring, "bursts": lambda t: streaming.bursts(t, gap="40 minutes")}[name]
    want = f(spark.read.parquet(batch)).where("sender_id <> 99")
    got = streamed(spark, batch, f, f"s_{name}")
    columns = [c for c in want.columns if c != "ids"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect())) and want.count() > 0


def test_once(spark, batch):
    got = streamed(spark, batch, streaming.once, "s_once")
    assert got.count() == spark.read.parquet(batch).select("transaction_id").distinct().count()


def test_versions_and_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    sources.create_table(spark, path, "transaction_id long, amount int")
    first = spark.createDataFrame([(1, 10), (2, 20)], "transaction_id long, amount int")
    assert sources.write_version(first, path) == 1
    after = sources.upsert(sources.read_version(spark, path), spark.createDataFrame([(2, 21), (3, 30)], "transaction_id long, amount int"))
    assert sources.write_version(after, path) == 2
    assert sorted(map(tuple, sources.read_version(spark, path).collect())) == [(1, 10), (2, 21), (3, 30)]
    assert sources.read_version(spark, path, 0).count() == 0 and sources.read_version(spark, path, 1).count() == 2
    with pytest.raises(Exception, match="two changes"):
        sources.upsert(first, first.union(first)).collect()


def test_watchlists(spark, tmp_path):
    (tmp_path / "ofac.csv").write_text("id,name,type\n7,Jane DOE,individual\n8, ,entity\n")
    assert {r["name_norm"] for r in sources.ofac_csv(spark, str(tmp_path / "ofac.csv")).collect()} == {"jane doe", "sdn-7", "sdn-8"}
    (tmp_path / "un.xml").write_text("<L><INDIVIDUAL><REFERENCE_NUMBER>R1</REFERENCE_NUMBER><FIRST_NAME>Ann</FIRST_NAME><SECOND_NAME>Bee</SECOND_NAME></INDIVIDUAL></L>")
    assert [tuple(r) for r in sources.un_xml(spark, str(tmp_path / "un.xml")).collect()] == [("UN", "UN-R1", "ann bee")]
    (tmp_path / "eu.csv").write_text("ref;a;b;c;d\nE1;Long Name;http://x;abc;Other Name\n")
    assert {r["name_norm"] for r in sources.eu_csv(spark, str(tmp_path / "eu.csv")).collect()} == {"long name", "other name"}
    assert not sources.accept(spark.range(100)) and sources.accept(spark.range(101))


def test_messages_round_trip(spark):
    t = spark.createDataFrame([("a", "x")], "transaction_id string, description string")
    assert sources.parsed(sources.messages(t, "transaction_id")).first()["description"] == "x"


def test_card_messages():
    assert messages.card_message("0100" + f"{1 << 62 | 1 << 60:016X}" + "04" + "1234" + "000000001500") == ("0100", {2: "1234", 4: "000000001500"}, None)
    assert messages.card_message("bad")[2] and messages.card_message(None)[2]
