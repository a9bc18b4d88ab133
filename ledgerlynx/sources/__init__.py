"""Reading and writing transactions, watchlists and versions of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import TRANSACTION


def load(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """IO1."""
    reader = spark.read.format(kind)
    return (reader.schema(schema) if schema else reader).load(path)


def load_json_array(spark: SparkSession, path: str, schema: str = TRANSACTION) -> DataFrame:
    """IO2."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def export(df: DataFrame, path: str) -> None:
    """IO3."""
    df.write.mode("overwrite").parquet(path)


def create_table(spark: SparkSession, path: str, schema: str = TRANSACTION) -> None:
    """IO4: version 0, empty."""
    spark.createDataFrame([], schema).write.mode("errorifexists").parquet(f"{path}/v=0")


def upsert(current: DataFrame, changes: DataFrame, key: str = "transaction_id") -> DataFrame:
    """IO5: matched rows are replaced whole, others added; fails if a key occurs twice among the changes."""
    once = changes.groupBy(key).agg(F.count("*").alias("n"), F.any_value(F.struct(*changes.columns)).alias("new"))
    new = once.select(key, F.when(F.col("n") == 1, F.col("new")).otherwise(F.raise_error(F.lit("two changes of one key"))).alias("new"))
    old = current.select(key, F.struct(*changes.columns).alias("old"))
    return old.join(new, key, "full_outer").select(F.coalesce("new", "old").alias("row")).select("row.*")


def versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    return sorted(int(f.getPath().getName()[2:]) for f in found if f.getPath().getName().startswith("v="))


def write_version(df: DataFrame, path: str) -> int:
    """A new snapshot beside those before it."""
    v = max(versions(df.sparkSession, path), default=-1) + 1
    df.write.mode("errorifexists").parquet(f"{path}/v={v}")
    return v


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """IO6: a version, by default the last."""
    return spark.read.parquet(f"{path}/v={versions(spark, path)[-1] if version is None else version}")


def flag_suspicious(df: DataFrame) -> DataFrame:
    """IO7."""
    return df.withColumn("risk_score", F.coalesce("risk_score", F.lit(0.0))).withColumn("is_suspicious", F.col("risk_score") > 0.7)


def write_monthly(df: DataFrame, path: str, rows: int = 1_000_000) -> None:
    """IO8: a folder a month. A month's rows are dealt by ranges of their order, so no task has a whole month; a file holds about `rows` rows at most, each in order."""
    order = ["month", "ts", "sender_id", "receiver_id"]
    dealt = df.withColumn("month", F.date_format("ts", "yyyyMM")).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.write.mode("append").option("maxRecordsPerFile", rows).partitionBy("month").parquet(path)


def _names(df: DataFrame, source: str, ref: Column, *names: Column) -> DataFrame:
    own = df.select(F.lit(source).alias("source"), F.concat_ws("-", F.lit(source), ref).alias("ref"), F.explode(F.array_compact(F.array(*names))).alias("name"))
    return own.select("source", "ref", F.lower(F.trim("name")).alias("name_norm")).where("name_norm <> ''").distinct()


def ofac_csv(spark: SparkSession, path: str) -> DataFrame:
    """IO9: columns id, name, type after a header."""
    d = spark.read.option("header", True).csv(path).toDF("id", "name", "type")
    return _names(d, "OFAC", F.col("id"), F.col("name"), F.concat(F.lit("sdn-"), "id"))


def un_xml(spark: SparkSession, path: str, tag: str = "INDIVIDUAL") -> DataFrame:
    """IO10: individuals have up to four names, entities one."""
    schema = "DATAID string, REFERENCE_NUMBER string, FIRST_NAME string, SECOND_NAME string, THIRD_NAME string, FOURTH_NAME string"
    d = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    parts = [F.nullif(F.trim(F.col(c)), F.lit("")) for c in ("FIRST_NAME", "SECOND_NAME", "THIRD_NAME", "FOURTH_NAME")]
    return _names(d, "UN", F.col("REFERENCE_NUMBER"), F.concat_ws(" ", *parts) if tag == "INDIVIDUAL" else parts[0])


def eu_xml(spark: SparkSession, path: str) -> DataFrame:
    """IO11: whole names, and first with last where both are present."""
    schema = "_euReferenceNumber string, nameAlias array<struct<_wholeName: string, _firstName: string, _lastName: string>>"
    d = spark.read.format("xml").option("rowTag", "sanctionEntity").schema(schema).load(path).select(F.col("_euReferenceNumber").alias("ref"), F.explode("nameAlias").alias("a"))
    first, last = F.nullif(F.trim("a._firstName"), F.lit("")), F.nullif(F.trim("a._lastName"), F.lit(""))
    return _names(d, "EU", F.col("ref"), F.col("a._wholeName"), F.when(first.isNotNull() & last.isNotNull(), F.concat_ws(" ", first, last)))


def eu_csv(spark: SparkSession, path: str) -> DataFrame:
    """IO12: cells of columns 2 to 5 that are longer than 3 characters and no address."""
    d = spark.read.option("sep", ";").option("header", True).csv(path)
    cells = [F.when((F.length(F.trim(F.col(f"`{c}`"))) > 3) & ~F.startswith(F.trim(F.col(f"`{c}`")), F.lit("http")), F.col(f"`{c}`")) for c in d.columns[1:5]]
    return _names(d, "EU", F.col(f"`{d.columns[0]}`"), *cells)


def union_lists(*lists: DataFrame) -> DataFrame:
    """IO13."""
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x)
    return out.distinct()


def accept(new: DataFrame, least: int = 100) -> bool:
    """IO14: a list replaces the last one only if it has more entries than `least`."""
    return new.limit(least + 1).count() > least


def route(alerts: DataFrame) -> DataFrame:
    """IO17: the topic of an alert by its priority."""
    p = F.col("priority")
    return alerts.withColumn("topic", F.when(p >= 0.8, "alerts-high").when(p >= 0.5, "alerts-medium").otherwise("alerts-low"))


def messages(df: DataFrame, key: str) -> DataFrame:
    """IO16: string keys and JSON values, for a message sink."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def parsed(messages: DataFrame, schema: str = TRANSACTION) -> DataFrame:
    """IO15: the records of a message source."""
    return messages.select(F.from_json(F.col("value").cast("string"), schema).alias("m")).select("m.*")


def handle_topics(handlers: dict):
    """IO18: a foreachBatch function that gives each handler the rows of its topic."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for topic, handler in handlers.items():
            handler(batch.where(F.col("topic") == topic), batch_id)
        batch.unpersist()

    return run
