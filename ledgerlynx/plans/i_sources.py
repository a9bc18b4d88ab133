"""IO3 to IO16 and U1 over the driver's tables. What is read was written from them first, in the shared folder, in the layout that the source asks for."""

import uuid

from pyspark.sql import functions as F

from .. import sources as IO
from ..operators.registry import Detector, Registry
from ..shared import shared_folder
from .bindings import query, table, txn

#: Rows of a written XML file. A file with one row tag is read by one task, however large it is.
XML_ROWS = 100_000


def scratch(spark) -> str:
    return f"{shared_folder(spark)}/io/{uuid.uuid4().hex}"


@query("io3_export", "txn", "SELECT transaction_id, amount::DOUBLE AS amount FROM txn")
def io3(spark, sf):
    path, t = scratch(spark), txn(spark, sf).select("transaction_id", F.col("amount").cast("double").alias("amount"))
    IO.export(t.limit(0), path)  # the second export takes its place
    IO.export(t, path)
    return IO.load(spark, path)


@query("io4_io6_versions", "txn", "SELECT 0 AS version, 0::BIGINT AS n UNION ALL SELECT 1, count(*) FILTER (amount < 9000) FROM txn UNION ALL SELECT 2, count(*) FROM txn UNION ALL SELECT 3, count(*) FROM txn")
def io6(spark, sf):
    path, t = scratch(spark), txn(spark, sf).select("transaction_id", "amount")
    IO.create_table(spark, path, "transaction_id long, amount decimal(18,2)")
    IO.write_version(t.where("amount < 9000"), path)
    IO.write_version(IO.upsert(IO.read_version(spark, path), t.where("amount >= 9000")), path)
    # each version counted; 3 stands for the last one, asked for without a number
    out = None
    for v, asked in ((0, 0), (1, 1), (2, 2), (3, None)):
        one = IO.read_version(spark, path, asked).agg(F.lit(v).alias("version"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("io8_monthly_tables", "txn", "SELECT strftime(ts, '%Y%m') AS month, count(*) AS n, sum(amount)::DOUBLE AS total FROM txn GROUP BY 1")
def io8(spark, sf):
    path = scratch(spark)
    IO.write_monthly(txn(spark, sf), path)
    return IO.load(spark, path).groupBy(F.col("month").cast("string").alias("month")).agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"))


@query("io9_list_csv", "", "SELECT 'OFAC' AS source, 'OFAC-' || p_partkey AS ref, lower(trim(p_name)) AS name_norm FROM part UNION SELECT 'OFAC', 'OFAC-' || p_partkey, 'sdn-' || p_partkey FROM part")
def io9(spark, sf):
    path = scratch(spark)
    table(spark, sf, "part").select("p_partkey", F.upper("p_name"), "p_type").write.option("header", True).csv(path)
    return IO.ofac_csv(spark, path)


@query("io10_list_xml_un", "", "SELECT DISTINCT 'UN' AS source, 'UN-' || p_partkey AS ref, lower(concat_ws(' ', p_brand, CASE WHEN p_partkey % 3 <> 0 THEN p_name END, p_type)) AS name_norm FROM part")
def io10(spark, sf):
    path, k = scratch(spark), F.col("p_partkey")
    rows = table(spark, sf, "part").select(k.alias("DATAID"), k.alias("REFERENCE_NUMBER"), F.col("p_brand").alias("FIRST_NAME"), F.when(k % 3 != 0, F.col("p_name")).alias("SECOND_NAME"), F.col("p_type").alias("FOURTH_NAME"))
    rows.write.format("xml").option("maxRecordsPerFile", XML_ROWS).option("rowTag", "INDIVIDUAL").option("rootTag", "INDIVIDUALS").save(path)
    return IO.un_xml(spark, path)


@query("io11_list_xml_eu", "", """
SELECT 'EU' AS source, 'EU-' || p_partkey AS ref, lower(p_name) AS name_norm FROM part UNION SELECT 'EU', 'EU-' || p_partkey, lower(p_brand || ' ' || p_type) FROM part WHERE p_partkey % 3 <> 0""")  # fmt: skip
def io11(spark, sf):
    path, k = scratch(spark), F.col("p_partkey")
    alias = F.struct(F.col("p_name").alias("_wholeName"), F.col("p_brand").alias("_firstName"), F.when(k % 3 != 0, F.col("p_type")).alias("_lastName"))
    rows = table(spark, sf, "part").select(k.cast("string").alias("_euReferenceNumber"), F.array(alias).alias("nameAlias"))
    rows.write.format("xml").option("maxRecordsPerFile", XML_ROWS).option("rowTag", "sanctionEntity").option("rootTag", "export").save(path)
    return IO.eu_xml(spark, path)


@query("io12_list_cells", "", "SELECT DISTINCT 'EU' AS source, 'EU-' || p_partkey AS ref, lower(trim(name)) AS name_norm FROM (SELECT p_partkey, unnest([p_name, p_brand]) AS name FROM part) WHERE length(trim(name)) > 3")
def io12(spark, sf):
    path = scratch(spark)
    rows = table(spark, sf, "part").select("p_partkey", "p_name", F.lit("abc").alias("short"), "p_brand", F.lit("http://list.example").alias("address"), F.col("p_type").alias("beyond"))
    rows.write.option("header", True).option("sep", ";").csv(path)
    return IO.eu_csv(spark, path)


@query("io15_io16_messages", "txn", "SELECT transaction_id::VARCHAR AS transaction_id, amount::DOUBLE AS amount, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, sender_id::VARCHAR AS sender_id, risk_score FROM txn")
def io15(spark, sf):
    out = IO.parsed(IO.messages(txn(spark, sf), "transaction_id"))
    return out.select("transaction_id", F.col("amount").cast("double").alias("amount"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "sender_id", "risk_score")


def finding(suspicious, risk):
    none = F.array().cast("array<string>")
    return lambda t, seen: t.select("transaction_id", suspicious.alias("suspicious"), F.lit(0.9).alias("confidence"), F.lit(risk).alias("risk_score"), none.alias("findings"), none.alias("patterns"))


def after_the_others(t, seen):
    """How many detectors before this one found the transaction suspicious."""
    n = seen.groupBy("transaction_id").agg(F.count_if("suspicious").alias("n"))
    return finding(F.col("n") >= 2, 0.8)(t.join(n, "transaction_id"), None)


@query("u1_registered_detectors", "txn", """
d AS (SELECT transaction_id, amount >= 9000 AS large, country_origin <> country_destination AS abroad FROM txn)
SELECT transaction_id, 'large' AS detector, large AS suspicious FROM d UNION ALL SELECT transaction_id, 'abroad', abroad FROM d UNION ALL SELECT transaction_id, 'both', large AND abroad FROM d""")  # fmt: skip
def u1(spark, sf):
    r = Registry()
    r.register(Detector("both", after_the_others, deferred=True))
    r.register(Detector("large", finding(F.col("amount") >= 9000, 0.6)))
    r.register(Detector("broken", finding(F.col("no such column") > 0, 0.1)))  # left out, and named in failures
    r.register(Detector("silent", finding(F.lit(True), 1.0)))
    r.register(Detector("abroad", finding(F.col("country_origin") != F.col("country_destination"), 0.5)), 0)
    r.switch("silent", False)
    return r.run(txn(spark, sf)).select("transaction_id", "detector", "suspicious")
