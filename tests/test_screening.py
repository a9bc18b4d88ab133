"""Screening of names that share no word with the list as it is written."""

from ledgerlynx.operators import screening as S


def test_names_misspelled_in_every_word_and_in_capitals(spark, monkeypatch):
    watch = spark.createDataFrame([("OFAC", "osama lorrimer"), ("UN", "viktor petrenko"), ("UN", "jane marlowe")], "source string, name_norm string")
    names = spark.createDataFrame([("OSAMA LORRIMER",), ("viktr petrenco",), ("jane marlow",), ("qqq zzz",), (None,)], "name string")
    for most in (S.MOST_LISTED, 1):
        monkeypatch.setattr(S, "MOST_LISTED", most)
        pairs = {(r["name"], r["name_norm"]) for r in S.candidates(names, watch).collect()}
        alone = {(n, w) for n in ("viktr petrenco", "qqq zzz") for w in ("osama lorrimer", "viktor petrenko", "jane marlowe")}
        assert pairs == alone | {("OSAMA LORRIMER", "osama lorrimer"), ("jane marlow", "jane marlowe")}
        hits = {r["name"]: (r["name_norm"], r["score"]) for r in S.screen(names, watch).collect()}
        assert hits["OSAMA LORRIMER"] == ("osama lorrimer", 100.0) and hits["viktr petrenco"][0] == "viktor petrenko" and "qqq zzz" not in hits


def test_wire_fields_are_searched_once(spark):
    from pyspark.sql import functions as F

    from ledgerlynx.operators import messages as M

    d = spark.createDataFrame([(":20:A\n:59:/X\n:20:B \n",), ("none",)], "m string").select(M.swift_fields(F.col("m")).alias("f"))
    assert [r["f"] for r in d.collect()] == [{"20": "B", "59": "/X"}, {}]
    assert d._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 2
