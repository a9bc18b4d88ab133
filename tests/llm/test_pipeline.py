"""The pipeline's stages, each against its operator's brute-force form."""

import corpus_pipeline
from ledgerlynx.llm import pii, quality

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality rules"](spark, docs, SF)
    one = quality.measure()
    measured = {r["doc_id"]: one((r["text"] or "").encode()) for r in docs.collect()}
    limits = quality.fit_limits(spark.createDataFrame([(k, *m) for k, m in measured.items()], f"id long, {quality.MEASURED}"))
    assert {r["doc_id"] for r in good.collect()} == {k for k, m in measured.items() if quality.verdict(m[6], m[8], m[9], m[5], limits)[1]}
    shingles = {r["doc_id"]: {tuple(w[i : i + 5]) for w in [(r["text"] or "").encode().lower().split()] for i in range(max(1, len(w) - 4)) if w} for r in good.collect()}
    group = {k: k for k in shingles}
    for a in sorted(shingles):  # each document under the smallest one of its component
        for b in sorted(shingles):
            x, y = shingles[a], shingles[b]
            if a < b and x and y and group[a] != group[b] and 100 * len(x & y) >= 75 * len(x | y):
                low, high = sorted((group[a], group[b]))
                group = {k: low if v == high else v for k, v in group.items()}
    single = stages["n-gram Jaccard join"](spark, good, SF)
    assert single.columns == docs.columns or set(single.columns) == set(docs.columns)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(k for k, v in group.items() if k == v)
    clean = stages["personal data"](spark, single, SF)
    assert set(clean.columns) == set(docs.columns)
    assert not any(s.base for r in clean.collect() for s in pii.matches(r["text"]))
    packed = stages["best-fit packing"](spark, clean, SF)
    assert packed.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048
    assert packed.select("doc_id").distinct().count() == clean.count()
