"""Similarity search over embedding arrays."""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 5, same: str | None = None, most_queries: int = 10_000) -> DataFrame:
    """The k best by cosine for each query, except itself; `same` names a column that must agree.

    The queries meet all vectors; above `most_queries` rows they are broadcast in blocks by a hash, of half as many on average."""
    n = queries.count()
    if n > most_queries:
        blocks = -(-2 * n // most_queries)
        block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
        return reduce(DataFrame.unionByName, [_nearest(queries.where(block == b), vectors, k, same) for b in range(blocks)])
    return _nearest(queries, vectors, k, same)


def _nearest(queries: DataFrame, vectors: DataFrame, k: int, same: str | None) -> DataFrame:
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.sqrt(dot(F.col("embedding"), F.col("embedding"))).alias("nq"), *([F.col(same).alias("q_same")] if same else []))
    v = vectors.withColumn("nv", F.sqrt(dot(F.col("embedding"), F.col("embedding"))))
    on = F.col("vec_id") != F.col("query_id")
    if same:
        on = on & (F.col(same) == F.col("q_same"))
    found = v.join(F.broadcast(q), on).withColumn("similarity", dot(F.col("q"), F.col("embedding")) / (F.col("nq") * F.col("nv")))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query_id", "vec_id", "similarity", "place")


def _classes(vectors: DataFrame) -> DataFrame:
    """vec_id, first: equal vectors share the smallest id of theirs, with its vector and their number. Vectors with missing components take no part."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x))")
    same = v.groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    return cut(v.join(same, "v").select("vec_id", "first", "n", F.when(F.col("vec_id") == F.col("first"), F.col("v")).alias("v")))


def _meets(ratio: float) -> float:
    """How likely one projection puts two vectors into one bucket that is `ratio` times as wide as the deviation of their difference."""
    return 1 - 2 * NormalDist().cdf(-ratio) - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-ratio * ratio / 2))


def _keys(reps: DataFrame, distance: float, recall: float) -> DataFrame:
    """vec_id, key: one key a table, a hash of the buckets that several random projections put the vector into.

    A table has so many projections that two vectors of usual distance (by the variance of all) share a key once in eight times as many tries as there are
    vectors, and there are so many tables that two at `distance` share one with the probability `recall`, nearer ones more often.
    Keys so grow little faster than the vectors, and a key holds few that are not near, however many vectors there are."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    n, variance = reps.agg(F.count("*"), vector_to_array(Summarizer.variance(array_to_vector("v")))).first()
    if not n or not variance:
        return reps.select("vec_id", F.lit(0).cast("long").alias("key"))
    wide = 6.0  # buckets in deviations of a difference of length `distance`
    spread = max(math.sqrt(2 * sum(variance)), distance)
    near, usual = _meets(wide), _meets(wide * distance / spread)
    joint = max(1, min(math.ceil(math.log(8 * n) / -math.log(usual)), int(math.log(400) / -math.log(near))))
    tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**joint)))
    dim, width = len(variance), wide * distance / math.sqrt(len(variance))

    def keyed(batches):
        for batch in batches:
            x = np.stack(batch["v"].to_numpy())
            for t in range(tables):
                rnd = np.random.default_rng((7, t))
                along = rnd.standard_normal((dim, joint)) / math.sqrt(dim)
                bucket = np.floor(x @ along / width + rnd.random(joint)).astype(np.int64)
                mixed = (bucket * rnd.integers(-(2**62), 2**62, joint)).sum(axis=1) + rnd.integers(-(2**62), 2**62)  # wraps
                yield pd.DataFrame({"vec_id": batch["vec_id"], "key": mixed})

    kind = dict(reps.dtypes)["vec_id"]
    return reps.select("vec_id", "v").mapInPandas(keyed, f"vec_id {kind}, key long")


def _within(candidates: DataFrame, reps: DataFrame, distance: float) -> DataFrame:
    """The pairs a, b nearer than the distance."""
    square = F.aggregate(F.zip_with("x", "y", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    both = candidates.distinct().join(reps.select(F.col("vec_id").alias("a"), F.col("v").alias("x")), "a").join(reps.select(F.col("vec_id").alias("b"), F.col("v").alias("y")), "b")
    return both.select("a", "b", F.sqrt(square).alias("distance")).where(F.col("distance") < distance)


def approximate(vectors: DataFrame, distance: float, recall: float = 0.95) -> DataFrame:
    """Pairs a, b nearer than a distance, by random projections: each between the smallest ids of two different vectors, and of these ids with those of
    equal vectors, at distance 0. A pair at just the distance is found with the probability `recall`, a nearer one more surely; none that is not near comes."""
    own = _classes(vectors)
    reps = own.where("v IS NOT NULL")
    keys = cut(_keys(reps, distance, recall))
    met = keys.toDF("a", "key").join(keys.toDF("b", "key"), "key").where("a < b").select("a", "b")
    copies = own.where("vec_id <> first").select(F.col("first").alias("a"), F.col("vec_id").alias("b"), F.lit(0.0).alias("distance"))
    return _within(met, reps, distance).unionByName(copies)


def near_counts(queries: DataFrame, vectors: DataFrame, distance: float, recall: float = 0.95) -> DataFrame:
    """For each query, a row of the vectors, how many others are nearer than the distance: query_id, n_near. Found as in `approximate`; equal vectors
    are counted, not listed."""
    own = _classes(vectors)
    reps = own.where("v IS NOT NULL")
    asked = cut(own.join(queries.select("vec_id"), "vec_id", "left_semi").select("vec_id", "first", "n"))
    keys = cut(_keys(reps, distance, recall))
    first = asked.select(F.col("first").alias("vec_id")).distinct()
    met = keys.join(first, "vec_id", "left_semi").toDF("a", "key").join(keys.toDF("b", "key"), "key").where("a <> b").select("a", "b")
    others = _within(met, reps, distance).join(reps.select(F.col("vec_id").alias("b"), "n"), "b").groupBy(F.col("a").alias("first")).agg(F.sum("n").alias("others"))
    return asked.join(others, "first", "left").select(F.col("vec_id").alias("query_id"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"))


def transaction_text(t: DataFrame) -> DataFrame:
    """N1."""
    return t.withColumn("text", F.concat_ws(" ", F.lit("Transaction"), F.col("transaction_id").cast("string"), F.lit("of"), F.col("amount").cast("string"), "currency", F.lit("by"), "transaction_type", F.lit("from"), "country_origin", F.lit("to"), "country_destination"))


def alert_text(alerts: DataFrame, attached: DataFrame, shown: int = 5) -> DataFrame:
    """Alerts with a text of their type, level, patterns, first transactions and priority. attached: alert_id and the transactions' columns.
    An alert's transactions are cut to the first ones by time before they are gathered."""
    first = attached.withColumn("place", F.row_number().over(Window.partitionBy("alert_id").orderBy("ts", "transaction_id"))).where(F.col("place") <= shown)
    line = F.concat_ws(" ", F.col("amount").cast("string"), "currency", F.lit("from"), F.col("sender_id").cast("string"), F.lit("to"), F.col("receiver_id").cast("string"))
    lines = first.groupBy("alert_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda r: r["line"]), "; ").alias("lines"))
    text = F.concat(
        F.lit("Alert "), "alert_id", F.lit(" of type "), "alert_type", F.lit(" at level "), "risk_level", F.lit(". Patterns: "), F.array_join("patterns", ", "),
        F.lit(". Transactions: "), F.coalesce("lines", F.lit("none")), F.lit(". Priority: "), F.format_string("%.2f", F.col("priority").cast("double")),
    )
    return alerts.join(lines, "alert_id", "left").withColumn("text", text).drop("lines")
