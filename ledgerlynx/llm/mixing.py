"""Mixing sources to target weights: fixed-length blocks of words, multinomial counts per output shard, permuted indices.

A document's size is its words, runs of characters other than spaces and \\t\\n\\v\\f\\r. Sources are numbered by code point (none
last) and weighted in turn; they share the size of all documents by weight, but no source gets more than `MOST` times its
own size: what it cannot use is shared again among the others by weight until none is above. That is a few sums over the
table of sources.

Each source's documents stand one after the other, in the order of a hash, and are cut into blocks of `BLOCK` words, the last
one shorter. A source's target is whole passes over its blocks and a part of one more; its last slot takes only the words
that are left of the target, so every source's taken words are its target rounded, and no block, so no document, comes more often than
`MOST` times. How many of a source's slots go to each output shard is drawn from a multinomial over the shards, by a
generator seeded with the source's number: totals of sources are exact, and the lengths of shards vary as a draw does.
In each pass a keyed Feistel permutation of the source's whole blocks decides which block a slot holds (a shorter last block
ends the pass), and another one shuffles the slots of a shard. No random keys are sorted and nothing is listed: blocks
and slots are joined by (source, block).

At scale: offsets of documents are running sums in `BUCKETS` buckets a source and the sums of the buckets before, so a source that
holds a third of all rows is dealt to many tasks; the join's key is a block of at most `BLOCK` words. Everything is a function of
the rows and the seed: reruns agree, whatever the partitioning.

Null and empty texts have size 0 and are taken 0 times. Null sources are one source, the last. Null ids are kept. Repeated rows are
documents of their own. Very long texts are as many blocks as they need. Empty tables give no rows. Further input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .training_order import permute

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS, MOST = (1, 2, 3), 3
#: Words of a block; slots of an output shard, on average; buckets that a source's documents are dealt to.
BLOCK, PER_SHARD, BUCKETS = 256, 4096, 1024
SEED = 20_240_229


def numbered(sources: DataFrame, column: str) -> DataFrame:
    """The rows with `number` from 0 in the order of a column, nulls last: by ranges, so that no task sorts them all."""
    order = F.col(column).asc_nulls_last()
    parts = materialise(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return parts.withColumn("nth", nth).join(F.broadcast(starts), "part").withColumn("number", F.col("start") + F.col("nth") - 1).drop("part", "nth", "start")


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, number, source_size, target: the shares of all sizes, by weight, of sources of which none exceeds `most` times its size."""
    sources = numbered(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    sources = materialise(sources.withColumn("weight", weight.cast("long")), "weighted-sources")
    total, left, weighing = 0, 0, 0
    first = sources.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w")).first()
    total, weighing = int(first["t"] or 0), int(first["w"] or 1)
    left = total
    while True:  # a source that is above its limit stays there, for the others' share only grows
        above = F.col("weight") * F.lit(left).cast("decimal(38,0)") > F.col("source_size") * F.lit(most * weighing).cast("decimal(38,0)")
        sums = sources.agg(F.sum(F.when(above, F.col("source_size") * most)).alias("taken"), F.sum(F.when(~above, F.col("weight"))).alias("w")).first()
        now = total - int(sums["taken"] or 0), int(sums["w"] or 1)
        if now == (left, weighing):
            break
        left, weighing = now
    share = F.col("weight") * F.lit(float(left)) / F.lit(float(weighing))
    return sources.select("source", "number", "source_size", F.when(above, (F.col("source_size") * most).cast("double")).otherwise(share).alias("target"))


_PLAN = "number long, shard long, first long, count long, whole long, blocks long, slots long, rest long"


def shard_counts(targets: DataFrame, block: int, per_shard: int, seed: int) -> DataFrame:
    """One row a source and output shard that has slots of it: the source's first slot there and how many, drawn from a multinomial."""
    wanted = F.round("target").cast("long")
    plan = targets.where("source_size > 0").select("number", wanted.alias("want"), F.col("source_size").alias("size"))
    plan = plan.selectExpr("number", f"size div {block} as whole", f"(size + {block - 1}) div {block} as blocks", "want div size as passes", "want % size as part")
    plan = plan.selectExpr("number", "whole", "blocks", f"passes * blocks + (part + {block - 1}) div {block} as slots", f"if(part = 0, {block}, (part - 1) % {block} + 1) as rest")
    plan = materialise(plan.where("slots > 0"), "slot-plan")
    slots = plan.agg(F.sum("slots")).first()[0] or 0
    n_shards = max(1, round(slots / per_shard))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        even = np.full(n_shards, 1 / n_shards)
        for batch in batches:
            for row in batch.itertuples():
                counts = np.random.default_rng([seed, int(row.number)]).multinomial(int(row.slots), even)
                shard = np.flatnonzero(counts)
                first = (np.cumsum(counts) - counts)[shard]
                yield pd.DataFrame({"number": row.number, "shard": shard, "first": first, "count": counts[shard], "whole": row.whole, "blocks": row.blocks, "slots": row.slots, "rest": row.rest})

    return materialise(plan.mapInPandas(draw, _PLAN), "shard-counts")


def slots_of(counts: DataFrame, block: int, seed: int) -> DataFrame:
    """number, block, shard, slot, most: the block that each slot of each output shard holds, and how many of its words."""
    shard = Window.partitionBy("shard")
    placed = counts.withColumns({"before": F.sum("count").over(shard.orderBy("number")) - F.col("count"), "in_shard": F.sum("count").over(shard)})

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                j = np.arange(row.first, row.first + row.count_of, dtype=np.int64)
                turn, at = j // row.blocks, j % row.blocks
                to = at.copy()  # a shorter last block ends a pass
                for k in np.unique(turn):
                    own = (turn == k) & (at < row.whole)
                    to[own] = permute(at[own], row.whole, _key(seed, row.number, int(k)))
                slot = permute(row.before + np.arange(len(j), dtype=np.int64), row.in_shard, _key(seed, -1, row.shard))
                yield pd.DataFrame({"number": row.number, "block": to, "shard": row.shard, "slot": slot, "most": np.where(j == row.slots - 1, row.rest, block)})

    columns = placed.select("number", "shard", "first", F.col("count").alias("count_of"), "whole", "blocks", "slots", "rest", "before", "in_shard")
    return columns.mapInPandas(fill, "number long, block long, shard long, slot long, most long")


def _key(seed: int, number: int, k: int) -> int:
    return hash((seed, int(number), int(k))) & 0xFFFFFFFFFFFFFFFF


def placed_documents(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """The rows with their source's number, size and target, and the place of their first word among their source's words."""
    known = targets.withColumnRenamed("source", "of")
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("bucket", F.pmod("hash", F.lit(BUCKETS)))
    sums = rows.groupBy("number", "bucket").agg(F.sum("size").alias("sum"))
    before = Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("number", "bucket", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("number", "bucket").orderBy("hash", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return rows.join(starts, ["number", "bucket"]).withColumn("offset", F.col("start") + F.col("within")).drop("bucket", "start", "within", "hash")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, per_shard: int = PER_SHARD, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows (row, id, source, size, source_size, target, shard, slot, at, start, length): `length` words of a document, from its word
    `start` on, stand from word `at` of a slot on. A document of which nothing is taken has one row without a slot."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.col(id_col), text).alias("hash"), F.monotonically_increasing_id().alias("row"),
    )
    rows = materialise(rows, "sizes")
    targets = materialise(source_targets(rows, weights, most), "targets")
    slots = slots_of(shard_counts(targets, block, per_shard, seed), block, seed)
    places = F.when(F.col("size") > 0, F.sequence(F.expr(f"offset div {block}"), F.expr(f"(offset + size - 1) div {block}")))
    pieces = placed_documents(rows, targets).select("*", F.explode_outer(places).alias("block"))
    # slots come out of a task that makes many rows of one, so Spark's guess of their size is far too small to broadcast by
    found = pieces.join(slots.hint("merge"), ["number", "block"], "left")
    begin, first = F.greatest(F.col("offset"), F.col("block") * block), F.col("block") * block
    end = F.least(F.col("offset") + F.col("size"), first + F.least("most", F.lit(block)))
    length = F.when(F.col("slot").isNotNull(), F.greatest(end - begin, F.lit(0))).otherwise(0)
    return found.select("row", "id", "source", "size", "source_size", "target", "shard", "slot", (begin - first).alias("at"), (begin - F.col("offset")).alias("start"), length.cast("long").alias("length"))


def taken(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a document: how many of its words the mix takes, repeats counted."""
    known = [F.first(c).alias(c) for c in ("id", "size", "source_size", "target")]
    return mixed.groupBy("row").agg(*known, F.sum("length").alias("taken")).select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def mixed_texts(mixed: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """shard, slot, source, text: the words of each slot, joined by one space. Ids must be unique."""
    words = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"({WORD})"), F.lit(1))
    own = docs.select(F.col(id_col).alias("id"), words.alias("words"))
    cut = F.array_join(F.slice("words", (F.col("start") + 1).cast("int"), F.col("length").cast("int")), " ")
    parts = mixed.where("length > 0").join(own, "id").groupBy("shard", "slot").agg(F.first("source").alias("source"), F.array_sort(F.collect_list(F.struct("at", cut.alias("cut")))).alias("cuts"))
    return parts.select("shard", "slot", "source", F.array_join(F.col("cuts.cut"), " ").alias("text"))
