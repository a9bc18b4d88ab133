"""Sharding: minimax contiguous partition of groups of equal texts, with DataFrame functions only.

The groups (equal texts; null counts as empty) stand in the order of a 64-bit hash of their text.
A binary search finds the smallest capacity for which a greedy pass over the ordered group sizes
needs at most `n_shards` shards, and the cuts go where that pass makes them. No group is ever split.

At scale the group sizes cannot come to the driver, so the search runs over *cells*: ranges of the
hash with their summed sizes. A cell that holds one group is atomic. Two greedy passes bound the
answer, one that cuts at cell borders only and one that may cut anywhere in a cell that is not
atomic; cells where a cut may fall are then split 256-fold by one grouped job, until every such
cell is atomic and both bounds are the exact answer. A round splits at most about n_shards ** 2
cells, whatever the input's size, so what comes to the driver is bounded.

Slots number the rows of a shard from 0: rows are dealt to `blocks` blocks a shard, blocks start at
the running sum of the block counts, and a window numbers the rows of each block. A group of copies
is thus numbered by many tasks, however large it is.

Empty tables give no rows. Repeated rows are separate rows with slots of their own. Null ids are kept.
Further input columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Bits of the hash in the first cells, and by how many a split lengthens them.
FIRST_BITS, STEP_BITS = 14, 8


class Cell(NamedTuple):
    first: int  # lowest hash of its range
    bits: int
    size: int
    atomic: bool


def cells_of(rows: DataFrame, bits: int) -> list[Cell]:
    """Cells of `bits` leading bits with the sizes in them; only counts and sums are shuffled."""
    prefix = F.shiftright("group_key", 64 - bits)
    found = rows.groupBy(prefix.alias("prefix")).agg(F.sum("size").alias("size"), F.min("group_key").alias("a"), F.max("group_key").alias("b"))
    return [Cell(r["prefix"] << (64 - bits), bits, r["size"], r["a"] == r["b"]) for r in found.collect()]


class Greedy:
    """Greedy passes over ordered cells."""

    def __init__(self, cells: list[Cell], n_shards: int):
        self.cells, self.n = cells, n_shards
        self.ends = list(accumulate(c.size for c in cells))
        self.total = self.ends[-1]

    def cuts(self, capacity: int, within: bool) -> list[int]:
        """Where each shard ends. within: a cut may fall inside a cell that is not atomic."""
        at, out = 0, []
        for _ in range(self.n):
            j = bisect_right(self.ends, at + capacity)
            before = self.ends[j - 1] if j else 0
            at = at + capacity if within and j < len(self.cells) and not self.cells[j].atomic else max(at, before)
            out.append(min(at, self.total))
        return out

    def smallest(self, within: bool) -> int:
        low, high = -(-self.total // self.n), self.total
        while low < high:
            mid = (low + high) // 2
            if self.cuts(mid, within)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low

    def unsure(self, low: int, high: int) -> list[int]:
        """Cells that are not atomic and where some capacity from low to high may cut."""
        found = set()
        for a, b in zip(self.cuts(low, False), self.cuts(high, True), strict=True):
            j = bisect_right(self.ends, a)
            while j < len(self.cells) and (self.ends[j - 1] if j else 0) <= b:
                if not self.cells[j].atomic:
                    found.add(j)
                j += 1
        return sorted(found)


def minimax_cuts(rows: DataFrame, n_shards: int, first_bits: int = FIRST_BITS) -> tuple[int, list[int]]:
    """The smallest feasible capacity, and the lowest hash of each shard but the first."""
    cells = sorted(cells_of(rows, first_bits))
    while cells:
        greedy = Greedy(cells, n_shards)
        low, high = greedy.smallest(True), greedy.smallest(False)
        split = greedy.unsure(low, high)
        if not split:
            starts = [0, *greedy.ends]
            ends = greedy.cuts(low, False)
            places = [bisect_right(starts, e) - 1 for e in ends[:-1]]
            return low, [cells[j].first if j < len(cells) else None for j in places]
        by_bits: dict[int, list[Cell]] = {}
        for j in split:
            by_bits.setdefault(cells[j].bits, []).append(cells[j])
        gone = set(split)
        cells = [c for j, c in enumerate(cells) if j not in gone]
        for bits, wide in by_bits.items():
            inside = rows.where(F.shiftright("group_key", 64 - bits).isin([c.first >> (64 - bits) for c in wide]))
            cells += cells_of(inside, min(64, bits + STEP_BITS))
        cells.sort()
    return 0, []


def shard_documents(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", blocks: int = 256) -> DataFrame:
    """One row a document: id, size, text_crc32, shard, slot, group_key, capacity."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("group_key"), F.monotonically_increasing_id().alias("row"),
    )
    rows = materialise(rows, "shard-rows")
    capacity, firsts = minimax_cuts(rows, n_shards)
    shard = F.lit(0)
    for first in firsts:
        if first is not None:
            shard = shard + (F.col("group_key") >= F.lit(first)).cast("int")
    placed = rows.select("*", shard.alias("shard"), F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"))
    counts = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = placed.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "block").orderBy("row")))
    # n_shards * blocks rows at most, so this side is small at every size of input
    numbered = numbered.join(F.broadcast(starts), ["shard", "block"])
    slot = (F.col("start") + F.col("nth") - 1).cast("long")
    return numbered.select(F.col("id").alias(id_col), "size", "text_crc32", F.col("shard").cast("int"), slot.alias("slot"), "group_key", F.lit(capacity).cast("long").alias("capacity"))
