"""Hard-negative mining: bounds on inner products from summaries of vector segments, refined until exact scores decide.

A vector's components become integers, floor(`SCALE` * x). It is cut into 1, 4, 16 and 32 segments; of each segment the mean and the
deviation are stored (the root of the summed squares of what differs from the mean). On one segment of n components two vectors'
inner product is n times the product of their means, give or take at most the product of their deviations; the sum over
the segments bounds the score from both sides, and finer segments bound it more closely. So a pair is dropped at the coarsest level at which its
upper bound is below what it must reach, or its lower bound above what it may reach; what is left after the last level is
scored exactly. The result is that of scoring all pairs.

Anchors are a stated set of queries. First each finds its best rows of the same label (positives), then, for each positive, the best rows
of other labels whose scores lie in a window that the positive's score sets. Higher scores come first, ties by smaller id.

At scale rows are packed in blocks of about `ROWS` by a hash of the row, anchors in packs of about `ANCHORS`, both with their
summaries; labels may be as uneven as they like. Slices of blocks meet groups of packs in a join on (slice, group) whose numbers
grow so that neither side is copied more often than the other's groups; a task holds one block and one pack at a time and
the best rows so far of its anchors, and hands on only those. What a slice has found raises what later blocks must reach.

Rows with a null id, label or vector, or with null or non-finite components take no part. Vectors of differing lengths make no pair;
empty ones score 0 with each other. Repeated rows are rows of their own: each may be anchor, positive and negative. Equal
scores and ids are told apart by the row. Scores that don't fit a long raise an error. Empty tables give no rows. Further input columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, small_batches

SCALE = 256
#: Rows of a block and anchors of a pack, about; segments at each level.
ROWS, ANCHORS, LEVELS = 1024, 256, (1, 4, 16, 32)
POSITIVES, NEGATIVES = 5, 3
#: A negative's score in hundredths of the positive's.
LEAST, GREATEST = 50, 95
#: Anchors of which a task keeps the best rows so far; past them it hands them on.
HELD = 200_000
NONE = -np.inf


def summaries(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """By level: each segment's mean times the root of its length, and its deviation."""
    out, dims = [], x.shape[1]
    for n in sorted({min(n, dims) for n in LEVELS} - {0}):
        starts = np.linspace(0, dims, n, endpoint=False).astype(int)
        length = np.diff(np.append(starts, dims))
        mean = np.add.reduceat(x, starts, axis=1) / length
        rest = x - np.repeat(mean, length, axis=1)
        out.append((mean * np.sqrt(length), np.sqrt(np.add.reduceat(rest * rest, starts, axis=1))))
    return out


class Pack(NamedTuple):
    """Vectors in the order of their ids, with what belongs to them."""

    ids: np.ndarray
    rows: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]
    windows: np.ndarray  # of anchors: (least, greatest) score for each of their positives

    @staticmethod
    def pack(own: pa.Table) -> bytes:
        order = np.lexsort((own["row"].to_numpy(), own["id"].to_numpy()))
        length = own["length"][0].as_py()
        x = np.floor(SCALE * own["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(order), length)[order])
        levels = {f"{what}{k}": a for k, pair in enumerate(summaries(x)) for what, a in zip("md", pair, strict=True)}
        if len(x) and np.abs(x).max(initial=0) < 2**24:
            x = x.astype(np.float32)
        windows = np.zeros((len(x), 0, 2))
        if "windows" in own.column_names:
            windows = np.full((len(x), POSITIVES, 2), np.nan)
            for i, w in enumerate(own["windows"].to_pylist()):
                windows[i, : len(w)] = [(p["least"], p["greatest"]) for p in w]
            windows = windows[order]
        out = io.BytesIO()
        np.savez(out, ids=own["id"].to_numpy()[order], rows=own["row"].to_numpy()[order], labels=own["label"].to_numpy()[order], x=x, windows=windows, **levels)
        return out.getvalue()

    @staticmethod
    def of(packed: bytes) -> Pack:
        z = np.load(io.BytesIO(packed))
        levels = [(z[f"m{k}"], z[f"d{k}"]) for k in range(sum(n[0] == "m" for n in z.files))]
        return Pack(z["ids"], z["rows"], z["labels"], z["x"].astype(np.float64), levels, z["windows"])


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integers, as whole numbers whatever their size."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < 2**53:
        return a @ b.T
    whole = np.vectorize(int, otypes=[object])
    return whole(a).dot(whole(b).T) if a.shape[1] else np.zeros((len(a), len(b)))


class Best:
    """The best k rows so far of each list: ids, rows and scores, best first."""

    def __init__(self, n: int, k: int):
        self.scores, self.ids, self.rows, self.k = np.full((n, k), NONE), np.zeros((n, k), np.int64), np.zeros((n, k), np.int64), k

    def least(self) -> np.ndarray:
        """What a row must reach, at least, to come into each list."""
        return np.asarray(self.scores[:, -1], np.float64)

    def add(self, at: np.ndarray, scores: np.ndarray, fits: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """scores (lists `at` x rows in the order of their ids), where `fits`."""
        scores = np.where(fits, scores, NONE)
        top = np.argsort(-scores, axis=1, kind="stable")[:, : self.k]
        scores = np.concatenate([self.scores[at], np.take_along_axis(scores, top, 1)], 1)
        ids, rows = np.concatenate([self.ids[at], ids[top]], 1), np.concatenate([self.rows[at], rows[top]], 1)
        order = np.lexsort((rows, ids, -scores), axis=1)[:, : self.k] if scores.dtype != object else np.array([sorted(range(scores.shape[1]), key=lambda j, i=i: (-scores[i, j], ids[i, j], rows[i, j]))[: self.k] for i in range(len(scores))])
        scores = np.take_along_axis(scores, order, 1)
        if scores.dtype == object:
            self.scores = self.scores.astype(object)
        self.scores[at], self.ids[at], self.rows[at] = scores, np.take_along_axis(ids, order, 1), np.take_along_axis(rows, order, 1)

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero(self.scores != NONE)


def survivors(anchors: Pack, block: Pack, a: np.ndarray, b: np.ndarray, open_pairs: np.ndarray, must: list[np.ndarray], may: list[np.ndarray | None], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors a, rows b and which of their pairs may still score in some range, of those that were open.

    must, may: by range, the least and the greatest score of each anchor of a (NaN where there is no range; None: no greatest).
    Without a greatest score the k-th best lower bound is one that a row must reach."""
    for (mean, deviation), (mean_b, deviation_b) in zip(anchors.levels, block.levels, strict=True):
        if not open_pairs.any():
            break
        some_a, some_b = open_pairs.any(axis=1), open_pairs.any(axis=0)
        a, b, open_pairs = a[some_a], b[some_b], open_pairs[np.ix_(some_a, some_b)]
        must, may = [m[some_a] for m in must], [None if m is None else m[some_a] for m in may]
        centre, spread = mean[a] @ mean_b[b].T, deviation[a] @ deviation_b[b].T
        spread += 1e-9 * (np.abs(centre) + spread) + 1e-6  # rounding
        upper, lower = centre + spread, centre - spread
        possible = np.zeros_like(open_pairs)
        for r, (low, high) in enumerate(zip(must, may, strict=True)):
            if high is None:
                if len(b) > k:
                    kth = -np.partition(np.where(open_pairs, -lower, np.inf), k - 1, axis=1)[:, k - 1]
                    low = must[r] = np.maximum(low, kth - 1e-6 * np.abs(np.where(np.isfinite(kth), kth, 0)))
                possible |= upper >= low[:, None]
            else:
                possible |= (upper >= low[:, None]) & (lower <= high[:, None])
        open_pairs = open_pairs & possible
    return a, b, open_pairs


def positives_in(anchors: Pack, block: Pack, best: Best, k: int) -> None:
    for label in np.intersect1d(anchors.labels, block.labels):
        a, b = np.flatnonzero(anchors.labels == label), np.flatnonzero(block.labels == label)
        other = anchors.rows[a][:, None] != block.rows[b][None, :]
        a, b, pairs = survivors(anchors, block, a, b, other, [best.least()[a]], [None], k)
        if pairs.any():
            best.add(a, exact(anchors.x[a], block.x[b]), pairs, block.ids[b], block.rows[b])


def negatives_in(anchors: Pack, block: Pack, best: Best, k: int) -> None:
    """best has a list for each anchor and positive."""
    a, b = np.arange(len(anchors.ids)), np.arange(len(block.ids))
    n = anchors.windows.shape[1]
    reached = best.least().reshape(-1, n)
    must = [np.fmax(np.where(np.isnan(anchors.windows[:, j, 0]), np.nan, reached[:, j]), anchors.windows[:, j, 0]) for j in range(n)]
    may = [anchors.windows[:, j, 1] for j in range(n)]
    a, b, pairs = survivors(anchors, block, a, b, anchors.labels[:, None] != block.labels[None, :], must, may, k)
    if pairs.any():
        scores = exact(anchors.x[a], block.x[b])
        for j in range(n):
            low, high = anchors.windows[a, j, 0], anchors.windows[a, j, 1]
            fits = pairs & (scores >= low[:, None]) & (scores <= high[:, None])
            some, cols = fits.any(axis=1), fits.any(axis=0)
            if some.any():
                best.add((a * n + j)[some], scores[np.ix_(some, cols)], fits[np.ix_(some, cols)], block.ids[b[cols]], block.rows[b[cols]])


_FOUND = "anchor long, nth int, id long, row long, score long"


def scan(blocks: DataFrame, packs: DataFrame, k: int, negatives: bool) -> DataFrame:
    """Of each anchor (and positive, if negatives), the best k rows of each task: (anchor's row, nth, id, row, score)."""
    n_blocks, n_packs = blocks.count(), packs.count()
    groups = 1 + n_packs // 1024
    slices = min(max(1, n_blocks), 64 + n_blocks // 1024)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = blocks.select("length", F.col("packed").alias("block"), (F.pmod(F.xxhash64("number"), F.lit(slices))).cast("int").alias("slice"), every(groups).alias("group"))
    right = packs.select("length", F.col("packed").alias("anchors"), F.pmod(F.col("number"), F.lit(groups)).cast("int").alias("group"), every(slices).alias("slice"), F.col("number").alias("pack"))
    # packs are copied to every slice, which Spark's guess of their size does not count, so they are never broadcast
    pairs = left.join(right.hint("merge"), ["length", "slice", "group"]).select("length", "pack", "block", "anchors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[Pack, Best]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for anchors, best in held.values():
                at, place = best.found()
                wide = len(best.ids) // max(1, len(anchors.ids))
                scores = [int(s) for s in best.scores[at, place]]
                columns = [anchors.rows[at // wide], (at % wide).astype(np.int32), best.ids[at, place], best.rows[at, place]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(scores, pa.int64())], names=["anchor", "nth", "id", "row", "score"])
            held.clear()

        for batch in batches:
            for length, pack, packed, own in zip(*batch.columns, strict=True):
                key = length.as_py(), pack.as_py()
                if key not in held:
                    if sum(len(a.ids) for a, _ in held.values()) > HELD:
                        yield from flush()
                    anchors = Pack.of(own.as_py())
                    held[key] = anchors, Best(len(anchors.ids) * (anchors.windows.shape[1] if negatives else 1), k)
                anchors, best = held[key]
                (negatives_in if negatives else positives_in)(anchors, Pack.of(packed.as_py()), best, k)
        yield from flush()

    small_batches(blocks.sparkSession)
    return pairs.mapInArrow(run, _FOUND)


def packed(rows: DataFrame, size: int, label: str) -> DataFrame:
    """length, number, packed: rows (id, row, label, embedding, length and, of anchors, windows) in packs of about `size`, dealt by hash."""
    counts = rows.groupBy("length").agg(F.ceil(F.count("*") / size).alias("n"))
    dealt = rows.join(counts, "length").withColumn("number", F.pmod(F.xxhash64("row"), F.col("n"))).drop("n")

    def run(key: tuple, own: pa.Table) -> pa.Table:
        return pa.table({"length": pa.array([key[0].as_py()], pa.int32()), "number": pa.array([key[1].as_py()], pa.int64()), "packed": pa.array([Pack.pack(own)], pa.binary())})

    return materialise(dealt.groupBy("length", "number").applyInArrow(run, "length int, number long, packed binary"), label)


def best_of(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The best k of what the tasks found, with their rank from 1."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", relabel: Column | None = None,
    positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, greatest: int = GREATEST,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. is_anchor, relabel: over the columns id and label."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("embedding"), F.col(label_col).cast("long").alias("label"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    if relabel is not None:
        rows = rows.withColumn("label", relabel)
    rows = materialise(rows.withColumns({"row": F.monotonically_increasing_id(), "length": F.size("embedding")}), "vectors")
    blocks = packed(rows, ROWS, "vector-blocks")
    asked = rows.where(is_anchor)
    packs = packed(asked, ANCHORS, "anchors")
    good = best_of(scan(blocks, packs, positives, False), ["anchor"], positives)
    good = materialise(good.select("anchor", (F.col("rank") - 1).alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # the whole scores that lie in the window; at most `positives` of them an anchor
    low, high = F.expr(f"-floor(cast(positive_score * {-least} as decimal(38,0)) / 100)"), F.expr(f"floor(cast(positive_score * {greatest} as decimal(38,0)) / 100)")
    windows = good.select("anchor", "nth", low.cast("double").alias("least"), high.cast("double").alias("greatest"))
    windows = windows.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("nth", "least", "greatest"))).alias("windows"))
    with_windows = asked.join(windows.withColumnRenamed("anchor", "row"), "row").select("id", "row", "label", "embedding", "length", F.expr("transform(windows, w -> struct(w.least, w.greatest))").alias("windows"))
    second = packed(with_windows, ANCHORS, "anchors-with-windows")
    bad = best_of(scan(blocks, second, negatives, True), ["anchor", "nth"], negatives)
    bad = bad.select("anchor", "nth", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = bad.join(good, ["anchor", "nth"]).join(asked.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    out = materialise(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard-negatives")
    discard(rows, blocks, packs, good, second)
    return out
