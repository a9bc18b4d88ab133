"""Embedding near-dedup: navigable small-world graphs per shard, audited beams, verified links, components.

Vectors are compared only within a label. Equal vectors form one class with a count. The classes of a
label are dealt to shards of about `SHARD` vectors by hash; each shard builds one hierarchical graph over all its vectors
once, and graph and vectors are written as one packed row. Every vector of the label queries every shard: a task takes one
shard's graph and the vectors of one shard as a block of queries, so it never holds more than two shards, and a label
with very many vectors is spread over the square of its shards. A query whose beam ends above the
threshold may have more links than its beam holds, so its beam is doubled until it does not; past `WIDEST`
the shard is scanned in blocks for that query. Each shard audits a sample of its own vectors against
brute force and doubles the beam of all queries until the recall of links to other vectors reaches `RECALL`; the recall
that the shard of a vector ended with is returned with it. Every link is verified by the cosine in double precision.

A task returns for each query its number of links and a spanning forest of the links it saw, not
all pairs, so a large group of near copies gives rows in proportion to its members. Components
are then the union of the forests.

Vectors that are null, zero, or hold null or non-finite components, and vectors without a label, link
with nothing. Empty tables give no rows. Ties in similarity are all links. Repeated rows are links of
each other, also if their ids are equal (an id is then in several rows, each with the other's link). Rows without an id
link nothing. Vectors of differing lengths never link. Further input columns are ignored.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, small_batches
from .graph import components

THRESHOLD = 0.93
#: Vectors of one graph, about, and bytes of its components. Links of a node on the lowest level, and above.
SHARD, SHARD_BYTES, NEAR, FAR = 16_384, 64 << 20, 16, 8
BEAM, WIDEST = 32, 512
#: Vectors that a shard audits, and the recall of links it must reach.
AUDIT, RECALL = 128, 0.995
BLOCK = 256


class SmallWorld:
    """A hierarchical navigable small-world graph over unit vectors; nodes and queries are handled in blocks."""

    def __init__(self, x: np.ndarray, beam: int = 48, seed: int = 7):
        self.x, n = x, len(x)
        level = np.minimum((-np.log(np.random.default_rng(seed).random(n)) / np.log(NEAR)).astype(int), 6)
        self.levels: list[np.ndarray] = []
        for k in range(int(level.max(initial=0)) + 1):
            width = 2 * NEAR if k == 0 else 2 * FAR
            self.levels.append(np.full((n, width), -1, np.int32))
        order = np.argsort(-level, kind="stable")  # the highest first: the upper levels are whole from the start
        self.entry = int(order[0]) if n else -1
        at = 1
        while at < n:
            block = order[at : at + min(BLOCK, max(1, at))]
            self._insert(block, level, beam)
            at += len(block)

    def _insert(self, nodes: np.ndarray, level: np.ndarray, beam: int) -> None:
        start = np.full(len(nodes), self.entry)
        for k in range(len(self.levels) - 1, -1, -1):
            ids, _ = self.search_level(self.x[nodes], start, k, beam if (level[nodes] >= k).any() else 1)
            start = ids[:, 0]
            own = np.flatnonzero(level[nodes] >= k)
            if len(own):
                among = self.x[nodes[own]] @ self.x[nodes[own]].T  # nodes of one block may be neighbours
                np.fill_diagonal(among, -2)
                for i, row in enumerate(own):
                    mates = nodes[own[np.argsort(-among[i])[:4]]] if len(own) > 1 else nodes[:0]
                    self._link(int(nodes[row]), np.unique(np.concatenate([ids[row][ids[row] >= 0], mates])), k)

    def _link(self, node: int, near: np.ndarray, k: int) -> None:
        near = near[near != node]
        chosen = self._diverse(node, near, NEAR if k == 0 else FAR)
        table = self.levels[k]
        table[node, : len(chosen)] = chosen
        table[node, len(chosen) :] = -1
        for other in chosen:
            row = table[other]
            if (row == node).any():
                continue
            free = np.flatnonzero(row < 0)
            if len(free):
                row[free[0]] = node
            else:
                kept = self._diverse(int(other), np.append(row, node), len(row) - 2)
                row[: len(kept)], row[len(kept) :] = kept, -1

    def _diverse(self, node: int, near: np.ndarray, most: int) -> np.ndarray:
        """Neighbours that are nearer to the node than to those chosen before, then the nearest of the rest."""
        if len(near) <= most:
            return near
        sims = self.x[near] @ self.x[node]
        order = np.argsort(-sims)
        near, sims = near[order], sims[order]
        among = self.x[near] @ self.x[near].T
        chosen: list[int] = []
        for i in range(len(near)):
            if len(chosen) == most:
                break
            if not chosen or among[i, chosen].max() < sims[i]:
                chosen.append(i)
        taken = set(chosen)
        chosen += [i for i in range(len(near)) if i not in taken][: most - len(chosen)]
        return near[chosen]

    def search_level(self, q: np.ndarray, start: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The best `beam` nodes of level k for each query, best first; -1 where there are fewer."""
        n, table = len(q), self.levels[k]
        rows = np.arange(n)
        ids = np.full((n, beam), -1, np.int32)
        sims = np.full((n, beam), -3.0, np.float32)
        spent = np.ones((n, beam), bool)
        ids[:, 0], sims[:, 0], spent[:, 0] = start, np.einsum("ij,ij->i", q, self.x[start]), False
        met = np.zeros((n, len(self.x)), bool)
        met[rows, start] = True
        active = rows
        while len(active):
            place = np.argmax(~spent[active], axis=1)
            at = ids[active, place]
            spent[active, place] = True
            near = table[at]
            fresh = (near >= 0) & ~met[active[:, None], near]
            r, c = np.nonzero(fresh)
            if len(r):
                found = near[r, c]
                met[active[r], found] = True
                s = np.full(near.shape, -3.0, np.float32)
                s[r, c] = np.einsum("ij,ij->i", q[active[r]], self.x[found])
                all_s = np.concatenate([sims[active], s], 1)
                all_i = np.concatenate([ids[active], np.where(fresh, near, -1)], 1)
                all_d = np.concatenate([spent[active], ~fresh], 1)
                order = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
                sims[active], ids[active], spent[active] = (np.take_along_axis(a, order, 1) for a in (all_s, all_i, all_d))
            active = active[~spent[active].all(axis=1)]
        return ids, sims

    def query(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        start = np.full(len(q), self.entry)
        for k in range(len(self.levels) - 1, 0, -1):
            start = self.search_level(q, start, k, 2)[0][:, 0]
        return self.search_level(q, start, 0, beam)


def neighbours(graph: SmallWorld, q: np.ndarray, beam: int, least: float):
    """For blocks of queries: (query rows, node ids) that may reach `least` (a little under the threshold)."""
    todo = np.arange(len(q))
    while len(todo):
        again = []
        for a in range(0, len(todo), BLOCK):
            rows = todo[a : a + BLOCK]
            if beam > WIDEST or beam >= len(graph.x):  # exact, for what no beam holds
                r, c = np.nonzero(q[rows] @ graph.x.T >= least)
                yield rows[r], c
                continue
            ids, sims = graph.query(q[rows], beam)
            full = sims[:, -1] >= least
            again.append(rows[full])
            r, c = np.nonzero((sims >= least) & ~full[:, None])
            yield rows[r], ids[r, c]
        todo = np.concatenate(again) if again else np.empty(0, int)
        beam *= 2


def audited_beam(graph: SmallWorld, beam: int, least: float) -> tuple[int, float]:
    """The beam, doubled until a sample's links to other vectors are found to `RECALL`, and the recall reached."""
    sample = np.unique(np.linspace(0, len(graph.x) - 1, min(AUDIT, len(graph.x))).astype(int))
    q = graph.x[sample]
    there = q @ graph.x.T >= least
    there[np.arange(len(sample)), sample] = False
    there = int(there.sum())
    while True:
        found = sum(int((sample[r] != c).sum()) for r, c in neighbours(graph, q, beam, least))
        if found >= RECALL * there or beam > WIDEST:  # past the widest beam the search is exact
            return beam, found / there if there else 1.0
        beam *= 2


class Forest:
    """Union-find that tells whether a link joins two parts."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def join(self, a: int, b: int) -> bool:
        up = self.up
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        while up[b] != b:
            up[b] = up[up[b]]
            b = up[b]
        up[a] = b
        return a != b


def pack_shard(rows: pd.DataFrame, threshold: float) -> tuple[bytes, float]:
    """A shard's ids, class sizes, vectors and graph as bytes, and its audited recall."""
    import zstandard

    vectors = np.stack(rows["embedding"].to_numpy())
    graph = SmallWorld(_unit(vectors.astype(np.float64)).astype(np.float32))
    beam, recall = audited_beam(graph, BEAM, np.float32(threshold - 1e-4))
    out = io.BytesIO()
    levels = {f"level{k}": x for k, x in enumerate(graph.levels)}
    np.savez(out, ids=rows["id"].to_numpy(np.int64), sizes=rows["size"].to_numpy(np.int64), vectors=vectors, entry=graph.entry, beam=beam, **levels)
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue()), recall


class Shard:
    """A packed shard, read again."""

    def __init__(self, packed: bytes):
        import zstandard

        own = np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(packed)))
        self.ids, self.sizes, self.exact, self.beam = own["ids"], own["sizes"], _unit(own["vectors"].astype(np.float64)), int(own["beam"])
        self.graph = SmallWorld.__new__(SmallWorld)
        self.graph.x, self.graph.entry = self.exact.astype(np.float32), int(own["entry"])
        self.graph.levels = [own[f"level{k}"] for k in range(sum(name.startswith("level") for name in own.files))]


def search_shard(index: Shard, asked: Shard, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, n_links) of the askers with links into the shard, weighted by class size, and the edges (id, other) of a forest."""
    places, at = np.unique(np.concatenate([index.ids, asked.ids]), return_inverse=True)
    ids_at, askers_at = at[: len(index.ids)], at[len(index.ids) :]
    forest, n_links, edges = Forest(len(places)), np.zeros(len(asked.ids), np.int64), []
    for r, c in neighbours(index.graph, asked.graph.x, index.beam, np.float32(threshold - 1e-4)):
        true = (askers_at[r] != ids_at[c]) & (np.einsum("ij,ij->i", asked.exact[r], index.exact[c]) >= threshold)
        r, c = r[true], c[true]
        np.add.at(n_links, r, index.sizes[c])
        edges += [(i, j) for i, j in zip(askers_at[r].tolist(), ids_at[c].tolist(), strict=True) if forest.join(i, j)]
    linked, edges = np.flatnonzero(n_links), np.array(edges, np.int64).reshape(-1, 2)
    return asked.ids[linked], n_links[linked], places[edges[:, 0]], places[edges[:, 1]]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares of very small or large components in range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, shard: int = SHARD) -> DataFrame:
    """One row a vector: id, n_links, component_id, kept, recall (null for vectors that link nothing by rule)."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = rows.withColumn("fit", F.coalesce(finite, F.lit(False)) & F.col("label").isNotNull() & F.col("id").isNotNull())
    # equal vectors are told by 128 bits of them
    keys = {f"key{k}": F.when(F.col("fit"), F.xxhash64(F.lit(k), F.col("embedding") if k == 0 else F.reverse("embedding"))) for k in range(2)}
    rows = materialise(rows.withColumns({**keys, "row": F.monotonically_increasing_id(), "length": F.size("embedding")}), "vectors")
    fit, same = rows.where("fit"), ["label", "length", *keys]
    # one row a class of equal vectors; any of its ids stands for it, here the smallest
    classes = fit.groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.min("row").alias("row"))
    classes = classes.join(rows.select("row", "embedding"), "row").select(*same, F.col("row").alias("id"), "rep", "size", "embedding")
    room = F.greatest(F.lit(64), F.least(F.lit(shard), F.expr(f"int({SHARD_BYTES} / (8 * length))")))
    shards = fit.groupBy("label", "length").agg(F.ceil(F.count("*") / room).cast("int").alias("n_shards"))
    classes = materialise(classes.join(shards, ["label", "length"]).withColumn("shard", F.pmod(F.xxhash64("id"), "n_shards").cast("int")), "classes")
    kind = dict(rows.dtypes)["label"]

    def build(key, indexed: pd.DataFrame) -> pd.DataFrame:
        packed, recall = pack_shard(indexed, threshold)
        return pd.DataFrame({"label": [key[0]], "length": [key[1]], "shard": [key[2]], "n_shards": [indexed["n_shards"].iloc[0]], "packed": [packed], "recall": [recall]})

    graphs = classes.select("label", "length", "shard", "n_shards", "id", "size", "embedding").groupBy("label", "length", "shard").applyInPandas(build, f"label {kind}, length int, shard int, n_shards int, packed binary, recall double")
    graphs = materialise(graphs, "graphs")
    every = F.explode(F.sequence(F.lit(0), F.col("n_shards") - 1))
    index = graphs.select("label", "length", "shard", every.alias("block"), F.col("packed").alias("index"))
    asking = graphs.select("label", "length", F.col("shard").alias("block"), every.alias("shard"), F.col("packed").alias("asking"))
    both = index.join(asking, ["label", "length", "shard", "block"]).select("index", "asking")

    def search(batches):
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1), strict=True):
                ids, n_links, u, v = search_shard(Shard(left.as_py()), Shard(right.as_py()), threshold)
                columns = np.concatenate([ids, u]), np.concatenate([n_links, np.zeros(len(u), np.int64)])
                other = pa.concat_arrays([pa.nulls(len(ids), pa.int64()), pa.array(v, pa.int64())])
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), other], names=["id", "n_links", "other"])

    small_batches(rows.sparkSession)
    found = materialise(both.mapInArrow(search, "id long, n_links long, other long"), "vector-links")
    recalls = materialise(graphs.select("label", "length", "shard", "recall"), "recalls")
    discard(graphs)
    reps = classes.select("id", "rep", "size", "shard", *same)
    links = found.where("other is not null").join(reps.select("id", F.col("rep").alias("u")), "id")
    links = links.join(reps.select(F.col("id").alias("other"), F.col("rep").alias("v")), "other")
    joined = components(links.select("u", "v")).withColumnRenamed("id", "rep")
    counts = found.where("other is null").groupBy("id").agg(F.sum("n_links").alias("n_links"))
    known = reps.join(counts, "id", "left").join(joined, "rep", "left").join(F.broadcast(recalls) if recalls.count() <= 100_000 else recalls, ["label", "length", "shard"])
    known = known.select(*same, (F.coalesce("n_links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"), "recall")
    linked = fit.select("id", *same).join(known, same).select("id", "n_links", "component_id", "recall")
    alone = rows.where("not fit").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(None).cast("double").alias("recall"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"), "recall")
