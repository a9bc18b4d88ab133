"""Graph operators over vertex and edge DataFrames. Searches and components run until
nothing changes, other loops a given number of rounds; each round is checkpointed where lineage would grow; path joins need edges filtered first and a hop cap."""

from __future__ import annotations

import math
from collections.abc import Iterable
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import money
from ..shared import Steps, cut


def edges(txns: DataFrame, weight: str = "total") -> DataFrame:
    """G1: one edge a pair; weight is the total, or the amount of the first transaction."""
    out = txns.groupBy(F.col("sender_id").alias("src"), F.col("receiver_id").alias("dst")).agg(
        F.count("*").alias("n"), money(F.sum("amount")).alias("total"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), money(F.min_by("amount", F.struct("ts", "transaction_id"))).alias("first_amount")
    )
    return out.withColumn("weight", F.col("total" if weight == "total" else "first_amount"))


def vertices(txns: DataFrame) -> DataFrame:
    """Transactions touching a node; a transfer to oneself counts twice."""
    return txns.select(F.explode(F.array("sender_id", "receiver_id")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))


def nodes_of(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def degrees(e: DataFrame) -> DataFrame:
    """G3."""
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    d = ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    n = d.agg(F.count("*").alias("n_nodes"))
    return d.crossJoin(F.broadcast(n)).select("node", "out_degree", "in_degree", ((F.col("out_degree") + F.col("in_degree")) / (F.col("n_nodes") - 1)).alias("centrality"))


def pagerank(e: DataFrame, rounds: int = 100, damping: float = 0.85, tolerance: float = 1e-9) -> DataFrame:
    """Weighted; the rank of nodes without outgoing edges is dealt to all. One join and one aggregate a round, until the
    ranks' changes sum up to less than the tolerance."""
    total = e.groupBy("src").agg(F.sum("weight").alias("out"))
    share = cut(e.join(total, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("p")))
    nodes = cut(nodes_of(e).join(total.select(F.col("src").alias("node"), F.lit(False).alias("dangling")), "node", "left").fillna(True, ["dangling"]))
    n = nodes.count()
    rank = nodes.withColumn("rank", F.lit(1.0 / n if n else 0.0))
    for _ in range(rounds):
        lost = rank.where("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        came = share.join(rank.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("p") * F.col("rank")).alias("came"))
        new = rank.join(came, "node", "left").crossJoin(F.broadcast(lost))  # one row
        new = cut(new.select("node", "dangling", F.col("rank").alias("old"), ((1 - damping) / n + damping * (F.coalesce("came", F.lit(0.0)) + F.col("lost") / n)).alias("rank")))
        rank = new.drop("old")
        if (new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0) < tolerance:
            break
    return rank.select("node", "rank")


def eigenvector(e: DataFrame, rounds: int = 100, tolerance: float = 1e-9) -> DataFrame:
    """Power iteration along incoming edges, normalised each round, until nothing changes by more than the tolerance; 0 for all if nothing is left."""
    links = cut(e.select("src", "dst"))
    x = cut(nodes_of(e).withColumn("x", F.lit(1.0)))
    for _ in range(rounds):
        came = links.join(x.select(F.col("node").alias("src"), F.col("x").alias("y")), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("y").alias("y"))
        raw = cut(x.join(came, "node", "left").select("node", F.col("x").alias("old"), (F.col("x") + F.coalesce("y", F.lit(0.0))).alias("x")))
        norm = raw.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
        new = cut(raw.crossJoin(F.broadcast(norm)).select("node", "old", F.coalesce(F.try_divide("x", "norm"), F.lit(0.0)).alias("x")))  # one row
        x = new.select("node", "x")
        if (new.agg(F.max(F.abs(F.col("x") - F.col("old")))).first()[0] or 0.0) < tolerance:
            break
    return x


def _inner(links: DataFrame) -> DataFrame:
    """The links that a search can follow after its first step: from nodes that another one leads to."""
    return cut(links.join(links.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"))


def distances(e: DataFrame, sources: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Breadth-first search from every source (default all), to the end or `most` steps far: source, node, dist, sigma = number of shortest paths."""
    links = cut(e.where("src <> dst").select("src", "dst").distinct())
    return _search(links, _inner(links), nodes_of(e) if sources is None else sources, most)[0]


def _search(links: DataFrame, inner: DataFrame, sources: DataFrame, most: int | None = None) -> tuple[DataFrame, int]:
    """The result of `distances` and the number of its steps. links: distinct, without loops; inner: those of them that lead on from where a link ends.

    The first step is the sources' own links. Later ones keep a source's rows together, so that where inner links are few enough to be
    broadcast, paths are summed where they are made and only their sums are shuffled. A step's rows are written once, into a part of one table."""
    kind = dict(links.dtypes)["src"]
    steps = Steps(links.sparkSession, f"source {kind}, node {kind}, sigma double, dist int")
    seen = steps.add(sources.select(F.col("node").cast(kind).alias("source"), F.col("node").cast(kind).alias("node"), F.lit(1.0).alias("sigma")), 0)
    for k in count(1) if most is None else range(1, most + 1):
        if k == 1:
            front = links.join(sources.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("src").alias("source"), F.col("dst").alias("node"), F.lit(1.0).alias("sigma"))
        else:
            step = seen.where(F.col("dist") == k - 1).repartition("source").join(inner, F.col("node") == F.col("src")).groupBy("source", F.col("dst").alias("node")).agg(F.sum("sigma").alias("sigma"))
            front = step.join(seen.select("source", "node"), ["source", "node"], "left_anti")
        seen = steps.add(front, k)
        if seen.where(F.col("dist") == k).limit(1).count() == 0:
            return seen.select("source", "node", "dist", "sigma"), k - 1
    return seen.select("source", "node", "dist", "sigma"), most


#: Bytes that one (source, node) row of a search takes while it is joined, about.
SEARCH_ROW = 512


def block_rows(e: DataFrame) -> int:
    """(source, node) rows that may be alive at once: a quarter of what the executors' memory holds."""
    held = e.sparkSession.sparkContext._jsc.sc().getExecutorMemoryStatus()
    return max(100_000, sum(x._2()._1() for x in _entries(held)) // (4 * SEARCH_ROW))


def _entries(scala_map):
    it = scala_map.iterator()
    while it.hasNext():
        yield it.next()


def path_measures(e: DataFrame, most_rows: int | None = None) -> DataFrame:
    """Node, betweenness, reached (nodes that reach it), far (the sum of their distances), cycle (the hops of the shortest cycle
    through it, null without one; a transfer to oneself is none).

    Sources are searched in blocks, so that about `most_rows` pairs of a source and a node that it reaches are alive at once (by default what the
    executors' memory allows), whatever the number of nodes. No source reaches more than the nodes that links lead to, and one without
    links reaches none, so the first block is dealt by that; later ones by what the sources before them have reached. In a block, levels of a breadth-first
    search count shortest paths, then dependencies flow back level by level from the farthest nodes; both are summed by node and the pairs are dropped. All nodes are sources."""
    nodes = cut(nodes_of(e))
    links = cut(e.where("src <> dst").select("src", "dst").distinct())
    inner = _inner(links)
    n, most_rows = nodes.count(), most_rows or block_rows(e)
    starts = cut(links.select(F.col("src").alias("node")).distinct())
    pairs = starts.count() * (1 + links.select("dst").distinct().count())
    sums = nodes.select("node", F.lit(0.0).alias("delta"), F.lit(0).cast("long").alias("reached"), F.lit(0).cast("long").alias("far"), F.lit(None).cast("int").alias("cycle"))
    whole = 1 << 30
    at, width, held = 0, max(1, min(whole, whole * most_rows // max(1, pairs))), 0
    while at < whole:
        place = F.pmod(F.xxhash64("node"), F.lit(whole))
        found, depth = _search(links, inner, starts.where((place >= at) & (place < at + width)))
        parts = [
            _dependencies(inner, found, depth), found.where("dist > 0").groupBy("node").agg(F.count("*").alias("reached"), F.sum("dist").cast("long").alias("far")),
            found.join(inner, (F.col("node") == F.col("src")) & (F.col("source") == F.col("dst"))).groupBy(F.col("source").alias("node")).agg((F.min("dist") + 1).alias("cycle")),
        ]
        for own in parts:
            sums = sums.unionByName(own, allowMissingColumns=True)
        sums = cut(sums.groupBy("node").agg(*(F.sum(c).alias(c) for c in ("delta", "reached", "far")), F.min("cycle").alias("cycle")))
        at, held = at + width, held + found.count()
        width = max(1, min(whole - at, most_rows * at // max(1, held)))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return sums.select("node", (F.col("delta") * scale).alias("betweenness"), "reached", "far", "cycle")


def _dependencies(inner: DataFrame, found: DataFrame, depth: int) -> DataFrame:
    """node, delta: the summed dependencies on each node of the sources in `found` (source, node, dist, sigma), which ends after `depth` steps.

    A node's share goes to those before it, which are inner nodes, for nothing is asked of the sources themselves. What a node is due is
    summed before its own number of paths is looked up."""
    level, total = None, None
    for k in range(depth, 1, -1):
        far = found.where(F.col("dist") == k).select("source", "node", "sigma")
        far = far.withColumn("delta", F.lit(0.0)) if level is None else far.join(level, ["source", "node"], "left").fillna(0.0, ["delta"])
        due = far.select("source", "node", ((1 + F.col("delta")) / F.col("sigma")).alias("due")).repartition("source")
        due = due.join(inner, F.col("node") == F.col("dst")).groupBy("source", F.col("src").alias("node")).agg(F.sum("due").alias("due"))
        # a node's level is fixed, so what the nodes of one level have is whole after it, and is all that the next one needs
        level = cut(found.where(F.col("dist") == k - 1).join(due, ["source", "node"]).select("source", "node", (F.col("sigma") * F.col("due")).alias("delta")))
        own = level.groupBy("node").agg(F.sum("delta").alias("delta"))
        total = own if total is None else total.unionByName(own)
    if total is None:
        return found.select("node", F.lit(0.0).alias("delta")).limit(0)
    return total.groupBy("node").agg(F.sum("delta").alias("delta"))


def closeness(e: DataFrame, measured: DataFrame | None = None) -> DataFrame:
    """By distances to the node, scaled by the share of nodes that reach it. measured: the result of path_measures."""
    d = measured if measured is not None else path_measures(e)
    n = nodes_of(e).count()
    return d.select("node", F.when((F.col("far") > 0) & F.lit(n > 1), F.col("reached") / F.col("far") * F.col("reached") / (n - 1)).otherwise(0.0).alias("closeness"))


def betweenness(e: DataFrame, measured: DataFrame | None = None) -> DataFrame:
    """Normalised for a directed graph."""
    return (measured if measured is not None else path_measures(e)).select("node", "betweenness")


def paths(e: DataFrame, most: int) -> list[DataFrame]:
    """Simple paths of 1 .. `most` hops as (path, start, last, total, first_ts, last_ts)."""
    step = cut(e.where("src <> dst").select("src", "dst", "total", "first_ts", "last_ts"))
    out = [step.select(F.array("src", "dst").alias("path"), F.col("src").alias("start"), F.col("dst").alias("last"), "total", "first_ts", "last_ts")]
    nxt = step.toDF("src", "dst", "t2", "f2", "l2")
    for _ in range(most - 1):
        more = out[-1].join(nxt, F.col("last") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        more = more.select(F.concat("path", F.array("dst")).alias("path"), "start", F.col("dst").alias("last"), (F.col("total") + F.col("t2")).alias("total"), F.least("first_ts", "f2").alias("first_ts"), F.greatest("last_ts", "l2").alias("last_ts"))
        out.append(cut(more))  # it is read twice, and nested expressions of many hops are slow to plan
    return out


def cycles_of(e: DataFrame, lengths) -> dict[int, DataFrame]:
    """Simple cycles by their number of hops, each once, as the path from its smallest node.

    Only links inside a strong component can lie on a cycle. A cycle of n hops is met in the middle: a path of half its hops
    from its smallest node, and one of the rest back to it, over larger nodes that are apart. So the paths that are made are half as long as the cycles."""
    lengths = sorted(lengths)
    part = strong_components(e)
    inside = e.where("src <> dst").select("src", "dst").distinct().join(part.toDF("src", "a"), "src").join(part.toDF("dst", "b"), "dst")
    step = cut(inside.where("a = b").select("src", "dst"))
    half = -(-max(lengths, default=2) // 2)
    out_ways = [step.where("src < dst").select(F.col("src").alias("start"), F.col("dst").alias("at"), F.array("dst").alias("out"))]
    back_ways = [step.where("dst < src").select(F.col("dst").alias("start"), F.col("src").alias("at"), F.array().cast("array<" + dict(step.dtypes)["src"] + ">").alias("back"))]
    for _ in range(half - 1):
        w = out_ways[-1].join(step, F.col("at") == F.col("src")).where((F.col("dst") > F.col("start")) & ~F.array_contains("out", F.col("dst")))
        out_ways.append(cut(w.select("start", F.col("dst").alias("at"), F.concat("out", F.array("dst")).alias("out"))))
        w = back_ways[-1].join(step, F.col("at") == F.col("dst")).where((F.col("src") > F.col("start")) & (F.col("src") != F.col("at")) & ~F.array_contains("back", F.col("src")))
        back_ways.append(cut(w.select("start", F.col("src").alias("at"), F.concat(F.array("at"), "back").alias("back"))))
    found = {}
    for n in lengths:
        a, b = -(-n // 2), n // 2
        both = out_ways[a - 1].join(back_ways[b - 1], ["start", "at"]).where(~F.arrays_overlap("out", "back"))
        found[n] = both.select(F.concat(F.array("start"), "out", "back").alias("path"))
    return found


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def rotated(cycles: DataFrame) -> DataFrame:
    """Each cycle from each of its nodes."""
    k = F.explode(F.sequence(F.lit(0), F.size("path") - 1)).alias("k")
    turned = cycles.select("path", k).select(F.expr("concat(slice(path, k + 1, size(path)), slice(path, 1, k))").alias("path"))
    return turned


def cycles(e: DataFrame, most: int = 10, rotations: bool = False) -> DataFrame:
    """Simple cycles of 2 .. `most` hops, each once, from its smallest node; G10: with all rotations."""
    found = _all(list(cycles_of(e, range(2, most + 1)).values()))
    return rotated(found) if rotations else found


def longest_cycles(e: DataFrame, most: int = 10, k: int = 100) -> DataFrame:
    """The k longest cycles of 2 .. `most` hops with all rotations, longest first, then in the order of their nodes.
    Lengths are taken from the longest down, and no more of them than it takes to have k."""
    kept, n = [], 0
    for _, found in sorted(cycles_of(e, range(2, most + 1)).items(), reverse=True):
        best = cut(rotated(found).orderBy("path").limit(k - n))
        kept.append(best)
        n += best.count()
        if n >= k:
            break
    return _all(kept).orderBy(F.size("path").desc(), "path")


def layering(e: DataFrame, least_hops: int = 2, most: int = 10) -> DataFrame:
    """Simple paths with their totals and times. Their number grows with the degree to the power of the hops."""
    return _all(paths(e, most)[least_hops - 1 :])


def heaviest_paths(e: DataFrame, hops: int, k: int = 100) -> DataFrame:
    """The k simple paths of so many hops with the largest totals, ties by their nodes.

    Bounds keep the paths few. The heaviest walk of j hops from each node, from j rounds of one join, bounds what a path can
    still gain; the k-th best of the paths that a few heavy links grow into bounds what it must reach. Exact: what is
    dropped can't be among the k."""
    step = cut(e.where("src <> dst").select("src", "dst", "total", "first_ts", "last_ts"))
    gains = [nodes_of(e).select("node", F.lit(0.0).alias("gain"))]
    for _ in range(hops - 1):
        more = step.join(gains[-1].withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.max(F.col("total") + F.col("gain")).alias("gain"))
        gains.append(cut(more))

    def grown(least: float | None, width: int | None) -> DataFrame:
        out = step.select(F.array("src", "dst").alias("path"), F.col("dst").alias("last"), "total", "first_ts", "last_ts")
        nxt = step.toDF("src", "dst", "t2", "f2", "l2")
        for left in range(hops - 1, -1, -1):
            hope = out.join(gains[left].withColumnRenamed("node", "last"), "last").withColumn("hope", F.col("total") + F.col("gain"))
            out = (hope if least is None else hope.where(F.col("hope") >= least)).select("path", "last", "total", "first_ts", "last_ts", "hope")
            # nested expressions of many hops are slow to plan
            out = cut(out.orderBy(F.desc("hope"), "path").limit(width) if width else out)
            if left:
                more = out.join(nxt, F.col("last") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
                out = more.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("last"), (F.col("total") + F.col("t2")).alias("total"), F.least("first_ts", "f2").alias("first_ts"), F.greatest("last_ts", "l2").alias("last_ts"))
        return out.orderBy(F.desc("total"), "path").limit(k)

    sample = grown(None, 20 * k).agg(F.count("*").alias("n"), F.min("total").alias("least")).first()
    least = sample["least"] - abs(sample["least"]) * 1e-12 if sample["n"] == k else None  # sums in another order may differ in their last digits
    return grown(least, None).select("path", "total", "first_ts", "last_ts")


def timed_layering(txns: DataFrame, hops: int = 3, hours: int = 48) -> DataFrame:
    """Each hop later than the one before, the whole within the hours; no node twice: ids, path, start, last, began, at, first_amount."""
    t = txns.where("sender_id <> receiver_id").select("transaction_id", "sender_id", "receiver_id", "ts", "amount")
    out = t.select(F.array("transaction_id").alias("ids"), F.array("sender_id", "receiver_id").alias("path"), F.col("sender_id").alias("start"), F.col("receiver_id").alias("last"), F.col("ts").alias("began"), F.col("ts").alias("at"), F.col("amount").alias("first_amount"))
    nxt = t.drop("amount").toDF("id2", "s2", "r2", "ts2")
    for _ in range(hops - 1):
        j = out.join(nxt, (F.col("last") == F.col("s2")) & (F.col("ts2") > F.col("at")) & (F.unix_micros("ts2") - F.unix_micros("began") < hours * 3_600_000_000) & ~F.array_contains("path", F.col("r2")))
        out = j.select(F.concat("ids", F.array("id2")).alias("ids"), F.concat("path", F.array("r2")).alias("path"), "start", F.col("r2").alias("last"), "began", F.col("ts2").alias("at"), "first_amount")
    return out


def return_legs(chains: DataFrame, txns: DataFrame, hours: int = 48, tolerance: float = 0.1) -> DataFrame:
    """G13, R020: the transactions that take a chain's money back: from its last node to its first, later than its last hop, within the hours of
    its first, by an amount that differs from the first hop's by at most the tolerance. chains: as timed_layering gives them; adds
    return_id, return_ts, return_amount. Amounts that are not positive return nothing.

    A join over two ranges: rows meet by the pair of nodes, a bucket of time and a bin of the logarithm of the amount, and a chain asks
    the bins that its range of amounts touches, so that a pair with very many transfers is not multiplied with itself. A bin is four times as wide as
    the tolerance, so most chains ask one or two."""
    span, width = hours * 3_600_000_000, -4 * math.log1p(-tolerance)
    bucket = lambda c: F.floor(F.unix_micros(c) / span)
    amount = lambda c: F.col(c).cast("double")
    legs = txns.where("amount > 0 AND sender_id <> receiver_id").select(
        F.col("sender_id").alias("last"), F.col("receiver_id").alias("start"), F.col("transaction_id").alias("return_id"), F.col("ts").alias("return_ts"), F.col("amount").alias("return_amount"),
        bucket("ts").alias("time_bin"), F.floor(F.ln(amount("amount")) / width).alias("amount_bin"),
    )
    reach = [F.floor((F.ln(amount("first_amount")) + math.log1p(d)) / width + e) for d, e in ((-tolerance, -1e-9), (tolerance, 1e-9))]  # a margin for rounding
    asked = chains.where("first_amount > 0").withColumn("time_bin", F.explode(F.sequence(bucket("at"), F.floor((F.unix_micros("began") + span) / span)))).withColumn("amount_bin", F.explode(F.sequence(*reach)))
    near = F.abs(F.col("return_amount") - F.col("first_amount")) <= F.lit(tolerance).cast("decimal(9,6)") * F.col("first_amount")
    found = asked.join(legs, ["last", "start", "time_bin", "amount_bin"]).where((F.col("return_ts") > F.col("at")) & (F.unix_micros("return_ts") - F.unix_micros("began") < span) & near)
    return found.drop("time_bin", "amount_bin")


def round_trips(txns: DataFrame, hops: Iterable[int], hours: int = 48, tolerance: float = 0.1) -> dict[int, DataFrame]:
    """G13, R020: for each number of hops the timed chains with their return legs. Every transfer of such a round leaves an account that receives and reaches
    one that sends, so chains are built over those transfers alone; the given ones are read once."""
    t = cut(txns.where("sender_id <> receiver_id").select("transaction_id", "sender_id", "receiver_id", "ts", "amount"))
    ends = {c: t.select(c).distinct() for c in ("sender_id", "receiver_id")}
    inner = t.join(ends["receiver_id"].toDF("sender_id"), "sender_id", "left_semi").join(ends["sender_id"].toDF("receiver_id"), "receiver_id", "left_semi")
    inner = cut(inner.select(t.columns))
    return {k: return_legs(timed_layering(inner, k, hours), inner, hours, tolerance) for k in hops}


def greedy_chain(txns: DataFrame, most: int = 10) -> DataFrame:
    """From each transaction follow the receiver's first outgoing transaction; layers, and whether it comes back."""
    first = cut(txns.groupBy(F.col("sender_id").alias("at")).agg(F.min_by("receiver_id", F.struct("ts", "transaction_id")).alias("to")))
    out = txns.select("transaction_id", F.col("sender_id").alias("origin"), F.array("sender_id", "receiver_id").alias("path"), F.col("receiver_id").alias("at"), (F.col("sender_id") == F.col("receiver_id")).alias("back"), F.lit(1).alias("layers"))
    for _ in range(most - 1):
        j = out.join(first, "at", "left")
        stop = F.col("back") | F.col("to").isNull() | (F.array_contains("path", F.col("to")) & (F.col("to") != F.col("origin")))
        back = ~stop & (F.col("to") == F.col("origin"))
        out = j.select(
            "transaction_id", "origin", F.when(stop | back, F.col("path")).otherwise(F.concat("path", F.array("to"))).alias("path"), F.when(stop, F.lit(None)).otherwise(F.col("to")).alias("at"),
            (F.col("back") | F.coalesce(back, F.lit(False))).alias("back"), (F.col("layers") + (~F.coalesce(stop, F.lit(True))).cast("int")).alias("layers"),
        )
    return out.select("transaction_id", "layers", "back").withColumn("layering", (F.col("layers") >= 3) | F.col("back"))


def weak_components(e: DataFrame) -> DataFrame:
    """(node, component): the smallest node that is reachable either way; labels jump along themselves."""
    both = cut(e.select("src", "dst").union(e.select("dst", "src")).where("src <> dst").distinct())
    label = cut(nodes_of(e).withColumn("component", F.col("node")))
    while True:
        near = both.join(label, both["dst"] == label["node"]).groupBy("src").agg(F.min("component").alias("near"))
        new = label.join(near, label["node"] == near["src"], "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = new.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = cut(new.join(jump, "component").select("node", "old", F.least("component", "further").alias("component")))
        label = new.select("node", "component")
        if new.where("component <> old").limit(1).count() == 0:
            break
    return label


def strong_components(e: DataFrame) -> DataFrame:
    """(node, component): the smallest node of those that reach each other. Each round takes labels forward to the smallest node that
    reaches a node, then searches back from the nodes that keep their own label, within it: these are whole components. Nodes without
    incoming or outgoing edges go first."""
    left, found = cut(e.where("src <> dst").select("src", "dst").distinct()), None
    while True:
        before = -1
        while (now := left.count()) != before:
            before = now
            left = cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        if not now:
            break
        label = cut(nodes_of(left).withColumn("component", F.col("node")))
        while True:
            came = left.join(label.select(F.col("node").alias("src"), "component"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("component").alias("came"))
            new = cut(label.join(came, "node").select("node", F.col("component").alias("old"), F.least("component", "came").alias("component")))
            label = new.select("node", "component")
            if new.where("component <> old").limit(1).count() == 0:
                break
        inside = left.join(label.toDF("src", "component"), "src").join(label.toDF("dst", "other"), "dst")
        inside = cut(inside.where("component = other").select("src", "dst", "component"))
        seen = front = cut(label.where("node = component"))
        while True:
            back = inside.join(front.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "component").distinct()
            front = cut(back.join(seen.select("node"), "node", "left_anti"))
            if front.limit(1).count() == 0:
                break
            seen = cut(seen.unionByName(front))
        found = seen if found is None else found.unionByName(seen)
        left = cut(left.join(seen.select(F.col("node").alias("src")), "src", "left_anti").join(seen.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
    if found is None:
        return nodes_of(e).withColumn("component", F.col("node"))
    return nodes_of(e).join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def flow_statistics(e: DataFrame) -> DataFrame:
    """G17."""
    n, parts = nodes_of(e).agg(F.count("*").alias("nodes")), weak_components(e).agg(F.count_distinct("component").alias("weak"))
    strong = strong_components(e).agg(F.count_distinct("component").alias("strong"))
    flow = e.agg(F.count("*").alias("edges"), F.sum("total").alias("total"), F.avg("total").alias("average"))
    out = flow.crossJoin(n).crossJoin(parts).crossJoin(strong)
    return out.withColumns({"density": F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), "connected": F.col("weak") == 1})


def clustering(e: DataFrame) -> DataFrame:
    """Undirected local coefficient. Edges point from the end of the smaller degree (ties by node) to the other, so that no node has more than
    the root of twice the edges of them, however many neighbours it has; two edges from one node are closed by an edge between their ends."""
    pairs = cut(e.where("src <> dst").select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct())
    degree = cut(pairs.select(F.explode(F.array("x", "y")).alias("node")).groupBy("node").agg(F.count("*").alias("d")))
    known = pairs.join(degree.toDF("x", "dx"), "x").join(degree.toDF("y", "dy"), "y")
    ends = F.array_sort(F.array(F.struct(F.col("dx").alias("d"), F.col("x").alias("node")), F.struct(F.col("dy").alias("d"), F.col("y").alias("node"))))
    u = cut(known.select(ends[0]["node"].alias("a"), ends[1].alias("b")))
    two = u.join(u.select("a", F.col("b").alias("c")), "a").where("b < c").select("a", F.col("b.node").alias("b"), F.col("c.node").alias("c"))
    closing = cut(u.select(F.col("a").alias("b"), F.col("b.node").alias("c")).join(u.select("b.node").toDF("b").distinct(), "b", "left_semi"))
    tri = two.join(closing, ["b", "c"]).select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("t"))
    return nodes_of(e).join(degree, "node", "left").join(tri, "node", "left").select("node", F.when(F.col("d") > 1, 2 * F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0).alias("clustering"))


def neighbourhood(e: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """Edges among the nodes within some hops, either way, of the start nodes."""
    both = e.select("src", "dst").union(e.select("dst", "src")).distinct()
    near = start.select("node").distinct()
    for _ in range(hops):
        near = near.union(both.join(near, both["src"] == near["node"]).select(F.col("dst").alias("node"))).distinct()
    near = cut(near)
    return e.join(near.withColumnRenamed("node", "src"), "src", "left_semi").join(near.withColumnRenamed("node", "dst"), "dst", "left_semi")


def communities(e: DataFrame, rounds: int = 30, levels: int = 12, passes: int = 3, least_gain: float = 1e-6) -> DataFrame:
    """Communities of high modularity in the undirected weighted graph, and their smallest nodes' names: node, community.

    A level moves nodes to the neighbouring community of the largest gain until no node gains by a move; then each community
    becomes one node of a coarser graph, whose inner weight is its loop, and the next level goes on with that, until a level
    gains less modularity than `least_gain`. Then the nodes themselves may move again from where that has brought them, and a further pass goes
    on from there. In a round only a share of the nodes that want to move do, dealt by a hash: half, and
    fewer after a round that lowered the modularity, because two neighbours that move at once may both be wrong. The
    best labels of a level are the ones that count, so the result is never below that of the singletons. Ties go to the smallest community.
    The modularity of each round's labels falls out of the sums that the next moves need."""
    e = cut(e.select("src", "dst", "weight"))  # read four times
    both = e.where("src <> dst").union(e.where("src <> dst").select("dst", "src", "weight"))
    graph = cut(both.groupBy("src", "dst").agg(F.sum("weight").alias("w")))
    m2 = graph.agg(F.sum("w")).first()[0]
    whole = cut(nodes_of(e).withColumn("c", F.col("node")))
    if not m2:
        return whole.select("node", F.col("c").alias("community"))
    reached = -1.0
    for _ in range(passes):
        coarse, began = None, reached
        for level in range(levels):
            label, quality = _best_moves(graph if coarse is None else coarse, m2, rounds, whole if level == 0 else None)
            if quality < reached + least_gain:
                break
            reached = quality
            own = label.select(F.col("node").alias("old"), F.col("c").alias("new"))
            whole = whole.join(own, F.col("node" if level == 0 else "c") == F.col("old"), "left")
            whole = cut(whole.select("node", F.coalesce("new", "c").alias("c")))  # a node without edges stays alone
            a, b = label.select(F.col("node").alias("src"), F.col("c").alias("a")), label.select(F.col("node").alias("dst"), F.col("c").alias("b"))
            coarse = (graph if coarse is None else coarse).join(a, "src").join(b, "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst"))
            coarse = cut(coarse.agg(F.sum("w").alias("w")))
        if reached < began + least_gain:
            break
    smallest = whole.groupBy("c").agg(F.min("node").alias("community"))
    return whole.join(smallest, "c").select("node", "community")


def _best_moves(graph: DataFrame, m2: float, rounds: int, start: DataFrame | None) -> tuple[DataFrame, float]:
    """(node, c) of the best labels met from `start` on (by default each node's own), and their modularity. graph: src, dst, w in both directions, with loops.
    A round moves its links twice, to the labels of their ends and to the nodes that may move; sums of communities and of nodes travel with them."""
    label = graph.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k"))
    label = cut(label.withColumn("c", F.col("node")) if start is None else label.join(start.select("node", "c"), "node"))
    loops = graph.where("src = dst").agg(F.sum("w")).first()[0] or 0.0
    links = cut(graph.where("src <> dst").join(label.select(F.col("node").alias("src"), "k"), "src").select("src", "dst", "w", "k"))
    best, best_quality, deal, last = None, None, 2, None
    for r in range(rounds + 1):
        known = label.join(label.groupBy("c").agg(F.sum("k").alias("total")), "c")
        near = links.join(known.select(F.col("node").alias("dst"), "c", "total"), "dst").select(F.col("src").alias("node"), "k", "c", "total", "w", F.lit(False).alias("stays"))
        to = near.unionByName(known.select("node", "k", "c", "total", F.lit(0.0).alias("w"), F.lit(True).alias("stays"))).repartition("node")
        to = to.groupBy("node", "c").agg(F.sum("w").alias("w"), F.max("stays").alias("stays"), F.first("k").alias("k"), F.first("total").alias("total"))
        to = to.withColumn("gain", F.col("w") - F.col("k") * (F.col("total") - F.when(F.col("stays"), F.col("k")).otherwise(0.0)) / m2)
        found = to.groupBy("node").agg(
            F.first("k").alias("k"), F.min_by("c", F.struct(-F.col("gain"), F.col("c"))).alias("to"), F.max("gain").alias("gain"),
            *(F.max(F.when(F.col("stays"), F.col(c))).alias(n) for c, n in (("c", "own"), ("gain", "stay"), ("w", "inside"), ("total", "around"))),
        )
        found = cut(found.withColumn("wants", F.col("gain") > F.col("stay") + 1e-9 * m2))
        sums = found.agg(F.sum("inside").alias("inside"), F.sum(F.col("k") * F.col("around")).alias("squares"), F.count_if("wants").alias("wants")).first()
        quality = (sums["inside"] + loops) / m2 - sums["squares"] / m2**2
        if best_quality is None or quality > best_quality:
            best, best_quality = found.select("node", F.col("own").alias("c")), quality
        if not sums["wants"] or r == rounds:
            break
        deal = min(16, deal * 2) if last is not None and quality < last else deal
        last = quality
        moves = F.col("wants") & (F.pmod(F.xxhash64("node", F.lit(r)), F.lit(deal)) == 0)
        label = found.select("node", "k", F.when(moves, F.col("to")).otherwise(F.col("own")).alias("c"))
    return best, best_quality


def modularity(e: DataFrame, label: DataFrame) -> float:
    und = e.where("src <> dst").select("src", "dst", "weight").union(e.where("src <> dst").select("dst", "src", "weight"))
    m2 = und.agg(F.sum("weight")).first()[0] or 1.0
    both = und.join(label.toDF("src", "a"), "src").join(label.toDF("dst", "b"), "dst")
    inside = both.where("a = b").agg(F.sum("weight")).first()[0] or 0.0
    squares = both.groupBy("a").agg(F.sum("weight").alias("k")).agg(F.sum(F.col("k") * F.col("k"))).first()[0] or 0.0
    return inside / m2 - squares / m2**2


def hubs(measures: DataFrame, share: float = 0.9) -> DataFrame:
    """Measures: node, rank, betweenness. Those at or above a percentile in either."""
    cuts = measures.agg(F.percentile("rank", F.lit(share)).alias("p"), F.percentile("betweenness", F.lit(share)).alias("q"))
    out = measures.crossJoin(F.broadcast(cuts)).where("rank >= p OR betweenness >= q")
    return out.select("node", "rank", "betweenness", (F.col("rank") + F.col("betweenness")).alias("score")).orderBy(F.desc("score"), "node")


def risk_scores(measures: DataFrame, share: float = 0.9, hub: int = 10) -> DataFrame:
    """Measures: node, centrality, betweenness, rank, out_degree, in_degree. The risk, whether the degree is above a percentile, and whether it is a hub."""
    degree = F.col("out_degree") + F.col("in_degree")
    cuts = measures.agg(F.percentile(degree, F.lit(share)).alias("p"))  # one row
    out = measures.withColumn("risk", 0.3 * F.col("centrality") + 0.4 * F.col("betweenness") + 0.3 * F.col("rank")).crossJoin(F.broadcast(cuts))
    return out.withColumns({"above_p90": degree > F.col("p"), "hub": F.col("out_degree") > hub}).drop("p")


def shells(degrees: DataFrame, most: int = 50) -> DataFrame:
    """Nodes of more edges than a person has."""
    return degrees.where(F.col("out_degree") + F.col("in_degree") > most)


def mules(e: DataFrame, between: DataFrame, community: DataFrame, share: float = 0.95, least: int = 2) -> DataFrame:
    """Nodes of the highest betweenness whose neighbours lie in several communities: node, betweenness, n_communities."""
    cuts = between.agg(F.percentile("betweenness", F.lit(share)).alias("p"))  # one row
    top = between.crossJoin(F.broadcast(cuts)).where("betweenness >= p AND betweenness > 0").select("node", "betweenness")
    both = e.where("src <> dst").select(F.col("src").alias("node"), F.col("dst").alias("other")).union(e.where("src <> dst").select("dst", "src")).distinct()
    near = both.join(community.select(F.col("node").alias("other"), "community"), "other").groupBy("node").agg(F.count_distinct("community").alias("n_communities"))
    return top.join(near, "node").where(F.col("n_communities") >= least)


def network_features(txns: DataFrame, measures: DataFrame) -> DataFrame:
    """F8: measures: node, out_degree, in_degree, betweenness, rank, clustering. Of each sender; 0 for one that is not in the graph."""
    own = measures.select(F.col("node").alias("sender_id"), (F.col("out_degree") + F.col("in_degree")).alias("degree"), "betweenness", F.col("rank").alias("pagerank"), "clustering")
    out = txns.join(own, "sender_id", "left").fillna(0, ["degree", "betweenness", "pagerank", "clustering"])
    return out.withColumn("hub", F.col("degree") > 10)


def community_sizes(txns: DataFrame, community: DataFrame) -> DataFrame:
    """F8: the size of the sender's community."""
    sizes = community.groupBy("community").agg(F.count("*").alias("community_size"))
    own = community.join(sizes, "community").select(F.col("node").alias("sender_id"), "community_size")
    return txns.join(own, "sender_id", "left").fillna(0, ["community_size"])


def layered_links(e: DataFrame) -> DataFrame:
    """Links that lie on a simple path of at least three nodes: src, dst. Such a link has another one before it or after it that
    leads from, or to, a third node, so the ends' degrees tell and no path is listed."""
    links = e.where("src <> dst").select("src", "dst").distinct()
    into, out = links.groupBy(F.col("dst").alias("src")).agg(F.count("*").alias("before")), links.groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("after"))
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("back"))
    known = links.join(into, "src", "left").join(out, "dst", "left").join(back, ["src", "dst"], "left").fillna(0, ["before", "after", "back"])
    return known.where("before > back OR after > back").select("src", "dst")


def verdict_measures(e: DataFrame, measures: DataFrame, most: int = 10) -> DataFrame:
    """What network_verdict asks for of each node. measures: node, rank, betweenness, cycle."""
    strong = strong_components(e)
    m = measures.select("node", "rank", "betweenness", (F.coalesce("cycle", F.lit(0)).between(2, most)).alias("in_cycle")).join(communities(e), "node").join(strong, "node")
    m = m.join(strong.groupBy("component").agg(F.count("*").alias("component_size")), "component")
    return m.join(hubs(measures).select("node", F.lit(True).alias("hub")), "node", "left").fillna(False, ["hub"])


def network_verdict(txns: DataFrame, measures: DataFrame, layers: DataFrame) -> DataFrame:
    """Measures: node, rank, betweenness, in_cycle, community, component, component_size, hub; layers: src, dst."""
    m = measures.select(*(F.col(c).alias(f"s_{c}") for c in measures.columns))
    r = measures.select(*(F.col(c).alias(f"r_{c}") for c in measures.columns))
    out = txns.join(m, txns["sender_id"] == m["s_node"], "left").join(r, txns["receiver_id"] == r["r_node"], "left")
    out = out.join(layers.select(F.col("src").alias("sender_id"), F.col("dst").alias("receiver_id"), F.lit(True).alias("layered")).distinct(), ["sender_id", "receiver_id"], "left")
    tests = ((F.col("s_rank") > 0.01, 0.6), (F.col("s_betweenness") > 0.01, 0.65), (F.col("s_in_cycle") & F.col("r_in_cycle"), 0.9), (F.col("s_community") != F.col("r_community"), 0.5), (F.col("layered"), 0.85), (F.col("s_hub"), 0.7),
             ((F.col("s_component") == F.col("r_component")) & (F.col("s_component_size") > 1), 0.75))
    risk = F.greatest(F.lit(0.0), *(F.when(F.coalesce(t, F.lit(False)), v).otherwise(0.0) for t, v in tests))
    return out.withColumn("network_risk", risk).withColumn("network_alert", F.col("network_risk") >= 0.75)
