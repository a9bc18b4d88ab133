"""Graph measures on known and random graphs against plain searches: shortest-path measures in blocks, ranks, communities, cycles, paths and return legs."""

import random
from collections import deque
from datetime import datetime, timedelta
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlynx.operators import network as G


def graph(spark, pairs):
    return spark.createDataFrame([(a, b, float(w[0]) if w else 1.0) for a, b, *w in pairs], "src long, dst long, weight double")


def with_totals(spark, pairs):
    t0 = datetime(2024, 1, 1)
    rows = [(a, b, float(w), float(w), t0 + timedelta(hours=k), t0 + timedelta(hours=2 * k)) for k, (a, b, w) in enumerate(pairs)]
    return spark.createDataFrame(rows, "src long, dst long, weight double, total double, first_ts timestamp, last_ts timestamp")


def searched(pairs):
    """By node: betweenness, nodes that reach it, the sum of their distances, and its shortest cycle; one source at a time."""
    nodes = sorted({x for p in pairs for x in p[:2]})
    after = {v: sorted({b for a, b, *_ in pairs if a == v and b != v}) for v in nodes}
    between, reached, far, cycle = (dict.fromkeys(nodes, 0) for _ in range(4))
    for s in nodes:
        dist, sigma, before, order, queue = {s: 0}, {s: 1}, {}, [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in after[v]:
                if w not in dist:
                    dist[w], sigma[w] = dist[v] + 1, 0
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    before.setdefault(w, []).append(v)
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before.get(w, ()):
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                between[w] += delta[w]
                reached[w] += 1
                far[w] += dist[w]
        back = [dist[v] + 1 for v in order if s in after[v]]
        cycle[s] = min(back) if back else None
    n = len(nodes)
    return {v: (round(between[v] / ((n - 1) * (n - 2)) if n > 2 else 0.0, 9), reached[v], far[v], cycle[v]) for v in nodes}


def dense(seed, n, m):
    rnd = random.Random(seed)
    return sorted({(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)})


GRAPHS = {
    "chain with a way round": [(k, k + 1) for k in range(8)] + [(0, 4), (6, 1), (3, 3)],
    "random": dense(3, 30, 90),
    "two parts and a star": [(0, k) for k in range(1, 9)] + [(k, 0) for k in range(1, 5)] + [(20, 21), (21, 20), (21, 22), (30, 30)],
}


@pytest.mark.parametrize("name", GRAPHS)
@pytest.mark.parametrize("most_rows", [10_000, 150])
def test_path_measures_in_blocks(spark, name, most_rows):
    got = {r["node"]: (round(r["betweenness"], 9), r["reached"], r["far"], r["cycle"]) for r in G.path_measures(graph(spark, GRAPHS[name]), most_rows).collect()}
    assert got == searched(GRAPHS[name])


def test_search_of_a_block_holds_no_more_than_its_pairs(spark):
    pairs = GRAPHS["random"]
    links = graph(spark, pairs)
    block = spark.createDataFrame([(0,), (7,)], "node long")
    assert G.distances(links, block).count() <= 2 * len({x for p in pairs for x in p})
    assert G.block_rows(links) >= 100_000


def test_ranks(spark):
    pairs = GRAPHS["random"] + [(40, 0), (41, 40)]
    nodes = sorted({x for p in pairs for x in p})
    at = {v: i for i, v in enumerate(nodes)}
    a = np.zeros((len(nodes), len(nodes)))
    for s, d in pairs:
        a[at[s], at[d]] = 1
    out = a.sum(1, keepdims=True)
    step = np.where(out > 0, a / np.maximum(out, 1), 1 / len(nodes))
    rank = np.full(len(nodes), 1 / len(nodes))
    x = np.ones(len(nodes))
    for _ in range(500):
        rank = 0.15 / len(nodes) + 0.85 * rank @ step
        x = x + x @ a
        x /= np.linalg.norm(x)
    e = graph(spark, pairs)
    assert {r["node"]: round(r["rank"], 7) for r in G.pagerank(e, 200, tolerance=1e-11).collect()} == {v: round(rank[at[v]], 7) for v in nodes}
    assert {r["node"]: round(r["x"], 5) for r in G.eigenvector(e, 200, tolerance=1e-10).collect()} == {v: round(x[at[v]], 5) for v in nodes}


def modularity(pairs, label):
    w = {}
    for a, b, *x in pairs:
        if a != b:
            for k in ((a, b), (b, a)):
                w[k] = w.get(k, 0.0) + (x[0] if x else 1.0)
    m2, degree = sum(w.values()), {}
    for (a, _), v in w.items():
        degree[label[a]] = degree.get(label[a], 0.0) + v
    return sum(v for (a, b), v in w.items() if label[a] == label[b]) / m2 - sum(d * d for d in degree.values()) / m2**2


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        for k in range(len(rest)):
            yield [*rest[:k], [items[0], *rest[k]], *rest[k + 1 :]]
        yield [[items[0]], *rest]


def best_of_all(pairs):
    nodes = sorted({x for p in pairs for x in p[:2]})
    return max(modularity(pairs, {v: k for k, part in enumerate(p) for v in part}) for p in partitions(nodes))


def clique(nodes):
    return [(a, b) for a in nodes for b in nodes if a < b]


COMMUNITIES = {
    "two cliques and a bridge": clique(range(4)) + clique(range(4, 8)) + [(3, 4)],
    "three triangles in a ring": clique(range(3)) + clique(range(3, 6)) + clique(range(6, 9)) + [(2, 3), (5, 6), (8, 0)],
    "weights": [(0, 1, 9.0), (1, 2, 1.0), (2, 3, 9.0), (3, 4, 1.0), (4, 5, 9.0), (5, 0, 1.0), (0, 3, 2.0), (6, 0, 0.5), (6, 2, 0.5)],
}


def test_communities_of_a_graph_without_any_end_where_no_node_gains_by_a_move(spark):
    pairs = dense(8, 9, 17)
    label = {r["node"]: r["community"] for r in G.communities(graph(spark, pairs)).collect()}
    now = modularity(pairs, label)
    assert now >= 0.9 * best_of_all(pairs)
    assert all(modularity(pairs, label | {v: c}) <= now + 1e-9 for v in label for c in set(label.values()))


@pytest.mark.parametrize("name", COMMUNITIES)
def test_communities_come_near_the_best(spark, name):
    pairs = COMMUNITIES[name]
    e = graph(spark, pairs)
    found = G.communities(e)
    label = {r["node"]: r["community"] for r in found.collect()}
    assert all(label[v] <= v and label[label[v]] == label[v] for v in label)
    best = best_of_all(pairs)
    assert modularity(pairs, label) >= best - 0.02 * abs(best) - 1e-9
    assert modularity(pairs, label) >= modularity(pairs, {v: v for v in label})
    assert abs(G.modularity(e, found) - modularity(pairs, label)) < 1e-9


def test_communities_of_a_larger_graph_contract(spark):
    rnd = random.Random(1)
    pairs = [(a, b) for a in range(60) for b in range(a + 1, 60) if rnd.random() < (0.7 if a // 10 == b // 10 else 0.03)]
    label = {r["node"]: r["community"] for r in G.communities(graph(spark, pairs)).collect()}
    assert modularity(pairs, label) >= 0.98 * modularity(pairs, {v: v // 10 for v in label})
    alone = G.communities(graph(spark, [(1, 1), (2, 2)]))
    assert sorted(map(tuple, alone.collect())) == [(1, 1), (2, 2)]


def all_cycles(pairs, most):
    after = {}
    for a, b, *_ in pairs:
        if a != b:
            after.setdefault(a, set()).add(b)
    out = []

    def go(path):
        for w in after.get(path[-1], ()):
            if w == path[0] and len(path) > 1:
                out.append(tuple(path))
            elif w > path[0] and w not in path and len(path) < most:
                go([*path, w])

    for v in sorted(after):
        go([v])
    return sorted(out)


SPARSE = [(k, (k + 1) % 7) for k in range(7)] + [(7, 8), (8, 9), (9, 7), (2, 5), (5, 1), (4, 4), (9, 10), (10, 11), (11, 12), (12, 13), (13, 14), (6, 20), (20, 21), (1, 0), (3, 0)]


@pytest.mark.parametrize(("pairs", "most"), [(SPARSE, 10), (dense(0, 8, 30), 8)])
def test_cycles(spark, pairs, most):
    e = graph(spark, pairs)
    want = all_cycles(pairs, most)
    assert sorted(tuple(r["path"]) for r in G.cycles(e, most).collect()) == want
    assert max(map(len, want)) >= 7
    if most < 10:
        return
    turned = sorted(((*c[k:], *c[:k]) for c in want for k in range(len(c))), key=lambda c: (-len(c), c))
    assert sorted(tuple(r["path"]) for r in G.cycles(e, most, rotations=True).collect()) == sorted(turned)
    assert [tuple(r["path"]) for r in G.longest_cycles(e, most, 12).collect()] == turned[:12]


def all_paths(pairs, hops):
    weight = {(a, b): w for a, b, w in pairs if a != b}
    nodes = sorted({x for p in pairs for x in p[:2]})
    return [(p, sum(weight[x] for x in zip(p, p[1:]))) for p in permutations(nodes, hops + 1) if all(x in weight for x in zip(p, p[1:]))]


def test_paths(spark):
    rnd = random.Random(6)
    pairs = [(a, b, rnd.randrange(1, 50)) for a, b in dense(2, 7, 24)]
    e = with_totals(spark, pairs)
    for hops, k in ((3, 5), (5, 20), (6, 1000)):
        want = sorted(all_paths(pairs, hops), key=lambda x: (-x[1], x[0]))
        assert [(tuple(r["path"]), r["total"]) for r in G.heaviest_paths(e, hops, k).collect()] == want[:k]
    line = with_totals(spark, [(k, k + 1, 1) for k in range(12)])
    assert max(len(r["path"]) for r in G.layering(line, 2, 9).collect()) == 10
    assert sorted(tuple(r["path"]) for r in G.layering(e, 2, 3).collect()) == sorted(p for h in (2, 3) for p, _ in all_paths(pairs, h))


def test_layered_links(spark):
    for pairs in (SPARSE, dense(5, 6, 9), [(1, 2), (2, 1)], [(1, 2), (2, 1), (2, 2)]):
        own = [(a, b, 1) for a, b in pairs if a != b]
        want = {x for p, _ in all_paths(own, 2) for x in zip(p, p[1:])}
        assert {tuple(r) for r in G.layered_links(graph(spark, pairs)).collect()} == want


def test_round_trips_follow_only_transfers_that_can_close(spark, monkeypatch):
    rnd = random.Random(3)
    t0 = datetime(2024, 1, 1)
    rows = [(k, rnd.choice([*range(4)] * 20 + [*range(100, 160)]), rnd.choice([*range(4)] * 2 + [*range(200, 203)]), t0 + timedelta(minutes=rnd.randrange(4000)), rnd.choice([100, 91, 109.99, 500, 0])) for k in range(300)]
    t = spark.createDataFrame([(*r[:4], float(r[4])) for r in rows], "transaction_id long, sender_id long, receiver_id long, ts timestamp, amount double").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    seen, layering = [], G.timed_layering
    monkeypatch.setattr(G, "timed_layering", lambda x, *a: seen.append(x.count()) or layering(x, *a))
    got = sorted((*r["ids"], r["return_id"]) for r in G.round_trips(t, [2])[2].collect())
    assert seen == [sum(r[1] < 4 and r[2] < 4 and r[1] != r[2] for r in rows)]
    assert len(got) > 10 and got == sorted((*r["ids"], r["return_id"]) for r in G.return_legs(layering(t, 2), t).collect())


def test_return_legs(spark):
    rnd = random.Random(11)
    t0 = datetime(2024, 1, 1)
    rows = [(k, rnd.randrange(4), rnd.randrange(4), t0 + timedelta(minutes=rnd.randrange(6000)), rnd.choice([100, 90, 110, 89, 111, 1000, 0, -5])) for k in range(150)]
    t = spark.createDataFrame([(*r[:4], float(r[4])) for r in rows], "transaction_id long, sender_id long, receiver_id long, ts timestamp, amount double").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    chains = G.timed_layering(t, hops=2)
    got = sorted((*r["ids"], r["return_id"]) for r in G.return_legs(chains, t).collect())
    span = timedelta(hours=48)
    want = []
    for a in rows:
        for b in rows:
            if a[1] != a[2] == b[1] != b[2] and a[1] != b[2] and a[3] < b[3] < a[3] + span:
                for r in rows:
                    if r[1] == b[2] and r[2] == a[1] and b[3] < r[3] < a[3] + span and a[4] > 0 and r[4] > 0 and 10 * abs(r[4] - a[4]) <= a[4]:
                        want.append((a[0], b[0], r[0]))
    assert got == sorted(want) and want


def test_verdict_hubs_and_risk(spark):
    pairs = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (5, 6)] + [(7, k) for k in range(8, 20)]
    e = with_totals(spark, [(a, b, 1) for a, b in pairs])
    m = G.cut(G.pagerank(e).join(G.path_measures(e), "node").join(G.degrees(e), "node"))
    verdicts = G.verdict_measures(e, m)
    known = {r["node"]: r for r in verdicts.collect()}
    assert {v for v in known if known[v]["in_cycle"]} == {0, 1, 2} and known[0]["component_size"] == 3 and known[5]["component_size"] == 1
    t = spark.createDataFrame([(1, 0, 1), (2, 2, 3), (3, 5, 6), (4, 7, 8), (5, 99, 98)], "transaction_id long, sender_id long, receiver_id long")
    out = {r["transaction_id"]: (r["network_risk"], r["network_alert"]) for r in G.network_verdict(t, verdicts, G.layered_links(e)).collect()}
    assert out[1] == (0.9, True) and out[2] == (0.85, True) and out[5] == (0.0, False)
    assert out[3][0] in (0.6, 0.7) and not out[3][1] and out[4][0] in (0.6, 0.7)
    ranks, between = ({r["node"]: r[c] for r in m.collect()} for c in ("rank", "betweenness"))
    top = {v for v in ranks if ranks[v] >= np.quantile(list(ranks.values()), 0.9) or between[v] >= np.quantile(list(between.values()), 0.9)}
    assert {r["node"] for r in G.hubs(m).collect()} == top
    risk = {r["node"]: r for r in G.risk_scores(m).collect()}
    assert risk[7]["hub"] and risk[7]["above_p90"] and not risk[0]["hub"]
    assert abs(risk[2]["risk"] - (0.3 * 3 / 19 + 0.4 * between[2] + 0.3 * ranks[2])) < 1e-9
    assert [r["node"] for r in G.shells(G.degrees(e), most=11).collect()] == [7]
    community = spark.createDataFrame([(v, v // 3) for v in ranks], "node long, community long")
    found = {r["node"]: r["n_communities"] for r in G.mules(e, G.betweenness(e), community).collect()}
    assert found == {v: n for v, n in {2: 2}.items() if between[v] >= np.quantile(list(between.values()), 0.95)}
    features = {r["transaction_id"]: r for r in G.network_features(t, m.join(G.clustering(e), "node")).collect()}
    assert features[4]["degree"] == 12 and features[4]["hub"] and features[5]["degree"] == 0 and features[1]["clustering"] == 1.0
    assert {r["transaction_id"]: r["community_size"] for r in G.community_sizes(t, community).collect()} == {1: 3, 2: 3, 3: 3, 4: 3, 5: 0}


def test_search_needs_no_block_for_pairs_that_cannot_be(spark, monkeypatch):
    """Many senders and few receivers: what is alive at once is what sources reach, not the square of the nodes."""
    pairs = [(100 + k, k % 7) for k in range(400)] + [(k, (k + 1) % 7) for k in range(7)]
    runs = []
    search = G._search
    monkeypatch.setattr(G, "_search", lambda *a: runs.append(1) or search(*a))
    got = {r["node"]: (round(r["betweenness"], 9), r["reached"], r["far"], r["cycle"]) for r in G.path_measures(graph(spark, pairs), 4_000).collect()}
    assert got == searched(pairs) and len(runs) == 1


def test_triangles_of_a_node_with_many_neighbours(spark, monkeypatch):
    """The smallest node has 2,000 neighbours, whose pairs are 2,000,000; only pairs of edges that leave a node of smaller degree are made."""
    pairs = [(0, k) for k in range(1, 2001)] + [(k, k + 1) for k in range(1, 2000, 2)]
    made = []
    monkeypatch.setattr(G, "cut", lambda df: made.append(df) or df.localCheckpoint())
    e = graph(spark, pairs)
    got = {r["node"]: r["clustering"] for r in G.clustering(e).collect()}
    assert got[0] == pytest.approx(2 * 1000 / (2000 * 1999)) and all(got[k] == 1.0 for k in range(1, 2001))
    u = next(d for d in made if d.columns == ["a", "b"])
    assert u.groupBy("a").count().agg(F.max("count")).first()[0] <= 2


def test_communities_read_the_edges_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(w):
        read.add(1)
        return w

    pairs = [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (0, 3)]
    got = {r["node"]: r["community"] for r in G.communities(graph(spark, pairs).coalesce(1).withColumn("weight", seen("weight")), rounds=4, levels=1, passes=1).collect()}
    assert len(got) == 6 and read.value == len(pairs)
