"""G1-G24, F8 over all transfers among the driver's customers."""

from pyspark.sql import functions as F

from ..operators import network as G
from .bindings import query, txn

E = "edges"
NODES = "nodes AS (SELECT DISTINCT unnest([src, dst]) AS node FROM edges)"
LINKS = f"{NODES}, links AS (SELECT src, dst FROM edges WHERE src <> dst), c AS (SELECT count(*)::DOUBLE AS n FROM nodes)"


def edges(spark, sf):
    return G.edges(txn(spark, sf))


def text(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def minute(*names):
    return [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in names]


@query("g1_edges", "txn", """
SELECT sender_id AS src, receiver_id AS dst, count(*) AS n, sum(amount)::DOUBLE AS total, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts,
  arg_min(amount, (ts, transaction_id))::DOUBLE AS first_amount FROM txn GROUP BY 1, 2""")  # fmt: skip
def g1(spark, sf):
    return edges(spark, sf).drop("weight").withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_ts", "last_ts")})


@query("g2_vertices", "txn", "SELECT node, count(*) AS n FROM (SELECT unnest([sender_id, receiver_id]) AS node FROM txn) GROUP BY 1")
def g2(spark, sf):
    return G.vertices(txn(spark, sf))


# a transfer to oneself is an outgoing and an incoming edge
_DEGREES = "deg AS (SELECT node, count(*) FILTER (o) AS out_degree, count(*) FILTER (NOT o) AS in_degree FROM (SELECT src AS node, true AS o FROM edges UNION ALL SELECT dst, false FROM edges) GROUP BY 1)"


@query("g3_degrees", E, f"{NODES}, {_DEGREES} SELECT node, out_degree, in_degree, round((out_degree + in_degree) / ((SELECT count(*) FROM nodes) - 1), 6) AS centrality FROM deg")
def g3(spark, sf):
    return G.degrees(edges(spark, sf)).withColumn("centrality", F.round("centrality", 6))


# a node without outgoing edges deals its rank to all; so many rounds that nothing changes any more
_RANK = """o AS (SELECT src, sum(total)::DOUBLE AS out FROM edges GROUP BY 1),
p AS (SELECT e.src, e.dst, e.total::DOUBLE / o.out AS p FROM edges e JOIN o ON o.src = e.src UNION ALL SELECT a.node, b.node, 1 / c.n FROM nodes a, nodes b, c WHERE a.node NOT IN (SELECT src FROM o) UNION ALL SELECT node, node, 0 FROM nodes),
pr AS (SELECT 0 AS k, node, 1 / c.n AS rank FROM nodes, c UNION ALL SELECT pr.k + 1, p.dst, 0.15::DOUBLE / (SELECT n FROM c) + 0.85::DOUBLE * sum(pr.rank * p.p) FROM pr JOIN p ON p.src = pr.node WHERE pr.k < 150 GROUP BY pr.k, p.dst),
ranks AS (SELECT node, rank FROM pr WHERE k = 150)"""


@query("g4_pagerank", E, f"{LINKS}, {_RANK} SELECT node, round(rank, 8) AS rank FROM ranks", recursive=True)
def g4(spark, sf):
    return G.pagerank(edges(spark, sf), rounds=200, tolerance=1e-12).withColumn("rank", F.round("rank", 8))


# distances, numbers of shortest paths level by level, and their shares through each node
_PATHS = """d AS (SELECT node AS s, node AS t, 0 AS k FROM nodes UNION SELECT d.s, l.dst, d.k + 1 FROM d JOIN links l ON l.src = d.t WHERE d.k < 20),
m AS (SELECT s, t, min(k) AS k FROM d GROUP BY 1, 2),
sg AS (SELECT node AS s, node AS t, 0 AS k, 1::DOUBLE AS sigma FROM nodes UNION ALL SELECT r.s, l.dst, r.k + 1, sum(r.sigma) FROM sg r JOIN links l ON l.src = r.t JOIN m ON m.s = r.s AND m.t = l.dst AND m.k = r.k + 1 GROUP BY r.s, l.dst, r.k),
through AS (SELECT a.t AS node, sum(a.sigma * b.sigma / x.sigma) AS b FROM sg a JOIN sg b ON b.s = a.t JOIN sg x ON x.s = a.s AND x.t = b.t AND x.k = a.k + b.k WHERE a.k > 0 AND b.k > 0 GROUP BY 1),
bt AS (SELECT node, coalesce(through.b, 0) / ((c.n - 1) * (c.n - 2)) AS betweenness FROM nodes CROSS JOIN c LEFT JOIN through USING (node))"""


@query("g5_betweenness", E, f"{LINKS}, {_PATHS} SELECT node, round(betweenness, 6) AS betweenness FROM bt", recursive=True)
def g5(spark, sf):
    return G.betweenness(edges(spark, sf)).withColumn("betweenness", F.round("betweenness", 6))


@query("g6_closeness", E, f"""{LINKS}, {_PATHS}
SELECT t AS node, round(CASE WHEN sum(k) > 0 THEN (count(*) - 1) / sum(k) * (count(*) - 1) / ((SELECT n FROM c) - 1) ELSE 0 END, 6)::DOUBLE AS closeness FROM m GROUP BY 1""", recursive=True)  # fmt: skip
def g6(spark, sf):
    return G.closeness(edges(spark, sf)).withColumn("closeness", F.round("closeness", 6))


@query("g7_eigenvector", E, f"""{LINKS}, both_kinds AS (SELECT src, dst FROM edges UNION ALL SELECT node, node FROM nodes),
x AS (SELECT 0 AS k, node, 1::DOUBLE AS x FROM nodes UNION ALL SELECT k + 1, dst, y / sqrt(sum(y * y) OVER ()) FROM (SELECT x.k, b.dst, sum(x.x) AS y FROM x JOIN both_kinds b ON b.src = x.node WHERE x.k < 100 GROUP BY x.k, b.dst))
SELECT node, round(x, 6) AS x FROM x WHERE k = 100""", recursive=True)  # fmt: skip
def g7(spark, sf):
    return G.eigenvector(edges(spark, sf)).withColumn("x", F.round("x", 6))


@query("g8_communities")
def g8(spark, sf):
    return G.communities(edges(spark, sf))


def _cycles(most: int) -> str:
    return f"""{LINKS}, p AS (SELECT src AS start, dst AS last, [src, dst] AS path FROM links WHERE src < dst UNION ALL SELECT p.start, l.dst, list_append(p.path, l.dst) FROM p JOIN links l ON l.src = p.last WHERE p.start < l.dst AND NOT list_contains(p.path, l.dst) AND len(p.path) < {most}),
found AS (SELECT path FROM p JOIN links l ON l.src = p.last AND l.dst = p.start)"""


@query("g9_cycles", E, _cycles(3) + " SELECT array_to_string(path, ',') AS path FROM found", recursive=True)
def g9(spark, sf):
    return G.cycles(edges(spark, sf), 3).select(text("path").alias("path"))


@query("g10_cycles_rotated", E, _cycles(3) + ", turned AS (SELECT list_concat(path[k + 1:], path[:k]) AS path FROM (SELECT path, unnest(range(len(path))) AS k FROM found)) SELECT array_to_string(path, ',') AS path FROM turned ORDER BY len(turned.path) DESC, turned.path LIMIT 100", recursive=True)
def g10(spark, sf):
    return G.longest_cycles(edges(spark, sf), 3, 100).select(text("path").alias("path"))


@query("g11_layering_paths", E, f"{LINKS} SELECT concat_ws(',', a.src, a.dst, b.dst) AS path FROM links a JOIN links b ON b.src = a.dst AND b.dst <> a.src")
def g11(spark, sf):
    return G.layering(edges(spark, sf), 2, 2).select(text("path").alias("path"))


@query("g12_layering_totals", E, """
l AS (SELECT * FROM edges WHERE src <> dst)
SELECT concat_ws(',', a.src, a.dst, b.dst, z.dst) AS path, (a.total + b.total + z.total)::DOUBLE AS total, strftime(least(a.first_ts, b.first_ts, z.first_ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(greatest(a.last_ts, b.last_ts, z.last_ts), '%Y-%m-%d %H:%M:%S') AS last_ts
FROM l a JOIN l b ON b.src = a.dst AND b.dst <> a.src JOIN l z ON z.src = b.dst AND z.dst <> a.src AND z.dst <> a.dst ORDER BY a.total + b.total + z.total DESC, [a.src, a.dst, b.dst, z.dst] LIMIT 100""")  # fmt: skip
def g12(spark, sf):
    return G.heaviest_paths(edges(spark, sf), 3, 100).select(text("path").alias("path"), "total", *minute("first_ts", "last_ts"))


_TIMED = """t AS (SELECT * FROM txn WHERE sender_id <> receiver_id),
ch AS (SELECT a.transaction_id AS t1, b.transaction_id AS t2, c.transaction_id AS t3, a.sender_id AS start, c.receiver_id AS last, a.ts AS began, c.ts AS at, a.amount AS first_amount
  FROM t a JOIN t b ON b.sender_id = a.receiver_id AND b.ts > a.ts AND b.ts < a.ts + INTERVAL 48 HOURS AND b.receiver_id <> a.sender_id
  JOIN t c ON c.sender_id = b.receiver_id AND c.ts > b.ts AND c.ts < a.ts + INTERVAL 48 HOURS AND c.receiver_id NOT IN (a.sender_id, a.receiver_id))"""


@query("g13_timed_layering", "txn", f"{_TIMED} SELECT concat_ws(',', t1, t2, t3) AS ids FROM ch")
def g13(spark, sf):
    return G.timed_layering(txn(spark, sf)).select(text("ids").alias("ids"))


@query("g13_return_legs", "txn", f"""{_TIMED} SELECT concat_ws(',', t1, t2, t3) AS ids, r.transaction_id AS return_id, r.amount::DOUBLE AS return_amount
FROM ch JOIN t r ON r.sender_id = ch.last AND r.receiver_id = ch.start AND r.ts > ch.at AND r.ts < ch.began + INTERVAL 48 HOURS WHERE ch.first_amount > 0 AND r.amount > 0 AND abs(r.amount - ch.first_amount) <= 0.1 * ch.first_amount""")  # fmt: skip
def g13_returns(spark, sf):
    return G.round_trips(txn(spark, sf), [3])[3].select(text("ids").alias("ids"), "return_id", F.col("return_amount").cast("double").alias("return_amount"))


@query("g14_greedy_chain", "txn", """
f AS (SELECT sender_id AS at, arg_min(receiver_id, (ts, transaction_id)) AS nxt FROM txn GROUP BY 1),
c AS (SELECT transaction_id, sender_id AS origin, receiver_id AS at, [sender_id, receiver_id] AS path, 1 AS layers, sender_id = receiver_id AS back FROM txn
  UNION ALL SELECT c.transaction_id, c.origin, f.nxt, list_append(c.path, f.nxt), c.layers + 1, f.nxt = c.origin FROM c JOIN f ON f.at = c.at WHERE NOT c.back AND c.layers < 10 AND (f.nxt = c.origin OR NOT list_contains(c.path, f.nxt)))
SELECT transaction_id, max(layers)::INT AS layers, bool_or(back) AS back, max(layers) >= 3 OR bool_or(back) AS layering FROM c GROUP BY 1""", recursive=True)  # fmt: skip
def g14(spark, sf):
    return G.greedy_chain(txn(spark, sf), 10)


_REACH = f"{NODES},\nreach AS (SELECT node AS s, node AS t FROM nodes UNION SELECT reach.s, e.dst FROM reach JOIN edges e ON e.src = reach.t), st AS (SELECT a.s, min(a.t) AS c FROM reach a JOIN reach b ON a.s = b.t AND a.t = b.s GROUP BY 1)"


@query("g15_strong_components", E, _REACH + " SELECT s AS node, c AS component FROM st", recursive=True)
def g15(spark, sf):
    return G.strong_components(edges(spark, sf))


_WEAK = "both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), wr AS (SELECT node AS s, node AS t FROM nodes UNION SELECT wr.s, b.dst FROM wr JOIN both_ways b ON b.src = wr.t), wk AS (SELECT s, min(t) AS c FROM wr GROUP BY 1)"


@query("g16_weak_components", E, f"{NODES}, {_WEAK} SELECT s AS node, c AS component FROM wk", recursive=True)
def g16(spark, sf):
    return G.weak_components(edges(spark, sf))


@query("g17_flow_statistics", E, f"""{_REACH}, {_WEAK}
SELECT (SELECT count(*) FROM edges) AS edges, (SELECT sum(total)::DOUBLE FROM edges) AS total, (SELECT round(avg(total::DOUBLE), 4) FROM edges) AS average, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(DISTINCT c) FROM wk) AS weak,
  (SELECT count(DISTINCT c) FROM st) AS strong, round((SELECT count(*) FROM edges) / ((SELECT count(*) FROM nodes) * ((SELECT count(*) FROM nodes) - 1)), 8) AS density, (SELECT count(DISTINCT c) FROM wk) = 1 AS connected""", recursive=True)  # fmt: skip
def g17(spark, sf):
    return G.flow_statistics(edges(spark, sf)).withColumns({"average": F.round("average", 4), "density": F.round("density", 8)})


def measures(spark, sf, e=None):
    e = edges(spark, sf) if e is None else e
    return G.cut(G.pagerank(e, rounds=200, tolerance=1e-12).join(G.path_measures(e), "node").join(G.degrees(e), "node"))


_MEASURES = f"{LINKS}, {_RANK}, {_PATHS}, {_DEGREES}, ms AS (SELECT node, rank, betweenness, out_degree, in_degree, (out_degree + in_degree) / (c.n - 1) AS centrality FROM ranks JOIN bt USING (node) JOIN deg USING (node) CROSS JOIN c)"


@query("g18_hubs", E, f"""{_MEASURES}
SELECT node, round(rank + betweenness, 6) AS score FROM ms WHERE round(rank, 10) >= (SELECT round(quantile_cont(rank, 0.9), 10) FROM ms) OR round(betweenness, 10) >= (SELECT round(quantile_cont(betweenness, 0.9), 10) FROM ms)""", recursive=True)  # fmt: skip
def g18(spark, sf):
    return G.hubs(measures(spark, sf)).select("node", F.round("score", 6).alias("score"))


@query("g19_neighbourhood", E, f"""{LINKS}, {_RANK},
b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), s AS (SELECT min(src) AS node FROM edges), h1 AS (SELECT node FROM s UNION SELECT dst FROM b JOIN s ON src = node), h2 AS (SELECT node FROM h1 UNION SELECT dst FROM b JOIN h1 ON src = node)
SELECT src, dst, total::DOUBLE AS total, round(r.rank, 8) AS src_rank FROM edges JOIN ranks r ON r.node = src WHERE src IN (SELECT node FROM h2) AND dst IN (SELECT node FROM h2)""", recursive=True)  # fmt: skip
def g19(spark, sf):
    e = edges(spark, sf)
    ranks = G.pagerank(e, rounds=200, tolerance=1e-12).select(F.col("node").alias("src"), F.round("rank", 8).alias("src_rank"))
    return G.neighbourhood(e, e.agg(F.min("src").alias("node")), 2).join(ranks, "src").select("src", "dst", "total", "src_rank")


@query("g20_high_risk_customers")
def g20(spark, sf):
    e = edges(spark, sf)
    return G.pagerank(e).join(G.vertices(txn(spark, sf)), "node").join(G.communities(e), "node").orderBy(F.desc("rank"), F.desc("n"), "node").limit(50)


@query("g21_network_verdict")
def g21(spark, sf):
    e = G.cut(edges(spark, sf))
    return G.network_verdict(txn(spark, sf), G.verdict_measures(e, measures(spark, sf, e)), G.layered_links(e)).select("transaction_id", "network_risk", "network_alert")


@query("g22_risk_scores", E, f"""{_MEASURES}
SELECT node, round(0.3 * centrality + 0.4 * betweenness + 0.3 * rank, 6)::DOUBLE AS risk, out_degree + in_degree > (SELECT quantile_cont(out_degree + in_degree, 0.9) FROM ms) AS above_p90, out_degree > 10 AS hub FROM ms""", recursive=True)  # fmt: skip
def g22(spark, sf):
    return G.risk_scores(measures(spark, sf)).select("node", F.round("risk", 6).alias("risk"), "above_p90", "hub")


@query("g22_top_risk", E, f"""{_MEASURES} SELECT node, round(0.3 * centrality + 0.4 * betweenness + 0.3 * rank, 6)::DOUBLE AS risk FROM ms ORDER BY 0.3 * centrality + 0.4 * betweenness + 0.3 * rank DESC, node LIMIT 10""", recursive=True)
def g22_top(spark, sf):
    return G.risk_scores(measures(spark, sf)).orderBy(F.desc("risk"), "node").limit(10).select("node", F.round("risk", 6).alias("risk"))


_TRIANGLES = """u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst), nb AS (SELECT a AS x, b AS y FROM u UNION SELECT b, a FROM u),
tr AS (SELECT p.x AS node, count(*) AS t FROM nb p JOIN nb q ON p.x = q.x AND p.y < q.y JOIN u ON u.a = p.y AND u.b = q.y GROUP BY 1), dg AS (SELECT x AS node, count(*) AS d FROM nb GROUP BY 1),
cl AS (SELECT node, round(CASE WHEN d > 1 THEN 2 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END, 6)::DOUBLE AS clustering FROM nodes LEFT JOIN tr USING (node) LEFT JOIN dg USING (node))"""


@query("g23_clustering", E, f"{NODES}, {_TRIANGLES} SELECT node, clustering FROM cl")
def g23(spark, sf):
    return G.clustering(edges(spark, sf)).withColumn("clustering", F.round("clustering", 6))


@query("g24_shell_heuristics", E, f"""{_MEASURES} SELECT node, out_degree, in_degree, out_degree + in_degree > 50 AS shell FROM ms WHERE out_degree + in_degree > 50""", recursive=True)
def g24(spark, sf):
    return G.shells(G.degrees(edges(spark, sf))).select("node", "out_degree", "in_degree", F.lit(True).alias("shell"))


@query("g24_mules")
def g24_mules(spark, sf):
    e = edges(spark, sf)
    return G.mules(e, G.betweenness(e), G.communities(e))


_DEGREE = "nd AS (SELECT node, out_degree + in_degree AS degree FROM deg)"


@query("f8_network_features", E, f"""{LINKS}, {_RANK}, {_PATHS}, {_DEGREES}, {_DEGREE}, {_TRIANGLES}
SELECT t.transaction_id, coalesce(degree, 0) AS degree, coalesce(degree, 0) > 10 AS hub, round(coalesce(betweenness, 0), 6) AS betweenness, round(coalesce(rank, 0), 8) AS pagerank, coalesce(clustering, 0) AS clustering
FROM txn t LEFT JOIN nd ON nd.node = t.sender_id LEFT JOIN bt ON bt.node = t.sender_id LEFT JOIN ranks ON ranks.node = t.sender_id LEFT JOIN cl ON cl.node = t.sender_id""", recursive=True)  # fmt: skip
def f8(spark, sf):
    e = G.cut(edges(spark, sf))
    out = G.network_features(txn(spark, sf), measures(spark, sf, e).join(G.clustering(e), "node"))
    return out.select("transaction_id", "degree", "hub", F.round("betweenness", 6).alias("betweenness"), F.round("pagerank", 8).alias("pagerank"), F.round("clustering", 6).alias("clustering"))


@query("f8_community_size")
def f8_community(spark, sf):
    return G.community_sizes(txn(spark, sf), G.communities(edges(spark, sf))).select("transaction_id", "community_size")
