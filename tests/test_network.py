"""Graph operators on long and whole graphs, where bounded loops or a slice would fall short."""

from ledgerlynx import plans
from ledgerlynx.operators import network as G
from ledgerlynx.plans.bindings import txn

SF = "/root/testdata/sf0.001"


def graph(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_distances_run_to_the_end(spark):
    far = G.distances(graph(spark, [(k, k + 1) for k in range(25)]), spark.createDataFrame([(0,)], "node long"))
    assert {r["node"]: r["dist"] for r in far.collect()} == {k: k for k in range(26)}


def test_strong_components_of_long_cycles(spark):
    ring = [(k, (k + 1) % 30) for k in range(30)]
    other = [(40 + k, 40 + (k + 1) % 3) for k in range(3)]
    found = G.strong_components(graph(spark, [*ring, (29, 42), *other, (41, 60), (60, 61), (61, 60), (61, 70), (5, 5)]))
    want = {**dict.fromkeys(range(30), 0), **dict.fromkeys(range(40, 43), 40), 60: 60, 61: 60, 70: 70}
    assert {r["node"]: r["component"] for r in found.collect()} == want


def test_whole_graph_is_registered(spark):
    t = txn(spark, SF)
    assert plans.QUERIES["g1_edges"](spark, SF).count() == t.select("sender_id", "receiver_id").distinct().count()
