import random

from helixframe.operators import trees as T

INF, NAN = float("inf"), float("nan")


def test_mutations_meet_edges_by_bin(spark):
    """The same pairs as the comparison of all, with odd places, and a join on the node and the bin."""
    rng = random.Random(3)
    muts = [(k, rng.randrange(5), float(rng.randrange(120))) for k in range(300)]
    muts += [(300, 1, None), (301, None, 3.0), (302, 1, INF), (303, 1, -INF), (304, 1, NAN), (305, 1, 1e300)]
    edges = []
    for k in range(200):
        left = float(rng.randrange(100))
        edges.append((k, rng.randrange(5), left, left + rng.choice([0.0, 3.0, 20.0, -4.0])))
    edges += [(200, 1, -INF, INF), (201, 1, 5.0, INF), (202, 1, None, 9.0), (203, None, 0.0, 9.0), (204, 1, 0.0, NAN)]
    m = spark.createDataFrame(muts, "mut_id long, node long, position double")
    e = spark.createDataFrame(edges, "edge_id long, child long, left double, right double")
    got = T.mutation_edges(m, e)
    all_pairs = m.join(e, (m["node"] == e["child"]) & (m["position"] >= e["left"]) & (m["position"] <= e["right"]))
    assert got.columns == all_pairs.columns
    pairs = lambda df: sorted((r.mut_id, r.edge_id) for r in df.select("mut_id", "edge_id").collect())
    assert pairs(got) == pairs(all_pairs)
    assert "__bin" in got._jdf.queryExecution().toString()
    assert T.mutation_edges(m.limit(0), e).count() == T.mutation_edges(m, e.limit(0)).count() == 0
