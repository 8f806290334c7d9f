"""Trees of any depth; cycles and missing parents are left out."""

from convolake.operators import sequences


def test_deep_chains(spark):
    deep = [(0, None), *[(i, i - 1) for i in range(1, 301)]]
    edges = spark.createDataFrame([*deep, (1000, 1002), (1001, 1000), (1002, 1001), (1003, 1002), (2000, 9999), (2001, 2000)], "node long, parent long")
    got = {r.node: (r.root, r.depth) for r in sequences.tree_depths(edges).collect()}
    assert got == {i: (0, i) for i in range(301)}


def test_a_chain_of_all_nodes(spark):
    for n in (1, 2, 6, 9):
        edges = spark.createDataFrame([(0, None), *[(i, i - 1) for i in range(1, n)]], "node long, parent long")
        assert {r.node: r.depth for r in sequences.tree_depths(edges).collect()} == {i: i for i in range(n)}
