"""Markov clusters of components above the bound follow the same law as those below it."""

import numpy as np

from octolith.operators import clusters


def test_large_components_are_clustered(spark):
    rng = np.random.default_rng(2)
    edge = {(b, a): 1.0 for k in (0, 10, 20) for a in range(k, k + 6) for b in range(a + 1, k + 6)} | {(10, 5): 1.0, (20, 15): 1.0}
    edge |= {(101 + i, 100 + i): float(w) for i, w in enumerate(rng.uniform(0.2, 2, 12))} | {(201, 200): 1.0}
    e = spark.createDataFrame([(a, b, w) for (a, b), w in edge.items()], "src long, dst long, weight double").coalesce(1)
    small = sorted(map(tuple, clusters.markov_clusters(e).collect()))
    large = sorted(map(tuple, clusters.markov_clusters(e, most=1).collect()))
    assert large == small
    assert {c for n, c in large if n < 100} == {0, 10, 20}


def test_no_column_is_lost():
    """A hub's flow over 1500 nodes is under the bound that values are put to nought by."""
    n = 1500
    to = clusters._markov(n, np.zeros(n - 1, int), np.arange(1, n), np.ones(n - 1), 2.0)
    assert (to == 0).all()
