import random
from collections import defaultdict

import pytest

from weftline.operators import community as cm


def planted(seed, groups, size, inside, across):
    rng = random.Random(seed)
    edges = {}
    for _ in range(groups * size * inside):
        g = rng.randrange(groups)
        a, b = rng.sample(range(size), 2)
        edges[tuple(sorted((g * size + a, g * size + b)))] = rng.choice([0.5, 1.0, 2.0])
    for _ in range(groups * size * across):
        a, b = rng.sample(range(groups * size), 2)
        edges[tuple(sorted((a, b)))] = 0.3
    return [(f"n{a:05d}", f"n{b:05d}", w) for (a, b), w in edges.items()]


def quality(edges, home):
    m, inside, degree = sum(w for *_, w in edges), 0.0, defaultdict(float)
    for a, b, w in edges:
        inside += w * (home[a] == home[b])
        degree[home[a]] += w
        degree[home[b]] += w
    return inside / m - sum(d * d for d in degree.values()) / (4 * m * m)


@pytest.mark.parametrize("groups, size, inside, across", [(12, 40, 4, 1)])
def test_great_components_come_near_one_task(spark, groups, size, inside, across):
    edges = planted(groups, groups, size, inside, across)
    one = cm.louvain(edges, 2 * sum(w for *_, w in edges))
    df = spark.createDataFrame([(0, *e) for e in edges] + [(1, "x", "y", 1.0)], "replicate int, locality_a string, locality_b string, weight double")
    nodes = spark.createDataFrame(sorted({(0, x) for a, b, _ in edges for x in (a, b)}) + [(1, "x"), (1, "y"), (1, "alone")], "replicate int, locality string")
    rows = cm.cluster_replicates(df, nodes, most_edges=300).collect()
    found = {r.locality: r.cluster for r in rows if r.replicate == 0}
    assert len(rows) == nodes.count() and {(r.locality, r.cluster) for r in rows if r.replicate == 1} == {("x", "x"), ("y", "x"), ("alone", "alone")}
    assert quality(edges, found) >= 0.98 * quality(edges, one)
    least = defaultdict(list)
    for x, c in found.items():
        least[c].append(x)
    assert all(c == min(own) for c, own in least.items())
    own = cm.modularity(df.filter("replicate = 0"), spark.createDataFrame(sorted(found.items()), "locality string, cluster string")).first().modularity
    assert own == pytest.approx(quality(edges, found))


def test_no_edges(spark):
    df = spark.createDataFrame([], "replicate int, locality_a string, locality_b string, weight double")
    nodes = spark.createDataFrame([(0, "a"), (0, "b")], "replicate int, locality string")
    assert sorted((r.locality, r.cluster) for r in cm.cluster_replicates(df, nodes).collect()) == [("a", "a"), ("b", "b")]
    assert cm.modularity(df, nodes.withColumn("cluster", nodes.locality)).first().modularity is None
