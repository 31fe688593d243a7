import random

from logtide.llm.components import components, join_components


def brute(edges):
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def frame(spark, edges):
    return spark.createDataFrame(edges, "a long, b long")


def test_chains_stars_and_random(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 230)] + [(rng.randrange(300, 380), rng.randrange(300, 380)) for _ in range(50)]
    edges = [e for e in edges if e[0] != e[1]]
    assert {r["node"]: r["component"] for r in components(frame(spark, edges)).collect()} == brute(edges)
    assert components(frame(spark, [])).count() == 0


def test_later_edges(spark):
    first, more = [(1, 2), (3, 4), (5, 6)], [(2, 3), (7, 6), (8, 9)]
    found = components(frame(spark, first))
    assert {r["node"]: r["component"] for r in join_components(found, frame(spark, more)).collect()} == brute(first + more)
    assert {r["node"]: r["component"] for r in join_components(found, frame(spark, [])).collect()} == brute(first)
