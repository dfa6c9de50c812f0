import numpy as np
import pytest

from assayer.operators.linkage import average_linkage, merges


def brute(names, distance, clusters):
    """Merges the nearest two clusters until one is left; items in their order in the tree, and their clusters after the cut."""
    live = {i: [i] for i in range(len(names))}
    steps = []
    while len(live) > 1:
        mean = {(x, y): np.mean([distance[i][j] for i in live[x] for j in live[y]]) for x in live for y in live if x < y}
        x, y = min(mean, key=lambda p: (mean[p], p))
        steps.append((mean[x, y], x, y))
        live[len(names) + len(steps) - 1] = live.pop(x) + live.pop(y)
    (order,) = live.values()
    parent = {i: {i} for i in range(len(names))}
    for k, (_, x, y) in enumerate(steps):
        parent[len(names) + k] = parent[x] | parent[y]
    groups = [{i} for i in range(len(names))]
    for k in range(max(0, len(names) - clusters)):
        whole = parent[len(names) + k]
        groups = [g for g in groups if not g <= whole] + [whole]
    first = sorted(min(order.index(i) for i in g) for g in groups)
    return {names[i]: (first.index(min(order.index(j) for g in groups if i in g for j in g)) + 1, order.index(i)) for i in range(len(names))}, [s[0] for s in steps]


@pytest.mark.parametrize("n,clusters", [(2, 4), (5, 4), (23, 4), (40, 7)])
def test_equals_merging_one_pair_at_a_time(spark, n, clusters):
    rng = np.random.default_rng(n)
    points = rng.normal(size=(n, 3)) + rng.integers(0, 3, (n, 1)) * 4
    distance = np.sqrt(((points[:, None] - points) ** 2).sum(axis=2))
    names = [f"t{i:02d}" for i in range(n)]
    rows = [(names[i], names[j], float(distance[i][j])) if (i + j) % 2 else (names[j], names[i], float(distance[i][j])) for i in range(n) for j in range(i)] + [(names[0], names[0], 0.0), (names[0], names[1], None)]
    df = spark.createDataFrame(rows, "a string, b string, d double").repartition(3)
    want, heights = brute(names, distance, clusters)
    done, rounds = merges(df, "a", "b", "d")
    assert sorted(r.height for r in done.collect()) == pytest.approx(sorted(heights)) and rounds < n
    assert {r["item"]: (r.cluster_id, r.cluster_order) for r in average_linkage(df, "a", "b", "d", clusters).collect()} == want


def test_equal_heights_are_kept_together_and_nothing_is_nothing(spark):
    rows = [(a, b, 1.0 if {a, b} in ({"a", "b"}, {"c", "d"}, {"e", "f"}) else 5.0) for i, a in enumerate("abcdef") for b in "abcdef"[:i]]
    got = {r["item"]: r.cluster_id for r in average_linkage(spark.createDataFrame(rows, "a string, b string, d double"), "a", "b", "d", 4).collect()}
    assert len(set(got.values())) == 3 and got["a"] == got["b"] != got["c"]
    assert average_linkage(spark.createDataFrame([], "a string, b string, d double"), "a", "b", "d").count() == 0
