"""Connected components and merges by chained keys against plain Python."""

import random

import pytest

from rankweave.operators.components import components, merge_parents, merged_by_keys


def expected(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def hub():
    return [(5_000, i) for i in range(1, 400)] + [(i, i + 1000) for i in range(1, 400, 3)]


CASES = {
    "chain": [(i, i + 1) for i in range(60)],
    "hub": hub(),
    "random": [(random.Random(i).randint(0, 300), random.Random(-i - 1).randint(0, 300)) for i in range(220)],
    "loops, repeats and nulls": [(1, 1), (2, 3), (3, 2), (2, 3), (None, 4), (5, None), (7, 6)],
    "none": [],
}


@pytest.mark.parametrize("case", CASES)
def test_components(spark, case):
    df = spark.createDataFrame(CASES[case], "x long, y long")
    assert {r.node: r.component for r in components(df, "x", "y").collect()} == expected(CASES[case])


def test_merge_by_chained_keys(spark):
    rows = [(1, "u1", None, "A"), (2, "u1", "s1", "B"), (3, "", "s1", "C"), (4, "", None, "D"), (5, None, "s2", "D"), (6, "", None, ""), (7, "u9", "", "")]
    parents = spark.createDataFrame(rows, "id long, url string, source string, name string")
    into = {r.id: r.merged_into for r in merged_by_keys(parents, "id", ["url", "source", "name"]).collect()}
    assert into == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7}
    children = spark.createDataFrame([(10, 3), (11, 5), (12, 99), (13, None), (14, 6)], "child long, parent long")
    _, kept, moved = merge_parents(parents, children, "id", ["url", "source", "name"], "parent")
    assert {r.id: r.merged for r in kept.collect()} == {1: 3, 4: 2, 6: 1, 7: 1}
    assert {r.child: r.parent for r in moved.collect()} == {10: 1, 11: 4, 12: 99, 13: None, 14: 6}
