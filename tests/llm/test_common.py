import random
from collections import defaultdict

import pytest

from helixframe.llm.common import Scratch, components, sorted_groups


@pytest.mark.parametrize("partitions,distinct", [(1, False), (7, False), (7, True), (40, True)])
def test_sorted_groups_equal_brute_force(spark, partitions, distinct):
    r = random.Random(partitions)
    rows = [(r.choice([1, 1, 1, 2, 3, r.randint(4, 400)]), r.randint(0, 1), r.randint(-50, 50), r.choice([None, 5, 6])) for _ in range(3000)]
    if not distinct:
        rows = list({x[:3]: x for x in rows}.values())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "a long, b long, c long, d long").repartition(5)
        got = sorted_groups(Scratch(spark, "t"), df, ["a", "b"], ["c"], "g", carry=None if distinct else "d", distinct=distinct).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    groups = defaultdict(set if distinct else list)
    for a, b, c, d in rows:
        (groups[a, b].add((c,)) if distinct else groups[a, b].append((c, d)))
    assert len(got) == sum(map(len, groups.values()))
    for x in got:
        g = sorted(groups[x.a, x.b], key=lambda y: y[0])
        assert x.repeated == (len(g) > 1) and x.first_c == g[0][0]
        assert distinct or x.first_d == g[0][1]


def test_sorted_groups_of_nothing(spark):
    df = spark.createDataFrame([], "a long, b long")
    assert sorted_groups(Scratch(spark, "t"), df, ["a"], ["b"], "g").count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.component for r in components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long"), "x").collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
