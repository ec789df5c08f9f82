import os
import random

import pytest
from pyspark.sql import functions as F

from gradewright.llm import common


def brute(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


CASES = [
    [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (7, 8), (8, 9), (9, 10)],
    [(i, i + 1) for i in range(40)][::-1],
    [(0, i) for i in range(1, 60)] + [(100, i) for i in range(101, 130)] + [(59, 129)],
    [(5, 5), (7, 7), (7, 6)],
    [],
]


@pytest.mark.parametrize("edges", CASES)
def test_components(rows, edges):
    got = {r.node: r.component for r in common.components(rows(edges, "a long, b long")).collect()}
    assert got == brute(edges)


def test_components_of_random_edges_with_hot_nodes(rows, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 20)
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(7, r.randrange(300)) for _ in range(40)]
    got = {x.node: x.component for x in common.components(rows(edges, "a long, b long")).collect()}
    assert got == brute(edges)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_by_key_equals_a_plain_join(rows, monkeypatch, how):
    monkeypatch.setattr(common, "HOT_KEYS", 10)
    left = rows([(k % 7 if k < 60 else k, k) for k in range(100)], "k long, v long")
    facts = rows([(k, k * 2) for k in range(0, 100, 2)], "k long, f long")
    assert sorted(map(str, common.join_by_key(left, facts, "k", how).collect())) == sorted(
        map(str, left.join(facts, "k", how).select("k", "v", "f").collect()))


def test_written_leaves_no_shuffle_files(spark):
    folders = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def files():
        return {f for d in folders for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    before = files()
    table = common.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test-shuffle")
    assert table.count() == 7
    left = {f.split("_")[1] for f in files() - before}
    assert len(left) <= 1  # that of the count above
    assert spark.conf.get(common.SHUFFLE_CLEANUP, None) in (None, "false", "true")
