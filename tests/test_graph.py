import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import graph as G
from strandloom.operators import kmers as K

SCHEMA = "read_id long, seq string"


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def spelled(rows, k):
    return sorted(min(s[i : i + k], rc(s[i : i + k])) for s in rows for i in range(len(s) - k + 1))


@pytest.fixture(scope="module")
def sequence():
    draw = random.Random(5)
    unit = "".join(draw.choice("ACGT") for _ in range(150))
    repeat = "".join(draw.choice("ACGT") for _ in range(40))
    return unit[:60] + repeat + unit[60:] + repeat + rc(unit[:30])


def test_compaction_keeps_the_spelling(spark, sequence):
    k = 11
    reads = spark.createDataFrame([(1, sequence)], SCHEMA)
    nodes, arcs = K.kmer_graph(reads, k)
    assert G.sanity(nodes, arcs, k).collect() == []
    joined, left = G.concatenate(nodes, arcs, k)
    assert joined.count() < nodes.count() / 5
    assert spelled([r.seq for r in joined.collect()], k) == spelled([r.seq for r in nodes.collect()], k)
    assert G.sanity(joined, left, k).collect() == []
    again, _ = G.concatenate(joined, left, k)
    assert sorted(r.seq for r in again.collect()) == sorted(r.seq for r in joined.collect())
    assert joined.agg(F.sum("cov")).first()[0] == nodes.agg(F.sum("cov")).first()[0]


def test_a_single_path_becomes_one_node(spark):
    reads = spark.createDataFrame([(1, "ACGTTGCATTCAGGATC")], SCHEMA)
    joined, left = G.concatenate(*K.kmer_graph(reads, 5), 5)
    (row,) = joined.collect()
    assert row.seq in ("ACGTTGCATTCAGGATC", rc("ACGTTGCATTCAGGATC")) and row.arc_counts == [1] * 12 and left.count() == 0


def test_a_cycle_is_cut_once(spark):
    nodes = spark.createDataFrame([(i, s, 1.0, [1], []) for i, s in ((1, "AAC"), (2, "ACG"), (3, "CGA"), (4, "GAA"))], "node_id int, seq string, cov double, counts array<bigint>, arc_counts array<bigint>")
    arcs = G.canonical_arcs(spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (4, 1, 1.0)], "src int, dst int, cov double"))
    joined, left = G.concatenate(nodes, arcs, 3)
    (row,) = joined.collect()
    assert row.seq == "AACGAA" and [(r.src, r.dst) for r in left.collect()] in ([(-1, -1)], [(1, 1)])


def test_canonical_edges(spark):
    rows = spark.createDataFrame([(1, 2, 1.0), (-2, -1, 1.0), (1, -1, 1.0)], "src int, dst int, cov double")
    assert sorted(tuple(r) for r in G.canonical_arcs(rows).collect()) == [(-2, -1, 2.0), (1, -1, 1.0)]


def test_removal_and_defrag(spark, sequence):
    nodes, arcs = K.kmer_graph(spark.createDataFrame([(1, sequence)], SCHEMA), 11)
    gone = nodes.filter("node_id % 3 = 0").select("node_id")
    left, kept = G.remove_nodes(nodes, arcs, gone)
    dense, moved = G.defrag(left, kept)
    assert sorted(r.node_id for r in dense.collect()) == list(range(1, left.count() + 1))
    assert moved.count() == kept.count() and G.sanity(dense, moved, 11).collect() == []


def test_components_and_neighbourhood(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a int, b int")
    found = {r.node: r.component for r in G.components(pairs).collect()}
    assert found == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}
    arcs = spark.createDataFrame([(-i - 1, -i, 1.0) for i in range(1, 10)], "src int, dst int, cov double")
    near = G.neighbourhood(arcs, spark.createDataFrame([(5,)], "seed int"), 2)
    assert sorted((r.node_id, r.dist) for r in near.collect()) == [(3, 2), (4, 1), (5, 0), (6, 1), (7, 2)]


def test_subgraphs_and_moves(spark):
    nodes = spark.createDataFrame([(i, [1] * n) for i, n in ((1, 5), (2, 3), (3, 10), (4, 2))], "node_id int, counts array<bigint>")
    arcs = G.canonical_arcs(spark.createDataFrame([(1, 2, 1.0), (1, 3, 1.0), (2, 4, 1.0), (3, 4, 1.0)], "src int, dst int, cov double"))
    assert {r.node: r.dist for r in G.within(nodes, arcs, 1, 5).collect()} == {1: 0, 2: 3, 4: 5}
    assert {r.node: r.dist for r in G.within(nodes, arcs, 1, 20).collect()} == {1: 0, 2: 3, 3: 10, 4: 5}
    assert sorted(r.node for r in G.between(nodes, arcs, 1, 4, 11).collect()) == [1, 2, 4]
    moves = spark.createDataFrame([(1, 2), (2, 5), (7, 1)], "node_id int, to int")
    assert {r.node_id: r.now for r in G.present(moves, spark.createDataFrame([(1,), (3,), (7,)], "node_id int")).collect()} == {1: 5, 3: 3, 7: 5}


@pytest.mark.parametrize("most", [0, 40, 1_000_000])
def test_reach_of_paths_and_cycles(spark, monkeypatch, most):
    monkeypatch.setattr(G, "ONE_TASK", most)
    paths, cycles = [range(10, 61), range(100, 103)], [[7, 5, 9], [-71, -70]]
    steps = [(b, a) for p in paths for a, b in zip(p, p[1:], strict=False)] + [(c[(i + 1) % len(c)], x) for c in cycles for i, x in enumerate(c)]
    found = {r.node: (r.head, r.dist if r.head else None, r.least) for r in G.reach(spark.createDataFrame(steps, "node int, prev int")).collect()}
    assert found == {x: (p[0], i, p[0]) for p in paths for i, x in enumerate(p)} | {x: (None, None, min(map(abs, c))) for c in cycles for x in c}


def test_a_cycle_is_gone_round_without_overflow(spark, monkeypatch):
    monkeypatch.setattr(G, "ONE_TASK", 0)
    n = 70_000  # 17 rounds for the path and as many for the cycle after it
    path, cycle = spark.range(1, n).selectExpr("cast(id + 1 AS int) AS node", "cast(id AS int) AS prev"), spark.range(n).selectExpr(f"cast({n} + 1 + (id + 1) % {n} AS int) AS node", f"cast({n} + 1 + id AS int) AS prev")
    found = G.reach(path.union(cycle))
    assert found.groupBy("head").agg({"least": "max", "*": "count"}).orderBy("head").collect() == [(None, n + 1, n), (1, 1, n)]
    assert found.filter("head = 1").agg({"dist": "max"}).first()[0] == n - 1
