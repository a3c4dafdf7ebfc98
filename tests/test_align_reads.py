import random

from strandloom.operators import align as L
from strandloom.operators import coverage as C

K = 15


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_reads_cross_many_short_nodes_both_ways(spark):
    draw = random.Random(3)
    genome = "".join(draw.choice("ACGT") for _ in range(184))
    cuts = [genome[i : i + 24] for i in range(0, 161, 10)]  # neighbours overlap by K - 1
    nodes = spark.createDataFrame([(i + 1, s, 0.0, [0], [0]) for i, s in enumerate(cuts)], "node_id int, seq string, cov double, counts array<bigint>, arc_counts array<bigint>")
    arcs = spark.createDataFrame([(-(i + 2), -(i + 1), 0.0) for i in range(len(cuts) - 1)], "src int, dst int, cov double")
    spoilt = "".join("ACGT"[("ACGT".index(c) + 1) % 4] if i in (4, 12) else c for i, c in enumerate(genome[23:173]))
    rows = [(1, genome[3:173]), (2, rc(genome[3:173])), (3, spoilt), (4, "A" * 60)]
    reads = spark.createDataFrame(rows, "read_id long, seq string")
    found = {r.read_id: r for r in L.align_reads(reads, C.hits(reads, C.kmer_index(nodes, K), K), nodes, arcs, K).collect()}
    assert sorted(found) == [1, 2, 3, 4] and [found[i].aligned for i in (1, 2, 3, 4)] == [True, True, True, False]
    for i in (1, 2):
        assert (found[i].score, found[i].n_subst, found[i].n_indel) == (340, 0, 0)
    assert len(found[1].path) > 10 and all(b - a == 1 for a, b in zip(found[1].path, found[1].path[1:], strict=False))
    assert (found[3].score, found[3].n_subst, found[3].n_indel) == (2 * 148 - 2, 2, 0)
    assert (found[4].score, found[4].path) == (0, [])
