import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import align as L
from strandloom.operators import assemble as A
from strandloom.operators import compare as P
from strandloom.operators import coverage as C
from strandloom.operators import kmers as K
from strandloom.operators import thresholds as T
from strandloom.operators.model import CovModel, spectrum_table
from strandloom.pipeline import EngineConfig

K_ = 15


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.fixture(scope="module")
def genome():
    draw = random.Random(11)
    part = lambda n: "".join(draw.choice("ACGT") for _ in range(n))
    repeat = part(80)
    return part(300) + repeat + part(250) + repeat + part(200)


@pytest.fixture(scope="module")
def reads(spark, genome):
    draw = random.Random(12)
    rows = []
    for i in range(400):
        at = draw.randrange(len(genome) - 60 + 1)
        rows.append((i, genome[at : at + 60] if i % 2 else rc(genome[at : at + 60])))
    return spark.createDataFrame(rows, "read_id long, seq string").cache()


def test_coverage_equals_a_count_by_hand(spark, genome, reads):
    nodes = spark.createDataFrame([(1, genome[:120]), (2, genome[106:220])], "node_id int, seq string")
    arcs = spark.createDataFrame([(-2, -1, 0.0)], "src int, dst int, cov double")
    place = {}
    for node, seq in ((1, genome[:120]), (2, genome[106:220])):
        for i in range(len(seq) - K_ + 1):
            place.setdefault(seq[i : i + K_], (node, i))
            place.setdefault(rc(seq[i : i + K_]), (-node, len(seq) - K_ - i))
    cov, pos, crossed = {}, {}, 0
    for r in reads.collect():
        before = None
        for i in range(len(r.seq) - K_ + 1):
            hit = place.get(r.seq[i : i + K_])
            if hit:
                node, at = hit
                cov[abs(node)] = cov.get(abs(node), 0) + 1
                n = 106 if abs(node) == 1 else 100
                key = (abs(node), at if node > 0 else n - 1 - at)
                pos[key] = pos.get(key, 0) + 1
                if before and before[0] == i - 1 and (before[1][0], node) in ((1, 2), (-2, -1)):
                    crossed += 1
                before = (i, hit)
    by_node, by_pos, by_arc, by_step = C.cov_count(reads, nodes, arcs, K_)
    assert {r.node_id: r.cov for r in by_node.collect()} == cov
    assert {(r.node_id, r.pos): r.n for r in by_pos.collect()} == pos
    assert by_arc.first().cov == crossed
    back = reads.select("read_id", F.translate(F.reverse("seq"), "ACGT", "TGCA").alias("seq"))
    assert {r.node_id: r.cov for r in C.cov_count(back, nodes, arcs, K_)[0].collect()} == cov


def test_contigs_are_part_of_the_genome(spark, genome, reads):
    nodes, arcs = K.unitigs(reads, K_, 2)
    nodes, arcs = C.annotate(reads, nodes, arcs, K_)
    model = CovModel(1.0, 1.5, 400 * 46 / len(genome), 1.5, (1, 100, 10, 1, 1, 1))
    p = T.misassembly(T.multiplicities(spectrum_table(spark, model)))
    found = A.assemble(nodes, arcs, T.thresholds(p, 1e-3), p, 500, K_).collect()
    assert found
    for r in found:
        assert len(r.fwd) == len(r.bwd) == len(r.seq) - 1
        assert r.seq in genome or rc(r.seq) in genome
        assert r.fwd[: K_ - 1] == [0.0] * (K_ - 1) and r.bwd[1 - K_ :] == [0.0] * (K_ - 1)
    assert sorted(r.contig_id for r in found) == list(range(1, len(found) + 1))


def test_segments_of_a_deletion(spark, genome):
    nodes = spark.createDataFrame([(1, genome[:200])], "node_id int, seq string")
    arcs = spark.createDataFrame([], "src int, dst int, cov double")
    read = spark.createDataFrame([(1, genome[:80] + genome[110:200])], "read_id long, seq string")
    steps = C.steps(C.hits(read, C.kmer_index(nodes, K_), K_), arcs)
    found = sorted((r.seg_no, r.type, r.seq_begin, r.seq_end) for r in P.annotated(P.segments(steps, K_), K_).collect())
    assert found == [(1, "CONTIG", 0, 80), (2, "DELETION", 80, 80), (3, "CONTIG", 80, 170)]
    assert [r.chain for r in P.node_chains(steps).orderBy("seg_no").collect()] == [[1], [1]]
    assert P.true_multiplicities(steps, nodes, arcs, K_)[0].first().mult == 1


def test_alignments():
    s = L.Scores()
    assert L.align("ACGT", "ACGT").steps == "MMMM" and L.align("ACGT", "AGGT").steps == "MXMM" and L.align("ACGT", "ANGT").score == 4
    assert L.align("ACGT", "AGT", s).score == 0 and L.align("ACGTTT", "ACGT").stats[2] == 2
    assert L.align_banded("ACGTACGT", "ACGTCGT", 2).score == L.align("ACGTACGT", "ACGTCGT").score
    with pytest.raises(ValueError):
        L.align_banded("ACGTACGT", "A", 2)
    assert L.align_free_end("ACGT", "ACGTTTTT", both=False).end2 == 4
    assert L.align_overlap("GTACC", "TTTGTA").steps == "MMM" and L.trimmed(L.Alignment(0, "MMDD", 4, 2)).steps == "MM"
    g = L.LocalGraph({1: "ACGTACC", 2: "CCGGA", 3: "CCTTA"}, {1: [2, 3]}, 3)
    found, path = g.extend(1, 0, "ACGTACCTTA", L.Scores(2, -1, -3))
    assert path == [1, 3] and found.stats == (10, 0, 0) and g.distances(1, 10) == {1: 0, 2: 3, 3: 3}


def test_configuration_is_checked():
    for wrong in ({"k": 30}, {"mm_components": 5}, {"likelihood": 0.0}, {"crf_max_fact": 10.0}, {"arc_dst_pos": "middle"}):
        with pytest.raises(ValueError):
            EngineConfig(**wrong)
