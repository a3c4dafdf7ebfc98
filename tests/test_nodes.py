"""Small functions, packed windows and banded alignment against plain versions."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.functions import nodes as N
from strandloom.operators import align as L
from strandloom.operators import kmers as K
from strandloom.sources import fastq, tables


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.mark.parametrize("k", [1, 2, 5, 8, 21, 31])
def test_rolled_windows(k):
    draw = random.Random(k)
    seq = "".join(draw.choice("ACGT" * 8 + "N") for _ in range(300))
    ahead, back, good = K.rolled(np.frombuffer(seq.encode(), np.uint8), k)
    number = lambda s: int("0" + s.translate(str.maketrans("ACGT", "0123")), 4)
    for i in range(300 - k + 1):
        part = seq[i : i + k]
        assert good[i] == ("N" not in part)
        if good[i]:
            assert (ahead[i], back[i]) == (number(part), number(rc(part)))
    assert len(K.rolled(np.frombuffer(b"AC", np.uint8), 3)[0]) == 0


def test_packed_offsets_of_long_and_odd_reads(spark, monkeypatch):
    monkeypatch.setattr(K, "SLAB", 50)
    draw = random.Random(1)
    seqs = ["".join(draw.choice("ACGTN") for _ in range(n)) for n in (0, 4, 5, 49, 50, 51, 333)] + [None]
    reads = spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")
    want = sorted((i, o, s[o : o + 5]) for i, s in enumerate(seqs) if s for o in range(len(s) - 4) if "N" not in s[o : o + 5])
    found = K.packed_offsets(reads, 5).withColumn("kmer", F.lpad(F.conv(F.col("code").cast("string"), 10, 4), 5, "0")).collect()
    got = sorted((r.read_id, r.offset, r.kmer.translate(str.maketrans("0123", "ACGT")) if r.same else rc(r.kmer.translate(str.maketrans("0123", "ACGT")))) for r in found)
    assert got == want


def test_a_record_starts_only_at_a_line(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">id a>b\nACGT\nAC>GT\n>second\nTTTT\n")
    assert sorted(tuple(r) for r in fastq.read_fasta(spark, str(tmp_path / "x.fa")).collect()) == [("id a>b", "ACGTAC>GT"), ("second", "TTTT")]


def test_sizes_and_times(spark):
    rows = spark.createDataFrame([(10, 0.25), (2048, 61.0), (1536 * 1024, 3725.0), (5 << 30, 90061.5), (3 << 41, 5.125)], "size long, t double")
    found = rows.select(N.human_size(F.col("size")).alias("s"), N.human_time(F.col("t")).alias("t")).collect()
    assert [r.s for r in found] == ["10 B", "2 kB", "1.5 MB", "5 GB", "6 TB"]
    assert [r.t for r in found] == ["250ms", "1min 1s", "1h 2min 5s", "1d 1h 1min", "5s 125ms"]


def test_indexes_and_determinants():
    cards = (2, 3, 4)
    assert [N.linear_index(s, cards) for s in N.counted(cards)] == list(range(24)) and N.states_of(1, cards) == (1, 0, 0)
    assert N.linear_index((), ()) == 0 and N.states_of(0, ()) == ()
    assert N.determinant([[2, 1], [1, 3]]) == pytest.approx(5) and N.determinant([]) == 1.0
    assert N.permuted(np.zeros((2, 3)), (1, 0)).shape == (3, 2)


def test_a_band_takes_memory_of_its_width():
    draw = random.Random(2)
    for _ in range(60):
        a = "".join(draw.choice("ACGT") for _ in range(draw.randrange(0, 30)))
        b = "".join(c for c in a if draw.random() > 0.1) + draw.choice(["", "A", "CG"])
        band = max(abs(len(a) - len(b)), 12)
        found = L.align_banded(a, b, band)
        if len(a) <= band and len(b) <= band:
            assert found.score == L.align(a, b).score
        assert sum(s != "I" for s in found.steps) == len(a) and sum(s != "D" for s in found.steps) == len(b)
    a = "".join(draw.choice("ACGT") for _ in range(20_000))
    assert L.align_banded(a, a[:9000] + a[9003:], 5).steps.count("D") == 3


def test_estimates_and_networks(spark, tmp_path):
    nodes = spark.createDataFrame([(1, "ACGTA", 2.0), (2, "GTACC", 4.0), (3, "AAAAA", 1.0)], "node_id int, seq string, cov double")
    arcs = spark.createDataFrame([(1, 2, 3.0)], "src int, dst int, cov double")
    table, pairs = tables.neighbourhood_tables(nodes, arcs, 1, 1, 3)
    assert sorted(r["Node ID"] for r in table.collect()) == [1, 2] and pairs.count() == 1 and table.columns == list(tables.NODE_HEAD)
    (tmp_path / "arcs").write_text("-2 -1 2 -0.5 3\n1 x\n")
    assert [tuple(r) for r in tables.read_arc_estimates(spark, str(tmp_path / "arcs")).collect()] == [(-2, -1, 2, -0.5)]
    (tmp_path / "list").write_text("1 2\n")
    with pytest.raises(ValueError, match="no such arc"):
        tables.read_arcs(spark, str(tmp_path / "list"), arcs.filter("cov > 9"))


@pytest.mark.parametrize("k", [5, 13])
def test_packed_counts_in_one_array_and_in_parts(spark, k):
    draw = random.Random(k)
    base = "".join(draw.choice("ACGT") for _ in range(400))
    seqs = [base[i : i + 90] + draw.choice(["", "N", "ACGTACGTACGTACGT"]) + base[:i] for i in range(0, 300, 7)] + ["", None, "ACG"]
    windows = [s[i : i + k] for s in seqs if s for i in range(len(s) - k + 1) if "N" not in s[i : i + k]]
    want = Counter(min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA"))) for w in windows)
    reads = spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string").repartition(3)
    for least in (1, 4):
        got = K.canonical_counts(reads, k, least).collect()
        assert sorted((r.kmer, r.n) for r in got) == sorted((w, n) for w, n in want.items() if n >= least)


def test_windows_of_many_reads_are_rolled_in_little_memory():
    column = pa.array(["ACGTTGCATT" * 200] * 2000)
    tracemalloc.start()
    n = sum(int(K.rolled(bases, 11)[2].sum()) for bases, *_ in K.slabs(column, 11))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 2000 * 1990 and peak < 40e6
