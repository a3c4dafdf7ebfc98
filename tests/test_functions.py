import math

import pytest
from pyspark.sql import functions as F

from strandloom.functions import maths as M
from strandloom.functions import sequence as S
from strandloom.operators import kmers as K
from strandloom.operators import thresholds as T
from strandloom.operators.coverage import error_cutoff
from strandloom.operators.model import CovModel, c_best, fit_mixture, fit_truncated, log_nb

MODEL = CovModel(1.0, 1.5, 12.0, 1.5, (100, 50, 5, 1, 1, 1))


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_windows(spark):
    reads = spark.createDataFrame([(1, "ACGTT"), (2, "ACNGTA"), (3, "AC"), (4, ""), (5, None)], "read_id long, seq string")
    assert sorted(r.kmer for r in K.kmers(reads.filter("read_id = 2"), 3).collect()) == ["GTA"]
    assert {r.kmer: r.n for r in K.canonical_counts(reads.filter("read_id = 1"), 3).collect()} == {"ACG": 2, "AAC": 1}
    assert K.kmers(reads.filter("read_id > 2"), 3).count() == 0
    assert [(r.offset, r.kmer) for r in K.kmer_offsets(reads.filter("read_id = 2"), 3).collect()] == [(3, "GTA")]


def test_long_reads_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(K, "PIECE", 10)
    seq = "ACGTTGCATTCAGGATCCAGT" * 3
    found = K.kmer_offsets(spark.createDataFrame([(1, seq)], "read_id long, seq string"), 5)
    assert sorted((r.offset, r.kmer) for r in found.collect()) == [(i, seq[i : i + 5]) for i in range(len(seq) - 4)]


def test_phred(spark):
    p = [0.0, 1e-5, 1e-3, 0.01, 0.5, 1.0]
    assert "".join(one(spark, **{f"c{i}": S.phred_char(F.lit(x)) for i, x in enumerate(p)})) == "II?5$!"
    scores = one(spark, s=F.transform(S.qual_scores(F.lit("I5+!")), S.phred_correct)).s
    assert scores == pytest.approx([0.9999, 0.99, 0.9, 0.0])


def test_pack(spark):
    row = one(spark, a=S.pack(F.lit("GATTACA")), b=S.unpack(S.pack(F.lit("AATTACA")), 7))
    assert row.a == int("2033010", 4) and row.b == "AATTACA"


def test_lgamma_and_densities(spark):
    values = [0.5, 1.0, 2.5, 10.0, 345.6, 7400.0]
    found = one(spark, **{f"c{i}": M.lgamma(F.lit(x)) for i, x in enumerate(values)})
    assert list(found) == pytest.approx([math.lgamma(x) for x in values], rel=1e-12, abs=1e-12)
    cases = [(10, 12, 18, -2.373906605), (24.5, 12, 18, -5.907287855), (5, 4, 4, -1.856019937)]
    for k, mean, var, want in cases:
        assert one(spark, x=M.log_negbinomial(F.lit(float(k)), F.lit(float(mean)), F.lit(float(var)))).x == pytest.approx(want, abs=1e-8)
        assert log_nb(k, mean, var) == pytest.approx(want, abs=1e-8)


def test_expected_multiplicities(spark):
    covs, want = [1.0, 3.0, 5.0, 12.0, 19.0, 24.0, 30.0], [0, 0, 1, 1, 1, 2, 2]
    assert [MODEL.expected(c) for c in covs] == want
    rows = spark.createDataFrame([(c,) for c in covs], "c double")
    assert [r.m for r in rows.select(MODEL.c_expected(F.col("c")).alias("m")).collect()] == want
    assert [r.m for r in rows.select(c_best(MODEL.c_soft(F.col("c"), 2)).alias("m")).collect()] == want


def test_error_cutoff():
    assert error_cutoff(1.0, 0.01) == 5


def test_misassembly_probabilities_and_thresholds(spark):
    p = (0.9, 0.08, 0.015, 0.004, 0.001)
    mult = spark.createDataFrame([(10, *p), (20, *p)], "a int, p1 double, p2 double, p3 double, p4 double, p5 double")
    total = T.misassembly(mult).cache()
    at = {(r.a, r.ell): r.p for r in total.collect()}
    assert [at[10, i] for i in range(6, 11)] == pytest.approx([0.121064, 0.123393, 0.047949, 0.014866, 0.002375], abs=1e-6)
    assert (at[20, 13], at[20, 14]) == pytest.approx((0.045994, 0.073790), abs=1e-6)
    found = {e: {r.a: r.th for r in T.thresholds(total, e).collect()} for e in (0.05, 0.01, 1e-3)}
    assert (found[0.05][10], found[0.01][10], found[1e-3][10]) == (8, 10, 10010) and found[0.05][20] == 13
    rows = spark.createDataFrame([(10, 5), (10, 6), (21, 20), (10, 11)], "n int, arc int")
    probs = {(r.n, r.arc): r.p for r in T.with_prob(rows, total, 20, "n", "arc", "p").collect()}
    assert probs == pytest.approx({(10, 5): 0.0, (10, 6): at[10, 6], (21, 20): 1.0, (10, 11): 1.0})


def test_truncated_fit_recovers_a_model():
    mu, odf = 3.0, 2.0
    hist = {x: 1000 * math.exp(log_nb(x, mu, odf * mu)) for x in range(1, 60)}
    got = fit_truncated(hist, 1.0, 1.5, 100.0, 1e-6, 100_000)
    assert got[0] == pytest.approx(mu, rel=1e-2) and got[1] == pytest.approx(odf, rel=1e-2)
    assert fit_truncated({}, 1.0, 1.5, 1.0, 1e-3, 10)[2] == 0.0


def test_mixture_fit_finds_the_mean():
    hist = {x: sum(w * math.exp(log_nb(x, *MODEL.mean_var(m))) for m, w in enumerate((300, 1000, 100))) for x in range(1, 60)}
    model, _ = fit_mixture(hist, CovModel(1.0, 1.5, 13.0, 1.5, (300.0, 300.0, 30.0, 1.0)))
    assert model.lam == pytest.approx(12, rel=0.05)


def test_vectors(spark):
    a, b = F.array(*map(F.lit, (0.2, 0.8))), F.array(*map(F.lit, (0.5, 0.5)))
    row = one(spark, tv=M.v_distance(a, b, "TV"), kl=M.v_distance(a, b, "KL"), e=M.v_entropy(b), n=M.v_normalise(F.array(F.lit(1.0), F.lit(3.0))), l=M.log_sum_exp(F.array(F.lit(-1000.0), F.lit(-1000.0))))
    assert row.tv == pytest.approx(0.3) and row.kl == pytest.approx(0.2 * math.log(0.4) + 0.8 * math.log(1.6)) and row.e == pytest.approx(math.log(2)) and row.n == [0.25, 0.75] and row.l == pytest.approx(-1000 + math.log(2))


def test_ratio_of_two_densities_is_compared_in_four_digits(spark):
    near, x = 17.170731707317074, F.col("x")
    rows = spark.createDataFrame([(1.00049,), (1.0006,), (0.99996,), (0.0,), (float("inf"),), (12345.6,)], "x double")
    assert [r[0] for r in rows.select(M.significant(x, 4)).collect()] == pytest.approx([1.0, 1.001, 1.0, 0.0, float("inf"), 12350.0])
    ratio = M.negbinomial_ratio(*(F.lit(float(v)) for v in (near, 12, 18, 24, 36)))
    assert one(spark, whole=ratio > 1, single=M.significant(ratio, 4) > 1) == (True, False)
