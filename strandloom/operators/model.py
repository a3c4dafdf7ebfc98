"""The coverage model: a mixture of negative binomials for 0, 1, 2, ... copies, and how it is fitted."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import maths as M


def log_nb(k: float, mean: float, var: float) -> float:
    excess = var - mean
    if excess < 1e-3:
        return k * math.log(mean) - mean - math.lgamma(k + 1)
    p, r = excess / var, mean * mean / excess
    return math.lgamma(k + r) - math.lgamma(k + 1) - math.lgamma(r) + r * math.log(1 - p) + k * math.log(p)


@dataclass(frozen=True)
class CovModel:
    """Mean and overdispersion of errors and of one copy; weights of 0, 1, ... copies, each at least 1 (a pseudo-count)."""

    err_lambda: float
    err_odf: float
    lam: float
    odf: float
    weights: tuple[float, ...] = field(default=(1.0,) * 6)

    def __post_init__(self):
        object.__setattr__(self, "weights", tuple(max(float(w), 1.0) for w in self.weights))

    @property
    def k(self) -> int:
        return len(self.weights)

    def mean_var(self, m: int) -> tuple[float, float]:
        return (self.err_lambda, self.err_odf * self.err_lambda) if m == 0 else (m * self.lam, m * self.lam * self.odf)

    def log_prob(self, cov: float, m: int) -> float:
        """ln of weight times density; beyond the last weight that one counts."""
        return math.log(self.weights[min(m, self.k - 1)]) + log_nb(cov, *self.mean_var(m))

    def expected(self, cov: float) -> int:
        """The more probable of the two multiplicities around cov / lam."""
        m = int(cov / self.lam)
        return m if self.log_prob(cov, m) > self.log_prob(cov, m + 1) else m + 1

    def soft(self, cov: float, alternatives: int) -> tuple[int, list[float]]:
        """First multiplicity and normalised log-probabilities of those around the expected one."""
        m = self.expected(cov)
        first = max(0, m - alternatives)
        logs = [self.log_prob(cov, x) for x in range(first, m + alternatives + 1)]
        top = max(logs)
        total = top + math.log(sum(math.exp(x - top) for x in logs))
        return first, [x - total for x in logs]

    def cutoff(self, odds: float = 1.0, epsilon: float = 1e-3) -> float:
        """The coverage between errors and one copy at which a copy is `odds` times as probable as an error."""
        low, high = self.err_lambda, self.lam
        while high - low > epsilon:
            mid = (low + high) / 2
            if self.log_prob(mid, 1) - self.log_prob(mid, 0) >= math.log(odds):
                high = mid
            else:
                low = mid
        return (low + high) / 2

    def with_weights(self, weights) -> CovModel:
        return replace(self, weights=tuple(weights))

    # The same as columns.

    def c_log_prob(self, cov: Column, m: Column) -> Column:
        weight = F.element_at(F.array(*[F.lit(math.log(w)) for w in self.weights]), (F.least(m, F.lit(self.k - 1)) + 1).cast("int"))
        mean = F.when(m == 0, F.lit(self.err_lambda)).otherwise(m * self.lam)
        var = F.when(m == 0, F.lit(self.err_lambda * self.err_odf)).otherwise(m * self.lam * self.odf)
        return weight + M.log_negbinomial(cov, mean, var)

    def c_expected(self, cov: Column) -> Column:
        m = F.floor(cov / self.lam).cast("int")
        return F.when(self.c_log_prob(cov, m) > self.c_log_prob(cov, m + 1), m).otherwise(m + 1)

    def c_soft(self, cov: Column, alternatives: int) -> Column:
        """struct(first_mult, logp)."""
        logs = lambda m: F.transform(F.sequence(F.greatest(m - alternatives, F.lit(0)), m + alternatives), lambda x: self.c_log_prob(cov, x))
        shifted = lambda found: M.let(M.log_sum_exp(found), lambda total: F.transform(found, lambda x: x - total))
        return M.let(self.c_expected(cov), lambda m: F.struct(F.greatest(m - alternatives, F.lit(0)).alias("first_mult"), M.let(logs(m), shifted).alias("logp")))


def c_best(mult: Column) -> Column:
    """The most probable multiplicity of struct(first_mult, logp), the first of equals."""
    return (F.array_position(mult["logp"], F.array_max(mult["logp"])) - 1).cast("int") + mult["first_mult"]


def c_log_odds(mult: Column) -> Column:
    """ln of the best's probability over that of all others; the largest double if there is only one."""
    best = F.array_max(mult["logp"])
    return F.when(F.size(mult["logp"]) < 2, F.lit(1.7976931348623157e308)).otherwise(best - F.log(1 - F.exp(best)))


def spectrum_table(spark, model: CovModel, hist: DataFrame | None = None) -> DataFrame:
    """(cov, p0..pK-1, hist): the mixture's components at every count from 1 on below (K + 1) copies."""
    rows = spark.range(1, max(2, math.ceil((model.k + 1) * model.lam))).select(F.col("id").cast("int").alias("cov"))
    table = rows.select("cov", *[F.exp(model.c_log_prob(F.col("cov").cast("double"), F.lit(m))).alias(f"p{m}") for m in range(model.k)])
    if hist is None:
        return table
    return table.join(F.broadcast(hist.filter("cov < %d" % math.ceil((model.k + 1) * model.lam)).select(F.col("cov").cast("int").alias("cov"), F.col("weight").alias("hist"))), "cov", "left").na.fill(0.0, ["hist"])


def rel_diff(a: float, b: float) -> float:
    if a == b == 0:
        return 0.0
    return max(abs((a - b) / x) if x else math.inf for x in (a, b))


def fit_truncated(hist: dict[int, float], mu: float, odf: float, w: float, epsilon: float, max_iter: int) -> tuple[float, float, float, int]:
    """A negative binomial for a histogram that lacks everything under its first count: mean, overdispersion, weight, iterations. The missing part is imputed in each round."""
    if not hist:
        return mu, odf, 0.0, 0
    hist, first = dict(hist), min(hist)
    for it in range(1, max_iter + 1):
        before = mu, odf, w
        for x in range(first):
            hist[x] = w * math.exp(log_nb(x, mu, odf * mu))
        w = sum(hist.values())
        mu = max(1e-12, sum(x * y for x, y in hist.items()) / w)
        odf = max(sum(y * (x - mu) ** 2 for x, y in hist.items()) / w / mu, 1 + 1e-6)
        if all(rel_diff(x, y) <= epsilon for x, y in zip((mu, odf, w), before, strict=True)):
            return mu, odf, w, it
    return mu, odf, w, max_iter + 1


def fit_mixture(hist: dict[int, float], model: CovModel, epsilon: float = 1e-3, max_iter: int = 100) -> tuple[CovModel, int]:
    """A mixture for a histogram, by expectation-maximisation on the driver; the histogram has one row for each count."""
    for it in range(1, max_iter + 1):
        w, s1, m1 = [0.0] * model.k, 0.0, 0.0
        shares = {}
        for x, y in hist.items():
            logs = [model.log_prob(x, m) for m in range(model.k)]
            top = max(logs)
            total = sum(math.exp(v - top) for v in logs)
            shares[x] = [y * math.exp(v - top) / total for v in logs]
            w = [a + b for a, b in zip(w, shares[x], strict=True)]
        err = sum(x * s[0] for x, s in shares.items()) / max(w[0], 1e-12)
        err_var = sum(s[0] * (x - err) ** 2 for x, s in shares.items()) / max(w[0], 1e-12)
        s1 = sum(x * sum(s[1:]) for x, s in shares.items())
        m1 = sum(m * s[m] for s in shares.values() for m in range(1, model.k))
        lam = max(0.5, s1 / max(m1, 1e-12))
        odf = max(1.0, sum(s[m] * (x - m * lam) ** 2 / (m * lam) for x, s in shares.items() for m in range(1, model.k)) / max(sum(w[1:]), 1e-12))
        new = CovModel(max(err, 1e-3), max(1.0, err_var / max(err, 1e-3)), lam, odf, tuple(w))
        done = rel_diff(new.lam, model.lam) <= epsilon and rel_diff(new.err_lambda, model.err_lambda) <= epsilon
        model = new
        if done:
            return model, it
    return model, max_iter + 1


def m_step(found: DataFrame, model: CovModel, epsilon: float, is_node: bool, fixed_zero: bool = False) -> CovModel:
    """The model that fits posteriors (cov, mlen, first_mult, logp) best: sums over multiplicities 1 to K - 1 and a truncated fit of the errors. For arcs mlen is 1 and cov counts once."""
    avg = F.col("cov") / F.col("mlen")
    p = found.select("cov", "mlen", avg.alias("avg"), "first_mult", F.posexplode("logp").alias("i", "lp"))
    p = p.select("cov", "mlen", "avg", (F.col("i") + F.col("first_mult")).alias("m"), F.exp("lp").alias("p"))
    sums = {r.m: r for r in p.filter(F.col("m") < model.k).groupBy("m").agg(F.sum("p").alias("w"), F.sum(F.col("p") * F.col("cov")).alias("c"), F.sum(F.col("p") * F.col("mlen")).alias("l")).collect()}
    copies = [m for m in sums if m >= 1]
    if is_node:
        lam = sum(sums[m].c for m in copies) / max(sum(sums[m].l * m for m in copies), 1e-12)
    else:
        lam = sum(sums[m].c / m for m in copies) / max(sum(sums[m].w for m in copies), 1e-12)
    lam = max(0.5, lam)
    square = {r.m: r.s for r in p.filter((F.col("m") >= 1) & (F.col("m") < model.k)).groupBy("m").agg(F.sum(F.col("p") * F.pow(F.col("avg") - F.col("m") * lam, F.lit(2.0))).alias("s")).collect()}
    odf = max(1.0, sum(s / (m * lam) for m, s in square.items()) / max(sum(sums[m].w for m in copies), 1e-12))
    err_lambda, err_odf, err_w = model.err_lambda, model.err_odf, model.weights[0]
    if not fixed_zero:
        from strandloom.operators.coverage import split_histogram

        errors = p.filter((F.col("m") == 0) & (F.col("p") > 1e-15))
        hist = {int(r.cov): r.weight for r in split_histogram(errors, "avg", "p").filter("cov > 0").collect()}
        err_lambda, err_odf, err_w, _ = fit_truncated(hist, err_lambda, err_odf, err_w, epsilon, int(10 / epsilon))
    weights = [err_w] + [sums[m].w if m in sums else 0.0 for m in range(1, model.k)]
    return CovModel(err_lambda, err_odf, lam, odf, tuple(weights))
