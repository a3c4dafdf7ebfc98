"""Column expressions of the coverage model's mathematics and of probability vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lanczos approximation, g = 7, 9 coefficients (fixed values).
LANCZOS = (
    0.99999999999980993,
    676.5203681218851,
    -1259.1392167224028,
    771.32342877765313,
    -176.61502916214059,
    12.507343278686905,
    -0.13857109526572012,
    9.9843695780195716e-6,
    1.5056327351493116e-7,
)


def let(value: Column, use) -> Column:
    """use(value) with value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def lgamma(x: Column) -> Column:
    """ln Gamma for x of at least 0.5."""
    z = x - 1
    series = sum((F.lit(c) / (z + i) for i, c in enumerate(LANCZOS[1:], 1)), F.lit(LANCZOS[0]))
    t = z + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.log(t) - t + F.log(series)


def log_poisson(k: Column, mean: Column) -> Column:
    return k * F.log(mean) - mean - lgamma(k + 1)


def poisson(k: Column, mean: Column) -> Column:
    return F.exp(log_poisson(k, mean))


def poisson_ratio(k: Column, a: Column, b: Column) -> Column:
    """P(k; a) / P(k; b)."""
    return F.exp(k * (F.log(a) - F.log(b)) + b - a)


def log_negbinomial(k: Column, mean: Column, var: Column) -> Column:
    """ln of the negative binomial of a mean and a variance, for whole or fractional k; Poisson if the variance hardly exceeds the mean."""
    excess = var - mean
    p, r = excess / var, mean * mean / excess
    full = lgamma(k + r) - lgamma(k + 1) - lgamma(r) + r * F.log(1 - p) + k * F.log(p)
    return F.when(excess < 1e-3, log_poisson(k, mean)).otherwise(full)


def negbinomial(k: Column, mean: Column, var: Column) -> Column:
    return F.exp(log_negbinomial(k, mean, var))


def negbinomial_ratio(k: Column, mean_a: Column, var_a: Column, mean_b: Column, var_b: Column) -> Column:
    return F.exp(log_negbinomial(k, mean_a, var_a) - log_negbinomial(k, mean_b, var_b))


def significant(x: Column, digits: int) -> Column:
    """A positive number rounded to as many digits, halves up; 0 and infinity stay as they are."""
    scale = F.pow(F.lit(10.0), digits - F.ceil(F.log10(x)))
    return F.when((x > 0) & (x < float("inf")), F.floor(x * scale + 0.5) / scale).otherwise(x)


def log_geometric(k: Column, mean: Column) -> Column:
    """ln of (1 - p) ** (k - 1) * p with p = 1 / mean."""
    return (k - 1) * F.log(1 - 1 / mean) - F.log(mean)


def geometric(k: Column, mean: Column) -> Column:
    return F.exp(log_geometric(k, mean))


def geometric_negbinomial_ratio(k: Column, mean: Column, nb_mean: Column, nb_var: Column) -> Column:
    return F.exp(log_geometric(k, mean) - log_negbinomial(k, nb_mean, nb_var))


def log_sum_exp(values: Column) -> Column:
    """Of an array."""
    return let(values, lambda v: let(F.array_max(v), lambda top: top + F.log(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)))))


def log_sum_exp2(x: Column, y: Column) -> Column:
    top = F.greatest(x, y)
    return top + F.log(F.exp(x - top) + F.exp(y - top))


def log_sum_exp_over(value: Column, top: Column) -> Column:
    """As an aggregate, with top a column that holds the group's largest value."""
    return F.max(top) + F.log(F.sum(F.exp(value - top)))


def rel_diff(a: Column, b: Column) -> Column:
    part = lambda x: F.when(x == 0, F.lit(float("inf"))).otherwise(F.abs((a - b) / x))
    return F.when((a == 0) & (b == 0), F.lit(0.0)).otherwise(F.greatest(part(a), part(b)))


def ratio(part: Column, other: Column, default: float = 1.0) -> Column:
    """part / (part + other): sensitivity of true positives and false negatives, specificity of true negatives and false positives."""
    return F.when(part + other == 0, F.lit(default)).otherwise(part / (part + other))


def percentage(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(100 * part / whole)


def factorial_ratio(n: Column, k: Column) -> Column:
    """n! / k! for n >= k."""
    return F.when(n == k, F.lit(1.0)).otherwise(F.aggregate(F.sequence(k + 1, n), F.lit(1.0), lambda acc, i: acc * i))


# Probability vectors, as arrays of doubles.


def v_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def v_sum_abs(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.abs(x))


def v_max_abs(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: F.greatest(acc, F.abs(x)))


def v_normalise(v: Column) -> Column:
    return let(v_sum(v), lambda total: F.transform(v, lambda x: x / total))


def v_log0(v: Column) -> Column:
    return F.transform(v, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(F.log(x)))


def v_inverse0(v: Column) -> Column:
    return F.transform(v, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(1 / x))


def v_divide0(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.when(y == 0, F.lit(0.0)).otherwise(x / y))


def v_power(v: Column, to: float) -> Column:
    return F.transform(v, lambda x: F.pow(x, F.lit(to)))


def v_entropy(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc - F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0)))


def v_inner(a: Column, b: Column) -> Column:
    return v_sum(F.zip_with(a, b, lambda x, y: x * y))


def v_distance(a: Column, b: Column, kind: str) -> Column:
    """L1, LINF, TV, KL or HELLINGER."""
    gap = lambda x, y: F.abs(x - y)
    if kind == "L1":
        return v_sum(F.zip_with(a, b, gap))
    if kind == "LINF":
        return F.array_max(F.zip_with(a, b, gap))
    if kind == "TV":
        return v_sum(F.zip_with(a, b, gap)) / 2
    if kind == "KL":
        return v_sum(F.zip_with(a, b, lambda x, y: F.when(x == 0, F.lit(0.0)).otherwise(x * (F.log(x) - F.log(y)))))
    if kind == "HELLINGER":
        return v_sum(F.zip_with(a, b, lambda x, y: F.pow(F.sqrt(x) - F.sqrt(y), F.lit(2.0)))) / 2
    raise ValueError(f"unknown distance {kind}")
