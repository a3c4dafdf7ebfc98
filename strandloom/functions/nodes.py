"""Small functions on windows, nodes, chains and numbers, as column expressions where rows are concerned."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.operators.graph import both_strands

# Windows.


def push_right(kmer: Column, base: Column) -> Column:
    """The window one base further on."""
    return F.concat(F.substring(kmer, F.lit(2), F.length(kmer) - 1), base)


def push_left(kmer: Column, base: Column) -> Column:
    """The window one base back."""
    return F.concat(base, F.substring(kmer, F.lit(1), F.length(kmer) - 1))


def first_base(kmer: Column) -> Column:
    return F.substring(kmer, 1, 1)


def last_base(kmer: Column) -> Column:
    return F.substring(kmer, -1, 1)


def base_before(seq: Column, offset: Column) -> Column:
    """The base before a window at an offset; null at the start."""
    return F.when(offset > 0, F.substring(seq, offset, F.lit(1)))


def base_after(seq: Column, offset: Column, k: int) -> Column:
    """The base after a window of k at an offset; null at the end."""
    return F.when(offset + k < F.length(seq), F.substring(seq, offset + k + 1, F.lit(1)))


def marginal_left(seq: Column, k: int) -> Column:
    """The first base of a node that its left neighbours don't share."""
    return F.substring(seq, k, 1)


def marginal_right(seq: Column, k: int) -> Column:
    """The last base of a node that its right neighbours don't share."""
    return F.substring(seq, F.length(seq) - k + 1, F.lit(1))


# Nodes, arcs and chains.


def neighbours_by_base(nodes: DataFrame, arcs: DataFrame, k: int) -> DataFrame:
    """(src, base, dst): where each signed node goes on by a base; a base leads to one node at most in a proper graph, and the smallest counts."""
    to = both_strands(arcs).select("src", "dst").join(nodes.select(F.col("node_id").alias("to"), "seq"), F.abs("dst") == F.col("to"))
    return to.groupBy("src", marginal_left(S.oriented(F.col("seq"), F.col("dst")), k).alias("base")).agg(F.min("dst").alias("dst"))


def with_existing(pairs: DataFrame, nodes: DataFrame, arcs: DataFrame, name: str = "exists") -> DataFrame:
    """pairs (src, dst) with whether there is such an arc, on either strand, between nodes that there are."""
    strands = both_strands(arcs).select("src", "dst").distinct()
    for side in ("src", "dst"):
        strands = strands.join(nodes.select(F.col("node_id").alias("__n")), F.abs(side) == F.col("__n"), "left_semi")
    return pairs.join(strands.withColumn(name, F.lit(True)), ["src", "dst"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def with_existing_path(chains: DataFrame, nodes: DataFrame, arcs: DataFrame, chain: str = "chain", name: str = "exists") -> DataFrame:
    """(id, exists) of chains (id, chain): whether every two neighbours are joined by an arc; chains of one node and of none exist."""
    steps = F.transform(F.sequence(F.lit(1), F.size(chain) - 1), lambda i: F.struct(F.col(chain)[i - 1].alias("src"), F.col(chain)[i].alias("dst")))
    pairs = chains.filter(F.size(chain) > 1).select("id", F.explode(steps).alias("s")).select("id", "s.src", "s.dst")
    met = with_existing(pairs, nodes, arcs, "__one").groupBy("id").agg(F.bool_and("__one").alias(name))
    return chains.select("id").join(met, "id", "left").withColumn(name, F.coalesce(name, F.lit(True)))


def path_coverage(chains: DataFrame, nodes: DataFrame, chain: str = "chain") -> DataFrame:
    """(id, coverage) of chains (id, chain): the mean over the k-mers of their nodes (node_id, cov, mlen)."""
    one = chains.select("id", F.explode(chain).alias("node")).join(nodes.select("node_id", "cov", "mlen"), F.abs("node") == F.col("node_id"))
    return one.groupBy("id").agg((F.sum("cov") / F.sum("mlen")).alias("coverage"))


def chain_contains(chain: Column, node: Column) -> Column:
    """Whether a chain has a node, on either strand."""
    return F.array_contains(chain, node) | F.array_contains(chain, -node)


def chain_before(a: Column, b: Column) -> Column:
    """Whether a chain comes before another: node by node, then the shorter one."""
    return a < b


def rank(bits: Column) -> Column:
    """How many bits are set before each place of an array of booleans."""
    return F.transform(bits, lambda _, i: F.size(F.filter(F.slice(bits, F.lit(1), i), lambda x: x)))


# Numbers.


def human_time(seconds: Column) -> Column:
    """A time in days, hours, minutes, seconds or milliseconds, the largest units that it has."""
    s = F.floor(seconds)
    days, hours, minutes, rest = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60), s % 60
    text = lambda *xs: F.concat(*[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in xs])
    ms = F.floor((seconds - s) * 1000)
    return (
        F.when(days > 0, text(days, "d ", hours, "h ", minutes, "min"))
        .when(hours > 0, text(hours, "h ", minutes, "min ", rest, "s"))
        .when(minutes > 0, text(minutes, "min ", rest, "s"))
        .when(rest > 0, text(rest, "s ", ms, "ms"))
        .otherwise(text(ms, "ms"))
    )


def human_size(size: Column) -> Column:
    """A number of bytes in the largest unit of 1024 that it exceeds, with four digits."""
    found = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("kB", "MB", "GB", "TB"), 1):
        x = size / float(1 << 10 * power)
        digits = F.greatest(F.lit(3) - F.floor(F.log10(x)).cast("int"), F.lit(0))
        plain = F.regexp_replace(F.regexp_replace(F.format_string("%.3f", F.round(x * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)), r"0+$", ""), r"\.$", "")
        found = F.when(size > (1 << 10 * power), F.concat(plain, F.lit(f" {unit}"))).otherwise(found)
    return found


def determinant(matrix: Sequence[Sequence[float]]) -> float:
    return float(np.linalg.det(np.asarray(matrix, float))) if len(matrix) else 1.0


def linear_index(states: Sequence[int], cards: Sequence[int]) -> int:
    """The number of a joint state; the first variable runs fastest."""
    return int(np.ravel_multi_index(tuple(states), tuple(cards), order="F")) if len(cards) else 0


def states_of(index: int, cards: Sequence[int]) -> tuple[int, ...]:
    return tuple(int(x) for x in np.unravel_index(index, tuple(cards), order="F")) if len(cards) else ()


def counted(cards: Sequence[int]):
    """All joint states in order."""
    return (states_of(i, cards) for i in range(math.prod(cards)))


def permuted(table: np.ndarray, order: Sequence[int]) -> np.ndarray:
    """A table with its variables in another order."""
    return np.transpose(table, order)
