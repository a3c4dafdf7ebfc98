"""Exact inference in a junction tree of a factor graph, and a registry of inference methods by name.

Cliques come from an elimination order, the tree is a maximum spanning tree of what they share, and beliefs are calibrated
by two sweeps of messages: HUGIN keeps a potential on every separator and divides by it, Shafer-Shenoy keeps the messages
and never divides. All tables are logarithms.
"""

from __future__ import annotations

import enum
import itertools
import math
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

import numpy as np

from strandloom.operators.crf import Factor
from strandloom.operators.inference import Options, Propagation, enumerate_exactly, mean_field, spanning_tree


class Code(enum.Enum):
    """What can be wrong with a question to an inference method."""

    UNKNOWN_METHOD = "there is no method of this name"
    UNKNOWN_PROPERTY = "the method has no such property"
    BAD_PROPERTY = "the value of a property can't be read"
    BAD_ALIAS = "an alias can't be read"
    TOO_LARGE = "a clique would be larger than allowed"
    NO_SUCH_VARIABLE = "no factor has the variable"
    IMPOSSIBLE = "all states have probability zero"
    EMPTY = "there are no factors"


class InferenceError(ValueError):
    def __init__(self, code: Code, what: object = ""):
        super().__init__(f"{code.value}: {what}" if what != "" else code.value)
        self.code = code


def _near(factors: Iterable[Factor]) -> tuple[dict[int, set[int]], dict[int, int]]:
    near: dict[int, set[int]] = {}
    card: dict[int, int] = {}
    for f in factors:
        for v, n in zip(f.vars, f.table.shape, strict=True):
            near.setdefault(v, set()).update(f.vars)
            card[v] = n
    for v in near:
        near[v].discard(v)
    return near, card


def order_by(factors: list[Factor], rule: str = "MINFILL") -> list[int]:
    """An elimination order: each time the variable of fewest neighbours (MINNEIGHBORS), of the smallest clique (MINWEIGHT), of the fewest new pairs of neighbours (MINFILL) or of the lightest ones (WEIGHTEDMINFILL); the lowest number first of equals."""
    near, card = _near(factors)

    def cost(v: int) -> float:
        if rule == "MINNEIGHBORS":
            return len(near[v])
        if rule == "MINWEIGHT":
            return math.prod(card[x] for x in near[v])
        missing = [(a, b) for a, b in itertools.combinations(near[v], 2) if b not in near[a]]
        return len(missing) if rule == "MINFILL" else sum(card[a] * card[b] for a, b in missing)

    order = []
    while near:
        v = min(near, key=lambda x: (cost(x), x))
        others = near.pop(v)
        for x in others:
            near[x] |= others
            near[x] -= {x, v}
        order.append(v)
    return order


def cliques_of(factors: list[Factor], order: list[int]) -> list[frozenset[int]]:
    """The largest cliques that elimination in this order makes."""
    near, _ = _near(factors)
    found: list[frozenset[int]] = []
    for v in order:
        others = near.pop(v)
        clique = frozenset(others | {v})
        if not any(clique <= c for c in found):
            found.append(clique)
        for x in others:
            near[x] |= others
            near[x] -= {x, v}
    return found


def treewidth_bound(factors: list[Factor], rule: str = "MINFILL") -> tuple[int, float]:
    """An upper bound of the treewidth, and the number of states of the largest clique that goes with it."""
    _, card = _near(factors)
    found = cliques_of(factors, order_by(factors, rule))
    return max((len(c) for c in found), default=1) - 1, float(max((math.prod(card[v] for v in c) for c in found), default=1))


def _summed(f: Factor, keep: Iterable[int], best: bool = False) -> Factor:
    for v in [v for v in f.vars if v not in set(keep)]:
        f = f.max_without(v) if best else f.without(v)
    return f


@dataclass(frozen=True)
class TreeOptions:
    """updates: HUGIN or SHSH (Shafer-Shenoy); heuristic: see order_by; infer: SUMPROD or MAXPROD."""

    updates: str = "HUGIN"
    heuristic: str = "MINFILL"
    infer: str = "SUMPROD"
    max_size: float = 1e6


class JunctionTree:
    """A calibrated junction tree (a forest where the graph has several components)."""

    def __init__(self, factors: list[Factor], options: TreeOptions | None = None):
        if not factors:
            raise InferenceError(Code.EMPTY)
        self.options = o = options or TreeOptions()
        self.card = _near(factors)[1]
        self.cliques = cliques_of(factors, order_by(factors, o.heuristic))
        largest = max(math.prod(self.card[v] for v in c) for c in self.cliques)
        if largest > o.max_size:
            raise InferenceError(Code.TOO_LARGE, largest)
        shared = {(i, j): len(a & b) for (i, a), (j, b) in itertools.combinations(enumerate(self.cliques), 2) if a & b}
        self.edges = spanning_tree(shared, largest=True)
        self.potentials = [Factor(tuple(sorted(c)), np.zeros([self.card[v] for v in sorted(c)])) for c in self.cliques]
        for f in factors:
            home = next(i for i, c in enumerate(self.cliques) if set(f.vars) <= c)
            self.potentials[home] = self.potentials[home] * f
        self.beliefs, self.separators = self._calibrated()

    def _order(self) -> list[tuple[int, int]]:
        """(child, parent) of every edge, leaves first."""
        near: dict[int, list[int]] = {i: [] for i in range(len(self.cliques))}
        for a, b in self.edges:
            near[a].append(b)
            near[b].append(a)
        seen, down = set(), []
        for root in near:
            if root in seen:
                continue
            seen.add(root)
            front = [root]
            while front:
                i = front.pop()
                for j in near[i]:
                    if j not in seen:
                        seen.add(j)
                        down.append((j, i))
                        front.append(j)
        return down[::-1]

    def _calibrated(self) -> tuple[list[Factor], dict[tuple[int, int], Factor]]:
        best, up = self.options.infer == "MAXPROD", self._order()
        between = {e: self.cliques[e[0]] & self.cliques[e[1]] for e in up}
        ways = [*up, *[(p, c) for c, p in reversed(up)]]
        if self.options.updates == "HUGIN":
            beliefs = list(self.potentials)
            held: dict[frozenset, Factor] = {}
            for a, b in ways:
                shared, key = between[(a, b) if (a, b) in between else (b, a)], frozenset((a, b))
                new = _summed(beliefs[a], shared, best)
                old = held.get(key)
                ratio = new if old is None else Factor(new.vars, np.where(np.isneginf(new.table), -np.inf, new.table - np.where(np.isneginf(old.over(new.vars)), 0, old.over(new.vars))))
                beliefs[b], held[key] = beliefs[b] * ratio, new
            return beliefs, {e: held[frozenset(e)] for e in up}
        sent: dict[tuple[int, int], Factor] = {}
        near: dict[int, list[int]] = {}
        for a, b in up:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)

        def gathered(i: int, but: int | None = None) -> Factor:
            f = self.potentials[i]
            for j in near.get(i, []):
                if j != but and (j, i) in sent:
                    f = f * sent[j, i]
            return f

        for a, b in ways:
            sent[a, b] = _summed(gathered(a, b), between[(a, b) if (a, b) in between else (b, a)], best)
        return [gathered(i) for i in range(len(self.cliques))], {(a, b): sent[a, b] * sent[b, a] for a, b in up}

    def belief(self, *vars_: int) -> Factor:
        """P of some variables (max-marginals under MAXPROD); those that no clique has together are put together from the whole tree."""
        for v in vars_:
            if v not in self.card:
                raise InferenceError(Code.NO_SUCH_VARIABLE, v)
        best = self.options.infer == "MAXPROD"
        home = next((b for b, c in zip(self.beliefs, self.cliques, strict=True) if set(vars_) <= c), None)
        if home is None:
            found = self._joined(set(vars_))
        else:
            found = _summed(home, vars_, best)
        z = np.logaddexp.reduce(found.table, axis=None)
        if np.isneginf(z):
            raise InferenceError(Code.IMPOSSIBLE)
        return Factor(vars_, np.exp(found.over(vars_) - z))

    def _joined(self, keep: set[int]) -> Factor:
        """A marginal outside any clique: from the leaves on, each clique hands over what its parent shares and what is asked for."""
        best, held = self.options.infer == "MAXPROD", list(self.potentials)
        up = self._order()
        for child, parent in up:
            asked = (set(held[child].vars) & keep) | (self.cliques[child] & self.cliques[parent])
            held[parent] = held[parent] * _summed(held[child], asked, best)
        children = {c for c, _ in up}
        whole = None
        for i in range(len(self.cliques)):
            if i not in children:
                part = _summed(held[i], keep, best)
                whole = part if whole is None else whole * part
        return whole

    def log_z(self) -> float:
        """ln Z: clique beliefs less what separators count twice."""
        total, children = 0.0, {c for c, _ in self._order()}
        for i, b in enumerate(self.beliefs):
            if i not in children:
                total += float(np.logaddexp.reduce(b.table, axis=None))
        return total

    def decode(self) -> dict[int, int]:
        """The most probable joint state (of a tree calibrated by MAXPROD): from the roots on, each clique takes its best state that agrees with what is fixed."""
        state: dict[int, int] = {}
        up = self._order()
        children = [c for c, _ in up]
        for i in [*[i for i in range(len(self.cliques)) if i not in set(children)], *reversed(children)]:
            b = self.beliefs[i]
            table = b.table[tuple(state.get(v, slice(None)) for v in b.vars)]
            free = [v for v in b.vars if v not in state]
            if free:
                state |= dict(zip(free, map(int, np.unravel_index(int(np.argmax(table)), table.shape)), strict=True))
        return state


def _bp(factors: list[Factor], **given) -> dict[int, np.ndarray]:
    p = Propagation(factors, replace(Options(), **given))
    p.run()
    return {v: p.belief(v) for v in p.card}


def _tree(factors: list[Factor], **given) -> dict[int, np.ndarray]:
    t = JunctionTree(factors, replace(TreeOptions(), **given))
    return {v: t.belief(v).table for v in t.card}


#: Methods by name: what they are asked by, and their properties with the names and types that they have here.
METHODS: dict[str, tuple[Callable, dict[str, tuple[str, type]]]] = {
    "BP": (_bp, {"updates": ("schedule", str), "inference": ("infer", str), "maxiter": ("max_iter", int), "tol": ("tol", float), "damping": ("damping", float), "weightdecay": ("weight_decay", bool)}),
    "JTREE": (_tree, {"updates": ("updates", str), "heuristic": ("heuristic", str), "inference": ("infer", str), "maxmem": ("max_size", float)}),
    "MF": (lambda factors, **given: mean_field(factors, **given), {"maxiter": ("max_iter", int), "tol": ("tol", float), "updates": ("hard", lambda x: x == "HARDSPIN")}),
    "EXACT": (lambda factors: enumerate_exactly(factors)[0], {}),
}


def parsed(text: str, aliases: dict[str, str] | None = None) -> tuple[str, dict[str, str]]:
    """A method's name and properties from `NAME[key=value,key=value]`; an alias stands for such a text, and properties given beside it win."""
    m = re.fullmatch(r"\s*([^\[\]\s]+)\s*(?:\[(.*)\])?\s*", text)
    if not m:
        raise InferenceError(Code.BAD_PROPERTY, text)
    given = {}
    for part in filter(None, (m[2] or "").split(",")):
        key, equals, value = part.partition("=")
        if not equals:
            raise InferenceError(Code.BAD_PROPERTY, part)
        given[key.strip()] = value.strip()
    if aliases and m[1] in aliases:
        name, base = parsed(aliases[m[1]], {k: v for k, v in aliases.items() if k != m[1]})
        return name, base | given
    return m[1], given


def parsed_aliases(text: str) -> dict[str, str]:
    """Lines of `alias: NAME[...]`; empty lines and those that begin with # are left out."""
    found = {}
    for line in text.splitlines():
        if line.strip() and not line.lstrip().startswith("#"):
            name, colon, what = line.partition(":")
            if not colon or not name.strip() or not what.strip():
                raise InferenceError(Code.BAD_ALIAS, line)
            found[name.strip()] = what.strip()
    return found


def infer(factors: list[Factor], method: str, aliases: dict[str, str] | None = None) -> dict[int, np.ndarray]:
    """Beliefs of all variables by a method with its properties."""
    name, given = parsed(method, aliases)
    if name not in METHODS:
        raise InferenceError(Code.UNKNOWN_METHOD, name)
    if not factors:
        raise InferenceError(Code.EMPTY)
    run, known = METHODS[name]
    options = {}
    for key, value in given.items():
        if key not in known:
            raise InferenceError(Code.UNKNOWN_PROPERTY, key)
        own, kind = known[key]
        try:
            options[own] = value in ("1", "true", "True") if kind is bool else kind(value)
        except ValueError as e:
            raise InferenceError(Code.BAD_PROPERTY, f"{key}={value}") from e
    return run(factors, **options)
