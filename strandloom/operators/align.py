"""Alignments of sequences to each other and to a graph."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.session import ship

#: Visited nodes after which a graph search stops.
VISITS = 1000


@dataclass(frozen=True)
class Scores:
    match: int = 1
    mismatch: int = -1
    gap: int = -3

    def of(self, a: str, b: str) -> int:
        return self.match if a == b or a == "N" or b == "N" else self.mismatch


@dataclass(frozen=True)
class Alignment:
    """score, and steps of M (match), X (mismatch), I (only in the second), D (only in the first) over [0, end1) and [0, end2)."""

    score: int
    steps: str
    end1: int
    end2: int

    @property
    def stats(self) -> tuple[int, int, int]:
        return self.steps.count("M"), self.steps.count("X"), self.steps.count("I") + self.steps.count("D")

    def show(self, a: str, b: str) -> str:
        """Three lines: the sequences with gaps and what agrees."""
        top, mid, low, i, j = [], [], [], 0, 0
        for s in self.steps:
            top.append(a[i] if s != "I" else "-")
            low.append(b[j] if s != "D" else "-")
            mid.append("|" if s == "M" else " ")
            i, j = i + (s != "I"), j + (s != "D")
        return "\n".join(map("".join, (top, mid, low)))


def _table(a: str, b: str, scores: Scores, free_start: bool = False) -> np.ndarray:
    n, m = len(a), len(b)
    t = np.empty((n + 1, m + 1), np.int64)
    codes_b = np.frombuffer(b.encode(), np.uint8)
    columns = np.arange(m + 1)
    t[0] = 0 if free_start else columns * scores.gap
    for i in range(1, n + 1):
        same = (codes_b == ord(a[i - 1])) | (codes_b == ord("N")) | (a[i - 1] == "N")
        row = t[i - 1] + scores.gap
        row[1:] = np.maximum(row[1:], t[i - 1, :-1] + np.where(same, scores.match, scores.mismatch))
        # gaps along the row: the running maximum of row minus its gap cost
        row = np.maximum.accumulate(row - columns * scores.gap) + columns * scores.gap
        t[i] = row
    return t


def _trace(t: np.ndarray, a: str, b: str, scores: Scores, i: int, j: int, free_start: bool = False) -> str:
    steps = []
    while i or j:
        if free_start and i == 0:
            break
        if i and j and t[i, j] == t[i - 1, j - 1] + scores.of(a[i - 1], b[j - 1]):
            steps.append("M" if scores.of(a[i - 1], b[j - 1]) == scores.match else "X")
            i, j = i - 1, j - 1
        elif i and t[i, j] == t[i - 1, j] + scores.gap:
            steps.append("D")
            i -= 1
        else:
            steps.append("I")
            j -= 1
    return "".join(reversed(steps))


def align(a: str, b: str, scores: Scores | None = None) -> Alignment:
    """Global alignment."""
    scores = scores or Scores()
    t = _table(a, b, scores)
    return Alignment(int(t[-1, -1]), _trace(t, a, b, scores, len(a), len(b)), len(a), len(b))


def _band_table(a: str, b: str, scores: Scores, band: int) -> np.ndarray:
    """The table of a global alignment between the diagonals -band and band: column c of row i is place i - band + c of b."""
    n, m, low, width = len(a), len(b), -(1 << 40), 2 * band + 1
    codes = np.frombuffer(b.encode(), np.uint8)
    t = np.full((n + 1, width), low, np.int64)
    cost = np.arange(width) * scores.gap
    t[0, band : band + min(band, m) + 1] = np.arange(min(band, m) + 1) * scores.gap
    for i in range(1, n + 1):
        j = np.arange(i - band, i + band + 1)
        inside = (j >= 1) & (j <= m)
        before = codes[np.clip(j - 1, 0, max(m - 1, 0))] if m else np.zeros(width, np.uint8)
        same = (before == ord(a[i - 1])) | (before == ord("N")) | (a[i - 1] == "N")
        row = np.where(inside, t[i - 1] + np.where(same, scores.match, scores.mismatch), low)
        row[:-1] = np.maximum(row[:-1], t[i - 1, 1:] + scores.gap)
        row = np.maximum.accumulate(row - cost) + cost
        t[i] = np.where((j >= 0) & (j <= m), np.maximum(row, low), low)
    return t


def align_banded(a: str, b: str, band: int, scores: Scores | None = None) -> Alignment:
    """Global alignment with at most `band` more bases of one than of the other on the way; longer differences are an error. Memory follows the length times the band."""
    scores = scores or Scores()
    if abs(len(a) - len(b)) > band:
        raise ValueError("the lengths differ by more than the band")
    t = _band_table(a, b, scores, band)
    at = lambda i, j: int(t[i, j - i + band]) if abs(j - i) <= band else -(1 << 40)
    steps, i, j = [], len(a), len(b)
    while i or j:
        if i and j and at(i, j) == at(i - 1, j - 1) + scores.of(a[i - 1], b[j - 1]):
            steps.append("M" if scores.of(a[i - 1], b[j - 1]) == scores.match else "X")
            i, j = i - 1, j - 1
        elif i and at(i, j) == at(i - 1, j) + scores.gap:
            steps.append("D")
            i -= 1
        else:
            steps.append("I")
            j -= 1
    return Alignment(at(len(a), len(b)), "".join(reversed(steps)), len(a), len(b))


def align_free_end(a: str, b: str, scores: Scores | None = None, both: bool = True) -> Alignment:
    """From both starts; what is left of the second (both: of either) at the end costs nothing."""
    scores = scores or Scores()
    t = _table(a, b, scores)
    i, j = len(a), int(t[-1].argmax())
    if both and t[:, -1].max() > t[i, j]:
        i, j = int(t[:, -1].argmax()), len(b)
    return Alignment(int(t[i, j]), _trace(t, a, b, scores, i, j), i, j)


def align_overlap(a: str, b: str, scores: Scores | None = None) -> Alignment:
    """The end of the second against the start of the first: the second's start and the first's end are free."""
    scores = scores or Scores()
    t = _table(a, b, scores, free_start=True)
    i = int(t[:, -1].argmax())
    return Alignment(int(t[i, -1]), _trace(t, a, b, scores, i, len(b), free_start=True), i, len(b))


def trimmed(found: Alignment) -> Alignment:
    """Without gaps at the end."""
    steps = found.steps.rstrip("ID")
    cut = found.steps[len(steps) :]
    return Alignment(found.score, steps, found.end1 - cut.count("D"), found.end2 - cut.count("I"))


@dataclass
class LocalGraph:
    """Sequences and ways of a part of a graph, both strands."""

    seqs: dict[int, str]
    ways: dict[int, list[int]]
    k: int

    def distances(self, start: int, most: int) -> dict[int, int]:
        """Bases from the end of a node to the end of others, shortest first, up to a number."""
        import heapq

        found, heap = {}, [(0, start)]
        while heap:
            d, node = heapq.heappop(heap)
            if node in found or d > most:
                continue
            found[node] = d
            for other in self.ways.get(node, []):
                heapq.heappush(heap, (d + len(self.seqs[other]) - self.k + 1, other))
        return found

    def extend(self, start: int, pos: int, read: str, scores: Scores | None = None, target: int | None = None) -> tuple[Alignment, list[int]]:
        """The best alignment of a read's rest along paths from a place on a node, all of the read against the path's start: branch and bound over a depth-first search. With a target the path must end there."""
        scores = scores or Scores()
        best: tuple[int, Alignment | None, list[int]] = (-(1 << 40), None, [])
        stack = [([start], self.seqs[start][pos:])]
        visits = 0
        while stack and visits < VISITS:
            path, text = stack.pop()
            visits += 1
            found = align_free_end(read, text, scores, both=False)
            if (target is None or path[-1] == target) and found.score > best[0]:
                best = (found.score, found, path)
            reach = min(len(text), len(read))
            part = align_free_end(text[:reach], read, scores, both=False).score if reach else 0
            if len(text) >= len(read) + 1 or part + scores.match * max(len(read) - reach, 0) + scores.match <= best[0]:
                continue  # nothing better can come
            for other in sorted(self.ways.get(path[-1], []), reverse=True):
                stack.append(([*path, other], text + self.seqs[other][self.k - 1 :]))
        return best[1] or Alignment(0, "", 0, 0), best[2]


def align_pairs(pairs: DataFrame, a: str, b: str, scores: Scores | None = None) -> DataFrame:
    """pairs with the score and the numbers of matches, mismatches and gaps of the global alignment of two columns."""
    ship(pairs.sparkSession)
    scores = scores or Scores()

    def run(frames):
        for pdf in frames:
            found = [align(x, y, scores) for x, y in zip(pdf[a], pdf[b], strict=True)]
            yield pdf.drop(columns=[a, b]).assign(score=[f.score for f in found], n_match=[f.stats[0] for f in found], n_subst=[f.stats[1] for f in found], n_indel=[f.stats[2] for f in found])

    kept = [f"`{n}` {t}" for n, t in pairs.dtypes if n not in (a, b)]
    return pairs.mapInPandas(run, ", ".join([*kept, "score long", "n_match long", "n_subst long", "n_indel long"]))


def covered(nodes: DataFrame, arcs: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """(seed, node): signed nodes that start less than `need` bases behind the end of a seed, along arcs, for seeds (seed, need); each seed too. Distances are relaxed until nothing changes, which ends, as every node adds a base."""
    from strandloom.operators.graph import both_strands, oriented_nodes
    from strandloom.plans.tables import stored

    add = oriented_nodes(nodes, k).select(F.col("node_id").alias("dst"), (F.length("seq") - k + 1).alias("w"))
    steps = stored(both_strands(arcs).join(add, "dst").select(F.col("src").alias("node"), "dst", "w").distinct(), "steps")
    found = stored(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("dist"), "need"), "covered")
    front = found
    while not front.isEmpty():
        more = front.filter("dist < need").join(steps, "node").select("seed", F.col("dst").alias("node"), (F.col("dist") + F.col("w")).alias("dist"), "need")
        more = more.groupBy("seed", "node").agg(F.min("dist").alias("dist"), F.first("need").alias("need"))
        known = found.select("seed", "node", F.col("dist").alias("had"))
        front = stored(more.join(known, ["seed", "node"], "left").filter("had IS NULL OR dist < had").select("seed", "node", "dist", "need"), "front")
        found = stored(found.unionByName(front).groupBy("seed", "node").agg(F.min("dist").alias("dist"), F.first("need").alias("need")), "covered")
    return found.select("seed", "node")


def align_reads(reads: DataFrame, hits: DataFrame, nodes: DataFrame, arcs: DataFrame, k: int, scores: Scores | None = None) -> DataFrame:
    """(read_id, aligned, score, path, n_subst, n_indel): reads along the graph from their first hit both ways, over all nodes that a read's length reaches. A read without a hit comes back as not aligned, with an empty path. Each read comes with its own local graph, so no part of the graph is on every executor."""
    from strandloom.operators.graph import both_strands, oriented_nodes
    from strandloom.plans.tables import stored

    ship(reads.sparkSession)
    scores = scores or Scores(2, -1, -3)
    first = hits.groupBy("read_id").agg(F.min(F.struct("offset", "node", "pos")).alias("h")).select("read_id", "h.*")
    seqs = oriented_nodes(nodes, k).select(F.col("node_id").alias("node"), "seq")
    placed = reads.select("read_id", F.col("seq").alias("read")).join(first, "read_id").join(seqs.select("node", F.length("seq").alias("size")), "node")
    placed = stored(placed, "placed")
    ahead = placed.select(F.col("node").alias("seed"), (F.length("read") - F.col("offset") + 1 - (F.col("size") - F.col("pos"))).alias("need"))
    back = placed.select((-F.col("node")).alias("seed"), (F.col("offset") + 1 - F.col("pos")).alias("need"))
    near = covered(nodes, arcs, ahead.unionByName(back).groupBy("seed").agg(F.max("need").alias("need")), k)
    ways = both_strands(arcs).groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_list("dst")).alias("ways"))
    local = stored(near.join(seqs, "node").join(ways, "node", "left").groupBy("seed").agg(F.collect_list(F.struct("node", "seq", "ways")).alias("local")), "local")
    joined = placed.join(local.select(F.col("seed").alias("node"), "local"), "node").join(local.select((-F.col("seed")).alias("node"), F.col("local").alias("back")), "node")

    def graph(part) -> LocalGraph:
        known = {x["node"]: x["seq"] for x in part}
        return LocalGraph(known, {x["node"]: [w for w in (x["ways"] if x["ways"] is not None else []) if w in known] for x in part}, k)

    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                found, path = graph(r.local).extend(r.node, r.pos, r.read[r.offset :], scores)
                score, subst, indel = found.score, found.stats[1], found.stats[2]
                if r.offset:
                    before = r.read[: r.offset][::-1].translate(str.maketrans("ACGT", "TGCA"))
                    found, other = graph(r.back).extend(-r.node, r.size - r.pos, before, scores)
                    path = [-n for n in reversed(other[1:])] + path
                    score, subst, indel = score + found.score, subst + found.stats[1], indel + found.stats[2]
                rows.append((r.read_id, bool(path), score, path, subst, indel))
            yield pd.DataFrame(rows, columns=["read_id", "aligned", "score", "path", "n_subst", "n_indel"])

    found = joined.select("read_id", "read", "offset", "node", "pos", "size", "local", "back").mapInPandas(run, "read_id long, aligned boolean, score long, path array<int>, n_subst long, n_indel long")
    zero = F.lit(0).cast("long")
    lost = reads.join(first, "read_id", "left_anti").select(F.col("read_id").cast("long").alias("read_id"), F.lit(False).alias("aligned"), zero.alias("score"), F.array().cast("array<int>").alias("path"), zero.alias("n_subst"), zero.alias("n_indel"))
    return found.unionByName(lost)
