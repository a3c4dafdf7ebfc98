import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from strandloom.llm import exactdedup, mixing, sharding


def targets(sizes, weights=(1, 2, 3), repeats=3):
    """The rule of the targets, source by source."""
    order = sorted((s for s, _ in sizes if s is not None)) + [s for s, _ in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    size, found, active, left = dict(sizes), {}, list(order), float(sum(n for _, n in sizes))
    while active:
        share = {s: left * weight[s] / sum(weight[x] for x in active) for s in active}
        above = [s for s in active if share[s] > repeats * size[s]]
        if not above:
            return found | share
        found |= {s: float(repeats * size[s]) for s in above}
        left -= sum(found[s] for s in above)
        active = [s for s in active if s not in found]
    return found


def taken(rows, target):
    """How many words the mix takes of each row (id, source, size, hash): whole rounds, then by hash until the budget ends, to the nearer side."""
    found = {}
    for source, want in target.items():
        mine = [r for r in rows if r[1] == source]
        size = sum(r[2] for r in mine)
        times = min(int(want // size), 3) if size else 0
        need, groups = want - times * size, defaultdict(int)
        for _, _, n, h in mine:
            groups[h] += n
        below = upto = 0
        for h in sorted(groups):
            if upto + groups[h] > need:
                below = h + 1 if 2 * (need - upto) >= groups[h] and need > upto else h
                break
            upto += groups[h]
        else:
            below = 1 << 60
        if need <= 0:
            below = 0
        found |= {r[0]: r[2] * (times + (r[3] < below)) for r in mine}
    return found


@pytest.mark.parametrize("sizes", [[("a", 10), ("b", 10), (None, 40)], [("a", 100), ("b", 100), ("c", 1), ("d", 0)], [("", 5), (None, 0), ("é", 7), ("z", 7)], [("a", 0)], [(f"s{i}", i * i % 97) for i in range(40)], []])
def test_targets(spark, sizes):
    given = spark.createDataFrame([(s, n, 1) for s, n in sizes], "source string, source_size long, n long").withColumn("key", mixing.source_key(F.col("source")))
    found = {r.source: r.target for r in mixing.targets(given).collect()}
    want = targets(sizes)
    assert found.keys() == want.keys() and all(found[s] == pytest.approx(want[s], rel=1e-12) for s in want)


@pytest.fixture(scope="module")
def documents(spark):
    draw = random.Random(4)
    rows = [(i, " ".join(["w"] * draw.randrange(1, 60)), draw.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mix_comes_near_its_targets(documents, monkeypatch):
    found = mixing.mix(documents).collect()
    taken_by, size, target = defaultdict(int), defaultdict(int), {}
    for r in found:
        assert 0 <= r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
        taken_by[r.source] += r.taken
        size[r.source] += r.size
        target[r.source] = r.target
    want = targets(list(size.items()))
    assert target.keys() == want.keys() and all(target[s] == pytest.approx(t, rel=1e-12) for s, t in want.items())
    assert all(r.source_size == size[r.source] for r in found)
    hashes = {r.doc_id: r.h for r in documents.select("doc_id", mixing.hashed("doc_id").alias("h")).collect()}
    assert {r.doc_id: r.taken for r in found} == taken([(r.doc_id, r.source, r.size, hashes[r.doc_id]) for r in found], target)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert {r.doc_id: r.taken for r in mixing.mix(documents).collect()} == {r.doc_id: r.taken for r in found}
    monkeypatch.undo()
    for s in target:
        assert abs(taken_by[s] - target[s]) <= 60
    again = {r.doc_id: r.taken for r in mixing.mix(documents.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in found}
    rows = mixing.mixed(documents)
    assert rows.columns == documents.columns and rows.count() == sum(r.taken // r.size for r in found)


def test_mix_of_odd_rows(odd, empty):
    found = mixing.mix(odd).collect()
    assert len(found) == odd.count() and all(r.taken <= 3 * r.size for r in found)
    assert mixing.mix(empty).count() == mixing.mixed(empty).count() == 0
    assert mixing.mixed(odd).columns == odd.columns


def test_columns_of_any_name(documents):
    names = ["key", "n", "whole", "below", "copy", "Key", "__whole", "__hash", "hash", "size", "s", "target"][:5] + ["__whole", "__s", "__hash", "hash", "size", "target"]
    wide = documents.select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    found = mixing.mixed(wide)
    assert found.columns == wide.columns and found.select("doc_id").collect() and found.count() == mixing.mixed(documents).count()
    kept = exactdedup.without_exact_duplicates(wide)
    assert kept.columns == wide.columns and kept.first()["__hash"] == names.index("__hash") and kept.first()["hash"] == names.index("hash")


class Fixed(sharding.Groups):
    def __init__(self, weights):
        self.upto, self.known = np.concatenate(([0], np.cumsum(weights))), {i: (np.array([i]), np.array([sum(weights[: i + 1])])) for i in range(len(weights))}
        self.total = int(self.upto[-1])

    def need(self, blocks):
        pass


def smallest(weights, shards):
    low, high = max(weights), sum(weights)
    while low < high:
        mid, n, held = (low + high) // 2, 1, 0
        for w in weights:
            if held + w > mid:
                n, held = n + 1, 0
            held += w
        low, high = (low, mid) if n <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("seed", range(12))
def test_cuts_are_minimax(seed):
    draw = random.Random(seed)
    weights = [draw.choice([1, 5, 50, 400 if seed % 3 == 0 else 7]) for _ in range(draw.randrange(1, 120))]
    for shards in (1, 3, 16):
        ends = [0, *sharding.cuts(Fixed(weights), max(weights), shards), sum(weights)]
        assert len(ends) == shards + 1 and ends == sorted(ends)
        assert set(ends) <= {0, *np.cumsum(weights).tolist()}
        assert max(b - a for a, b in zip(ends, ends[1:], strict=False)) == smallest(weights, shards)


def check(docs, found):
    by_text, slots, rows = {}, defaultdict(list), {r.doc_id: r.text or "" for r in docs.collect()}
    for r in found:
        text = rows[r.doc_id]
        assert r.size == len(text.encode()) + 1 and r.text_crc32 == zlib.crc32(text.encode())
        assert by_text.setdefault(text, r.shard) == r.shard and 0 <= r.shard < 16
        slots[r.shard].append(r.slot)
    assert len(found) == docs.count() and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards(spark, documents, odd, empty):
    found = sharding.shard(documents).collect()
    check(documents, found)
    assert sharding.shard(empty).count() == 0
    odd_found = sharding.shard(odd).collect()
    check(odd, odd_found)
    draw = random.Random(6)
    unique = spark.createDataFrame([(i, "".join(draw.choice("abc") for _ in range(draw.randrange(400)))) for i in range(4000)], "doc_id long, text string")
    sizes = defaultdict(int)
    for r in sharding.shard(unique).collect():
        sizes[r.shard] += r.size
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) < 1500
