import hashlib
import random
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from strandloom.llm import exactdedup, simhash
from strandloom.llm.components import connected_components


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_duplicates(odd, keep):
    rows = [(r.doc_id, r.text or "") for r in odd.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    pick = min if keep == "smallest" else max
    found = exactdedup.exact_duplicates(odd, keep=keep).collect()
    want = sorted((repr(i), pick(ids) if (ids := [x for x in groups[t] if x is not None]) else None, len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    assert sorted((repr(r.doc_id), r.keep_id, r.group_size, r.text_sha256) for r in found) == want
    assert sum(r.kept for r in found) == len(groups)
    assert exactdedup.without_exact_duplicates(odd, keep=keep).count() == len(groups)
    assert exactdedup.without_exact_duplicates(odd, keep=keep).columns == odd.columns


def test_empty_tables(empty):
    assert exactdedup.exact_duplicates(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0


def plain(text):
    words = []
    for w in text.replace("\t", " ").replace("\n", " ").split(" "):
        if w:
            words.append("".join(c.lower() if "A" <= c <= "Z" else c for c in w))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints_and_components(spark, odd):
    some = odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    prints = {r.doc_id: plain(r.text or "") for r in some.collect()}
    found = {r.doc_id: r for r in simhash.near_duplicates(some).collect()}
    assert {i: r.fp % 2**64 for i, r in found.items()} == prints
    assert {i: r.component_id for i, r in found.items()} == components(prints)


def test_slabs_change_nothing(monkeypatch):
    text = " ".join(random.Random(1).choice(["ab", "cd", "Efg", "h"]) for _ in range(2000))
    want = simhash.simhash(text)
    monkeypatch.setattr(simhash, "SLAB", 50)
    assert simhash.simhash(text) == want == (lambda x: x - 2**64 if x >> 63 else x)(plain(text))


@pytest.mark.parametrize("pairs", [128, 2])
def test_links_lose_no_pair(spark, monkeypatch, pairs):
    monkeypatch.setattr(simhash, "BUCKET_PAIRS", pairs)
    draw = random.Random(2)
    prints = []
    for _ in range(12):
        base = draw.getrandbits(64)
        for _ in range(12):
            x = base
            for b in draw.sample(range(64), draw.randrange(5)):
                x ^= 1 << b
            prints.append(x)
    prints = sorted(set(prints))
    df = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in prints], "fp long")
    found = {r.node % 2**64: r.root % 2**64 for r in connected_components(simhash.links(df)).collect()}
    want = components(dict(enumerate(prints)))
    groups = lambda label: sorted(sorted(g) for g in label.values())
    a, b = defaultdict(list), defaultdict(list)
    for i, x in enumerate(prints):
        a[want[i]].append(x)
        b[found.get(x, x)].append(x)
    assert groups(a) == groups(b)


@pytest.mark.parametrize("last", [0, 40, 200_000])
def test_components_of_a_long_path(spark, monkeypatch, last):
    monkeypatch.setattr("strandloom.llm.components.LAST", last)
    edges = spark.range(60).select((F.col("id") * 7 % 61).alias("a"), ((F.col("id") + 1) * 7 % 61).alias("b"))
    found = connected_components(edges.union(spark.createDataFrame([(1000, 1001), (5000, 5000)], "a long, b long")))
    assert len({r.root for r in found.collect()}) == 3 and found.count() == 64


def test_one_row_of_each_near_group_stays(odd):
    found = simhash.without_near_duplicates(odd)
    assert found.columns == odd.columns
    assert found.count() == simhash.near_duplicates(odd).select("component_id", "keep_same").distinct().count()
