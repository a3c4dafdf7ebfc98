"""Near copies against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandloom.llm import common, nearcopies


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def kept(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(least.values())


def corpus():
    draw = random.Random(5)
    line = "all of these rights are reserved to the owners of this very text".split()
    rows = []
    for base in range(40):
        words = [f"w{draw.randrange(3000)}" for _ in range(draw.randrange(4, 200))]
        for _ in range(draw.randrange(1, 7) if base else 90):
            copy = list(words)
            for _ in range(draw.randrange(1 + len(words) // 20)):
                copy[draw.randrange(len(copy))] = f"v{draw.randrange(3000)}"
            rows.append((len(rows), " ".join(copy + draw.randrange(3) * line)))
    rows += [(len(rows) + i, " ".join(line + [f"x{i}"])) for i in range(5)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(("pairs", "sample"), [(64, 20_000), (2, 20_000), (2, 20)])
def test_every_near_copy_goes(spark, monkeypatch, pairs, sample):
    monkeypatch.setattr(nearcopies, "BUCKET_PAIRS", pairs)
    monkeypatch.setattr(nearcopies, "SAMPLE", sample)
    if pairs == 2:
        monkeypatch.setattr(nearcopies, "PIVOTS", 2)
        monkeypatch.setattr(nearcopies, "CROSSING", 1)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect())
    assert found == kept(rows) and len(found) < len(rows) - 50


def test_odd_rows(odd, empty):
    found = nearcopies.without_near_copies(odd)
    assert found.columns == odd.columns
    assert sorted(r.doc_id for r in found.collect() if r.doc_id is not None) == [1, 3, 6, 7, 8, 9]
    assert nearcopies.without_near_copies(empty).count() == 0


def test_a_fingerprint_has_the_bits_of_over_half_of_the_hashes():
    for text in ("", "one two", "a b c d e f", " ".join(f"w{i % 700}" for i in range(1000))):
        hashes = nearcopies.shingles(text)
        mixed = [[int(nearcopies.mixed(h + np.uint64(k * nearcopies.BASE % (1 << 64)))) for h in hashes] for k in range(1, nearcopies.BITS // 64 + 1)]
        want = "".join("1" if 2 * sum(x >> (63 - i) & 1 for x in of) > len(hashes) else "0" for of in mixed for i in range(64))
        assert bin(int.from_bytes(b"\1" + nearcopies.folded(hashes), "big"))[3:] == want


def test_fingerprints_find_near_copies_without_the_rest(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "rest", lambda docs, found: found.limit(0))
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = corpus_pipeline.near(spark, docs, "").count()
    assert len(kept(rows)) <= found <= len(kept(rows)) + 0.05 * (len(rows) - len(kept(rows)))
    texts = docs.select(F.xxhash64("text").alias("same"), "text")
    text = {r.same: r.text for r in texts.collect()}
    for a, b in nearcopies.simhashed(texts).collect():
        x, y = shingles(text[a]), shingles(text[b])
        assert a != b and 5 * len(x & y) >= 4 * len(x | y)


def test_what_fingerprints_miss_is_found(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "DISTANCE", 0)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()) == kept(rows)


def test_executors_collect_their_garbage(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    before = sum(x.getCollectionCount() for x in beans())
    common.swept(spark)
    assert sum(x.getCollectionCount() for x in beans()) > before


def families(count, draw):
    """Groups of 12 texts that share their first words, but too few to be near copies."""
    rows = []
    for _ in range(count):
        words = [f"w{draw.randrange(10**9)}" for _ in range(60)]
        rows += [(words + [f"v{draw.randrange(10**9)}" for _ in range(40)]) for _ in range(12)]
    draw.shuffle(rows)
    return [(i, " ".join(words)) for i, words in enumerate(rows)]


def test_frequent_shingles_are_counted_over_all_texts(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "SAMPLE", 20)
    rows = families(10, random.Random(3)) + [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select(F.xxhash64("doc_id").alias("same"), F.coalesce("text", F.lit("")).alias("text"))
    known, counts, left = nearcopies.frequent(docs)
    of = Counter(int(h) >> left for _, text in rows for h in nearcopies.shingles(text))
    assert dict(zip(known.tolist(), counts.tolist(), strict=True)) == {key: n for key, n in of.items() if n > nearcopies.BUCKET_PAIRS} and len(known) > 500
    monkeypatch.setattr(nearcopies, "FREQUENT", 100)
    assert len(nearcopies.frequent(docs)[0]) <= 100
    assert len(nearcopies.frequent(docs.limit(0))[0]) == 0


def test_what_texts_share_gives_no_pairs_if_it_is_not_enough(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "SAMPLE", 20)
    seen, verified = [], nearcopies.verified

    def counted(pairs, docs):
        seen.append(pairs.count())
        return verified(pairs, docs)

    monkeypatch.setattr(nearcopies, "verified", counted)
    rows = families(30, random.Random(4))
    rows.append((len(rows), rows[0][1] + " end"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert corpus_pipeline.near(spark, docs, "").count() == len(rows) - 1
    assert sum(seen) <= len(rows)
