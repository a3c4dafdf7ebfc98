import base64
import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from strandloom.llm import bytebpe, tokencount

MODEL, RANKS = public_tokenizers.path(tokencount.MODEL), public_tokenizers.path(bytebpe.RANKS)
ODD = ["", " ", "\n", "a  b", " a ", "a\n b", "it's we'll ''s", "\x1c a \x1d\x85", "a  b　 c", "́ é", "Σας ΟΔΟΣ", "日本語 123", "<|endoftext|> x<|startoftext|>y", "ab" * 3000, "aaaa" * 5000 + "b", "a " * 40_000]


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(3)
    return ODD + ["".join(draw.choice("abcdefgh \n\t'1é") for _ in range(n)) for n in (100, 1000, 5000)] + ["".join(draw.choice("etaoin") for _ in range(3000))]


def test_counts_equal_the_library(spark, odd, texts):
    library = Tokenizer.from_file(MODEL)
    want = lambda t: len(library.encode(t or "", add_special_tokens=False))
    count = tokencount.counter(MODEL)
    assert count.counts(texts) == [want(t) for t in texts]
    found = tokencount.token_counts(odd).collect()
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in found) == sorted((repr(r.doc_id), len((r.text or "").encode()), want(r.text), want(r.text) > 2048) for r in odd.collect())


@pytest.mark.parametrize(("size", "overlap"), [(400, 4), (50, 1), (2000, 64)])
def test_spliced_counts_equal_the_library(texts, size, overlap):
    library, count = Tokenizer.from_file(MODEL), tokencount.counter(MODEL)
    for t in [*texts, "\n".join(texts), "x" * 3000 + " " + "y" * 500 + " z" * 900]:
        assert count.spliced(t.replace("\n", " "), size, overlap) == len(library.encode(t, add_special_tokens=False))


def test_chunks_are_spliced_and_long_words_are_encoded_once(monkeypatch):
    count, places, encoded = tokencount.Counter(MODEL), [], []
    common, tokens = count.common, count.tokens
    monkeypatch.setattr(count, "common", lambda *a: places.append(common(*a)) or places[-1])
    monkeypatch.setattr(count, "tokens", lambda p: encoded.append(p) or tokens(p))
    text = " ".join(random.Random(8).choice(["of", "token", "counts", "resynchronise", "x1"]) for _ in range(2000))
    assert count.counts([text])[0] == len(count.library.encode(text, add_special_tokens=False))
    assert len(places) >= len(text) // 1100 and None not in places
    encoded.clear()
    long = "q" * 50_000
    assert count.counts([f"a {long} b"])[0] == len(count.library.encode(f"a {long} b", add_special_tokens=False))
    assert [len(p) for p in encoded if len(p) > 1000] == [50_000]


def wanted(text):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    ids = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda t: (len(ids(t)), hashlib.sha256(struct.pack(f"<{len(ids(t))}I", *ids(t))).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


@pytest.mark.parametrize("slab", [1 << 20, 700])
def test_ids_equal_the_library_and_decode_to_the_text(texts, monkeypatch, slab):
    monkeypatch.setattr(bytebpe, "SLAB", slab)
    want = wanted(None)
    assert bytebpe.coded(texts, RANKS) == [want(t) for t in texts]


def test_long_words():
    draw = random.Random(5)
    letters = lambda n, some: "".join(draw.choice(some) for _ in range(n))
    words = [letters(100_000, "abcdefghijklmnopqrstuvwxyz"), letters(20_000, "ab"), "abc" * 4000, "=" * 5000 + "-" * 3001, letters(500, "xyz") + "ha" * 2000 + letters(500, "xyz"), "é" * 1001, letters(201, "日本語学校")]
    want = wanted(None)
    assert bytebpe.coded(words, RANKS) == [want(w) for w in words]
    assert not any(len(w) > bytebpe.LONG for w in bytebpe.coder(RANKS).ids)


def test_a_full_memory_is_emptied(texts, monkeypatch):
    want = wanted(None)
    monkeypatch.setattr(bytebpe, "KNOWN_BYTES", 10)
    monkeypatch.setattr(tokencount, "KNOWN_BYTES", 10)
    assert [bytebpe.coded([t], RANKS)[0] for t in texts[:12]] == [want(t) for t in texts[:12]]
    assert [tokencount.counter(MODEL).counts([t])[0] for t in texts[:12]] == [len(Tokenizer.from_file(MODEL).encode(t, add_special_tokens=False)) for t in texts[:12]]


def test_tables(spark, odd, empty):
    want = wanted(None)
    found = bytebpe.encode(odd).collect()
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == sorted((repr(r.doc_id), *want(r.text or "")) for r in odd.collect())
    assert bytebpe.encode(empty).count() == tokencount.token_counts(empty).count() == 0
