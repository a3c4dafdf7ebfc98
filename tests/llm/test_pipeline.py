"""The pipeline against a plain version of each of its stages."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline as P
from strandloom.llm import common, langid
from tests.llm.test_layout import targets
from tests.llm.test_nearcopies import kept as least_of_near_copies
from tests.llm.test_texts import labelled
from tests.llm.test_tokens import wanted


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, t, x, f"s{i % 4}", len(t)) for i, t, x in labelled(240, 9)]
    rows += [(1000 + i, *rows[i][1:]) for i in range(30)] + [(2000, "!!! 123", None, "s0", 7), (2001, None, "en", "s1", None), (2002, rows[3][1] + ".", "en", "s2", 1)]
    return common.stored(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "documents")


def test_stages(spark, documents):
    names = [n for n, _ in P.STAGES]
    assert names == ["language", "exact", "near", "mix", "encode"]
    docs, kept = documents, {}
    for name, stage in P.STAGES:
        docs = common.stored(stage(spark, docs, ""), name)
        kept[name] = docs.collect()
        if name != "encode":
            assert docs.columns == documents.columns
    ids = lambda name: sorted(r.doc_id for r in kept[name])
    network = langid.trained(documents.filter(~langid.held_out()))
    want = [r.doc_id for r in langid.identify(documents, network).collect() if r.lang_pred != "und" and r.score >= P.least_score(network)]
    assert ids("language") == sorted(want) and not {2000, 2001} & set(want)
    best = {}
    for r in kept["language"]:
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert ids("exact") == sorted(best.values())
    assert ids("near") == least_of_near_copies([(r.doc_id, r.text) for r in kept["exact"]])
    size, taken = defaultdict(int), defaultdict(int)
    for r in kept["near"]:
        size[r.source] += len(r.text.split())
    for r in kept["mix"]:
        taken[r.source] += len(r.text.split())
    target = targets(list(size.items()))
    assert all(abs(taken[s] - t) <= 80 for s, t in target.items()) and set(ids("mix")) <= set(ids("near")) and max(Counter(ids("mix")).values()) <= 3
    code = wanted(None)
    assert sorted(map(tuple, kept["encode"])) == sorted((r.doc_id, *code(r.text)) for r in kept["mix"])
    assert P.ORACLE_SQL is None


def test_an_empty_table(spark, documents):
    docs = documents.limit(0)
    for name, stage in P.STAGES:
        docs = common.stored(stage(spark, docs, ""), name)
    assert docs.count() == 0
