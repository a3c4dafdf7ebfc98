import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from strandloom.llm import fingerprints, htmltext, langid

PAGES = [
    ("", ""),
    (None, ""),
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav><article><h1>T</h1><p>One &amp; two</p><p>Three\n  four<br>five</article><footer>(c)</footer></body></html>", "T\nOne & two\nThree four\nfive"),
    ("<body><header>Site</header><div class='ad'>Buy</div><div id=content><p>The text of this page is long enough to be kept.</p><p>Short.</p></div><div class='comments'><p>A reader says a lot of things about this page here.</p></div></body>", "The text of this page is long enough to be kept.\nShort."),
    ("<main><p>a<script>var x='</p>';</script>b</p><form>Name <input> <button>Go</button></form><aside>no</aside><p>c</p><section class=comments><p>d</p></section></main>", "ab\nc"),
    ("<ul><li><a href=1>one link and another</a></li><li><a href=2>more of them here</a></li></ul>", ""),
    ("plain text without any markup at all, and an <b>open tag", "plain text without any markup at all, and an open tag"),
    ("<!-- never closed <p>text", ""),
    ("<article><p>x < y &lt; z &#233;&nbsp;!</p></article>", "x < y < z é !"),
    ("<article>" + "<p>word</p>" * 3000 + "</article>", "\n".join(["word"] * 3000)),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_main_text(page, text):
    assert htmltext.main_text(page) == text


def test_pages(spark):
    pages = spark.createDataFrame([(i, p, "u", 1) for i, (p, _) in enumerate(PAGES)] + [(0, "", "u", 1)], "page_id long, html string, url string, text int")
    found = htmltext.extract(pages, keep=["url"]).collect()
    assert sorted((r.page_id, r.url, r.text, r.n_chars) for r in found) == sorted([(i, "u", t, len(t)) for i, (_, t) in enumerate(PAGES)] + [(0, "u", "", 0)])
    assert htmltext.extract(pages.limit(0)).count() == 0


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def test_likeness_estimates_the_share_of_shingles():
    draw = random.Random(1)
    a, b = [], []
    for _ in range(300):
        words = [f"w{draw.randrange(500)}" for _ in range(draw.randrange(30, 400))]
        cut = draw.randrange(len(words))
        a.append(" ".join(words))
        b.append(" ".join(words[:cut] + [f"v{draw.randrange(500)}" for _ in range(len(words) - cut)]))
    found = fingerprints.likeness(*(fingerprints.fingerprints([t.encode() for t in x]) for x in (a, b)))
    want = np.array([len(shingles(x) & shingles(y)) / len(shingles(x) | shingles(y)) for x, y in zip(a, b, strict=True)])
    assert np.abs(found - want).mean() < 0.03 and abs((found - want).mean()) < 0.01


def test_fingerprints_of_odd_texts(monkeypatch):
    texts = [b"", b" \n ", b"one", b"one two three four", b"one  two\nthree four five", b"one two three four five", b"x" * 5000, b"a b c d e f " * 4000]
    found = fingerprints.fingerprints(texts)
    assert (found[0] == found[1]).all() and (found[4] == found[5]).all() and len({bytes(f) for f in found}) == 6
    monkeypatch.setattr(fingerprints, "SLAB", 64)
    monkeypatch.setattr("strandloom.llm.simhash.SLAB", 64)
    assert (fingerprints.fingerprints(texts) == found).all()
    assert fingerprints.fingerprints([]).shape == (0, fingerprints.BINS)


def test_documents_against_the_next(spark, odd, empty):
    draw = random.Random(2)
    rows = [(i * 3 % 101, " ".join(f"w{draw.randrange(50)}" for _ in range(draw.randrange(0, 60)))) for i in range(101)]
    found = {r.doc_id: r for r in fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    ordered = sorted(rows)
    assert len(found) == 101
    for (i, text), (j, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        prints = fingerprints.fingerprints([text.encode(), edited.encode(), after.encode()])
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert [r.fingerprint, r.edited_fingerprint, found[j].fingerprint] == fingerprints.packed(prints)
        assert r.near_edited == fingerprints.likeness(prints[:1], prints[1:2])[0] and r.near_next == fingerprints.likeness(prints[:1], prints[2:])[0]
    assert fingerprints.fingerprint_documents(odd).count() == odd.count()
    assert fingerprints.fingerprint_documents(empty).count() == 0
    one = fingerprints.fingerprint_documents(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")).first()
    assert one.near_next == 1.0


WORDS = {"en": "the of and to in is that it was for on are with as his they at be this".split(), "de": "der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch".split(), "fr": "le de un être et à il avoir ne je son que se qui ce dans en du elle".split()}


def labelled(n, seed):
    draw = random.Random(seed)
    return [(i, " ".join(draw.choice(WORDS[x]) for _ in range(draw.randrange(15, 80))), x) for i in range(n) for x in [draw.choice(list(WORDS))]]


def test_gradients():
    net = langid.Network(["a", "b", "c"], units=3)
    draw = np.random.default_rng(0)
    net.weights = {k: w.astype(np.float64) for k, w in net.weights.items()}
    x, y = draw.integers(65, 90, (6, 5)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    _, found = net.gradients(x, y)
    for k, w in net.weights.items():
        at = (0, int(x[2, 1])) if k[0] == "w" else (0, 0)
        old, e = w[at], 1e-4
        w[at] = old + e
        up, _ = net.gradients(x, y)
        w[at] = old - e
        down, _ = net.gradients(x, y)
        w[at] = old
        assert found[k][at] == pytest.approx((up - down) / (2 * e), rel=2e-2, abs=1e-6)


def test_a_text_is_read_whole_and_position_by_position():
    """The network against a plain loop over bytes."""
    net = langid.Network(["a", "b", "c"], units=3, seed=5)
    text = ("Zwölf Boxkämpfer jagen Viktor " * 5).encode()[:150]
    sig = lambda x: 1 / (1 + np.exp(-x))
    sums, letters = np.zeros(3), 0
    for at in range(0, len(text), langid.SEGMENT):
        data = text[at : at + langid.SEGMENT].ljust(langid.SEGMENT, b"\0")
        states = {}
        for way in "fb":
            w, u, h = net.weights[f"w{way}"], net.weights[f"u{way}"], np.zeros(3)
            for t in range(len(data)) if way == "f" else reversed(range(len(data))):
                x, a = w[:, data[t]], u @ h
                z, r = sig(x[:3] + a[:3]), sig(x[3:6] + a[3:6])
                h = z * h + (1 - z) * np.tanh(x[6:] + r * a[6:])
                states[way, t] = h
        for t, c in enumerate(data):
            if langid.LETTER[c]:
                e = np.exp(net.weights["v"] @ np.concatenate((states["f", t], states["b", t])) + net.weights["c"][:, 0])
                sums, letters = sums + e / e.sum(), letters + 1
    assert np.allclose(net.documents([text])[0], sums / letters, atol=1e-5)
    assert b"".join(x.tobytes() for x in langid.segmented(text.decode())).rstrip(b"\0") == text


def test_windows_decide():
    """spans against a plain version, and that a page's text depends on them."""
    draw = random.Random(3)
    for _ in range(300):
        chars = [draw.choice([3, 20, 100, 700]) for _ in range(draw.randrange(12))]
        weights = [n * draw.choice([0, 0.2, 0.6, 1]) for n in chars]
        bar = draw.choice([1, 25, 400])
        sums = [sum(weights[i : i + 3]) for i in range(len(chars))]
        live = [s >= 0.5 * sum(chars[i : i + 3]) for i, s in enumerate(sums)]
        want, i = [False] * len(chars), 0
        while i < len(chars):
            k = i
            while k < len(chars) and live[k]:
                k += 1
            dense = [j for j in range(i, k) if weights[j] >= 0.5 * chars[j]]
            if dense and max(sums[i:k]) >= bar:
                for j in range(dense[0], dense[-1] + 1):
                    want[j] = True
            i = max(k, i + 1)
        inside, highest = htmltext.spans(np.array(chars, float), np.array(weights, float), bar)
        assert inside.tolist() == want and highest == max([s for s, x in zip(sums, live, strict=True) if x], default=0.0)
    plain = "<div>Buy this now, it is cheap today.</div><article><p>" + "word " * 100 + "</p></article><div>" + "x" * 40 + "</div>"
    assert htmltext.main_text(plain) == ("word " * 100).strip()
    assert htmltext.main_text("<p>" + "word " * 30 + "</p><ul>" + "<li><a href=1>one more link</a></li>" * 6 + "</ul>") == ("word " * 30).strip()


@pytest.mark.parametrize(
    "page",
    ["<div>" * 20_000 + "x", "<span>" * 20_000 + "</b>" * 20_000, "<b><td>" + "<span>" * 20_000 + "</b>" * 20_000, "<a " * 20_000 + "'", "<p><span>" * 20_000, '<a href="' * 20_000, "<script>" * 20_000, "<!--" * 20_000, "<a" + " =" * 20_000 + "'"],
)
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    htmltext.main_text(page)
    assert time.process_time() - began < 1


def test_nothing_else_is_dropped():
    page = "<article><p>Let <math><mi>x</mi></math> be</p><figure><figcaption>A figure</figcaption></figure><ul><li><a href=1>a link of the text</a></li></ul><h2 id=comments>Comments on x</h2><p id=notice>said</p><noscript>n</noscript><label>l</label></article>"
    assert htmltext.main_text(page) == "Let x be\nA figure\na link of the text\nComments on x\nsaid\nnl"


def test_names_of_results_are_refused(spark):
    with pytest.raises(ValueError, match="n_chars"):
        htmltext.extract(spark.createDataFrame([(1, "a", 2)], "page_id long, html string, n_chars int"), keep=["n_chars"])


def test_held_out_accuracy(spark, odd, empty):
    docs = spark.createDataFrame(labelled(400, 1), "doc_id long, text string, lang string")
    network = langid.trained(docs.filter(~langid.held_out()))
    rows = {r.doc_id: r for r in docs.collect()}
    found = langid.identify(docs, network).withColumn("held", langid.held_out()).collect()
    held = [r for r in found if r.held]
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found) and held
    assert sum(r.lang_pred == rows[r.doc_id].lang for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in found)
    got = langid.identify(odd, network, keep=["lang"]).collect()
    assert len(got) == odd.count() and all((r.lang_pred == "und") == (r.doc_id in (3, 4, 5, 8)) for r in got)
    kept = langid.identify(odd, network, keep=odd.columns, least=0.0)
    assert kept.count() == odd.count() - 4 and kept.columns == [*odd.columns, "lang_pred", "score"]
    assert langid.identify(empty, network).count() == 0
    assert langid.trained(empty) is None and {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}
