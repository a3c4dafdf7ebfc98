"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are read in segments of SEGMENT bytes. In each, one recurrent layer runs forward and one backward; at every byte the
two states give probabilities of the languages. A document's probabilities are the means over its bytes that can be part
of a letter. The network is trained here, in numpy, by backpropagation through time on a bounded sample of labelled
documents, and is small enough to travel with the function that applies it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm import common
from strandloom.session import ship

#: Bytes of a segment; units of each direction; segments that run side by side.
SEGMENT, UNITS, ABREAST = 64, 12, 2048
#: Labelled documents for each language, how many times as many are drawn before the least hashes are taken, segments of their whole texts for each language, steps, segments in a step, seed.
SAMPLE_DOCS, DRAWN, SAMPLE_SEGMENTS, STEPS, STEP_SEGMENTS, SEED = 300, 8, 6000, 300, 192, 7
RATE = 0.02
#: Up to as many labels are broadcast (a row is under 100 bytes).
LABELS = 10_000

#: Bytes that can be part of a letter.
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """For each direction the input's part by byte (3 * UNITS, 256) and the recurrent part (3 * UNITS, UNITS) of the update gate, the reset gate and the candidate; then the output layer."""

    def __init__(self, languages: list[str], units: int = UNITS, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.languages = languages
        self.weights = {f"{k}{d}": (draw.standard_normal((3 * units, n)) * s).astype(np.float32) for d in "fb" for k, n, s in (("w", 256, 0.3), ("u", units, 0.4))}
        self.weights |= {"v": (draw.standard_normal((len(languages), 2 * units)) * 0.3).astype(np.float32), "c": np.zeros((len(languages), 1), np.float32)}

    def states(self, x: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """States (positions, units, segments) of one direction over bytes x (positions, segments)."""
        w, u = self.weights[f"w{way}"], self.weights[f"u{way}"]
        n = u.shape[1]
        h = np.zeros((n, x.shape[1]), np.float32)
        out = np.empty((len(x), *h.shape), np.float32)
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            g, a = np.take(w, x[t], axis=1, mode="clip"), u @ h
            gates = g[: 2 * n]
            gates += a[: 2 * n]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            z, r = gates[:n], gates[n:]
            m = g[2 * n :]
            m += r * a[2 * n :]
            np.tanh(m, out=m)
            if keep is not None:
                keep.append((t, h, z, r, m, a[2 * n :]))
            h = m + z * (h - m)
            out[t] = h
        return out

    def positions(self, x: np.ndarray, keep: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities (positions, languages, segments) of bytes x (positions, segments), and the states they come from."""
        both = np.concatenate([self.states(x, way, keep and keep[i]) for i, way in enumerate("fb")], axis=1)
        logits = self.weights["v"] @ both + self.weights["c"]
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits, both

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over letter positions of segments with labels y, and its gradients."""
        keep = ([], [])
        p, both = self.positions(x, keep)
        counts = LETTER[x].astype(np.float32)[:, None]
        total = max(counts.sum(), 1)
        right = np.eye(len(self.languages), dtype=np.float32)[:, y][None]
        loss = float(-(np.log((p * right).sum(1, keepdims=True) + 1e-9) * counts).sum() / total)
        d = (p - right) * counts / total
        found = {"v": np.tensordot(d, both, ((0, 2), (0, 2))), "c": d.sum((0, 2))[:, None]}
        back = self.weights["v"].T @ d
        n = UNITS if both.shape[1] == 2 * UNITS else both.shape[1] // 2
        for i, way in enumerate("fb"):
            u = self.weights[f"u{way}"]
            du, carry = np.zeros_like(u), np.zeros((n, x.shape[1]), np.float32)
            inputs = np.empty((3 * n, *x.shape), np.float32)
            for t, h, z, r, m, a in reversed(keep[i]):
                dh = back[t, i * n : (i + 1) * n] + carry
                dm = dh * (1 - z) * (1 - m * m)
                dz, dr = dh * (h - m) * z * (1 - z), dm * a * r * (1 - r)
                step = np.concatenate((dz, dr, dm * r))
                du += step @ h.T
                carry = dh * z + u.T @ step
                inputs[:, t] = np.concatenate((dz, dr, dm))
            found[f"u{way}"] = du
            found[f"w{way}"] = np.stack([np.bincount(x.ravel(), row.ravel(), 256) for row in inputs]).astype(np.float32)
        return loss, found

    def fit(self, segments: np.ndarray, labels: np.ndarray, steps: int = STEPS, size: int = STEP_SEGMENTS, rate: float = RATE, seed: int = SEED) -> float:
        """Adam over random segments (segments, SEGMENT), languages in equal parts; the last loss."""
        draw = np.random.default_rng(seed)
        by = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        by = [b for b in by if len(b)]
        mean, square, loss = {k: np.zeros_like(w) for k, w in self.weights.items()}, {k: np.zeros_like(w) for k, w in self.weights.items()}, 0.0
        for step in range(1, steps + 1):
            some = np.concatenate([draw.choice(b, -(-size // len(by))) for b in by])
            loss, found = self.gradients(np.ascontiguousarray(segments[some].T), labels[some])
            norm = np.sqrt(sum(float((g * g).sum()) for g in found.values()))
            for k, g in found.items():
                g = g * np.float32(min(1.0, 1.0 / (norm + 1e-9)))
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                self.weights[k] -= (rate * min(1, 2 * (1 - step / (steps + 1))) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return loss

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities (texts, languages): means over each text's letter positions; zeros for a text without any."""
        sizes = np.array([-(-len(t) // SEGMENT) for t in texts], np.int64)
        data = np.frombuffer(b"".join(t.ljust(n * SEGMENT, b"\0") for t, n in zip(texts, sizes.tolist(), strict=True)), np.uint8).reshape(-1, SEGMENT)
        doc = np.repeat(np.arange(len(texts)), sizes)
        sums, counts = np.zeros((len(texts), len(self.languages))), np.bincount(doc, LETTER[data].sum(1), len(texts))
        for at in range(0, len(data), ABREAST):
            x = np.ascontiguousarray(data[at : at + ABREAST].T)
            p, _ = self.positions(x)
            p *= LETTER[x][:, None]
            part, whose = p.sum(0), doc[at : at + ABREAST]
            first = int(whose[0])
            for k in range(len(self.languages)):
                found = np.bincount(whose - first, part[k])
                sums[first : first + len(found), k] += found
        return sums / np.maximum(counts, 1)[:, None]


def segmented(text: str) -> np.ndarray:
    """All segments of a text, the last one filled up."""
    data = text.encode()
    return np.frombuffer(data.ljust(max(-(-len(data) // SEGMENT), 1) * SEGMENT, b"\0"), np.uint8).reshape(-1, SEGMENT)


def trained(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> Network | None:
    """A network for the labels that occur; None if no document with a letter has one.

    At most SAMPLE_DOCS documents of each label are read, those of least hash, with their whole texts; of all their segments,
    from whatever place, at most SAMPLE_SEGMENTS of each label, those of least hash, are what is learned from. Both bounds are
    of the sample that the classifier is fitted on. Labels are counted first, and only hashes under a bound that leaves about
    DRAWN times as many documents go on, so that what is ranked does not grow with the input. The driver holds one count
    for each label and the segments. Null texts, texts without a letter and null labels teach nothing; rows that repeat an
    identifier and a text count once for each row. An empty table gives None.
    """
    ship(docs.sparkSession)
    labelled = docs.filter(F.col(lang_col).isNotNull())
    counts = {r.lang: r.n for r in labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    order = F.xxhash64(F.lit("sample"), F.col(id_col))
    limits = docs.sparkSession.createDataFrame([(x, min(2**63 - 1, int(-(2**63) + 2**64 * min(1.0, DRAWN * SAMPLE_DOCS / n)))) for x, n in counts.items()], "lang string, limit_ long")
    part = labelled.select(F.col(lang_col).alias("lang"), order.alias("order"), F.col(text_col).alias("part"), F.xxhash64(F.col(text_col)).alias("same"))
    part = part.join(F.broadcast(limits) if len(counts) <= LABELS else limits, "lang").filter("order <= limit_").filter(F.col("part").rlike(r"\p{L}"))
    least = part.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("order", "same"))).filter(F.col("nth") <= SAMPLE_DOCS)

    def cut(batches):
        for batch in batches:
            for lang, nth, text in zip(batch.column("lang").to_pylist(), batch.column("nth").to_pylist(), batch.column("part").to_pylist(), strict=True):
                some = segmented(text)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array([nth] * len(some), pa.int32()), pa.array(np.arange(len(some))), pa.array([x.tobytes() for x in some])], ["lang", "nth", "at", "segment"])

    some = least.select("lang", "nth", "part").mapInArrow(cut, "lang string, nth int, at long, segment binary").withColumn("order", F.xxhash64(F.lit("segment"), "nth", "at"))
    some = some.withColumn("of", F.row_number().over(Window.partitionBy("lang").orderBy("order", "nth", "at"))).filter(F.col("of") <= SAMPLE_SEGMENTS)
    rows = sorted((r.lang, r.order, r.nth, r["at"], bytes(r.segment)) for r in some.select("lang", "order", "nth", "at", "segment").collect())
    if not rows:
        return None
    network = Network(sorted({r[0] for r in rows}))
    number = {x: k for k, x in enumerate(network.languages)}
    network.fit(np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(-1, SEGMENT), np.array([number[r[0]] for r in rows]))
    return network


def grouped(some: list[int], texts: list[str]):
    """The numbers of texts in groups of about one run of the network."""
    group, size = [], 0
    for k in some:
        group.append(k)
        size += len(texts[k])
        if size > ABREAST * SEGMENT:
            yield group
            group, size = [], 0
    if group:
        yield group


def held_out(id_col: str = "doc_id") -> F.Column:
    """Documents that nothing is learned from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def identify(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, least: float | None = None) -> DataFrame:
    """One row per row of docs: the identifier, the columns in keep, lang_pred and score; with `least`, only rows that are not `und` and have that score.

    A text that is null or has no letter is `und` with score 0, as is every text if there is no network. Otherwise
    lang_pred is the language with the largest mean probability over the whole text, and score that mean; ties go to
    the first language. Repeated rows give repeated results; an empty table gives an empty result. Names of columns in
    keep may be any but lang_pred and score.
    """
    ship(docs.sparkSession)
    kept = list(dict.fromkeys([id_col, *(keep or [])]))
    given = docs.select(*kept, *([] if text_col in kept else [text_col]))
    column = given.columns.index(text_col)

    def run(batches):
        for batch in common.sliced(batches):
            texts = [t or "" for t in batch.column(column).to_pylist()]
            known = [k for k, t in enumerate(texts) if network is not None and any(c.isalpha() for c in t)]
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            for some in grouped(known, texts):
                found = network.documents([texts[i].encode() for i in some])
                for i, best, p in zip(some, found.argmax(1).tolist(), found.max(1).tolist(), strict=True):
                    lang[i], score[i] = network.languages[best], min(1.0, p)
            out = pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(lang, pa.string()), pa.array(score)], [*kept, "lang_pred", "score"])
            if least is not None:
                out = out.filter(pa.array([x != "und" and p >= least for x, p in zip(lang, score.tolist(), strict=True)], pa.bool_()))
            yield out

    schema = ", ".join(f"`{c}` {t}" for c, t in given.dtypes[: len(kept)])
    return given.mapInArrow(run, f"{schema}, lang_pred string, score double")
