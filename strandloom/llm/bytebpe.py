"""Byte-level BPE encoding and decoding by recursive DuckDB queries in each partition.

The pattern splits a text into words; long texts are first cut before a space between two characters that are not white
space, where a word starts whatever stands before. Words that a worker does not know yet go to DuckDB in batches: a row
for each word and token position joins the merge table with its right neighbour, and a recursive query contracts the
leftmost pair of least rank of every word until nothing joins. Words of over LONG bytes are contracted in overlapping
stretches. A row of tokens is the encoding of its bytes exactly if every two neighbours are the encoding of theirs, so
stretches that have a token in common are spliced at it without any loss: all neighbours stand in one or the other.
Stretches without one become one stretch. In a stretch that is still longer than LONG, as a long period can make it, all
disjoint occurrences of the pair are contracted in one step if no pair with the new token has a lower rank, which gives
the same result in fewer steps. A second query aggregates the tokens' bytes by position to decode. Words of up to LONG
bytes are remembered in two tables of bounded bytes: when the newer is full, it becomes the older, of which only what is met again is kept.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from itertools import accumulate

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import common
from strandloom.session import ship

RANKS = "byte_bpe_50k.tiktoken"
#: Bytes that a worker's remembered words may take, about (each takes ROW beside its characters and tokens); bytes of words and number of words that go to DuckDB at once; steps of one recursive query.
KNOWN_BYTES, ROW, BATCH, DECODED, STEPS = 50_000_000, 250, 400_000, 100_000, 48
#: Characters of a piece of a text, and of texts that are encoded at once; bytes of a slice of a batch.
SLAB, BATCH_CHARS, SLICE = 1 << 20, 1_000_000, 4_000_000

CHUNK = re.compile(r"(?<=\S) (?=\S)")

#: Words of up to LONG bytes: the leftmost pair of least rank of every word in each step. A word's tokens are a list between steps, its positions rows within one.
SHORT = """
WITH RECURSIVE step(word, toks, k) AS (
  SELECT word, list(tok ORDER BY pos), 0 FROM start GROUP BY word
  UNION ALL
  SELECT s.word, list_concat(list_concat(s.toks[:b.pos - 1], [b.rank]), s.toks[b.pos + 2:]), s.k + 1
  FROM step s JOIN (
    SELECT word, min(rank) AS rank, arg_min(pos, (rank::BIGINT << 32) + pos) AS pos
    FROM (SELECT word, unnest(toks[:-2]) AS l, unnest(toks[2:]) AS r, unnest(range(1, len(toks))) AS pos FROM step WHERE len(toks) > 1) p
    JOIN merges m ON m.lhs = p.l AND m.rhs = p.r
    GROUP BY word
  ) b USING (word)
)
SELECT word, arg_max(toks, k) AS toks FROM step GROUP BY word ORDER BY word
"""
LONG = 200
#: A stretch of a longer word starts every STRIDE bytes and has twice as many.
STRIDE = 32

#: Longer stretches, up to a number of steps: where it is safe, all disjoint occurrences of the pair of least rank.
CONTRACT = """
WITH RECURSIVE step(word, pos, tok, rank, safe, k) AS (
  SELECT s.word, s.pos, s.tok, m.rank, m.safe, 0
  FROM (SELECT word, pos, tok, lead(tok) OVER w AS after FROM start WINDOW w AS (PARTITION BY word ORDER BY pos)) s
  LEFT JOIN merges m ON m.lhs = s.tok AND m.rhs = s.after
  UNION ALL
  SELECT t.word, t.pos, t.tok, m.rank, m.safe, t.k
  FROM (
    SELECT word, pos, tok, k, lead(tok) OVER w AS after
    FROM (
      SELECT word, pos, CASE WHEN hit THEN rank ELSE tok END AS tok, k, lag(hit, 1, false) OVER w AS gone
      FROM (
        SELECT word, pos, tok, rank, k + 1 AS k, twin AND (pos = leftmost OR safe AND (place - run) % 2 = 0) AS hit
        FROM (
          SELECT *, max(CASE WHEN NOT follows THEN place END) OVER w AS run
          FROM (
            SELECT *, min(CASE WHEN rank = best THEN pos END) OVER (PARTITION BY word) AS leftmost, row_number() OVER w AS place,
                   coalesce(rank = best, false) AS twin, coalesce(lag(rank) OVER w = best, false) AS follows
            FROM (SELECT *, min(rank) OVER (PARTITION BY word) AS best FROM step WHERE k < $steps)
            WHERE best IS NOT NULL
            WINDOW w AS (PARTITION BY word ORDER BY pos)
          )
          WINDOW w AS (PARTITION BY word ORDER BY pos)
        )
      )
      WINDOW w AS (PARTITION BY word ORDER BY pos)
    )
    WHERE NOT gone
    WINDOW w AS (PARTITION BY word ORDER BY pos)
  ) t LEFT JOIN merges m ON m.lhs = t.tok AND m.rhs = t.after
)
SELECT word, list(tok ORDER BY pos) AS toks, bool_or(rank IS NOT NULL) AS more
FROM (SELECT *, max(k) OVER (PARTITION BY word) AS last FROM step) WHERE k = last GROUP BY word ORDER BY word
"""

DECODE = """
SELECT word, unhex(string_agg(v.hex, '' ORDER BY pos)) AS bytes FROM start s JOIN vocab v ON v.tok = s.tok GROUP BY word ORDER BY word
"""


def _rows(lists: list[bytes]) -> pa.Table:
    """The rows (word, pos, tok) of words' tokens, which come as little-endian 32-bit integers."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
    ends = np.cumsum(sizes)
    return pa.table(
        {
            "word": np.repeat(np.arange(len(lists), dtype=np.int32), sizes),
            "pos": (np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)).astype(np.int32),
            "tok": np.frombuffer(b"".join(lists), "<u4").astype(np.int32),
        }
    )


def _lists(column: pa.ChunkedArray) -> list[bytes]:
    lists = column.combine_chunks()
    ids, ends = lists.values.to_numpy().astype("<u4").tobytes(), (4 * lists.offsets.to_numpy()).tolist()
    return [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]


class Coder:
    """Encodes and decodes by the ranks of one file, as the file's library does; special tokens are ordinary text."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks, self.byte, self.ids, self.bytes = ranks, np.array([ranks[bytes([i])] for i in range(256)], "<u4"), {}, {}
        self.width = {r: len(t) for t, r in ranks.items()}
        pairs = np.array([(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks], np.int32).reshape(-1, 3)
        least = np.full(max(ranks.values()) + 1, np.iinfo(np.int32).max, np.int32)  # of the pairs that a token is in
        for side in (0, 1):
            np.minimum.at(least, pairs[:, side], pairs[:, 2])
        merges = pa.table({"lhs": pairs[:, 0], "rhs": pairs[:, 1], "rank": pairs[:, 2], "safe": least[pairs[:, 2]] > pairs[:, 2]})
        vocab = pa.table({"tok": np.array(list(ranks.values()), np.int32), "hex": [t.hex() for t in ranks]})
        spill = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]  # where Spark spills too
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": f"{spill}/duckdb-{os.getpid()}" if spill else ""})
        self.size, self.old = 0, ({}, {})
        for name, rows in (("merges", merges), ("vocab", vocab)):
            self.db.register("given", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.pattern = regex.compile(public_tokenizers.PATTERN)

    def ask(self, sql: str, lists: list[bytes], **values) -> pa.Table:
        self.db.register("start", _rows(lists))
        try:
            return self.db.sql(sql, params=values or None).to_arrow_table()
        finally:
            self.db.unregister("start")

    def contracted(self, words: list[bytes]) -> list[bytes]:
        """Each word's token ids as little-endian 32-bit integers."""
        flat, ends = self.byte[np.frombuffer(b"".join(words), np.uint8)].tobytes(), np.cumsum([0, *map(len, words)]) * 4
        lists = [flat[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        while long:
            steps = max(1, min(STEPS, 16 * BATCH // sum(len(lists[i]) for i in long)))
            found = self.ask(CONTRACT, [lists[i] for i in long], steps=steps)
            for i, toks in zip(long, _lists(found["toks"]), strict=True):
                lists[i] = toks
            long = [i for i, more in zip(long, found["more"].to_pylist(), strict=True) if more]
        if short := [i for i, w in enumerate(words) if len(w) <= LONG]:
            for i, toks in zip(short, _lists(self.ask(SHORT, [lists[i] for i in short])["toks"]), strict=True):
                lists[i] = toks
        return lists

    def stretched(self, word: bytes) -> bytes:
        """The token ids of a long word, from overlapping stretches that are spliced at common tokens."""
        stretches = [(a, min(a + 2 * STRIDE, len(word))) for a in range(0, max(len(word) - STRIDE, 1), STRIDE)]
        known: dict[tuple[int, int], list[tuple[int, int]]] = {}
        while True:
            fresh = list({word[a:b] for a, b in stretches if (a, b) not in known})
            ids = {}
            for some in self.batches(fresh):
                ids.update(zip(some, self.contracted(some), strict=True))
            for a, b in stretches:
                if (a, b) not in known:
                    tokens = np.frombuffer(ids[word[a:b]], "<u4").tolist()
                    known[a, b] = list(zip(accumulate((self.width[t] for t in tokens[:-1]), initial=a), tokens, strict=True))
            whole, cuts = [stretches[0]], []
            for before, now in zip(stretches, stretches[1:], strict=False):
                places = {t: k for k, t in enumerate(known[now])}
                cut = next(((k, places[t]) for k, t in enumerate(known[before]) if t in places), None)
                if cut is None:  # no token in common: one stretch
                    whole[-1] = (whole[-1][0], now[1])
                else:
                    whole.append(now)
                    cuts.append(cut)
            if len(whole) == len(stretches):
                starts, ends = [0, *(r for _, r in cuts)], [*(k for k, _ in cuts), None]
                return np.array([t for s, a, b in zip(stretches, starts, ends, strict=True) for _, t in known[s][a:b]], "<u4").tobytes()
            stretches = whole

    def batches(self, words: list[bytes]):
        some, size = [], 0
        for w in words:
            some.append(w)
            size += len(w)
            if size >= BATCH:
                yield some
                some, size = [], 0
        if some:
            yield some

    def learn(self, words: list[str]) -> None:
        """Remember the ids and the decoded bytes of words."""
        raw = [w.encode() for w in words]
        ids = dict((w, self.ranks[w].to_bytes(4, "little")) for w in raw if w in self.ranks)
        for some in self.batches([w for w in raw if w not in ids and len(w) <= LONG]):
            ids.update(zip(some, self.contracted(some), strict=True))
        ids.update((w, self.stretched(w)) for w in raw if w not in ids)
        ids = [ids[w] for w in raw]
        self.ids.update(zip(words, ids, strict=True))
        self.size += sum(ROW + 2 * len(w) + len(i) for w, i in zip(raw, ids, strict=True))
        for at in range(0, len(ids), DECODED):
            decoded = self.ask(DECODE, ids[at : at + DECODED])["bytes"].combine_chunks()
            self.bytes.update(zip(words[at : at + DECODED], decoded.to_pylist(), strict=True))

    def coded(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids and decoded bytes of each text."""
        if self.size > KNOWN_BYTES // 2:  # what isn't met again before the next time is forgotten then
            self.old, self.ids, self.bytes, self.size = (self.ids, self.bytes), {}, {}, 0
        split = [self.pattern.findall(t) for t in texts]
        fresh = {w for w in set().union(*split) if w not in self.ids}
        ids, bytes_ = self.old
        for w in [w for w in fresh if w in ids]:
            self.ids[w], self.bytes[w] = ids[w], bytes_[w]
            self.size += ROW + 2 * len(w) + len(ids[w])
            fresh.remove(w)
        if fresh:
            self.learn(list(fresh))
        found = [(b"".join(map(self.ids.__getitem__, ws)), b"".join(map(self.bytes.__getitem__, ws))) for ws in split]
        for w in fresh:
            if len(w) > LONG:
                self.size -= ROW + 2 * len(self.bytes.pop(w)) + len(self.ids.pop(w))
        return found


def _slabs(text: str):
    """The text in pieces of about SLAB characters that end before chunks."""
    at = 0
    while len(text) - at > SLAB and (m := CHUNK.search(text, at + SLAB)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """The worker's coder for a file."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def coded(texts: list[str], path: str):
    """For each text, its number of tokens, the digest of its ids and the digest of what they decode to, in order."""
    code, waiting, size, hashes = coder(path), [], 0, []

    def flush():
        for (i, _), (ids, decoded) in zip(waiting, code.coded([t for _, t in waiting]), strict=True):
            hashes[i][0] += len(ids) // 4
            hashes[i][1].update(ids)
            hashes[i][2].update(decoded)
        waiting.clear()

    for i, text in enumerate(texts):
        hashes.append([0, hashlib.sha256(), hashlib.sha256()])
        for slab in _slabs(text or ""):
            waiting.append((i, slab))
            size += len(slab)
            if size > BATCH_CHARS:
                flush()
                size = 0
    flush()
    return [(n, a.hexdigest(), b.hexdigest()) for n, a, b in hashes]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, same (a hash of the text), n_tokens, ids_sha256, decoded_sha256.

    The ids are those of the rank file's own library without special tokens; the digests are of the ids as
    little-endian unsigned 32-bit integers and of the bytes they decode to. Null counts as empty: 0 tokens. Texts of
    any length are read whole; repeated rows give repeated results; an empty table gives an empty result. Other columns
    of docs are not read.
    """
    ship(docs.sparkSession)
    path = path or public_tokenizers.path(RANKS)

    def run(batches):
        for batch in common.sliced(batches, SLICE):
            found = coded(batch.column("text").to_pylist(), path)
            n, ids, decoded = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("same"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "same", "n_tokens", "ids_sha256", "decoded_sha256"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("same"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, "doc_id long, same long, n_tokens long, ids_sha256 string, decoded_sha256 string")
