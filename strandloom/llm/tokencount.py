"""Token counts of whole texts, as a tokenizer's own library gives them, by overlap resynchronisation.

Every text of more than CHUNK characters is encoded in chunks that overlap, with offsets. The right chunk starts anywhere,
mostly inside a word; where both chunks start a token after white space and agree on the AGREE tokens that follow, they
are resynchronised: white space is in no token of this kind of tokenizer and decides nothing about what follows it, so
that place is a proven stable boundary, and the chunks are spliced there. If an overlap has no such place it is widened,
at least to the next white space, and what is known of it is not encoded again: a worker remembers the tokens of short
stretches between white space in two tables of bounded bytes: when the newer is full, it becomes the older, of which
only what is met again is kept. Longer stretches are encoded by
the library where they are met.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandloom.llm import common
from strandloom.session import ship

MODEL = "word_bpe_49k.json"
#: Characters of a chunk and of the first overlap; tokens that must agree.
CHUNK, OVERLAP, AGREE = 1024, 64, 8
#: Bytes that a worker's remembered stretches may take, about (each takes ROW beside its characters and tokens); characters of those that are remembered; characters of texts that are counted at once.
KNOWN_BYTES, ROW, SHORT, BATCH = 100_000_000, 200, 200, 4_000_000
#: More tokens than this are over the limit.
LIMIT = 2048


class Counter:
    """Counts tokens without begin, end or added special tokens; special strings in a text are what the library makes of them."""

    def __init__(self, path: str):
        self.library, self.known, self.old, self.size = Tokenizer.from_file(path), {}, {}, 0
        self.library.no_truncation()
        self.library.no_padding()

    def learn(self, fresh: list[str]) -> None:
        """Remember the tokens of short stretches."""
        for k in range(0, len(fresh), 1000):
            some = fresh[k : k + 1000]
            for piece, found in zip(some, self.library.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.known[piece] = ids = tuple(found.ids)
                self.size += ROW + len(piece) + 8 * len(ids)

    def found_again(self, piece: str) -> bool:
        """Whether the older table has a stretch, which then goes to the newer one."""
        ids = self.old.get(piece)
        if ids is None:
            return False
        self.known[piece] = ids
        self.size += ROW + len(piece) + 8 * len(ids)
        return True

    def tokens(self, piece: str) -> tuple[int, ...]:
        """The ids of a stretch between white space."""
        ids = self.known.get(piece)
        if ids is None:
            if len(piece) > SHORT:
                return tuple(self.library.encode(piece, add_special_tokens=False).ids)
            if not self.found_again(piece):
                self.learn([piece])
            ids = self.known[piece]
        return ids

    def encoded(self, text: str, start: int, stop: int) -> list[tuple[int, int, int]]:
        """The tokens of text[start:stop] in order: offset of the stretch that a token is in, its place there, id."""
        found, at = [], start
        for piece in text[start:stop].split(" "):
            if at > start or len(piece) <= SHORT:  # no place in a long stretch that the cut goes through
                found += [(at, k, i) for k, i in enumerate(self.tokens(piece))]
            at += len(piece) + 1
        return found

    def number(self, text: str) -> int:
        """How many tokens a text has, all stretches of which are encoded."""
        return sum(map(len, map(self.tokens, text.split(" "))))

    def spliced(self, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> int:
        """The number of tokens of a text of any length; its white space is spaces."""
        count, at, n = 0, 0, len(text)
        while n - at > size:
            end, width = at + size, overlap
            while True:
                stop = min(n, end + width)
                place = self.common(text, end, stop)
                if place is not None or stop == n:
                    break
                gap = text.find(" ", stop)
                width = max(2 * width, (n if gap < 0 else gap) + overlap - end)
            if place is None:
                break
            count += self.number(text[at : place - 1])
            at = place
        return count + self.number(text[at:])

    def common(self, text: str, end: int, stop: int) -> int | None:
        """The first place from end to stop at which the tokens of the chunk that goes on to `stop` and those of the chunk from `end` start after white space and the next AGREE are the same."""
        if text.find(" ", end, stop) < 0:
            return None
        left = self.encoded(text, text.find(" ", end - 1) + 1, stop)  # as the left chunk has them, from its first stretch that the cut doesn't go through
        right = self.encoded(text, end, stop)
        ours = {t[0]: k for k, t in reversed(list(enumerate(left)))}
        for k, (a, nth, _) in enumerate(right):
            if nth == 0 and a > end and text[a - 1] == " " and a in ours:
                mine = left[ours[a] : ours[a] + AGREE]
                if len(mine) == AGREE and mine == right[k : k + AGREE] and (stop == len(text) or mine[-1][0] <= text.rfind(" ", end, stop)):
                    return a
        return None

    def counts(self, texts: list[str]) -> list[int]:
        if self.size > KNOWN_BYTES // 2:  # what isn't met again before the next time is forgotten then
            self.old, self.known, self.size = self.known, {}, 0
        texts, fresh = [t.replace("\n", " ") for t in texts], set()
        for text in texts:
            for k in range(0, len(text), BATCH):
                fresh.update(p for p in set(text[k : k + BATCH].split(" ")) if len(p) <= SHORT and p not in self.known and not self.found_again(p))
                if len(fresh) * ROW > KNOWN_BYTES // 4:
                    self.learn(list(fresh))
                    fresh = set()
        self.learn(list(fresh))
        return [self.spliced(t) for t in texts]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit (more than LIMIT tokens).

    Null counts as empty: 0 bytes and tokens. Texts of any length are counted whole; repeated rows give repeated
    results; an empty table gives an empty result. Other columns of docs are not read.
    """
    ship(docs.sparkSession)
    path = path or public_tokenizers.path(MODEL)

    def run(batches):
        count = counter(path)
        for batch in common.sliced(batches, 8_000_000):
            texts, found, some, size = [t or "" for t in batch.column("text").to_pylist()], [], [], 0
            for text in texts:
                some.append(text)
                size += len(text)
                if size > BATCH:
                    found += count.counts(some)
                    some, size = [], 0
            found += count.counts(some)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(found, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.col(text_col)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    return given.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > LIMIT)
