"""Problem 7: encoding of a corpus with a public byte-level BPE vocabulary.

Two tiers.  A minimal perfect hash over the vocabulary (hash, displace, one slot a key) resolves every pre-token that
is a token by itself; what it misses is merged by a heap of candidate pairs over a doubly linked list of bytes.

The vocabulary is a fixed-size file: its tables (about 2 MB) are built once on the driver and broadcast.  There is no
shuffle: each Arrow batch is cut at spaces, its distinct pieces are encoded once, and the ids are gathered by numpy.

Defined cases: null and empty texts give an empty list; blank texts are encoded as they are; strings that look like
special tokens are ordinary text; lone surrogates cannot occur (Spark strings are UTF-8); repeated rows give repeated
rows; other columns of the input are ignored unless named.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pre-token pattern of this vocabulary, with white space as the Unicode property of that name.
PRE_TOKEN = (
    r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?![^\p{White_Space}])|\p{White_Space}+"
)
SPLITTER = regex.compile(PRE_TOKEN)
#: A space before other white space: only there may a cut at a space differ from the pattern's own cuts.
SPACE_RUN = r" [\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes to id, from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def heap_merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of ``piece``: the lowest-ranked neighbouring pair is merged first, leftmost among equals."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    part = [piece[i : i + 1] for i in range(n)]
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i]
        if part[i] is None or j < 0 or len(part[i]) + len(part[j]) != size:
            continue  # one of the two has been merged since
        part[i] += part[j]
        part[j] = None
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
        for a, b in ((before[i], i), (i, k)):
            if a >= 0 and b >= 0 and (r := ranks.get(part[a] + part[b])) is not None:
                heapq.heappush(heap, (r, a, len(part[a]) + len(part[b])))
    out, i = [], 0
    while i >= 0:
        out.append(ranks[part[i]])
        i = after[i]
    return out


class PerfectHash:
    """Minimal perfect hash of byte strings: buckets of about two keys, each with the displacement that fits.

    A bucket of one key takes any slot that is left; its displacement is that slot, as a negative number.
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = max(1, len(keys))
        m = self.m = n // 2 + 1
        h = np.array([self.halves(k) for k in keys], dtype=np.uint64).reshape(-1, 2)
        bucket = (h[:, 0] % np.uint64(m)).astype(np.int64)
        self.shift, self.slot = [0] * m, [-1] * n
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(m + 1))
        left = iter(())
        for b in sorted(range(m), key=lambda b: cuts[b] - cuts[b + 1]):
            own = order[cuts[b] : cuts[b + 1]].tolist()
            if len(own) == 1:
                at = next(left, None)
                if at is None:
                    left = iter([a for a in range(n) if self.slot[a] < 0])
                    at = next(left)
                self.slot[at], self.shift[b] = own[0], -1 - at
                continue
            halves, d = h[own, 1].tolist(), 0
            while own:
                at = [self.place(y, d) for y in halves]
                if len(set(at)) == len(at) and max(self.slot[a] for a in at) < 0:
                    for a, k in zip(at, own, strict=True):
                        self.slot[a] = k
                    self.shift[b] = d
                    break
                d += 1

    @staticmethod
    def halves(key: bytes) -> tuple[int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return h & 0xFFFFFFFFFFFFFFFF, h >> 64

    def place(self, y: int, d: int) -> int:
        if d < 0:
            return -1 - d
        return (((y ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF) >> 20) % self.n

    def index(self, key: bytes) -> int:
        """The position that ``key`` has if it is a key; the caller compares."""
        x, y = self.halves(key)
        return self.slot[self.place(y, self.shift[x % self.m])]


class Encoder:
    """Ids of texts by a vocabulary of ranks; keeps what it has encoded, up to ``keep`` pieces."""

    def __init__(self, ranks: dict[bytes, int], keep: int = 400_000):
        self.ranks, self.keep = ranks, keep
        self.keys = [k for k, r in ranks.items() if heap_merge(k, ranks) == [r]]
        self.ids = [ranks[k] for k in self.keys]
        self.hash = PerfectHash(self.keys)
        self.known: dict[str, np.ndarray] = {}
        self.tokens: dict[str, list[int]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "tokens": {}}

    def token(self, text: str) -> list[int]:
        """Ids of one pre-token: first tier, else second."""
        raw = text.encode()
        at = self.hash.index(raw)
        out = [self.ids[at]] if self.keys[at] == raw else heap_merge(raw, self.ranks)
        if len(text) < 32:
            if len(self.tokens) >= self.keep:
                self.tokens.clear()
            self.tokens[text] = out
        return out

    def piece(self, text: str) -> np.ndarray:
        """Ids of a text whose pre-tokens are found by the pattern."""
        found = self.known.get(text)
        if found is None:
            ids: list[int] = []
            for t in SPLITTER.findall(text):
                ids += self.tokens.get(t) or self.token(t)
            found = np.array(ids, np.int32)
            if len(text) < 64:
                if len(self.known) >= self.keep:
                    self.known.clear()
                self.known[text] = found
        return found

    def column(self, texts: pa.Array) -> pa.ListArray:
        """Ids of a string column."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        slow = np.asarray(pc.match_substring_regex(texts, SPACE_RUN).to_pylist(), bool)
        quick = pc.if_else(pa.array(~slow), texts, pa.scalar("", pa.large_string()))
        parts = pc.split_pattern(quick, " ")
        cuts = np.asarray(parts.offsets, np.int64)
        coded = parts.values.slice(cuts[0], cuts[-1] - cuts[0]).dictionary_encode()
        cuts = cuts - cuts[0]
        code = np.asarray(coded.indices, np.int64) * 2 + 1
        code[cuts[:-1]] -= 1  # the first piece of a text has no space before it
        used, code = np.unique(code, return_inverse=True)
        words = coded.dictionary.to_pylist()
        own = [self.piece(" " + words[c >> 1] if c & 1 else words[c >> 1]) for c in used.tolist()]
        size = np.array([len(x) for x in own], np.int64)
        flat = np.concatenate([*own, np.zeros(0, np.int32)])
        start = np.cumsum(size) - size
        each = size[code]
        ends = np.concatenate([[0], np.cumsum(each)])
        values = flat[np.repeat(start[code] - ends[:-1], each) + np.arange(ends[-1])]
        ends = ends[cuts]
        if slow.any():
            rows = [self.piece(t.as_py()) if s else values[a:b] for t, s, a, b in zip(texts, slow, ends, ends[1:], strict=False)]
            values, ends = np.concatenate([*rows, np.zeros(0, np.int32)]), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values, pa.int32()))


def encode_corpus(
    spark: SparkSession, df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY
) -> DataFrame:
    """``key`` and ``ids`` of every row of ``df``."""
    shared = spark.sparkContext.broadcast(Encoder(load_ranks(vocabulary)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        for rows in batches:
            for at in range(0, rows.num_rows, 2_000):
                part = rows.slice(at, 2_000)
                yield pa.RecordBatch.from_arrays([part.column(0), encoder.column(part.column(1))], names=["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, f"key {kind}, ids array<int>")
    return out.withColumnRenamed("key", key)
