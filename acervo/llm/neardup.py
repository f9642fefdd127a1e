"""Problem 6: near-duplicate records with small edits, by Order MinHash.

Texts are brought to the consistent form of problem 1, without case and accents, and cut into words.  Each of
``SKETCHES`` sketches of a text takes the ``TAKE`` least of its occurrence-labelled k-mers of ``K`` words and keeps them in
text order: two texts meet in a bucket with a probability that falls with their edit distance, reordering included.
These sketches pass over k-mers that come once in ``COMMON`` texts, and ``AT_LEAST`` times, so set phrases don't fill
buckets; texts that hold fewer others than a sketch takes use all.  ``WHOLE`` more sketches take ``WHOLE_TAKE`` k-mers of
all the rare ones and of every ``THIN``-th common one (by hash), so a large group, whose common k-mers are what makes it
one, meets too.

Exact copies are first folded into one representative, and k-mers are counted over these, in two passes that give the exact
common ones however the texts are split.  A bucket of up to ``SMALL`` texts gives all its pairs.  In a larger one every text
first gets the ``PIVOTS`` least ids that are not excluded; then all that are left of these whose texts the verified pairs
have not connected.  Every pair has to pass parity bitmaps of the sets of k-mers (the bits in which two differ are at most
the k-mers in which their sets do, so none that is similar is excluded).  No bucket is cut: what is not compared is
dissimilar by the bound or in the same group already.
Candidates are verified by banded alignment of their words; what the alignment leaves open (moved passages) is settled by
the exact similarity of the sets of ``K``-word sequences.  Groups are the connected components.

Sizes: what is broadcast are the common k-mers, of which there are at most ``COMMON`` times the mean number of k-mers in
a text; everything else is joined.  Texts are read whole; one task holds a batch of texts or of pairs, and the bitmaps of
``HELD`` texts of a bucket.  A bucket's comparisons of bitmaps grow with the square of its texts.

Defined cases: null, empty and blank texts, and those of less than ``K`` words, are in no group; repeated ids count as one;
ties between equal k-mers go to the earlier one; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from acervo.operators.components import components
from acervo.plans.workspace import Workspace

from .lookalike import ODD, mapped_form

K, LIMIT = 3, 0.5
SKETCHES, TAKE, COMMON, AT_LEAST = 20, 2, 5_000, 30
WHOLE, WHOLE_TAKE, THIN = 16, 3, 8
SEGMENT, NAMED = 20_000, 1_000_000
BAND = 24
#: Texts of a bucket that gives all its pairs; that a text is first compared with; whose bitmaps a task holds; ids that are
#: broadcast at most.
SMALL, PIVOTS, HELD, BROADCAST = 8, 8, 4_096, 300_000
#: Records of a group that one key of the join into pairs holds.
PART = 1_000
#: Bits of a parity bitmap.
LEAST_BITS, MOST_BITS = 128, 1 << 15

_ODD, _BLANKS = re.compile(ODD), re.compile(r"(\s+)")
_MARKS = re.compile("[" + chr(0x300) + "-" + chr(0x36F) + "]")
_WORD, _LATIN_WORD = re.compile(r"[^\W_]+"), re.compile("[a-z0-9]+")
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_TOP = np.uint64(1 << 63)


#: Odd stretches come again.
_form = lru_cache(1 << 15)(mapped_form)


def consistent(text: str) -> str:
    """The text in the consistent form of problem 1."""
    if text.isascii() or not _ODD.search(text):
        return text
    pieces = _BLANKS.split(text)  # every second one is blanks
    pieces[::2] = [c if c.isascii() or not _ODD.search(c) else _form(c) for c in pieces[::2]]
    return "".join(pieces)


def words_of(text: str) -> list[str]:
    """The words of a text in its consistent form, without case and accents."""
    return words_in(folded(consistent(text)))


def folded(text: str) -> str:
    """A text without case and accents."""
    return text.lower() if text.isascii() else _MARKS.sub("", unicodedata.normalize("NFD", text.casefold()))


def words_in(text: str) -> list[str]:
    """The words of a folded text."""
    return (_LATIN_WORD if text.isascii() else _WORD).findall(text)


class Numbers(dict):
    """Word to a 32-bit hash, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        n = self[word] = xxhash.xxh32_intdigest(word) - (1 << 31)
        return n


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(29))) * _M2
    return (x ^ (x >> np.uint64(32))) * _M1


def kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the sequences of ``k`` words."""
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    w = words.astype(np.int64).astype(np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix(out + w[i : i + n] * _M3 + np.uint64(i))
    return out


def kmers_of(words: np.ndarray, ends: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """K-mers of many texts, whose words lie one after the other up to ``ends``; and the text of each."""
    text = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
    own = kmers(words, k)
    inside = text[: len(own)] == text[k - 1 :] if len(own) else np.zeros(0, bool)
    return own[inside], text[: len(own)][inside]


def labelled(own: np.ndarray, text: np.ndarray) -> np.ndarray:
    """K-mers with the number of their occurrence in their text."""
    key = own ^ mix(text.astype(np.uint64) * _M3)
    s = np.sort(key)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    out = own.copy()
    if not len(twice):
        return out
    several = np.flatnonzero(Members(twice)(key))  # only these are put in order with their places
    order = several[np.argsort(key[several], kind="stable")]
    s = key[order]
    at = np.arange(len(s))
    first = np.concatenate([[True], s[1:] != s[:-1]])
    count = at - np.maximum.accumulate(np.where(first, at, 0))
    again = count > 0
    out[order[again]] = mix(own[order[again]] + count[again].astype(np.uint64) * _M3)
    return out


class Members:
    """Which of many hashes are among some sorted ones: these are found by their first bits, not by bisection."""

    def __init__(self, hashes: np.ndarray):
        bits = len(hashes).bit_length() + 2
        self.shift = np.uint64(64 - bits)
        size = np.bincount((hashes >> self.shift).astype(np.int64), minlength=1 << bits)
        self.starts = (np.cumsum(size) - size).astype(np.int32)
        self.most = int(size.max())
        self.hashes = np.concatenate([hashes, np.repeat(hashes[-1:], self.most)])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = self.starts[x >> self.shift]
        out = np.zeros(len(x), bool)
        for i in range(self.most):
            out |= self.hashes[at + i] == x
        return out


_SEEDS, _WHOLE_SEEDS = np.split(mix(np.arange(1, SKETCHES + WHOLE + 1, dtype=np.uint64) * _M3), [SKETCHES])
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketches(words: np.ndarray, ends: np.ndarray, common: np.ndarray | Members, rare: int = SKETCHES, whole: int = WHOLE) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of many texts, one a sketch, and the text of each; texts without k-mers have none.

    The first ``rare`` pass over the k-mers of ``common`` (sorted); ``whole`` others take a ``THIN``-th of them.
    """
    own, text = kmers_of(words, ends)
    if not len(own):
        return own, text
    late = (common if isinstance(common, Members) else Members(common))(own)
    thin = late & (mix(own ^ _M2) % np.uint64(THIN) > 0)
    own = labelled(own, text)
    parts = [drawn(own, text, late, _SEEDS[:rare], TAKE)]
    if whole:
        parts.append(drawn(own, text, thin, _WHOLE_SEEDS[:whole], WHOLE_TAKE))
    return np.concatenate([b for b, _ in parts]), np.concatenate([t for _, t in parts])


def drawn(own: np.ndarray, text: np.ndarray, late: np.ndarray, seeds: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray]:
    """A bucket for each seed and text, and the text; of labelled k-mers without the ``late`` ones, which fill up short texts.

    A sketch takes the least k-mers one after the other by minima over each text, then combines them in text order.
    """
    few = np.bincount(text, weights=~late) < take
    keep = ~late | few[text]
    own, text, late = own[keep], text[keep], late[keep]
    starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    size = np.diff(np.append(starts, len(own)))
    which = np.repeat(np.arange(len(starts)), size)
    out = np.empty((len(seeds), len(starts)), np.uint64)
    for j, seed in enumerate(seeds):
        h = mix(own ^ seed) >> np.uint64(1)
        h[late] |= _TOP
        taken = np.empty((take, len(starts)), np.int64)
        for i in range(take):
            least = np.minimum.reduceat(h, starts)
            hit = np.flatnonzero(h == least[which])
            taken[i] = hit[np.concatenate([[True], which[hit[1:]] != which[hit[:-1]]])]
            h[taken[i]] = _FULL
        for i in range(1, take):  # nothing is left to take: the last one again
            taken[i] = np.where(i >= size, taken[i - 1], taken[i])
        taken.sort(axis=0)
        b = np.full(len(starts), seed)
        for i in range(take):
            b = mix(b + own[taken[i]] * _M3)
        out[j] = b
    return out.ravel(), np.tile(text[starts], len(seeds))


def bitmap(words: np.ndarray) -> tuple[int, bytes]:
    """The size of a text's set of k-mers and its parity bitmap: twice as many bits or more, each the parity of its k-mers."""
    own = np.unique(kmers(words))
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * len(own) - 1).bit_length()))
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return len(own), np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Maps:
    """Bitmaps of some texts, by their length and folded to half of it."""

    def __init__(self, sizes: np.ndarray, maps: list[bytes]):
        self.sizes, self.by = sizes, {}
        long = np.array([len(m) for m in maps])
        for n in np.unique(long).tolist():
            at = np.flatnonzero(long == n)
            full = np.frombuffer(b"".join(maps[i] for i in at), np.uint64).reshape(len(at), -1)
            self.by[n] = at, full, full[:, : n // 16] ^ full[:, n // 16 :]

    def may(self, other: Maps, limit: float = LIMIT) -> np.ndarray:
        """Whether the sets of each text here and each of ``other`` may have the similarity ``limit``."""
        out = np.zeros((len(self.sizes), len(other.sizes)), bool)
        for n, (i, full, half) in self.by.items():
            for m, (j, full2, half2) in other.by.items():  # at 0.5 sizes differ at most twofold, and so do lengths
                if max(n, m) <= 2 * min(n, m):
                    x, y = full if n <= m else half, full2 if m <= n else half2
                    apart = np.zeros((len(i), len(j)), np.int64)
                    for k in range(x.shape[1]):
                        apart += np.bitwise_count(x[:, k, None] ^ y[None, :, k])
                    both = self.sizes[i][:, None] + other.sizes[j][None, :]
                    out[np.ix_(i, j)] = apart <= both * (1 - limit) / (1 + limit) + 1e-6
        return out


def banded(pairs: list[tuple[np.ndarray, np.ndarray]], band: int = BAND) -> np.ndarray:
    """Words that the best alignment within ``band`` of the diagonal matches, for many pairs at once."""
    n = np.array([len(a) for a, _ in pairs])
    rows, wide = int(n.max()), 2 * band + 1
    cols = max(len(b) for _, b in pairs)
    left = np.zeros((len(pairs), rows), np.int32)
    right = np.zeros((len(pairs), max(rows, cols) + 2 * wide), np.int32)
    inside = np.zeros(right.shape, bool)
    for i, (a, b) in enumerate(pairs):
        left[i, : len(a)] = a
        right[i, band : band + len(b)] = b
        inside[i, band : band + len(b)] = True
    best = np.zeros((len(pairs), wide + 1), np.int32)
    for i in range(rows):
        same = (right[:, i : i + wide] == left[:, i, None]) & inside[:, i : i + wide] & (i < n)[:, None]
        step = np.maximum(best[:, :-1] + same, best[:, 1:])
        best[:, :-1] = np.maximum.accumulate(step, axis=1)
        best[:, -1] = best[:, -2]
    return best.max(axis=1)


def shared_sets(pairs: list[tuple[np.ndarray, np.ndarray]], limit: float = LIMIT) -> np.ndarray:
    """Whether the sets of ``K``-word sequences of each pair have the similarity ``limit``, exactly, for many pairs at once."""
    ok = np.zeros(len(pairs), bool)
    for at in range(0, len(pairs), 512):
        part = pairs[at : at + 512]
        sets = []
        for side in (0, 1):
            own, which = kmers_of(np.concatenate([p[side] for p in part]), np.cumsum([len(p[side]) for p in part]))
            key, first = np.unique(own ^ mix((which + 1).astype(np.uint64) * _M3), return_index=True)
            sets.append((key, which[first]))
        (a, pa_), (b, pb_) = sets
        both = np.bincount(pb_[np.isin(b, a, assume_unique=True, kind="sort")], minlength=len(part))
        whole = np.bincount(pa_, minlength=len(part)) + np.bincount(pb_, minlength=len(part)) - both
        ok[at : at + 512] = (both > 0) & (both >= limit * whole)
    return ok


def similar(pairs: list[tuple[np.ndarray, np.ndarray]], limit: float = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Whether the similarity of each pair reaches ``limit``, and the words that its banded alignment matches."""
    matched = np.zeros(len(pairs), np.int32)
    by: dict[int, list[int]] = defaultdict(list)
    for i, (a, b) in enumerate(pairs):
        if 2 * min(len(a), len(b)) >= max(len(a), len(b)):  # else the alignment can't settle it
            by[max(len(a), len(b)).bit_length()].append(i)
    for own in by.values():
        for at in range(0, len(own), 256):
            part = own[at : at + 256]
            matched[part] = banded([pairs[i] for i in part])
    n = np.array([len(a) for a, _ in pairs]), np.array([len(b) for _, b in pairs])
    # each unmatched word spoils at most K sequences; a twentieth is left for sequences that come twice
    shared = np.maximum(0, np.minimum(*n) - K + 1 - K * (n[0] + n[1] - 2 * matched))
    ok = (shared > 0) & (shared >= (limit + 0.05) * (n[0] + n[1] - 2 * (K - 1) - shared))
    left = np.flatnonzero(~ok)
    ok[left] = shared_sets([pairs[i] for i in left], limit)
    return ok, matched


def tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """``id``, ``palavras`` (numbers, as bytes), ``marca`` (their hash) of every text of ``K`` words or more."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Numbers()
        for part in batches:
            own = [[number[w] for w in words_of(t)] for t in part.column(1).to_pylist()]
            keep = [i for i, w in enumerate(own) if len(w) >= K]
            raw = [np.array(own[i], np.int32).tobytes() for i in keep]
            marks = [xxhash.xxh3_128_digest(x) for x in raw]
            ids = part.column(0).take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(raw, pa.binary()), pa.array(marks, pa.binary())], names=["id", "palavras", "marca"])

    rows = df.select(key, text).where(F.length(F.trim(F.col(text))) > 0)
    return rows.mapInArrow(run, f"id {kind}, palavras binary, marca binary")


def word_numbers(column: pa.Array) -> list[np.ndarray]:
    """The word numbers that a binary column holds."""
    return [np.frombuffer(x, np.int32) for x in column.to_pylist()]


def common_kmers(words: DataFrame, count: int | None = None) -> np.ndarray:
    """K-mers that come once in ``COMMON`` texts or more, sorted: at most ``COMMON`` times the mean k-mers of a text.

    One that is common over all texts is as common in some part of them: a first pass collects what any part of up to
    ``SEGMENT`` texts finds common, with what these parts have of them; a second counts over all texts those for which that is
    not enough.  How texts are split changes nothing.  If the parts are so unlike that they name more than ``NAMED`` together,
    all k-mers are counted by a shuffle instead.
    """
    texts = words.count() if count is None else count
    least = max(AT_LEAST, -(-texts // COMMON))

    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int]]:
        held, n = [], 0
        for part in batches:
            for at in range(0, part.num_rows, SEGMENT):
                lists = word_numbers(part.column(0).slice(at, SEGMENT))
                held.append(kmers_of(np.concatenate(lists), np.cumsum([len(x) for x in lists]))[0])
                n += len(lists)
                if n >= SEGMENT:
                    yield np.concatenate(held), n
                    held, n = [], 0
        if n:
            yield np.concatenate(held), n

    def nominate(batches: Iterable[pa.RecordBatch], all_of_them: bool = False) -> Iterator[pa.RecordBatch]:
        for own, n in parts(batches):
            all_, times = np.unique(own, return_counts=True)
            often = times * texts >= (0 if all_of_them else least * n)
            yield pa.RecordBatch.from_arrays([pa.array(all_[often].astype(np.int64)), pa.array(times[often])], names=["comum", "n"])

    def counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total = np.zeros(len(known), np.int64)
        for own, _ in parts(batches):
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            total += np.bincount(at[known[at] == own], minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(known.astype(np.int64)), pa.array(total)], names=["comum", "n"])

    def added_up(run: object) -> DataFrame:
        return words.select("palavras").mapInArrow(run, "comum long, n long").groupBy("comum").agg(F.sum("n").alias("n"))

    def numbers(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        table = rows.toArrow()
        return table.column("comum").to_numpy().astype(np.int64).view(np.uint64), table.column("n").to_numpy()

    named, n = numbers(added_up(nominate).limit(NAMED + 1))
    if len(named) > NAMED:
        return np.sort(numbers(added_up(lambda rows: nominate(rows, True)).where(F.col("n") >= least))[0])
    known = np.sort(named[n < least])
    if not len(known):
        return np.sort(named)
    shared = words.sparkSession.sparkContext.broadcast(known)
    return np.sort(np.concatenate([named[n >= least], numbers(added_up(counts).where(F.col("n") >= least))[0]]))


def buckets(spark: SparkSession, words: DataFrame, common: np.ndarray, rare: int = SKETCHES, whole: int = WHOLE) -> DataFrame:
    """``balde`` and ``id``: the buckets of every text."""
    shared, kind = spark.sparkContext.broadcast(common), words.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Members(shared.value)
        for rows in batches:
            for at in range(0, rows.num_rows, 2_000):
                part = rows.slice(at, 2_000)
                lists = word_numbers(part.column(1))
                own, text = sketches(np.concatenate(lists), np.cumsum([len(x) for x in lists]), known, rare, whole)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), part.column(0).take(pa.array(text))], names=["balde", "id"])

    return words.select("id", "palavras").mapInArrow(run, f"balde long, id {kind}")


def runs(rows: DataFrame, by_run: object, schema: str) -> DataFrame:
    """What ``by_run`` makes of each batch of whole buckets, whose rows come by ``id``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for part in batches:
            if not part.num_rows:
                continue
            now = pa.Table.from_batches([part] if rest is None else [*rest.to_batches(), part])
            key = now.column("balde").to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            rest = now.slice(last)
            if last:
                yield from by_run(now.slice(0, last).combine_chunks())
        if rest is not None:
            yield from by_run(rest.combine_chunks())

    return rows.repartition("balde").sortWithinPartitions("balde", "id").mapInArrow(run, schema)


def meetings(buckets: DataFrame) -> DataFrame:
    """``a``, ``b``: the pairs of buckets of up to ``SMALL`` texts; ``balde``, ``a``: the texts of larger ones."""
    kind = buckets.schema["id"].dataType.simpleString()

    def by_run(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, ids = rows.column("balde").to_numpy(), rows.column("id").combine_chunks()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.repeat(*[np.diff(np.append(first, len(key)))] * 2)
        left, right = [], []
        for d in range(1, SMALL):
            at = np.flatnonzero((key[d:] == key[:-d]) & (size[d:] <= SMALL))
            left.append(at)
            right.append(at + d)
        a, b, hot = np.concatenate(left), np.concatenate(right), np.flatnonzero(size > SMALL)
        none = pa.nulls(len(a), pa.int64())
        yield pa.RecordBatch.from_arrays([none, ids.take(pa.array(a)), ids.take(pa.array(b))], names=["balde", "a", "b"])
        yield pa.RecordBatch.from_arrays([pa.array(key[hot]), ids.take(pa.array(hot)), pa.nulls(len(hot), ids.type)], names=["balde", "a", "b"])

    return runs(buckets.select("balde", "id"), by_run, f"balde long, a {kind}, b {kind}")


def bitmaps(words: DataFrame) -> DataFrame:
    """``id``, ``n``, ``mapa`` of every text."""
    kind = words.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            own = [bitmap(w) for w in word_numbers(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in own], pa.int32()), pa.array([m for _, m in own], pa.binary())], names=["id", "n", "mapa"])

    return words.select("id", "palavras").mapInArrow(run, f"id {kind}, n int, mapa binary")


def hot_pairs(rows: DataFrame, most: int | None, limit: float = LIMIT) -> DataFrame:
    """``a``, ``b``: of the first ``HELD`` texts of a bucket those that may be similar to a later one and have another ``grupo``.

    ``rows`` has ``balde``, ``id``, ``n``, ``mapa``, ``grupo``; a text gets the ``most`` least ids of these, or all.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def by_run(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, ids, maps = rows.column("balde").to_numpy(), rows.column("id").combine_chunks(), rows.column("mapa")
        size, group = rows.column("n").to_numpy(), rows.column("grupo").combine_chunks().dictionary_encode().indices.to_numpy()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        for s, e in zip(first, first[1:], strict=False):
            end = min(e, s + HELD)
            head = Maps(size[s:end], maps.slice(s, end - s).to_pylist())
            for at in range(s, e, 1_000):
                to = min(e, at + 1_000)
                ok = Maps(size[at:to], maps.slice(at, to - at).to_pylist()).may(head, limit)
                ok &= np.arange(at, to)[:, None] > np.arange(s, end)[None, :]
                ok &= group[at:to][:, None] != group[s:end][None, :]
                if most is not None:
                    ok &= np.cumsum(ok, axis=1) <= most
                b, a = np.nonzero(ok)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a + s)), ids.take(pa.array(b + at))], names=["a", "b"])

    return runs(rows.select("balde", "id", "n", "mapa", "grupo"), by_run, f"a {kind}, b {kind}").distinct()


def possible(pairs: DataFrame, maps: DataFrame, limit: float = LIMIT) -> DataFrame:
    """The pairs ``a``, ``b`` whose parity bitmaps allow the similarity ``limit``."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            keep = []
            for i, (n, m, x, y) in enumerate(zip(*(part.column(c).to_pylist() for c in range(2, 6)), strict=True)):
                wide = min(len(x), len(y))
                u, v = narrowed(x, wide), narrowed(y, wide)
                keep.append((u ^ v).bit_count() <= (n + m) * (1 - limit) / (1 + limit) + 1e-6)
            yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    for c in ("a", "b"):
        pairs = pairs.join(maps.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("mapa").alias(f"m{c}")), c)
    return pairs.select("a", "b", "na", "nb", "ma", "mb").mapInArrow(run, f"a {kind}, b {kind}")


def narrowed(bits: bytes, wide: int) -> int:
    """A bitmap as a number, folded to ``wide`` bytes."""
    out = int.from_bytes(bits, "little")
    size = len(bits)
    while size > wide:
        size //= 2
        out = (out >> 8 * size) ^ (out & ((1 << 8 * size) - 1))
    return out


def verify(pairs: DataFrame, words: DataFrame, limit: float = LIMIT, align: bool = True) -> DataFrame:
    """``a``, ``b``, ``ok``, ``alinhadas`` of pairs of ids; without ``align`` by their sets of sequences alone."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            both = list(zip(word_numbers(part.column(2)), word_numbers(part.column(3)), strict=True))
            ok, matched = similar(both, limit) if align else (shared_sets(both, limit), np.zeros(len(both), np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ok), pa.array(matched)], names=["a", "b", "ok", "alinhadas"])

    own = words.select("id", "palavras")
    both = pairs.join(own.select(F.col("id").alias("b"), F.col("palavras").alias("pb")), "b")
    both = both.join(own.select(F.col("id").alias("a"), F.col("palavras").alias("pa")), "a")
    return both.select("a", "b", "pa", "pb").mapInArrow(run, f"a {kind}, b {kind}, ok boolean, alinhadas int")


def only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose ``id`` is among ``ids``, which are broadcast if they are few."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST else ids, "id", "left_semi")


def groups(spark: SparkSession, df: DataFrame, key: str = "id", text: str = "texto") -> DataFrame:
    """``id`` and ``grupo`` (the least id of the group) of every record that is in a group of two or more."""
    work = Workspace(spark, "neardup")
    texts = work.save(tokens(df, key, text), "tokens")
    copies = texts.groupBy("marca").agg(F.min("id").alias("grupo"), F.count("*").alias("n")).where("n > 1")
    copies = work.save(texts.select("id", "marca").join(copies, "marca").select("id", "grupo").distinct(), "copies")
    words = texts.join(copies.where("id <> grupo"), "id", "left_anti").select("id", "palavras")
    meet = work.save(meetings(buckets(spark, words, common_kmers(words))), "met")
    hot = meet.where("balde IS NOT NULL").select("balde", F.col("a").alias("id"))
    ids = meet.select(F.explode(F.array("a", "b")).alias("id")).where("id IS NOT NULL").distinct()
    words = work.save(only(words, ids), "words")
    maps = work.save(bitmaps(words), "maps")
    first = hot.join(maps, "id").withColumn("grupo", F.col("id"))
    pairs = possible(meet.where("a <> b").select("a", "b").distinct(), maps).union(hot_pairs(first, PIVOTS)).distinct()
    told = work.save(verify(pairs, words), "told").select("a", "b", "ok")
    # what the first pairs have not connected: all pairs of the first HELD texts of each bucket, then without these
    with Workspace(spark, "neardup-first") as inner:
        joined = work.save(components(told.where("ok"), inner).select(F.col("no").alias("id"), "grupo"), "joined")
    rest = hot.join(joined, "id", "left").withColumn("grupo", F.coalesce("grupo", "id"))
    apart = rest.groupBy("balde").agg(F.min("grupo").alias("x"), F.max("grupo").alias("y")).where("x <> y").select("balde")
    rest, step = work.save(rest.join(apart, "balde"), "rest"), 0
    while not rest.isEmpty():
        pairs = hot_pairs(rest.join(maps, "id"), None).join(told, ["a", "b"], "left_anti")
        told = told.union(work.save(verify(pairs, words), f"told{step}").select("a", "b", "ok"))
        at = F.row_number().over(W.partitionBy("balde").orderBy("id"))
        rest = work.save(rest.withColumn("r", at).where(F.col("r") > HELD).drop("r"), f"rest{step}")
        step += 1
    edges = copies.where("id <> grupo").select(F.col("grupo").alias("a"), F.col("id").alias("b"))
    edges = edges.union(told.where("ok").select("a", "b"))
    return work.finish(components(edges, work).select(F.col("no").alias("id"), "grupo"), "groups")


def found(spark: SparkSession, df: DataFrame, key: str = "id", text: str = "texto") -> DataFrame:
    """``id_a`` < ``id_b``: every pair of records of the same group.

    A group's records are dealt to as many keys as it has ``PART`` of them, each of which meets all of the group.
    """
    own = groups(spark, df, key, text)
    parts = own.groupBy("grupo").agg(F.ceil(F.count("*") / PART).cast("int").alias("partes"))
    own = own.join(parts, "grupo")
    a = own.select(F.col("id").alias("id_a"), "grupo", F.pmod(F.xxhash64("id"), F.col("partes")).cast("int").alias("parte"))
    b = own.select(F.col("id").alias("id_b"), "grupo", F.explode(F.sequence(F.lit(0), F.col("partes") - 1)).alias("parte"))
    return a.join(b, ["grupo", "parte"]).where("id_a < id_b").select("id_a", "id_b")
