"""Detection of periodic runs of words: stretches that repeat themselves at once, as stuck generators and broken pages do.

A run has smallest period q, at least max(12, 2 * q) words, and ends where no neighbouring word keeps the period. Every
run holds a Lyndon root under one of two orders of the words, so a stack scanned from right to left under each order names
a candidate at every position; rolling hashes with binary search compare suffixes and extend candidates, and the words of
every run found are compared directly (a run that fails has its stretch done again with another base). No suffix array.

Before the scan, words that can't lie in a run are set aside: a run repeats six words or more at its period, so it lies in
stretches covered by six-word shingles that occur twice in the same stretch. Only those stretches are scanned, and they
hold every run as a whole, so that plain prose costs array steps alone. Each text is worked on by the task that reads it,
in slices of bounded bytes; nothing is shuffled. A single text needs about 30 times its bytes.

Defined cases: null, empty and white texts have no words and no runs; ids may repeat or be null; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchspark.llm.common import BASE, bounded_batches, mix, text_batches, text_bytes, word_spans

#: Words of a run at least, and the consecutive words that any run repeats: the least of max(12 - q, q).
LEAST_WORDS, SHINGLE = 12, 6
#: Hashes are modulo this prime; the bases are tried in turn.
PRIME = (1 << 61) - 1
BASES = (1_204_391_873_021_771_133, 906_180_339_887_498_949, 577_215_664_901_532_861, 1_618_033_988_749_894_849)
#: Bytes of kept text that are put together at once.
JOIN_BYTES = 2_000_000


# --- runs of one stretch -----------------------------------------------------------------------------------------


class Stretch:
    """Words of a stretch as numbers, with rolling hashes for longest common extensions."""

    def __init__(self, words: np.ndarray, base: int) -> None:
        self.words = words.tolist()
        sums, power, total, factor = [0], [1], 0, 1
        for x in self.words:
            total = (total * base + x + 1) % PRIME
            factor = factor * base % PRIME
            sums.append(total)
            power.append(factor)
        self.sums, self.power = sums, power

    def right(self, i: int, j: int) -> int:
        """How many words from ``i`` on equal those from ``j`` on (i < j)."""
        words, most = self.words, len(self.words) - j
        k = 0
        while k < most and k < 8:
            if words[i + k] != words[j + k]:
                return k
            k += 1
        if k == most:
            return k
        sums, power = self.sums, self.power
        apart, known, step = sums[i] - sums[j], k, 8
        while known < most:  # steps that double, then halve: a search by bisection from the near end
            to = min(known + step, most)
            if (sums[i + to] - sums[j + to] - apart * power[to]) % PRIME:
                break
            known, step = to, step * 2
        else:
            return most
        over = min(known + step, most)
        while over - known > 1:
            to = (known + over) // 2
            if (sums[i + to] - sums[j + to] - apart * power[to]) % PRIME:
                over = to
            else:
                known = to
        return known

    def left(self, i: int, j: int) -> int:
        """How many words before ``i`` equal those before ``j`` (i < j)."""
        words, k = self.words, 0
        while k < i and k < 8:
            if words[i - 1 - k] != words[j - 1 - k]:
                return k
            k += 1
        if k == i:
            return k
        sums, power = self.sums, self.power
        same = lambda n: not (sums[i] - sums[j] - (sums[i - n] - sums[j - n]) * power[n]) % PRIME
        known, step = k, 8
        while known < i:
            to = min(known + step, i)
            if not same(to):
                break
            known, step = to, step * 2
        else:
            return i
        over = min(known + step, i)
        while over - known > 1:
            to = (known + over) // 2
            known, over = (to, over) if same(to) else (known, to)
        return known

    def lyndon_ends(self, sign: int) -> list[int]:
        """Where the longest Lyndon word from each position ends, words ordered by ``sign`` times their number."""
        words, n = self.words, len(self.words)
        ends = [n] * n
        for i in range(n - 2, -1, -1):
            own, j = words[i] * sign, i + 1
            while j < n:  # the stack: ends of ends
                other = words[j] * sign
                if other == own:
                    k = self.right(i, j)
                    if j + k == n or words[j + k] * sign < words[i + k] * sign:
                        break
                elif other < own:
                    break
                j = ends[j]
            ends[i] = j
        return ends


def _stretch_runs(words: np.ndarray, base: int) -> set[tuple[int, int, int]]:
    stretch, found = Stretch(words, base), set()
    for sign in (1, -1):
        ends = np.asarray(stretch.lyndon_ends(sign))
        starts = np.flatnonzero(ends < len(words))
        ends = ends[starts]
        near = words[starts] == words[ends]
        near |= (starts > 0) & (words[starts - 1] == words[ends - 1])
        last: dict[int, tuple[int, int]] = {}  # of each period, the run found last
        for i, j in zip(starts[near].tolist(), ends[near].tolist(), strict=True):
            q = j - i
            if q in last and last[q][0] <= i and j <= last[q][1]:
                continue  # another root of the same run
            start, end = i - stretch.left(i, j), j + stretch.right(i, j)
            if end - start >= max(LEAST_WORDS, 2 * q):
                found.add((start, end - start, q))
                last[q] = start, end
    return found


def _verified(words: np.ndarray, runs: set[tuple[int, int, int]]) -> bool:
    """Whether the words themselves say that every run has its period and goes no further."""
    n = len(words)
    for start, length, q in runs:
        end = start + length
        if not np.array_equal(words[start : end - q], words[start + q : end]):
            return False
        if (start and words[start - 1] == words[start - 1 + q]) or (end < n and words[end] == words[end - q]):
            return False
    return True


def word_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of numbers, by start, then period."""
    found = []
    for lo, hi in zip(*stretches(words, np.zeros(len(words), dtype=np.int64)), strict=True):
        found += [(int(lo) + start, length, q) for start, length, q in _runs_within(words[lo:hi])]
    return sorted(found, key=lambda r: (r[0], r[2]))


def _runs_within(words: np.ndarray) -> set[tuple[int, int, int]]:
    _, words = np.unique(words, return_inverse=True)
    for base in BASES:
        runs = _stretch_runs(words, base)
        if _verified(words, runs):
            return runs
    raise ArithmeticError("hashes of different words agree under every base")


def stretches(words: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches that can hold runs; ``docs`` numbers the document of each word, ascending."""
    at = np.arange(len(words))  # the words still in question
    stretch = docs
    while len(at) >= LEAST_WORDS:
        n = len(at) - SHINGLE + 1
        key = np.zeros(n, dtype=np.uint64)
        hashed = mix(words[at])
        for k in range(SHINGLE):
            key = key * np.uint64(BASE) + hashed[k : k + n]
        key ^= mix(stretch[:n] + 1)
        whole = (at[SHINGLE - 1 :] - at[:n] == SHINGLE - 1) & (stretch[:n] == stretch[SHINGLE - 1 :])
        places = np.flatnonzero(whole)
        order = places[np.argsort(key[places])]
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(n + 1, dtype=bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        begin = np.flatnonzero(twice)
        change = np.zeros(len(at) + 1, dtype=np.int64)
        np.add.at(change, begin, 1)
        np.add.at(change, begin + SHINGLE, -1)
        stay = np.cumsum(change[:-1]) > 0
        kept = at[stay]
        if not len(kept):
            break
        new = np.append(True, (kept[1:] - kept[:-1] > 1) | (docs[kept[1:]] != docs[kept[:-1]]))
        if len(kept) == len(at):
            first = np.flatnonzero(new)
            lo, hi = kept[first], kept[np.append(first[1:], len(kept)) - 1] + 1
            long = hi - lo >= LEAST_WORDS
            return lo[long], hi[long]
        at, stretch = kept, np.cumsum(new)
    none = np.empty(0, dtype=np.int64)
    return none, none


# --- documents ---------------------------------------------------------------------------------------------------

OUT = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, n_dropped long, "
    "runs_sha256 string, collapsed_sha256 string, runs array<struct<start: long, length: long, period: long>>"
)


def _as_sequences(order: np.ndarray, bounds: np.ndarray, plant_at: list, plant_period: list) -> None:
    """Replace the words of a document from a place on by a repetition of the first of them, in ``order``."""
    for d, (a, p) in enumerate(zip(plant_at, plant_period, strict=True)):
        lo, hi = bounds[d], bounds[d + 1]
        if a is not None and lo + a < hi:
            order[lo + a : hi] = lo + a + np.arange(hi - lo - a) % p


def _hash_joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> list:
    """SHA-256 of each document's words joined by one space; ``bounds`` cuts the words into documents."""
    hashes = [sha256() for _ in range(len(bounds) - 1)]
    size = ends - starts + 1
    total = np.concatenate(([0], np.cumsum(size)))
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + JOIN_BYTES, side="right")) - 1)
        step = np.ones(total[hi] - total[lo], dtype=np.int64)
        begin = total[lo:hi] - total[lo]
        step[begin] = np.diff(np.concatenate(([0], starts[lo:hi] + size[lo:hi] - 1)))[: hi - lo]
        step[begin] = starts[lo:hi] - np.concatenate(([0], starts[lo : hi - 1] + size[lo : hi - 1] - 1))
        source = np.cumsum(step)
        last = begin + size[lo:hi] - 1
        source[last] = 0
        body = data[source]
        body[last] = 32
        view = memoryview(body)
        d = int(np.searchsorted(bounds, lo, side="right")) - 1
        while d < len(hashes) and bounds[d] < hi:
            a, b = max(bounds[d], lo), min(bounds[d + 1], hi)
            if a < b:
                stop = total[b] - total[lo] - (b == bounds[d + 1])  # no space after the last word
                hashes[d].update(view[total[a] - total[lo] : stop])
            d += 1
        lo = hi
    return hashes


def _scan(plant) -> object:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            yield _scanned(batch, plant)

    return scan


def _scanned(batch: pa.RecordBatch, plant) -> pa.RecordBatch:
    data, cuts = text_bytes(batch.column(1))
    starts, ends, docs = word_spans(data, cuts)
    n_docs, ids = batch.num_rows, batch.column(0)
    bounds = np.searchsorted(docs, np.arange(n_docs + 1))
    order = np.arange(len(starts))
    if plant:
        planted = [plant(i, int(n)) if i is not None and n else (None, 1) for i, n in zip(ids.to_pylist(), np.diff(bounds), strict=True)]
        _as_sequences(order, bounds, *zip(*planted, strict=True))
    size = ends - starts
    black = np.zeros(len(data) + 1, dtype=np.int8)
    black[starts] += 1
    black[ends] -= 1  # words touch only at the bounds of documents, where both cancel out
    inside = np.cumsum(black[:-1], dtype=np.int8).astype(bool)
    offsets = np.concatenate(([0], np.cumsum(size)))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[inside])])
    words = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[order]

    runs: list[list] = [[] for _ in range(n_docs)]
    for lo, hi in zip(*stretches(words, docs), strict=True):
        d = int(docs[lo])
        runs[d] += [(int(lo - bounds[d]) + start, length, q) for start, length, q in _runs_within(words[lo:hi])]
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for d, found in enumerate(runs):
        found.sort(key=lambda r: (r[0], r[2]))
        for start, length, q in found:
            change[bounds[d] + start + q] += 1
            change[bounds[d] + start + length] -= 1
    kept = np.cumsum(change[:-1]) == 0
    kept_bounds = np.concatenate(([0], np.cumsum(kept)))[bounds]
    left = order[kept]
    collapsed = _hash_joined(data, starts[left], ends[left], kept_bounds)

    longest = [min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None) for found in runs]
    columns = [
        ids.to_pylist(),
        np.diff(bounds).tolist(),
        [len(found) for found in runs],
        *[[r[k] for r in longest] for k in range(3)],
        [r[1] * 1000 // r[2] if r[1] else None for r in longest],
        (np.diff(bounds) - np.diff(kept_bounds)).tolist(),
        [sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest() for found in runs],
        [h.hexdigest() for h in collapsed],
    ]
    kinds = [pa.int64()] * 8 + [pa.string()] * 2
    spans = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in found] for found in runs], pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])))
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*arrays, spans], names=[x.split()[0] for x in OUT.split(", ")[:10]] + ["runs"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant=None) -> DataFrame:
    """One row per document: its longest run, the number of its runs, all runs, and digests of the runs and of the text
    without the words that runs repeat (kept words joined by one space).

    ``plant(id, n_words)`` may give (a, p): the document's words from ``a`` on become repetitions of its ``p`` words there.
    """
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan(plant), OUT)


def checksum_plant(doc_id: int, n_words: int) -> tuple[int | None, int]:
    """One document in ten, by the checksum of its id, ends in a repetition of 3 to 10 times."""
    h = crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return None, 1
    a = g % n_words
    return a, 1 + (n_words - a) // (3 + g % 8)


def collapsible(share: float) -> Column:
    """Whether runs repeat more than ``share`` of the words of a row of :func:`periodic_runs`."""
    return F.col("n_dropped") > F.lit(share) * F.col("n_words")
