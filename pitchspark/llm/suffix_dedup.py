"""Removal of repeated byte strings over a whole corpus with run-length indexes.

Every byte that lies in a string of ``LENGTH`` bytes which also starts earlier (smaller id, or earlier in the document) is
removed. One index of the corpus can't be built in pieces that fit tasks, so windows are first brought together: the
least hash of the 32-byte grams of a window (its minimiser) is the same wherever the window occurs. Neighbouring windows
with one minimiser form a piece; equal pieces are found by their hashes, and all but the first are repeats as a whole.
Only pieces that share a minimiser but differ (the edges of repeats) travel as bytes. Tasks take them in blocks and build
a run-length Burrows-Wheeler transform of each block: common prefixes with the neighbour in suffix order are measured at
the run heads alone and streamed from there (inside a run they shrink by one from position to position), which gives the
matching statistics of all windows; those of ``LENGTH`` or more are marked, but for the first in text order.

Minimisers with more than ``HOT`` different pieces are counted exactly beforehand. Their windows are hashed and grouped
by an ordinary aggregation, which splits a group that no task could hold.

Defined cases: null and empty texts, and texts shorter than ``LENGTH`` bytes, lose nothing. Null ids come before all
others. Rows that share an id, or have none, are told apart, and ordered, by a 64-bit hash of their text; rows equal in both
count as one document and get the same result. Whatever is gathered is gathered for an id and mark, that is for one text. Very long texts are read in slices. An empty table gives an empty result. Columns
other than id and text are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitchspark.llm.common import BASE, INVERSE, mix, powers, small, staged, text_batches, text_bytes

LENGTH, GRAM = 100, 32
#: Windows of one piece at most, which is also the number of grams in a window.
SPAN = LENGTH - GRAM + 1
#: Bytes that one pass of hashing takes, bytes within which repeats are combined before the shuffle, and pieces that a
#: task remembers from one such batch to the next.
SLICE_BYTES, COMBINE_BYTES, REMEMBERED = 500_000, 8_000_000, 1 << 18
#: Bytes of one run-length index, and different pieces of one minimiser beyond which its windows are aggregated instead.
BLOCK_BYTES, HOT = 1_000_000, 20_000

_NULL_ID = -(1 << 63)
_ODD = np.uint64(0x9E3779B97F4A7C15)


# --- pieces ------------------------------------------------------------------------------------------------------


def _mark(text: Column, without_id: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")), without_id)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (null: the least number), mark (tells rows with one id apart, and null ids from that number), text."""
    own = F.col(id_col).cast("long")
    return docs.select(F.coalesce(own, F.lit(_NULL_ID)).alias("id"), _mark(F.col(text_col), own.isNull()).alias("mark"), F.col(text_col).alias("text"))


def own_id() -> Column:
    """The id of a row of :func:`keyed` as it was, null or not."""
    without = (F.col("id") == _NULL_ID) & (F.col("mark") == _mark(F.col("text"), F.lit(True)))
    return F.when(~without, F.col("id"))


def _sliding(values: np.ndarray, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of every ``SPAN`` neighbouring values."""
    out, span = values, 1
    while 2 * span <= SPAN:
        out = best(out[:-span], out[span:])
        span *= 2
    return best(out[: len(out) - (SPAN - span)], out[SPAN - span :]) if span < SPAN else out


def slice_pieces(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Minimiser, content hash, first and number of windows of the pieces in ``data``, and whether a piece has its
    minimiser more than once (only then a window can recur in it). ``ends``: end of each window's text."""
    n = len(data)
    if n < LENGTH:
        none = np.empty(0, dtype=np.int64)
        return none, none, none, none, none.astype(bool)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=sums[1:])
    back = powers(INVERSE, n)
    grams = mix((sums[GRAM:] - sums[: n - GRAM + 1]) * back[: n - GRAM + 1])
    least = _sliding(grams, np.minimum)
    ends = ends[: len(least)]
    valid = np.arange(len(least)) + LENGTH <= ends
    same = (least[1:] == least[:-1]) & valid[1:] & valid[:-1]
    first = valid.copy()
    first[1:] &= ~same
    last = valid.copy()
    last[:-1] &= ~same
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    parts = -(-(stops - starts) // SPAN)
    if len(parts) and parts.max() > 1:  # periodic text repeats its minimiser: cut
        number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, stops = np.repeat(starts, parts) + number * SPAN, np.repeat(stops, parts)
        stops = np.minimum(stops, starts + SPAN)
    wins = stops - starts
    content = mix((sums[stops + LENGTH - 1] - sums[starts]) * back[starts] + wins.astype(np.uint64) * _ODD)
    # grams that are the least of some window, and how often each piece has its own
    edge = np.zeros(SPAN - 1, dtype=np.uint64)
    spots = np.flatnonzero(grams == _sliding(np.concatenate([edge, least, edge]), np.maximum))
    low, high = np.searchsorted(spots, starts), np.searchsorted(spots, stops + SPAN - 1)
    count = high - low
    owner = np.repeat(np.arange(len(starts)), count)
    near = spots[np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + low[owner]]
    inner = np.bincount(owner[grams[near] == least[starts][owner]], minlength=len(starts)) > 1
    return least[starts].view(np.int64), content.view(np.int64), starts, wins, inner


def _joined(doc: np.ndarray, start: np.ndarray, wins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first of each run of touching ranges, in (doc, start) order, and the windows of the whole run."""
    if not len(doc):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + wins[:-1])
    at = np.flatnonzero(new)
    return at, np.add.reduceat(wins, at)


_PIECE = ["route", "mini", "content", "id", "mark", "start", "wins", "fresh", "inner"]
_PIECE_TYPES = "route long, mini long, content long, id long, mark long, start int, wins int, fresh boolean, inner boolean"


class _Firsts:
    """Where the frequent pieces of a task's earlier batches start first, so that a passage that is everywhere sends one
    fresh piece a task to its minimiser and not one a batch. What is forgotten is fresh again and told apart later."""

    def __init__(self) -> None:
        self.keys, self.spots = np.empty(0, np.uint64), [np.empty(0, np.int64)] * 3

    def repeats(self, keys: np.ndarray, spots: list[np.ndarray], frequent: np.ndarray) -> np.ndarray:
        """Which pieces (distinct keys in order, with id, mark and start) stand later than a remembered one; those that
        are frequent here, or were remembered, are remembered with their first place."""
        at = np.searchsorted(self.keys, keys)
        hit = at < len(self.keys)
        hit[hit] = self.keys[at[hit]] == keys[hit]
        (a, x), (b, y), (c, z) = ((old[at[hit]], new[hit]) for old, new in zip(self.spots, spots))
        later = np.zeros(len(keys), bool)
        later[hit] = (a < x) | ((a == x) & ((b < y) | ((b == y) & (c < z))))
        firsts = [new.copy() for new in spots]
        for first, old in zip(firsts, self.spots):
            first[later] = old[at[later]]
        stay = hit | frequent
        other = np.ones(len(self.keys), bool)
        other[at[hit]] = False
        if other.sum() + stay.sum() > REMEMBERED:
            other[:] = False
        keys = np.concatenate([self.keys[other], keys[stay]])
        order = np.argsort(keys)[:REMEMBERED]
        self.keys = keys[order]
        self.spots = [np.concatenate([old[other], first[stay]])[order] for old, first in zip(self.spots, firsts)]
        return later


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch's pieces. Those that repeat one of the same batch, or a frequent one of an earlier batch of the task, leave
    as ranges, routed by document; the others are fresh and routed by minimiser."""
    firsts = _Firsts()
    for batch in text_batches(batches, 2, COMBINE_BYTES):
        data, bounds = text_bytes(batch.column(2))
        ids, marks = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        found = []
        for lo in range(0, len(data), SLICE_BYTES):
            hi = min(len(data), lo + SLICE_BYTES)
            some = data[lo : min(len(data), hi + LENGTH - 1)]
            docs = np.searchsorted(bounds, np.arange(lo, hi), side="right") - 1
            mini, content, starts, wins, inner = slice_pieces(some, bounds[docs + 1] - lo)
            doc = docs[starts]
            found.append((mini, content, doc, starts + lo - bounds[doc], wins, inner))
        if not found:
            continue
        mini, content, doc, start, wins, inner = (np.concatenate(x) for x in zip(*found))
        turn = np.empty(len(ids), dtype=np.int64)
        turn[np.lexsort((marks, ids))] = np.arange(len(ids))
        key = mix(mini.view(np.uint64) ^ (content.view(np.uint64) * _ODD))
        order = np.lexsort(((turn[doc] << 32) | start, key))
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = key[order[1:]] != key[order[:-1]]
        first = order[np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))]
        same = (ids[doc[first]] == ids[doc[order]]) & (marks[doc[first]] == marks[doc[order]]) & (start[first] == start[order])
        one = order[fresh]
        count = np.diff(np.append(np.flatnonzero(fresh), len(key)))
        later = firsts.repeats(key[one], [ids[doc[one]], marks[doc[one]], start[one].astype(np.int64)], count > 1)
        # a repeated row repeats nothing but itself
        old, new = np.sort(np.concatenate([order[~fresh & ~same], one[later]])), np.sort(one[~later])
        at, length = _joined(doc[old], start[old], wins[old])
        old = old[at]
        zero = np.zeros(len(old), np.int64)
        columns = [
            np.concatenate([mix(ids[doc[old]].view(np.uint64)).view(np.int64), mini[new]]),
            np.concatenate([zero, mini[new]]),
            np.concatenate([zero, content[new]]),
            ids[doc[np.concatenate([old, new])]],
            marks[doc[np.concatenate([old, new])]],
            np.concatenate([start[old], start[new]]).astype(np.int32),
            np.concatenate([length, wins[new]]).astype(np.int32),
            np.concatenate([np.zeros(len(old), bool), np.ones(len(new), bool)]),
            np.concatenate([np.zeros(len(old), bool), inner[new]]),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], _PIECE)


_FOUND = ["mini", "id", "mark", "start", "wins", "edge"]
_FOUND_TYPES = "mini long, id long, mark long, start int, wins int, edge boolean"


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (fresh, mini, content, id, mark, start): repeats of a piece, and pieces for the index (edge), which
    share their minimiser with different ones or have it twice. One row is kept back from batch to batch: the first piece of a minimiser that may get no second."""
    last: tuple | None = None  # mini, content, whether edge rows were seen; id, mark and start of the piece's first row
    held: list | None = None  # the row kept back

    for batch in batches:
        if not batch.num_rows:
            continue
        _, mini, content, ids, marks, start, wins, fresh, inner = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        old = np.flatnonzero(~fresh)
        new = np.flatnonzero(fresh)
        rows = [np.zeros(len(old), np.int64), ids[old], marks[old], start[old], wins[old], np.zeros(len(old), bool)]
        if len(new):
            m, c = mini[new], content[new]
            group, piece = np.ones(len(m), bool), np.ones(len(m), bool)
            group[1:] = m[1:] != m[:-1]
            piece[1:] = group[1:] | (c[1:] != c[:-1])
            goes_on = last is not None and last[0] == m[0]
            if goes_on:
                group[0] = False
                piece[0] = c[0] != last[1]
            number = np.cumsum(group) - (0 if goes_on else 1)  # 0 is the first group here, new or not
            count = np.bincount(number[piece], minlength=number[-1] + 1)
            many = count > 1
            if goes_on:
                many[0] = last[2] or count[0] > 0
            edge = piece & (many[number] | inner[new])
            spot = [x[new] for x in (ids, marks, start)]
            begin = np.maximum.accumulate(np.where(piece, np.arange(len(m)), -1))
            itself = np.logical_and.reduce([np.where(begin < 0, old_at, x[begin]) == x for x, old_at in zip(spot, last[3] if last else (0, 0, 0))])
            keep = edge | ~(piece | itself)
            out = new[keep]
            rows = [
                np.concatenate([a, b])
                for a, b in zip(rows, [mini[out], ids[out], marks[out], start[out], wins[out], edge[keep]])
            ]
            if held is not None and goes_on and many[0]:
                rows = [np.concatenate([a, np.asarray([b], a.dtype)]) for a, b in zip(rows, held)]
                held = None
            if number[-1] > 0 or not goes_on:
                held = None
                ending = number == number[-1]
                if not many[-1]:
                    k = new[np.flatnonzero(ending & piece)[0]]
                    held = None if inner[k] else [mini[k], ids[k], marks[k], start[k], wins[k], True]
            at = tuple(x[begin[-1]] for x in spot) if begin[-1] >= 0 else last[3]
            last = (m[-1], c[-1], bool(many[-1]), at)
        if len(rows[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], _FOUND)


# --- the run-length index of a block -----------------------------------------------------------------------------


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Of symbols below 512, by prefix doubling from words of seven symbols."""
    n = len(text)
    padded = np.zeros(n + 7, dtype=np.uint64)
    padded[:n] = text
    word = np.zeros(n, dtype=np.uint64)
    for k in range(7):
        word = (word << np.uint64(9)) | padded[k : n + k]
    depth = 7
    while True:
        order = np.argsort(word, kind="stable")
        ordered = word[order]
        new = np.ones(n, dtype=bool)
        new[1:] = ordered[1:] != ordered[:-1]
        if new.all() or depth >= n:
            return order
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = np.cumsum(new).astype(np.uint64)
        word = rank << np.uint64(32)
        word[: n - depth] |= rank[depth:]
        depth *= 2


def run_index(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix order, heads of the runs of the Burrows-Wheeler transform (places in that order), and the length of the
    common prefix at each head with the suffix before it."""
    order = suffix_array(text)
    before = text[order - 1]
    heads = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
    n = len(text)
    padded = np.concatenate([text.astype(np.int16), np.full(64, -1, np.int16)])
    here, there = order[heads], order[np.maximum(heads - 1, 0)]
    length = np.zeros(len(heads), dtype=np.int64)
    live = np.flatnonzero(heads > 0)
    width = 8
    while len(live):
        a, b = here[live] + length[live], there[live] + length[live]
        inside = np.maximum(a, b) < n
        span = np.arange(width)
        equal = padded[np.minimum(a, n)[:, None] + span] == padded[np.minimum(b, n)[:, None] + span]
        equal &= (np.maximum(a, b)[:, None] + span) < n
        step = np.where(equal.all(axis=1), width, equal.argmin(axis=1))
        length[live] += np.where(inside, step, 0)
        live = live[inside & (step == width)]
        width = min(2 * width, 64)
    return order, heads, length


def matching_lengths(order: np.ndarray, heads: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Common prefix of every suffix with the one before it in suffix order, streamed through the text from the samples.

    The text's last symbol is one of its kind, so text position 0 is always a head.
    """
    n = len(order)
    known = np.full(n, -1, dtype=np.int64)
    known[order[heads]] = length
    at = np.maximum.accumulate(np.where(known >= 0, np.arange(n), -1))
    return np.maximum(known[at] - (np.arange(n) - at), 0)


def repeated_windows(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(body, first window, windows) of the ranges of windows that an earlier body, or the same earlier, has too."""
    sizes = np.array([len(b) for b in bodies], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.zeros(begins[-1] + 1, dtype=np.int16)  # a separator after each body, and the end, which is less than all
    for a, body in zip(begins.tolist(), bodies):
        text[a : a + len(body)] = np.frombuffer(body, dtype=np.uint8).astype(np.int16) + 2
        text[a + len(body)] = 1
    text[-1] = 0
    order, heads, length = run_index(text)
    prefix = matching_lengths(order, heads, length)[order]
    left = np.zeros(len(text), dtype=np.int64)  # bytes from a position to the end of its body
    for a, size in zip(begins.tolist(), sizes.tolist()):
        left[a : a + size] = np.arange(size, 0, -1)
    # suffixes whose matching statistic reaches LENGTH stand together; the first in the text stays
    group = np.cumsum(prefix < LENGTH) - 1
    edges = np.flatnonzero(prefix < LENGTH)
    least = np.minimum.reduceat(order, edges)
    again = (left[order] >= LENGTH) & (order != least[group])
    at = np.sort(order[again])
    owner = np.searchsorted(begins, at, side="right") - 1
    start, run = _joined(owner, at, np.ones(len(at), np.int64))
    return owner[start], at[start] - begins[owner[start]], run


_BODY_TYPES = "mini long, id long, mark long, start int, wins int, body binary"
_RANGE = ["id", "mark", "start", "wins"]
_RANGE_TYPES = "id long, mark long, start int, wins int"


def _index_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (mini, id, mark, start): blocks of whole minimisers, each with its index. Pieces equal in all four
    come from a repeated row and count once."""
    rows: list[tuple] = []
    held = 0

    def ranges() -> pa.RecordBatch:
        body, first, wins = repeated_windows([r[5] for r in rows])
        owner = [rows[k] for k in body.tolist()]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[1] for r in owner], pa.int64()),
                pa.array([r[2] for r in owner], pa.int64()),
                pa.array([r[3] + f for r, f in zip(owner, first.tolist())], pa.int32()),
                pa.array(wins, pa.int32()),
            ],
            _RANGE,
        )

    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(6))):
            if held >= BLOCK_BYTES and row[0] != rows[-1][0]:
                yield ranges()
                rows, held = [], 0
            if rows and row[:4] == rows[-1][:4]:
                continue
            rows.append(row)
            held += len(row[5])
    if rows:
        yield ranges()


# --- the operator ------------------------------------------------------------------------------------------------


def _wanted(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(minimiser, id, mark, start, windows, bytes) of the wanted pieces of a batch of id, mark, text, wanted."""
    data, bounds = text_bytes(batch.column(2))
    for k, (i, mark, wanted) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)))):
        for w in wanted:
            a = int(bounds[k]) + w["start"]
            yield w["mini"], i, mark, w["start"], w["wins"], data[a : a + w["wins"] + LENGTH - 1].tobytes()


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    for batch in text_batches(batches, 2):
        rows = list(_wanted(batch))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["mini", "id", "mark", "start", "wins", "body"]
        )


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of the wanted pieces with its hash."""
    for batch in text_batches(batches, 2):
        rows = [
            (mini, int.from_bytes(hashlib.blake2b(body[k : k + LENGTH], digest_size=8).digest(), "little", signed=True), i, mark, start + k)
            for mini, i, mark, start, wins, body in _wanted(batch)
            for k in range(wins)
        ]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["mini", "window", "id", "mark", "start"])


def _spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges; touching ones become one."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), dtype=bool)
    new[1:] = starts[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return starts[at], reach[np.concatenate([at[1:] - 1, [len(reach) - 1]])]


def _lists(column: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bounds of each row's entries, and the fields (start, wins) of all entries one after another."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    fields = [x.to_numpy(zero_copy_only=False) for x in column.flatten().flatten()]
    return np.concatenate([[0], np.cumsum(lengths)]), fields


def _remaining(body: np.ndarray, start: np.ndarray, wins: np.ndarray) -> tuple[bytes, int]:
    """The bytes outside the windows' ranges, and the number of removed runs."""
    if not len(start):
        return body.tobytes(), 0
    starts = start.astype(np.int64)
    starts, ends = _spans(starts, starts + wins + LENGTH - 1)
    edges = [0, *np.stack([starts, ends], axis=1).ravel().tolist(), len(body)]
    return b"".join(body[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2])), len(starts)


def _cut(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            data, bounds = text_bytes(batch.column(1))
            total, gone, count, digests, texts = [], [], [], [], []
            edges, fields = _lists(batch.column(2))
            for k, (a, b, lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), edges[:-1].tolist(), edges[1:].tolist())):
                left, spans = _remaining(data[a:b], *[x[lo:hi] for x in fields])
                total.append(b - a)
                gone.append(b - a - len(left))
                count.append(spans)
                digests.append(hashlib.sha256(left).hexdigest())
                texts.append(left.decode("utf-8", "ignore") if keep_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(digests), pa.array(texts, pa.string())],
                ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"],
            )

    return run


def repeated_ranges(rows: DataFrame) -> DataFrame:
    """``rows`` (id, mark, text) -> id, mark, start, wins: ranges of windows that also start earlier; ranges don't overlap."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["fresh", "mini", "content", "id", "mark", "start"]
    found = staged(
        rows.mapInArrow(_pieces, _PIECE_TYPES)
        .repartition(tasks, "route")
        .sortWithinPartitions(*order)
        .mapInArrow(_resolve, _FOUND_TYPES),
        "suffix-found",
    )
    edges = found.where("edge")
    hot, _ = small(staged(edges.groupBy("mini").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("mini"), "suffix-hot"))
    # not staged: within one query the shuffle of the texts is made once for all that reads it
    spots = lambda some: some.groupBy("id", "mark").agg(F.collect_list(F.struct("mini", "start", "wins")).alias("wanted"))
    texts = lambda wanted: rows.join(wanted, ["id", "mark"]).select("id", "mark", "text", "wanted")
    usual = texts(spots(edges.join(hot, "mini", "left_anti"))).mapInArrow(_bodies, _BODY_TYPES)
    ranges = usual.repartition(tasks, "mini").sortWithinPartitions("mini", "id", "mark", "start").mapInArrow(_index_blocks, _RANGE_TYPES)
    if not hot.isEmpty():
        windows = texts(spots(edges.join(hot, "mini", "left_semi"))).mapInArrow(_window_rows, "mini long, window long, id long, mark long, start int")
        at = F.struct("id", "mark", "start")
        first = windows.groupBy("mini", "window").agg(F.min(at).alias("first"))
        later = windows.join(first, ["mini", "window"]).where(at != F.col("first")).select("id", "mark", "start")
        # neighbouring windows of a document become one range
        place = F.col("start") - F.row_number().over(Window.partitionBy("id", "mark").orderBy("start"))
        runs = later.distinct().withColumn("_run", place).groupBy("id", "mark", "_run")
        ranges = ranges.unionByName(runs.agg(F.min("start").alias("start"), F.count("*").cast("int").alias("wins")).select(*_RANGE))
    return found.where("NOT edge").select(*_RANGE).unionByName(ranges)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256; with ``keep_text`` also kept_text.

    ``kept_text`` is what stays, without the bytes of characters that a cut went through.
    """
    rows = keyed(docs, id_col, text_col)
    ranges = repeated_ranges(rows).groupBy("id", "mark").agg(F.collect_list(F.struct("start", "wins")).alias("ranges"))
    # the same columns as in repeated_ranges, so that the texts are shuffled once for both
    cut = rows.join(ranges, ["id", "mark"], "left").select(own_id().alias("own_id"), "text", "ranges").mapInArrow(
        _cut(keep_text), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    )
    return cut.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * keep_text)


def cut_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs``, all columns, with repeats cut out of the text; ``length_col``, if there, counts the characters that stay.

    Texts that lose nothing stay as they are, null ones too. Columns may have any names.
    """
    at = docs.columns.index(text_col)
    ranges = repeated_ranges(keyed(docs, id_col, text_col)).groupBy("id", "mark").agg(F.collect_list(F.struct("start", "wins")).alias("__ranges"))
    ranges = ranges.select(F.col("id").alias("__range_id"), F.col("mark").alias("__range_mark"), "__ranges")
    own = docs[id_col].cast("long")
    mark = _mark(docs[text_col], own.isNull())
    same = (F.coalesce(own, F.lit(_NULL_ID)) == ranges["__range_id"]) & (mark == ranges["__range_mark"])
    joined = docs.join(ranges, same, "left").drop("__range_id", "__range_mark")
    n = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, column=at):
            column = batch.column(at)
            edges, fields = _lists(batch.column(n))
            data, bounds = text_bytes(column)
            texts = [None] * len(batch)
            for k in np.flatnonzero(np.diff(edges)).tolist():
                left, _ = _remaining(data[bounds[k] : bounds[k + 1]], *[x[edges[k] : edges[k + 1]] for x in fields])
                texts[k] = left.decode("utf-8", "ignore")
            columns = list(batch.columns[:n])
            columns[at] = pa.array([x.as_py() if t is None else t for x, t in zip(column, texts)], column.type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([batch.schema.field(k) for k in range(n)]))

    out = joined.mapInArrow(run, docs.schema)
    if length_col in docs.columns:
        size = F.when(F.col(text_col).isNotNull(), F.char_length(text_col)).cast(docs.schema[length_col].dataType)
        out = out.withColumn(length_col, F.coalesce(size, F.col(length_col)))
    return out
