"""Document fingerprints: a Merkle tree over paragraphs and sections, so that roots test equality and branches that differ
locate edits.

Paragraphs are lines; a section ends before a heading, at a blank line, or after a paragraph whose digest says so (one in
four), so that an edit changes the sections near it alone. A paragraph's digest is of its text, a section's of its
paragraphs' digests, the root's of its sections' digests (BLAKE2b of 16 bytes). Below the paragraphs stand pieces of about
``PIECE`` bytes, cut where the bytes around say so; they only serve to locate edits within a paragraph and to weigh how
much two texts share, so their digests are short.

A fingerprint is one string: the root in hex, a colon, and the tree in base64. Likeness and the places of edits are found
from two fingerprints alone, without the texts; the root alone (:func:`root`) joins equal texts.

Defined cases: null counts as empty, and the empty text has a tree of no paragraphs; a line end belongs to the paragraph
before it; ids may repeat or be null (null ids come first in order, equal ids by text); an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitchspark.llm.common import BASE, bounded_batches, powers, small, staged, text_batches

#: Mean bytes of a piece (a power of two), bytes between two chosen cuts at least, and of a piece at most; one paragraph in
#: so many ends a section.
PIECE, APART, LONGEST, SECTION = 32, 8, 4096, 4
#: Bytes that decide on a cut.
AROUND = 8
_MIXED = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(29)).astype(np.uint32)
_STEP = 0x85EBCA6B
#: Powers of an odd number; a piece's digest is of the sum of its bytes times these.
_POWERS = powers(BASE, LONGEST)
_NODE = np.dtype([("digest", "<u8"), ("size", "<u4")])
_LEAF = np.dtype([("digest", "<u4"), ("chars", "<u2")])
#: Parts of the order for each partition of a shuffle.
PARTS = 4


class Tree:
    """Sections (digest, paragraphs), paragraphs (digest, pieces) and pieces (digest, code points) of one text."""

    def __init__(self, root: bytes, sections: np.ndarray, paragraphs: np.ndarray, pieces: np.ndarray) -> None:
        self.root, self.sections, self.paragraphs, self.pieces = root, sections, paragraphs, pieces
        self._bag: Counter | None = None

    @property
    def bag(self) -> Counter:
        """How often each piece stands in the text; a piece's code points are the last 16 bits of its key."""
        if self._bag is None:
            self._bag = Counter((self.pieces["digest"].astype(np.int64) << 16 | self.pieces["chars"]).tolist())
        return self._bag

    def __str__(self) -> str:
        head = np.array([len(self.sections), len(self.paragraphs)], dtype="<u4").tobytes()
        body = head + self.sections.tobytes() + self.paragraphs.tobytes() + self.pieces.tobytes()
        return f"{self.root.hex()}:{base64.b64encode(body).decode()}"


def parse(fingerprint: str) -> Tree:
    """The tree that a fingerprint holds."""
    root, _, body = fingerprint.partition(":")
    data = base64.b64decode(body)
    n, m = np.frombuffer(data, "<u4", 2).tolist()
    at = 8 + _NODE.itemsize * n
    end = at + _NODE.itemsize * m
    return Tree(bytes.fromhex(root), np.frombuffer(data[8:at], _NODE), np.frombuffer(data[at:end], _NODE), np.frombuffer(data[end:], _LEAF))


def _piece_ends(data: np.ndarray, lines: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Ends of pieces: the ends of lines, and before them places that ``AROUND`` bytes of the same text choose."""
    h, shift, factor = _MIXED[data], 1, _STEP
    while shift < AROUND:  # h[i]: of the bytes up to i, AROUND at most
        h[shift:] += h[:-shift] * np.uint32(factor)
        factor, shift = factor * factor & 0xFFFFFFFF, shift * 2
    chosen = np.flatnonzero(h >> np.uint32(32 - PIECE.bit_length() + 1) == 0) + 1
    chosen = chosen[chosen < len(data)]
    own = texts[np.searchsorted(texts, chosen, side="right") - 1]  # where the text begins
    chosen, own = chosen[(inside := chosen - own >= AROUND)], own[inside]
    if len(chosen):
        chosen = chosen[np.append(True, (np.diff(chosen) >= APART) | (np.diff(own) > 0))]
    ends = np.union1d(chosen, lines)
    long = np.flatnonzero(np.diff(np.concatenate(([0], ends))) > LONGEST - 4)
    if len(long):
        starts = np.concatenate(([0], ends))[long]
        ends = np.union1d(ends, np.concatenate([np.arange(a + LONGEST - 4, b, LONGEST - 4) for a, b in zip(starts, ends[long], strict=True)]))
    for _ in range(3):  # never within a character: such a cut moves back to its start
        within = (ends < len(data)) & ((data[np.minimum(ends, len(data) - 1)] & 0xC0) == 0x80)
        if not within.any():
            break
        ends = np.unique(ends - within)
    return ends


def tree(text: str) -> Tree:
    """The Merkle tree of a text."""
    return trees([text])[0]


def trees(texts: list[str]) -> list[Tree]:
    """The Merkle tree of each text; a text's tree is the same whichever texts stand beside it."""
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = b"".join(coded)
    data = np.frombuffer(raw, dtype=np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in coded], dtype=np.int64)))
    empty = Tree(blake2b(b"", digest_size=16).digest(), np.empty(0, _NODE), np.empty(0, _NODE), np.empty(0, _LEAF))
    if not len(data):
        return [empty] * len(texts)
    begin = np.unique(bounds[:-1][bounds[:-1] < len(data)])
    lines = np.union1d(np.flatnonzero(data == 10) + 1, np.append(begin[1:], len(data)))
    ends = _piece_ends(data, lines, begin)
    starts = np.concatenate(([0], ends[:-1]))

    code = data.astype(np.uint64) + np.uint64(1)
    code *= _POWERS[np.arange(len(data)) - np.repeat(starts, ends - starts)]
    pieces = np.empty(len(ends), dtype=_LEAF)
    pieces["digest"] = np.add.reduceat(code, starts) * np.uint64(0x94D049BB133111EB) >> np.uint64(32)
    pieces["chars"] = np.add.reduceat((data & 0xC0) != 0x80, starts, dtype=np.int64)
    paragraphs = np.empty(len(lines), dtype=_NODE)
    paragraphs["size"] = np.diff(np.concatenate(([0], np.searchsorted(ends, lines, side="right"))))

    out, digests, view, lo = [], [], memoryview(raw), 0
    line_bounds, piece_bounds = (np.searchsorted(x, bounds, side="right").tolist() for x in (lines, ends))
    stops = lines.tolist()
    for t, whole_text in enumerate(coded):
        if not whole_text:
            out.append(empty)
            continue
        first, last = line_bounds[t : t + 2]
        sections, held = [], []
        for hi in stops[first:last]:
            line = view[lo:hi]
            if held and line[0] == 35:  # "#": a heading
                sections.append(held)
                held = []
            own = blake2b(line, digest_size=16).digest()
            held.append(own)
            digests.append(own[:8])
            if own[15] % SECTION == 0 or (hi - lo < 80 and not bytes(line).strip()):
                sections.append(held)
                held = []
            lo = hi
        if held:
            sections.append(held)
        nodes = [blake2b(b"".join(members), digest_size=16).digest() for members in sections]
        level = np.empty(len(nodes), dtype=_NODE)
        level["digest"], level["size"] = np.frombuffer(b"".join(x[:8] for x in nodes), "<u8"), [len(x) for x in sections]
        out.append(Tree(blake2b(b"".join(nodes), digest_size=16).digest(), level, paragraphs[first:last], pieces[piece_bounds[t] : piece_bounds[t + 1]]))
    paragraphs["digest"] = np.frombuffer(b"".join(digests), "<u8")
    return out


def likeness(a: Tree, b: Tree) -> float:
    """Twice the code points of pieces that both trees have over the code points of both; 1 for equal roots alone."""
    if a.root == b.root:
        return 1.0
    total = int(a.pieces["chars"].sum(dtype=np.int64)) + int(b.pieces["chars"].sum(dtype=np.int64))
    less, more = sorted((a.bag, b.bag), key=len)
    shared = sum(min(n, more[x]) * (x & 0xFFFF) for x, n in less.items() if x in more)
    return min(2 * shared / total, 1 - 1e-9)


def _common(a: list, b: list) -> list[tuple[int, int]]:
    """Places of nodes that stand in both lists in order: equal ends first, then nodes that occur once in each between."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    out, i, j = [(k, k) for k in range(lo)], len(a), len(b)
    tail = []
    while i > lo and j > lo and a[i - 1] == b[j - 1]:
        i, j = i - 1, j - 1
        tail.append((i, j))
    once_a, once_b = Counter(a[lo:i]), Counter(b[lo:j])
    where = {x: k for k, x in enumerate(b[lo:j], lo) if once_b[x] == 1}
    last = -1
    for k in range(lo, i):
        at = where.get(a[k], -1) if once_a[a[k]] == 1 else -1
        if at > last:
            out.append((k, at))
            last = at
    return out + tail[::-1]


def edits(a: Tree, b: Tree) -> list[tuple[int, int, int, int]]:
    """Ranges of code points (start and end in ``a``, start and end in ``b``) that differ, descending only into branches
    that do; each is as long as the pieces it cuts."""
    if a.root == b.root:
        return []

    def level(t: Tree) -> list[tuple[list, np.ndarray]]:
        """Digests of sections, paragraphs and pieces, and the bounds of each one's children."""
        cut = lambda sizes: np.concatenate(([0], np.cumsum(sizes.astype(np.int64))))
        return [(t.sections["digest"].tolist(), cut(t.sections["size"])), (t.paragraphs["digest"].tolist(), cut(t.paragraphs["size"])), (t.pieces.tolist(), cut(t.pieces["chars"]))]

    left, right, out = level(a), level(b), []

    def descend(depth: int, i0: int, i1: int, j0: int, j1: int) -> None:
        if depth == 3:
            if (i0, j0) != (i1, j1):
                out.append((i0, i1, j0, j1))
            return
        (names, bounds), (others, other_bounds) = left[depth], right[depth]
        i, j = i0, j0
        for x, y in [*((p + i0, q + j0) for p, q in _common(names[i0:i1], others[j0:j1])), (i1, j1)]:
            if x > i or y > j:
                descend(depth + 1, int(bounds[i]), int(bounds[x]), int(other_bounds[j]), int(other_bounds[y]))
            i, j = x + 1, y + 1

    descend(0, 0, len(a.sections), 0, len(b.sections))
    return out


# --- columns -----------------------------------------------------------------------------------------------------


def root(fingerprint: Column) -> Column:
    """The root of a fingerprint, equal for equal texts alone."""
    return F.substring_index(fingerprint, ":", 1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars and fingerprint of every row; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([str(t) for t in trees(texts)], pa.string())], names=["id", "n_chars", "fingerprint"])

    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, f"id {kind}, n_chars long, fingerprint string")
    return out.withColumnRenamed("id", id_col)


def compared(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``pairs`` with likeness and edits (ranges of code points that differ) of two columns of fingerprints; null with null."""
    kind = "struct<likeness: double, edits: array<struct<a_start: long, a_end: long, b_start: long, b_end: long>>>"

    @F.udf(returnType=kind, useArrow=True)
    def compare(a, b):
        if a is None or b is None:
            return None
        a, b = parse(a), parse(b)
        return {"likeness": likeness(a, b), "edits": [dict(zip(("a_start", "a_end", "b_start", "b_end"), x, strict=True)) for x in edits(a, b)]}

    return pairs.withColumn("__found", compare(F.col(left), F.col(right))).select(*pairs.columns, "__found.likeness", "__found.edits")


# --- every document against its edited self and the next document ------------------------------------------------

_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, copies long"
_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")]]
    + [("near_edited", pa.float64()), ("near_next", pa.float64()), ("copies", pa.int64())]
)


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many code points from the start of ``following`` (or all it has)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(pairs: list[tuple]) -> pa.RecordBatch:
    """Rows of (id, text, tree, following text, following tree, copies)."""
    made = [edited(text, following) for _, text, _, following, _, _ in pairs]
    rows = [
        (doc_id, len(text), sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), str(own), str(changed), likeness(own, changed), likeness(own, other), copies)
        for (doc_id, text, own, _, other, copies), new, changed in zip(pairs, made, trees(made), strict=True)
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts in order, each row with the one after it; a part ends with the next part's first row, which has no part of
    its own to compare in. A row that stands for several equal ones is followed by itself but for the last of them."""
    before = None
    for batch in text_batches(batches):
        ids, texts, parts, closing, copies = (batch.column(k).to_pylist() for k in range(5))
        pairs = []
        for doc_id, text, own, part, last, n in zip(ids, texts, trees(texts), parts, closing, copies, strict=True):
            if before is not None and before[0] == part:
                _, b_id, b_text, b_tree, b_copies = before
                pairs.append((b_id, b_text, b_tree, text, own, 1))
                if b_copies > 1:
                    pairs.append((b_id, b_text, b_tree, b_text, b_tree, b_copies - 1))
            before = None if last else (part, doc_id, text, own, n)
        if pairs:
            yield _compared(pairs)


def _place(keys: DataFrame, parts: int) -> Column:
    """The part of the order that a row's (key, h) falls into, ascending; ``keys`` are all of them.

    Parts are cut at quantiles of the keys. A key at several quantiles has as many parts, by h.
    """
    found = keys.agg(F.percentile_approx("key", [(i + 1) / parts for i in range(parts - 1)], 20 * parts).alias("q")).first()["q"] or []
    times = sorted(Counter(found).items())  # as many numbers as parts, whatever the table
    cuts = F.array(*[F.lit(x) for x, _ in times]).cast("array<bigint>")
    step = max(1, int(len(times) ** 0.5))
    coarse = F.array(*[F.lit(x) for x, _ in times[step - 1 :: step]]).cast("array<bigint>")
    key = F.col("key")
    passed = F.size(F.filter(coarse, lambda x: x <= key)) * step
    bucket = (passed + F.size(F.filter(F.slice(cuts, passed + 1, F.lit(step)), lambda x: x <= key))).cast("long")
    hot = [(x, n) for x, n in times if n > 1]
    sub = F.lit(0)
    if hot:
        several = F.create_map(*[F.lit(v).cast("long") for pair in hot for v in pair])[key]
        sub = F.coalesce(F.least(F.floor((F.col("h") / 2.0**64 + 0.5) * several), several - 1), F.lit(max(n for _, n in hot)))
    return (bucket * (parts + 1) + sub).cast("long")


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: fingerprint, that of its edited text (see :func:`edited`; the following text is that of the
    next id, the first's after the last), and how like its own are that fingerprint and the next document's.

    Texts are exchanged once, into parts of the order; each part gets the next part's first row with it. Rows that share id
    and text go as one row with a count.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("key"), F.xxhash64(text).alias("h"))
    keys = staged(rows.select("key", "h"), "merkle-keys")
    place = _place(keys, PARTS * int(spark.conf.get("spark.sql.shuffle.partitions")))

    rows = rows.withColumn("copies", F.lit(1).cast("long"))
    several = staged(keys.groupBy("key", "h").agg(F.count("*").alias("n")).where("n > 1").select("key", "h"), "merkle-repeated")
    if not several.isEmpty():
        several, _ = small(several)
        again = rows.join(several, ["key", "h"], "left_semi").groupBy("id", "text", "key", "h").agg(F.count("*").alias("copies"))
        rows = rows.join(several, ["key", "h"], "left_anti").unionByName(again)

    # the first row of each part, given to the part before it; the first part's goes to the last
    firsts = keys.groupBy(place.alias("part")).agg(F.min(F.struct("key", "h")).alias("first"))
    order = Window.partitionBy(F.lit(0)).orderBy("part")  # one narrow row for each part
    given = firsts.select(F.coalesce(F.lag("part").over(order), F.max("part").over(Window.partitionBy(F.lit(0)))).alias("part"), "first.key", "first.h")
    given, _ = small(staged(given, "merkle-firsts"))
    closing = rows.join(given, ["key", "h"]).dropDuplicates(["part"]).select("id", "text", "part", "key", "h", F.lit(1).alias("closing"), "copies")
    dealt = rows.select("id", "text", place.alias("part"), "key", "h", F.lit(0).alias("closing"), "copies").unionByName(closing)
    dealt = dealt.repartition("part").sortWithinPartitions("part", "closing", "key", "h").select("id", "text", "part", F.expr("closing = 1").alias("closing"), "copies")
    found = dealt.mapInArrow(_neighbours, _OUT)
    many = F.explode(F.expr("sequence(1L, copies)"))
    out = found.select("*", many.alias("__copy")).drop("copies", "__copy")
    return out.withColumnRenamed("doc_id", id_col)
