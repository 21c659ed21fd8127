"""Near-duplicate groups: fast similarity sketches, banding, exact verification on full sets, connected components.

A document's set holds its distinct shingles of five words (lower-cased A-Z). Equal sets are one node from the start. A
sketch has ``COORDINATES`` coordinates filled in rounds: in round i every shingle is thrown into the bin that its i-th
hash names, with the value i + hash; the second half of the rounds names the bins itself, so every bin fills, and later
rounds never lower a filled bin. Coordinates agree with the probability of the Jaccard similarity and concentrate as
independent ones do. Bands of ``ROWS`` coordinates make buckets; at similarity 0.75 all bands miss with probability
(1 - 0.75**4)**32, about 5 in a million.

The smallest node of a bucket is its pivot, and the nodes that share a pivot are one candidate group, which covers every
pair of every bucket. Full sets travel once to each group of a node, and groups are compared inside tasks, in blocks of
bounded size; only edges that join parts leave a task. Groups of several blocks get a second pass for the pairs of other
blocks: of a pair at the threshold, the prefix of the larger set (its rarest shingles, a quarter and one) and the shorter
prefix of the smaller one (a seventh and one, since its partner is no smaller) have a common shingle. So only nodes that share such a shingle with a node of another component are looked at again; those outside the
pivot's component are compared with all of them, in cells of bounded nodes and shingles. A group of texts of like length
that are alike but below the threshold shares no shingle of the shorter prefixes and isn't paired.

Defined cases: documents without words or text (null, empty) have the empty set and are linked with nothing. Rows with a
null id are linked with nothing, and are kept. Rows that share an id and a set get one row each with the same result; an
id with several sets stands for each of them. An empty table gives an empty result. Columns other than id and text are not read, so
their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitchspark.llm.common import LOWER, components, mix, small, staged, text_batches, text_bytes, word_hashes, word_spans
from pitchspark.operators.windows import ranked

SHINGLE, COORDINATES, ROWS = 5, 128, 4
BANDS = COORDINATES // ROWS
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Nodes of one block, and shingles of one block.
BLOCK, BLOCK_SHINGLES = 256, 2_000_000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64((1 << 40) - 1)


# --- sets and sketches -------------------------------------------------------------------------------------------


def shingle_sets(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents one after another, and the bounds of each document's."""
    n = len(bounds) - 1
    starts, ends, docs = word_spans(data, bounds)
    words = word_hashes(LOWER[data], starts, ends)
    per_doc = np.bincount(docs, minlength=n)
    first = np.cumsum(per_doc) - per_doc
    if len(words) >= SHINGLE:
        hashes = words[: len(words) - SHINGLE + 1].copy()
        for k in range(1, SHINGLE):
            hashes *= _STEP
            hashes += words[k : len(words) - SHINGLE + 1 + k]
        inside = docs[: len(hashes)] == docs[SHINGLE - 1 :]
        hashes, owner = mix(hashes[inside]), docs[: len(hashes)][inside]
    else:
        hashes, owner = np.empty(0, np.uint64), np.empty(0, np.int64)
    few = np.flatnonzero((per_doc > 0) & (per_doc < SHINGLE))
    if len(few):  # the whole sequence is one shingle, told apart by its number of words
        whole = np.zeros(len(few), np.uint64)
        for k in range(SHINGLE - 1):
            here = per_doc[few] > k
            whole[here] = whole[here] * _STEP + words[first[few[here]] + k]
        whole = mix(whole ^ (per_doc[few].astype(np.uint64) << np.uint64(56)))
        hashes, owner = np.concatenate([hashes, whole]), np.concatenate([owner, few])
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    count = np.bincount(owner, minlength=n)
    edge = np.concatenate([[0], np.cumsum(count)])
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        hashes[a:b].sort()
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    count = np.bincount(owner[new], minlength=n)
    return hashes[new], np.concatenate([[0], np.cumsum(count)])


def set_marks(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of each set's hashes, which names the set."""
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes, out=sums[1:])
    return (sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64)


def sketches(hashes: np.ndarray, bounds: np.ndarray, size: int = COORDINATES) -> np.ndarray:
    """The fast similarity sketch of each set, one row of ``size`` coordinates each; empty sets keep the empty mark."""
    n = len(bounds) - 1
    filled = np.full(n * size, _EMPTY)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    for i in range(2 * size):
        thrown = mix(hashes + np.uint64((i + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
        bins = (thrown >> np.uint64(40)).astype(np.int64) % size if i < size else i - size
        np.minimum.at(filled, owner * size + bins, (thrown & _LOW) | np.uint64(i << 40))
        open_docs = (filled.reshape(n, size) == _EMPTY).any(axis=1)
        more = open_docs[owner]
        if not more.any():
            break
        hashes, owner = hashes[more], owner[more]
    return filled.reshape(n, size)


def band_hashes(rows: np.ndarray) -> np.ndarray:
    """One signed 64-bit hash for each band, with the band's number in it."""
    n = len(rows)
    parts = rows.reshape(n, BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP, (n, BANDS)).copy()
    for k in range(ROWS):
        out = mix(out ^ parts[:, :, k]) * _STEP
    return mix(out).view(np.int64)


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_batches(batches):
        data, bounds = text_bytes(batch.column(1))
        hashes, edge = shingle_sets(data, bounds)
        count = np.diff(edge)
        bands = band_hashes(sketches(hashes, edge)).ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(bands) + 1, BANDS), pa.int32()), pa.array(bands))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(count, pa.int64()),
                pa.array(set_marks(hashes, edge)),
                pa.array(set_marks(mix(hashes + _STEP), edge)),
                lists,
            ],
            ["id", "n", "mark", "mark2", "bands"],
        )


# --- comparison inside tasks -------------------------------------------------------------------------------------


def linked_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, part: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (i of ``left``, j of ``right``) that pass the threshold and join two parts; ``part`` names the known ones.

    Shared shingles become bits, so an intersection is a count of common bits. Pairs in one part already are skipped.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if len(sets) == 2:
        common = np.intersect1d(sets[0], sets[1], assume_unique=True).size
        return [(0, 1)] if 100 * common >= PERCENT * (sizes.sum() - common) and part[0] != part[1] else []
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    again = np.zeros(len(ordered), dtype=bool)
    again[1:] = ordered[1:] == ordered[:-1]
    shared = again.copy()
    shared[:-1] |= again[1:]
    columns = np.cumsum(~again[shared]) - 1
    width = int(columns[-1]) + 1 if len(columns) else 0
    where = np.full(len(every), -1, dtype=np.int64)
    where[order[shared]] = columns
    bits = np.zeros((len(sets), -(-width // 64)), dtype=np.uint64)
    ends = np.cumsum(sizes)
    for k, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist())):
        own = np.zeros(bits.shape[1] * 64, dtype=bool)
        at = where[a:b]
        own[at[at >= 0]] = True
        bits[k] = np.packbits(own).view(np.uint64)
    label = np.unique(part, return_inverse=True)[1]
    found: list[tuple[int, int]] = []
    step = max(1, 4_000_000 // max(1, bits.shape[1]))
    for i in left.tolist():
        small_size, large_size = np.minimum(sizes[right], sizes[i]), np.maximum(sizes[right], sizes[i])
        near = right[(label[right] != label[i]) & (100 * small_size >= PERCENT * large_size)]
        for lo in range(0, len(near), step):
            some = near[lo : lo + step]
            common = np.bitwise_count(bits[some] & bits[i]).sum(axis=1, dtype=np.int64)
            for j in some[100 * common >= PERCENT * (sizes[some] + sizes[i] - common)].tolist():
                if label[i] != label[j]:
                    found.append((i, j))
                    label[label == label[j]] = label[i]
    return found


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block; a block's rows are held until the next block begins."""
    key, held = None, []

    def edges() -> pa.RecordBatch:
        ids = np.array([x[0] for x in held], dtype=np.int64)
        parts = np.array([x[1] for x in held], dtype=np.int64)
        late = np.array([x[2] for x in held], dtype=bool)
        sets = [np.frombuffer(x[3], dtype=np.uint64) for x in held]
        every = np.arange(len(held))
        # the second pass compares a node with its candidates; the first compares all
        left, right = (np.flatnonzero(late), np.flatnonzero(~late)) if late.any() else (every, every)
        found = linked_pairs(sets, left, right, parts)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[[f[k] for f in found]] if found else [], pa.int64()) for k in (0, 1)], ["a", "b"]
        )

    for batch in batches:
        cols = [batch.column(k).to_pylist() for k in range(7)]
        for pivot, low, high, node, part, late, body in zip(*cols):
            if (pivot, low, high) != key:
                if len(held) > 1:
                    yield edges()
                key, held = (pivot, low, high), []
            held.append((node, part, late, body))
    if len(held) > 1:
        yield edges()


def _sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and body (its sorted shingle hashes) of ``nodes`` (node, mark), from the texts that stand for them."""
    wanted, _ = small(nodes)
    texts = docs.select("id", "text").join(wanted, F.col("id") == F.col("node")).select("text", "mark", "node")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, column=0):
            hashes, edge = shingle_sets(*text_bytes(batch.column(0)))
            rows = np.flatnonzero(set_marks(hashes, edge) == np.asarray(batch.column(1)))  # rows that repeat an id may have another set
            yield pa.RecordBatch.from_arrays(
                [batch.column(2).take(pa.array(rows)), pa.array([hashes[edge[k] : edge[k + 1]].tobytes() for k in rows.tolist()], pa.binary())],
                ["node", "body"],
            )

    return texts.mapInArrow(sets, "node long, body binary")


def _compare(docs: DataFrame, placed: DataFrame, tasks: int) -> DataFrame:
    """Edges between nodes. ``placed``: node, mark, pivot, part, late, lows, highs (the cells of the pivot's group that it goes to)."""
    nodes = staged(placed.select("node", "mark").distinct(), "near-wanted")
    where, _ = small(placed.select("node", "pivot", "part", "late", "lows", "highs"))
    shipped = (
        _sets_of(docs, nodes)
        .join(where, "node")
        .withColumn("low", F.explode("lows"))
        .withColumn("high", F.explode("highs"))
        .select("pivot", "low", "high", "node", "part", "late", "body")
        .repartition(tasks, "pivot", "low", "high")
        .sortWithinPartitions("pivot", "low", "high", "node")
    )
    return shipped.mapInArrow(_edges, "a long, b long")


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, its set's size and one row per shingle."""
    for batch in batches:
        bodies = [np.frombuffer(x, dtype=np.int64) for x in batch.column(1).to_pylist()]
        if not bodies:
            continue
        sizes = np.array([len(x) for x in bodies])
        columns = [np.repeat(batch.column(0).to_numpy(), sizes), np.repeat(sizes, sizes), np.concatenate(bodies)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["node", "n", "shingle"])


def _alive(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Those of ``known`` (node, mark, part) whose prefix holds a shingle that the prefix of another part holds too."""
    shingles = staged(_sets_of(docs, known.select("node", "mark")).distinct().mapInArrow(_prefixes, "node long, n long, shingle long"), "near-shingles")
    often = shingles.groupBy("shingle").agg(F.count("*").alias("often"))
    rarest = Window.partitionBy("node").orderBy("often", "shingle")
    # a pair at the threshold shares PERCENT of the larger set at least, and 2 * PERCENT / (100 + PERCENT) of the smaller one
    long = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1
    short = F.col("n") - F.ceil(F.col("n") * (2 * PERCENT) / (100 + PERCENT)) + 1
    first = shingles.join(often.where("often > 1"), "shingle", "left").withColumn("often", F.coalesce("often", F.lit(1)))
    first = first.withColumn("turn", F.row_number().over(rarest)).where(F.col("turn") <= long).where("often > 1")
    first = first.select("node", "shingle", (F.col("turn") <= short).alias("smaller"))
    listed = staged(first.join(known.select("node", "part"), "node"), "near-prefixes")
    shared = listed.groupBy("shingle").agg(F.min("part").alias("a"), F.max("part").alias("b"), F.max("smaller").alias("some")).where("a <> b AND some").select("shingle")
    return known.join(listed.join(shared, "shingle", "left_semi").select("node").distinct(), "node", "left_semi")


def _with_edges(label: DataFrame, more: DataFrame) -> DataFrame:
    """``label`` (id, component) after the edges ``more`` (a, b), which join the components' names: only those are linked anew."""
    name = lambda end: label.select(F.col("id").alias(end), F.col("component").alias(f"_{end}"))
    ends = more.join(name("a"), "a", "left").join(name("b"), "b", "left")
    joined = staged(components(ends.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))), "near-joined")
    above = joined.select(F.col("id").alias("component"), F.col("component").alias("_above"))
    old = label.join(above, "component", "left").select("id", F.coalesce("_above", "component").alias("component"))
    return old.unionByName(joined.join(label.select("id"), "id", "left_anti"))


# --- the operator ------------------------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable over links), kept."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    marked = staged(rows.mapInArrow(_sketch_batches, "id long, n long, mark long, mark2 long, bands array<long>"), "near-sketches")
    nodes = staged(
        marked.where("n > 0 AND id IS NOT NULL")
        .groupBy("mark", "mark2", "n")
        .agg(F.min("id").alias("node"), F.any_value("bands").alias("bands")),
        "near-nodes",
    )
    buckets = nodes.select("node", "mark", "n", F.explode("bands").alias("bucket"))
    pivots = buckets.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("many")).where("many > 1")
    pivots, _ = small(staged(pivots.select("bucket", "pivot"), "near-pivots"))
    member = staged(buckets.join(pivots, "bucket").select("pivot", "node", "mark", "n").distinct(), "near-members")
    groups = member.groupBy("pivot").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    groups = staged(groups, "near-groups")
    sized, _ = small(groups)
    placed = staged(
        member.join(sized, "pivot").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "near-placed"
    )

    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lows, zero = F.when(F.col("node") == F.col("pivot"), upto("blocks")).otherwise(F.array("block")), F.array(F.lit(0))
    first = placed.select("node", "mark", "pivot", F.col("node").alias("part"), F.lit(False).alias("late"), lows.alias("lows"), zero.alias("highs"))
    edges = staged(_compare(rows, staged(first, "near-first"), tasks), "near-edges")
    label = staged(components(edges), "near-labels")

    # groups of several blocks: pairs of different blocks that aren't in one component yet
    wide = placed.where("blocks > 1").select("node", "mark").distinct()
    known = staged(
        wide.join(label.withColumnRenamed("id", "node"), "node", "left").select("node", "mark", F.coalesce("component", "node").alias("part")), "near-wide"
    )
    if not known.isEmpty():
        alive = staged(_alive(rows, known), "near-alive")
        group = placed.where("blocks > 1").select("pivot", "node", "n").join(alive, "node")
        heads = placed.where("blocks > 1 AND node = pivot").select("pivot", F.col("node").alias("_head"))
        heads = heads.join(known.select(F.col("node").alias("_head"), F.col("part").alias("head")), "_head").drop("_head")
        again = staged(group.join(heads, "pivot").withColumn("apart", F.col("part") != F.col("head")), "near-again")
        cut = lambda rows, shingles: F.greatest(F.ceil(rows / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")
        apart = F.sum(F.when(F.col("apart"), F.col("n")).otherwise(0))
        cells = again.groupBy("pivot").agg(cut(F.count_if("apart"), apart).alias("lefts"), cut(F.count("*"), F.sum("n")).alias("rights")).where("lefts > 0")
        sized, _ = small(staged(cells.select("pivot", "lefts", "rights"), "near-cells"))
        both = again.join(sized, "pivot")
        block = lambda n, seed: F.array(F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int"))
        facts = ["node", "mark", "pivot", "part"]
        whole = both.select(*facts, F.lit(False).alias("late"), upto("lefts").alias("lows"), block("rights", 2).alias("highs"))
        left = both.where("apart").select(*facts, F.lit(True).alias("late"), block("lefts", 1).alias("lows"), upto("rights").alias("highs"))
        second = staged(whole.unionByName(left), "near-second")
        more = staged(_compare(rows, second, tasks), "near-edges2")
        label = label if more.isEmpty() else _with_edges(label, more)
    found = nodes.select("mark", "mark2", "n", "node").join(label, F.col("node") == F.col("id"), "left")
    found = staged(found.select("mark", "mark2", "n", F.coalesce("component", "node").alias("component")), "near-found")
    return (
        marked.select("id", "n", "mark", "mark2")
        .join(found, ["mark", "mark2", "n"], "left")
        .select(
            F.col("id").alias(id_col),
            F.col("n").alias("n_shingles"),
            F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
        )
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
    )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one document of each component: that with the smallest id.

    Where an id stands for several texts, texts are numbered in the order of id and hash and compared under these
    numbers, so that a text stays or goes by itself. Rows equal in id and text stay or go together.
    """
    text_mark = F.xxhash64(F.col(text_col))
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("__id"), text_mark.alias("__mark"))
    texts = staged(texts.distinct(), "near-texts")
    if texts.groupBy("__id").count().where("count > 1").isEmpty():
        report = near_duplicates(docs, id_col, text_col).where("NOT kept").select(F.col(id_col).alias("__dropped_id"))
        dropped, _ = small(staged(report.distinct(), "near-dropped"))
        return docs.join(dropped, docs[id_col] == F.col("__dropped_id"), "left_anti")
    numbers = staged(ranked(texts, ["__id", "__mark"], "__number"), "near-numbers")
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), text_mark.alias("__mark"), F.col(text_col).alias("text"))
    some, _ = small(numbers)
    numbered = rows.join(some, ["__id", "__mark"], "left").select(F.col("__number").cast("long").alias("__number"), "text")
    report = near_duplicates(numbered, "__number", "text").where("NOT kept").select("__number").distinct()
    dropped, _ = small(staged(numbers.join(report, "__number").select("__id", "__mark"), "near-dropped"))
    return docs.join(dropped, (docs[id_col].cast("long") == dropped["__id"]) & (F.xxhash64(docs[text_col]) == dropped["__mark"]), "left_anti")
