"""Sharding by histogram sort: count exact bytes below candidate key boundaries, refine the intervals that matter, cut
at the splitters and exchange the rows once.

The key is 62 bits: 31 of a hash of the text, 20 of a hash of the id, 11 of a hash of the row's place in the scan. Equal
texts are neighbours, so a group leaves its shard only where a splitter has to cut through it, and a group that holds a
third of all rows still splits, even if its ids are equal or null too. The keys are staged once, so the place counts as it
was then. Everything is DataFrame code; the driver sees histograms only, whose size depends on parameters and not on the
data.

A splitter falls between two rows, at that end of the row under it which is nearer to its aim, or within ``TOLERANCE`` of a
share. So a shard's bytes differ from an equal share by one (the largest) row and twice the tolerance at most.

Defined cases: a null text has size ``ROW_BYTES`` and the checksum of an empty text; null ids share one hash; rows that
repeat are spread by their place. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitchspark.llm.common import staged, text_of

#: Bytes that a row takes besides its text.
ROW_BYTES = 8
KEY_BITS, FIRST_BITS, NEXT_BITS = 62, 12, 8
#: Rows of a shard's share within which a splitter has to be, as a part of the share.
TOLERANCE = 0.0005
#: An interval with more rows than the total over this is cut further, so that no task of the exchange gets many rows.
BLOCKS = 4096
LEAST_BLOCK = 32


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32 and the sort key of every row."""
    text = text_of(text_col)
    high = F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 33), 31)
    low = F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 44), 11)
    place = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 53)
    return docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        high.bitwiseOR(low).bitwiseOR(place).alias("key"),
    )


def _count(rows: DataFrame, shift: int) -> dict[int, tuple[int, int]]:
    counted = rows.groupBy(F.shiftright("key", shift).alias("bin")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    return {r["bin"]: (r["bytes"], r["rows"]) for r in counted.collect()}


def histogram(rows: DataFrame, shards: int, tolerance: float = TOLERANCE, blocks: int = BLOCKS) -> list[tuple[int, int, int]]:
    """Intervals of the key in order, as (lower bound, bytes, rows), fine enough for splitters and for even tasks.

    The first round counts all rows in 2**FIRST_BITS intervals; each later round counts again only in intervals that hold
    a splitter or too many rows, at most ``shards + blocks`` of them.
    """
    shift = KEY_BITS - FIRST_BITS
    fresh = {b << shift: n for b, n in _count(rows, shift).items()}
    total, count = sum(n[0] for n in fresh.values()), sum(n[1] for n in fresh.values())
    near, most = total / shards * tolerance, max(LEAST_BLOCK, count // blocks)
    leaves = dict(fresh)
    while shift and fresh:
        low = sorted(leaves)
        ends = list(accumulate(leaves[x][0] for x in low))
        if not low:
            break
        cut = {low[min(bisect_left(ends, total * i / shards), len(low) - 1)] for i in range(1, shards)}
        probe = [x for x, (size, n) in fresh.items() if n > 1 and (n > most or x in cut and size > near)]
        if not probe:
            break
        active = rows.where(F.shiftright("key", shift).isin([x >> shift for x in probe]))
        shift = max(0, shift - NEXT_BITS)
        for x in probe:
            del leaves[x]
        fresh = {b << shift: n for b, n in _count(active, shift).items()}
        leaves |= fresh
    return [(x, *leaves[x]) for x in sorted(leaves)]


def cut(intervals: list[tuple[int, int, int]], shards: int, blocks: int = BLOCKS) -> list[tuple[int, int, int]]:
    """Blocks of neighbouring intervals of one shard, as (lower bound, shard, rows of the shard before the block)."""
    if not intervals:
        return []
    ends = list(accumulate(x[1] for x in intervals))
    total, count = ends[-1], sum(x[2] for x in intervals)
    most = max(LEAST_BLOCK, count // blocks)
    edges = []
    for i in range(1, shards):
        at = bisect_left(ends, total * i / shards)
        before = ends[at - 1] if at else 0
        edges.append(at if total * i / shards - before <= ends[at] - total * i / shards else at + 1)
    out: list[tuple[int, int, int]] = []
    shard, done, held = 0, 0, 0
    for k, (low, _, rows) in enumerate(intervals):
        new = shard
        while new < shards - 1 and k >= edges[new]:
            new += 1
        if new != shard:
            shard, done, held = new, 0, 0
        if not held or held + rows > most:
            out.append((low, shard, done))
            held = 0
        held += rows
        done += rows
    return out


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id, size, text_crc32, shard and slot; shards' bytes are as near equal as ``TOLERANCE`` and whole rows allow."""
    spark = docs.sparkSession
    rows = staged(keyed(docs, id_col, text_col), "shard-keys")
    found = cut(histogram(rows, shards), shards)
    shift = KEY_BITS - FIRST_BITS
    parts: dict[int, list[tuple[int, int, int]]] = {}
    for i, block in enumerate(found):
        last = (found[i + 1][0] - 1 if i + 1 < len(found) else (1 << KEY_BITS) - 1) >> shift
        for part in range(block[0] >> shift, last + 1):
            parts.setdefault(part, []).append(block)
    # 2**FIRST_BITS rows at most, whatever the data: broadcast
    table = spark.createDataFrame(list(parts.items()), "part long, found array<struct<low: long, shard: int, done: long>>")
    block = F.element_at(F.filter("found", lambda b: b["low"] <= F.col("key")), -1)
    placed = rows.join(F.broadcast(table), F.shiftright("key", shift) == F.col("part")).withColumn("block", block)
    within = Window.partitionBy("block.low").orderBy("key", "id", "text_crc32", "size")
    return placed.select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.col("block.shard").alias("shard"),
        (F.row_number().over(within) - 1 + F.col("block.done")).cast("long").alias("slot"),
    )
