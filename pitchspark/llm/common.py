"""Helpers that several operators share: staged tables, checked broadcasts, word hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types

from pitchspark.staging import shared_dir, staged  # noqa: F401  also for the operators beside this file

#: White space of all text contracts: the space and U+0009 to U+000D.
WHITE = r"[\x20\x09-\x0D]+"

#: A side of a join is broadcast only if it was measured and has no more rows and bytes than these.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32_000_000


#: Bytes of a record batch between Spark and Python, so that neither holds much of a partition at once.
ARROW_BYTES = 8_000_000


def bounded_batches(spark: SparkSession) -> None:
    """Keep record batches below ``ARROW_BYTES`` in this session; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int("".join(x for x in spark.conf.get(name) if x.isdigit() or x == "-"))
    if not 0 < now <= ARROW_BYTES:
        spark.conf.set(name, ARROW_BYTES)


def _bytes_of(value: Column, kind: types.DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (types.StringType, types.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 24
    if isinstance(kind, types.ArrayType):
        add = lambda total, x: total + _bytes_of(x, kind.elementType)
        return F.coalesce(F.aggregate(value, F.lit(0).cast("long"), add), F.lit(0)) + 24
    if isinstance(kind, types.StructType):
        return sum((_bytes_of(value.getField(f.name), f.dataType) for f in kind.fields), F.lit(8).cast("long"))
    return F.lit(8).cast("long")


def small(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """``df`` with a broadcast hint if it is measured to have at most ``limit`` rows and ``most`` bytes, else unchanged for a
    shuffled join. ``df`` is computed for the measure, so it should be staged."""
    width = sum((_bytes_of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0).cast("long"))
    seen = df.limit(limit + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    fits = seen["n"] <= limit and seen["b"] <= most
    return (F.broadcast(df) if fits else df), fits


def text_of(name: str) -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b): the smallest node it reaches.

    Alternates the star contractions of connected components in map-reduce: a node hands its larger neighbours to its
    smallest one, then its smaller ones. Minima are partly aggregated before the shuffle; a node with very many
    neighbours is only ever a join key, which adaptive execution splits.
    """
    pairs = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = staged(pairs, "stars")
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "stars-min")
        least, _ = small(least)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = staged(large, "stars-large")
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "stars-min")
        hint, _ = small(least)
        moved = large.join(hint, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = staged(moved.unionByName(least.withColumnRenamed("m", "v")).distinct(), "stars")
        pairs = new
        if moved.isEmpty() and new.join(new.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            break
    ends = pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(ends)


# --- 64-bit hashes over the bytes of an Arrow batch -------------------------------------------------------------

_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: Base of the polynomial over bytes, and its inverse modulo 2**64.
BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base & _MASK, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = _lower_table()
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the words in ``data`` (bytes of all documents, cut at ``bounds``)."""
    if not len(data):
        none = np.empty(0, dtype=np.int64)
        return none, none, none
    black = ~_SPACE[data]
    first = black.copy()
    first[1:] &= ~black[:-1]
    cuts = bounds[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = black[cuts]  # a document's first byte never continues the word before
    starts = np.flatnonzero(first)
    last = black.copy()
    last[:-1] &= ~black[1:]
    inner = cuts[cuts > 0] - 1
    last[inner] = black[inner]
    ends = np.flatnonzero(last) + 1
    docs = np.searchsorted(bounds, starts, side="right") - 1
    return starts, ends, docs


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from prefix sums of a polynomial over the bytes."""
    return word_prefix_hashes(data, starts, ends, (None,))[0]


def word_prefix_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lengths: tuple) -> list[np.ndarray]:
    """Hashes of each word's first bytes, for each of ``lengths`` (None: of the whole word). Shorter words count whole,
    but with another hash for each length."""
    if not len(starts):
        return [np.empty(0, dtype=np.uint64) for _ in lengths]
    power = powers(BASE, len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    back = powers(INVERSE, len(data))
    back = back[starts]
    begin, out = sums[starts], []
    for length in lengths:
        stops = ends if length is None else np.minimum(ends, starts + length)
        size = (stops - starts).astype(np.uint64) + np.uint64(0 if length is None else length << 32)
        out.append(mix((sums[stops] - begin) * back + size * np.uint64(_ODD)))
    return out


#: Bytes of text that one step over a batch takes, but for a single longer text.
BATCH_BYTES = 1_000_000


def text_batches(batches, column: int = 1, most: int = BATCH_BYTES):
    """The same rows in slices whose texts (Arrow column number ``column``) have about ``most`` bytes at most."""
    import pyarrow as pa

    for batch in batches:
        if not batch.num_rows:
            continue
        body = batch.column(column)
        kind = pa.large_string() if pa.types.is_string(body.type) else body.type
        ends = np.frombuffer(body.cast(kind).buffers()[1], dtype=np.int64)[body.offset : body.offset + len(body) + 1]
        lo = 0
        while lo < len(body):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, side="right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column and the bounds of its rows; nulls are empty. Nothing is copied."""
    import pyarrow as pa

    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    _, offsets, data = column.buffers()
    if not n or data is None:
        return np.empty(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    bounds = np.frombuffer(offsets, dtype=np.int64, count=column.offset + n + 1)[column.offset :]
    body = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]]
    return body, bounds - bounds[0]
