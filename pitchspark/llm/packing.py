"""Packing of documents into fixed windows of tokens by non-negative least squares over a length histogram.

Documents become pieces of at most one window. Shallow combinations of length classes that fill a window are enumerated;
non-negative least squares finds how often to repeat each so that they use up the histogram; the counts are rounded down
and the residual is packed greedily, longest first. All of that sees ``window`` counts at most. Pieces then get their
number within their length class from a distributed ranking and look up their sequence, so no task holds a class whole.

Defined cases: a null or empty text is one document of the end token alone; very long texts become many full pieces; ids
may repeat or be null (pieces of equal ids and starts are then told apart by their tokens' checksum only, and take any of
the places meant for them). An empty table gives an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitchspark.llm.common import staged

WINDOW, END_TOKEN = 2048, 1
#: Tokens of a length class.
WIDTH = 8
#: Rows of one block of the ranking: the total over BLOCKS, within these bounds.
BLOCKS, LEAST_BLOCK, MOST_BLOCK = 8192, 128, 1_000_000
#: Steps of the least-squares solver.
STEPS = 600

PIECES = "start long, length long, doc_tokens long, ids binary"


# --- tokens ------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def encoders(json_path: str, ranks_path: str | None):
    """``encode(texts)``, giving lists of ids as the ``tokenizers`` file at ``json_path`` defines them.

    ``ranks_path`` may name the same vocabulary as ranks. Then plain texts (Latin letters, ASCII digits and common
    punctuation, no "<|") go to the faster ``tiktoken``, whose ids are the same there; all others to ``tokenizers``.
    """
    import re

    from tokenizers import Tokenizer

    whole = lru_cache(maxsize=1)(lambda: Tokenizer.from_file(json_path))  # loaded when the first text needs it
    if ranks_path is None:
        return lambda texts: [e.ids for e in whole().encode_batch_fast(texts, add_special_tokens=False)]
    import base64

    import tiktoken
    from public_tokenizers import PATTERN

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = re.compile(r"<\||[^\t\n\r\x20-\x7e¡-¬®-ɏ‐-‧‰-⁞€]")

    def encode(texts: list[str]) -> list[list[int]]:
        return [whole().encode(x, add_special_tokens=False).ids if odd.search(x) else fast.encode_ordinary(x) for x in texts]

    return encode


def tokenize_pieces(
    docs: DataFrame, json_path: str, ranks_path: str | None = None, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Each document's tokens and the end token, cut every ``window`` tokens: id, start, length, doc_tokens and ids.

    ``ids`` holds the piece's tokens as little-endian unsigned 32-bit numbers.
    """
    schema = docs.select(F.col(id_col).alias("id")).schema.simpleString()[len("struct<") : -1] + ", " + PIECES

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoders(json_path, ranks_path)
        for batch in batches:
            ids = batch.column(0)
            for lo in range(0, len(batch), 256):
                texts = [x or "" for x in batch.column(1).slice(lo, 256).to_pylist()]
                rows, starts, lengths, totals, blobs = [], [], [], [], []
                for k, tokens in enumerate(encode(texts)):
                    tokens.append(END_TOKEN)
                    body = np.asarray(tokens, dtype="<u4")
                    for start in range(0, len(body), window):
                        part = body[start : start + window]
                        rows.append(lo + k)
                        starts.append(start)
                        lengths.append(len(part))
                        totals.append(len(body))
                        blobs.append(part.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(totals, pa.int64()), pa.array(blobs, pa.binary())],
                    ["id", "start", "length", "doc_tokens", "ids"],
                )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(pieces, schema)


# --- the plan ----------------------------------------------------------------------------------------------------


def combinations(slots: int, present: set[int]) -> list[tuple[int, ...]]:
    """Multisets of two or three length classes of ``present`` that fill ``slots`` exactly, and the class that does alone."""
    out: list[tuple[int, ...]] = [(slots,)] if slots in present else []
    for a in sorted(present):
        if slots - a in present and 2 * a <= slots:
            out.append((a, slots - a))
        out += [(a, b, slots - a - b) for b in range(a, (slots - a) // 2 + 1) if b in present and slots - a - b in present]
    return out


def nonnegative_least_squares(patterns: list[tuple[int, ...]], counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """x >= 0 with the least |Ax - counts|, A[class, pattern] being how often the pattern has the class: accelerated
    projected gradient on the sparse A."""
    rows = np.array([c for p in patterns for c in p])
    cols = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    scale = max(1.0, float(counts.max()))
    aim = counts / scale
    apply = lambda x: np.bincount(rows, x[cols], minlength=len(aim))
    back = lambda y: np.bincount(cols, y[rows], minlength=len(patterns))
    v = np.ones(len(patterns))
    for _ in range(30):  # the largest eigenvalue of A'A, for the step
        v = back(apply(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - back(apply(y) - aim) / (norm * 1.01))
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (old - 1) / t * (new - x)
        x = new
    return x * scale


def plan_packing(histogram: dict[int, int], slots: int) -> list[tuple[tuple[int, ...], int]]:
    """(classes of one sequence, repeats) covering ``histogram`` (class -> pieces) exactly; a class takes as many slots."""
    left = np.zeros(slots + 1, dtype=np.int64)
    for k, n in histogram.items():
        left[k] = n
    plan: list[tuple[tuple[int, ...], int]] = []
    if left[slots]:
        plan.append(((slots,), int(left[slots])))
        left[slots] = 0
    patterns = combinations(slots, set(np.flatnonzero(left).tolist()))
    if patterns:
        repeats = nonnegative_least_squares(patterns, left.astype(float))
        for k in np.argsort(-repeats, kind="stable"):
            need: dict[int, int] = {}
            for c in patterns[k]:
                need[c] = need.get(c, 0) + 1
            n = min(int(repeats[k]), *(int(left[c]) // m for c, m in need.items()))
            if n > 0:
                plan.append((patterns[k], n))
                for c, m in need.items():
                    left[c] -= n * m
    while left.any():  # the longest piece first, each gap filled with the longest that fits
        taken: dict[int, int] = {}
        gap = slots
        while gap:
            fits = np.flatnonzero(left[: gap + 1])
            fits = [c for c in fits[::-1][:64] if left[c] > taken.get(int(c), 0)] or [c for c in fits[::-1] if left[c] > taken.get(int(c), 0)]
            if not fits:
                break
            c = int(fits[0])
            taken[c] = taken.get(c, 0) + 1
            gap -= c
        n = min(int(left[c]) // m for c, m in taken.items())
        plan.append((tuple(c for c, m in sorted(taken.items(), reverse=True) for _ in range(m)), n))
        for c, m in taken.items():
            left[c] -= n * m
    return plan


# --- placement ---------------------------------------------------------------------------------------------------


def place(pieces: DataFrame, key: list[str], length_col: str = "length", window: int = WINDOW, width: int = WIDTH) -> DataFrame:
    """``pieces`` with sequence_id (from 0) and offset; ``key`` orders pieces of a class. Its lengths are 1 to ``window``."""
    spark = pieces.sparkSession
    slots = window // width
    classed = pieces.withColumn("_class", F.ceil(F.col(length_col) / width).cast("int"))
    histogram = {r["_class"]: r["n"] for r in classed.groupBy("_class").agg(F.count("*").alias("n")).collect()}
    total = sum(histogram.values())
    base, spots = 0, {}
    for pattern, repeats in plan_packing(histogram, slots):
        for slot, c in enumerate(pattern):
            spots.setdefault(c, []).append((repeats, base, slot))
        base += repeats
    table = []  # as many rows as classes; all arrays together as long as the plan, which depends on the window alone
    for c, found in spots.items():
        first, runs = 0, []
        for repeats, start, slot in found:
            runs.append((first, start, slot))
            first += repeats
        table.append((c, runs))
    places = spark.createDataFrame(table, "_class int, _runs array<struct<first: long, sequence: long, slot: int>>")

    block = min(max(total // BLOCKS, LEAST_BLOCK), MOST_BLOCK)
    salts = spark.createDataFrame([(c, -(-n // block)) for c, n in histogram.items()], "_class int, _salts long")
    salted = (
        classed.join(F.broadcast(salts), "_class")
        .withColumn("_salt", F.pmod(F.xxhash64(*key), F.col("_salts")))
        .drop("_salts")
    )
    before = Window.partitionBy("_class").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        salted.groupBy("_class", "_salt")
        .agg(F.count("*").alias("_n"))
        .select("_class", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("_class", "_salt").orderBy(*key)) - 1)
    run = F.element_at(F.filter("_runs", lambda r: r["first"] <= F.col("_at")), -1)
    placed = (
        ranked.join(offsets, ["_class", "_salt"])
        .withColumn("_at", F.col("_rank") + F.col("_before"))
        .join(F.broadcast(places), "_class")
        .withColumn("_run", run)
        .withColumn("sequence_id", F.col("_run.sequence") + F.col("_at") - F.col("_run.first"))
    )
    ahead = Window.partitionBy("sequence_id").orderBy("_run.slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum(length_col).over(ahead), F.lit(0)).cast("long")).select(
        *pieces.columns, "sequence_id", "offset"
    )


def pack(docs: DataFrame, json_path: str, ranks_path: str | None = None, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places; with ``keep_ids`` their tokens too, else only the tokens' checksum."""
    pieces = tokenize_pieces(docs, json_path, ranks_path, window).withColumn("ids_crc32", F.crc32("ids"))
    # the place in the scan tells rows that repeat apart, so that no block of the ranking holds all of them
    pieces = pieces.withColumn("_place", F.monotonically_increasing_id())
    pieces = staged(pieces if keep_ids else pieces.drop("ids"), "pack-pieces")
    return place(pieces, ["id", "start", "ids_crc32", "_place"], window=window).drop("_place").withColumnRenamed("id", "doc_id")
