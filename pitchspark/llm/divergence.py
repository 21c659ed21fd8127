"""Source divergence audit: how far the sources of a language are from each other, and which terms set a source apart.

Term-block dense matrices. Every task counts the terms of its texts for each (language, source) before anything is
shuffled; the terms that enough documents of their language have are dealt into blocks of about ``BLOCK_TERMS`` by hash.
A block and a tile of at most ``TILE`` groups make a numpy int64 matrix (group by term), and all pairs of groups of two
tiles are compared by broadcasting. Partial pair matrices are summed over the blocks, and each group's best terms of each
block (a heap of ``TOP``) are merged. No task ever holds a language's vocabulary or all its groups' counts.

All arithmetic is exact in 64-bit integers: shares are found by long division in steps of 1000, so counts may reach 9e15.

Defined cases: null text, language and source count as empty text; a document without terms still makes its group known;
rows that repeat count as often as they stand; a language without kept terms gives pairs of value 0 and no terms; a
language with one source gives no pairs; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitchspark.llm.common import LOWER, bounded_batches, small, staged, text_batches, text_bytes

#: Documents of a language that must have a term, parts of a share, and terms reported for each group.
LEAST_DOCS, SCALE, TOP = 10, 1_000_000_000, 10
#: Terms of a block (on average), groups of a tile, cells that one broadcast makes, matrices held before they are passed on.
BLOCK_TERMS, TILE, CELLS, HELD = 1024, 256, 2_000_000, 32
#: Bytes of text whose terms are counted together, and of the slices that are gathered up to that, so that it is hardly exceeded.
COUNT_BYTES, SLICE_BYTES = 12_000_000, 1_500_000

_TERM = np.zeros(256, dtype=bool)
_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


# --- counts of terms ---------------------------------------------------------------------------------------------


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with the term), staged."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for n, c in (("lang", lang_col), ("source", source_col), ("text", text_col))])
    counted = texts.mapInArrow(_count_batches, "lang string, source string, term string, n long, docs long")
    return staged(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in text_batches(batches, 2, SLICE_BYTES):
        held.append(batch)
        size += batch.column(2).nbytes
        if size >= COUNT_BYTES:
            yield from _counted(held)
            held, size = [], 0
    if held:
        yield from _counted(held)


def _counted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the terms of all batches for each group, in slices."""
    table = pa.Table.from_batches(held)
    langs, sources = (table.column(i).combine_chunks().dictionary_encode() for i in (0, 1))
    group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
    place = np.empty(len(group), dtype=np.int64)  # documents of one group stand together
    order = np.argsort(group, kind="stable")
    place[order] = np.arange(len(group))
    data, bounds = text_bytes(table.column(2).cast(pa.large_string()).combine_chunks())
    inside = _TERM[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(data))]  # no term goes on into the next text
    first[cuts], last[cuts - 1] = inside[cuts], inside[cuts - 1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(np.flatnonzero(last) + 1 - starts, out=offsets[1:])
    del first, last
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(LOWER[data[inside]]))
    del inside
    terms = terms.dictionary_encode()
    del offsets, data
    keys = terms.indices.to_numpy().astype(np.int64) * len(group) + place[np.searchsorted(bounds, starts, side="right") - 1]
    del starts
    keys.sort()
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))  # of each term and document
    times = np.diff(np.append(first, len(keys)))
    code, own = keys[first] // len(group), group[order][keys[first] % len(group)]
    begin = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (own[1:] != own[:-1])))  # of each term and group
    n, with_term = np.add.reduceat(times, begin), np.diff(np.append(begin, len(first)))
    code, own = code[begin], own[begin]
    names = terms.dictionary.cast(pa.string())
    for lo in range(0, len(code), 50_000):
        part = slice(lo, lo + 50_000)
        yield pa.RecordBatch.from_arrays(
            [
                langs.dictionary.take(pa.array(own[part] // len(sources.dictionary))),
                sources.dictionary.take(pa.array(own[part] % len(sources.dictionary))),
                names.take(pa.array(code[part])),
                pa.array(n[part]),
                pa.array(with_term[part]),
            ],
            names=["lang", "source", "term", "n", "docs"],
        )


# --- blocks and tiles --------------------------------------------------------------------------------------------


def shares(count: np.ndarray, total: np.ndarray, vocabulary: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * vocabulary)), exact while count * 1000 fits 64 bits."""
    over = np.asarray(total, dtype=np.int64) + 2 * vocabulary
    rest, out = np.broadcast_arrays(np.asarray(count, dtype=np.int64) + 2, over)[0], np.int64(0)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, over)
        out = out * 1000 + digit
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q)) by broadcasting."""
    apart = p - q
    return apart * apart // (p + q)


def pair_sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row of ``a`` and each of ``b`` (groups by terms) the sum of distances over all terms."""
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    width = max(1, min(a.shape[1], CELLS // max(1, len(b))))
    height = max(1, CELLS // max(1, len(b) * width))
    for t in range(0, a.shape[1], width):
        for i in range(0, len(a), height):
            out[i : i + height] += distance(a[i : i + height, None, t : t + width], b[None, :, t : t + width]).sum(axis=2)
    return out


OUT = "lang string, part string, source string, item string, value long"


def _emit(lang: str, part: str, sources: list, items: list, values) -> pa.RecordBatch:
    n = len(values)
    columns = [[lang] * n, [part] * n, sources, items]
    return pa.RecordBatch.from_arrays([*[pa.array(x, pa.string()) for x in columns], pa.array(values, pa.int64())], names=["lang", "part", "source", "item", "value"])


def _matrix(cells: list[dict], terms: dict[str, int], sizes: list[int], vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and shares of a tile's groups (rows) for the terms."""
    counts = np.zeros((len(sizes), len(terms)), dtype=np.int64)
    if cells:
        counts[[c["g"] for c in cells], [terms[c["term"]] for c in cells]] = [c["n"] for c in cells]
    return counts, shares(counts, np.asarray(sizes, dtype=np.int64)[:, None], vocabulary)


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial pair sums and best terms of rows that hold one block of two tiles of groups each."""
    sums: dict = {}
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            lang, vocabulary, same = row["lang"], row["v"], row["tile_a"] == row["tile_b"]
            names_a, sizes_a, names_b, sizes_b = ([x[k] for x in row[side]] for side in ("groups_a", "groups_b") for k in ("source", "total"))
            cells_a, cells_b = row["cells_a"] or [], row["cells_b"] or []
            totals = {c["term"]: c["all"] for c in cells_a} | {c["term"]: c["all"] for c in cells_b}
            terms = {t: k for k, t in enumerate(sorted(totals))}  # code points sort as UTF-8 does
            if vocabulary:
                counts, a = _matrix(cells_a, terms, sizes_a, vocabulary)
                b = a if same else _matrix(cells_b, terms, sizes_b, vocabulary)[1]
                none = [shares(np.int64(0), np.asarray(x, dtype=np.int64), vocabulary) for x in (sizes_a, sizes_b)]
                value = pair_sums(a, b) + (row["n_terms"] - len(terms)) * distance(none[0][:, None], none[1][None, :])
            else:
                value = np.zeros((len(names_a), len(names_b)), dtype=np.int64)
            key = (lang, row["tile_a"], row["tile_b"])
            if key in sums:
                sums[key][2] += value
            else:
                sums[key] = [names_a, names_b, value]
            if len(sums) >= HELD:
                yield from _pairs(sums)
                sums = {}
            if same and terms:
                q = shares(np.array([totals[t] for t in terms], dtype=np.int64), np.int64(row["n"]), vocabulary)
                yield from _best_terms(lang, names_a, list(terms), counts, a, q)
    yield from _pairs(sums)


def _pairs(sums: dict) -> Iterator[pa.RecordBatch]:
    for (lang, tile_a, tile_b), (names_a, names_b, value) in sums.items():
        i, j = np.indices(value.shape).reshape(2, -1)
        if tile_a == tile_b:
            i, j = i[(other := i != j)], j[other]
        left, right, values = [names_a[x] for x in i], [names_b[x] for x in j], value[i, j]
        yield _emit(lang, "pair", left, right, values)
        if tile_a != tile_b:
            yield _emit(lang, "pair", right, left, values)


def _best_terms(lang: str, names: list[str], terms: list[str], counts: np.ndarray, p: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each group's TOP terms of a block that it has more of than its language."""
    value = np.where((counts > 0) & (p > q), distance(p, q), -1)
    best = np.argsort(-value, axis=1, kind="stable")[:, :TOP]  # terms are in order, so ties are too
    g = np.repeat(np.arange(len(names)), best.shape[1])
    t = best.ravel()
    g, t = g[(found := value[g, t] >= 0)], t[found]
    if len(g):
        yield _emit(lang, "term", [names[x] for x in g], [terms[x] for x in t], value[g, t])


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, part, item, value, rank: see the head of this module and ``pair`` and ``term`` below.

    ``pair``: item is another source of the language and value the sum of distances between both sources' shares over
    all kept terms. ``term``: item is one of the TOP terms that the source has a larger share of than its language.
    """
    spark = docs.sparkSession
    named = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source"))
    groups = staged(named.distinct(), "divergence-groups")
    counts = term_counts(docs, lang_col, source_col, text_col)

    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).where(F.col("docs") >= least_docs)
    kept = staged(kept.drop("docs"), "divergence-kept")
    langs = groups.select("lang").distinct().join(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("n")), "lang", "left")
    langs = langs.select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("n", F.lit(0)).alias("n"))
    langs = staged(langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("v") / BLOCK_TERMS)).cast("int")), "divergence-langs")
    few_langs, _ = small(langs)
    block = F.expr("CAST(pmod(xxhash64(term), blocks) AS INT)").alias("block")
    dealt = kept.join(few_langs, "lang").select("lang", "term", "all", block)

    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # one row for each source, as the pairs have many
    placed = staged(groups.select("lang", "source", (number % TILE).alias("g"), F.floor(number / TILE).cast("int").alias("tile")), "divergence-places")
    few_places, _ = small(placed)
    rows = counts.select("lang", "source", "term", "n").join(dealt, ["lang", "term"]).join(few_places, ["lang", "source"])
    rows = staged(rows.select("lang", "source", "term", "n", "all", "block", "tile", "g"), "divergence-rows")

    totals = placed.join(rows.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    tile_groups = F.array_sort(F.collect_list(F.struct("g", "source", F.coalesce("total", F.lit(0)).alias("total"))))  # at most TILE
    tiles = totals.groupBy("lang", "tile").agg(tile_groups.alias("groups")).join(few_langs, "lang")
    frames = tiles.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    cells = rows.groupBy("lang", "block", "tile").agg(F.collect_list(F.struct("term", "g", "n", "all")).alias("cells"))  # of a block and a tile
    terms = dealt.groupBy("lang", "block").agg(F.count("*").alias("n_terms"))
    frames = staged(frames.join(cells, ["lang", "block", "tile"], "left"), "divergence-frames")
    left = frames.select("lang", "block", "v", "n", F.col("tile").alias("tile_a"), F.col("groups").alias("groups_a"), F.col("cells").alias("cells_a"))
    right = frames.select("lang", "block", F.col("tile").alias("tile_b"), F.col("groups").alias("groups_b"), F.col("cells").alias("cells_b"))
    same = left.join(terms, ["lang", "block"], "left").select(
        "*", F.col("tile_a").alias("tile_b"), F.col("groups_a").alias("groups_b"), F.lit(None).cast(frames.schema["cells"].dataType).alias("cells_b")
    )
    mixed = left.join(right, ["lang", "block"]).where("tile_a < tile_b").join(terms, ["lang", "block"], "left")
    pairs = same.unionByName(mixed.select(*same.columns)).withColumn("n_terms", F.coalesce("n_terms", F.lit(0)))
    bounded_batches(spark)
    found = staged(pairs.mapInArrow(_compare_blocks, OUT), "divergence-partial")

    summed = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda rows: rows.select("lang", "source", "part", "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(summed).unionByName(ranked(found.where("part = 'term'")).where(F.col("rank") <= TOP))
