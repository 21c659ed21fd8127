"""Quality rules: counts of words, symbols and repeats, and a verdict from tokeniser fertility.

A public vocabulary (a SentencePiece model with byte fallback) measures three figures of a text: its letters per token,
the share of tokens that stand for single bytes, and the entropy of its tokens. What is usual depends on the script and
the language (:func:`groups`: the script of most letters, and for the Latin one a guess from its accents), and for the
entropy on the length, so a first pass over all documents counts the figures in narrow bins for each group and class of
length. The bands lie around each group's medians and are wider where a group has few documents, by ``DOUBT`` over the root
of their number, so a small group is judged leniently and no group is judged by another's text. The counts are bounded by
the bins, not by the data. A document is kept if it passes the base rules and all three bands.

Defined cases: null and empty texts have no words and fail the base rules. Texts without letters form a group of their own,
whose fertility is outside the fixed bands. Rows that repeat count as often as they appear; of medians that tie between
bins the lower one counts. An empty table gives an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchspark.llm.common import BASE, INVERSE, mix, powers, staged, text_batches, text_bytes, word_hashes, word_spans
from pitchspark.llm.toxicity import LANGUAGES, languages

WINDOW, LEAST_WORDS, REPEAT_PERCENT = 8, 20, 30
SYMBOLS = "#*$%&|<>"
#: Letters per token of the median times these; bits of entropy below the median; share of byte tokens above the median.
LOW_FERTILITY, HIGH_FERTILITY, ENTROPY_BITS, BYTE_SHARE = 0.9, 1.5, 0.8, 0.15
#: Few tokens vary more: the lower factor falls by this over the root of the least number of tokens of the length class.
SPREAD = 0.4
#: A group's bands are this much wider (as a part of the median fertility, in bits, and as a share), over the root of the
#: number of its documents.
DOUBT = {"fertility": 1.0, "entropy": 4.0, "byte_share": 1.0}
#: Fixed outer bands, whatever the medians are.
FIXED = {"fertility": (0.25, 12.0), "entropy": 2.0, "byte_share": 0.5}
BINS = 100  # of one unit of a figure

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(x) for x in SYMBOLS]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(0xC2, 256)]] = True  # other scripts count by lead byte
_ODD = np.uint64(0x9E3779B97F4A7C15)


# Scripts by the first code points of their ranges; letters outside them count as "other".
RANGES = (
    (0x41, "latin"), (0x5B, None), (0x61, "latin"), (0x7B, None), (0xC0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"),
    (0x590, "hebrew"), (0x600, "arabic"), (0x700, "other"), (0x900, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, None), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, None), (0xFE70, "arabic"),
    (0xFF00, None), (0x10000, "other"), (0x1F000, None), (0x20000, "han"),
)
SCRIPTS = ("latin", *sorted({x for _, x in RANGES if x} - {"latin"}))
GROUPS = (*LANGUAGES, *SCRIPTS[1:], "none")
_EDGES = np.array([x for x, _ in RANGES])
_SCRIPT_OF = np.array([len(SCRIPTS), *(SCRIPTS.index(x) if x else len(SCRIPTS) for _, x in RANGES)])


def groups(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Index in GROUPS of each text: the script of most of its letters (of the first in SCRIPTS if they tie), the guessed
    language if that is Latin, "none" without letters."""
    n = len(bounds) - 1
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = data[lead].astype(np.int64)
    size = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
    code = np.where(size == 1, first, first & (0xFF >> (size + 1)))
    for k in range(1, 4):
        more = size > k
        code[more] = code[more] << 6 | data[lead[more] + k] & 0x3F
    script = _SCRIPT_OF[np.searchsorted(_EDGES, code, side="right")]
    docs = np.repeat(np.arange(n), _per_doc((data & 0xC0) != 0x80, bounds))
    counts = np.bincount(docs * (len(SCRIPTS) + 1) + script, minlength=n * (len(SCRIPTS) + 1)).reshape(n, -1)[:, :-1]
    best = counts.argmax(axis=1)
    out = np.where(best == 0, languages(data, bounds), len(LANGUAGES) - 1 + best)
    return np.where(counts.any(axis=1), out, len(GROUPS) - 1)


def _per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flagged bytes each text has."""
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key occurs twice or more, and whether it equals an earlier one."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    later, several = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    several[order[1:]] |= same
    several[order[:-1]] |= same
    return several, later


def base_counts(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(bounds) - 1
    starts, ends, docs = word_spans(data, bounds)
    n_words = np.bincount(docs, minlength=n)
    first_bytes = (data & 0xC0) != 0x80
    spaces = (data == 32) | ((data >= 9) & (data <= 13))
    out = {
        "n_words": n_words,
        "word_chars": _per_doc(first_bytes & ~spaces, bounds),
        "n_symbols": _per_doc(_SYMBOL[data], bounds),
    }
    # lines with a word, by a hash with the document in it
    cut = data == 10
    begins = np.unique(np.concatenate([np.flatnonzero(cut) + 1, bounds[:-1]]))
    begins = begins[begins < len(data)]
    if len(begins):
        stops = np.concatenate([begins[1:], [len(data)]])
        stops = stops - cut[stops - 1]
        doc = np.searchsorted(bounds, begins, side="right") - 1
        full = np.searchsorted(starts, stops) > np.searchsorted(starts, begins)
        begins, stops, doc = begins[full], stops[full], doc[full]
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=sums[1:])
        lines = mix((sums[stops] - sums[begins]) * powers(INVERSE, len(data))[begins] + (stops - begins).astype(np.uint64) * _ODD)
        out["n_dup_lines"] = np.bincount(doc[_again(mix(lines ^ (doc.astype(np.uint64) * _ODD)))[1]], minlength=n)
    else:
        out["n_dup_lines"] = np.zeros(n, np.int64)
    covered = np.zeros(len(starts) + 1, dtype=np.int64)
    if len(starts) >= WINDOW:
        words = word_hashes(data, starts, ends)
        m = len(words) - WINDOW + 1
        hashes = words[:m].copy()
        for k in range(1, WINDOW):
            hashes *= _ODD
            hashes += words[k : m + k]
        inside = np.flatnonzero(docs[:m] == docs[WINDOW - 1 :])
        found = inside[_again(mix(mix(hashes[inside]) ^ (docs[inside].astype(np.uint64) * _ODD)))[0]]
        np.add.at(covered, found, 1)
        np.add.at(covered, found + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(docs[np.cumsum(covered)[:-1] > 0], minlength=n)
    return out


@lru_cache(maxsize=2)
def _vocabulary(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, np.array([model.is_byte(k) for k in range(model.get_piece_size())])


def fertility(texts: list[str], data: np.ndarray, bounds: np.ndarray, path: str) -> dict[str, np.ndarray]:
    """n_tokens, letters per token, share of byte tokens and entropy of the tokens in bits, of each text."""
    model, is_byte = _vocabulary(path)
    letters = _per_doc(_LETTER[data], bounds)
    tokens, share, entropy = (np.zeros(len(texts)) for _ in range(3))
    for lo in range(0, len(texts), 64):
        for k, ids in enumerate(model.encode(texts[lo : lo + 64], num_threads=1), lo):
            ids = np.sort(np.asarray(ids, dtype=np.int32))
            tokens[k] = len(ids)
            if len(ids):
                share[k] = is_byte[ids].mean()
                counts = np.diff(np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]])))
                part = counts / len(ids)
                entropy[k] = -(part * np.log2(part)).sum()
    return {"n_tokens": tokens.astype(np.int64), "fertility": letters / np.maximum(1, tokens), "byte_share": share, "entropy": entropy}


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens"]
_FIGURES = ["fertility", "byte_share", "entropy"]


def measure(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, language (or script, see :func:`groups`), the counts and the figures of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            data, bounds = text_bytes(batch.column(1))
            found = base_counts(data, bounds) | fertility([x or "" for x in batch.column(1).to_pylist()], data, bounds, vocabulary)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([GROUPS[k] for k in groups(data, bounds).tolist()])]
                + [pa.array(found[k], pa.int64()) for k in _COUNTS]
                + [pa.array(found[k], pa.float64()) for k in _FIGURES],
                ["id", "language", *_COUNTS, *_FIGURES],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, language string, " + ", ".join([f"{k} long" for k in _COUNTS] + [f"{k} double" for k in _FIGURES]))


def _length_class():
    return F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))).cast("int")


def _medians(rows: DataFrame, figure: str, with_class: bool) -> dict[tuple, tuple[float, int]]:
    """Median bin and number of documents of each (group, class)."""
    group = ["language", *(["class"] if with_class else [])]
    counted = rows.groupBy(*group, F.floor(F.col(figure) * BINS).cast("long").alias("bin")).agg(F.count("*").alias("n")).collect()
    bins: dict[tuple, dict[int, int]] = {}
    for r in counted:
        bins.setdefault((r["language"], r["class"] if with_class else None), {})[r["bin"]] = r["n"]
    out = {}
    for key, own in bins.items():
        total, seen = sum(own.values()), 0
        for b in sorted(own):
            seen += own[b]
            if 2 * seen >= total:
                out[key] = ((b + 0.5) / BINS, total)
                break
    return out


def bands(measured: DataFrame) -> list[tuple]:
    """(group, class, least and most fertility, least entropy, most byte share) for every group and class."""
    rows = measured.where(f"n_words >= {LEAST_WORDS}").withColumn("class", _length_class())
    fertile, byte, entropy = (_medians(rows, k, k == "entropy") for k in ("fertility", "byte_share", "entropy"))
    out = []
    for group in GROUPS:
        for size in range(63):
            low, high = FIXED["fertility"]
            bits, share = FIXED["entropy"], FIXED["byte_share"]
            if (group, None) in fertile:
                (mid, n), (part, _) = fertile[group, None], byte[group, None]
                low = max(low, mid * (LOW_FERTILITY - SPREAD / 2 ** (size / 2) - DOUBT["fertility"] / n**0.5))
                high = min(high, mid * (HIGH_FERTILITY + DOUBT["fertility"] / n**0.5))
                share = min(share, part + BYTE_SHARE + DOUBT["byte_share"] / n**0.5)
            if (group, size) in entropy:
                mid, n = entropy[group, size]
                bits = max(bits, mid - ENTROPY_BITS - DOUBT["entropy"] / n**0.5)
            out.append((group, size, low, high, bits, share))
    return out


def quality_report(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, the counts, base_failed, kept, language and the figures."""
    spark = docs.sparkSession
    measured = staged(measure(docs, vocabulary, id_col, text_col), "quality")
    table = spark.createDataFrame(
        bands(measured), "language string, class int, low double, high double, bits double, share double"
    )  # a few hundred rows, whatever the data
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    inside = F.col("fertility").between(F.col("low"), F.col("high")) & (F.col("entropy") >= F.col("bits")) & (F.col("byte_share") <= F.col("share"))
    return (
        measured.withColumn("class", _length_class())
        .join(F.broadcast(table), ["language", "class"], "left")
        .withColumn("base_failed", failed)
        .select(
            F.col("id").alias(id_col), *_COUNTS[:-1], "base_failed", (~failed & F.coalesce(inside, F.lit(True))).alias("kept"), "language", "n_tokens", *_FIGURES
        )
    )
