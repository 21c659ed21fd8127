"""SentencePiece encoding and decoding on the ``tokenizers`` library.

The model file is parsed as a protobuf message (pieces, trainer and normaliser settings), and a tokenizer is rebuilt from
it: the normaliser's own replacements, the dummy prefix and the metaspace marker, then either unigram scores or, for
models of kind BPE, merges ranked by the pieces' scores, with byte fallback. A text is only cut before a run of markers if
no piece of the model reaches across such a place, so the cut changes nothing and known words come from a cache. Batches
are encoded with ``THREADS`` of the library's threads in each Python worker, since Spark fills the cores with tasks already.
Parity with the ``sentencepiece`` library is verified when a model is loaded on a
probe of its own pieces and a few hard texts, and by :func:`parity` over any table.

Defined cases: null and empty texts have no tokens and decode to the empty text; ids that repeat or are null get their
rows; an empty table gives an empty result. Decoding ignores control pieces and turns invalid bytes into U+FFFD. Columns
other than id and text are not read, so their names can't clash.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchspark.llm.common import text_batches

MARK = "▁"
# Fixed values of the message: kinds of model and of pieces.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Texts of one call to the library, and its threads in one Python worker (an environment's own setting stays).
CALL, THREADS = 256, 2


@dataclass
class Spec:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unknown: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    suffix_marks: bool = False


def _fields(message: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protobuf message: an int, or the bytes of what has a length or a fixed size. A message that
    ends within a field is an error."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            if at >= len(message):
                raise ValueError("the model file is cut off")
            byte = message[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(message):
        key, at = number(at)
        wire = key & 7
        if wire == 0:
            value, at = number(at)
        elif wire in (1, 2, 5):
            size, at = number(at) if wire == 2 else (8 if wire == 1 else 4, at)
            if at + size > len(message):
                raise ValueError("the model file is cut off")
            value, at = message[at : at + size], at + size
        else:
            raise ValueError(f"a field of wire type {wire} isn't in this format")
        yield key >> 3, value


def parse_model(message: bytes) -> Spec:
    spec = Spec()
    for number, value in _fields(message):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for k, v in _fields(value):
                if k == 1:
                    piece = v.decode()
                elif k == 2:
                    score = struct.unpack("<f", v)[0]
                elif k == 3:
                    kind = v
            spec.pieces.append((piece, score, kind))
        elif number == 2:
            own = dict(_fields(value))
            spec.kind, spec.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
            spec.unknown, spec.suffix_marks = own.get(40, 0), bool(own.get(24, 0))
        elif number == 3:
            own = dict(_fields(value))
            spec.charsmap, spec.dummy_prefix = own.get(2, b""), bool(own.get(3, 1))
            spec.squeeze, spec.escape = bool(own.get(4, 1)), bool(own.get(5, 1))
    return spec


def _merges(spec: Spec, vocabulary: dict[str, int]) -> list[tuple[str, str]]:
    """Every way to make a piece of two others; better scores first."""
    usable = {p for p, _, kind in spec.pieces if kind in (NORMAL, USER_DEFINED)}
    found = []
    for piece, score, kind in spec.pieces:
        if kind in (NORMAL, USER_DEFINED):
            for k in range(1, len(piece)):
                if piece[:k] in usable and piece[k:] in usable:
                    found.append((-score, vocabulary[piece], vocabulary[piece[:k]], vocabulary[piece[k:]], (piece[:k], piece[k:])))
    return [x[-1] for x in sorted(found)]


def build(spec: Spec):
    """The ``tokenizers`` tokenizer of a parsed model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if spec.kind not in (UNIGRAM, BPE) or spec.suffix_marks or not spec.escape:
        raise ValueError("models of kind word or char, and other marker settings, aren't supported")
    vocabulary = {p: k for k, (p, _, _) in enumerate(spec.pieces)}
    if spec.kind == BPE:
        unknown = spec.pieces[spec.unknown][0]
        model = models.BPE(vocabulary, _merges(spec, vocabulary), unk_token=unknown, fuse_unk=True, byte_fallback=spec.byte_fallback)
    else:
        least = min((s for _, s, kind in spec.pieces if kind == NORMAL), default=0.0)
        # pieces that never match a text get a score that no path would choose
        scored = [(p, s if kind in (NORMAL, USER_DEFINED, UNKNOWN) else least - 1000.0) for p, s, kind in spec.pieces]
        model = models.Unigram(scored, spec.unknown, spec.byte_fallback)
    out = Tokenizer(model)
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.squeeze:
        # spaces alone, no other white space; at the end a marker in the text counts as one
        steps += [normalizers.Replace(Regex(x), y) for x, y in ((r"\A +", ""), (rf"[ {MARK}]+\z", ""), (" {2,}", " "))]
    if spec.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    cuts = []
    if not any(MARK in p.lstrip(MARK) for p, _, kind in spec.pieces if kind in (NORMAL, USER_DEFINED)):
        cuts.append(pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated"))
    if spec.kind == UNIGRAM:  # the library would take a control or byte piece's name in a text for the piece
        names = [re.escape(p[1:]) for p, _, kind in spec.pieces if kind in (CONTROL, UNKNOWN, BYTE, UNUSED) and p.startswith("<")]
        cuts.append(pre_tokenizers.Split(Regex(f"<(?={'|'.join(names) or '$^'})"), "isolated"))
    if cuts:
        out.pre_tokenizer = pre_tokenizers.Sequence(cuts)
    out.add_tokens([AddedToken(p, normalized=True) for p, _, kind in spec.pieces if kind == USER_DEFINED])
    ends = [decoders.Strip(" ", 1, 0)] if spec.dummy_prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *ends])
    return out


@dataclass
class Codec:
    spec: Spec
    tokenizer: object

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __post_init__(self) -> None:
        self.bytes = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in self.spec.pieces]
        self.other = frozenset(k for k, (_, _, kind) in enumerate(self.spec.pieces) if kind not in (NORMAL, BYTE))
        self.silent = frozenset(k for k, (_, _, kind) in enumerate(self.spec.pieces) if kind == CONTROL)

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of ids. Normal pieces and bytes that make valid UTF-8 are joined; all else (control pieces, broken bytes)
        goes through the library's decoder."""
        out = [self._joined(x) for x in ids]
        if self.spec.dummy_prefix:
            out = [x[1:] if x is not None and x[:1] == " " else x for x in out]
        rest = [k for k, x in enumerate(out) if x is None]
        found = self.tokenizer.decode_batch([[i for i in ids[k] if i not in self.silent] for k in rest], skip_special_tokens=False)
        for k, x in zip(rest, found):
            out[k] = x
        return out

    def _joined(self, ids: list[int]) -> str | None:
        if not self.other.isdisjoint(ids):
            return None
        try:
            return b"".join([self.bytes[i] for i in ids]).decode()
        except UnicodeDecodeError:
            return None


#: Texts that differ where a rebuilt model would be wrong: spaces, markers, line ends, scripts, bytes outside the pieces.
HARD = ["", " ", "  two  spaces ", "a\nb\tc\r\n", MARK, f"x{MARK}y", "don't U.S.A. 1,234.50", "éèß ñ Привет 漢字 かな עברית", "\U0001f600 ‍﻿", "<s> </s> <unk> <0x41>", "aaaaaaaaaaaa", "\x00\x7f"]


@lru_cache(maxsize=2)
def load(path: str) -> Codec:
    """The codec of a model file that every worker can read; fails if it doesn't agree with ``sentencepiece`` on a probe."""
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))  # read when the library's threads start
    import sentencepiece

    with open(path, "rb") as f:
        message = f.read()
    codec = Codec(spec := parse_model(message), build(parse_model(message)))
    known = sentencepiece.SentencePieceProcessor(model_proto=message)
    plain = [p.replace(MARK, " ") for p, _, kind in spec.pieces if kind == NORMAL]
    probe = [*HARD, *("".join(plain[k : k + 20]) for k in range(0, len(plain), 400)), *(" ".join(plain[k : k + 20]) for k in range(0, len(plain), 400))]
    ids = codec.encode(probe)
    for text, own, theirs, back, their_back in zip(probe, ids, known.encode(probe), codec.decode(ids), known.decode(ids)):
        if not agree(spec, own, theirs) or back != their_back:
            raise ValueError(f"the rebuilt tokenizer differs from sentencepiece on {text!r}")
    return codec


def agree(spec: Spec, own: list[int], theirs: list[int]) -> bool:
    """Whether two encodings are the same, or, for unigram models, the same pieces in an order of equal score: the libraries
    add scores in other precisions, so they break such ties differently."""
    return own == theirs or spec.kind == UNIGRAM and sorted(own) == sorted(theirs)


def _summary(ids: list[list[int]], byte: np.ndarray) -> tuple[list[int], list[int], list[bytes]]:
    arrays = [np.asarray(x, dtype="<u4") for x in ids]
    return [len(x) for x in arrays], [int(byte[x].sum()) for x in arrays], [x.tobytes() for x in arrays]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_byte_tokens, tokens (little-endian unsigned 32-bit ids) and decoded, the text of those ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(model_path)
        byte = np.array([kind == BYTE for _, _, kind in codec.spec.pieces])
        for batch in text_batches(batches):
            for lo in range(0, len(batch), CALL):
                part = batch.slice(lo, CALL)
                ids = codec.encode([x or "" for x in part.column(1).to_pylist()])
                count, bytes_, tokens = _summary(ids, byte)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(count, pa.int64()), pa.array(bytes_, pa.int64()), pa.array(tokens, pa.binary()), pa.array(codec.decode(ids), pa.string())],
                    ["id", "n_tokens", "n_byte_tokens", "tokens", "decoded"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, n_byte_tokens long, tokens binary, decoded string").withColumnRenamed("id", id_col)


def decode(rows: DataFrame, model_path: str, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """id and text of rows with ``tokens`` as :func:`encode` gives them; null tokens decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(model_path)
        for batch in batches:
            for lo in range(0, len(batch), CALL):
                part = batch.slice(lo, CALL)
                ids = [np.frombuffer(x or b"", dtype="<u4").tolist() for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(codec.decode(ids), pa.string())], ["id", "text"])

    tokens = rows.select(F.col(id_col).alias("id"), F.col(tokens_col).alias("tokens"))
    kind = tokens.schema["id"].dataType.simpleString()
    return tokens.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def parity(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows (id) on which ids or decoded text differ from those of ``sentencepiece``; none should."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        codec = load(model_path)
        known = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for batch in text_batches(batches):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            ids = codec.encode(texts)
            same = [agree(codec.spec, a, b) and c == d for a, b, c, d in zip(ids, known.encode(texts), codec.decode(ids), known.decode(ids))]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array([not x for x in same]))], ["id"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}").withColumnRenamed("id", id_col)
