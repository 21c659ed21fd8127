"""Toxicity scores from a convolutional text classifier, trained in numpy.

A word becomes the sum of three hashed embeddings: of the word and of its first four and six bytes, so inflected and
compound forms share weight. Filters of several widths run over all words of a text, each filter's largest response
counts, and a logistic layer joins them. Training takes every labelled row: the rows are dealt by a hash of id and text into
shards of bounded size, whose number grows with them. In each round every shard trains a copy of the weights in a task of its
own, and what the copies changed is averaged in Spark (federated averaging); a single shard takes all its epochs in one round.
``NETS`` networks are trained, each without another part of the rows; a score is the mean of their logits. The part that a
network hasn't seen gives its logits for the thresholds, counted over all rows by hundredths: each language has its own,
drawn towards the common one where it has few toxic examples. Scores are shifted so that every language's threshold is ``CUT``.
The language is guessed from the letters of the text, so nothing but the text enters a score.
Scoring reads whole texts, in slices of bounded memory.

Defined cases: null and empty texts get the score of a text without words. Labels that are null, or whose id has no
document, teach nothing; an id with several labels or documents teaches each pair. Without toxic or without clean
examples every score is 0. Rows that repeat each get their score. An empty table gives an empty result. Only the named
columns are read, so others can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchspark.llm.common import LOWER, text_batches, text_bytes, word_prefix_hashes, word_spans
from pitchspark.staging import release, shared_side, staged

#: Examples and bytes of their words' rows that a shard has about; a task holds twice as much at once at most.
SHARD_ROWS, SHARD_BYTES = 6_000, 24_000_000
#: Rounds over all rows if there are several shards, and pieces of the weights that are averaged apart.
ROUNDS, PIECES = 3, 16
BUCKETS, DIMENSIONS, WIDTHS, FILTERS = 1 << 15, 16, (1, 2, 3), 8
PREFIXES = (None, 4, 6)
#: A row of the embedding; two bytes hold them all, the padding too.
ROW = np.uint16
EPOCHS, LEAST_STEPS, BATCH, RATE, DECAY, DROPPED = 8, 600, 32, 0.1, 1e-5, 0.3
#: Networks, each trained without one of as many parts of the rows.
NETS = 3
#: A language's threshold weighs as many examples as it has toxic ones, the common threshold this many.
COMMON = 30
#: Thresholds have the best F score with recall weighed this much; cuts this near to the best one count as equal, and the
#: threshold is in their middle.
BETA, PLATEAU = 1.5, 0.01
CUT = 0.7
#: Words of one step of scoring.
STEP = 100_000

LANGUAGES = ("en", "de", "fr", "es")
#: Second bytes of the letters (first byte C3) that set a language apart.
LETTERS = {"de": "äöüßÄÖÜ", "fr": "àâçèêëîïôùûÀÇÈÊ", "es": "ñáíóúÑÁÍÓÚ"}


@dataclass
class Net:
    embedding: np.ndarray  # BUCKETS + 1 rows; the last is zero and stands for padding
    filters: list[np.ndarray]  # for each width: (width * DIMENSIONS, FILTERS)
    bias: np.ndarray
    weights: np.ndarray
    constant: float = 0.0


@dataclass
class Model:
    nets: list[Net]  # none without examples of both labels
    shifts: np.ndarray  # of the logit, by language

    def scores(self, rows: np.ndarray, per_doc: np.ndarray, language: np.ndarray) -> np.ndarray:
        if not self.nets:
            return np.zeros(len(per_doc))
        logits = sum(logits_of(net, rows, per_doc) for net in self.nets) / len(self.nets)
        return 1 / (1 + np.exp(-np.clip(logits - self.shifts[language] + np.log(CUT / (1 - CUT)), -30, 30)))


# --- text to numbers ---------------------------------------------------------------------------------------------


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the embedding for every word, (words, len(PREFIXES)), and the number of words of each text."""
    starts, ends, docs = word_spans(data, bounds)
    hashed = word_prefix_hashes(LOWER[data], starts, ends, PREFIXES)
    rows = np.empty((len(starts), len(PREFIXES)), ROW)
    for k, h in enumerate(hashed):
        rows[:, k] = (h >> np.uint64(20)) % np.uint64(BUCKETS)
    return rows, np.bincount(docs, minlength=len(bounds) - 1)


def languages(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Index in LANGUAGES, from the accented letters; texts without a word's worth of them are taken for the first."""
    n = len(bounds) - 1
    counts = np.zeros((n, len(LANGUAGES)))
    lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) > 1 else np.empty(0, np.int64)
    docs = np.searchsorted(bounds, lead, side="right") - 1
    for k, name in enumerate(LANGUAGES):
        if name in LETTERS:
            second = np.zeros(256, dtype=bool)
            second[[x.encode()[1] for x in LETTERS[name]]] = True
            counts[:, k] = np.bincount(docs[second[data[lead + 1]]], minlength=n)
    counts[:, 0] = np.diff(bounds) * 0.004
    return counts.argmax(axis=1)


def pooled(model: Net, rows: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
    """The largest response of each filter in each text (0 if none is positive)."""
    n, last = len(per_doc), max(WIDTHS) - 1
    # the words of all texts one after another, each text followed by padding that no window reaches across
    total = int(per_doc.sum()) + n * last
    begins = np.cumsum(per_doc + last) - (per_doc + last)
    place = np.arange(per_doc.sum()) + np.repeat(begins - (np.cumsum(per_doc) - per_doc), per_doc)
    stream = np.full((total, len(PREFIXES)), BUCKETS, dtype=ROW)
    stream[place] = rows
    out = np.zeros((n, len(WIDTHS) * FILTERS), dtype=np.float32)
    docs = np.repeat(np.arange(n), per_doc + last)
    for lo in range(0, total, STEP):
        hi = min(total, lo + STEP)
        some = stream[lo : min(total, hi + last)]
        x = model.embedding[some[:, 0]]
        for k in range(1, len(PREFIXES)):
            x = x + model.embedding[some[:, k]]
        at = np.flatnonzero(stream[lo:hi, 0] != BUCKETS)
        if not len(at):
            continue
        owner = docs[lo:hi][at]
        heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        padded = np.concatenate([x, np.zeros((last, DIMENSIONS), np.float32)]) if len(some) < hi - lo + last else x
        for k, (width, f) in enumerate(zip(WIDTHS, model.filters)):
            seen = sum(padded[j : j + hi - lo] @ f[j * DIMENSIONS : (j + 1) * DIMENSIONS] for j in range(width))[at]
            best = np.maximum.reduceat(seen, heads, axis=0) + model.bias[k * FILTERS : (k + 1) * FILTERS]
            part = out[:, k * FILTERS : (k + 1) * FILTERS]
            part[owner[heads]] = np.maximum(part[owner[heads]], best)
    return out


def logits_of(net: Net, rows: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
    return pooled(net, rows, per_doc) @ net.weights + net.constant


# --- training ----------------------------------------------------------------------------------------------------


#: Rows after each text, so that no window reaches into the next one.
PAD = np.full((max(WIDTHS) - 1, len(PREFIXES)), BUCKETS, dtype=ROW)


def _new_net(rng: np.random.Generator) -> Net:
    embedding = rng.normal(0, 0.02, (BUCKETS + 1, DIMENSIONS)).astype(np.float32)
    embedding[BUCKETS] = 0
    filters = [rng.normal(0, (w * DIMENSIONS) ** -0.5, (w * DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
    n = len(WIDTHS) * FILTERS
    return Net(embedding, filters, np.zeros(n, np.float32), rng.normal(0, 0.3, n).astype(np.float32))


def _learn(model: Net, texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, rates: np.ndarray, rng: np.random.Generator) -> None:
    """An epoch for each of ``rates``; ``texts`` end with ``PAD``. Adagrad on the logistic loss; only windows that gave a largest response get a
    gradient. A part of the embeddings is left out at random in each step, so that no single word of a text is relied on."""
    last = len(PAD)
    seen = {k: np.full(v.shape, 1e-3, np.float32) for k, v in (("e", model.embedding), ("b", model.bias), ("w", model.weights))}
    seen_f = [np.full(f.shape, 1e-3, np.float32) for f in model.filters]
    seen_c, n_filters = 1e-3, len(model.weights)
    for rate in rates.tolist():
        for chosen in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // BATCH)):
            some = np.concatenate([texts[i] for i in chosen])
            some[rng.random(some.shape, np.float32) < DROPPED] = BUCKETS
            x = model.embedding[some].sum(axis=1)
            top = np.zeros((len(chosen), n_filters), np.float32)
            where = np.zeros((len(chosen), n_filters), np.int64)
            ends = np.cumsum([len(texts[i]) for i in chosen])
            for k, (width, f) in enumerate(zip(WIDTHS, model.filters)):
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                length = len(x) - last
                response = sum(x[j : j + length] @ f[j * DIMENSIONS : (j + 1) * DIMENSIONS] for j in range(width))
                for d, (a, b) in enumerate(zip([0, *ends[:-1]], ends - last)):
                    if b > a:
                        where[d, own] = a + response[a:b].argmax(axis=0)
                        top[d, own] = response[where[d, own], np.arange(FILTERS)] + model.bias[own]
            active = top > 0
            top *= active
            error = (1 / (1 + np.exp(-(top @ model.weights + model.constant))) - labels[chosen]) * weight[chosen] / len(chosen)
            back = (error[:, None] * model.weights * active).astype(np.float32)
            steps = [("w", model.weights, top.T @ error + DECAY * model.weights), ("b", model.bias, back.sum(axis=0))]
            grad_x = np.zeros_like(x)
            for k, (width, f) in enumerate(zip(WIDTHS, model.filters)):
                g = back[:, k * FILTERS : (k + 1) * FILTERS]
                at = where[:, k * FILTERS : (k + 1) * FILTERS]
                grad_f = np.zeros_like(f)
                for j in range(width):
                    part = slice(j * DIMENSIONS, (j + 1) * DIMENSIONS)
                    grad_f[part] = np.einsum("nfd,nf->df", x[at + j], g)
                    np.add.at(grad_x, (at + j).ravel(), (g[:, :, None] * f[part].T[None]).reshape(-1, DIMENSIONS))
                seen_f[k] += grad_f**2
                f -= rate * grad_f / np.sqrt(seen_f[k])
            for name, value, grad in steps:
                seen[name] += (grad**2).astype(np.float32)
                value -= (rate * grad / np.sqrt(seen[name])).astype(np.float32)
            seen_c += float(error.sum()) ** 2
            model.constant -= rate * float(error.sum()) / seen_c**0.5
            rows = np.flatnonzero(grad_x.any(axis=1))
            touched, back_to = np.unique(some[rows].ravel(), return_inverse=True)
            grad_e = np.zeros((len(touched), DIMENSIONS), np.float32)
            np.add.at(grad_e, back_to.reshape(-1), np.repeat(grad_x[rows], len(PREFIXES), axis=0))
            grad_e[touched == BUCKETS] = 0
            seen["e"][touched] += grad_e**2
            model.embedding[touched] -= rate * grad_e / np.sqrt(seen["e"][touched])


def _threshold(logits: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> float:
    """In the middle between the cuts whose F score is the best or near it."""
    values, at = np.unique(-logits, return_inverse=True)
    hit = np.cumsum(np.bincount(at, weights=counts * (labels == 1)))
    score = (1 + BETA**2) * hit / (np.cumsum(np.bincount(at, weights=counts)) + BETA**2 * max(1, hit[-1]))
    good = np.flatnonzero(score >= score.max() - PLATEAU)
    high, low = -values[good[0]], -values[min(good[-1] + 1, len(values) - 1)]
    return float((high + low) / 2) if good[-1] + 1 < len(values) else float(low - 1)


def _flat(net: Net) -> np.ndarray:
    return np.concatenate([x.ravel() for x in (net.embedding, *net.filters, net.bias, net.weights, np.array([net.constant]))]).astype(np.float32)


def _net_of(flat: np.ndarray) -> Net:
    sizes = [(BUCKETS + 1) * DIMENSIONS, *[w * DIMENSIONS * FILTERS for w in WIDTHS], len(WIDTHS) * FILTERS, len(WIDTHS) * FILTERS]
    embedding, *filters, bias, weights, constant = np.split(flat.astype(np.float32), np.cumsum(sizes))
    return Net(embedding.reshape(BUCKETS + 1, DIMENSIONS), [f.reshape(-1, FILTERS) for f in filters], bias, weights, float(constant[0]))


@dataclass
class _Block:
    net: int
    shard: int
    number: int  # within the shard
    label: np.ndarray
    language: np.ndarray
    turn: np.ndarray  # which network doesn't see the row
    texts: list[np.ndarray]  # with PAD


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    """The rows (net, shard, label, language, rows) of each net and shard, in their order, as blocks of bounded size: a shard
    is larger than one only if an example repeats very often."""
    held: list[tuple] = []
    owner, number, size = None, 0, 0

    def block() -> _Block:
        label, language = (np.array([r[k] for r in held]) for k in (0, 1))
        turn = np.where(label == 1, np.cumsum(label == 1), np.cumsum(label != 1)) - 1
        return _Block(*owner, number, label, language, turn % NETS, [np.concatenate([np.frombuffer(r[2], ROW).reshape(-1, len(PREFIXES)), PAD]) for r in held])

    for batch in batches:
        for net, shard, label, language, body in zip(*[c.to_pylist() for c in batch.columns]):
            full = len(held) >= 2 * SHARD_ROWS or size + len(body) > 2 * SHARD_BYTES
            if held and (full or owner != (net, shard)):
                yield block()
                number, held, size = number + 1 if owner == (net, shard) else 0, [], 0
            owner = (net, shard)
            held.append((label, language, body))
            size += len(body)
    if held:
        yield block()


#: What a block changed of a network: for each piece of the flat weights one row.
_CHANGE_TYPES = "net int, piece int, shard int, number int, n long, change binary"


def _round(nets: list[np.ndarray], weigh: tuple[float, float], now: int, rounds: int, seed: int):
    """A function over rows of :func:`_blocks`: each block trains on from ``nets``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            fit = np.flatnonzero(b.turn != b.net)
            fit = fit if len(fit) else np.arange(len(b.turn))
            epochs = max(EPOCHS, LEAST_STEPS * BATCH // len(fit)) if rounds == 1 else 1
            net, label = _net_of(nets[b.net]), b.label[fit]
            rates = RATE * (1 - (now + np.arange(epochs) / epochs) / rounds)
            _learn(net, [b.texts[i] for i in fit], label, np.where(label == 1, weigh[1], weigh[0]), rates, np.random.default_rng([seed, b.net, now, b.shard, b.number]))
            pieces = [x.tobytes() for x in np.array_split(_flat(net) - nets[b.net], PIECES)]
            same = [pa.array([v] * PIECES, k) for v, k in ((b.net, pa.int32()), (b.shard, pa.int32()), (b.number, pa.int32()), (len(fit), pa.int64()))]
            yield pa.RecordBatch.from_arrays([same[0], pa.array(range(PIECES), pa.int32()), *same[1:], pa.array(pieces, pa.binary())], ["net", "piece", "shard", "number", "n", "change"])

    return run


def _averaged(table: pa.Table) -> pa.Table:
    """The mean change of one piece over the blocks, by their rows; a weight that a block left as it was doesn't count there, so
    that the embedding of a rare word isn't thinned by shards without it."""
    table = table.sort_by([("shard", "ascending"), ("number", "ascending")])
    total = weight = 0.0
    for n, body in zip(table.column("n").to_pylist(), table.column("change")):
        change = np.frombuffer(body.as_buffer(), np.float32).astype(np.float64)
        total, weight = total + n * change, weight + n * (change != 0)
    mean = (total / np.maximum(weight, 1)).astype(np.float32)
    return pa.Table.from_arrays([table.column("net")[:1], table.column("piece")[:1], pa.array([mean.tobytes()], pa.binary())], names=["net", "piece", "change"])


def _unseen(nets: list[np.ndarray]):
    """A function over rows of :func:`_blocks`: the logits of the rows that the block's network hasn't seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            kept = np.flatnonzero(b.turn == b.net)
            if len(kept):
                bodies = [b.texts[i][: -len(PAD)] for i in kept]
                found = logits_of(_net_of(nets[b.net]), np.concatenate(bodies), np.array([len(x) for x in bodies]))
                yield pa.RecordBatch.from_arrays([pa.array(b.label[kept], pa.int32()), pa.array(b.language[kept], pa.int32()), pa.array(found, pa.float64())], ["label", "language", "logit"])

    return run


def train(rows: DataFrame, seed: int = 11) -> Model:
    """``rows``: turn and mark (hashes that order them), label, language and rows of :func:`features`, staged. All of them are
    learned from; what comes to the driver is the mean weights of each round and counts of logits by hundredths."""
    model = Model([], np.zeros(len(LANGUAGES)))
    seen = {r.label: r for r in rows.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.octet_length("rows")).alias("bytes")).collect()}
    if len(seen) < 2:
        return model
    n = sum(r.n for r in seen.values())
    weigh = (n / seen[0].n / 2, n / seen[1].n / 2)  # both labels weigh the same
    shards = max(1, -(-n // SHARD_ROWS), -(-sum(r.bytes for r in seen.values()) // SHARD_BYTES))
    dealt = rows.repartition(shards, "turn", "mark").sortWithinPartitions("turn", "mark", "label")
    dealt = staged(dealt.select(F.spark_partition_id().alias("shard"), "label", "language", "rows"), "toxicity-shards")
    every = reduce(DataFrame.unionByName, [dealt.select(F.lit(k).alias("net"), "*") for k in range(NETS)])
    nets = [_flat(_new_net(np.random.default_rng(seed + k))) for k in range(NETS)]
    rounds = ROUNDS if shards > 1 else 1
    for now in range(rounds):
        changes = every.mapInArrow(_round(nets, weigh, now, rounds, seed), _CHANGE_TYPES)
        mean = changes.groupBy("net", "piece").applyInArrow(_averaged, "net int, piece int, change binary").collect()
        for k in range(NETS):
            nets[k] = nets[k] + np.concatenate([np.frombuffer(r.change, np.float32) for r in sorted((r for r in mean if r.net == k), key=lambda r: r.piece)])
    logits = every.mapInArrow(_unseen(nets), "label int, language int, logit double")
    hundredth = F.round(F.greatest(F.least("logit", F.lit(30.0)), F.lit(-30.0)), 2)
    counts = logits.groupBy("label", "language", hundredth.alias("logit")).agg(F.count("*").alias("n")).collect()
    release(dealt)
    model.nets = [_net_of(x) for x in nets]
    labels, language, unseen, number = (np.array([r[c] for r in counts], dtype=float) for c in ("label", "language", "logit", "n"))
    common = _threshold(unseen, labels, number)
    for k in range(len(LANGUAGES)):
        own = language == k
        toxic = int(number[own & (labels == 1)].sum())
        model.shifts[k] = (toxic * _threshold(unseen[own], labels[own], number[own]) + COMMON * common) / (toxic + COMMON) if toxic else common
    return model


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_batches(batches):
        data, bounds = text_bytes(batch.column(1))
        rows, per_doc = features(data, bounds)
        ends = np.cumsum(per_doc)
        bodies = [rows[b - k : b].tobytes() for b, k in zip(ends.tolist(), per_doc.tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(languages(data, bounds), pa.int32()), pa.array(bodies, pa.binary())], ["turn", "mark", "label", "language", "rows"])


def train_on(docs: DataFrame, labels: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the rows of ``labels`` for which ``use`` (over its id column) holds."""
    known = labels.where(use).where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    turn = F.xxhash64(F.col("id").cast("string"))
    known, _ = shared_side(known)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = texts.join(known, "id").select(turn.alias("turn"), "text", F.xxhash64("text").alias("mark"), "label")
    rows = staged(found.mapInArrow(_feature_batches, "turn long, mark long, label int, language int, rows binary"), "toxicity-rows")
    model = train(rows)
    release(rows)
    return model


# --- scoring -----------------------------------------------------------------------------------------------------


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score (0 to 1), language (guessed from the text), flagged (score at least ``CUT``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            data, bounds = text_bytes(batch.column(1))
            rows, per_doc = features(data, bounds)
            language = languages(data, bounds)
            found = model.scores(rows, per_doc, language)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.float64()), pa.array([LANGUAGES[k] for k in language.tolist()]), pa.array(found >= CUT)],
                ["id", "score", "language", "flagged"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, score double, language string, flagged boolean").withColumnRenamed("id", id_col)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels never teach: a third, by a checksum of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def drop_toxic(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the flagged rows. Columns may have any names."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, column=at):
            data, bounds = text_bytes(batch.column(at))
            rows, per_doc = features(data, bounds)
            found = model.scores(rows, per_doc, languages(data, bounds))
            yield batch.filter(pa.array(found < CUT))

    return docs.mapInArrow(run, docs.schema)
