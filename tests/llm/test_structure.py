"""Divergence of sources, periodic runs and Merkle fingerprints against brute force, on odd documents and a driver table."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pitchspark.llm import divergence, merkle, periodic
from tests.llm.helpers import empty_documents, odd_documents

DOCS = "/root/testdata/sf0.001/documents.parquet"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- divergence of sources ---------------------------------------------------------------------------------------


def brute_divergence(rows, least_docs=10):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = Counter(t.translate(LOW) for t in TERM.findall(text or ""))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs[lang].update(terms.keys())
    out = []
    for lang, source in groups:
        kept = sorted(t for t, n in docs[lang].items() if n >= least_docs)
        names = sorted((s for g, s in groups if g == lang), key=lambda s: s.encode())
        total = Counter()
        for s in names:
            total.update({t: counts[lang, s][t] for t in kept})
        size = lambda c: sum(c[t] for t in kept)
        share = lambda c, t: 1 + 1000000000 * (c[t] + 2) // (size(c) + 2 * len(kept))
        f = lambda p, q: (p - q) * (p - q) // (p + q)
        own = {t: share(counts[lang, source], t) for t in kept}
        pairs = []
        for s in names:
            if s != source:
                other = {t: share(counts[lang, s], t) for t in kept}
                pairs.append((s, sum(f(own[t], other[t]) for t in kept)))
        whole = {t: share(total, t) for t in kept}
        terms = [(t, f(own[t], whole[t])) for t in kept if counts[lang, source][t] > 0 and own[t] > whole[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


def odd_sources(spark):
    rng = random.Random(8)
    words = ["Alpha", "beta", "gamma", "Überß", "delta3eps", "x", "naïve", "zeta", "日本", "A"]
    rows = []
    for k in range(160):
        text = " ".join(rng.choice(words[: 3 + k % 8]) for _ in range(rng.randrange(0, 30)))
        rows.append((k, text, rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "é", "Z", None, "b"])))
    rows += [(1, None, "fr", "q"), (2, "", "fr", "r"), (3, "123 !?", "it", "only"), rows[5], rows[5], (None, "beta " * 5000, "en", "hot")]
    rows += [(900 + k, "beta gamma", "en", "hot") for k in range(80)]
    return spark.createDataFrame([(*r, 7, "clash", 1) for r in rows], "doc_id long, text string, lang string, source string, n long, term string, g int")


@pytest.mark.parametrize("block, tile", [(1024, 256), (3, 2)])
def test_divergence_equals_brute_force(spark, monkeypatch, block, tile):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", block)
    monkeypatch.setattr(divergence, "TILE", tile)
    docs = odd_sources(spark)
    got = sorted(tuple(r) for r in divergence.divergence(docs).collect())
    assert got == brute_divergence([(r.lang, r.source, r.text) for r in docs.collect()])
    assert {r[2] for r in got} == {"pair", "term"} and ("fr", "q", "pair", "r", 0, 1) in got


def test_divergence_of_a_table_and_of_none(spark):
    docs = spark.read.parquet(DOCS)
    got = sorted(tuple(r) for r in divergence.divergence(docs).collect())
    assert got == brute_divergence([(r.lang, r.source, r.text) for r in docs.collect()])
    assert divergence.divergence(empty_documents(spark).selectExpr("*", "node lang", "n source")).count() == 0


def test_shares_are_exact_for_large_counts():
    rng = random.Random(1)
    for _ in range(200):
        total, v = rng.randrange(1, 9 * 10**15), rng.randrange(1, 10**9)
        n = rng.randrange(0, total)
        if (n + 2) * 1000 < 2**63:
            assert int(divergence.shares(np.int64(n), np.int64(total), v)) == 1 + 1000000000 * (n + 2) // (total + 2 * v)


def test_pair_sums_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    a, b = rng.integers(1, 10**9, (7, 40)), rng.integers(1, 10**9, (5, 40))
    whole = ((a[:, None] - b[None]) ** 2 // (a[:, None] + b[None])).sum(axis=2)
    for cells in (1, 11, 60, 10**6):
        monkeypatch.setattr(divergence, "CELLS", cells)
        assert np.array_equal(divergence.pair_sums(a, b), whole)


# --- periodic runs -----------------------------------------------------------------------------------------------


def brute_runs(words):
    found = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            smallest = not any(words[start : start + length - d] == words[start + d : start + length] for d in range(1, q))
            if length >= max(12, 2 * q) and smallest:
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_periodic(doc_id, text, planted):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if planted and doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), s, length, q, length and 1000 * length // q, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(kept)))


def test_word_runs_equal_brute_force():
    rng = random.Random(4)
    for _ in range(1200):
        k, n = rng.choice([1, 2, 2, 3, 5, 40]), rng.randrange(0, 70)
        words = [rng.randrange(k) for _ in range(n)]
        if n > 12 and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + (n - a) // (2 + rng.randrange(8))
            words = words[:a] + [words[a + i % p] for i in range(n - a)]
            if rng.random() < 0.5:
                words[rng.randrange(n)] = 99
        assert periodic.word_runs(np.array(words, dtype=np.int64)) == brute_runs(words)


def test_words_that_hashes_like_least(monkeypatch):
    thue = [bin(i).count("1") % 2 for i in range(4096)]  # equal under sums modulo powers of two
    words = np.array(thue + [1 - x for x in thue], dtype=np.int64)
    squares = sorted(r for r in brute_runs(words[:600].tolist()))
    assert sorted(periodic.word_runs(words[:600])) == squares
    assert all(np.array_equal(words[s : s + n - q], words[s + q : s + n]) for s, n, q in periodic.word_runs(words))
    monkeypatch.setattr(periodic, "BASES", (0, 1, 1_204_391_873_021_771_133))  # bases that fail are found out
    rng = random.Random(9)
    for _ in range(60):
        words = [rng.randrange(3) for _ in range(20)] * 3 + [rng.randrange(3) for _ in range(40)]
        assert periodic.word_runs(np.array(words)) == brute_runs(words)


def test_long_repetitions_take_linear_work():
    assert periodic.word_runs(np.zeros(60_000, dtype=np.int64)) == [(0, 60_000, 1)]
    block = np.random.default_rng(0).integers(0, 1000, 3000)
    assert periodic.word_runs(np.tile(block, 30)) == [(0, 90_000, 3000)]


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_periodic_runs_of_odd_documents(spark, monkeypatch):
    docs = odd_documents(spark).unionByName(
        spark.createDataFrame([(k, "ab cd " * k + "tail", 1, "a", "b") for k in range(40, 90)] + [(91, "\t x y \n" * 30, 1, "a", "b")], odd_documents(spark).schema)
    )
    for plant in (None, periodic.checksum_plant):
        for most in (periodic.JOIN_BYTES, 50):
            monkeypatch.setattr(periodic, "JOIN_BYTES", most)
            expected = order(brute_periodic(r.doc_id, r.text, plant) for r in docs.collect())
            got = periodic.periodic_runs(docs, plant=plant).select(*COLUMNS).collect()
            assert order(tuple(r) for r in got) == expected
    assert periodic.periodic_runs(docs).where(periodic.collapsible(0.5)).where("doc_id = 12").count() == 1
    assert periodic.periodic_runs(empty_documents(spark)).count() == 0


def test_periodic_runs_of_a_table(spark):
    docs = spark.read.parquet(DOCS)
    got = periodic.periodic_runs(docs, plant=periodic.checksum_plant).select(*COLUMNS).collect()
    rows = {r.doc_id: r.text for r in docs.collect()}
    short = {k for k, t in rows.items() if len(t) < 6000}
    assert len(short) > 150 and len(got) == len(rows)
    assert order(tuple(r) for r in got if r.doc_id in short) == order(brute_periodic(k, rows[k], True) for k in short)


# --- Merkle fingerprints -----------------------------------------------------------------------------------------


def brute_order(rows):
    """Rows with the text after each: ascending ids, null ids first."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    return [(i, t or "", rows[(k + 1) % len(rows)][1] or "") for k, (i, t) in enumerate(rows)]


def test_edit_report_of_a_table(spark):
    docs = spark.read.parquet(DOCS)
    got = {r.doc_id: r for r in merkle.edit_report(docs.repartition(5)).collect()}
    rows = brute_order([(r.doc_id, r.text) for r in docs.collect()])
    assert len(got) == len(rows)
    prints, same = {}, 0
    for doc_id, text, following in rows:
        r, half = got[doc_id], len(text) // 2
        made = text[: len(text) - half] + following[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(made.encode()).hexdigest()
        assert r.fingerprint == str(merkle.tree(text)) and r.edited_fingerprint == str(merkle.tree(made))
        assert (r.near_edited == 1) == (made == text) and (r.near_next == 1) == (text == following)
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        same += len(text) > 1000
    assert len(set(prints.values())) == len(prints)
    long = [r for r in got.values() if r.n_chars > 1000]
    assert np.median([r.near_edited for r in long]) > 0.4 and np.median([r.near_next for r in long]) < 0.05


def test_edit_report_of_odd_documents(spark):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = merkle.edit_report(docs).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((i, len(t or "")) for i, t in rows)
    by_id = Counter(i for i, _ in rows)
    texts = dict(rows)
    for doc_id, text, following in brute_order(rows):
        if by_id[doc_id] == 1 and by_id[brute_next := sorted(i for i in texts if i is not None)[0] if doc_id == 16 else doc_id] == 1 and doc_id not in (7, 16):
            r = next(x for x in got if x.doc_id == doc_id)
            assert r.edited_sha256 == hashlib.sha256(merkle.edited(text, following).encode()).hexdigest(), brute_next
    assert merkle.edit_report(empty_documents(spark)).count() == 0
    one = merkle.edit_report(docs.where("doc_id = 16")).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_edit_report_of_one_id(spark):
    """A third of all rows have one id, another third are the same row."""
    rows = [(k, f"text number {k} " * 20) for k in range(200)] + [(77, f"own text {k} " * 20) for k in range(200)] + [(150, "the same row " * 30)] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = merkle.edit_report(docs).collect()
    assert len(got) == 600 and sum(r.near_next == 1 for r in got) == 199
    seen = Counter(r.fingerprint for r in got)
    assert seen[str(merkle.tree("the same row " * 30))] == 200
    # every row is followed by exactly one other: the edited texts' second halves come from every row once
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert len({r.edited_sha256 for r in got}) >= 400


def test_trees_locate_edits():
    rng = random.Random(6)
    docs = [t for t in (" ".join(f"w{rng.randrange(3000)}" + rng.choice(["", "", ".", ".\n", "\n# head\n", "\n\n", " é日"]) for _ in range(rng.randrange(1, 900))) for _ in range(120))]
    touched = []
    for text in docs:
        a = rng.randrange(len(text))
        new = text[:a] + "".join(rng.choice("xyz \né") for _ in range(rng.randrange(0, 30))) + text[a + rng.randrange(0, 30) :]
        left, right = merkle.tree(text), merkle.parse(str(merkle.tree(new)))
        found = merkle.edits(left, right)
        out, at = [], 0
        for s, e, u, v in found:
            out += [text[at:s], new[u:v]]
            at = e
        assert "".join([*out, text[at:]]) == new
        assert (not found) == (left.root == right.root) == (text == new)
        touched.append(sum(e - s for s, e, _, _ in found))
    assert np.median(touched) < 400
    together = merkle.trees([*docs, "", docs[0]])
    assert [str(t) for t in together] == [str(merkle.tree(t)) for t in [*docs, "", docs[0]]]
    assert all(len(merkle.tree(t).pieces) < 100 for t in ("x" * 100_000, "und " * 9000, "é" * 50_000))


def test_fingerprints_as_columns(spark):
    docs = odd_documents(spark)
    prints = merkle.fingerprints(docs)
    assert prints.count() == docs.count() and prints.groupBy(merkle.root(prints.fingerprint)).count().count() == docs.selectExpr("coalesce(text, '')").distinct().count()
    pairs = prints.where("doc_id = 1").selectExpr("fingerprint a").crossJoin(prints.where("doc_id = 4").selectExpr("fingerprint b"))
    found = merkle.compared(pairs.unionByName(spark.createDataFrame([(None, None)], pairs.schema)), "a", "b").collect()
    near = next(r for r in found if r.a)
    assert 0.5 < near.likeness < 1 and len(near.edits) == 1 and next(r for r in found if not r.a).likeness is None


def test_counting_terms_takes_few_times_the_texts_bytes(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    held = []
    monkeypatch.setattr(divergence, "_counted", lambda batches: held.append(sum(b.column(2).nbytes for b in batches)) or iter(()))
    text = "extraordinarily " * 6000
    batch = pa.RecordBatch.from_arrays([pa.array([x] * 80) for x in ("en", "a", text)], names=["lang", "source", "text"])
    list(divergence._count_batches(iter([batch] * 4)))
    assert sum(held) >= 4 * 80 * len(text) and max(held) < 1.2 * divergence.COUNT_BYTES  # gathered, but hardly beyond the bound
    monkeypatch.undo()
    tracemalloc.start()
    list(divergence._counted([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * 80 * len(text)
