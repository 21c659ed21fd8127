import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pitchspark.llm import exact_dedup, minhash, suffix_dedup
from tests.llm.helpers import empty_documents, odd_documents

WHITE = re.compile(r"[\x20\x09-\x0D]+")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_exact_dedup_equals_brute_force(spark):
    docs = odd_documents(spark)
    groups = defaultdict(list)
    for i, text in pairs(docs):
        groups[WHITE.sub(" ", text or "")].append(i)
    want = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    found = [tuple(r) for r in exact_dedup.dedup_report(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_exact_dedup_keeps_columns(spark):
    docs = odd_documents(spark)
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= {1, 4, 5, 8, 9} and 2 not in {r["doc_id"] for r in kept.collect()}
    assert exact_dedup.exact_dedup(empty_documents(spark)).count() == exact_dedup.dedup_report(empty_documents(spark)).count() == 0


def test_exact_dedup_drops_by_row(spark):
    """Unique texts stay whatever happens to their id, null ids too; of equal rows one stays."""
    extra = [(None, "unique, no id"), (None, "null twice"), (None, "null twice"), (20, "mine alone"), (20, "two words"), (21, "again"), (21, "again"), (21, " again"), (None, " again")]
    docs = odd_documents(spark).unionByName(spark.createDataFrame([(a, b, 1, "c", f"d{k}") for k, (a, b) in enumerate(extra)], odd_documents(spark).schema))
    groups = defaultdict(list)
    for i, text in pairs(docs):
        groups[WHITE.sub(" ", text or "")].append(i)
    want = Counter((min((i for i in ids if i is not None), default=None), text) for text, ids in groups.items())
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert Counter((i, WHITE.sub(" ", text or "")) for i, text in pairs(kept)) == want
    assert (None, "no id at all") in want and (20, "mine alone") in want


def shingles(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows):
    """Smallest id reachable; rows with a null id are linked with nothing."""
    sets = [(i, shingles(t)) for i, t in rows]
    known = [(i, s) for i, s in sets if i is not None and s]
    parent = {i: i for i, _ in known}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(known):
        for j, b in known[:k]:
            both = len(a & b)
            if 100 * both >= 75 * (len(a) + len(b) - both):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [(i, len(s), None if i is None else find(i) if i in parent else i) for i, s in sets]


@pytest.mark.parametrize("block", [256, 3])
def test_minhash_equals_brute_force(spark, monkeypatch, block):
    """Also with blocks so small that groups need the second pass."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    import random

    rng = random.Random(2)
    base = [f"b{k}" for k in range(80)]
    extra = []
    for k in range(40):  # a chain of copies with ever more edits, most too far from the first
        words = list(base)
        for _ in range(k % 7):
            words[rng.randrange(80)] = f"e{rng.randrange(1000)}"
        extra.append((100 + k, " ".join(words), 1, "c", "d"))
    docs = odd_documents(spark).unionByName(spark.createDataFrame(extra, odd_documents(spark).schema))
    found = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()]
    assert sorted(found, key=repr) == sorted(brute_components(pairs(docs)), key=repr)


def test_sketch_agrees_as_often_as_sets_overlap():
    import numpy as np

    rng = np.random.default_rng(1)
    for shared in (0, 500, 900):
        rates = []
        for _ in range(30):
            x = rng.integers(0, 2**63, 2000 - shared, dtype=np.uint64)
            a, b = np.sort(x[:1000]), np.sort(x[1000 - shared : 2000 - shared])
            rows = minhash.sketches(np.concatenate([a, b]), np.array([0, 1000, 2000]))
            assert not (rows == np.uint64(2**64 - 1)).any()
            rates.append((rows[0] == rows[1]).mean())
        assert abs(np.mean(rates) - shared / (2000 - shared)) < 0.03
    one = minhash.sketches(np.array([7], dtype=np.uint64), np.array([0, 1]))  # one element fills every coordinate
    assert not (one == np.uint64(2**64 - 1)).any()


def test_minhash_second_pass_pairs_only_what_shares_rare_shingles(spark, monkeypatch):
    """A large group of texts alike but below the threshold, with a few near copies among them: rows of the second pass are
    those of the copies alone."""
    import random

    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(31)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for k in range(400):  # about 0.7 alike: buckets meet, links don't
        own = [f"u{k}x{j}" for j in range(24)]
        rows.append((k, " ".join(base + own)))
    for k in range(400, 430):  # pairs of near copies
        own = [f"u{k - k % 2}x{j}" for j in range(24)]
        rows.append((k, " ".join(base + own + ([f"z{k}"] if k % 2 else []))))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shipped = []
    compare = minhash._compare
    monkeypatch.setattr(minhash, "_compare", lambda d, placed, tasks: (shipped.append(placed.count()), compare(d, placed, tasks))[1])
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert found == {k: k if k < 400 else k - k % 2 for k in found} and len(found) == 430
    assert len(shipped) < 2 or shipped[1] <= 2 * minhash.BANDS * 30  # the copies alone, in two roles for each pivot at most


def test_minhash_recall_at_the_threshold(spark):
    """Pairs at a similarity just at or above 0.75, planted among the documents of a whole table: all are found."""
    import random

    rng = random.Random(77)
    rows = []
    for k in range(400):
        n = rng.randrange(40, 200)
        words = [f"p{k}w{j}" for j in range(n)]
        shingles = n - 4
        new = int(shingles / 7)  # replaced at the end: (s - new) / (s + new) is 0.75 or a little more
        rows += [(10**9 + 2 * k, " ".join(words)), (10**9 + 2 * k + 1, " ".join([*words[: n - new], *[f"q{k}w{j}" for j in range(new)]]))]
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).where(f"doc_id >= {10**9}").collect()}
    assert sum(found[10**9 + 2 * k] == found[10**9 + 2 * k + 1] for k in range(400)) == 400


def test_components_after_more_edges(spark):
    """As if all edges had been there from the start, also for nodes that had none, chains of components and loops."""
    import random

    rng = random.Random(8)
    draw = lambda n, low, high: [(rng.randrange(low, high), rng.randrange(low, high)) for _ in range(n)]
    some, more = draw(60, 0, 100), [*draw(25, 0, 130), (140, 139), (139, 141), (5, 5)]
    frame = lambda edges: spark.createDataFrame(edges, "a long, b long")
    pairs = lambda df: sorted((r.id, r.component) for r in df.collect() if r.id != r.component)
    found = minhash._with_edges(minhash.components(frame(some)), frame(more))
    assert found.count() == found.select("id").distinct().count()
    assert pairs(found) == pairs(minhash.components(frame(some + more)))


def test_minhash_empty(spark):
    assert minhash.near_duplicates(empty_documents(spark)).count() == 0
    kept = minhash.near_dedup(odd_documents(spark))
    assert kept.columns == odd_documents(spark).columns and kept.where("doc_id = 4").count() == 0 and kept.where("doc_id IS NULL").count() == 2


def test_near_dedup_drops_by_row(spark):
    """An id with a near copy and a text of its own keeps the latter, and links nothing by it."""
    import random

    rng = random.Random(4)
    prose = lambda: [f"n{rng.randrange(10_000)}" for _ in range(100)]
    a, b, c = prose(), prose(), prose()
    near = lambda words: " ".join([*words[:50], "changed", *words[51:]])
    rows = [(1, " ".join(a)), (2, near(a)), (2, " ".join(b)), (3, near(b)), (3, " ".join(c)), (4, near(c)), (5, "short"), (6, None), (None, near(a)), (None, "short"), (7, " ".join(a)), (7, " ".join(a))]
    docs = spark.createDataFrame([(i, t, 1, "c", "d") for i, t in rows], empty_documents(spark).schema)
    kept = minhash.near_dedup(docs)
    assert kept.columns == docs.columns
    assert Counter(pairs(kept)) == Counter([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c)), (5, "short"), (6, None), (None, near(a)), (None, "short")])


def brute_repeats(docs):
    """Rows in order of (id, null first; hash of the text); rows equal in both are one document."""
    rows = suffix_dedup.keyed(docs, "doc_id", "text").withColumn("own_id", suffix_dedup.own_id())
    keyed = [(r.own_id, (r.id, r.mark), (r.text or "").encode()) for r in rows.collect()]
    texts = {key: body for _, key, body in keyed}
    seen, out = set(), {}
    for key in sorted(texts):
        body = texts[key]
        gone = bytearray(len(body))
        for k in range(len(body) - 99):
            window = body[k : k + 100]
            if window in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(window)
        spans = sum(1 for k in range(len(body)) if gone[k] and not (k and gone[k - 1]))
        left = bytes(c for c, g in zip(body, gone) if not g)
        out[key] = (len(body), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return Counter((i, *out[key]) for i, key, _ in keyed)


@pytest.mark.parametrize(("hot", "slices"), [(20_000, 500_000), (1, 701)])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, hot, slices):
    """Also where every minimiser counts as hot, and where texts are cut in small slices."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", slices)
    docs = odd_documents(spark)
    found = suffix_dedup.remove_repeats(docs).collect()
    assert Counter(tuple(r) for r in found) == brute_repeats(docs)


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_dedup_counts_a_repeated_row_once(spark, monkeypatch, hot):
    """Its pieces that others share, and periodic text, stay where they stand first."""
    import random

    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(9)
    prose = lambda n: " ".join(f"v{rng.randrange(10_000)}" for _ in range(n))
    shared = prose(60)
    row, other, periodic = f"{prose(50)} {shared} {prose(50)}", f"{prose(40)} {shared} {prose(20)}", "abcde " * 200
    extra = [(30, row), (31, other), (30, row), (32, periodic), (32, periodic), (30, row)]
    docs = odd_documents(spark).unionByName(spark.createDataFrame([(a, b, 1, "c", "d") for a, b in extra], odd_documents(spark).schema))
    found = [tuple(r) for r in suffix_dedup.remove_repeats(docs).collect()]
    assert Counter(found) == brute_repeats(docs)
    assert {r[2] for r in found if r[0] == 30} == {0}


def test_suffix_dedup_over_many_batches_of_a_task(spark):
    """One task reads the rows in batches of three, in an order that is not that of the ids."""
    docs = odd_documents(spark)
    docs = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") - 10)).orderBy(F.crc32("text")).coalesce(1)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(size, "3")
    try:
        found = suffix_dedup.remove_repeats(docs).collect()
    finally:
        spark.conf.unset(size)
    assert Counter(tuple(r) for r in found) == brute_repeats(docs)


def test_pieces_of_a_frequent_passage_leave_a_task_once():
    """Of a passage in every batch, the first and what stands before it are fresh; all others are ranges of repeats."""
    import random

    import pyarrow as pa

    rng = random.Random(6)
    prose = lambda n: " ".join(f"v{rng.randrange(10_000)}" for _ in range(n))
    shared = prose(50)
    ids = [5, 6, 3, 4, 7, 8, 1, 2, 9, 10]
    texts = {i: f"{prose(30)} {shared} {prose(30)}" for i in ids}
    names = ["id", "mark", "text"]
    batches = [pa.RecordBatch.from_arrays([pa.array(some), pa.array([0, 0]), pa.array([texts[i] for i in some])], names) for some in zip(ids[::2], ids[1::2])]
    rows = [r for b in suffix_dedup._pieces(iter(batches)) for r in b.to_pylist()]
    inside = lambda r: texts[r["id"]].find(shared) <= r["start"] <= texts[r["id"]].find(shared) + len(shared) - 150
    fresh = {}
    for r in rows:
        if r["fresh"]:
            fresh.setdefault(r["content"], []).append(r["id"])
        else:
            body = texts[r["id"]][r["start"] : r["start"] + r["wins"] + 99]
            assert any(body in texts[i] for i in ids if i < r["id"])
    assert {tuple(x) for x in fresh.values() if len(x) > 1} == {(5, 3, 1)}
    assert {r["id"] for r in rows if r["fresh"] and inside(r)} == {1, 3, 5}


def test_suffix_dedup_of_many_rows_without_an_id(spark):
    """Each row's ranges are gathered for itself; the least long is an id like others."""
    import random

    rng = random.Random(21)
    prose = lambda n: " ".join(f"v{rng.randrange(10_000)}" for _ in range(n))
    shared = prose(40)
    rows = [(None, f"{prose(8)} {shared} {prose(8)}") for _ in range(1500)] + [(-(1 << 63), f"{shared} {prose(5)}"), (None, f"{shared} {prose(5)}"), (-(1 << 63), shared), (None, shared)]
    docs = spark.createDataFrame([(i, t, 1, "c", "d") for i, t in rows], empty_documents(spark).schema).repartition(5)
    found = suffix_dedup.remove_repeats(docs).collect()
    assert Counter(tuple(r) for r in found) == brute_repeats(docs)
    assert sum(r.doc_id is None for r in found) == 1502 and sum(r.n_removed == 0 for r in found) == 1


def test_run_index_streams_true_prefixes():
    import numpy as np

    rng = np.random.default_rng(3)
    text = np.concatenate([rng.integers(2, 5, 300), rng.integers(2, 5, 20).repeat(3), [1], np.tile([2, 3], 60), [0]]).astype(np.int16)
    order, heads, length = suffix_dedup.run_index(text)
    body = text.tolist()
    assert order.tolist() == sorted(range(len(body)), key=lambda k: body[k:])
    prefix = suffix_dedup.matching_lengths(order, heads, length)[order]
    for k in range(1, len(body)):
        a, b = body[order[k] :], body[order[k - 1] :]
        assert prefix[k] == next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_cut_documents(spark):
    docs = odd_documents(spark)
    out = {r["doc_id"]: r for r in suffix_dedup.cut_documents(docs, length_col="id").where("doc_id IS NOT NULL").collect()}
    assert suffix_dedup.cut_documents(docs).columns == docs.columns
    assert out[2]["text"] == "" and out[2]["id"] == 0 and out[5]["text"] is None and out[5]["id"] == 99
    assert suffix_dedup.cut_documents(empty_documents(spark)).count() == suffix_dedup.remove_repeats(empty_documents(spark)).count() == 0
