"""Small documents with every odd case: nulls, empty and short texts, copies, repeated rows, ids that repeat or are null."""

import random

SCHEMA = "doc_id long, text string, id long, n string, node string"


def prose(rng, words, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def odd_documents(spark):
    rng = random.Random(5)
    base, passage = prose(rng, 120), prose(rng, 60, 10_000)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base),
        (2, base),
        (3, base.replace(" ", "\n\t", 3)),
        (4, " ".join(near)),
        (5, None),
        (6, ""),
        (7, "   "),
        (8, "two words"),
        (9, "Two WORDS"),
        (10, f"{prose(rng, 30)} {passage} {prose(rng, 30)}"),
        (11, f"{prose(rng, 40)} {passage}"),
        (12, "und " * 400),
        (13, "x" * 3000),
        (None, base),
        (None, "no id at all"),
        (8, "two words"),
        (14, f"{passage} {passage}"),
        (15, "é" * 150 + " ß" + "é" * 150),
        (16, prose(rng, 3000)),
    ]
    return spark.createDataFrame([(a, b, 99, "clash", "clash") for a, b in rows], SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)
