"""Exact deduplication by progressive refinement: length, then a hash of the prefix, then a hash of the whole text.

One pass over the texts gives each row its length and prefix hash; these narrow columns are staged, and each level only
looks at rows whose group at the level before has two rows or more. The stage :func:`exact_dedup` reads full content again
for the survivors of the second level alone. The report needs the digest of every row, so it takes it in the first pass
and refines over the staged columns without reading a text again. Everything is DataFrame code.

Defined cases: a null text counts as empty, and empty texts form one group. Rows with a null id stay only if no row of
their group has an id. In the report, rows that repeat the kept id all count as kept (it can't tell them apart by id);
``exact_dedup`` returns one of them. An empty table gives an empty result. Other columns decide nothing but which of
those rows it is, and their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchspark.llm.common import WHITE, small, staged, text_of

#: Characters of the normalised text that the second level hashes.
PREFIX_CHARS = 64


def _norm(text_col: str) -> Column:
    return F.regexp_replace(text_of(text_col), WHITE, " ")


def _raw(text_col: str) -> Column:
    """Names a text as it stands among those of one id."""
    return F.xxhash64(text_of(text_col))


def signatures(docs: DataFrame, id_col: str, text_col: str, digest: bool) -> DataFrame:
    """id, raw, len and pre of every row, with ``digest`` its text_sha256 too: one pass over the texts, staged."""
    rows = docs.select(F.col(id_col).alias("id"), _raw(text_col).alias("raw"), _norm(text_col).alias("norm"))
    sha = [F.sha2("norm", 256).alias("text_sha256")] if digest else []
    pre = F.xxhash64(F.substring("norm", 1, PREFIX_CHARS))
    return staged(rows.select("id", "raw", F.length("norm").alias("len"), pre.alias("pre"), *sha), "dedup-rows")


def survivors(rows: DataFrame) -> DataFrame:
    """The rows of :func:`signatures` that share length and prefix hash with another."""
    # one length may be that of a third of all rows: its rows stay where they are while the list of lengths is small
    lengths, _ = small(staged(rows.groupBy("len").agg(F.count("*").alias("n")).where("n > 1").select("len"), "dedup-lengths"))
    prefixes = rows.join(lengths, "len", "left_semi").groupBy("len", "pre").agg(F.count("*").alias("n")).where("n > 1")
    prefixes, _ = small(staged(prefixes.select("len", "pre"), "dedup-prefixes"))
    return rows.join(prefixes, ["len", "pre"], "left_semi")


def _groups(rows: DataFrame) -> DataFrame:
    """text_sha256, keep_id and group_size of the groups of two rows or more; a table, so that a join with it can split."""
    groups = rows.groupBy("text_sha256").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    return staged(groups.where("group_size > 1"), "dedup-groups")


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256 (of the normalised text, lowercase hex)."""
    rows = signatures(docs, id_col, text_col, digest=True)
    groups, _ = small(_groups(survivors(rows)))
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return rows.join(groups, "text_sha256", "left").select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one row of each group of equal texts: that with the smallest id.

    Rows go by id and text, so other texts under a dropped id (or under no id) stay. Of several rows with the kept id, that
    with the smallest columns stays, taken in their order.
    """
    found = survivors(signatures(docs, id_col, text_col, digest=False)).select(F.col("id").alias("__id"), F.col("raw").alias("__raw"))
    found, _ = small(staged(found.distinct(), "dedup-survivors"))
    marked = docs.withColumn("__own_raw", _raw(text_col))
    same = lambda other: marked[id_col].eqNullSafe(other["__id"]) & (marked["__own_raw"] == other["__raw"])
    full = marked.join(found, same(found)).select(F.col("__id").alias("id"), F.col("__raw").alias("raw"), F.sha2(_norm(text_col), 256).alias("text_sha256"))
    full = staged(full.groupBy("id", "raw", "text_sha256").agg(F.count("*").alias("n")), "dedup-full")
    groups = full.groupBy("text_sha256").agg(F.min("id").alias("keep_id"), F.sum("n").alias("size")).where("size > 1")
    members = full.join(groups, "text_sha256").withColumn("keep", F.col("id").eqNullSafe(F.col("keep_id")))
    members = staged(members.select(F.col("id").alias("__id"), F.col("raw").alias("__raw"), F.col("text_sha256").alias("__sha"), "keep", "n"), "dedup-members")
    dropped, _ = small(members.where("NOT keep").select("__id", "__raw"))
    several = members.where("keep").groupBy("__sha").agg(F.sum("n").alias("rows")).where("rows > 1").select("__sha")
    doubled = staged(members.where("keep").join(several, "__sha").select("__id", "__raw", "__sha"), "dedup-doubled")

    kept = marked.join(dropped, same(dropped), "left_anti")
    if doubled.isEmpty():
        return kept.drop("__own_raw")
    doubled, _ = small(doubled)
    once = kept.join(doubled, same(doubled), "left_anti").drop("__own_raw")
    sortable = [F.col(f"`{f.name}`") for f in docs.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    least = marked.join(doubled, same(doubled)).groupBy("__sha").agg(F.min_by(whole, F.struct(*sortable)).alias("__row"))
    return once.unionByName(least.select("__row.*"))
