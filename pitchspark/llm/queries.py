"""Queries over the whole driver tables, one for each operator, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchspark.llm import divergence, exact_dedup, html_text, merkle, minhash, packing, periodic, quality, sentencepiece_codec, sharding, suffix_dedup, toxicity, url_filter
from pitchspark.llm.common import bounded_batches, staged

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_report(_table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, sha256(norm) AS text_sha256,
         min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
  FROM t
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    docs = _table(spark, sf_dir, "documents")
    return packing.pack(docs, tokenizers.path("byte_bpe_50k.json"), tokenizers.path("byte_bpe_50k.tiktoken"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    return quality.quality_report(_table(spark, sf_dir, "documents"), tokenizers.path("piece_bpe_32k.model"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def _fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` has no fetch time: one each four hours by page_id, over 180 days."""
    at = F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.expr("make_dt_interval(0, CAST(pmod(page_id, 1080) * 4 AS INT))")
    return _table(spark, sf_dir, "pages").select("page_id", "url", at.cast("timestamp_ntz").alias("fetched_at"))


def _code(text: Column) -> Column:
    """A number below 65536 from the MD5 of a text, which SQL engines can say too."""
    return F.conv(F.substring(F.md5(text), 1, 4), 16, 10).cast("int")


def _list_events(captures: DataFrame) -> DataFrame:
    """A dated list for the captures' own hosts: every host and host's first path segment has entries by a checksum."""
    url = url_filter.normal_url(F.col("url"))
    host = F.regexp_extract(url, r"^([^/?]*)", 1)
    first = F.regexp_extract(url, r"^([^/?]*/[^/?]+)", 1)
    kind = F.when(_code(host) % 2 == 0, "domain").otherwise("host")
    made = captures.select(F.lit("hosts").alias("list"), kind.alias("kind"), host.alias("pattern")).unionByName(
        captures.select(F.lit("paths").alias("list"), F.lit("prefix").alias("kind"), first.alias("pattern"))
    )
    made = made.where("pattern != ''").distinct().withColumn("code", _code(F.col("pattern"))).where("code % 4 != 3")
    made = staged(made, "url-patterns")  # three kinds of events are made from it
    day = lambda n: (F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.expr(f"make_dt_interval(CAST({n} AS INT))")).cast("timestamp_ntz")
    added, removed, again = day("code % 90"), day("code % 90 + 20 + code % 31"), day("code % 90 + 80")
    event = lambda rows, action, at: rows.select("list", "kind", "pattern", F.lit(action).alias("action"), at.alias("at"))
    return (
        event(made, "add", added)
        .unionByName(event(made.where("code % 3 != 0"), "remove", removed))
        .unionByName(event(made.where("code % 6 = 1"), "add", again))
    )


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = _fetched(spark, sf_dir)
    return url_filter.judge(captures, _list_events(captures))


OP8_SQL = r"""
WITH p AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST((page_id % 1080) * 4 AS INTEGER)) AS fetched_at,
         regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://', ''), '#.*$', '') AS rest FROM pages
), a AS (
  SELECT *, regexp_extract(rest, '^([^/?]*)', 1) AS authority FROM p
), h AS (
  SELECT *, lower(regexp_replace(regexp_replace(regexp_replace(authority, '^.*@', ''), ':[0-9]*$', ''), '\.$', '')) AS host,
         substring(rest, length(authority) + 1) AS tail FROM a
), n AS (
  SELECT page_id, url, fetched_at, host, CASE WHEN host <> '' THEN
         host || regexp_replace(regexp_extract(tail, '^([^?]*)', 1), '/+$', '') || regexp_extract(tail, '(\?.*)$', 1) END AS normal_url FROM h
), patterns AS (
  SELECT DISTINCT 'hosts' AS list, host AS pattern, CASE WHEN CAST('0x' || substr(md5(host), 1, 4) AS INTEGER) % 2 = 0 THEN 'domain' ELSE 'host' END AS kind
  FROM n WHERE host <> ''
  UNION ALL
  SELECT DISTINCT 'paths', regexp_extract(normal_url, '^([^/?]*/[^/?]+)', 1) AS first, 'prefix' FROM n WHERE regexp_extract(normal_url, '^([^/?]*/[^/?]+)', 1) <> ''
), coded AS (
  SELECT *, CAST('0x' || substr(md5(pattern), 1, 4) AS INTEGER) AS code FROM patterns
), e AS (
  SELECT list, kind, pattern, 'add' AS action, TIMESTAMP '2024-01-01 00:00:00' + to_days(code % 90) AS moment FROM coded WHERE code % 4 <> 3
  UNION ALL
  SELECT list, kind, pattern, 'remove', TIMESTAMP '2024-01-01 00:00:00' + to_days(code % 90 + 20 + code % 31) FROM coded WHERE code % 4 <> 3 AND code % 3 <> 0
  UNION ALL
  SELECT list, kind, pattern, 'add', TIMESTAMP '2024-01-01 00:00:00' + to_days(code % 90 + 80) FROM coded WHERE code % 4 <> 3 AND code % 6 = 1
), spans AS (
  SELECT list, kind, pattern, action, moment AS since, lead(moment) OVER (PARTITION BY list, kind, pattern ORDER BY moment) AS until FROM e
), hits AS (
  SELECT n.page_id, n.url, n.fetched_at, s.list, s.kind, s.pattern, s.since
  FROM n JOIN spans s ON s.action = 'add' AND n.fetched_at >= s.since AND (s.until IS NULL OR n.fetched_at < s.until)
   AND (s.kind = 'host' AND n.host = s.pattern
     OR s.kind = 'domain' AND (n.host = s.pattern OR ends_with(n.host, '.' || s.pattern))
     OR s.kind = 'prefix' AND (split_part(n.normal_url, '?', 1) = s.pattern OR starts_with(split_part(n.normal_url, '?', 1), s.pattern || '/')))
), judged AS (
  SELECT page_id, url, fetched_at, count(DISTINCT list || ' ' || kind || ' ' || pattern) AS n_entries, string_agg(DISTINCT list, ',' ORDER BY list) AS lists,
         arg_min(list || ':' || kind || ':' || pattern, list || ' ' || kind || ' ' || pattern) AS rule, arg_min(since, list || ' ' || kind || ' ' || pattern) AS since
  FROM hits GROUP BY ALL
)
SELECT n.page_id, n.url, n.fetched_at, n.normal_url, coalesce(j.n_entries, 0) AS n_entries, coalesce(j.lists, '') AS lists, j.rule, j.since,
       coalesce(j.n_entries, 0) > 0 AS blocked
FROM n LEFT JOIN judged j USING (page_id, url, fetched_at)
"""


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and checksum of every text's ids, and the checksum of what they decode to."""
    import public_tokenizers as tokenizers

    found = sentencepiece_codec.encode(_table(spark, sf_dir, "documents"), tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_tokens", "n_byte_tokens", F.crc32("tokens").alias("ids_crc32"), F.crc32("decoded").alias("decoded_crc32"))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    labels, docs = _table(spark, sf_dir, "labels"), _table(spark, sf_dir, "documents")
    return toxicity.train_on(docs, labels, ~toxicity.held_out(F.col("doc_id")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(_table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return found.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", F.col("flagged").cast("int").alias("predicted")
    )


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT doc) >= 10
), langs AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY ALL
), c AS (
  SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL
), sizes AS (
  SELECT lang, source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL
), p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (s.n + 2 * l.v) AS p,
         1 + 1000000000::HUGEINT * (k.n + 2) // (l.n + 2 * l.v) AS q
  FROM sizes s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM sizes a JOIN sizes b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(_table(spark, sf_dir, "documents"), plant=periodic.checksum_plant).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words", "n_dropped"
    )


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_report(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_sharding": op2_sharding,
    "op3_packing": op3_packing,
    "op4_html_text": op4_html_text,
    "op5_quality_rules": op5_quality_rules,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_url_filters": op8_url_filters,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_toxicity": op10_toxicity,
    "op11_divergence": op11_divergence,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_merkle": op13_merkle,
}

ORACLE_SQL: dict[str, str] = {"op1_exact_dedup": OP1_SQL, "op8_url_filters": OP8_SQL, "op11_divergence": OP11_SQL}
