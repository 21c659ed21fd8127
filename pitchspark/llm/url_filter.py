"""URL filtering against dated lists: entries become validity intervals, captures are judged as of their fetch time.

A list is a log of events: a pattern is added to a list or removed from it at some time. Of one list, kind and pattern,
each "add" opens an interval that the next event closes. Kinds: ``url`` (the whole normalised URL), ``host`` (that host
alone), ``domain`` (the host or any host below it) and ``prefix`` (host and path, up to a segment's end). A capture turns
into the few keys that could match it: its URL, host, parent domains and path prefixes, no deeper than the deepest entry.
An equality join on kind and key with the interval as a further condition finds the active entries; it is a broadcast
join while the counted list is small, and else a shuffled one whose hot keys adaptive execution splits. Everything is
DataFrame code.

Normalised: scheme, user, port and fragment go, host in lower case without a final dot, no ``/`` at the end of the path;
the query stays for ``url`` and goes for ``prefix``. A host may be an IPv6 address in brackets.

Defined cases: a null, empty or hostless URL and a null time match nothing and are not blocked; events with a null in
list, kind, pattern, time or action are ignored; of several events of a pattern at one time the removal counts. Captures
that repeat get a row each, with the same result. Empty tables on either side work. Extra columns are not read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitchspark.llm.common import small, staged

#: Rows of the interval table that may be broadcast.
BROADCAST_ENTRIES = 200_000


#: Scheme, user, host, port, path without its last slashes, query, fragment; the groups are host, path and query.
_URL = r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*://)?(?:[^/?#]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\s]*[^/?#:@\s.])\.?(?::[0-9]*)?((?:/[^?#]*[^/?#])?)/*((?:\?[^#]*)?)(?:#.*)?$"


def normal_url(url: Column) -> Column:
    """``host/path?query``; null if there is no host."""
    host = F.regexp_extract(url, _URL, 1)
    return F.when(host != "", F.concat(F.lower(host), F.regexp_extract(url, _URL, 2), F.rtrim(F.regexp_extract(url, _URL, 3))))


def intervals(events: DataFrame) -> DataFrame:
    """list, kind, pattern, since, until (null: still active) from events (list, kind, pattern, action, at)."""
    known = events.select("list", "kind", "pattern", F.lower("action").alias("action"), "at").dropna()
    # of several events at one time one counts: the removal
    last = known.groupBy("list", "kind", "pattern", "at").agg(F.max("action").alias("action"))
    following = Window.partitionBy("list", "kind", "pattern").orderBy("at")
    return (
        last.withColumn("until", F.lead("at").over(following))
        .where("action = 'add'")
        .select("list", "kind", "pattern", F.col("at").alias("since"), "until")
    )


def capture_keys(url: Column, depth: Column) -> Column:
    """The (kind, key) pairs of a normalised URL; prefixes have ``depth`` path segments at most."""
    page = F.regexp_extract(url, r"^([^?]*)", 1)
    parts = F.split(page, "/")
    host = F.element_at(parts, 1)
    labels = F.split(host, r"\.")
    pair = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: pair("domain", F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    deep = F.least(F.size(parts) - 1, depth)
    prefixes = F.transform(
        F.when(deep >= 1, F.sequence(F.lit(1), deep)).otherwise(F.array().cast("array<int>")),
        lambda i: pair("prefix", F.array_join(F.slice(parts, 1, i + 1), "/")),
    )
    return F.concat(F.array(pair("url", url), pair("host", host)), domains, prefixes)


def judge(captures: DataFrame, events: DataFrame, key_cols: tuple[str, ...] = ("page_id",), url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """One row per capture: key columns, URL, time, normal_url, n_entries active at that time, lists (their names, sorted,
    joined by commas), rule (the first entry by list, kind and pattern), since (when that one was added), blocked."""
    entries = staged(intervals(events), "url-intervals")
    table, _ = small(entries, BROADCAST_ENTRIES)
    # the deepest prefix of the list: one number
    depth = entries.where("kind = 'prefix'").agg(F.coalesce(F.max(F.size(F.split("pattern", "/")) - 1), F.lit(0)).alias("d")).first()["d"]
    rows = captures.select(*key_cols, F.col(url_col).alias("url"), F.col(time_col).alias("fetched_at")).withColumn("normal_url", normal_url(F.col("url")))
    mark = ["normal_url", "fetched_at"]
    keys = rows.dropna(subset=mark).select(*mark, F.explode(capture_keys(F.col("normal_url"), F.lit(depth))).alias("k")).select(*mark, "k.*")
    active = (
        keys.join(table.withColumnRenamed("kind", "entry_kind"), (F.col("kind") == F.col("entry_kind")) & (F.col("key") == F.col("pattern")))
        .where((F.col("fetched_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until"))))
        .select(*mark, "list", "kind", "pattern", "since")
    )
    hits = active.groupBy(*mark).agg(
        F.sort_array(F.collect_set(F.struct("list", "kind", "pattern", "since"))).alias("entries")
    )
    first = F.element_at("entries", 1)
    return rows.join(hits, mark, "left").select(
        *key_cols,
        "url",
        "fetched_at",
        "normal_url",
        F.coalesce(F.size("entries"), F.lit(0)).cast("long").alias("n_entries"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform("entries", lambda e: e["list"]))), ","), F.lit("")).alias("lists"),
        F.concat(first["list"], F.lit(":"), first["kind"], F.lit(":"), first["pattern"]).alias("rule"),
        first["since"].alias("since"),
        F.coalesce(F.size("entries") > 0, F.lit(False)).alias("blocked"),
    )
