"""Scans of nested JSON feeds into typed tables, and partitioned Parquet sinks.

Schemas are declared, never inferred. Maps keyed by id become rows by exploding; ids stay strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = (
    "struct<id:string,competitionId:bigint,team1:string,team2:string,team1Id:bigint,team2Id:bigint,status:string,eventStartTime:bigint,"
    "date:string,redCards:array<string>,extraTime:boolean,penalties:boolean,betMarketsCount:int>"
)
FEED = (
    f"struct<events:map<string,{EVENT}>,eventsBySport:map<string,array<string>>,"
    "scores:map<string,struct<currentScore:array<string>,htScore:array<string>>>,"
    "sportCompetitionMap:map<string,array<struct<groupId:bigint,groupIdString:string,name:string,parentName:string>>>>"
)
DETAIL = (
    "struct<event:struct<id:string>,oddGroups:map<string,struct<id:string,caption:string,type:string,fixedParam:string,status:string>>,"
    "oddGroupResultsMap:map<string,array<bigint>>,"
    "results:map<string,struct<id:string,caption:string,choiceParam:string,quote:string,quoteFloatValue:double,status:string>>>"
)
DAILY = "struct<leagues:array<struct<id:string,name:string,ccode:string,matches:array<struct<id:string,home:struct<id:string,name:string>,away:struct<id:string,name:string>,status:struct<utcTime:string,finished:boolean>>>>>>"


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path and text. Files are whole documents; many small ones should be compacted first."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))


def _goal(values: Column, side: int) -> Column:
    return F.try_element_at(values, F.lit(side)).try_cast("int")


def events_of_feed(documents: DataFrame, feed: str = "live", root: str = "LIVE", sport: str = "soccer", payload: str = "payload") -> DataFrame:
    """One row per event of a sport: names, score, half-time score (the score itself during the break if none is given),
    competition, kickoff. Unknown flags stay null. Broken documents give no rows."""
    doc = F.from_json(payload, f"{root} {FEED}")[root]
    rows = documents.select(*[c for c in documents.columns if c != payload], doc.alias("d")).where("d.events IS NOT NULL")
    listed = F.try_element_at("d.eventsBySport", F.lit(sport))
    entries = F.filter(F.map_entries("d.events"), lambda e: listed.isNull() | F.array_contains(listed, e["key"]))
    competitions = F.try_element_at("d.sportCompetitionMap", F.lit(sport))
    rows = rows.select("*", competitions.alias("_competitions"), F.explode(entries).alias("_entry"))
    event, score = F.col("_entry.value"), F.try_element_at("d.scores", F.col("_entry.key"))
    competition = F.try_element_at(F.filter("_competitions", lambda c: c["groupId"] == F.col("_entry.value.competitionId")), F.lit(1))
    now, half = score["currentScore"], score["htScore"]
    pause = event["date"] == "HZ"
    with_half = F.coalesce(half, F.when(pause, now))
    return rows.select(
        *[c for c in documents.columns if c != payload],
        F.lit(feed).alias("feed"),
        F.col("_entry.key").alias("event_id"),
        event["team1"].alias("home"),
        event["team2"].alias("away"),
        event["status"].alias("status"),
        event["date"].alias("clock"),
        F.timestamp_millis(event["eventStartTime"]).alias("kickoff"),
        competition["name"].alias("competition"),
        competition["parentName"].alias("country"),
        _goal(now, 1).alias("home_score"),
        _goal(now, 2).alias("away_score"),
        _goal(with_half, 1).alias("home_ht"),
        _goal(with_half, 2).alias("away_ht"),
        event["extraTime"].alias("extra_time"),
        event["penalties"].alias("penalties"),
        F.coalesce(event["betMarketsCount"], F.lit(0)).alias("markets"),
    )


CLOSED = ("paused", "stopped", "suspended", "closed")


def outcomes_of_detail(documents: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per outcome of each market of an event-detail document: markets of either map, in order; outcomes that the
    document doesn't hold get a row with their id alone. ``available``: open, with a quote above one. A market without a status
    of its own is paused if it has outcomes and none of them is available, else open."""
    doc = F.from_json(payload, DETAIL)
    kept = [c for c in documents.columns if c != payload]
    rows = documents.select(*kept, doc.alias("d"))  # without a filter, for which the document would be parsed again
    keys = lambda m: F.coalesce(F.map_keys(m), F.array().cast("array<string>"))
    rows = rows.select("*", F.explode(F.array_distinct(F.concat(keys("d.oddGroups"), keys("d.oddGroupResultsMap")))).alias("market_id"))
    market = F.try_element_at("d.oddGroups", F.col("market_id"))
    ids = F.array_distinct(F.coalesce(F.try_element_at("d.oddGroupResultsMap", F.col("market_id")), F.array().cast("array<bigint>")))

    def outcome(i):
        x = F.try_element_at("d.results", i.cast("string"))
        status = F.lower(F.coalesce(x["status"], F.lit("open")))
        return F.struct(i.cast("string").alias("outcome_id"), x["caption"].alias("caption"), x["choiceParam"].alias("choice"), x["quoteFloatValue"].alias("odds"), status.alias("status"), (~status.isin(*CLOSED) & F.coalesce(x["quoteFloatValue"] > 1, F.lit(False))).alias("available"))

    rows = rows.withColumn("_o", F.transform(ids, outcome)).withColumn("_m", market)
    idle = (F.size("_o") > 0) & ~F.exists("_o", lambda x: x["available"])
    state = F.lower(F.coalesce("_m.status", F.when(idle, "paused").otherwise("open")))
    rows = rows.withColumn("market_status", state).select("*", F.explode("_o").alias("o"))
    return rows.select(
        *kept, F.col("d.event.id").alias("event_id"), "market_id", F.col("_m.type").alias("market_type"), F.col("_m.fixedParam").alias("parameter"), "market_status", "o.outcome_id", "o.caption", "o.choice", "o.odds", "o.status",
        (F.col("o.available") & ~F.col("market_status").isin(*CLOSED)).alias("available"),
    )


def matches_of_daily(documents: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per match entry of a daily fixture document, with its place; of entries with one id the first has ``first`` true."""
    from pyspark.sql.window import Window

    kept = [c for c in documents.columns if c != payload]
    rows = documents.withColumn("_doc", F.xxhash64(payload)).select("_doc", *kept, F.posexplode(F.from_json(payload, DAILY)["leagues"]).alias("group_place", "l"))
    rows = rows.select("*", F.posexplode("l.matches").alias("match_place", "m"))
    first = F.row_number().over(Window.partitionBy("_doc", *kept, "m.id").orderBy("group_place", "match_place")) == 1
    return rows.select(
        *kept,
        "group_place",
        "match_place",
        first.alias("first"),
        F.col("l.id").alias("league_id"),
        F.col("l.name").alias("league"),
        F.col("l.ccode").alias("country"),
        F.col("m.id").alias("match_id"),
        F.col("m.home.name").alias("home"),
        F.col("m.away.name").alias("away"),
        F.try_to_timestamp("m.status.utcTime").alias("kickoff"),
        F.col("m.status.finished").alias("finished"),
    )


def read_archive(spark: SparkSession, path: str, columns: list[str], schema: str) -> DataFrame:
    """The wanted columns of a Hive-partitioned Parquet archive; columns that old files lack are null, partitions strings."""
    table = spark.read.option("mergeSchema", "false").schema(schema).parquet(path)
    return table.select(*columns)


def new_payloads(stored: DataFrame, incoming: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """Payloads whose hash isn't that of the latest stored one of their key (stored: keys, observed_at, payload_hash)."""
    from pitchspark.operators.joins import latest_by

    hashed = incoming.withColumn("payload_hash", F.sha2(payload, 256))
    latest = latest_by(stored.select(*keys, "observed_at", "payload_hash"), keys, ["observed_at"]).select(*keys, "payload_hash")
    return hashed.join(latest, [*keys, "payload_hash"], "left_anti")


def summary_of_daily(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of a daily feed: groups, entries, distinct matches, repeated ones, entries without an id."""
    known = F.col("match_id").isNotNull()
    found = matches.groupBy(*keys).agg(
        F.count_distinct("league_id").alias("groups"), F.count("*").alias("entries"), F.count_distinct("match_id").alias("matches"), F.count_if(known).alias("_known"), F.count_if(~known).alias("invalid")
    )
    return found.withColumn("repeated", F.col("_known") - F.col("matches")).drop("_known")


def _existing(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def write_archive(df: DataFrame, path: str, partition: list[str], keys: list[str] | None = None, target_rows: int = 2_000_000) -> None:
    """Partitioned Parquet without a file per match: rows of a partition meet in few tasks, hot ones are split by rebalancing.

    With ``keys``, only rows whose keys the archive lacks are added (the first of rows that repeat), so doing it again adds
    nothing. A write that breaks off leaves no file that readers see."""
    if keys:
        df = df.dropDuplicates(keys)
        if _existing(df.sparkSession, path):
            old = df.sparkSession.read.schema(df.schema).parquet(path).select(*keys)
            df = df.join(old, keys, "left_anti")
    df.hint("rebalance", *partition).write.mode("append").option("maxRecordsPerFile", target_rows).partitionBy(*partition).parquet(path)


def export_pending(outbox: DataFrame, path: str, captured: str = "captured_at", key: str = "snapshot_id") -> None:
    """Rows of an outbox under the UTC year, month and date of their capture; rows that are there stay and aren't doubled."""
    day = F.to_date(captured)
    rows = outbox.withColumns({"year": F.date_format(day, "yyyy"), "month": F.date_format(day, "MM"), "date": F.date_format(day, "yyyy-MM-dd")})
    write_archive(rows, path, ["year", "month", "date"], [key])


def write_datasets(datasets: dict[str, DataFrame], root: str, key: str = "match_id", partition: tuple[str, ...] = ("league_id", "season")) -> None:
    """Several datasets of the same matches, each under its name. Partitions with rows are replaced by what they held of other
    matches and the new rows, so a match that lost its rows in one dataset loses them there too; others stay.

    ``datasets`` has ``core`` with one row per match, which says what is replaced."""
    from pitchspark.staging import staged

    core = datasets["core"]
    renewed = staged(core.select(key, *partition).dropDuplicates([key]), "archive-renewed")
    for name, rows in datasets.items():
        path = f"{root}/{name}"
        if name == "core":
            rows = rows.dropDuplicates([key])
        if _existing(rows.sparkSession, path):
            old = rows.sparkSession.read.schema(rows.schema).parquet(path)
            touched = old.join(renewed.select(*partition).distinct(), list(partition), "left_semi")
            rows = touched.join(renewed.select(key), key, "left_anti").select(*rows.columns).unionByName(rows)
        # read before the partitions it comes from are replaced
        staged(rows, "archive-new").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def archive_with_priority(old: DataFrame, new: DataFrame, keys: list[str], priority: str, order: list[str]) -> DataFrame:
    """Per key the row of the highest source priority; ties keep the first by ``order``."""
    from pitchspark.operators.joins import first_by

    return first_by(old.unionByName(new).withColumn("_low", -F.col(priority)), keys, ["_low", *order]).drop("_low")


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A report as CSV, JSON lines or a Markdown table; for CSV and Markdown nested columns become JSON text."""
    if kind == "json":
        df.write.mode("overwrite").json(path)
        return
    flat = df.select(*[F.to_json(c).alias(c) if k.startswith(("struct", "array", "map")) else F.col(c) for c, k in df.dtypes])
    if kind == "csv":
        flat.write.mode("overwrite").option("header", True).csv(path)
        return
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in flat.columns]), F.lit(" |"))
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(flat.columns) + " |"), (1, "|" + "---|" * len(flat.columns))], "n int, value string")
    body = flat.select(F.lit(2).alias("n"), line.alias("value"))
    head.unionByName(body).orderBy("n").select("value").write.mode("overwrite").text(path)
