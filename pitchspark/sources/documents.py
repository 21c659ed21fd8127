"""Match documents: point reads, identities of sources, legacy tables, seasons, statistics and evidence out of JSON.

Fields whose place is known are read by path in the JVM; only the search for a key at any depth is a small Python helper.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from pitchspark.functions.text import repaired

# Words of a statistic's label that name it; the first rule that holds counts.
METRICS = (
    ("xg", r"expected goals|^xg$"), ("big_chances", r"big chance(?!.*missed)"), ("shots_on_target", r"shots on (target|goal)"), ("shots", r"^shots$|total shot"), ("shots_inside_box", r"(?=.*shot).*inside box"),
    ("shots_outside_box", r"(?=.*shot).*outside box"), ("touches_in_box", r"touches in(side)? (opposition )?box"), ("corners", r"corner"), ("possession", r"possession"), ("yellow_cards", r"(?=.*card).*yellow"), ("red_cards", r"(?=.*card).*red"),
    ("accurate_passes", r"accurate pass"), ("passes", r"^passes$|total passes"), ("fouls", r"foul"), ("offsides", r"offside"), ("goalkeeper_saves", r"(?=.*keeper).*save"), ("expected_threat", r"expected threat|^xt$"),
)
PERIODS = {"all": "ALL", "firsthalf": "FIRST_HALF", "secondhalf": "SECOND_HALF"}
_STAT = "struct<title:string,name:string,label:string,key:string,stats:array<string>>"
STATS = f"struct<Periods:map<string,struct<stats:array<struct<title:string,stats:array<{_STAT}>>>>>>"
WRAPPERS = ("observation", "entry_observation", "entry", "data", "evidence")


def row_of(spark: SparkSession, path: str, schema: str | StructType, key: str, value) -> DataFrame:
    """The row of one key of an archive, by a filter that reaches the scan."""
    return spark.read.schema(schema).parquet(path).where(F.col(key) == value).limit(1)


def table_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table, or an empty one of its schema where there is none yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def source_identity(spark: SparkSession, path: str) -> DataFrame:
    """One row: files, bytes and a checksum over the names, sizes and times of a table's files. Equal before and after a run,
    it shows that the source wasn't changed. File names are hashed one by one; what is gathered is a sum per bucket."""
    from pitchspark.operators.ledger import fingerprint

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.unix_micros("modificationTime").alias("at"))
    size = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    return fingerprint(files, ["path", "length", "at"]).crossJoin(size)  # one row each


def number_of(x: Column) -> Column:
    """First number in a provider's text, with a comma or point and maybe a per cent sign."""
    found = F.regexp_extract(F.replace(F.replace(F.replace(x, F.lit("\u00a0"), F.lit("")), F.lit(" "), F.lit("")), F.lit(","), F.lit(".")), r"([-+]?[0-9]+(?:\.[0-9]+)?)", 1)
    return F.when(found != "", found.cast("double"))


def metric_of(label: Column) -> Column:
    """The metric that a provider's label names, or null."""
    text = F.trim(F.regexp_replace(F.lower(label), r"[^a-z0-9]+", " "))
    out = None
    for name, rule in METRICS:
        out = F.when(text.rlike(rule), name) if out is None else out.when(text.rlike(rule), name)
    return out


def period_stats(documents: DataFrame, key: str = "match_id", payload: str = "payload", path: str = "$.content.stats") -> DataFrame:
    """(key, period, metric, home, away) of match documents; what a document lacks has no row, and nothing becomes 0. Metrics
    without a rule keep their label as a slug. Of a metric's several rows in a period the last counts."""
    parsed = F.from_json(F.get_json_object(payload, path), STATS)
    rows = documents.select(key, F.explode(F.map_entries(parsed["Periods"])).alias("p"))
    period = F.try_element_at(F.create_map(*[F.lit(v) for pair in PERIODS.items() for v in pair]), F.lower(F.regexp_replace("p.key", r"[^A-Za-z]", "")))
    rows = rows.select(key, period.alias("period"), F.posexplode("p.value.stats").alias("i", "g")).select(key, "period", "i", F.posexplode("g.stats").alias("j", "s")).where("period IS NOT NULL")
    label = F.coalesce("s.title", "s.name", "s.label", "s.key")
    slug = F.regexp_replace(F.lower(label), r"[^a-z0-9]+", "_")
    side = lambda k: number_of(F.get(F.col("s.stats"), F.lit(k)))
    rows = rows.select(key, "period", F.coalesce(metric_of(label), slug).alias("metric"), F.struct("i", "j").alias("place"), side(0).alias("home"), side(1).alias("away"))
    rows = rows.where("metric IS NOT NULL AND (home IS NOT NULL OR away IS NOT NULL)")
    return rows.groupBy(key, "period", "metric").agg(F.max_by(F.struct("home", "away"), "place").alias("v")).select(key, "period", "metric", "v.home", "v.away")


def find_first(payload: Column, names: tuple[str, ...]) -> Column:
    """JSON of the first value, depth first, under one of ``names`` (any case) at any depth; null without one."""
    wanted = {n.lower() for n in names}

    def search(node):
        stack = [node]
        while stack:
            top = stack.pop()
            if isinstance(top, tuple):
                if top[0] is not None and top[0].lower() in wanted:
                    return json.dumps(top[1])
                top = top[1]
            children = list(top.items()) if isinstance(top, dict) else [(None, x) for x in top] if isinstance(top, list) else []
            stack.extend(reversed(children))
        return None

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                return search(json.loads(text)) if text else None
            except ValueError:
                return None

        return texts.map(one).astype(object)

    return run(payload)


def seasons_of(documents: DataFrame, league: str = "league_id", payload: str = "payload") -> DataFrame:
    """(league, season_id, season_label) out of league pages of any shape: links of season statistics first, else lists of
    seasons; an item needs an id and a label. The last of items with one id counts."""
    links = find_first(F.col(payload), ("seasonStatLinks", "seasonLinks"))
    lists = find_first(F.col(payload), ("seasons", "availableSeasons", "seasonList", "seasonSelector", "seasonSelection"))
    rows = documents.select(league, F.from_json(links, "array<map<string,string>>").alias("a"), F.from_json(lists, "array<map<string,string>>").alias("b"))
    items = F.when(F.size("a") > 0, F.col("a")).otherwise(F.col("b"))
    rows = rows.select(league, F.posexplode(items).alias("place", "s")).withColumn("s", F.transform_keys("s", lambda k, _: F.lower(F.replace(k, F.lit("_"), F.lit("")))))
    value = lambda n: F.trim(F.try_element_at("s", F.lit(n.lower().replace("_", ""))))
    first = lambda *names: F.coalesce(*[F.when(value(n) != "", value(n)) for n in names])
    rows = rows.select(league, first("seasonId", "tournamentId", "id", "key", "valueId").alias("season_id"), first("seasonLabel", "seasonName", "label", "name", "text", "displayName").alias("season_label"), "place")
    return rows.dropna(subset=["season_id", "season_label"]).groupBy(league, "season_id").agg(F.max_by("season_label", "place").alias("season_label"))


def legacy_season(day: Column) -> Column:
    """2024/25 from August on: the old table's rule."""
    year = F.when(F.month(day) >= 8, F.year(day)).otherwise(F.year(day) - 1)
    return F.concat(year.cast("string"), F.lit("/"), F.lpad(F.pmod(year + 1, F.lit(100)).cast("string"), 2, "0"))


def legacy_matches(table: DataFrame, stats: list[str], data: str = "data_json") -> DataFrame:
    """Rows of an old wide table: repaired names, season, and for each statistic of its JSON the numbers of both sides in the
    first half and in all (null where the JSON lacks them or is broken)."""
    values = F.from_json(data, "map<string,string>")
    cell = lambda period, s, side: number_of(F.try_element_at(values, F.lit(f"stats_{period}_{s}_{side}"))).alias(f"{'ht' if period == '1st' else 'ft'}_{s}_{side}")
    cells = [cell(p, s, side) for p in ("1st", "all") for s in stats for side in ("home", "away")]
    return table.select(F.col("match_id").cast("string"), F.col("league_id").cast("string"), F.to_date("date").alias("date"), legacy_season(F.to_date("date")).alias("season"), repaired("home_team").alias("home_team"), repaired("away_team").alias("away_team"), *cells)


def legacy_inventory(matches: DataFrame, fields: list[str]) -> DataFrame:
    """Per league: matches, first and last day, seasons, and how many matches have each field."""
    return matches.groupBy("league_id").agg(F.count("*").alias("matches"), F.min("date").alias("first"), F.max("date").alias("last"), F.count_distinct("season").alias("seasons"), *[F.count(f).alias(f"n_{f}") for f in fields])


def evidence_rows(documents: DataFrame, schema: str, payload: str = "payload", event_id: str | None = None) -> DataFrame:
    """Rows of ``schema`` out of JSON that is an object, a list of objects, or either under one of ``WRAPPERS``; those of
    ``event_id`` if it is given. Broken JSON and anything else gives no row."""
    shapes = [F.col(payload), *[F.get_json_object(payload, f"$.{w}") for w in WRAPPERS]]
    wrapped = F.coalesce(*[F.when(F.startswith(F.ltrim(x), F.lit("{")) | F.startswith(F.ltrim(x), F.lit("[")), x) for x in shapes[1:]], shapes[0])
    items = F.when(F.startswith(F.ltrim("_j"), F.lit("[")), F.from_json("_j", f"array<struct<{schema}>>")).when(F.startswith(F.ltrim("_j"), F.lit("{")), F.array(F.from_json("_j", f"struct<{schema}>")))
    rows = documents.withColumn("_j", wrapped).select(F.explode(items).alias("r")).where("r IS NOT NULL").select("r.*")
    return rows if event_id is None else rows.where(F.col("event_id").cast("string") == event_id)


def flattened(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested structs as columns of their own, named by their path; arrays and maps stay."""

    def cells(kind: StructType, path: tuple[str, ...]) -> list[Column]:
        out = []
        for f in kind.fields:
            at = (*path, f.name)
            out += cells(f.dataType, at) if isinstance(f.dataType, StructType) else [F.col(".".join(f"`{x}`" for x in at)).alias(sep.join(at))]
        return out

    return df.select(*cells(df.schema, ()))
