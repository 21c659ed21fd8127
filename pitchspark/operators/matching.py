"""Entity resolution between two sources of fixtures: blocking by time and country, hard guards, aliases, a score.

Candidates meet in an equality join on a quarter of an hour and the country; fixtures without a country meet those of any
country by a quarter of an hour and common bigrams of both names: pair by pair where a quarter has few fixtures of either
source, by the rare ones of their bigrams where it has many. Similarities are computed behind the guards only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitchspark.functions.countries import country_names
from pitchspark.functions.text import label_key, marker_set, normal_name, sequence_ratio, team_core, team_name
from pitchspark.operators.joins import interval_join, latest_by
from pitchspark.staging import shared_side, spread, staged

LEAST_COMPETITION, LEAST_TEAM, ACCEPT, NEAR = 0.70, 0.78, 0.80, 0.05
#: Of a name's bigrams that a similar name shares: at a ratio of ``LEAST_TEAM`` two names of together n letters have m of them
#: in common blocks, n - 2 m outside, and so one more block than that at most: 3 m - n - 1 bigrams or more.
_SHARE, _PARTNER = 1.5 * LEAST_TEAM - 1, LEAST_TEAM / (2 - LEAST_TEAM)
#: Fixtures of the smaller side in a stretch of time up to which all its pairs are looked at: fewer than the pairs of rare
#: bigrams that each fixture would be multiplied by.
FEW = 100


def prepare(fixtures: DataFrame, source: str, countries: dict[str, str] | None = None) -> DataFrame:
    """fixture_id, home, away, kickoff, country, and competition if there is one -> normalised names, markers and country with
    the source's prefix; an empty country is unknown. ``countries`` are aliases beside those of every country."""
    competition = normal_name("competition") if "competition" in fixtures.columns else F.lit(None).cast("string")
    rows = fixtures.withColumn("_place", normal_name("country")).join(F.broadcast(country_names(fixtures.sparkSession, countries)).select(F.col("alias").alias("_place"), F.col("country").alias("_known")), "_place", "left")
    known = F.coalesce("_known", "_place")
    return rows.select(
        F.col("fixture_id").alias(f"{source}_id"),
        team_name("home").alias(f"{source}_home"),
        team_name("away").alias(f"{source}_away"),
        marker_set("home").alias(f"{source}_home_marks"),
        marker_set("away").alias(f"{source}_away_marks"),
        F.col("kickoff").alias(f"{source}_kickoff"),
        F.when(known != "", known).alias(f"{source}_country"),
        F.coalesce(competition, F.lit("")).alias(f"{source}_competition"),
    )


def with_aliases(prepared: DataFrame, aliases: DataFrame, source: str) -> DataFrame:
    """One row for each pair of home and away spelling whose markers are those of the name; ``aliases``: name, alias."""
    spelled = aliases.select(team_name("name").alias("_name"), team_name("alias").alias("_alias"), marker_set("name").alias("_m"), marker_set("alias").alias("_n"))
    spelled = spelled.where("_m = _n").groupBy("_name").agg(F.array_sort(F.collect_set("_alias")).alias("_aliases"))  # spellings of one name are few
    for side in ("home", "away"):
        name = f"{source}_{side}"
        names = F.array_distinct(F.concat(F.array(name), F.coalesce("_aliases", F.array().cast("array<string>"))))
        prepared = prepared.join(spelled.withColumnRenamed("_name", name), name, "left").withColumn(name, F.explode(names)).drop("_aliases")
    return prepared


def _grams(name: Column) -> Column:
    """Bigrams of a name, each with how often it stood before in the name; a name of up to three letters also has itself as
    short, since two such names may be similar without a bigram in common."""
    every = F.when(F.length(name) > 1, F.transform(F.sequence(F.lit(1), F.length(name) - 1), lambda i: F.substring(name, i, 2))).otherwise(F.array().cast("array<string>"))
    numbered = F.transform(every, lambda x, i: F.concat(x, F.size(F.filter(F.slice(every, 1, i), lambda y: y == x)).cast("string")))
    return F.concat(numbered, F.when(F.length(name) <= 3, F.array(F.lit("short"))).otherwise(F.array().cast("array<string>")))


def _rarest(rows: DataFrame, column: str, often: DataFrame, name: str) -> DataFrame:
    """``rows`` with the bigrams of a name that one of a similar name's must be among: all but the most frequent ones, as many
    as may be missing from what both share."""
    names = rows.select(column).distinct().select(column, F.explode(_grams(F.col(column))).alias("gram"))
    counted, _ = shared_side(often)
    ordered = names.join(counted, "gram").groupBy(column).agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("_g"))
    least = F.greatest(F.lit(1), F.ceil(_SHARE * (1 + _PARTNER) * F.length(column) - 1 - 1e-9)).cast("int")
    first = F.slice("_g.gram", F.lit(1), F.greatest(F.lit(1), F.size("_g") - least + 1))
    return rows.join(ordered.select(column, first.alias(name)), column)


def _share_grams(x: str, y: str) -> Column:
    """Whether two names have as many bigrams in common as a ratio of ``LEAST_TEAM`` needs."""
    least = F.greatest(F.lit(1), F.ceil(_SHARE * (F.length(x) + F.length(y)) - 1 - 1e-9))
    return F.size(F.array_intersect(_grams(F.col(x)), _grams(F.col(y)))) >= least


def _same_core(x: str, y: str) -> Column:
    return team_core(F.col(x)) == team_core(F.col(y))


def _bucket(time: str, seconds: int) -> Column:
    return F.floor(F.unix_micros(F.col(time).cast("timestamp")) / (seconds * 1_000_000))


def _similar_names(left: DataFrame, right: DataFrame, seconds: int) -> DataFrame:
    """Pairs near in time whose names may be similar on both sides, or are equal but for decorations, whatever the country.

    Stretches of time with fixtures of one source only are left out first. In those with few fixtures of either side every
    pair is looked at; in the others pairs meet by rare bigrams."""
    near = left.withColumn("_at", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: _bucket("a_kickoff", seconds) + d)))
    at = right.withColumn("_at", _bucket("b_kickoff", seconds))
    count = lambda df, name: df.groupBy("_at").agg(F.count("*").alias(name))
    cells = staged(count(near, "_n").join(count(at, "_m"), "_at").select("_at", (F.least("_n", "_m") <= FEW).alias("_few")), "match-times")
    some = {r["_few"] for r in cells.select("_few").distinct().collect()}
    out = left.limit(0).crossJoin(right.limit(0))
    if True in some:
        few, _ = shared_side(cells.where("_few").select("_at"))
        gap = F.abs(F.unix_micros(F.col("a_kickoff").cast("timestamp")) - F.unix_micros(F.col("b_kickoff").cast("timestamp")))
        pairs = near.join(few, "_at", "left_semi").join(at, "_at").where(gap <= seconds * 1_000_000).drop("_at")
        names = (_share_grams("a_home", "b_home") & _share_grams("a_away", "b_away")) | (_same_core("a_home", "b_home") & _same_core("a_away", "b_away"))
        out = pairs.where(names).dropDuplicates(["a_id", "a_home", "a_away", "b_id", "b_home", "b_away"])
    if False in some:
        many, _ = shared_side(cells.where("NOT _few").select("_at"))
        own = near.join(many, "_at", "left_semi").drop("_at").dropDuplicates(["a_id", "a_home", "a_away"])
        out = out.unionByName(_by_grams(own, at.join(many, "_at", "left_semi").drop("_at"), seconds))
    return out


def _by_grams(left: DataFrame, right: DataFrame, seconds: int) -> DataFrame:
    """The pairs of :func:`_similar_names` by rare bigrams.

    Names that are similar enough share a bigram among the rarest of either (prefix filtering), so pairs meet by time and
    such a bigram of the home side and of the away side; none that the similarity floors would let pass is missed."""
    often = None
    for df, s in ((left, "a"), (right, "b")):
        for side in ("home", "away"):
            rows = df.select(F.col(f"{s}_{side}").alias("_name")).distinct()
            often = rows if often is None else often.unionByName(rows)
    often = staged(often.distinct().select(F.explode(_grams(F.col("_name"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")), "match-grams")
    keyed = []
    for df, s in ((left, "a"), (right, "b")):
        rows = _rarest(_rarest(df, f"{s}_home", often, "_hs"), f"{s}_away", often, "_as")
        keyed.append(rows.withColumn("_h", F.explode("_hs")).withColumn("_w", F.explode("_as")).drop("_hs", "_as"))
    pairs = interval_join(keyed[0], keyed[1], "a_kickoff", "b_kickoff", seconds, ["_h", "_w"]).drop("_h", "_w")
    core = lambda df, s: df.withColumns({f"_c{k}": team_core(F.col(f"{s}_{side}")) for k, side in enumerate(("home", "away"))})
    equal = interval_join(core(left, "a"), core(right, "b"), "a_kickoff", "b_kickoff", seconds, ["_c0", "_c1"]).drop("_c0", "_c1")
    return pairs.unionByName(equal).dropDuplicates(["a_id", "a_home", "a_away", "b_id", "b_home", "b_away"])


def candidates(left: DataFrame, right: DataFrame, seconds: int = 900) -> DataFrame:
    """Pairs of prepared fixtures whose kickoffs are near and that no guard parts: names present, not the same fixture the
    other way round, equal markers, equal countries if both are known. Where a country is unknown only pairs are given whose
    names can reach the floors of :func:`scored`."""
    left, right = staged(left, "match-left"), staged(right, "match-right")
    known_left, known_right = left.where("a_country IS NOT NULL"), right.where("b_country IS NOT NULL")
    by_country = interval_join(known_left.withColumn("_country", F.col("a_country")), known_right.withColumn("_country", F.col("b_country")), "a_kickoff", "b_kickoff", seconds, ["_country"])
    pairs = by_country.drop("_country")
    pairs = pairs.unionByName(_similar_names(left.where("a_country IS NULL"), right, seconds))
    pairs = pairs.unionByName(_similar_names(known_left, right.where("b_country IS NULL"), seconds))
    same = lambda x, y: team_core(F.col(x)) == team_core(F.col(y))
    marks = (F.col("a_home_marks") == F.col("b_home_marks")) & (F.col("a_away_marks") == F.col("b_away_marks"))
    names = F.lit(True)
    for c in ("a_home", "a_away", "b_home", "b_away"):
        names = names & (F.coalesce(c, F.lit("")) != "")
    return pairs.where(names & marks & ~(same("a_home", "b_away") & same("a_away", "b_home")))


def scored(pairs: DataFrame, labels: dict[str, list[tuple[str, ...]]] | None = None) -> DataFrame:
    """Pairs with ``score`` (0 where a guard on similarity parts them) and ``exact``.

    0.42 or 0.30 for each team, equal or similar; 0.10 or 0.05 for the competition; 0.06 or 0.03 for kickoffs within five
    minutes or not; 0.04 if both countries are known; 1 at most. ``labels``: per country, groups of competition labels that
    mean one competition; two labelled ones of different groups part the pair."""
    c = F.col
    equal = {side: team_core(c(f"a_{side}")) == team_core(c(f"b_{side}")) for side in ("home", "away")}
    keys = [label_key(c(f"{s}_country"), c(f"{s}_competition"), labels or {}) for s in ("a", "b")]
    both = F.coalesce(c("a_country") == c("b_country"), F.lit(False))
    named = (c("a_competition") != "") & (c("b_competition") != "")
    same = (c("a_competition") == c("b_competition")) | (both & (keys[0] == keys[1]))
    parted = both & F.startswith(keys[0], F.lit("label:")) & F.startswith(keys[1], F.lit("label:")) & (keys[0] != keys[1])
    pairs = pairs.withColumns({"_home": equal["home"], "_away": equal["away"], "_comp": same, "_parted": parted, "_named": named})
    ratio = lambda use, a, b: F.when(use, sequence_ratio(F.when(use, c(a)), F.when(use, c(b)))).otherwise(1.0)
    pairs = pairs.withColumn("_rc", ratio(c("_named") & ~c("_comp"), "a_competition", "b_competition"))
    unsure = ~(c("_home") & c("_away")) & (c("_rc") >= LEAST_COMPETITION) & ~c("_parted")
    pairs = pairs.withColumn("_rt", F.least(ratio(unsure, "a_home", "b_home"), ratio(unsure, "a_away", "b_away")))
    gap = F.abs(F.unix_micros(c("a_kickoff").cast("timestamp")) - F.unix_micros(c("b_kickoff").cast("timestamp"))) / 60e6
    part = lambda cond, a, b: F.when(cond, a).otherwise(b)
    total = part(c("_home"), 0.42, 0.30) + part(c("_away"), 0.42, 0.30) + part(c("_comp"), 0.10, 0.05) + part(gap <= 5, 0.06, 0.03)
    total = total + part(c("a_country").isNotNull() & c("b_country").isNotNull(), 0.04, 0.0)
    fails = c("_parted") | (c("_rc") < LEAST_COMPETITION) | (c("_rt") < LEAST_TEAM)
    exact = c("_home") & c("_away") & c("_comp") & (gap <= 5)
    pairs = pairs.withColumns({"score": F.when(fails, 0.0).otherwise(F.round(F.least(F.lit(1.0), total), 6)), "exact": exact & ~fails})
    return pairs.drop("_home", "_away", "_comp", "_parted", "_named", "_rc", "_rt")


def resolve(pairs: DataFrame) -> DataFrame:
    """Best pair of each left fixture: a_id, b_id (null unless decided), score, second and verdict: EXACT, HIGH_CONFIDENCE,
    AMBIGUOUS (another within ``NEAR``) or UNMATCHED. Of several spellings of a pair the best counts."""
    each = staged(pairs.groupBy("a_id", "b_id").agg(F.max("score").alias("score"), F.max_by("exact", "score").alias("exact")).where("score > 0"), "match-scores")
    best = latest_by(each.withColumn("_turn", F.struct("score", -F.row_number().over(Window.partitionBy("a_id", "score").orderBy("b_id")))), ["a_id"], ["_turn"]).drop("_turn")
    second = each.join(best.select("a_id", F.col("b_id").alias("_first")), "a_id").where("b_id <> _first").groupBy("a_id").agg(F.max("score").alias("second"))
    close = F.coalesce(F.col("second") >= F.col("score") - NEAR, F.lit(False))
    verdict = F.when(close, "AMBIGUOUS").when(F.col("exact"), "EXACT").when(F.col("score") >= ACCEPT, "HIGH_CONFIDENCE").otherwise("UNMATCHED")
    found = best.join(second, "a_id", "left").withColumn("verdict", verdict)
    return found.withColumn("b_id", F.when(F.col("verdict").isin("EXACT", "HIGH_CONFIDENCE"), F.col("b_id"))).drop("exact")


def match(left: DataFrame, right: DataFrame, aliases: DataFrame | None = None, labels: dict[str, list[tuple[str, ...]]] | None = None) -> DataFrame:
    """The whole chain for two tables of fixtures; ``aliases`` are other spellings of the right source's names."""
    a, b = prepare(spread(left), "a"), prepare(spread(right), "b")
    return resolve(scored(candidates(a, b if aliases is None else with_aliases(b, aliases, "b")), labels))


def same_fixture(column: str = "verdict") -> Column:
    return F.col(column).isin("EXACT", "HIGH_CONFIDENCE")
