"""Countries and candidates without a country against all pairs."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from pitchspark.functions.countries import country_names
from pitchspark.operators import matching


@pytest.mark.parametrize(
    "spellings",
    [
        ("GER", "DEU", "de", "Germany", "Deutschland"), ("aut", "AT", "Austria", "Österreich"), ("SUI", "CHE", "ch", "Switzerland", "Schweiz"), ("NED", "nld", "Netherlands", "Niederlande"), ("POR", "prt", "Portugal"),
        ("BEL", "Belgium", "Belgien"), ("SWE", "Sweden", "Schweden"), ("TUR", "Turkey", "Türkei"), ("DEN", "dnk", "Dänemark"), ("CRO", "hrv", "Croatia", "Kroatien"), ("uk", "gb", "ENG", "England"), ("KSA", "sau", "Saudi Arabia", "Saudi-Arabien"),
        ("CIV", "Ivory Coast", "Cote d'Ivoire", "Elfenbeinküste"), ("COD", "Democratic Republic of the Congo", "Demokratische Republik Kongo"), ("USA", "us", "United States"), ("KOR", "South Korea", "Südkorea"), ("HKG", "Hong Kong", "Hongkong"),
        ("UAE", "United Arab Emirates", "Vereinigte Arabische Emirate", "V.A. Emirate"), ("SCO", "Scotland", "Schottland"), ("NIR", "Northern Ireland", "Nordirland"), ("CZE", "Czech Republic", "Czechia", "Tschechien"), ("GRE", "grc", "Greece", "Griechenland"),
        ("RSA", "zaf", "South Africa", "Südafrika"), ("INT", "International"), ("MDA", "Moldawien"), ("PLE", "Palästina"), ("BIH", "Bosnia and Herzegovina", "Bosnien und Herzegowina"), ("URU", "Uruguay"), ("TAH", "Tahiti"), ("CPV", "Kap Verde"),
    ],
)
def test_spellings_of_a_country_are_one(spark, names, spellings):
    from pitchspark.functions.text import normal_name

    rows = spark.createDataFrame([(x,) for x in spellings], "x string").select(normal_name("x").alias("alias")).collect()
    assert len({names.get(r.alias, f"? {r.alias}") for r in rows}) == 1


@pytest.fixture(scope="module")
def names(spark):
    return {r.alias: r.country for r in country_names(spark).collect()}


def test_countries_are_a_bounded_table(spark, names):
    assert 700 < len(names) < 1500 and not {"", None} & set(names.values())
    more = {r.alias: r.country for r in country_names(spark, {"fc land": "Neuland"}).collect()}
    assert more["fc land"] == "neuland" and len(more) == len(names) + 1


def mangled(rng, name):
    out = list(name)
    for _ in range(rng.randrange(0, 4)):
        k = rng.randrange(len(out))
        out[k] = rng.choice(["", "x", out[k] * 2, "e "])
    return "".join(out)


def test_candidates_without_a_country_equal_all_pairs_above_the_floors(spark):
    rng = random.Random(3)
    clubs = ["bayern munich", "real madrid", "atletico madrid", "fc koln", "hertha", "ajax", "as roma", "lazio", "inter", "ac milan", "psv", "az", "ok", "olympique lyon", "olympiakos", "shakhtar donetsk", "dynamo kyiv", "dinamo zagreb", "hnk rijeka", "1860 munich"]
    rows = {"a": [], "b": []}
    for k in range(150):
        home, away = rng.sample(clubs, 2)
        at = 1_700_000_000 + rng.randrange(3000)
        place = rng.choice([None, None, "de", "es"])
        rows["a"].append((f"a{k}", home, away, at, place))
        rows["b"].append((f"b{k}", mangled(rng, home), mangled(rng, away), at + rng.randrange(-1200, 1200), rng.choice([None, place, "it"])))
    rows["b"].append(("b-core", "koln", "real madrid", 1_700_000_100, None))
    rows["a"].append(("a-core", "fc koln", "real madrid cf", 1_700_000_000, None))
    kind = "fixture_id string, home string, away string, s long, country string"
    left, right = (matching.prepare(spark.createDataFrame(rows[s], kind).withColumn("kickoff", F.timestamp_seconds("s")), s) for s in ("a", "b"))
    pairs = matching.candidates(left, right)
    got = {(r.a_id, r.b_id) for r in pairs.collect()}
    from pitchspark.functions.text import team_core

    read = lambda df, s: df.withColumns({"h": team_core(F.col(f"{s}_home")), "w": team_core(F.col(f"{s}_away"))}).collect()
    ratio = lambda x, y: SequenceMatcher(None, x, y).ratio()
    every, wanted = 0, set()
    for x in read(left, "a"):
        for y in read(right, "b"):
            if abs((x.a_kickoff - y.b_kickoff).total_seconds()) > 900 or (x.a_country and y.b_country) or x.a_home_marks != y.b_home_marks or x.a_away_marks != y.b_away_marks or not y.b_home or not y.b_away:
                continue
            every += 1
            if (x.h, x.w) == (y.w, y.h):
                continue
            if (x.h, x.w) == (y.h, y.w) or min(ratio(x.a_home, y.b_home), ratio(x.a_away, y.b_away)) >= matching.LEAST_TEAM:
                wanted.add((x.a_id, y.b_id))
    unknown = {(r.a_id, r.b_id) for r in pairs.where("a_country IS NULL OR b_country IS NULL").collect()}
    assert wanted <= got and len(wanted) > 30 and ("a-core", "b-core") in got
    assert len(unknown) < 0.6 * every  # of the pairs that are near in time, not those whose names have little in common
    assert pairs.count() == len(got)


def test_fixtures_far_from_all_others_are_not_multiplied(spark, monkeypatch):
    kind = "fixture_id int, home string, away string, s long, country string"
    side = lambda rows, s: matching.prepare(spark.createDataFrame(rows, kind).withColumn("kickoff", F.timestamp_seconds("s")), s)
    far = [(k, f"Supplier {k}", f"Away {k}", 1_700_000_000 + 7200 * k, None) for k in range(40)]
    left, right = side(far[:3], "a"), side(far, "b")
    expected = {(r.a_id, r.b_id) for r in matching.candidates(left, right).collect()}
    monkeypatch.setattr(matching, "_by_grams", None)  # no quarter of an hour here has many of both sources
    assert {(r.a_id, r.b_id) for r in matching.candidates(left, right).collect()} == expected == {(k, k) for k in range(3)}


def test_few_and_many_fixtures_at_a_time_give_the_same_scores(spark, monkeypatch):
    rng = random.Random(5)
    clubs = ["bayern munich", "real madrid", "fc koln", "ajax", "as roma", "az", "ok", "inter", "1860 munich"]
    kind = "fixture_id int, home string, away string, s long, country string"
    rows = [(k, *rng.sample(clubs, 2), 1_700_000_000 + rng.randrange(9000), rng.choice([None, "de"])) for k in range(120)]
    right = [(k, mangled(rng, h), mangled(rng, w), at + rng.randrange(-1000, 1000), None) for k, h, w, at, _ in rows]
    a, b = (spark.createDataFrame(x, kind).withColumn("kickoff", F.timestamp_seconds("s")) for x in (rows, right))
    found = {}
    for few in (0, 10**6):
        monkeypatch.setattr(matching, "FEW", few)
        pairs = matching.scored(matching.candidates(matching.prepare(a, "a"), matching.prepare(b, "b")))
        found[few] = sorted((r.a_id, r.b_id, r.score) for r in pairs.where("score > 0").collect())
    assert found[0] == found[10**6] and len(found[0]) > 30


def test_prepared_countries_join_over_their_spellings(spark):
    rows = lambda country: spark.createDataFrame([(1, "FC Alpha", "Beta", 1_700_000_000, country)], "fixture_id int, home string, away string, s long, country string").withColumn("kickoff", F.timestamp_seconds("s"))
    for a, b in (("NED", "Niederlande"), ("deu", "Germany"), ("ENG", "uk")):
        assert [r.verdict for r in matching.match(rows(a), rows(b)).collect()] == ["EXACT"]
    assert matching.match(rows("NED"), rows("Belgien")).count() == 0
