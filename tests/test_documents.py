import json

from pyspark.sql import functions as F

from pitchspark.functions import numbers, times
from pitchspark.sources import documents, feeds


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_period_stats(spark):
    stat = lambda title, *values: {"title": title, "stats": list(values)}
    page = {"content": {"stats": {"Periods": {"All": {"stats": [{"title": "Top", "stats": [stat("Expected goals (xG)", "1.2", "0,8"), stat("Ball possession", "55%", "45 %"), stat("Own thing", "3", None)]}]}, "FirstHalf": {"stats": [{"title": "Top", "stats": [stat("Total shots", "4", "5"), stat("Corners", None, None)]}]}}}}}
    docs = spark.createDataFrame([("m", json.dumps(page)), ("n", "broken"), ("o", None)], "match_id string, payload string")
    assert rows(documents.period_stats(docs)) == [("m", "ALL", "own_thing", 3.0, None), ("m", "ALL", "possession", 55.0, 45.0), ("m", "ALL", "xg", 1.2, 0.8), ("m", "FIRST_HALF", "shots", 4.0, 5.0)]


def test_metric_labels(spark):
    labels = ["Shots on target", "Big chances missed", "Shots inside box", "Goalkeeper saves", "Passes", "Yellow cards", "Weather"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, label string")
    assert [r["m"] for r in df.orderBy("i").select(documents.metric_of(F.col("label")).alias("m")).collect()] == ["shots_on_target", None, "shots_inside_box", "goalkeeper_saves", "passes", "yellow_cards", None]


def test_seasons_at_any_depth(spark):
    a = {"x": [{"stats": {"seasonStatLinks": [{"TournamentId": 7, "Name": "2024/2025"}, {"TournamentId": 8}]}}], "seasons": [{"id": "9", "label": "no"}]}
    b = {"deep": {"er": {"Seasons": [{"id": "1", "label": "A"}, {"id": "1", "label": "B"}, {"label": "C"}]}}}
    docs = spark.createDataFrame([("p", json.dumps(a)), ("q", json.dumps(b)), ("r", "{"), ("s", None)], "league_id string, payload string")
    assert rows(documents.seasons_of(docs)) == [("p", "7", "2024/2025"), ("q", "1", "B")]


def test_legacy_tables(spark):
    data = json.dumps({"stats_1st_shots_home": "3", "stats_all_shots_away": "7,5"})
    table = spark.createDataFrame([(1, 5, "2024-08-01", "1. FC K�ln", "B", data), (2, 5, "2024-07-31", "A", "B", "broken")], "match_id int, league_id int, date string, home_team string, away_team string, data_json string")
    found = documents.legacy_matches(table, ["shots"])
    assert rows(found.select("match_id", "season", "home_team", "ht_shots_home", "ft_shots_away")) == [("1", "2024/25", "1. FC Köln", 3.0, 7.5), ("2", "2023/24", "A", None, None)]
    assert [tuple(r)[1:2] + tuple(r)[4:] for r in documents.legacy_inventory(found, ["ht_shots_home"]).collect()] == [(2, 2, 1)]


def test_evidence_shapes(spark):
    one = {"event_id": "a", "x": 1}
    shapes = [one, [one, {"event_id": "b", "x": 2}], {"data": one}, {"entry": [one]}]
    docs = spark.createDataFrame([(json.dumps(s),) for s in shapes] + [("3",), ("broken",), (None,)], "payload string")
    assert rows(documents.evidence_rows(docs, "event_id: string, x: int")) == [("a", 1)] * 4 + [("b", 2)]
    assert rows(documents.evidence_rows(docs, "event_id: string, x: int", event_id="b")) == [("b", 2)]


def test_point_read_identity_and_missing_table(spark, tmp_path):
    path = str(tmp_path / "t")
    assert documents.table_or_empty(spark, path, "id int").count() == 0
    spark.range(5).selectExpr("CAST(id AS INT) AS id").write.parquet(path)
    assert rows(documents.row_of(spark, path, "id int", "id", 3)) == [(3,)]
    before = documents.source_identity(spark, path).first()
    assert before == documents.source_identity(spark, path).first() and before["bytes"] > 0
    spark.range(1).selectExpr("CAST(id AS INT) AS id").write.mode("append").parquet(path)
    assert documents.source_identity(spark, path).first()["fingerprint"] != before["fingerprint"]


def test_flattened(spark):
    df = spark.sql("SELECT 1 AS a, named_struct('b', 2, 'c', named_struct('d.e', 3)) AS s, array(1) AS l")
    assert documents.flattened(df).columns == ["a", "s_b", "s_c_d.e", "l"] and documents.flattened(df).first()[:3] == (1, 2, 3)


def test_exports_are_idempotent(spark, tmp_path):
    path = str(tmp_path / "out")
    box = spark.createDataFrame([(1, "2026-01-31 23:59:59"), (2, "2026-02-01 00:00:00"), (2, "2026-02-01 00:00:00")], "snapshot_id int, at string").select("snapshot_id", F.col("at").cast("timestamp").alias("captured_at"))
    for _ in range(2):
        feeds.export_pending(box, path)
    assert rows(spark.read.parquet(path).select("snapshot_id", F.col("date").cast("string"))) == [(1, "2026-01-31"), (2, "2026-02-01")]


def test_datasets_of_a_match_are_replaced_together(spark, tmp_path):
    core = lambda *ids: spark.createDataFrame([(i, "L", "S") for i in ids], "match_id int, league_id string, season string")
    shots = lambda *pairs: spark.createDataFrame([(i, n, "L", "S") for i, n in pairs], "match_id int, n int, league_id string, season string")
    feeds.write_datasets({"core": core(1, 2), "shots": shots((1, 1), (2, 1), (2, 2))}, str(tmp_path))
    feeds.write_datasets({"core": core(2), "shots": shots()}, str(tmp_path))
    read = lambda name: rows(spark.read.parquet(str(tmp_path / name)).select("match_id"))
    assert read("core") == [(1,), (2,)]
    feeds.write_datasets({"core": core(2), "shots": shots((2, 9))}, str(tmp_path))
    assert rows(spark.read.parquet(str(tmp_path / "shots")).select("match_id", "n")) == [(1, 1), (2, 9)]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b", [1, 2])], "i int, s string, l array<int>")
    for kind in ("csv", "json", "md"):
        feeds.write_report(df, str(tmp_path / kind), kind)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "md")).collect()] == ["| i | s | l |", "|---|---|---|", "| 1 | a\\|b | [1,2] |"]
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["l"] == "[1,2]"
    assert spark.read.json(str(tmp_path / "json")).first()["l"] == [1, 2]


def test_market_graph_keeps_what_is_missing(spark):
    page = {"event": {"id": "e"}, "oddGroups": {"1": {"id": "1", "type": "t"}, "2": {"id": "2", "status": "Open"}}, "oddGroupResultsMap": {"1": [10, 11], "3": [12]}, "results": {"10": {"id": "10", "quoteFloatValue": 1.0}, "12": {"id": "12", "quoteFloatValue": 2.0}}}
    found = feeds.outcomes_of_detail(spark.createDataFrame([(json.dumps(page),)], "payload string"))
    assert rows(found.select("market_id", "market_status", "outcome_id", "odds", "available")) == [("1", "paused", "10", 1.0, False), ("1", "paused", "11", None, False), ("3", "open", "12", 2.0, True)]


def test_daily_feed_keeps_the_first_of_an_id(spark):
    m = lambda i: {"id": i, "home": {"id": "h", "name": "H"}, "away": {"id": "a", "name": "A"}, "status": {"utcTime": "2026-01-01T00:00:00Z", "finished": False}}
    page = {"leagues": [{"id": "1", "matches": [m("x"), m("y")]}, {"id": "2", "matches": [m("x"), m(None)]}]}
    found = feeds.matches_of_daily(spark.createDataFrame([("d", json.dumps(page))], "day string, payload string"))
    assert rows(found.where("first").select("match_id", "league_id")) == [("x", "1"), ("y", "1"), (None, "2")]
    assert rows(feeds.summary_of_daily(found, ["day"])) == [("d", 2, 4, 2, 1, 1)]


def test_small_functions(spark):
    df = spark.createDataFrame([(2.675, "2026-01-02T23:30:00-02:00", '{"a":{"b":"x"}}', [1, 2], [2, 3])], "v double, t string, j string, a array<int>, b array<int>")
    found = df.select(
        numbers.python_round("v").alias("r"), times.utc_date("t").cast("string").alias("d"), *times.partition_keys(times.utc("t")), numbers.first_path("j", ("$.z", "$.a.b")).alias("p"),
        numbers.json_list("j", "struct<a:int>").alias("l"), numbers.appended(F.col("a"), F.col("b")).alias("u"), numbers.same_ids(F.col("a"), F.col("b")).alias("s"),
    ).first()
    assert tuple(found) == (2.67, "2026-01-03", "2026", "01", "2026-01-03", "x", [], [1, 2, 3], True)
