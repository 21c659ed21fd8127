from pyspark.sql import functions as F

from pitchspark.operators import windows
from pitchspark.streaming import engines


def stream_of(spark, path, df):
    df.repartition(1).sortWithinPartitions("at").write.parquet(path)
    return engines.read_feed(spark, path, df.schema.simpleString()[7:-1].replace(":", " "))


def drained(spark, tmp_path, stream):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    engines.drain(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    return sorted(tuple(r) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect())


DATA = [("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 1, "z"), ("b", 5, "z"), ("a", 9, "x")]


def test_change_only_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(DATA, "key string, at long, value string")
    batch = windows.change_only(df, ["key"], ["at"], ["value"]).select("key", "at", "value")
    found = drained(spark, tmp_path, engines.change_only(stream_of(spark, str(tmp_path / "in"), df)))
    assert found == sorted(tuple(r) for r in batch.collect())


def test_slots_fire_once(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 50.0), ("a", 2, 72.0), ("a", 3, 90.0)], "key string, at long, value double")
    found = drained(spark, tmp_path, engines.slot_triggers(stream_of(spark, str(tmp_path / "in"), df), (60.0, 70.0, 85.0)))
    batch = windows.first_crossings(df, ["key"], "at", "value", [60, 70, 85], []).select("key", "threshold", "at")
    assert found == sorted(tuple(r) for r in batch.collect())


def test_rate_limit_counts_from_the_last_that_passed(spark, tmp_path):
    df = spark.createDataFrame([("a", t * 1_000_000) for t in (0, 5, 9, 12, 19, 22)], "key string, at long")
    found = drained(spark, tmp_path, engines.rate_limit(stream_of(spark, str(tmp_path / "in"), df), 10))
    assert [x[1] // 1_000_000 for x in found] == [0, 12, 22]


def test_sliding_counts(spark, tmp_path):
    df = spark.createDataFrame([(t * 60, "k") for t in (1, 2, 7, 400)], "s long, kind string").select(F.timestamp_seconds("s").alias("at"), "kind")
    out = drained(spark, tmp_path, engines.sliding_counts(stream_of(spark, str(tmp_path / "in"), df), "at", "kind", "5 minutes", "5 minutes"))
    assert [x[3] for x in out] == [2, 1]


def test_lifecycle_equals_the_batch_fold(spark, tmp_path):
    """Finished events never come back; quotes close once; rows behind the watermark change nothing."""
    from pitchspark.operators import results

    data = [
        ("a", 1, "PREMATCH", True, "0"), ("a", 2, "LIVE", True, "0"), ("a", 3, "PREMATCH", True, "0"), ("a", 4, "LIVE", True, "1"), ("a", 5, "FINISHED", True, "1"), ("a", 6, "LIVE", True, "1"), ("a", 7, "FINISHED", True, "2"),
        ("b", 1, "LIVE", False, None), ("b", 2, "GONE", False, None), ("b", 3, "PREMATCH", False, None), ("b", 4, "PREMATCH", True, None), ("b", 5, "OTHER", True, "x"),
    ]
    df = spark.createDataFrame(data, "key string, at long, kind string, soon boolean, value string")
    found = drained(spark, tmp_path, engines.lifecycle(stream_of(spark, str(tmp_path / "in"), df)))
    kickoff = F.when(F.col("soon"), F.lit("2026-02-01")).otherwise("2025-01-01").cast("timestamp")
    batch = results.accepted_states(df.select(F.col("key").alias("event_id"), "at", "kind", kickoff.alias("kickoff")), 1.0, F.lit("2026-01-01").cast("timestamp"))
    assert [(x[0], x[1], x[2], x[4]) for x in found] == sorted(tuple(r) for r in batch.collect())
    by = {(x[0], x[1]): x for x in found}
    assert [k for k, x in by.items() if x[6]] == [("a", 5)] and by["a", 7][5] and not by["a", 6][5]
    later = spark.createDataFrame([("a", 4, "FINISHED", True, "9")], df.schema)
    later.write.mode("append").parquet(str(tmp_path / "in"))
    again = drained(spark, tmp_path, engines.lifecycle(engines.read_feed(spark, str(tmp_path / "in"), "key string, at long, kind string, soon boolean, value string")))
    assert again == found


def test_match_slots_fire_once_with_a_timer(spark, tmp_path):
    t = lambda s: F.timestamp_seconds(F.lit(1_700_000_000 + s))
    rows = [(-30, "PRE", 0, 0), (10, "H1", 1, 0), (2700, "HT", 45, 1), (2710, "HT", 45, 1), (2800, "HT", 45, 1), (3700, "H2", 61, 1), (3800, "H2", 62, 2), (4300, "H2", 71, 2), (5500, "END", 90, 2)]
    df = spark.createDataFrame([("m", *r) for r in rows], "key string, s long, period string, minute int, goals int")
    df = df.select("key", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("at"), t(0).alias("kickoff"), "period", "minute", "goals")
    first, rest = df.where("period in ('PRE', 'H1') OR at <= timestamp_seconds(1700002710)"), df.where("at > timestamp_seconds(1700002710)")
    kind = "key string, at timestamp, kickoff timestamp, period string, minute int, goals int"
    for part in (first, rest.where("period = 'HT'"), rest.where("period <> 'HT'")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        found = drained(spark, tmp_path, engines.match_slots(engines.read_feed(spark, str(tmp_path / "in"), kind)))
    assert sorted(x[1] for x in found) == sorted(["PRE_KICKOFF", "HALFTIME", "HT_STABLE", "MINUTE_60", "FIRST_H2_GOAL", "MINUTE_70", "FINAL"])


def test_debounce_needs_number_and_time(spark, tmp_path):
    rows = [("a", 0, True), ("a", 30, True), ("a", 50, True), ("a", 65, True), ("a", 70, True), ("a", 80, False), ("a", 90, True), ("b", 0, True), ("b", 100, True)]
    df = spark.createDataFrame([(k, s * 1_000_000, x) for k, s, x in rows], "key string, at long, suspect boolean")
    assert drained(spark, tmp_path, engines.debounced(stream_of(spark, str(tmp_path / "in"), df))) == [("a", 65_000_000, 4)]


def test_freshness_and_first_delivery(spark, tmp_path):
    df = spark.createDataFrame([(1, 1000, 1005), (2, 1000, 1011), (3, 1009, 1005), (1, 1000, 1005)], "id int, o long, r long").select("id", F.timestamp_seconds("o").alias("at"), F.timestamp_seconds("r").alias("seen"))
    found = drained(spark, tmp_path, engines.once(engines.fresh_and_stale(stream_of(spark, str(tmp_path / "in"), df), "at", "seen"), ["id"], "at"))
    assert [(x[0], x[3]) for x in found] == [(1, "FRESH"), (2, "STALE"), (3, "FUTURE")]


def test_rate_decisions_equal_a_fold(spark):
    import random

    rng = random.Random(4)
    rows = [("k", i, 429 if rng.random() < 0.02 else 200, rng.random() > 0.06, False, rng.randrange(2500) if i > 150 else 100) for i in range(250)]
    df = spark.createDataFrame(rows, "key string, i int, status int, ok boolean, parse_failure boolean, elapsed_ms int")
    rate, want = 10.0, []
    for w in range(len(rows) // 20):
        part = rows[w * 20 : w * 20 + 20]
        p95 = sorted(r[5] for r in part)[18]
        state = "UNSTABLE" if any(r[2] == 429 for r in part) else "DEGRADED" if sum(not r[3] for r in part) > 2 or p95 > 2000 else "STABLE"
        rate = min(60.0, rate + 2) if state == "STABLE" else max(1.0, rate * (0.5 if state == "UNSTABLE" else 0.75))
        want.append((w, state, rate))
    assert sorted(tuple(r) for r in windows.rate_decisions(df, ["key"], ["i"]).select("window", "state", "rate").collect()) == want


# --- order and state ---------------------------------------------------------------------------------------------


def shuffled_rows(n=60, keys=("a", "b", "c")):
    import random

    rng = random.Random(12)
    rows = [(k, (10 * i + rng.randrange(9)) * 1_000_000, rng.choice(["x", "y", "z", None])) for k in keys for i in range(n)]
    rng.shuffle(rows)
    return rows


def expected_changes(rows):
    out, last = [], {}
    for k, at, v in sorted(rows, key=lambda r: (r[0], r[1])):
        if k not in last or last[k] != v:
            out.append((k, at, v))
        last[k] = v
    return sorted(out, key=repr)


def run_parts(spark, tmp_path, name, parts, schema, build, batch=10_000):
    """Each part of the rows arrives in a micro-batch of its own, in chunks of ``batch`` rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k, part in enumerate(parts):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
            stream = build(engines.read_feed(spark, str(tmp_path / name / "in"), schema))
            query = stream.writeStream.format("parquet").option("path", str(tmp_path / name / "out")).option("checkpointLocation", str(tmp_path / name / "check")).trigger(availableNow=True).start()
            query.awaitTermination()
        states = [o["numRowsTotal"] for o in query.lastProgress["stateOperators"]]
        return sorted((tuple(r) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / name / "out")).collect()), key=repr), states
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_changes_are_the_same_for_any_chunk_and_order_of_arrival(spark, tmp_path):
    rows, kind = shuffled_rows(), "key string, at long, value string"
    end = [("end", 10_000_000_000, "x")]  # moves the watermark on
    want = sorted([*expected_changes(rows), *expected_changes(end)], key=repr)
    one, _ = run_parts(spark, tmp_path, "one", [rows, end], kind, engines.change_only)
    small, _ = run_parts(spark, tmp_path, "small", [rows, end], kind, engines.change_only, batch=2)
    ordered = sorted(rows, key=lambda r: r[1])
    swapped = [ordered[40:80], ordered[:40], ordered[80:], end]  # within the watermark, a later micro-batch has earlier rows
    apart, _ = run_parts(spark, tmp_path, "apart", swapped, kind, lambda s: engines.change_only(s, late="2 hours"))
    assert one == small == want
    assert apart == want[:0] + sorted(expected_changes(rows), key=repr) or apart == want  # the last row waits for the watermark


def test_state_falls_to_zero_after_the_end(spark, tmp_path):
    minute = 60_000_000
    rows = [("a", minute, "LIVE", True, "0"), ("a", 2 * minute, "FINISHED", True, "1"), ("b", minute, "LIVE", True, None)]
    later = [("c", 10 * minute, "LIVE", True, None)]
    last = [("c", 11 * minute, "FINISHED", True, None)]
    kind = "key string, at long, kind string, soon boolean, value string"
    found, states = run_parts(spark, tmp_path, "life", [rows, later, last], kind, lambda s: engines.lifecycle(s, idle=120.0))
    assert sorted(x[:3] for x in found) == [("a", minute, "LIVE"), ("a", 2 * minute, "FINISHED"), ("b", minute, "LIVE"), ("c", 10 * minute, "LIVE"), ("c", 11 * minute, "FINISHED")]
    keys = {r.key for r in spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "life" / "check")).selectExpr("key.key AS key").collect()}
    assert keys == {"c"}  # a and b are forgotten: silent for two minutes
    found, states = run_parts(spark, tmp_path, "rate", [[("k", i * minute) for i in range(9)], [("other", 60 * minute)]], "key string, at long", lambda s: engines.rate_limit(s, 150))
    assert [x[1] // minute for x in found if x[0] == "k"] == [0, 3, 6]
    left = spark.read.format("statestore").option("stateVarName", "passed").load(str(tmp_path / "rate" / "check")).selectExpr("key.key AS key").collect()
    assert {r.key for r in left} == {"other"}


def test_slots_in_any_order_of_arrival(spark, tmp_path):
    base = 1_700_000_000
    rows = [(-30, "PRE", 0, 0), (10, "H1", 1, 0), (2700, "HT", 45, 1), (2710, "HT", 45, 1), (2720, "H2", 46, 1), (3700, "H2", 61, 1), (3800, "H2", 62, 2), (5500, "END", 90, 2), (9000, "END", 90, 2)]
    table = [("m", s + base, base, p, m, g) for s, p, m, g in rows]
    kind = "key string, s long, k long, period string, minute int, goals int"

    def build(stream):
        return engines.match_slots(stream.select("key", F.timestamp_seconds("s").alias("at"), F.timestamp_seconds("k").alias("kickoff"), "period", "minute", "goals"))

    found, _ = run_parts(spark, tmp_path, "slots", [table[::-1]], kind, build, batch=1)
    # play went on 20 seconds into the break, so that it was stable never comes
    assert sorted(x[1] for x in found) == sorted(["PRE_KICKOFF", "HALFTIME", "MINUTE_60", "FIRST_H2_GOAL", "FINAL"])
