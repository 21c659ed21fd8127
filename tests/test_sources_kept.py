"""Exactly-once outbox, raw payloads with replay and retention, pinned reads."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pitchspark.sources import payloads, pinned
from pitchspark.streaming import engines, outbox


class Killed(RuntimeError):
    pass


def killer(step, times=1):
    left = [times]

    def fail(at):
        if at == step and left[0]:
            left[0] -= 1
            raise Killed(at)

    return fail


SCHEMA = "id int, day string"


def rows_of(spark, root):
    return sorted((r.id, r.day) for r in outbox.published(spark, root, SCHEMA).collect())


@pytest.mark.parametrize("step", ["staged", "published", "entered"])
def test_a_killed_epoch_is_published_once(spark, tmp_path, step):
    root, source = str(tmp_path / "root"), str(tmp_path / "in")
    spark.createDataFrame([(k, f"d{k % 2}") for k in range(6)], SCHEMA).coalesce(1).write.parquet(source)
    run = lambda fail: outbox.outbox(engines.read_feed(spark, source, SCHEMA), root, "q", str(tmp_path / "check"), ["day"], fail)
    with pytest.raises(Exception, match="Killed|killed|StreamingQueryException"):
        run(killer(step)).awaitTermination()
    assert rows_of(spark, root) in ([], [(k, f"d{k % 2}") for k in range(6)])  # all or nothing shows
    run(lambda at: None).awaitTermination()
    assert rows_of(spark, root) == [(k, f"d{k % 2}") for k in range(6)]
    spark.createDataFrame([(9, "d9")], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run(lambda at: None).awaitTermination()
    run(lambda at: None).awaitTermination()
    assert rows_of(spark, root) == [*((k, f"d{k % 2}") for k in range(6)), (9, "d9")]
    assert sorted(r.rows for r in outbox.ledger(spark, root).collect()) == [1, 6]


def test_publishing_twice_and_two_queries(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA)
    assert outbox.published(spark, root, SCHEMA).count() == 0 and outbox.ledger(spark, root).count() == 0
    assert outbox.publish(df, root, "x", 0) and not outbox.publish(df, root, "x", 0) and outbox.publish(df.limit(1), root, "y", 0)
    assert outbox.published(spark, root, SCHEMA).count() == 3
    spark.createDataFrame([(5, "z")], SCHEMA).write.parquet(f"{root}/data/query=x/epoch=7")  # renamed, not in the ledger
    assert outbox.published(spark, root, SCHEMA).count() == 3


# --- raw payloads ------------------------------------------------------------------------------------------------


def at(text):
    return dt.datetime.fromisoformat(f"{text}+00:00")


INCOMING = "kind string, identity string, halftime boolean, observed_at timestamp, payload string"
ROWS = [
    ("live", "e1", False, at("2026-01-01T10:00:00"), '{"b": 1, "a": 2}'),
    ("live", "e1", False, at("2026-01-01T10:01:00"), '{"a":2,"b":1}'),  # the same content
    ("live", "e1", False, at("2026-01-01T10:02:00"), '{"a":3,"b":1}'),
    ("live", "e1", False, at("2026-01-01T10:03:00"), '{"a":2,"b":1}'),  # back again
    ("live", "e1", False, at("2026-01-02T09:00:00"), '{"a":2,"b":1}'),  # another day
    ("detail", "e1", True, at("2026-01-01T10:00:00"), "not json"),
    ("paper_entries", "p1", None, at("2026-01-01T08:00:00"), '{"a":3,"b":1}'),
]


def test_payloads_replay_what_was_stored(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame(ROWS, INCOMING)
    assert payloads.store(spark, root, df).count() == 6
    assert payloads.store(spark, root, df).count() == 0  # done again, nothing is added
    stored, seen = payloads.tables(spark, root)
    assert stored.count() == 3 and seen.count() == 6
    now = lambda text: F.lit(text).cast("timestamp")
    known = lambda text: {(r.kind, r.identity): r.payload for r in payloads.replay(spark, root, now(text)).collect()}
    assert known("2026-01-01 10:01:30")["live", "e1"] == '{"a":2,"b":1}' and known("2026-01-01 10:02:30")["live", "e1"] == '{"a":3,"b":1}'
    assert set(known("2026-01-01 09:00:00")) == {("paper_entries", "p1")} and known("2026-01-03 00:00:00")["detail", "e1"] == "not json"
    every = payloads.replay(spark, root).where("kind = 'live'").orderBy("observed_at").collect()
    assert [json.loads(r.payload)["a"] for r in every] == [2, 3, 2, 2]
    until = {r.observed_at: r.until for r in payloads.validity(seen.where("kind = 'live'")).collect()}
    assert sorted(v is None for v in until.values()) == [False, False, False, True]


def test_an_earlier_observation_that_comes_late_takes_its_place(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame(ROWS, INCOMING)
    payloads.store(spark, root, df.where("observed_at >= '2026-01-01 10:03:00' AND kind = 'live'"))
    payloads.store(spark, root, df.where("observed_at < '2026-01-01 10:03:00' AND kind = 'live'"))
    found = payloads.replay(spark, root, F.lit("2026-01-01 10:02:10").cast("timestamp")).collect()
    assert [r.payload for r in found] == ['{"a":3,"b":1}']


def test_retention_spares_preserved_kinds_and_needed_payloads(spark, tmp_path):
    root = str(tmp_path)
    payloads.store(spark, root, spark.createDataFrame(ROWS, INCOMING))
    now = F.lit("2026-01-03 08:00:00").cast("timestamp")
    stored, seen = payloads.tables(spark, root)
    assert payloads.expired(seen, now, -1).count() == 0
    assert payloads.retain(spark, root, now, 1) == (4, 1)
    stored, seen = payloads.tables(spark, root)
    assert sorted((r.kind, r.observed_at.day) for r in seen.collect()) == [("live", 2), ("paper_entries", 1)]
    assert sorted(r.payload for r in stored.collect()) == ['{"a":2,"b":1}', '{"a":3,"b":1}']  # the preserved entry needs the second
    assert payloads.retain(spark, root, now, 1) == (0, 0)
    # what expired doesn't keep a new observation of the same content from being stored
    again = spark.createDataFrame([("detail", "e1", True, at("2026-01-01T10:00:00"), "not json")], INCOMING)
    assert payloads.store(spark, root, again).count() == 1
    assert payloads.retain(spark, root, F.lit("2027-01-01").cast("timestamp"), 0, ()) == (3, 3)
    stored, seen = payloads.tables(spark, root)
    assert stored.count() == 0 and seen.count() == 0


# --- pinned reads ------------------------------------------------------------------------------------------------


def test_pinned_reads_see_one_state(spark, tmp_path):
    table, where = str(tmp_path / "t"), str(tmp_path / "m")
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, day string").write.partitionBy("day").parquet(table)
    manifest = pinned.pin(spark, table, where)
    before = pinned.identity(manifest).first()
    read = lambda: sorted((r.id, r.day) for r in pinned.read_pinned(spark, table, manifest, "id int, day string").collect())
    assert read() == [(1, "a"), (2, "b")]
    spark.createDataFrame([(3, "a")], "id int, day string").write.mode("append").partitionBy("day").parquet(table)
    assert read() == [(1, "a"), (2, "b")] and spark.read.parquet(table).count() == 3
    assert pinned.pin(spark, table, where).count() == manifest.count() and pinned.identity(manifest).first() == before
    victim = next((tmp_path / "t" / "day=b").glob("*.parquet"))
    body = victim.read_bytes()
    victim.unlink()
    with pytest.raises(pinned.SourceChanged, match="GONE"):
        read()
    victim.write_bytes(body + b"x")
    with pytest.raises(pinned.SourceChanged, match="CHANGED"):
        read()


def test_pinned_table_without_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    manifest = pinned.pin(spark, str(tmp_path / "t"), str(tmp_path / "m"))
    assert pinned.read_pinned(spark, str(tmp_path / "t"), manifest, "id int").count() == 0
