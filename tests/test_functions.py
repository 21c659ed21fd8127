from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pitchspark.functions import numbers, text, times


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


def test_probabilities(spark):
    assert one(spark, numbers.two_way_probability("a", "b"), a=2.0, b=2.0) == 0.5
    assert one(spark, numbers.two_way_probability("a", "b"), a=1.0, b=2.0) is None
    assert one(spark, numbers.power_probability("a", "b"), a=4.0, b=1.2) == pytest.approx(0.19400163962261957, abs=1e-15)
    assert one(spark, numbers.haircut("a", 0.1), a=3.0) == pytest.approx(2.8)


def test_wilson_limits(spark):
    low, high = numbers.wilson("k", "n")
    assert one(spark, low, k=0, n=10) == 0.0 and one(spark, high, k=10, n=10) == pytest.approx(1.0)
    assert one(spark, low, k=0, n=0) is None
    assert one(spark, low, k=5, n=10) == pytest.approx(0.2365931, abs=1e-6)


def test_money_is_half_up(spark):
    assert one(spark, numbers.money(F.lit(Decimal("2.675")))) == Decimal("2.68")
    assert one(spark, numbers.number_or_null("a"), a="12,5 %") == 12.5
    assert one(spark, numbers.number_or_null("a"), a="none") is None
    assert one(spark, numbers.finite("a"), a=float("nan")) is None


def test_stake_split_evens_payouts(spark):
    split = one(spark, numbers.stake_split(F.lit(100.0), F.lit(3.0), F.lit(1.5)))
    assert split["first"] + split["second"] == 10000 and abs(split["first"] * 3.0 - split["second"] * 1.5) <= 4.5
    assert one(spark, numbers.stake_split(F.lit(100.0), F.lit(1.0), F.lit(1.5))) is None


def test_names(spark):
    assert one(spark, text.normal_name("a"), a="  FC Köln & Größe-04 ") == "fc koln and grosse 04"
    assert one(spark, text.normal_name("a"), a="Łódź Øst ﬁne ДИНАМО Munich") == "łodz øst fine динамо munchen"
    assert one(spark, text.team_name("a"), a="TSG Hoffenheim") == "hoffenheim"
    assert one(spark, text.team_core(F.lit("fc koln"))) == "koln" and one(spark, text.team_core(F.lit("fc sc"))) == "fc sc"
    assert one(spark, text.label_key(F.lit("usa"), F.lit("mls"), {"usa": [("mls", "major league soccer")]})) == "label:usa:0"
    assert one(spark, text.repaired("a"), a="1. FC K\ufffdln") == "1. FC Köln"
    assert one(spark, text.fold_umlauts("a"), a="Köln") == "koeln"
    assert one(spark, text.marker_set("a"), a="Bayern II (U19)") == ["ii", "u19"]
    assert one(spark, text.last_number("a"), a="over 2 : 1.5") == 1.5
    assert one(spark, text.minute_and_added("a"), a="45+2").asDict() == {"minute": 45, "added": 2}
    assert one(spark, text.all_digits("a"), a="45+2") == 452
    assert one(spark, text.slug("a"), a=" Penalty goal! ") == "PENALTY_GOAL"
    assert one(spark, text.truth("a"), a="No") is False
    assert one(spark, text.sequence_ratio("a", "b"), a="abcd", b="bcde") == pytest.approx(0.75)


def test_times(spark):
    assert one(spark, times.utc("a"), a="2026-01-02T03:04:05Z") == datetime(2026, 1, 2, 3, 4, 5)
    assert one(spark, times.utc("a", naive_is_utc=False), a="2026-01-02T03:04:05") is None
    assert one(spark, times.season_label(F.lit("2025-07-01").cast("date"))) == "2025/26"
    assert one(spark, times.season_label(F.lit("2025-06-30").cast("date"))) == "2024/25"
    assert one(spark, times.age_bucket(F.lit(None).cast("double"))) == "UNKNOWN"
    assert one(spark, times.display(F.lit("2026-07-01 12:00:00").cast("timestamp"))) == "01.07.2026 14:00:00"
