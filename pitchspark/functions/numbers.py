"""Column functions over quotes, probabilities, money and ratios. Missing input gives null, never zero."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Fixed value: two-sided 95 % point of the normal distribution.
Z95 = 1.959963984540054


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def valid_quote(q: Column | str) -> Column:
    """The quote, or null if it isn't above one (or not a number)."""
    q = col(q)
    return F.when(~F.isnan(q) & (q > 1), q)


def two_way_probability(a: Column | str, b: Column | str) -> Column:
    """Share of ``a`` in the implied probabilities of a two-sided market, without the margin."""
    a, b = valid_quote(a), valid_quote(b)
    return (1 / a) / (1 / a + 1 / b)


def break_even(a: Column | str, b: Column | str) -> Column:
    """1 - (1/a + 1/b): what is left of the third outcome at even payout."""
    return 1 - (1 / valid_quote(a) + 1 / valid_quote(b))


def power_probability(a: Column | str, b: Column | str, steps: int = 80) -> Column:
    """p**k of side ``a``, with k such that the two implied probabilities raised to it sum to one, by bisection on 0 to 100."""
    p, q = 1 / valid_quote(a), 1 / valid_quote(b)

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        over = F.pow(p, mid) + F.pow(q, mid) > 1
        return F.struct(F.when(over, mid).otherwise(s["lo"]).alias("lo"), F.when(over, s["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(100.0).alias("hi"))
    k = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)
    return F.when(p.isNotNull() & q.isNotNull(), F.pow(p, k))


def haircut(q: Column | str, share: float) -> Column:
    """The quote after its gain is cut by ``share``."""
    return 1 + (valid_quote(q) - 1) * (1 - share)


def pair_features(home: str, away: str, name: str) -> list[Column]:
    """Home, away, total, difference, share and ratio of a metric; null if a side is missing or the denominator is zero."""
    h, a = F.col(home), F.col(away)
    total = h + a
    return [
        F.when(a.isNotNull(), h).alias(f"{name}_home"),
        F.when(h.isNotNull(), a).alias(f"{name}_away"),
        total.alias(f"{name}_total"),
        (h - a).alias(f"{name}_diff"),
        F.when(total != 0, h / total).alias(f"{name}_share"),
        F.when(a != 0, h / a).alias(f"{name}_ratio"),
    ]


def ratio(n: Column | str, d: Column | str) -> Column:
    return F.when(col(d) > 0, col(n) / col(d))


def missing_to_ninety(n: Column | str, d: Column | str) -> Column:
    """How many are missing until nine tenths of ``d``, rounded up."""
    return F.greatest(F.lit(0), F.floor((9 * col(d) + 9) / 10) - col(n)).cast("long")


def wilson(k: Column | str, n: Column | str) -> tuple[Column, Column]:
    """95 % score interval of k of n, within 0 and 1; null without observations."""
    k, n = col(k).cast("double"), col(n).cast("double")
    p = k / n
    middle = p + Z95**2 / (2 * n)
    spread = Z95 * F.sqrt(p * (1 - p) / n + Z95**2 / (4 * n * n))
    scale = 1 + Z95**2 / n
    clamp = lambda x: F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
    return clamp((middle - spread) / scale), clamp((middle + spread) / scale)


def money(x: Column | str) -> Column:
    """Cents, half up, as a decimal."""
    return F.round(col(x).cast("decimal(20,6)"), 2).cast("decimal(18,2)")


def half_up(x: Column | str, digits: int = 2) -> Column:
    return F.round(col(x), digits)


def number_or_null(x: Column | str) -> Column:
    """First number in a text (decimal comma or point, per cent sign and units ignored); null for NaN and infinities."""
    found = F.regexp_extract(F.replace(col(x), F.lit(","), F.lit(".")), r"(-?[0-9]+(?:\.[0-9]+)?)", 1)
    return F.when(found != "", found.cast("double"))


def finite(x: Column | str) -> Column:
    x = col(x)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def decay_weight(seconds_old: Column, half_life_days: float) -> Column:
    return F.exp(-F.log(F.lit(2.0)) * F.greatest(F.lit(0.0), seconds_old / 86400.0) / half_life_days)


def stake_split(total: Column | str, a: Column | str, b: Column | str) -> Column:
    """Struct of the stakes on two quotes that make the payouts most equal, in cents; ties go to the smaller first stake."""
    a, b = valid_quote(a), valid_quote(b)
    cents = F.round(money(total) * 100).cast("long")
    base = F.round(cents * b / (a + b)).cast("long")
    options = F.transform(F.array(base - 1, base, base + 1), lambda s: F.struct(F.abs(s * a - (cents - s) * b).alias("gap"), s.alias("first"), (cents - s).alias("second")))
    good = F.filter(options, lambda o: (o["first"] >= 0) & (o["second"] >= 0))
    return F.when(a.isNotNull() & b.isNotNull() & cents.isNotNull(), F.array_min(good))


def hedge_profile(stake: Column | str, q: Column | str, other: Column | str) -> Column:
    """Struct: the stake on ``other`` that makes both outcomes equal, and the profit then."""
    s, q, o = col(stake), valid_quote(q), valid_quote(other)
    hedge = s * q / o
    return F.struct(money(hedge).alias("hedge"), money(s * q - s - hedge).alias("profit"))


def python_round(x: Column | str, digits: int = 2) -> Column:
    """Rounded by the binary value of a double, as Python does (2.675 gives 2.67); an Arrow UDF, for parity only."""
    @F.pandas_udf(DoubleType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: round(v, digits), na_action="ignore")

    return run(col(x))


def first_path(payload: Column | str, paths: tuple[str, ...]) -> Column:
    """First of several JSON paths that has a value; null for broken JSON."""
    return F.coalesce(*[F.get_json_object(col(payload), p) for p in paths])


def json_list(payload: Column | str, item: str) -> Column:
    """A JSON list of ``item``, empty where the text is null, broken or no list."""
    kind = f"array<{item}>"
    listed = F.startswith(F.ltrim(col(payload)), F.lit("["))
    return F.coalesce(F.when(listed, F.from_json(col(payload), kind)), F.array().cast(kind))


def appended(values: Column, more: Column) -> Column:
    """Distinct values in order of first appearance."""
    return F.array_distinct(F.concat(values, more))


def same_ids(a: Column, b: Column) -> Column:
    """Whether two arrays of ids share one; unknown arrays share none."""
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))
