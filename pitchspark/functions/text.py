"""Column functions over names, labels and ids."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pitchspark.functions.numbers import col

# Words of team names that keep teams apart, words that say nothing, other spellings of cities and clubs.
MARKERS = ("ii", "iii", "iv", "b", "reserve", "reserves", "u17", "u18", "u19", "u20", "u21", "u23", "youth", "women", "woman", "frauen", "ladies", "femenino", "feminino", "w")
DECORATIONS = ("ac", "afc", "as", "bsc", "calcio", "cf", "club", "fc", "fk", "sc", "sk", "ssc", "sv", "tsv", "us", "vfb", "vfl")
CITIES = {"munich": "munchen", "muenchen": "munchen", "vienna": "wien"}
CLUBS = {
    "tsg hoffenheim": "hoffenheim", "borussia dortmund": "dortmund", "bayer leverkusen": "leverkusen", "borussia m gladbach": "borussia monchengladbach",
    "m gladbach": "borussia monchengladbach", "fc augsburg": "augsburg", "sc freiburg": "freiburg", "1 fc koln": "koln", "fc koln": "koln", "fsv mainz 05": "mainz 05",
    "sc paderborn 07": "paderborn", "paderborn 07": "paderborn", "hsv": "hamburger sv",
}
#: Names that an old export broke, and what they were.
BROKEN = {"M\ufffdnchengladbach": "Mönchengladbach", "M\ufffdnchen": "München", "K\ufffdln": "Köln"}


@F.pandas_udf(StringType())
def _decomposed(x: pd.Series) -> pd.Series:
    """NFKD, case folded, without combining marks: the JVM has no expression for it. Each distinct value of a batch once."""
    import unicodedata

    found = {v: "".join(ch for ch in unicodedata.normalize("NFKD", v).casefold() if not unicodedata.combining(ch)) for v in x.dropna().unique()}
    return x.map(found).astype(object)


def normal_name(x: Column | str) -> Column:
    """Compatibility forms and case folded, marks gone (letters with a stroke stay), ß as ss, & as and, some cities in one
    spelling, everything but letters and digits of any script as one space."""
    out = F.regexp_replace(F.replace(_decomposed(col(x)), F.lit("ß"), F.lit("ss")), "&", " and ")
    for name, other in CITIES.items():
        out = F.regexp_replace(out, rf"(?U)\b{name}\b", other)
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def team_name(x: Column | str) -> Column:
    name = normal_name(x)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for pair in CLUBS.items() for v in pair]), name), name)


def team_core(name: Column) -> Column:
    """A normalised name without words like fc or club; the name itself if nothing is left."""
    core = F.array_join(F.array_except(F.split(name, " "), F.array(*[F.lit(d) for d in DECORATIONS])), " ")
    return F.when(core != "", core).otherwise(name)


def label_key(country: Column, name: Column, labels: dict[str, list[tuple[str, ...]]]) -> Column:
    """A normalised competition name, or the group of labels of its country that it belongs to (``labels`` are normalised)."""
    table = {f"{place}|{label}": f"label:{place}:{k}" for place, groups in labels.items() for k, group in enumerate(groups) for label in group}
    if not table:
        return name
    found = F.try_element_at(F.create_map(*[F.lit(v) for pair in table.items() for v in pair]), F.concat_ws("|", country, name))
    return F.coalesce(found, name)


def repaired(x: Column | str) -> Column:
    out = col(x)
    for bad, good in BROKEN.items():
        out = F.replace(out, F.lit(bad), F.lit(good))
    return out


def fold_umlauts(x: Column | str) -> Column:
    """The German spelling: ä as ae and so on (not the same as :func:`normal_name`)."""
    out = F.lower(col(x))
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def marker_set(x: Column | str) -> Column:
    return F.array_sort(F.array_intersect(F.split(team_name(x), " "), F.array(*[F.lit(m) for m in MARKERS])))


def last_number(x: Column | str) -> Column:
    found = F.regexp_extract_all(col(x), F.lit(r"(-?[0-9]+(?:\.[0-9]+)?)"), 1)
    return F.when(F.size(found) > 0, F.element_at(found, -1).cast("double"))


def minute_and_added(x: Column | str) -> Column:
    """Struct of the minute and the added time of a clock like 45+2; added is null without a plus."""
    part = lambda k: F.regexp_extract(col(x), r"^\s*([0-9]+)(?:\s*\+\s*([0-9]+))?", k)
    number = lambda c: F.when(c != "", c.cast("int"))
    return F.struct(number(part(1)).alias("minute"), number(part(2)).alias("added"))


def all_digits(x: Column | str) -> Column:
    """Every digit of the text as one number (45+2 as 452), as the archive has it."""
    found = F.regexp_replace(col(x), "[^0-9]", "")
    return F.when(found != "", found.cast("long"))


def slug(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(col(x))), r"[^A-Z0-9]+", "_"), r"^_+|_+$", "")


def stable_id(x: Column | str, space: str, prefix: str = "match_", length: int = 24) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(F.lit(f"{space}:"), col(x).cast("string")), 256), 1, length))


def truth(x: Column | str) -> Column:
    """Provider flags: null stays unknown; 0, false, no and off are false; all else is true."""
    x = F.lower(F.trim(col(x).cast("string")))
    return F.when(x.isNotNull(), ~x.isin("0", "false", "no", "off", ""))


def sequence_ratio(a: Column | str, b: Column | str) -> Column:
    """Ratcliff-Obershelp similarity of two texts, 0 to 1; an Arrow UDF, to be used behind blocking only."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        seen: dict[tuple, float] = {}
        out = []
        for pair in zip(x, y):
            if None in pair:
                out.append(None)
            else:
                if pair not in seen:
                    seen[pair] = SequenceMatcher(None, *pair).ratio()
                out.append(seen[pair])
        return pd.Series(out, dtype="float64")

    return run(col(a), col(b))
