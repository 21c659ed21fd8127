"""Countries by their codes and names in two languages, as one name each.

The names come from a rule: the JVM's list of countries gives two-letter and three-letter codes, English and German names.
Fixed values below are what that list doesn't have: codes of sports bodies, football's own nations, other spellings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitchspark.functions.text import normal_name

# Sports codes that aren't the three-letter codes of the standard, with the country's two letters.
SPORT_CODES = {
    "alg": "dz", "ang": "ao", "bah": "bs", "ban": "bd", "bar": "bb", "ber": "bm", "bot": "bw", "bru": "bn", "bul": "bg", "cam": "cm", "cgo": "cg", "cha": "td", "chi": "cl", "crc": "cr",
    "cro": "hr", "den": "dk", "eqg": "gq", "fij": "fj", "gam": "gm", "ger": "de", "gre": "gr", "gua": "gt", "gui": "gn", "hai": "ht", "hon": "hn", "ksa": "sa", "kuw": "kw", "les": "ls",
    "mad": "mg", "mas": "my", "mri": "mu", "mtn": "mr", "nca": "ni", "ned": "nl", "nep": "np", "nig": "ne", "oma": "om", "par": "py", "phi": "ph", "ple": "ps", "por": "pt", "pur": "pr",
    "rsa": "za", "slo": "si", "sri": "lk", "sud": "sd", "sui": "ch", "tah": "pf", "tan": "tz", "tog": "tg", "tri": "tt", "uae": "ae", "uk": "gb", "uru": "uy", "vie": "vn", "zam": "zm", "zim": "zw",
}
# Names in use here where the standard's German name is another one.
NAMES = {
    "ae": "Vereinigte Arabische Emirate", "by": "Belarus", "bn": "Brunei", "ci": "Elfenbeinküste", "cd": "Demokratische Republik Kongo", "cv": "Kap Verde", "gb": "England", "hk": "Hongkong", "mo": "Macau",
    "md": "Moldawien", "pf": "Tahiti", "ps": "Palästina", "us": "USA", "sz": "Eswatini", "cz": "Tschechien", "kp": "Nordkorea", "kr": "Südkorea", "tr": "Türkei", "mk": "Nordmazedonien",
}
# Further names, with the country's two letters.
SPELLINGS = {
    "united states": "us", "great britain": "gb", "united kingdom": "gb", "turkey": "tr", "ivory coast": "ci", "cote divoire": "ci", "cote d ivoire": "ci", "czech republic": "cz", "czechia": "cz",
    "cape verde": "cv", "swaziland": "sz", "macedonia": "mk", "north macedonia": "mk", "mazedonien": "mk", "south korea": "kr", "north korea": "kp", "hong kong": "hk", "macao": "mo", "palestine": "ps",
    "moldova": "md", "democratic republic of the congo": "cd", "dr congo": "cd", "republic of ireland": "ie", "v a emirate": "ae", "weissrussland": "by", "burma": "mm", "tahiti": "pf", "russia": "ru",
}
# Nations of football that are no countries of the standard.
NATIONS = {"eng": "England", "sco": "Schottland", "scotland": "Schottland", "wal": "Wales", "nir": "Nordirland", "northern ireland": "Nordirland", "kos": "Kosovo", "int": "International", "international": "International"}


def country_names(spark: SparkSession, more: dict[str, str] | None = None) -> DataFrame:
    """alias and country, both normalised: codes, English and German names and other spellings of every country. A bounded
    table (some 1,100 rows). ``more`` adds aliases and goes before all others."""
    locale = spark._jvm.java.util.Locale
    german, english = locale("de"), locale("en")
    rows: dict[str, str] = {}
    own: dict[str, str] = {}
    for code in locale.getISOCountries():
        place = locale("", code)
        two, local = str(code).lower(), str(place.getDisplayCountry(german))
        own[two] = NAMES.get(two, local)
        for alias in (two, str(place.getISO3Country()).lower(), str(place.getDisplayCountry(english)), local, own[two]):
            rows[alias] = own[two]
    rows |= {alias: own[two] for table in (SPORT_CODES, SPELLINGS) for alias, two in table.items()}
    rows |= NATIONS | {name: name for name in NATIONS.values()} | (more or {})
    table = spark.createDataFrame(list(rows.items()), "alias string, country string")
    named = table.select(normal_name("alias").alias("alias"), normal_name("country").alias("country"))
    return named.dropDuplicates(["alias"])
