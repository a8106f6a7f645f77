"""Team names, arena coordinates and rivalries.

Fixed values: codes, names, latitude, longitude and altitude in metres must be
these for results to agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (code, city, nickname, latitude, longitude, altitude_m) - fixed values.
TEAMS = [
    ("ATL", "atlanta", "hawks", 33.755, -84.39, 313),
    ("BOS", "boston", "celtics", 42.366, -71.062, 14),
    ("BKN", "brooklyn", "nets", 40.682, -73.975, 10),
    ("CHA", "charlotte", "hornets", 35.226, -80.84, 241),
    ("CHI", "chicago", "bulls", 41.88, -87.63, 181),
    ("CLE", "cleveland", "cavaliers", 41.43, -81.69, 207),
    ("DAL", "dallas", "mavericks", 32.79, -96.77, 140),
    ("DEN", "denver", "nuggets", 39.748, -104.996, 1609),
    ("DET", "detroit", "pistons", 42.7, -83.054, 181),
    ("GSW", "golden state", "warriors", 37.768, -122.387, 16),
    ("HOU", "houston", "rockets", 29.75, -95.36, 13),
    ("IND", "indiana", "pacers", 39.76, -86.15, 218),
    ("LAC", "los angeles", "clippers", 33.96, -118.14, 89),
    ("LAL", "los angeles", "lakers", 34.043, -118.267, 89),
    ("MEM", "memphis", "grizzlies", 35.138, -90.05, 99),
    ("MIA", "miami", "heat", 25.78, -80.22, 2),
    ("MIL", "milwaukee", "bucks", 43.045, -87.917, 188),
    ("MIN", "minnesota", "timberwolves", 44.98, -93.27, 264),
    ("NOP", "new orleans", "pelicans", 29.948, -90.08, 2),
    ("NYK", "new york", "knicks", 40.75, -73.993, 10),
    ("OKC", "oklahoma city", "thunder", 35.463, -97.516, 370),
    ("ORL", "orlando", "magic", 28.539, -81.383, 26),
    ("PHI", "philadelphia", "76ers", 39.901, -75.171, 12),
    ("PHX", "phoenix", "suns", 33.445, -112.07, 331),
    ("POR", "portland", "trail blazers", 45.52, -122.665, 15),
    ("SAC", "sacramento", "kings", 38.580, -121.499, 9),
    ("SAS", "san antonio", "spurs", 29.427, -98.437, 198),
    ("TOR", "toronto", "raptors", 43.643, -79.379, 76),
    ("UTA", "utah", "jazz", 40.768, -111.901, 1288),
    ("WAS", "washington", "wizards", 38.898, -77.02, 6),
]

#: Further spellings - fixed values.
MORE_NAMES = {"cleveland cavs": "CLE", "portland": "POR"}

#: Unordered rival pairs - fixed values.
RIVALS = [("LAL", "LAC"), ("LAL", "BOS"), ("NYK", "BOS"), ("GSW", "LAL"), ("PHI", "NYK"), ("BKN", "NYK")]

HIGH_ALTITUDE_M = 1000
EARTH_RADIUS_KM = 6371.0


def default_names() -> dict[str, str]:
    names = {f"{city} {nick}": code for code, city, nick, *_ in TEAMS}
    names.update({nick: code for code, _, nick, *_ in TEAMS})
    names.update(MORE_NAMES)
    return names


def literal_map(names: dict[str, str]) -> Column:
    """A constant map column; for the fixed name tables, a few hundred entries."""
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])


def team_code(name: Column, names: dict[str, str] | None = None) -> Column:
    """Three-letter code: kept if already one, else full name, else last word,
    else the first three letters in capitals."""
    lookup = literal_map(names or default_names())
    text = F.trim(name)
    key = F.lower(text)
    words = F.split(F.trim(F.regexp_replace(key, r"\s+", " ")), " ")
    is_code = (F.length(text) == 3) & (text == F.upper(text)) & (F.upper(text) != key)
    return F.when(name.isNull() | (name == ""), name).when(is_code, text).otherwise(
        F.coalesce(lookup[key], lookup[F.element_at(words, -1)], F.substring(F.upper(text), 1, 3))
    )


def coordinates(spark: SparkSession) -> DataFrame:
    """code, lat, lon, altitude_m - thirty rows."""
    return spark.createDataFrame(
        [(code, lat, lon, float(alt)) for code, _, _, lat, lon, alt in TEAMS],
        "code string, lat double, lon double, altitude_m double",
    )


def rival_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(sorted(p)) for p in RIVALS], "low string, high string")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    dphi, dlam = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dphi / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(dlam / 2), F.lit(2.0)
    )
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))
