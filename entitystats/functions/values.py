"""Scalar coercions and sports arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scale factors and unit conversions - fixed values.
PER_FACTOR, PER_SCALE = 2.5, 0.34
WS_FACTOR, WS_SCALE = 0.018, 0.31
MPS_TO_MPH = 2.2369362920544
METRES_PER_MILE = 1609.344
BPM_BASE, BPM_FACTOR = 15.0, 0.4


def first_present(*cols: Column) -> Column:
    """First value that is not null."""
    return F.coalesce(*cols)


def first_truthy(*cols: Column) -> Column:
    """First number that is neither null nor zero."""
    return F.coalesce(*[F.nullif(c, F.lit(0)) for c in cols])


def first_nonblank(*cols: Column) -> Column:
    """First text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def int_text(text: Column) -> Column:
    """'1,234 ' as 1234; null when it is not a whole number."""
    return F.trim(F.regexp_replace(text, ",", "")).try_cast("bigint")


def id_number(text: Column) -> Column:
    """'1631210.0' and '1631210' as 1631210; null when unreadable."""
    return F.trim(text).try_cast("double").try_cast("bigint")


def float_text(text: Column) -> Column:
    """Number with an optional trailing percent sign; null when unreadable."""
    return F.regexp_replace(F.trim(text.cast("string")), "%$", "").try_cast("double")


def as_share(value: Column) -> Column:
    """Percentages above one become shares."""
    return F.when(value > 1.0, value / 100.0).otherwise(value)


def box_efficiency(pts, ast, reb, stl, blk, tov, fga, fgm, fta, ftm) -> Column:
    """Points and credits minus misses and turnovers."""
    missed = F.greatest(F.lit(0.0), fga - fgm) + F.greatest(F.lit(0.0), fta - ftm)
    return pts + reb + ast + stl + blk - missed - tov


def minutes_factor(minutes: Column) -> Column:
    return F.when(minutes > 0, minutes / 30.0).otherwise(F.lit(1.0))


def per_estimate(eff: Column, scale: float | Column = PER_SCALE) -> Column:
    return eff * PER_FACTOR * scale


def ws_per_game(eff: Column, minutes: Column, scale: float | Column = WS_SCALE) -> Column:
    return F.greatest(F.lit(0.0), eff) * WS_FACTOR * minutes_factor(minutes) * scale


def bpm_estimate(per: Column, bpm: Column | None = None) -> Column:
    """Given box plus-minus, else (PER - 15) * 0.4."""
    approx = (per - BPM_BASE) * BPM_FACTOR
    return approx if bpm is None else F.coalesce(bpm, approx)


def contract_year(end_year: Column, current_year: int | Column) -> Column:
    """1 when the contract ends this year or the next."""
    year = F.lit(current_year) if isinstance(current_year, int) else current_year
    return F.coalesce(end_year.isin(year, year + 1).cast("int"), F.lit(0))


def matchup_home_flag(matchup: Column) -> Column:
    """1 for 'A vs B' or 'A vs. B', 0 for other text, null without text."""
    return (matchup.contains(" vs ") | matchup.contains(" vs. ")).cast("int")


def matchup_teams(matchup: Column) -> dict[str, Column]:
    """Home and away side of 'A vs B' (A at home) and 'A @ B' (B at home)."""
    away_form = F.split(matchup, " @ ", 2)
    home_form = F.split(F.regexp_replace(matchup, r" vs\. ", " vs "), " vs ", 2)
    is_away, is_home = matchup.contains(" @ "), matchup_home_flag(matchup) == 1
    side = lambda i, j: F.when(is_away, F.trim(F.get(away_form, F.lit(i)))).when(is_home, F.trim(F.get(home_form, F.lit(j))))
    return {"home_team": side(1, 0), "away_team": side(0, 1)}


def all_star(*flags: Column) -> Column:
    """1 when any of the flags is set."""
    hit = F.lit(False)
    for f in flags:
        hit = hit | F.coalesce(f.cast("boolean"), F.lit(False))
    return hit.cast("int")


def award_count(awards: Column) -> Column:
    """Length of the list; 0 without one."""
    return F.greatest(F.coalesce(F.size(awards), F.lit(0)), F.lit(0))
