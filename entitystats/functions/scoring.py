"""Probabilities, odds, stakes and recommendations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Recommendation limits and default American odds - fixed values.
OVER_LIMIT, UNDER_LIMIT = 0.55, 0.45
DEFAULT_AMERICAN = -110


def clamp(x: Column, low: float, high: float) -> Column:
    """Between the limits; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def model_probability(raw: Column, line: Column) -> Column:
    """Sigmoid of prediction minus line."""
    return 1.0 / (1.0 + F.exp(-(raw - line)))


def heuristic_probability(mean: Column, line: Column) -> Column:
    """Linear in the distance to the line, kept in [0.05, 0.95]."""
    return clamp(0.5 + (mean - line) * 0.05, 0.05, 0.95)


def scaled_probability(predicted: Column, line: Column) -> Column:
    """Sigmoid of a fifth of the distance, kept in [0.0001, 0.9999]."""
    return clamp(1.0 / (1.0 + F.exp(-((predicted - line) / 5.0))), 0.0001, 0.9999)


def recommendation(over: Column) -> Column:
    return F.when(over > OVER_LIMIT, "OVER").when(over < UNDER_LIMIT, "UNDER")


def confidence(over: Column) -> Column:
    return F.abs(over - 0.5) * 200


def decimal_odds(american: Column) -> Column:
    return F.when(american > 0, american / 100.0 + 1.0).otherwise(100.0 / F.abs(american) + 1.0)


def expected_value(over: Column, odds_over: Column | int = DEFAULT_AMERICAN, odds_under: Column | int = DEFAULT_AMERICAN) -> Column:
    """The better of betting over and betting under one unit."""
    as_col = lambda o: F.lit(o) if isinstance(o, int) else o
    return F.greatest(over * decimal_odds(as_col(odds_over)) - 1.0, (1.0 - over) * decimal_odds(as_col(odds_under)) - 1.0)


def implied_probability(decimal: Column) -> Column:
    return F.when(decimal > 0, 1.0 / decimal).otherwise(F.lit(0.0))


def unit_ev(prob: Column, decimal: Column) -> Column:
    """Expected profit of a unit stake."""
    return prob * (decimal - 1.0) - (1.0 - prob)


def kelly_fraction(prob: Column, decimal: Column) -> Column:
    """(b p - q) / b in [0, 1]; 0 when the odds pay nothing."""
    b = decimal - 1.0
    return F.when(b > 0, clamp((b * prob - (1.0 - prob)) / b, 0.0, 1.0)).otherwise(F.lit(0.0))


def score_columns(predicted: Column, over: Column) -> dict[str, Column]:
    return {
        "predicted_value": predicted,
        "over_probability": over,
        "under_probability": 1.0 - over,
        "recommendation": recommendation(over),
        "expected_value": expected_value(over),
        "confidence": confidence(over),
    }


def heuristic_score(average: Column, line: Column) -> dict[str, Column]:
    """Expected side and a score of 80, 50, 25 or 20 by distance to the line."""
    gap = F.abs(average - line)
    return {
        "expected_side": F.when(average >= line, "OVER").when(average < line, "UNDER"),
        "heuristic_score": F.when(average.isNull(), 20).when(gap >= 2, 80).when(gap >= 0.5, 50).otherwise(25),
    }


def review(
    side: Column, expected: Column, agreement: Column, score: Column, heuristic: Column,
    limit: int = 60, max_delta: int = 20,
) -> dict[str, Column]:
    """Withdraw a side that disagrees while overall agreement is low; flag large score gaps."""
    withdrawn = ~side.eqNullSafe(expected) & (agreement < limit)
    apart = F.coalesce(F.abs(score - heuristic) > max_delta, F.lit(False))
    return {
        "final_side": F.when(~withdrawn, side),
        "flagged": withdrawn | apart,
        "original_side": F.when(withdrawn | apart, side),
    }


def conflict(side: Column, other: Column, other_confidence: Column, limit: int = 60) -> Column:
    """Two sides differ and the other one is confident enough."""
    return F.coalesce(side.isNotNull() & other.isNotNull() & (side != other) & (other_confidence >= limit), F.lit(False))
