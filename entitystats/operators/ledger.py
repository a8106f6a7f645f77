"""Replaying betting strategies as window expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitystats.functions.scoring import kelly_fraction, unit_ev
from entitystats.skew import Timeline, as_list

#: Strategy defaults - fixed values.
START_BANKROLL = 1000.0
DEFAULT_ODDS = 2.0
FLAT_STAKE = 10.0
KELLY_CAP = 0.25
FIXED_FRACTION = 0.02


def bets(
    df: DataFrame,
    portfolio: str | Sequence[str],
    order: Sequence[str],
    prob: str,
    actual: str,
    odds: str | None = None,
    mode: str = "flat",
    bankroll: float = START_BANKROLL,
    flat_stake: float = FLAT_STAKE,
    cap: float = KELLY_CAP,
    fraction: float = FIXED_FRACTION,
    confidence: str | None = None,
    min_confidence: float = 0.0,
    max_rows: int | None = None,
) -> DataFrame:
    """The bets a strategy places, with stake, profit and bankroll after each.

    Only bets with positive expected value are considered.

    * flat: a fixed stake. As long as bets are placed the bankroll is the start
      plus the running profit; once it is below the stake nothing changes any
      more. So a bet is placed when the running minimum of that sum reaches the
      stake.
    * kelly (capped) and fixed: a share f of the bankroll. The bankroll is the
      start times the product of 1 + f r, kept as a running sum of logarithms.
    """
    keys = as_list(portfolio)
    o = F.lit(DEFAULT_ODDS) if odds is None else F.coalesce(F.nullif(F.col(odds).cast("double"), F.lit(0.0)), F.lit(DEFAULT_ODDS))
    rows = df.select(
        *keys, *[c for c in order if c not in keys], F.coalesce(F.col(prob).cast("double"), F.lit(0.0)).alias("pred_prob"),
        F.col(actual).cast("int").alias("actual"), o.alias("odds"),
        *([F.col(confidence).alias("__conf")] if confidence else []),
    )
    if confidence:
        rows = rows.filter(F.coalesce("__conf", F.lit(0.0)) >= min_confidence).drop("__conf")
    rows = rows.filter(unit_ev(F.col("pred_prob"), F.col("odds")) > 0)
    win = F.col("actual") == 1
    unit = F.when(win, F.col("odds") - 1.0).otherwise(F.lit(-1.0))
    if mode == "flat":
        rows = rows.withColumns({"stake": F.lit(float(flat_stake)), "__profit": flat_stake * unit})
        line = Timeline(rows, keys, order, max_rows).running(__before=("sum", F.col("__profit"), False))
        have = bankroll + F.coalesce(F.col("__before"), F.lit(0.0))
        line = line.with_column("__have", have).running(__low=("min", F.col("__have"), True))
        out = line.result().filter((F.col("__low") >= F.col("stake")) & (F.col("stake") > 0))
        return out.withColumns({"profit": F.col("__profit"), "bankroll": F.col("__have") + F.col("__profit")}).drop(
            "__profit", "__before", "__have", "__low"
        )
    if mode == "kelly":
        share = F.least(kelly_fraction(F.col("pred_prob"), F.col("odds")), F.lit(float(cap)))
    elif mode == "fixed":
        share = F.lit(float(fraction))
    else:
        raise ValueError(f"unknown mode {mode}")
    growth = 1.0 + F.col("__f") * unit
    # losing everything leaves log 0: minus infinity keeps the product at zero
    log_growth = F.when(growth > 0, F.log(growth)).otherwise(F.lit(float("-inf")))
    rows = rows.withColumn("__f", share).withColumn("__log", log_growth)
    line = Timeline(rows, keys, order, max_rows).running(__before=("sum", F.col("__log"), False))
    have = bankroll * F.exp(F.coalesce(F.col("__before"), F.lit(0.0)))
    out = line.result().withColumn("__have", have).withColumn("stake", F.col("__have") * F.col("__f")).filter("stake > 0")
    return out.withColumn("profit", F.col("stake") * unit).withColumn("bankroll", F.col("__have") + F.col("profit")).withColumnRenamed(
        "__f", "fraction"
    ).drop("__log", "__before", "__have")


def _sharpe(mean: Column, sd: Column, n: Column) -> Column:
    return F.when((n > 1) & (sd > 0), mean / sd * F.sqrt(n)).otherwise(F.lit(0.0))


def summary(
    placed: DataFrame,
    portfolio: str | Sequence[str],
    bankroll: float = START_BANKROLL,
    portfolios: DataFrame | None = None,
    mode: str = "flat",
) -> DataFrame:
    """Counts, win rate, profit, return, mean stake and Sharpe ratio per portfolio.

    ``sharpe`` uses the profits as placed; ``sharpe_ref`` recomputes share
    stakes from the final bankroll. ``portfolios`` adds portfolios without a bet.
    """
    keys = as_list(portfolio)
    unit = F.col("profit") / F.col("stake")
    ref = unit * F.col("fraction") if mode != "flat" else F.col("profit")
    agg = placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_bets"), F.count_if(F.col("actual") == 1).alias("wins"), F.sum("profit").alias("total_profit"),
        F.avg("stake").alias("avg_stake"), F.avg("profit").alias("__m"), F.stddev_samp("profit").alias("__s"),
        F.avg(ref).alias("__rm"), F.stddev_samp(ref).alias("__rs"), F.max("stake").alias("__stake"),
    )
    if portfolios is not None:
        agg = portfolios.select(*keys).distinct().join(agg, keys, "left")
    zero = lambda c, kind="double": F.coalesce(F.col(c), F.lit(0).cast(kind))
    final = bankroll + zero("total_profit")
    # share stakes scale with the final bankroll, which cancels in the ratio;
    # a flat stake above the final bankroll leaves no bets to measure
    usable = (final >= F.col("__stake")) if mode == "flat" else (final > 0)
    n = zero("total_bets", "bigint")
    return agg.select(
        *keys, final.alias("final_bankroll"), n.alias("total_bets"), zero("wins", "bigint").alias("wins"),
        (n - zero("wins", "bigint")).alias("losses"),
        F.when(n > 0, zero("wins", "bigint") / n).otherwise(0.0).alias("win_rate"), zero("total_profit").alias("total_profit"),
        ((final - bankroll) / bankroll).alias("roi"), zero("avg_stake").alias("avg_stake"),
        _sharpe(F.col("__m"), F.col("__s"), n).alias("sharpe"),
        F.when(usable, _sharpe(F.col("__rm"), F.col("__rs"), n)).otherwise(0.0).alias("sharpe_ref"),
    )
