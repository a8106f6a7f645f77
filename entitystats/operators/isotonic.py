"""Non-decreasing fits per entity, for entities of any size.

Equal predictions are averaged first. The points of an entity are pooled where
they lie: one task a slice of the prediction axis. Pooled neighbours are then
merged pair by pair, in as many rounds as the number of slices has binary
digits. Two neighbours that both rise need one pool at most: the end of the left
one above some level v and the start of the right one below it, with v their
common mean. That level is the root of a function that falls with v, read off
running sums over the blocks in conflict, so a merge is a sorted sum like any
other (``Timeline``) and no task holds an entity.

Fits are tables of blocks, one row each. They are applied by merging rows and
blocks along the prediction axis; no row carries a whole fit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entitystats.session import settled, settled_small
from entitystats.skew import COLD, SLICE, Timeline, null_safe_join

BLOCK = ["lo", "hi", "y", "w"]


def pooled(lo: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[list, list, list, list]:
    """Blocks (lo, hi, y, w) of points sorted by lo: neighbours are pooled until y rises everywhere."""
    los, his, ys, ws = [], [], [], []
    for at, value, weight in zip(lo.tolist(), y.tolist(), w.tolist()):
        begin = at
        while ys and ys[-1] >= value:
            value = (ys[-1] * ws[-1] + value * weight) / (ws[-1] + weight)
            weight += ws[-1]
            begin = los[-1]
            for held in (los, his, ys, ws):
                held.pop()
        los.append(begin)
        his.append(at)
        ys.append(value)
        ws.append(weight)
    return los, his, ys, ws


def _pool_slice(table: pa.Table) -> pa.Table:
    table = table.sort_by("lo")
    blocks = pooled(*(table.column(c).to_numpy() for c in ("lo", "y", "w")))
    n = len(blocks[0])
    keys = table.select([c for c in table.column_names if c not in BLOCK]).take(pa.array(np.zeros(n, np.int64)))
    for name, values in zip(BLOCK, blocks):
        keys = keys.append_column(name, pa.array(values, pa.float64()))
    return keys


def isotonic_blocks(df: DataFrame, entity: str, truth: str, pred: str, min_pairs: int = 3, max_rows: int | None = None) -> DataFrame:
    """(entity, n, lo, hi, y, w): the blocks of each entity's fit, for entities with enough pairs."""
    y, x = F.col(truth).cast("double"), F.col(pred).cast("double")
    points = df.filter(y.isNotNull() & x.isNotNull()).groupBy(entity, x.alias("lo")).agg(F.avg(y).alias("y"), F.count(F.lit(1)).cast("double").alias("w"))
    points = settled(points)
    line = Timeline(points, entity, ["lo"], max_rows)
    cut = line.df if line.sliced else line.df.withColumn(SLICE, F.lit(COLD))
    cut = cut.select(entity, F.col(SLICE).alias("s"), "lo", "y", "w")
    schema = T.StructType([cut.schema[entity], cut.schema["s"], *[T.StructField(c, T.DoubleType()) for c in BLOCK]])
    blocks = cut.groupBy(entity, "s").applyInArrow(_pool_slice, schema)
    if line.sliced:
        blocks = settled(blocks)
        top, level = blocks.agg(F.max("s")).first()[0] or 0, 0
        while top >> level:
            blocks = _merged(blocks, entity, level, max_rows)
            level += 1
    counts = points.groupBy(entity).agg(F.sum("w").cast("bigint").alias("n")).filter(F.col("n") >= min_pairs)
    return null_safe_join(blocks, settled_small(counts), [entity], "inner").select(entity, "n", *BLOCK)


def _merged(blocks: DataFrame, entity: str, level: int, max_rows: int | None) -> DataFrame:
    """Blocks after each two neighbouring groups of 2**level slices have become one."""
    sided = blocks.withColumns({"pair": F.when(F.col("s") != COLD, F.shiftright("s", level + 1)), "side": F.shiftright("s", level).bitwiseAND(1)})
    left, right = F.col("side") == 0, F.col("side") == 1
    ends = sided.filter("pair IS NOT NULL").groupBy(entity, "pair").agg(F.max(F.when(left, F.col("y"))).alias("high"), F.min(F.when(right, F.col("y"))).alias("low"))
    ends = settled_small(ends.filter("high > low"))
    if ends.isEmpty():
        return blocks
    zone = null_safe_join(sided, ends, [entity, "pair"], "inner").filter((left & (F.col("y") > F.col("low"))) | (right & (F.col("y") < F.col("high"))))
    wy = F.col("w") * F.col("y")
    line = Timeline(zone.select(entity, "pair", "side", "lo", "y", "w"), [entity, "pair"], ["y", "side", "lo"], max_rows)
    line = line.running(
        wl=("sum", F.when(left, F.col("w")).otherwise(0.0), True), yl=("sum", F.when(left, wy).otherwise(0.0), True),
        wr=("sum", F.when(right, F.col("w")).otherwise(0.0), True), yr=("sum", F.when(right, wy).otherwise(0.0), True),
    ).totals(wt=("sum", F.when(left, F.col("w")).otherwise(0.0)), yt=("sum", F.when(left, wy).otherwise(0.0)))
    above_w, above_y = F.col("wt") - F.col("wl"), F.col("yt") - F.col("yl")
    surplus = above_y - above_w * F.col("y") - (F.col("wr") * F.col("y") - F.col("yr"))
    common = (above_y + F.col("yr")) / (above_w + F.col("wr"))
    levels = line.result().filter(surplus >= 0).groupBy(entity, "pair").agg(F.max_by(common, F.struct("y", "side", "lo")).alias("v"))
    met = null_safe_join(sided, settled_small(levels), [entity, "pair"])
    joins = F.coalesce((left & (F.col("y") > F.col("v"))) | (right & (F.col("y") < F.col("v"))), F.lit(False))
    met = settled(met.withColumn("joins", joins))
    centre = met.filter("joins").groupBy(entity, "pair").agg(
        F.min("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), (F.sum(wy) / F.sum("w")).alias("y"), F.sum("w").alias("w")
    )
    columns = [entity, "s", *BLOCK]
    return settled(met.filter(~F.col("joins")).select(*columns).unionByName(centre.select(*columns)))


def _lines(blocks: DataFrame, entity: str, max_rows: int | None) -> DataFrame:
    """Blocks as straight pieces: from ``start`` on the value is y0 + slope * (x - x0)."""
    # what follows a block is the first row after it: read backwards, the last one
    back = Timeline(blocks.withColumn("__back", -F.col("lo")), entity, ["__back"], max_rows)
    following = back.running(__next=("max", F.struct("__back", "lo", "y"), False), __all=("count", F.lit(1), True)).totals(__n=("count", F.lit(1))).result()
    piece = lambda start, y0, slope, x0: F.struct(start.alias("start"), y0.alias("y0"), slope.alias("slope"), x0.alias("x0"))
    lo, hi, y, flat = F.col("lo"), F.col("hi"), F.col("y"), F.lit(0.0)
    rising = piece(hi, y, F.coalesce((F.col("__next.y") - y) / (F.col("__next.lo") - hi), flat), hi)
    pieces = F.array_compact(F.array(
        F.when(F.col("__all") == F.col("__n"), piece(F.lit(float("-inf")), y, flat, lo)), F.when(lo < hi, piece(lo, y, flat, lo)), rising
    ))
    return following.select(entity, F.explode(pieces).alias("__piece"))


def apply_blocks(df: DataFrame, blocks: DataFrame, entity: str, pred: str, name: str = "calibrated", max_rows: int | None = None) -> DataFrame:
    """Adds the fitted value: that of the block, linear between blocks, constant outside, the raw one where the entity has no fit."""
    pieces = _lines(blocks, entity, max_rows).select(entity, F.col("__piece.start").alias("__x"), F.lit(0).alias("__side"), "__piece")
    rows = df.select(entity, F.col(pred).cast("double").alias("__x"), F.lit(1).alias("__side"), F.struct(*df.columns).alias("__row"))
    merged = rows.unionByName(pieces, allowMissingColumns=True)
    line = Timeline(merged, entity, ["__x", "__side"], max_rows).running(__at=("max", F.col("__piece"), True))
    here = F.col("__at.y0") + F.when(F.col("__at.slope") == 0, F.lit(0.0)).otherwise(F.col("__at.slope") * (F.col("__x") - F.col("__at.x0")))
    found = line.result().filter("__side = 1")
    return found.select(*[F.col(f"__row.{c}").alias(c) for c in df.columns], F.coalesce(F.when(F.col("__x").isNotNull(), here), F.col("__x")).alias(name))
