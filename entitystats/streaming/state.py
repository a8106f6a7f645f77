"""Per-key running state over a stream: bankroll and exponential mean.

A step of either kind is a function of the state before it, and such functions
compose: a stretch of steps is again one function, known from a few numbers.
The exponential mean's steps are affine, v -> a v + b. Flat stakes add a fixed
amount as long as the bankroll covers the stake, so a stretch is known from its
sum and the lowest of its running sums. A key's rows of a micro-batch can thus
be cut into slices, each taken by its own task, and meet in one short table of
slices (``Timeline``); no task holds a whole key.

The state after each batch is a small table of its own, read by the next one. A
batch that runs again reads the state before it and writes the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entitystats.session import join_per_key, settled, settled_small
from entitystats.skew import SLICE, Timeline, null_safe_join
from entitystats.streaming.ingest import run_available
from entitystats.streaming.levels import current, fold, parts, write_batch


def _last(name: str, order: Sequence[str]) -> Column:
    return F.max_by(name, F.struct(*order))


@dataclass(frozen=True)
class FlatStake:
    """Bankroll under flat stakes: one row per placed bet, as ``bankroll``.

    Rows need pred_prob, odds and actual. Bets without a positive expectation,
    or with a null in it, are not placed; none is once the bankroll is below
    the stake. The state is ``v``.
    """

    key: str
    order: Sequence[str]
    ident: str
    start: float = 1000.0
    stake: float = 10.0
    max_rows: int | None = None

    def advance(self, rows: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        win = self.stake * (F.col("odds") - 1.0)
        bets = rows.filter(F.col("pred_prob") * (F.col("odds") - 1.0) - (1.0 - F.col("pred_prob")) > 0).select(
            self.key, *[c for c in self.order if c != self.ident], self.ident, F.when(F.col("actual") == 1, win).otherwise(F.lit(-self.stake)).alias("__d")
        )
        line = Timeline(bets, self.key, self.order, self.max_rows).running(__s=("sum", F.col("__d"), False))
        line = line.with_column("__s", F.coalesce("__s", F.lit(0.0))).running(__low=("min", F.col("__s"), True))
        known = join_per_key(line.result(), state.withColumnRenamed("v", "__v"), [self.key], "left")
        begin = F.coalesce("__v", F.lit(float(self.start)))
        placed = settled(known.filter(begin + F.col("__low") >= self.stake).withColumn("bankroll", begin + F.col("__s") + F.col("__d")))
        after = placed.groupBy(self.key).agg(_last("bankroll", self.order).alias("v"))
        return placed.select(self.key, self.ident, "bankroll"), after


@dataclass(frozen=True)
class ForwardEma:
    """Exponential mean of ``value`` in the order of arrival: one row per record, as ``ema``.

    The first record is its own mean; rows without a value are left out. The
    state is ``v``.
    """

    key: str
    order: Sequence[str]
    ident: str
    alpha: float = 0.3
    max_rows: int | None = None

    def advance(self, rows: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        columns = list(dict.fromkeys([self.key, *self.order, self.ident, "value"]))
        line = Timeline(rows.filter("value IS NOT NULL").select(*columns).withColumn("value", F.col("value").cast("double")), self.key, self.order, self.max_rows)
        cut = line.df if line.sliced else line.df.withColumn(SLICE, F.lit(0))
        cut = cut.select(*columns, F.col(SLICE).alias("__slice_no"))
        schema = T.StructType([*cut.schema.fields, T.StructField("__a", T.DoubleType()), T.StructField("__b", T.DoubleType())])
        # within a slice the mean is a * (mean before the slice) + b; a task takes its slices one after another
        order = [F.col(c).asc_nulls_last() for c in self.order]
        rows = cut.withColumn("__n", F.row_number().over(Window.partitionBy(self.key, "__slice_no").orderBy(*order)))
        local = settled(rows.sortWithinPartitions(self.key, "__slice_no", *order).mapInArrow(_affine(self.alpha), schema))
        slices = local.groupBy(self.key, "__slice_no").agg(
            _last("__a", self.order).alias("a"), _last("__b", self.order).alias("b"), F.min_by("value", F.struct(*self.order)).alias("x")
        )
        slices = join_per_key(slices, state, [self.key], "left")
        # slices of one key, in order, are few: at most one for every maxRowsPerTask rows
        steps = F.sort_array(F.collect_list(F.struct("__slice_no", "a", "b", "x", "v"))).alias("steps")
        begin = lambda s: F.coalesce(F.get(s, F.lit(0))["v"], F.get(s, F.lit(0))["x"])
        folded = slices.groupBy(self.key).agg(steps).withColumn("carries", F.aggregate(
            "steps", F.array(begin(F.col("steps"))), lambda done, s: F.concat(done, F.array(s["a"] * F.element_at(done, -1) + s["b"]))
        ))
        carry = folded.select(self.key, F.explode(F.arrays_zip(F.col("steps")["__slice_no"].alias("__slice_no"), F.slice("carries", 1, F.size("steps")).alias("__c"))).alias("z"))
        carry = settled_small(carry.select(self.key, "z.*"))
        out = null_safe_join(local, carry, [self.key, "__slice_no"], "inner")
        after = folded.select(self.key, F.element_at("carries", -1).alias("v"))
        return out.select(self.key, self.ident, (F.col("__a") * F.col("__c") + F.col("__b")).alias("ema")), after


def _affine(alpha: float):
    """Steps of ordered slices, whose rows are numbered from 1 as ``__n``.

    A value that is not finite leaves the mean as it is and makes it older.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, old = 0.0, 1.0
        for batch in batches:
            place, out = batch.column("__n").to_numpy(), []
            for n, value in zip(place.tolist(), batch.column("value").to_numpy().tolist()):
                mean, old = (0.0, 1.0 - alpha) if n == 1 else (mean, old * (1.0 - alpha))
                if alpha == 1:
                    mean = value
                elif math.isfinite(value):
                    if mean != value:
                        mean = (old * mean + alpha * value) / (old + alpha)
                    old = 1.0
                out.append(mean)
            kept = batch.drop_columns(["__n"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array((1.0 - alpha) ** place.astype("int64")), pa.array(out, pa.float64())], [*kept.schema.names, "__a", "__b"])

    return run


def run_state(stream: DataFrame, step: FlatStake | ForwardEma, base: str, table: str, checkpoint: str) -> None:
    """Take in what has arrived: rows go to ``table``, the state after each batch to ``<table>_state``."""
    run_available(stream, lambda df, batch: state_batch(df, step, base, table, batch), checkpoint)


def state_batch(df: DataFrame, step: FlatStake | ForwardEma, base: str, table: str, batch: int) -> None:
    """One batch; its rows are ordered among themselves, and come after those of earlier batches."""
    spark, kept = df.sparkSession, f"{table}_state"
    rows = settled(df)
    before = parts(spark, base, kept, batch)
    schema = T.StructType([df.schema[step.key], T.StructField("v", T.DoubleType())])
    state = current(spark, base, kept, step.key, before=batch) if before else spark.createDataFrame([], schema)
    out, after = step.advance(rows, state)
    write_batch(out, base, table, batch)
    write_batch(after, base, kept, batch)
    fold(spark, base, kept, step.key, batch)
