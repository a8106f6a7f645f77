"""Per-entity ordering that survives a hot entity.

A window partitioned by entity sorts each entity inside one task. That is the
right plan while every entity is small, and it costs one shuffle. When one
entity holds a large share of all rows it is not: the task that owns it would
sort a third of the table. ``Timeline`` keeps the cheap plan for the first case
and, for entities above a row threshold, cuts the history into consecutive
slices, so the shuffle key becomes (entity, slice).

Frames then reach across slice borders in one of two ways:

* bounded frames (last k rows) copy the k rows before each border into the next
  slice (``trailing``);
* unbounded frames add an aggregate of all earlier slices to the value computed
  inside the slice (``running``, ``totals``).

Both give exactly what the plain window gives. Slice borders come from a small
sample of sort keys; a poor sample makes slices uneven, never wrong.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entitystats.session import BROADCAST_BYTES, BROADCAST_ROWS, max_rows_per_task, size_in_bytes

SLICE = "__slice"
HALO = "__halo"
HOT = "__hot"

#: Slice number of the rows of entities that are not cut.
COLD = -1

#: At most this many slices are cut, whatever the data size; it bounds the
#: border tables that are broadcast and the sample that is read by the driver.
MAX_SLICES = 20_000
SAMPLES_PER_SLICE = 16

#: Children of a node of the border tables.
FANOUT = 32
NODE = "__node"


def as_list(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on equality that treats null keys as equal; keeps the left key columns."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(renamed[f"__r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def heavy_keys(df: DataFrame, keys: Sequence[str], max_rows: int) -> list[tuple]:
    """(key..., count) of every key above ``max_rows``.

    Counts are combined before the shuffle. The result has at most
    rows / max_rows entries, so reading it on the driver is bounded. A limit
    of 0 looks for none.
    """
    if max_rows <= 0:
        return []
    counts = df.groupBy(*as_list(keys)).agg(F.count(F.lit(1)).alias("__heavy_n")).filter(F.col("__heavy_n") > max_rows)
    return [tuple(r) for r in counts.collect()]


def _sort_key(value: tuple) -> tuple:
    return tuple((v is not None, v) for v in value)


class Timeline:
    """Rows of ``df`` ordered by ``order`` within ``entity`` (ascending, nulls first)."""

    def __init__(
        self,
        df: DataFrame,
        entity: str | Sequence[str],
        order: str | Sequence[str],
        max_rows: int | None = None,
        heavy: list[tuple] | None = None,
    ) -> None:
        """``order`` should be total within the entity: add tie-breaking columns.

        ``heavy`` passes on the result of ``heavy_keys`` where it is known.
        """
        self.entity = as_list(entity)
        self.order = as_list(order)
        limit = max_rows or max_rows_per_task(df.sparkSession)
        if heavy is None:
            heavy = heavy_keys(df, self.entity, limit)
        # with very many rows slices grow, so that their number stays bounded
        per_slice = max(limit, sum(h[-1] for h in heavy) // MAX_SLICES)
        heavy = [h for h in heavy if h[-1] > per_slice]
        self.sliced = bool(heavy)
        self.df = self._cut(df, heavy, per_slice) if heavy else df

    # -- slicing -----------------------------------------------------------
    def _cut(self, df: DataFrame, heavy: list[tuple], per_slice: int) -> DataFrame:
        spark = df.sparkSession
        fraction = min(1.0, SAMPLES_PER_SLICE / per_slice)
        key_fields = [df.schema[k] for k in self.entity]
        hot_keys = spark.createDataFrame([h[:-1] for h in heavy], T.StructType(key_fields))
        # bounded by MAX_SLICES * SAMPLES_PER_SLICE rows in expectation
        sample = (
            null_safe_join(df.select(*self.entity, *self.order), F.broadcast(hot_keys), self.entity, "inner")
            .sample(fraction, seed=17)
            .collect()
        )
        n_key = len(self.entity)
        picked: dict[tuple, list[tuple]] = {}
        for row in sample:
            picked.setdefault(tuple(row[:n_key]), []).append(tuple(row[n_key:]))
        found: dict[tuple, list[tuple]] = {}
        for *key, n in heavy:
            keys = sorted(picked.get(tuple(key), []), key=_sort_key)
            want = -(-n // per_slice)
            borders = found.setdefault(tuple(key), [])
            for i in range(1, want):
                at = i * len(keys) // want
                if keys and (not borders or _sort_key(keys[at]) > _sort_key(borders[-1])):
                    borders.append(keys[at])
        return self._placed(df, found, key_fields)

    def _placed(self, df: DataFrame, borders: dict[tuple, list[tuple]], key_fields: list[T.StructField]) -> DataFrame:
        """Rows of cut entities with the number of borders not after them.

        The number is found digit by digit, in base ``FANOUT``: a table a digit
        holds the few borders between the children of a node, joined by entity
        and node. A row never carries more than those.
        """
        names = [f"__b{i}" for i in range(len(self.order))]
        fields = [T.StructField(b, T.ArrayType(df.schema[c].dataType)) for b, c in zip(names, self.order)]
        longest = max(len(found) for found in borders.values())
        digits = 1
        while FANOUT**digits <= longest:
            digits += 1
        out = df
        # bisection as one expression; a chain of columns would be copied into
        # every filter that Spark pushes below it
        powers = F.array(*[F.lit(1 << k) for k in range(FANOUT.bit_length() - 1, -1, -1)])
        digit = F.aggregate(powers, F.lit(0), lambda pos, step: F.when(self._not_after(names, pos + step - 1), pos + step).otherwise(pos))
        for level in range(digits - 1, -1, -1):
            unit, rows = FANOUT**level, []
            for key, found in borders.items():
                for node in range(len(found) // (unit * FANOUT) + 1):
                    here = [found[t * unit - 1] for t in range(node * FANOUT + 1, (node + 1) * FANOUT) if t * unit <= len(found)]
                    rows.append((*key, node, *[[b[i] for b in here] for i in range(len(self.order))]))
            table = df.sparkSession.createDataFrame(rows, T.StructType([*key_fields, T.StructField(NODE, T.IntegerType()), *fields]))
            if level == digits - 1:
                out = null_safe_join(out, F.broadcast(table.drop(NODE)), self.entity).withColumn(HOT, F.col(names[0]).isNotNull())
                out = out.withColumn(SLICE, F.when(F.col(HOT), digit).otherwise(F.lit(COLD)))
            else:
                out = null_safe_join(out, F.broadcast(table.withColumnRenamed(NODE, SLICE)), [*self.entity, SLICE])
                out = out.withColumn(SLICE, F.when(F.col(HOT), F.col(SLICE) * FANOUT + digit).otherwise(F.col(SLICE)))
            out = out.drop(*names)
        return out

    def _not_after(self, names: Sequence[str], at: Column) -> Column:
        """Border number ``at`` exists and is not after the row, column by column, nulls first."""
        cond = F.lit(True)
        for name, column in reversed(list(zip(names, self.order))):
            b, c = F.get(F.col(name), at), F.col(column)
            before = F.coalesce(b < c, F.lit(False)) | (b.isNull() & c.isNotNull())
            cond = before | (b.eqNullSafe(c) & cond)
        return (at < F.size(names[0])) & cond

    @property
    def keys(self) -> list[str]:
        return [*self.entity, SLICE] if self.sliced else self.entity

    def window(self, descending: bool = False) -> WindowSpec:
        order = [F.col(c).desc() if descending else F.col(c).asc() for c in self.order]
        return Window.partitionBy(*self.keys).orderBy(*order)

    # -- bounded frames ----------------------------------------------------
    def trailing(self, k: int, build: Callable[[DataFrame, WindowSpec], DataFrame]) -> DataFrame:
        """Apply ``build(df, window)`` whose frames look back at most ``k`` rows."""
        if not self.sliced:
            return build(self.df, self.window())
        work = self.df.withColumn(HALO, F.lit(False)).unionByName(self._halo(k).withColumn(HALO, F.lit(True)))
        return build(work, self.window()).filter(~F.col(HALO)).drop(HALO, SLICE, HOT)

    def hot_rows(self) -> DataFrame:
        return self.df.filter(HOT)

    def hot_slices(self, *aggs: Column) -> DataFrame:
        """One row per (entity, slice) of the cut entities.

        Rows combine before the shuffle, and there are no more of these rows
        than borders and cut entities, so the result may be broadcast.
        """
        return self.hot_rows().groupBy(*self.keys).agg(*aggs)

    def join_slices(self, df: DataFrame, slices: DataFrame, how: str = "left") -> DataFrame:
        return null_safe_join(df, F.broadcast(slices), self.keys, how)

    def _halo(self, k: int) -> DataFrame:
        """The k rows before each slice, labelled with that slice."""
        sizes = self.hot_slices(F.count(F.lit(1)).alias("__n"))
        ordered = Window.partitionBy(*self.entity).orderBy(SLICE)
        ends = sizes.withColumn("__end", F.sum("__n").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        # every slice holds a row, so at most the next k slices can see this one
        ends = ends.withColumn(
            "__next",
            F.collect_list(F.struct(F.col(SLICE).alias("to"), (F.col("__end") - F.col("__n")).alias("start"))).over(
                ordered.rowsBetween(1, k)
            ),
        ).filter(F.size("__next") > 0)
        # Spark keeps only k rows per slice before shuffling for this rank
        tails = self.hot_rows().withColumn("__rank", F.row_number().over(self.window(descending=True))).filter(
            F.col("__rank") <= k
        )
        reach = self.join_slices(tails, ends.select(*self.keys, "__end", "__next"), "inner")
        return (
            reach.withColumn("__to", F.explode("__next"))
            .filter(F.col("__to.start") - F.col("__end") + F.col("__rank") <= k)
            .withColumn(SLICE, F.col("__to.to"))
            .drop("__rank", "__end", "__next", "__to")
        )

    # -- unbounded frames --------------------------------------------------
    def running(self, **specs: tuple[str, Column, bool]) -> Timeline:
        """Add running aggregates from the first row of the entity.

        Each spec is ``name=(kind, column, inclusive)`` with kind one of sum,
        count, min, max; ``inclusive`` says whether the current row counts.
        """
        inner = {True: self.window().rowsBetween(Window.unboundedPreceding, 0),
                 False: self.window().rowsBetween(Window.unboundedPreceding, -1)}
        local = {name: _AGGS[kind](col).over(inner[inc]) for name, (kind, col, inc) in specs.items()}
        if not self.sliced:
            counts = [n for n, (kind, _, _) in specs.items() if kind == "count"]
            return self._with(self.df.withColumns(local).fillna(0, counts))
        partial = self.hot_slices(*[_AGGS[kind](col).alias(n) for n, (kind, col, _) in specs.items()])
        before = Window.partitionBy(*self.entity).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        carry = partial.select(
            *self.keys,
            *[_MERGE[kind](F.col(n)).over(before).alias(f"__c_{n}") for n, (kind, _, _) in specs.items()],
        )
        joined = self.join_slices(self.df.withColumns({f"__l_{n}": c for n, c in local.items()}), carry)
        out = joined.withColumns(
            {n: _combine(kind, F.col(f"__l_{n}"), F.col(f"__c_{n}")) for n, (kind, _, _) in specs.items()}
        )
        return self._with(out.drop(*[f"__l_{n}" for n in specs], *[f"__c_{n}" for n in specs]))

    def totals(self, **specs: tuple[str, Column]) -> Timeline:
        """Add whole-entity aggregates (sum, count, min, max) to every row."""
        here = Window.partitionBy(*self.keys)
        local = {n: _AGGS[kind](c).over(here) for n, (kind, c) in specs.items()}
        if not self.sliced:
            return self._with(self.df.withColumns(local))
        partial = self.hot_slices(*[_AGGS[kind](c).alias(n) for n, (kind, c) in specs.items()])
        whole = Window.partitionBy(*self.entity)  # one row per slice here
        total = partial.select(
            *self.keys, *[_MERGE[kind](F.col(n)).over(whole).alias(f"__t_{n}") for n, (kind, _) in specs.items()]
        )
        joined = self.join_slices(self.df.withColumns({f"__l_{n}": c for n, c in local.items()}), total)
        hot = F.col(HOT)
        out = joined.withColumns({n: F.when(hot, F.col(f"__t_{n}")).otherwise(F.col(f"__l_{n}")) for n in specs})
        return self._with(out.drop(*[f"__{p}_{n}" for p in "tl" for n in specs]))

    def _with(self, df: DataFrame) -> Timeline:
        clone = object.__new__(Timeline)
        clone.__dict__.update(self.__dict__)
        clone.df = df
        return clone

    def with_column(self, name: str, column: Column) -> Timeline:
        return self._with(self.df.withColumn(name, column))

    def drop(self, *names: str) -> Timeline:
        return self._with(self.df.drop(*names))

    def result(self) -> DataFrame:
        return self.df.drop(SLICE, HOT)


_AGGS = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
_MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def _combine(kind: str, local: Column, carry: Column) -> Column:
    if kind == "min":
        return F.least(local, carry)
    if kind == "max":
        return F.greatest(local, carry)
    if kind == "count":
        return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
    return F.coalesce(local + carry, local, carry)


def quantiles(
    df: DataFrame,
    by: str | Sequence[str],
    value: str,
    probs: dict[str, float],
    max_rows: int | None = None,
    heavy: list[tuple] | None = None,
) -> DataFrame:
    """Exact interpolated quantiles per group, one row per group.

    Groups under the row limit use the built-in aggregate, whose buffer is one
    entry per distinct value. Larger groups are ranked over slices and only the
    rows next to each quantile position are kept.
    """
    by = as_list(by)
    df = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias(value))
    limit = max_rows or max_rows_per_task(df.sparkSession)
    if heavy is None:
        heavy = heavy_keys(df, by, limit)
    builtin = [F.percentile(value, p).alias(n) for n, p in probs.items()]
    if not heavy:
        return df.groupBy(*by).agg(*builtin)
    hot_keys = df.sparkSession.createDataFrame(
        [h[:-1] for h in heavy], T.StructType([df.schema[k] for k in by])
    )
    cold = null_safe_join(df, F.broadcast(hot_keys), by, "left_anti").groupBy(*by).agg(*builtin)
    # equal values share a rank range, so combine them before ordering
    hot = null_safe_join(df, F.broadcast(hot_keys), by, "inner").groupBy(*by, value).agg(F.count(F.lit(1)).alias("__w"))
    line = Timeline(hot, by, value, limit).running(__upto=("sum", F.col("__w"), True)).totals(__n=("sum", F.col("__w")))
    ranked = line.result().withColumn("__from", F.col("__upto") - F.col("__w"))
    aggs = []
    for n, p in probs.items():
        pos = (F.col("__n") - 1) * F.lit(float(p))
        lo, hi = F.floor(pos), F.ceil(pos)
        at = lambda r: F.max(F.when((F.col("__from") <= r) & (r < F.col("__upto")), F.col(value)))
        share = F.max(pos - lo)
        aggs.append((at(lo) + (at(hi) - at(lo)) * share).alias(n))
    return cold.unionByName(ranked.groupBy(*by).agg(*aggs))


def whole_key(column: str) -> Column:
    """Zero for every row, yet not a constant to the optimizer.

    As a group key for "all rows" it lets one-row statistics join back by
    equality, as a hash join; a literal would turn that into a nested loop.
    """
    return F.pmod(F.hash(F.col(column)), F.lit(1))


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after its size and a bounded count show the side is small.

    For plain tables, where counting is cheap; computed sides should go through
    ``settled_small`` so that they are not computed twice.
    """
    if size_in_bytes(df) > max_bytes:
        return df
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
