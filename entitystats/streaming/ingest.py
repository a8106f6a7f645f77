"""Incremental ingest and roll-ups with Structured Streaming.

Every micro-batch writes only below its own ``batch=<id>`` folder and replaces
that folder when it runs again, so a replay after a failure leaves the same
tables. Readers take the last batch that holds a key (``current``), inside a
batch the record that arrived last.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entitystats.operators.normalize import normalize_games
from entitystats.operators.quality import batch_summary, flag_records
from entitystats.session import settled
from entitystats.skew import as_list
from entitystats.streaming.levels import batches, current, fold, write_batch  # noqa: F401

#: Place of a record in the order of arrival, larger for later ones.
AT = "arrived"
#: The file a record came in, and how far into it.
SOURCE = "arrived_in"
#: How late a record may be before the daily means ignore it - fixed value.
LATE = "7 days"


def file_stream(
    spark: SparkSession, path: str, schema, fmt: str = "json", files_per_batch: int | None = None, bytes_per_batch: str | None = None,
    arrival: bool = False, **options: str,
) -> DataFrame:
    """Files as a stream; the limits bound what one micro-batch takes in.

    With ``arrival`` every record carries its file's time and name and the
    place of its block, from which ``with_arrival`` makes the order of arrival.
    """
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    rows = reader.load(path)
    if not arrival:
        return rows
    m = F.col("_metadata")
    place = F.concat_ws("|", F.date_format(m["file_modification_time"], "yyyyMMddHHmmssSSS"), m["file_path"], F.lpad(m["file_block_start"].cast("string"), 20, "0"))
    return rows.select("*", place.alias(SOURCE))


def with_arrival(df: DataFrame, order: str | None = None) -> DataFrame:
    """A batch with its order of arrival: a column of the records, else file, block and row."""
    if order is not None:
        return df.withColumn(AT, F.col(order)).drop(SOURCE)
    row = F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0")
    return df.withColumn(AT, F.concat_ws("|", F.col(SOURCE), row) if SOURCE in df.columns else row).drop(SOURCE)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process what has arrived, then stop; the next run goes on from there."""
    query = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def accepted(raw: DataFrame, base: str, batch: int, dry_run: bool = False, names: dict[str, str] | None = None) -> DataFrame | None:
    """Audit, normalise, validate and set rejects aside; the good records, or None in a dry run.

    A dry run writes the audit and the counts only. Else the checked records
    are settled: reading their dates costs far more than all that follows.
    """
    write_batch(raw, base, "audit", batch)
    flagged = flag_records(normalize_games(raw, names))
    if not dry_run:
        flagged = settled(flagged)
    write_batch(batch_summary(flagged), base, "summary", batch)
    if dry_run:
        return None
    write_batch(flagged.filter(F.size("missing") > 0).select(F.to_json(F.struct(*raw.columns)).alias("record"), "missing"), base, "rejects", batch)
    return flagged.filter(F.size("missing") == 0)


def ingest_batch(raw: DataFrame, base: str, batch: int, dry_run: bool = False, names: dict[str, str] | None = None, order: str | None = None) -> None:
    """Take in a batch: player values by player name and games by sides, the last record per key."""
    raw = with_arrival(raw, order).persist()
    try:
        good = accepted(raw, base, batch, dry_run, names)
        if good is not None:
            _load_values(good, base, batch)
            _load_games(good, base, batch)
    finally:
        raw.unpersist()


def value_rows(good: DataFrame) -> DataFrame | None:
    """Player values of accepted records: player (null if unnamed), player_nba_id, stat_type, value; None without such columns."""
    if "stat_type" not in good.columns or "value" not in good.columns:
        return None
    named = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("player_name", "player", "name") if c in good.columns]
    return good.withColumns({
        "player": F.coalesce(*named) if named else F.lit(None).cast("string"),
        "player_nba_id": F.col("player_nba_id").try_cast("bigint") if "player_nba_id" in good.columns else F.lit(None).cast("bigint"),
        "stat_type": F.col("stat_type").cast("string"),
        "value": F.col("value").try_cast("double"),
    }).filter("stat_type IS NOT NULL AND value IS NOT NULL AND game_date IS NOT NULL AND coalesce(player, CAST(player_nba_id AS STRING)) IS NOT NULL")


def game_rows(good: DataFrame) -> DataFrame:
    """Games of accepted records: date, sides and scores, with the order of arrival."""
    score = lambda c: F.col(c).try_cast("bigint") if c in good.columns else F.lit(None).cast("bigint")
    side = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("UNKNOWN")) if c in good.columns else F.lit("UNKNOWN")
    return good.select("game_date", side("home_team").alias("home_team"), side("away_team").alias("away_team"), score("home_score").alias("home_score"), score("away_score").alias("away_score"), AT)


def last_known(name: str) -> Column:
    """The last value of a column that is not null."""
    return F.max_by(name, F.when(F.col(name).isNotNull(), F.col(AT))).alias(name)


def _load_values(good: DataFrame, base: str, batch: int) -> None:
    rows = value_rows(good)
    if rows is None:
        return
    rows = rows.withColumn("player", F.coalesce("player", F.concat(F.lit("player_"), F.col("player_nba_id").cast("string"))))
    write_batch(rows.groupBy("player", "game_date", "stat_type").agg(F.max_by("value", AT).alias("value"), last_known("player_nba_id")), base, "player_stats", batch)
    fold(good.sparkSession, base, "player_stats", ["player", "game_date", "stat_type"], batch)


def _load_games(good: DataFrame, base: str, batch: int) -> None:
    write_batch(game_rows(good).groupBy("game_date", "home_team", "away_team").agg(last_known("home_score"), last_known("away_score")), base, "games", batch)


def current_games(spark: SparkSession, base: str) -> DataFrame:
    """Games with the last score that was reported for each side."""
    rows = batches(spark, base, "games")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("batch"))).alias(c)
    return rows.groupBy("game_date", "home_team", "away_team").agg(last("home_score"), last("away_score"))


def run_ingest(stream: DataFrame, base: str, checkpoint: str, dry_run: bool = False, names: dict[str, str] | None = None, order: str | None = None) -> None:
    run_available(stream, lambda df, batch: ingest_batch(df, base, batch, dry_run, names, order), checkpoint)


def daily_means(stream: DataFrame, entity: str, ts: str, value: str, late: str = LATE, width: str = "1 day") -> DataFrame:
    """Mean per entity and day; records later than ``late`` are ignored.

    Works on a batch DataFrame as well, where nothing is late.
    """
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark(ts, late)
    return rows.groupBy(F.window(ts, width).alias("w"), entity).agg(F.avg(value).alias("avg_value"), F.count(value).alias("n")).select(
        F.col("w.start").alias("day"), entity, "avg_value", "n"
    )


def running_counts(stream: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Rows per key so far (update mode)."""
    return stream.groupBy(*as_list(keys)).agg(F.count(F.lit(1)).alias("count"))


def run_updates(stream: DataFrame, base: str, table: str, checkpoint: str, keys: str | Sequence[str] | None = None) -> None:
    """Write each batch of changed aggregates; ``current`` gives the latest state.

    With ``keys``, those of the aggregate, closed batches are folded together.
    """

    def each(df: DataFrame, batch: int) -> None:
        write_batch(df, base, table, batch)
        if keys is not None:
            fold(df.sparkSession, base, table, keys, batch)

    run_available(stream, each, checkpoint, mode="update")


def run_index(stream: DataFrame, base: str, checkpoint: str, ident: str = "id", text: str = "text", dim: int = 384) -> None:
    """Add vectors for ids that no earlier batch has indexed."""
    from entitystats.operators.similarity import index_new

    def each(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        known = batches(spark, base, "index", before=batch)
        if known is None:
            known = spark.createDataFrame([], "source_id string")
        write_batch(index_new(df, known, ident, text, dim), base, "index", batch)

    run_available(stream, each, checkpoint)


def run_backfill(stream: DataFrame, base: str, checkpoint: str, entity: str) -> None:
    """Copy rows batch by batch and note which entities each batch touches."""

    def each(df: DataFrame, batch: int) -> None:
        write_batch(df, base, "target", batch)
        write_batch(df.select(entity).distinct(), base, "affected", batch)

    run_available(stream, each, checkpoint)


def downsample(df: DataFrame, entity: str, ts: str, value: str, before: Column) -> DataFrame:
    """Daily means for rows older than ``before``, newer rows unchanged: (entity, ts, value, n)."""
    old = df.filter(F.col(ts) < before).groupBy(entity, F.date_trunc("day", ts).alias(ts)).agg(F.avg(value).alias(value), F.count(value).alias("n"))
    new = df.filter(F.col(ts) >= before).select(entity, ts, F.col(value).cast("double").alias(value), F.lit(1).cast("bigint").alias("n"))
    return old.select(entity, F.col(ts).cast(df.schema[ts].dataType).alias(ts), value, "n").unionByName(new)
