"""Ingest that gives players and games surrogate ids, batch by batch.

Each micro-batch is resolved against the entities and events as they stood
before it, which it reads from the tables of earlier batches. New ids go on
after the largest one there, in the order in which records arrived, so a batch
that runs again after a failure gives every player and game the same id. What a
batch writes are its changes alone: new or completed entities, new or corrected
events, and the values by (entity, event, kind).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entitystats.operators.resolve import entity_changes, event_changes
from entitystats.session import settled
from entitystats.streaming.ingest import AT, accepted, game_rows, run_available, value_rows, with_arrival
from entitystats.streaming.levels import current, fold, parts, write_batch

ENTITY_SCHEMA = "id long, name string, ext_id long"
EVENT_SCHEMA = "id long, game_date timestamp, home_team string, away_team string, home_score long, away_score long"
FACT_KEYS = ["entity_id", "event_id", "stat_type"]


def table_before(spark: SparkSession, base: str, table: str, keys: str | list[str], schema: str, before: int | None = None) -> DataFrame:
    """Rows as they stood before a batch (at the end, without one); none at first."""
    if not parts(spark, base, table, before):
        return spark.createDataFrame([], schema)
    return current(spark, base, table, keys, before=before)


def resolve_batch(raw: DataFrame, base: str, batch: int, dry_run: bool = False, names: dict[str, str] | None = None, order: str | None = None, match: str = "full_key") -> None:
    """Audit, normalise, validate, resolve and load one batch.

    Players are found by external id, then by name, else created; games by date
    and sides, then by date, else created. Of records about one game the last
    score stands, of values with one (player, game, kind) the last value.
    """
    spark = raw.sparkSession
    raw = with_arrival(raw, order).persist()
    try:
        good = accepted(raw, base, batch, dry_run, names)
        if good is None:
            return
        sides = ["home_team", "away_team"]
        good = settled(good.drop("errors", "missing", "is_outlier").select("*", *[F.lit(None).cast("string").alias(s) for s in sides if s not in good.columns]))
        events = table_before(spark, base, "events", "id", EVENT_SCHEMA, batch)
        ids, event_rows = event_changes(game_rows(good), events, AT, match=match)
        event_rows = settled(event_rows)
        write_batch(event_rows.drop("fresh"), base, "events", batch)
        fold(spark, base, "events", "id", batch)
        counts = event_rows.agg(F.count_if("fresh").alias("games_created"), F.count_if(~F.col("fresh")).alias("games_changed"))
        values = value_rows(good)
        if values is not None:
            entities = table_before(spark, base, "entities", "id", ENTITY_SCHEMA, batch)
            found, entity_rows = entity_changes(values, entities, AT, "player", "player_nba_id")
            write_batch(entity_rows, base, "entities", batch)
            fold(spark, base, "entities", "id", batch)
            keyed = found.withColumns({s: F.coalesce(F.nullif(F.col(s), F.lit("")), F.lit("UNKNOWN")) for s in sides})
            facts = keyed.join(ids, ["game_date", *sides]).groupBy(*FACT_KEYS).agg(F.max_by("value", AT).alias("value"))
            write_batch(facts, base, "facts", batch)
            fold(spark, base, "facts", FACT_KEYS, batch)
        write_batch(counts, base, "loads", batch)
    finally:
        raw.unpersist()


def run_resolving_ingest(stream: DataFrame, base: str, checkpoint: str, dry_run: bool = False, names: dict[str, str] | None = None, order: str | None = None, match: str = "full_key") -> None:
    """Resolve and load what has arrived; the next run goes on from there."""
    run_available(stream, lambda df, batch: resolve_batch(df, base, batch, dry_run, names, order, match), checkpoint)


def current_entities(spark: SparkSession, base: str) -> DataFrame:
    return table_before(spark, base, "entities", "id", ENTITY_SCHEMA)


def current_events(spark: SparkSession, base: str) -> DataFrame:
    return table_before(spark, base, "events", "id", EVENT_SCHEMA)


def current_facts(spark: SparkSession, base: str) -> DataFrame:
    return table_before(spark, base, "facts", FACT_KEYS, "entity_id long, event_id long, stat_type string, value double")
