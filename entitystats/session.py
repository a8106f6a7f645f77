"""Session defaults the library relies on."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entities with more rows than this are cut into several time slices so that
#: no single task sorts them whole. Override with the Spark setting below; 0
#: skips the count that looks for such entities.
MAX_ROWS_CONF = "spark.entitystats.maxRowsPerTask"
MAX_ROWS_DEFAULT = 1_000_000


def build_session(app: str = "entitystats", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and Arrow; on a cluster pass no master."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per session.

    Functions that run in Python workers are pickled by module name, so every
    worker has to be able to import the package wherever it runs.
    """
    if getattr(spark.sparkContext, "_entitystats_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    archive = shutil.make_archive(f"{tempfile.mkdtemp()}/entitystats", "zip", root, "entitystats")
    spark.sparkContext.addPyFile(archive)
    spark.sparkContext._entitystats_shipped = True


def max_rows_per_task(spark: SparkSession) -> int:
    return int(spark.conf.get(MAX_ROWS_CONF, str(MAX_ROWS_DEFAULT)))


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared place named by ``spark.checkpoint.dir``.

    Only where that is unset, as on one machine in tests, a temporary folder
    serves instead, once per session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="entitystats-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def settled(df: DataFrame) -> DataFrame:
    """The same rows, computed once and read back from a written table.

    For intermediate results that several later steps use: they are not
    computed again, survive the loss of executors, and have known sizes.
    """
    path = scratch_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A side that is hinted for broadcast has at most so many bytes in its files, and so many rows.
BROADCAST_BYTES = 64 << 20
BROADCAST_ROWS = 1_000_000


def size_in_bytes(df: DataFrame) -> int:
    """Bytes of a plan's result as Spark estimates them; of a table read from files, their size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def settled_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A settled result, with a broadcast hint if its files and its rows are few enough.

    The count comes from the file footers of the written table. Without the
    hint the join is left to Spark; the rows are the same either way.
    """
    table = settled(df)
    return F.broadcast(table) if size_in_bytes(table) <= max_bytes and table.count() <= max_rows else table


def join_per_key(df: DataFrame, per_key: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows joined to a table that has one row per key, such as an aggregate of them.

    An aggregate right below a join keeps Spark from splitting a hot key of the
    other side. Written and read back, the table is broadcast if it is small;
    else both sides are shuffled for the join alone, and AQE may split them.
    """
    return df.join(settled_small(per_key), keys, how)
