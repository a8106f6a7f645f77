"""Versioned data sets with manifests, and a registry of them.

A version is written once under ``<base>/<name>_v<version>_<uid>`` and never
changed. Its manifest is a JSON record beside the data. The registry is an
append-only log; reading it takes the last entry of each version, so a repeated
or interrupted registration does no harm.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from entitystats.operators.sets import keep_newest

MANIFEST = (
    "name string, version string, uid string, created_at string, seasons string, path string, rows bigint,"
    " rows_train bigint, rows_val bigint, rows_test bigint, columns array<string>, files map<string,string>"
)
SPLITS = ["train", "val", "test"]


def _identity(name: str, version: str | None, uid: str | None) -> dict[str, str]:
    now = dt.datetime.now(dt.timezone.utc)
    return {
        "name": name,
        "version": version or now.strftime("%Y%m%dT%H%M%SZ"),
        "uid": uid or uuid.uuid4().hex[:8],
        "created_at": now.isoformat(),
    }


def _write_manifest(spark: SparkSession, target: str, manifest: dict[str, Any]) -> dict[str, Any]:
    fields = [f.split()[0] for f in MANIFEST.split(", ")]
    row = tuple(manifest.get(f) for f in fields)
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.json(f"{target}/manifest")
    return manifest


def export_dataset(
    df: DataFrame, base: str, name: str, labels: DataFrame | None = None, fmt: str = "parquet", version: str | None = None, uid: str | None = None
) -> dict[str, Any]:
    """Write features (and labels); returns the manifest. Rows are counted while writing."""
    ident = _identity(name, version, uid)
    target = f"{base}/{name}_v{ident['version']}_{ident['uid']}"
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    _save(counted, f"{target}/features", fmt)
    files = {"features": f"{target}/features"}
    if labels is not None:
        _save(labels, f"{target}/labels", fmt)
        files["labels"] = f"{target}/labels"
    return _write_manifest(df.sparkSession, target, {**ident, "path": target, "rows": seen.get["rows"], "columns": df.columns, "files": files})


def _save(df: DataFrame, path: str, fmt: str) -> None:
    if fmt == "parquet":
        df.write.parquet(path)
    elif fmt == "csv":
        df.write.option("header", True).option("compression", "gzip").csv(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def create_version(
    df: DataFrame, base: str, name: str, seasons: str = "", split: str = "split", version: str | None = None, uid: str | None = None
) -> dict[str, Any]:
    """Write a split data set partitioned by split, in one pass over the rows."""
    ident = _identity(name, version, uid)
    target = f"{base}/{name}_v{ident['version']}_{ident['uid']}"
    seen = Observation()
    counts = [F.count_if(F.col(split) == s).alias(f"rows_{s}") for s in SPLITS]
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts).write.partitionBy(split).parquet(f"{target}/features")
    got = seen.get
    manifest = {
        **ident, "seasons": seasons, "path": target, "rows": got["rows"], **{f"rows_{s}": got[f"rows_{s}"] for s in SPLITS},
        "columns": [c for c in df.columns if c != split], "files": {s: f"{target}/features/{split}={s}" for s in SPLITS if got[f"rows_{s}"]},
    }
    return _write_manifest(df.sparkSession, target, manifest)


def read_version(spark: SparkSession, manifest: dict[str, Any], split: str | None = None) -> DataFrame:
    """The rows of a version; a split reads only its own partition."""
    rows = spark.read.parquet(f"{manifest['path']}/features")
    return rows if split is None else rows.filter(F.col("split") == split)


def list_datasets(spark: SparkSession, base: str) -> DataFrame:
    """All manifests under ``base``, oldest first; none gives no rows."""
    from entitystats.sources.files import _paths_exist

    if not _paths_exist(spark, f"{base}/*/manifest"):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(f"{base}/*/manifest").orderBy(F.coalesce("created_at", "version"))


def latest_dataset(spark: SparkSession, base: str, name: str) -> dict[str, Any] | None:
    rows = list_datasets(spark, base).filter(F.col("name") == name).orderBy(F.desc("created_at"), F.desc("version")).limit(1).collect()
    return rows[0].asDict(recursive=True) if rows else None


def register(spark: SparkSession, registry: str, manifest: dict[str, Any]) -> None:
    """Append a registry entry for (name, version, uid)."""
    at = dt.datetime.now(dt.timezone.utc).isoformat()
    row = (manifest["name"], manifest["version"], manifest["uid"], manifest.get("created_at"), json.dumps(manifest, sort_keys=True), at)
    spark.createDataFrame([row], REGISTRY).coalesce(1).write.mode("append").json(registry)


REGISTRY = "name string, version string, uid string, created_at string, manifest string, registered_at string"


def registered(spark: SparkSession, registry: str) -> DataFrame:
    """Registry entries, the last one of each (name, version, uid)."""
    from entitystats.sources.files import _paths_exist

    log = spark.read.schema(REGISTRY).json(registry) if _paths_exist(spark, registry) else spark.createDataFrame([], REGISTRY)
    last = F.max_by(F.struct("created_at", "manifest", "registered_at"), "registered_at").alias("r")
    return log.groupBy("name", "version", "uid").agg(last).select("name", "version", "uid", "r.*")


def latest_registered(spark: SparkSession, registry: str, name: str) -> dict[str, Any] | None:
    rows = registered(spark, registry).filter(F.col("name") == name).orderBy(F.desc("created_at"), F.desc("registered_at")).limit(1).collect()
    return json.loads(rows[0]["manifest"]) if rows else None


def versions_beyond(manifests: DataFrame, keep: int) -> DataFrame:
    """Versions older than the newest ``keep`` of each name; deleting them is the caller's decision."""
    return keep_newest(manifests, "name", "created_at", keep, ["version", "uid"])
