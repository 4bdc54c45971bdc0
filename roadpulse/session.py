"""Spark session helpers.

Library functions never create sessions; they take the caller's session.
``get_spark`` is for tests, the bench and command-line jobs.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "roadpulse") -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings every job relies on (idempotent).

    Naive wall-clock timestamps are kept as ``timestamp_ntz``; the session time
    zone only matters at the streaming edge, where it must be UTC.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster in ``spark.checkpoint.dir``.

    Only a ``local`` session without the setting gets a scratch folder (driver and
    executors are one process there); a cluster without it is an error.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        d = sc._jsc.sc().getCheckpointDir()
        d = d.get() if d.isDefined() else None
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="roadpulse-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def cut_lineage(df: DataFrame, cluster_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The files survive a lost executor, and readers prune columns and push filters
    into the scan.  ``cluster_by`` keeps rows of near values in the same files, so
    that their row-group statistics skip what a filter on it excludes; the ranges are
    sampled from the written rows, so that ``df`` runs once.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/stage-{uuid.uuid4().hex}"
    out = df if cluster_by is None else cut_lineage(df).repartitionByRange(cluster_by).sortWithinPartitions(cluster_by)
    out.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
