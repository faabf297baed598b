"""Session settings the plans rely on, and the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Adaptive execution (on by default) splits skewed join partitions. Forcing it lets a split happen even where
# the aggregate after the join then needs one more shuffle: cheaper than a task with a third of the rows.
ADAPTIVE_SETTINGS = {"spark.sql.adaptive.forceOptimizeSkewedJoin": "true"}


MB = 1 << 20
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
SPLIT_BYTES = "spark.sql.files.maxPartitionBytes"


@contextmanager
def prepared(spark: SparkSession, input_bytes: int = 0) -> Iterator[SparkSession]:
    """Run actions under the settings above and those for the input size; the session's own come back afterwards.

    What the application was submitted with stays as it is. ``input_bytes`` is the size of the files a report reads.
    """
    submitted = spark.sparkContext.getConf()
    wanted = {**ADAPTIVE_SETTINGS, **sizing(spark, input_bytes)}
    before = {key: spark.conf.get(key, None) for key in wanted if submitted.get(key) is None}
    try:
        for key in before:
            spark.conf.set(key, wanted[key])
        yield spark
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def sizing(spark: SparkSession, input_bytes: int, per_partition: int = 256 * MB, most: int = 65536) -> dict[str, str]:
    """Shuffle and scan partition settings for an input of that many bytes.

    Adaptive execution merges small shuffle partitions but never splits ordinary ones, so a shuffle starts
    from enough partitions for the whole input: one per 256 MB of files (a report reads a third
    or less of the columns), 65,536 at most. Above 25 TB scan splits grow so that there are at most
    200,000 of them. Small inputs keep the session's own numbers.
    """
    settings = {}
    wanted = min(input_bytes // per_partition, most)
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        settings[INITIAL_PARTITIONS] = str(wanted)
    split = input_bytes // 200_000
    if split > 128 * MB:
        settings[SPLIT_BYTES] = str(split)
    return settings


def shuffle_partitions(spark: SparkSession) -> int:
    """The number of partitions a shuffle starts with."""
    return int(spark.conf.get(INITIAL_PARTITIONS, None) or spark.conf.get("spark.sql.shuffle.partitions"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for ``checkpoint()``: what the cluster names in ``spark.checkpoint.dir``.

    Executors must all see it, so only local mode may fall back to a temporary folder. Spark removes the files of
    DataFrames that are no longer used if the application starts with
    ``spark.cleaner.referenceTracking.cleanCheckpoints=true``.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="shelfwise-checkpoint-")
    sc.setCheckpointDir(named)
    return named
