"""Session construction and checkpoint-directory policy.

On a cluster the shared checkpoint folder comes from ``spark.checkpoint.dir``
(or an already configured SparkContext checkpoint dir).  Only a local master
may fall back to a private temporary folder (tests, bench).
"""

from __future__ import annotations

import os
import re
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "margincast",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    master = master or os.environ.get("MARGINCAST_MASTER", "local[*]")
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.optimizer.canChangeCachedPlanOutputPartitioning", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("MARGINCAST_DRIVER_MEM", "16g"))
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint dir, configuring one only when unset.

    Order: an already set SparkContext checkpoint dir, then the session
    setting ``spark.checkpoint.dir``; a private temp folder is used only on a
    local master (tests).  A cluster without the setting is an error rather
    than a silent machine-local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="margincast-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def reuse(df):
    """Keep a frame that several branches (actions, dictionaries, windows)
    read, so it is computed once.  Spills to disk rather than failing, keeps
    its partitioning (later per-product windows and aggregates do not
    re-shuffle), and is rebuilt from lineage if an executor is lost."""
    from pyspark import StorageLevel
    # let AQE coalesce the cached plan's partitions (otherwise a cached frame
    # keeps spark.sql.shuffle.partitions partitions however small it is);
    # coalesced hash partitioning still serves later per-product windows
    df.sparkSession.conf.set("spark.sql.optimizer.canChangeCachedPlanOutputPartitioning", "true")
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def scale_conf(input_bytes: int, executors_cores: int = 8000,
               input_per_partition: int = 1 << 30, max_partitions: int = 200_000) -> dict[str, str]:
    """Session settings for a run over ``input_bytes`` of source data.

    Shuffles carry a fraction of the input (projected columns, filtered rows,
    map-side partial aggregates), so shuffle partitions start at about one per
    GiB of input — at least 2 × the cluster's cores, at most ``max_partitions``
    (map × reduce shuffle files grow with it) — and AQE coalesces them toward
    128 MB at run time.  Skewed join partitions are split; file splits are
    256 MB so scan tasks stay large."""
    parts = min(max_partitions, max(2 * executors_cores, -(-input_bytes // input_per_partition)))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 << 20),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.files.maxPartitionBytes": str(256 << 20),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }


# What a shuffle of narrow numeric rows is cut into (``small_shuffles``).
SHUFFLE_BYTES, SHUFFLE_PARTS = 8 << 20, 2_000


def _bytes(text: str) -> int:
    """A size as Spark's settings write it (64m, 8MB, 1024) in bytes."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)b?", text.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


@contextmanager
def small_shuffles(spark, task_bytes: int | None = None, first_parts: int | None = None):
    """Within, AQE merges shuffle partitions up to ``task_bytes`` only (default: the
    fixed values above), starting from at least ``first_parts``.  It goes by compressed bytes, and sorts and aggregations of
    narrow rows of keys, dates and decimals hold some twenty times those: at the usual
    64 MB a task held over 1 GB.  For jobs that run within (an eager checkpoint); a
    smaller advisory size of the session and a larger number of partitions stay."""
    size, first = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    was = {k: spark.conf.get(k, None) for k in (size, first)}
    parts = int(was[first] or spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(size, str(min(task_bytes or SHUFFLE_BYTES, _bytes(spark.conf.get(size)))))
    spark.conf.set(first, str(max(first_parts or SHUFFLE_PARTS, parts)))
    try:
        yield
    finally:
        for k, v in was.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def partitions_for(spark, rows: int, rows_per_partition: int) -> int:
    """Partition count for a frame of ``rows`` rows that AQE cannot size
    (e.g. before a generator multiplies rows): about ``rows_per_partition``
    rows each, at least the default parallelism, at most the session's
    shuffle partition setting."""
    cap = int(spark.conf.get("spark.sql.shuffle.partitions"))
    floor = min(cap, spark.sparkContext.defaultParallelism)
    return max(floor, min(cap, -(-rows // rows_per_partition)))


def spread(df, keys: list[str], rows_per_task: int = 1_000, rows_per_partition: int = 200_000):
    """``df`` dealt out by ``keys`` for an iterative fit, which passes over it many
    times: its partitions become a whole number of waves over the cores, while
    AQE would size them for one pass (few partitions, most cores idle).

    Rows are put in order inside a partition and written to the checkpoint folder, so seeded
    draws that count rows meet the same ones on every read.  A frame that one task
    passes over quickly is returned as it is."""
    spark = df.sparkSession
    rows = df.count()
    if rows <= rows_per_task:
        return df
    cores = spark.sparkContext.defaultParallelism
    waves = -(-rows // (cores * rows_per_partition))
    n = min(cores * waves, -(-rows // rows_per_task))
    ensure_checkpoint_dir(spark)
    return df.repartition(n, *keys).sortWithinPartitions(*keys).checkpoint(eager=True)
