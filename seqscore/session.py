"""Spark session and lineage helpers."""

from __future__ import annotations

import os
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every seqscore job relies on. Cluster deployments override the sizing
# keys (shuffle partitions, maxPartitionBytes) through spark-submit; these are defaults.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Partition sizing for large inputs: ~128 MB shuffle partitions after AQE coalescing
    # and 256 MB scan splits keep tasks well inside executor memory; skewed partitions
    # above 5x the median (and 256 MB) are split by the skew-join rule.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.showConsoleProgress": "false",
    # HotSpot does not JIT methods over 8000 bytecodes; a whole-stage method above that
    # runs interpreted and is slower than per-expression codegen, so fall back early.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Never broadcast on a planner estimate (estimates do not grow through explode /
    # inline, so a 27x or 171x expanded table looks as small as its source). AQE
    # broadcasts a side only after measuring its shuffle output.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "seqscore", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the seqscore defaults."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor
        conf["spark.driver.memory"] = "8g"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where it is unset, a local session
    (tests) gets a private folder; a cluster session raises, because executors cannot
    share a machine-local folder."""
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="seqscore-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return conf_dir


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make the package importable by the Python workers (functions are pickled by module
    reference): zip it once per application and ``addPyFile`` it, as ``--py-files`` would."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="seqscore-pyfiles-"), "seqscore")
    sc.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package)))
    _SHIPPED.add(sc.applicationId)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """``df`` written once and marked for broadcast if it has at most ``most`` rows; beyond that it
    joins by a shuffle."""
    frozen = cut_lineage(df)
    return F.broadcast(frozen) if frozen.limit(most + 1).count() <= most else frozen


def many_parts(spark: SparkSession) -> int:
    """Several tasks a core. Given as a number to ``repartition``, adaptive execution does not merge the
    parts by their small size: for rows that are dear to work on."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread_evenly(df: DataFrame) -> DataFrame:
    """``df`` dealt to ``many_parts`` tasks of as many rows each."""
    return df.repartition(many_parts(df.sparkSession))


def spread(df: DataFrame, key: str, run: int = 1000) -> DataFrame:
    """``df`` dealt to ``many_parts`` tasks in runs of ``run`` neighbouring values of the whole number
    ``key``: neighbours stay together, so what is grouped by ranges of it is still combined in the task."""
    return df.repartition(many_parts(df.sparkSession), F.floor(F.col(key) / run))


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
