"""SparkSession construction and the shared checkpoint folder.

The cluster names a shared checkpoint folder in ``spark.checkpoint.dir``; this
module reads it from the session and only sets one when it is unset (tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings that matter at scale: AQE re-plans joins from runtime sizes, splits
# skewed join partitions and coalesces small shuffle partitions; the session
# time zone is pinned so timestamp_ntz / date arithmetic is deterministic.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    # split a skewed join even if an aggregate above then has to shuffle again
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app_name: str = "ordercraft",
                shuffle_partitions: int | None = None,
                extra_conf: dict[str, str] | None = None) -> SparkSession:
    """Return (or create) a session with the library's defaults applied.

    ``master`` is only used when no session exists yet (local runs and tests);
    on a cluster the launcher decides it.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and intermediate tables."""
    return ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; set a scratch one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder "
                               "that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="ordercraft-ckpt-",
                                      dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_SCOPES: list[list[str]] = []  # tables written inside the open scopes


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that ``materialize`` wrote inside the block once it has
    ended well; results must be written by then. After a failure they stay."""
    _SCOPES.append([])
    try:
        yield
    except BaseException:
        _SCOPES.pop()
        raise
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in _SCOPES.pop():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: cuts the lineage (a lost executor recomputes from the table) and
    fixes the data for repeated use in one plan. ``compression``: a codec for
    wide texts, instead of the session's."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/ordercraft-tables/{name}-{uuid.uuid4().hex[:12]}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    df.write.mode("overwrite").parquet(path, compression=compression)
    return spark.read.parquet(path)


# Upper bound (bytes) for a side table broadcast after its size was measured.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row: strings and binaries by their length, nested values by
    the length of their JSON text, other columns by a fixed width."""
    width = F.lit(8)  # row header
    for f in df.schema.fields:
        name, col = type(f.dataType).__name__, F.col(f"`{f.name}`")
        if name in ("StringType", "BinaryType"):
            width += F.lit(16) + F.coalesce(F.octet_length(col), F.lit(0))
        elif name in ("ArrayType", "MapType", "StructType"):
            width += F.lit(32) + F.coalesce(F.octet_length(F.to_json(F.struct(col))), F.lit(0)) * 4
        else:
            width += F.lit(16 if name == "DecimalType" else 8)
    return width


def _total_bytes(df: DataFrame) -> int:
    return int(df.agg(F.sum(row_bytes(df).cast("long"))).first()[0] or 0)


def bounded_side(df: DataFrame, name: str, limit_bytes: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """A join side whose size is measured before the join is planned.

    The side (an aggregate: one row per order, per key ...) is materialized
    and its bytes are summed; it is returned with a broadcast hint only when
    they stay under ``limit_bytes``, otherwise as a plain table so the
    planner uses a shuffle join. Deciding before planning lets the large
    other side skip its shuffle, which AQE can no longer avoid once both
    sides' stages have started.
    """
    side = materialize(df, name)
    return F.broadcast(side) if _total_bytes(side) <= limit_bytes else side


def scale_conf(input_bytes: int, target_partition_bytes: int = 512 * 1024 * 1024,
               max_partitions: int = 100_000) -> dict[str, str]:
    """Settings sized for a large cluster run over ``input_bytes`` of input.

    Shuffles start with about one partition per ``target_partition_bytes`` of
    input (bounded, so the driver's map-output tracking stays manageable) and
    AQE coalesces them toward 256 MiB; file splits are 256 MiB; a partition
    counts as skewed at 4x the median and 512 MiB, and is then split.
    """
    initial = max(200, min(max_partitions, -(-input_bytes // target_partition_bytes)))
    return {
        **DEFAULT_CONF,
        "spark.sql.shuffle.partitions": str(initial),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(initial),
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
        "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * 1024 * 1024),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    }
