"""Session settings and lineage cuts shared by the iterative operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
# The folder, below the shared one, of the tables that are written now.
_WITHIN: ContextVar[str] = ContextVar("within", default="")


def build_session(app: str = "floodgrid", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators expect (AQE with skew handling, UTC)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for materialised steps: the cluster's ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder; a cluster session
    without it is refused, since a machine-local folder would not survive an executor.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return f"{configured.rstrip('/')}/{sc.applicationId}"
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    if sc.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="floodgrid-")
    return _LOCAL_DIRS[sc.applicationId]


# Shuffled megabytes that one task reads. Columns of cells pack about thirty times, so Spark's own 64 MB are 2 GB of rows.
TASK_READ_MB = 4
# Megabytes, as written or shuffled, of a table that a join may send through the driver unasked: 30 MB of rows. Spark's
# own bound of 10 MB is 300 MB of packed cells.
SENT_MB = 1


def small_tasks(spark: SparkSession) -> None:
    """Lower the session's target for the shuffled data of a task to ``TASK_READ_MB`` and its bounds for broadcasts
    that no hint asks for to ``SENT_MB``; smaller ones, and broadcasts that are off, stay."""
    in_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    limits = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": TASK_READ_MB, "spark.sql.autoBroadcastJoinThreshold": SENT_MB}
    at_run_time = "spark.sql.adaptive.autoBroadcastJoinThreshold"
    # Unset, the run time takes the planned bound.
    if spark.conf.get(at_run_time, None) is not None:
        limits[at_run_time] = SENT_MB
    for key, most in limits.items():
        now = spark.conf.get(key)
        if not now.startswith("-") and in_bytes(now) > most << 20:
            spark.conf.set(key, f"{most}m")


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` with the mark that its joins go by shuffle, unless the other side is marked for broadcast.

    Columns of cells and made-up geometry shrink to next to nothing in parquet, and Spark takes the size of the
    files for that of the rows: it would send tables of many millions of rows through the driver.
    """
    return df.hint("merge")


def write_and_read(df: DataFrame) -> DataFrame:
    """Run ``df`` once into a parquet table in the shared folder and read it back.

    Cuts the lineage of iterative jobs; survives lost executors; later joins see real sizes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}{_WITHIN.get()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """``write_and_read`` of what ``make`` gives; the tables that ``make`` wrote on its way are deleted.

    Nothing but the result may use those tables. Calls may be nested.
    """
    within = f"{_WITHIN.get()}/{uuid.uuid4().hex}"
    outside = _WITHIN.set(within)
    try:
        out = make()
    finally:
        _WITHIN.reset(outside)
    kept = write_and_read(out)
    _delete(spark, shared_dir(spark) + within)
    return kept


def discard(table: DataFrame) -> None:
    """Delete a table that ``write_and_read`` gave and that nothing reads any more."""
    spark = table.sparkSession
    ours = shared_dir(spark).rpartition("/")[2]
    for path in {file.rpartition("/")[0] for file in table.inputFiles()}:
        if f"/{ours}/" in path:
            _delete(spark, path)


def materialize(df: DataFrame) -> DataFrame:
    """``write_and_read`` for tables that grow with the cells: joins with them go by shuffle."""
    return by_shuffle(write_and_read(df))
