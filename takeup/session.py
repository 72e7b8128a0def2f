"""Session settings and staging of intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Staged tables with at most this many rows each, and this many bytes together, may be
# broadcast; beyond it the lookup is a shuffle join (see operators.lookup).
MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 << 20

_local_dirs: dict[str, str] = {}
_scopes: dict[str, list[Scope]] = {}


def build_session(app: str = "takeup", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution on; cluster settings are left alone
    unless passed in."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        # call-site capture costs milliseconds per column expression
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for name, value in {**defaults, **conf}.items():
        builder = builder.config(name, value)
    return importable_in_workers(builder.getOrCreate())


def importable_in_workers(spark: SparkSession) -> SparkSession:
    """Put the folder of this package on the path of the session's Python workers, for where it is not installed and the
    working folder is another. On a cluster the package is installed or sent along (``--py-files``)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *known])
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for staged tables: the session's ``spark.checkpoint.dir``.

    Only a local master may do without: its temporary folder is seen by all tasks. On a
    cluster every executor would write to a disk of its own, so there it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master.split("[")[0] != "local":
        raise ValueError(f"spark.checkpoint.dir must name a shared folder on master {master}")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="takeup-")
    return _local_dirs[app]


class Scope:
    """Collects the tables staged while it is the innermost open scope and deletes them on closing.

    Close it once everything read from them has been written. ``with Scope(spark):`` does so at
    the end of the block.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []
        _scopes.setdefault(spark.sparkContext.applicationId, []).append(self)

    def leave(self) -> None:
        """Collect no more, delete nothing yet."""
        opened = _scopes.get(self.spark.sparkContext.applicationId, [])
        if self in opened:
            opened.remove(self)

    def close(self) -> None:
        self.leave()
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            folder = jvm.org.apache.hadoop.fs.Path(path).getParent()
            folder.getFileSystem(conf).delete(folder, True)
        self.paths = []

    def holds(self, df: DataFrame) -> bool:
        """Whether ``df`` reads a table of this scope."""
        own = {path.rstrip("/").rsplit("/", 2)[-2] for path in self.paths}
        return any(set(name.split("/")) & own for name in df.inputFiles())

    def __enter__(self) -> "Scope":
        return self

    def __exit__(self, *_) -> None:
        self.close()


def allow_checkpoints(spark: SparkSession) -> None:
    """Iterative learners cut their lineage with checkpoints when a folder is set."""
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))


def new_path(spark: SparkSession, name: str) -> str:
    """Fresh path below the checkpoint folder."""
    return f"{checkpoint_dir(spark)}/takeup/{uuid.uuid4().hex}/{name}"


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a table feeds several jobs or several branches of one job. Unlike
    a cache it survives the loss of executors; unlike an RDD checkpoint it stays
    columnar, so later scans prune columns, and Catalyst knows its size.
    """
    path = new_path(df.sparkSession, name)
    for scope in _scopes.get(df.sparkSession.sparkContext.applicationId, [])[-1:]:
        scope.paths.append(path)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
