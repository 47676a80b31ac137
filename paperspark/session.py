"""Session helpers: a local session for tests and the shared work folder.

On a cluster the session comes from the caller; nothing here changes its
settings except a checkpoint folder when none is configured in local mode.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job in this package relies on. Partition values such as
# model specs ("007") or paper ids ("0704.0001") must stay strings.
REQUIRED_CONF = {
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    # Lists up to this length are pushed into Parquet scans as such, not as a
    # range (sources.corpus_store.LIST_IDS).
    "spark.sql.parquet.pushdown.inFilterThreshold": "100",
    # Rows carry whole texts: a batch for the Python workers ends at so many
    # bytes, however many rows they are; a worker holds some copies of it.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


# Runtime settings recommended on a cluster. AQE re-plans joins from measured
# sizes (broadcast only what is measured small), coalesces small shuffle
# partitions and splits skewed ones; scan splits and shuffle partitions aim
# at ~256 MB; Arrow batches stay small because rows carry whole texts.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def apply_cluster_conf(spark: SparkSession) -> None:
    """Apply :data:`CLUSTER_CONF` and :data:`REQUIRED_CONF` to a session."""
    for k, v in {**CLUSTER_CONF, **REQUIRED_CONF}.items():
        spark.conf.set(k, v)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "paperspark") -> SparkSession:
    """A local session configured like the tests and the bench expect."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Small test files still give every core a split.
        .config("spark.sql.files.openCostInBytes", "256k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PAPERSPARK_DRIVER_MEMORY", "8g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in REQUIRED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def apply_required_conf(spark: SparkSession) -> None:
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)
    ship_package(spark)


_shipped: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers.

    Functions run by ``mapInPandas`` are pickled by reference to their
    module, so every worker must be able to import ``paperspark`` wherever
    the driver was started. The package's sources are zipped once per
    application and handed to ``addPyFile``; Spark serves the file to every
    executor from the driver.
    """
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _shipped:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    base = os.path.dirname(pkg_dir)
    fd, zpath = tempfile.mkstemp(prefix="paperspark-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg_dir):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(dirpath, name)
                    z.write(full, os.path.relpath(full, base))
    sc.addPyFile(zpath)
    _shipped.add(app)


def work_dir(spark: SparkSession) -> str:
    """Shared folder for staging tables and checkpoints.

    Reads ``spark.checkpoint.dir`` (or the context's checkpoint dir). Only a
    session in one process without a setting gets a fresh temporary folder
    (tests, the bench); any other session without one is a configuration
    error, because a machine-local folder would not survive the loss of an
    executor.
    """
    sc = spark.sparkContext
    ctx_dir = sc.getCheckpointDir()
    base = ctx_dir or sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder")
        base = tempfile.mkdtemp(prefix="paperspark-ckpt-")
    if not ctx_dir:
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir() or base
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, never used path under the shared work folder."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


# Of what a session writes for itself: texts take about 2/3 of their room in
# Spark's default.
STORED_CODEC = "zstd"
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """What is written in here leaves no shuffle files: Spark drops them when
    the write ends, not when the driver happens to collect its garbage."""
    old = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, old)


def _staged_at(df, path: str):
    spark = df.sparkSession
    with shuffles_dropped(spark):
        df.write.option("compression", STORED_CODEC).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged(df, name: str):
    """``df`` written once as Parquet to the shared folder and read again:
    what produced it runs once, and its lineage ends there."""
    return _staged_at(df, fresh_path(df.sparkSession, name))


@contextmanager
def staged_for(df, name: str):
    """``staged``, and deleted at the end: nothing may read it later."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    try:
        yield _staged_at(df, path)
    finally:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def literal(df):
    """The only value of a one-row DataFrame as a literal column of exactly its
    type, which may hold any others."""
    from pyspark.sql.classic.column import Column

    jvm, jdf = df.sparkSession._jvm, df._jdf
    row, field = jdf.queryExecution().executedPlan().executeCollect()[0], jdf.schema().apply(0)
    value = jvm.org.apache.spark.sql.catalyst.expressions.Literal(row.get(0, field.dataType()), field.dataType())
    return Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(value))


def null_join(left, right, cols: list[str], how: str = "inner"):
    """Join on ``cols``, where NULL key parts match NULL; keeps the key
    columns of ``left``."""
    other = right.withColumnsRenamed({c: f"__right_{c}" for c in cols})
    cond = None
    for c in cols:
        same = left[c].eqNullSafe(other[f"__right_{c}"])
        cond = same if cond is None else cond & same
    return left.join(other, cond, how).drop(*[f"__right_{c}" for c in cols])
