"""Session helpers.

The library never creates a cluster session on its own: `spark-submit` owns that.
`local_session` is for tests, the benchmark and the examples only.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job of this package relies on (all public Spark SQL options).
JOB_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # The arg-min over k centroids is one wide expression. Above ~8000 bytes of bytecode
    # the JVM does not JIT a method, so such a fused stage would run interpreted; with
    # this limit Spark itself drops whole-stage fusion for that subtree instead and keeps
    # expression-level codegen (measured 16 s -> 2 s for 600k rows, k = 20).
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "mixclust") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in JOB_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_DIRS: dict[str, str] = {}


def spread(df: DataFrame) -> DataFrame:
    """A small source in fewer partitions than the session has cores, dealt out to all of them; others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession, sub: str | None = None) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set by whoever submits the job (HDFS/S3/...).
    Only when it is unset (tests, local runs) a fresh local folder is taken, one for each
    application (the setting itself cannot be changed once a session runs).
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder for this job")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_DIRS:
            _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="mixclust-ckpt-", dir="/tmp")
        base = _LOCAL_DIRS[app]
    return base if sub is None else base.rstrip("/") + "/" + sub


def fresh_dir(spark: SparkSession, stem: str) -> str:
    """A new, unused path below the shared folder (never reused between runs)."""
    return shared_dir(spark, f"{stem}-{uuid.uuid4().hex[:12]}")


def written(df: DataFrame, stem: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: its lineage is one scan, which
    any executor can repeat after another is lost."""
    spark = df.sparkSession
    path = fresh_dir(spark, stem)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
