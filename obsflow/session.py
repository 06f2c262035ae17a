"""Session helpers: checkpointing and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(app: str = "obsflow", cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where neither that setting nor a checkpoint folder exists is a temporary one set, and only for a local
    master: elsewhere every worker would write to its own disk, so that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="obsflow-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder and cut its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Shelf:
    """Tables kept as Parquet in the shared checkpoint folder, each until it is dropped.

    Checkpoints and shuffle files otherwise stay until the driver happens to collect its garbage, so a long query holds all of them at once. The
    shuffle files of a table go as soon as it is written.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.count = spark, f"{checkpoint_folder(spark)}/shelf-{uuid.uuid4().hex}", 0
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` read from its files, with the names and types of its columns."""
        path, before = f"{self.folder}/{self.count}", self.spark.conf.get(SHUFFLE_CLEANUP, None)
        self.count += 1
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(SHUFFLE_CLEANUP) if before is None else self.spark.conf.set(SHUFFLE_CLEANUP, before)
        stored = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(stored)] = stored, path
        return stored

    def drop(self, *tables: DataFrame) -> None:
        """Delete the files of tables that nothing reads again."""
        for table in tables:
            _, path = self.paths.pop(id(table))
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Materialise a parameter table and broadcast it only if its counted rows are within bounds.

    Beyond the bound the table is returned without a hint, so that joins with it shuffle and adaptive
    execution splits skewed partitions.
    """
    stored = checkpointed(df)
    return F.broadcast(stored) if stored.limit(max_rows + 1).count() <= max_rows else stored


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all cores before costly per-row work, if their source has fewer partitions than that.

    Large inputs have more partitions than cores already and are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers of a session this package, wherever they run; once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="obsflow-")) / "obsflow.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
