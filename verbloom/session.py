"""Sessions, tables and the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers of the session's executors, once per application, so that they need
    neither an installation nor the driver's working folder."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="verbloom-"), f"{root.name}.zip")  # of the driver; Spark copies it
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def local_session(cpus: int = 8, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("verbloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str, fields: list[str] | None = None) -> DataFrame:
    """One table of the data folder; `name` is the file or folder without its ending.

    `fields` (dotted, through arrays) are all that the scan reads: the optimiser doesn't prune fields of structs in
    arrays of arrays, or under functions of array elements.
    """
    ship(spark)
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(path)
    return spark.read.schema(_kept(df.schema, [f.split(".") for f in fields])).parquet(path) if fields else df


def _kept(kind: T.DataType, paths: list[list[str]]) -> T.DataType:
    """The part of a type that the paths name; a path's end keeps everything below it."""
    if any(not p for p in paths):
        return kind
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_kept(kind.elementType, paths), kind.containsNull)
    wanted = {p[0] for p in paths}
    return T.StructType([T.StructField(f.name, _kept(f.dataType, [p[1:] for p in paths if p[0] == f.name]), f.nullable) for f in kind.fields if f.name in wanted])


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where a local session has none (tests), a new one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="verbloom-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder and read from there: short lineage that survives lost executors."""
    spark = df.sparkSession
    ship(spark)
    base = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return df.checkpoint()


def written(df: DataFrame, *partition_by: str) -> tuple[DataFrame, str]:
    """`df` as a table in the shared folder, with its path."""
    path = os.path.join(shared_dir(df.sparkSession), f"table-{uuid.uuid4().hex}")
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Removes a table of `written` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def parallelism(spark: SparkSession) -> int:
    """The number of partitions for steps that name one."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
