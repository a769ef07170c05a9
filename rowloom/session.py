"""Session helpers: building a local session, shipping the package to executors, shared scratch tables."""

from __future__ import annotations

import contextlib
import gc
import os
import tempfile
import time
import uuid
import zipfile

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

PACKAGE_DIR = os.path.dirname(os.path.abspath(__file__))


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rowloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python stages can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_rowloom_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="rowloom"), "rowloom_src.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, dirs, files in os.walk(PACKAGE_DIR):
            dirs[:] = sorted(d for d in dirs if d != "__pycache__")
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("rowloom", os.path.relpath(full, PACKAGE_DIR)))
    sc.addPyFile(path)
    sc._rowloom_shipped = True


def spread(df: DataFrame, least: int = 1 << 20, most: int = 4 << 20) -> DataFrame:
    """A small table dealt out to all cores: a file of a few megabytes is often one row group, which one task reads.

    Between `least` bytes and `most` for each core this costs next to nothing; larger tables have splits of their own.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if least <= size <= most * cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master, where it is unset, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(spark.sparkContext, "_rowloom_shared", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="rowloom-shared")
        spark.sparkContext._rowloom_shared = own
    return own


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: later stages and retries start from the files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rowloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._rowloom_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of cut_lineage that nothing reads any more."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._rowloom_path)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Ask for garbage collection, so that Spark deletes the shuffle files of plans that cut_lineage has replaced.

    Listeners still to be told of a query hold its plan, so they are waited for (but not for long: on a busy cluster the
    files go a little later), and a second round takes what the first has set free.
    """
    for _ in range(2):
        with contextlib.suppress(Py4JJavaError):
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(5_000)
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
