"""Session, tables and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "radiolake", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the engine expects of a cluster too."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(os.cpu_count() or 8),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**base, **conf}.items():
        builder = builder.config(key, value)
    return shipped(builder.getOrCreate())


def shipped(spark: SparkSession) -> SparkSession:
    """spark, with this package sent to its executors, once a session: their Python
    workers may have neither the repository nor its folder on their path."""
    context = spark.sparkContext
    if not getattr(context, "_radiolake_shipped", False):
        package = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="radiolake-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = Path(folder, "radiolake.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        context.addPyFile(str(archive))
        context._radiolake_shipped = True
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return shipped(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines see: the one the cluster names in spark.checkpoint.dir.

    Where that is unset a temporary folder is made, but only under a local master:
    on a cluster it would be another folder on every machine, so that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if not getattr(context, "_radiolake_folder", None):
        context._radiolake_folder = tempfile.mkdtemp(prefix="radiolake-")
        atexit.register(shutil.rmtree, context._radiolake_folder, ignore_errors=True)
    return context._radiolake_folder


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system that the cluster knows exists."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; it is removed when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_removed, path)
    return path


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else os.path.abspath(path))


def _removed(path: str) -> None:
    try:
        system, at = _file_system(path)
        system.delete_dir(at)
    except Exception:  # it may never have been made, or be gone already
        pass


def store(path: str, content: bytes) -> None:
    """Write one file of any file system, whole or not at all for readers of listings."""
    system, at = _file_system(path)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(at) as out:
        out.write(content)


def fetch(path: str) -> bytes:
    system, at = _file_system(path)
    with system.open_input_stream(at) as f:
        return f.read()


def store_files(df: DataFrame, folder: str, name: str, content: str) -> DataFrame:
    """Write each row's content (text or bytes) as the file folder/name, in the tasks; gives
    the names and sizes. A task that runs again writes the same files again."""

    def run(batches):
        for b in batches:
            data = [c.encode() if isinstance(c, str) else bytes(c) for c in b["_c"]]
            for n, d in zip(b["_n"], data):
                store(f"{folder}/{n}", d)
            yield b[["_n"]].rename(columns={"_n": "name"}).assign(size=[len(d) for d in data])

    return df.where(F.col(name).isNotNull() & F.col(content).isNotNull()).select(F.col(name).alias("_n"), F.col(content).alias("_c")).mapInPandas(run, "name string, size long")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from those files."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
