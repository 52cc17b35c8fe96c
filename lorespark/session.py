"""Session defaults and the shared folder in which plans are cut."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "lorespark", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use; on a cluster pass your own session instead."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    } | {k.replace("__", "."): str(v) for k, v in conf.items()}
    spark = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=base).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where its folder is visible to them (local mode, shared mounts).

    Elsewhere install the package on the executors or pass it with ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a session that names none (tests, local runs) gets a folder of its own, which is deleted at exit.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="lorespark-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{path}")
    return f"file://{path}"


#: What this driver put into shared folders and hasn't deleted yet: path to (JVM, Hadoop configuration).
_MADE: dict[str, tuple] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder, whatever its file system; deleted by ``clean_up`` or when the driver ends."""
    path = f"{shared_dir(spark)}/lorespark/{name}-{uuid.uuid4().hex}"
    _MADE[path] = (spark._jvm, spark._jsc.hadoopConfiguration())
    return path


def clean_up() -> int:
    """Delete all intermediate tables of this driver; returns how many paths were tried. DataFrames that read them end."""
    tried = list(_MADE.items())
    _MADE.clear()
    for path, (jvm, conf) in tried:
        try:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        except Exception:  # the JVM may have gone before this driver's exit
            if path.startswith("file:"):
                shutil.rmtree(local_path(path), ignore_errors=True)
    return len(tried)


atexit.register(clean_up)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    Unlike a local checkpoint the table survives the loss of an executor.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A scan over at least one task a core: where its files give fewer (one small file is one task), rows are dealt out.

    For scans and what needs no shuffle on top of them. A table of as many splits as cores stays as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan._jdf.queryExecution().toRdd().getNumPartitions() >= cores else scan.repartition(cores)


def local_path(uri: str) -> str:
    """The file-system path of a ``file:`` URI (shared mounts are ordinary paths on every executor)."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"{uri}: mount the shared folder as a file system")
    return os.path.abspath(uri)
