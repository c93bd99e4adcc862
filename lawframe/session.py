"""Session settings that the queries rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def local_session(cores: str = "8", app: str = "lawframe", **extra: str) -> SparkSession:
    """A local session with the settings that every query assumes: UTC, ANSI and adaptive execution."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", f"{tempfile.gettempdir()}/lawframe-{os.getpid()}/warehouse")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, also for checkpoints: spark.checkpoint.dir, else the context's own.

    Where neither is set, a new temporary folder serves a local session; on a cluster
    that is a ValueError, as executors would not see a folder of the driver's.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="lawframe-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return base


#: Folders of written tables, by application: what clear_scratch() removes.
_SCRATCH: dict[str, list[str]] = {}


def scratch_folder(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared one for written tables; results may be read from it lazily, so it stays until clear_scratch() or whoever clears the shared folder."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Remove the scratch folders of this application, once the results made from them are used; how many there were."""
    folders = _SCRATCH.pop(spark.sparkContext.applicationId, [])
    for path in folders:
        system, make = file_system(spark, path)
        system.delete(make(path), True)
    return len(folders)


def file_system(spark: SparkSession, path: str) -> tuple:
    """The Hadoop file system of a path, and a function that makes its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def names_in(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if it is not there."""
    system, make = file_system(spark, path)
    return [f.getPath().getName() for f in system.listStatus(make(path))] if system.exists(make(path)) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file of UTF-8 text, such as a manifest, on the driver."""
    system, make = file_system(spark, path)
    stream = system.open(make(path))
    try:
        return spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream).decode("utf-8")
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, text: str, replace: bool = False) -> bool:
    """Put a small file of text in place whole, or not at all; False if it is there already and may not be replaced.

    It is written under another name and renamed, which the file system does for one
    of several writers alone.
    """
    system, make = file_system(spark, path)
    folder, _, name = path.rpartition("/")
    draft = make(f"{folder}/.{name}-{uuid.uuid4().hex}")
    stream = system.create(draft, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    options = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark._sc._gateway.new_array(options, 1)
    how[0] = options.OVERWRITE if replace else options.NONE
    target = make(path)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(system.makeQualified(draft), system.makeQualified(target), how)
    except Py4JJavaError as problem:
        system.delete(draft, False)
        if "AlreadyExists" in str(problem.java_exception.getClass().getName()):
            return False
        raise
    return True
