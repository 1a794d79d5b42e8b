"""Tables written between steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The JVM never compiles a method of more bytes than this, but interprets it; Spark then
#: makes a stage operator by operator, in methods that are compiled.
_WHILE_WRITING = {"spark.sql.codegen.hugeMethodLimit": "8000"}
_written: list[str] = []


def folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        named = tempfile.mkdtemp(prefix="weftlink-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """df as a table in the shared folder: computed once, however often it is read, and cut off from its lineage."""
    spark = df.sparkSession
    path = f"{folder(spark)}/weftlink-{label}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in _WHILE_WRITING}
    try:
        for k, v in _WHILE_WRITING.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not _written:
        atexit.register(_sweep, spark)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Remove the files of tables from written() that no later plan reads."""
    for df in tables:
        found = df.inputFiles()[:1]
        _remove(df.sparkSession, [p for p in _written if any(f"/{p.rsplit('/', 1)[-1]}/" in f for f in found)])


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        _written.remove(path)


def _sweep(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may be gone by then
        _remove(spark, list(_written))
