"""Helpers shared by the training-text operators."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words, wherever a contract speaks of words.
BREAKS = " \t\n\x0b\x0c\r"

#: What holds while a table is written: shuffle files go at its end, and batches
#: for Python are short, since a row can be a whole text.
_WHILE_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver can reach.

    It is the one named in ``spark.checkpoint.dir``.  Only a local session may
    leave it unset; it then gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        named = tempfile.mkdtemp(prefix="weftlink-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage: lost executors cost a reread, not a rerun.  Shuffle
    files of the write are removed as soon as it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftlink-{label}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in _WHILE_WRITING}
    try:
        for k, v in _WHILE_WRITING.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    _remember(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remember(spark: SparkSession, path: str) -> None:
    if not _written:
        atexit.register(_sweep, spark)
    _written.append(path)


def _sweep(spark: SparkSession) -> None:
    """Remove what materialise() wrote, when the driver ends."""
    with contextlib.suppress(Exception):
        drop(spark, list(_written))


def drop(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        if path in _written:
            _written.remove(path)


def forget(df: DataFrame) -> None:
    """Remove the files of a materialised table that no later plan reads."""
    drop(df.sparkSession, [p for p in _written if any(f"/{p.rsplit('/', 1)[-1]}/" in f for f in df.inputFiles()[:1])])


def bind(value: Column, body) -> Column:
    """body(value) with value computed once, also inside higher-order functions."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text as an array: empty for a null, empty or blank text."""
    inner = F.btrim(text, F.lit(BREAKS))
    return F.when(F.coalesce(inner, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[ \t-\r]+"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: So many keys at most can each have more than one in HOT_KEYS of all rows.
HOT_KEYS = 50_000


def looked_up(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """rows with the columns of facts (one row a key), null where there is none.

    A key with more than 4,096 rows and more than one in HOT_KEYS of all is
    hot.  There are HOT_KEYS of them at most, whatever the input, so theirs are
    sent to all tasks, and no task of the shuffled rest holds a hot key.
    """
    total = rows.count()
    if total <= 4096:  # no key can be hot
        return rows.join(facts, key, "left")
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > max(4096, total // HOT_KEYS))
    if sizes.isEmpty():
        return rows.join(facts, key, "left")
    hot = materialise(sizes.select(key), "hot")
    near = rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(facts.join(F.broadcast(hot), key, "left_semi")), key, "left")
    return near.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(facts, key, "left"))


def tasks_for(df: DataFrame, each: int = 1) -> int:
    """A number of partitions that follows the input: its splits hold a bounded number of bytes."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), each * df.rdd.getNumPartitions())
