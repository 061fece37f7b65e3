"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Prefix of every column an operator adds for itself, so that extra input columns cannot clash with it.
OWN = "__gw_"

#: Rows up to which a table of narrow rows (under 64 bytes) is broadcast, after it was counted: 16 MB at most.
BROADCAST_ROWS = 250_000
#: A key is hot from this share of the rows on, so there are fewer hot keys than 1 / share; its rows are dealt over SALTS tasks.
HOT_SHARE, SALTS = 0.001, 64

_LOCAL: dict[str, str] = {}
_TABLES: dict[str, Callable[[], None]] = {}


def claim(name: str, release: Callable[[], None] | None = None) -> None:
    """Called in a Python worker by the operator that begins to use it. Spark hands workers on from stage to stage, so the
    tables that other operators keep there are released, and their memory goes back to the system."""
    others = [k for k in _TABLES if k != name]
    for k in others:
        _TABLES.pop(k)()
    if release:
        _TABLES[name] = release
    if others:
        gc.collect()
        trim()


def trim() -> None:
    """Memory that a worker has freed goes back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, as a URI: spark.checkpoint.dir. Where it is unset, a temporary one in local
    mode (tests); on a cluster that is an error, as executors would write to disks of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="gaugework-")
    return _LOCAL[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gaugework/{name}-{uuid.uuid4().hex}"


def _write(df: DataFrame, path: str) -> DataFrame:
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and no executor's loss can undo it. For results, which stay."""
    return _write(df, fresh_path(df.sparkSession, name))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this run wrote, through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables that only the steps of one job read. Each is deleted when it is dropped, the rest when the block ends, after
    failures too; the shuffle files of finished steps go with the JVM's next collection, which a drop asks for."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.held = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*[df for df, _ in self.held])

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        self.held.append((None, path))
        out = _write(df, path)
        self.held[-1] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df, path in [h for h in self.held if any(h[0] is t for t in tables)]:
            remove(self.spark, path)
        self.held = [h for h in self.held if not any(h[0] is t for t in tables)]
        self.spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it was counted to have at most that many rows, else df as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def salted_join(many: DataFrame, one: DataFrame, key: str, spread: Column, how: str = "inner") -> DataFrame:
    """many joined with one, whose keys are unique. Keys that hold more than HOT_SHARE of many's rows are dealt over SALTS
    tasks by spread, and their rows of one are repeated for each. many is counted by key first, with partial sums."""
    counts = many.groupBy(key).agg(F.count("*").alias(OWN + "rows"))
    total = many.count()
    hot = [r[0] for r in counts.filter(F.col(OWN + "rows") > max(HOT_SHARE * total, 1000)).select(key).collect()]
    if not hot:
        return many.join(one, key, how)
    marks = F.broadcast(many.sparkSession.createDataFrame([(k,) for k in hot], counts.select(key).schema).withColumn(OWN + "hot", F.lit(True)))
    salt = F.when(F.col(OWN + "hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(0).cast("int")
    salts = F.when(F.col(OWN + "hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = many.join(marks, key, "left").withColumn(OWN + "salt", salt).drop(OWN + "hot")
    right = one.join(marks, key, "left").withColumn(OWN + "salt", F.explode(salts)).drop(OWN + "hot")
    return left.join(right, [key, OWN + "salt"], how).drop(OWN + "salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def doc_bucket(col: str = "doc_id"):
    """crc32 of the id as text, modulo 4; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % 4
