"""What the corpus operators share: scratch tables in the cluster's shared folder,
positions within hot groups, and columnar blocks for shuffles of many small records."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import inspect
import math
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (only where that
    is unset, as in local tests) a temporary folder which is then set as the checkpoint dir."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not getattr(shared_dir, "own", None):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        shared_dir.own = tempfile.mkdtemp(prefix="sparkpact-")
        spark.sparkContext.setCheckpointDir(shared_dir.own)
    return shared_dir.own


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Whole texts can be long: fewer rows go to a Python worker at a time than Spark's default."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A setting of the session, put back as it was."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Scratch:
    """Tables written as Parquet in the shared folder: lineage ends there, so a lost executor
    costs a re-read and not a recomputation. `drop` frees the ones no longer needed; what a result still
    reads stays until `passing` ends or the driver does."""

    open: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        Scratch.open.append(self)

    @staticmethod
    @contextlib.contextmanager
    def passing():
        """Frees all tables that operators write within, once their results have been written elsewhere."""
        before = list(Scratch.open)
        try:
            yield
        finally:
            for s in [s for s in Scratch.open if s not in before]:
                s.close()

    def close(self) -> None:
        self._delete(self.root)
        Scratch.open.remove(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, lean: bool = False) -> DataFrame:
        """`lean`: packed closer, and the shuffle files of the write go when it ends, not when the driver's memory is next cleaned."""
        if lean:
            with setting(self.spark, FREE_SHUFFLES, "true"):
                df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        else:
            df.write.mode("overwrite").parquet(self.path(name))
        return self.load(name, df)

    def load(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _end() -> None:
    for s in list(Scratch.open):
        with contextlib.suppress(Exception):  # the session may be gone
            s.close()


_held: dict = {}


def held(name, make):
    """What a worker process keeps between tasks, made once. Only one such thing is kept, so that
    the caches of several operators don't add up."""
    if name not in _held:
        _held.clear()
        gc.collect()
        _held[name] = make()
    return _held[name]


def trim() -> None:
    """Gives free memory back to the system: workers stay, and what each keeps adds up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(f):
    """A function of batches or of groups that trims the worker's memory when it is done (for groups:
    once a second at most)."""
    if inspect.isgeneratorfunction(f):

        @functools.wraps(f)
        def run(batches):
            yield from f(batches)
            trim()

        return run
    last = [time.monotonic()]

    @functools.wraps(f)
    def once(*groups):
        out = f(*groups)
        if time.monotonic() - last[0] > 1:
            trim()
            last[0] = time.monotonic()
        return out

    once.__signature__ = inspect.signature(f)
    return once


def whole_row(df: DataFrame) -> Column:
    """All columns, of whatever name, as one struct."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_table(spark: SparkSession, rows: list[tuple], **types: pa.DataType) -> DataFrame:
    """A table of rows made on the driver, by Arrow: no Python worker is needed to read it."""
    columns = list(zip(*rows)) or [()] * len(types)
    return spark.createDataFrame(pa.table({n: pa.array(list(c), t) for (n, t), c in zip(types.items(), columns)}))


def split_count(rows: int, each: int, least: int) -> int:
    """Into how many pieces a group is split so that a piece holds about `each` rows."""
    return max(least, math.ceil(rows / each))


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str, pieces: int) -> DataFrame:
    """`df` with `out`: positions from 0 without gaps within `keys` (not null).

    A group is split by a hash of `order` into `pieces`, which are numbered apart and then
    shifted by the rows of the pieces before: no task holds a whole group. `order` has to tell rows apart,
    else those alike stay in one piece."""
    cut = df.withColumn("_piece", F.pmod(F.xxhash64(*order), F.lit(pieces)).cast("int"))
    within = Window.partitionBy(*keys, "_piece").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        cut.groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    )
    return (
        cut.withColumn("_row", F.row_number().over(within) - 1)
        .join(shift, [*keys, "_piece"])
        .withColumn(out, (F.col("_row") + F.col("_shift")).cast("long"))
        .drop("_piece", "_row", "_shift")
    )


def join_spread(rows: DataFrame, facts: DataFrame, key: str, apart: list[str], pieces: int = 64, how: str = "inner") -> DataFrame:
    """`rows` joined with `facts`, which has one row a key. A key of very many rows is spread over `pieces` by
    a hash of the columns `apart`: facts go once to each piece that a key has, and so no task gets all its rows."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*apart), F.lit(pieces)).cast("int"))
    spread = salted.select(key, "_salt").distinct().join(facts, key)
    return salted.join(spread, [key, "_salt"], how).drop("_salt")


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str], apart: list[str], most_bytes: int = 8 << 20) -> DataFrame:
    """`rows` joined with `facts`, which has one row for the values of `keys`: broadcast if its keys and 64 bytes
    a row come to no more than `most_bytes`, else with keys of very many rows spread by a hash of `apart`."""
    key_bytes = sum((F.octet_length(F.col(k).cast("string")) for k in keys), F.lit(64))
    if (facts.agg(F.sum(key_bytes)).first()[0] or 0) <= most_bytes:
        return rows.join(F.broadcast(facts), keys)
    more = [c for c in facts.columns if c not in keys]
    facts = facts.select(F.struct(*keys).alias("_key"), *more)
    return join_spread(rows.withColumn("_key", F.struct(*keys)), facts, "_key", apart).drop("_key")


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
