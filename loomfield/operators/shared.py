"""Intermediate tables in the cluster's shared folder, and connected components over them."""

from __future__ import annotations

import re
import tempfile
import threading
import time
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark setting: the shuffle files of a SQL execution go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_scope: ContextVar[list | None] = ContextVar("scratch", default=None)
_lock = threading.Lock()
_made: set[str] = set()
_writers: dict[int, tuple[int, str | None]] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a new one only in local mode, where all tasks see the same disk."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(folder)
    return folder


def _files(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def tables_dir(spark: SparkSession) -> str:
    """This application's own folder of tables in the shared folder; it goes when the driver's JVM ends."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/stash-{spark.sparkContext.applicationId}"
    with _lock:
        if folder not in _made:
            at, fs = _files(spark, folder)
            fs.mkdirs(at)
            fs.deleteOnExit(at)
            _made.add(folder)
    return folder


def stash(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: lineage is cut, sizes are known, and the shuffle files behind it go.

    The table goes with the `scratch` around the call, or else with the application.
    """
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/{uuid.uuid4().hex}"
    scope = _scope.get()
    with _shuffles_go(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if scope is not None:
        scope.append((out, path))
    return out


@contextmanager
def _shuffles_go(spark: SparkSession):
    """The setting is the session's, so the first writer of a session sets it and the last one sets it back."""
    key = id(spark._jsparkSession)
    with _lock:
        writers, before = _writers.get(key, (0, None))
        if not writers:
            before = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _writers[key] = (writers + 1, before)
    try:
        yield
    finally:
        with _lock:
            writers, before = _writers.pop(key)
            if writers > 1:
                _writers[key] = (writers - 1, before)
            elif before is None:
                spark.conf.unset(CLEANUP)
            else:
                spark.conf.set(CLEANUP, before)


@contextmanager
def scratch():
    """Tables that `stash` writes inside go at the end, but for those given to the function that this yields.

    What is kept belongs to the scratch around this one, if any.  Read or write results inside, as a lazy DataFrame over a
    table that went can't be read::

        with scratch():
            QUERIES["kmeans_full"](spark, folder).write.parquet(path)
    """
    outer, mine, kept = _scope.get(), [], []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    token = _scope.set(mine)
    try:
        yield keep
    finally:
        _scope.reset(token)
        for df, path in mine:
            if not any(df is k for k in kept):
                at, fs = _files(df.sparkSession, path)
                fs.delete(at, True)
            elif outer is not None:
                outer.append((df, path))


def sweep(spark: SparkSession, hours: float) -> list[str]:
    """Remove tables that applications left which ended without their exit hooks: folders last written to over `hours` ago."""
    root, fs = _files(spark, checkpoint_dir(spark))
    own, now, gone = tables_dir(spark), time.time(), []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("stash-") and not own.endswith("/" + name) and now - status.getModificationTime() / 1000 > hours * 3600:
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df, a scan, dealt out by keys where its files give fewer tasks than there are cores; unchanged, and unshuffled, elsewhere.

    A file of one row group is one task, whatever its size.  Large inputs have more row groups than the cluster has cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def connected(links: DataFrame) -> DataFrame:
    """links(a, b) -> (id, component): the least id that each id can reach, for ids with a link to another id.

    Null ends and loops are ignored, repeated links do no harm.  In each round every id hooks to the first of itself and
    its neighbours, follows that one's hook once more, and what hooks together becomes one; the rounds' hooks are then
    followed from the last to the first.  First is the least id in the first round, which takes a star around its least id at
    once, and the least hash, another one each time, in later rounds, which leaves a fraction of the ids on average,
    whatever the shape of the links: so long chains take rounds in the logarithm of their length.  Every round is a written table:
    the planner sees its real size, and a lost executor costs one round.  The last table stays, the others go.
    """
    with scratch() as keep:
        ends = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        left = stash(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        rounds = []
        while left.limit(1).count():
            rank = lambda c: F.struct((F.xxhash64(F.col(c), F.lit(len(rounds))) if rounds else F.lit(0).cast("long")).alias("h"), F.col(c).alias("id"))  # noqa: E731, B023
            both = left.select(F.explode(F.array(F.struct(F.col("a").alias("id"), rank("b").alias("other")), F.struct(F.col("b").alias("id"), rank("a").alias("other")))).alias("e")).select("e.id", "e.other")
            hooks = both.groupBy("id").agg(F.min("other").alias("to")).where(F.col("to") < rank("id")).select("id", F.col("to.id").alias("to"))
            further = hooks.select(F.col("id").alias("_id"), F.col("to").alias("_to"))
            hooks = stash(hooks.join(further, F.col("to") == F.col("_id"), "left").select("id", F.coalesce("_to", "to").alias("to")))
            rounds.append(hooks)
            low, high = (hooks.select(F.col("id").alias(f"_{x}"), F.col("to").alias(f"_to_{x}")) for x in "ab")
            moved = left.join(high, F.col("b") == F.col("_b"), "left").join(low, F.col("a") == F.col("_a"), "left")
            moved = moved.select(F.coalesce("_to_a", "a").alias("x"), F.coalesce("_to_b", "b").alias("y")).where("x <> y")
            left = stash(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if not rounds:
            return keep(left).select(F.col("a").alias("id"), F.col("b").alias("component"))
        named = rounds.pop().select("id", F.col("to").alias("head"))
        while rounds:
            hooks = rounds.pop()
            later = named.select(F.col("id").alias("_id"), "head")
            first = hooks.join(later, F.col("to") == F.col("_id"), "left").select("id", F.coalesce("head", "to").alias("head"))
            # An id that hooked in this round may hook again later, as what others follow: its first hook counts.
            named = stash(first.unionByName(named.join(hooks.select("id"), "id", "left_anti")))
        heads = named.select(F.col("head").alias("id"), "head").distinct().join(named.select("id"), "id", "left_anti")
        named = keep(stash(named.unionByName(heads)))
        least = named.groupBy(F.col("head").alias("_head")).agg(F.min("id").alias("component"))
        return named.join(least, F.col("head") == F.col("_head")).select("id", "component")
