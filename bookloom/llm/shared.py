"""What the operators of this subpackage share: written intermediate tables, joins
that stand a hot key, and connected components."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space, \t, \n, \v, \f, \r. A word is a run of anything else.
WHITE = " \t\n\x0b\x0c\r"
WHITE_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A key that holds over 1/HEAVY_PART of all rows is heavy, so there are fewer than
#: HEAVY_PART heavy keys whatever the data: a broadcast with a proven bound.
HEAVY_PART = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application in the shared one that spark.checkpoint.dir names. Only
    where everything runs in one process (tests) and none is named, a temporary one is
    made, which goes when the process ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        folder = "file://" + local
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/{spark.sparkContext.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: computed once, lineage cut, and safe
    against lost executors. The tables of an application lie in one folder, to be removed
    when it is over; drop_written removes one before."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path  # type: ignore[attr-defined]
    return out


def drop_written(df: DataFrame) -> None:
    """Remove a table made by written() that nothing reads any more."""
    path = getattr(df, "_written_at", None)
    if path:
        spark = df.sparkSession
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of jobs that are over: it goes by what the
    driver's garbage collector finds, which may not run for long."""
    gc.collect()
    spark._jvm.System.gc()


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """Inside, Spark removes the shuffle files of a query as soon as the query is over, whatever
    the driver's garbage collector has found by then. For queries that end in a written table."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def ascii_lower(text):
    return F.translate(text, UPPER, LOWER)


def words_of(text):
    """array<string> of the words of a text; null: none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), WHITE, " " * len(WHITE))
    return F.array_remove(F.split(spaced, " "), "")


def let(value, body):
    """body(value) with value computed once per row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join by shuffle and sort. Where no hint says so Spark broadcasts a side that it takes for small,
    by the bytes of its files, whatever they unpack to and however many rows an explode makes of them."""
    return df.hint("merge")


def attach(rows: DataFrame, lookup: DataFrame, key: str, n_rows: int, count: str = "n") -> DataFrame:
    """rows left-joined with lookup (one row per key, with the key's row count in
    `count`). Heavy keys go by broadcast, the rest by a shuffle, so that no task gets
    all rows of a hot key."""
    heavy = lookup.where(F.col(count) * HEAVY_PART > F.lit(n_rows)).drop(count)
    marked = rows.join(
        F.broadcast(heavy.select(F.col(key), F.lit(True).alias("_heavy"))), key, "left")
    hot = marked.where("_heavy").drop("_heavy").join(F.broadcast(heavy), key)
    rest = marked.where("_heavy IS NULL").drop("_heavy").join(
        shuffled(lookup.where(F.col(count) * HEAVY_PART <= F.lit(n_rows)).drop(count)), key, "left")
    return hot.unionByName(rest)


def _settled(edges: DataFrame) -> bool:
    """Every node has one smaller neighbour, which has none: stars."""
    doubled = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a")
    chained = edges.join(shuffled(edges.select(F.col("b").alias("a"))), "a", "left_semi").select("a")
    return not doubled.union(chained).limit(1).count()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Connected components of undirected edges (a, b) of longs.

    Returns (node, component): every node that has an edge to another node, with the
    smallest node of its component. Alternates large-star and small-star steps, which
    end in stars around each smallest node after O(log^2 n) rounds; a round is two
    minima per node (combined before the shuffle) and two joins, written to the shared
    folder. Loops and repeated edges are ignored; no edges give no rows.
    """
    now = written(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        if _settled(now):
            break
        # large star: larger neighbours of a node move to the least of its neighbourhood
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(shuffled(least), "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours move to the least of them
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(shuffled(floor), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        step = written(small.union(floor).where("a <> b").distinct())
        drop_written(now)
        now = step
    else:
        raise RuntimeError(f"components not settled in {max_rounds} rounds")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
