"""Getting this package to the Python workers of a cluster, and rows to its tasks."""

from __future__ import annotations

import re
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SHIPPED = "_bookloom_shipped"


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a context, so that Python workers can
    import it whatever their folder and path."""
    context = spark.sparkContext
    if getattr(context, _SHIPPED, False):
        return
    top = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-")) / f"{top.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(top.rglob("*.py")):
            archive.write(path, f"{top.name}/{path.relative_to(top)}")
    context.addPyFile(str(target))
    setattr(context, _SHIPPED, True)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df in more parts than there are cores, by keys if any: for rows that take long for their
    few bytes, of which Spark, going by bytes, makes few tasks."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def in_groups(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """rows with `_nth`, their place in their group from 1, groups whole and in order in their
    parts: for whole_groups."""
    return dealt(rows, *keys).withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def whole_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables of whole groups out of in_groups' batches, and where in them each group lies. One
    call takes many small groups, which a call each would make far dearer than their work."""
    held: list[pa.RecordBatch] = []

    def told(table: pa.Table) -> tuple[pa.Table, list[tuple[int, int]]]:
        at = np.flatnonzero(table["_nth"].to_numpy() == 1).tolist()
        return table, list(zip(at, [*at[1:], table.num_rows], strict=True))

    for batch in batches:
        firsts = np.flatnonzero(batch.column("_nth").to_numpy(zero_copy_only=False) == 1)
        if len(firsts) and (last := int(firsts[-1])) + len(held):
            done = [*held, batch.slice(0, last)]
            yield told(pa.Table.from_batches(done))
            held = [batch.slice(last)]
        elif batch.num_rows:
            held.append(batch)
    if held:
        yield told(pa.Table.from_batches(held))


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the folder that spark.checkpoint.dir names; where none is named,
    only local sessions get a temporary one. The shuffle files of the query go with it, not when
    the driver happens to collect its garbage."""
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    freed = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(freed, None)
    spark.conf.set(freed, "true")
    try:
        return df.select("*").checkpoint()  # a query of its own, as the setting is read when a query is made
    finally:
        spark.conf.unset(freed) if before is None else spark.conf.set(freed, before)
