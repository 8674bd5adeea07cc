"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import from_driver, merged


#: Bytes of a batch that a Python worker gets at once.
BATCH = 8 << 20


def opened(df: DataFrame) -> DataFrame:
    """``df`` for operators with Python workers: splits not worth a task merged, and Arrow batches of 8 MB in its session.

    A row count alone doesn't bound a batch of whole texts. A session that has set a bound of its own keeps it.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, "64MB") == "64MB":
        conf.set(key, str(BATCH))
    return merged(df)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return opened(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's decimal text leaves 1 when divided by 3 (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def sample_rows(df: DataFrame, key: str, group: str, per_group: int) -> DataFrame:
    """About ``per_group`` rows of each value of ``group``, chosen by a hash of ``key``: the same on every run.

    Only ``group`` is counted to find the fractions. Null groups are left out. The table of fractions has a row a
    group; it is broadcast where these are few enough, else joined by a shuffle.
    """
    spark, spread = df.sparkSession, 1 << 30
    kind = df.schema[group].dataType.simpleString()
    counts = df.where(F.col(group).isNotNull()).groupBy(group).count().collect()
    edges = [(r[0], spread if r[1] <= per_group else int(spread * per_group / r[1])) for r in counts]
    name = fresh("edge", df.columns)
    edge = from_driver(spark, edges, f"`{group}` {kind}, `{name}` long")
    return df.join(edge, group).where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(spread)) < F.col(name)).select(*df.columns)


def fresh(name: str, taken) -> str:
    """``name``, with as many underscores before it as it takes to differ from the names that are taken (case aside)."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name = "_" + name
    return name


def splitmix(x):
    """The splitmix64 finaliser over a numpy uint64 array (wraps modulo 2**64)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lean(run):
    """A function for ``mapInArrow`` whose worker gives Arrow's memory back after each batch instead of holding on to it."""

    def frugal(batches):
        import pyarrow as pa

        for batch in run(batches):
            yield batch
            del batch
            pa.default_memory_pool().release_unused()

    return frugal


_KEPT: dict[tuple[str, str], object] = {}


def once_per_process(kind: str, key: str, make):
    """``make()`` for the first task of a Python worker, then the same object; the worker keeps the last one only."""
    if (kind, key) not in _KEPT:
        _KEPT.clear()
        _KEPT[kind, key] = make()
    return _KEPT[kind, key]


def new_key() -> str:
    return uuid.uuid4().hex
