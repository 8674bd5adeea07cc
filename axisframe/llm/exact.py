"""Exact deduplication by sorting content.

Rows are range-partitioned by sampled splitters over (first bytes, 64-bit digest, id) and sorted outside
memory by (first bytes, digest, whole text, id), so equal texts stand side by side and each row is compared in
full with its neighbour. The splitter key is short whatever the texts are, and the id in it lets one text's
copies spread over many partitions: a run that crosses a partition's edge is joined to its continuation through
a table of at most two digests a partition, and whole texts are compared where these agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import materialise, merged
from .common import fresh, lean

META = ("__keep", "__size", "__last", "__sha", "__pid", "__edge", "__edge_text")


def _runs(batches: Iterator[pa.RecordBatch], id_col: str) -> Iterator[pa.RecordBatch]:
    """Sorted rows -> their ids with their run's last id and size."""
    import numpy as np
    import pyarrow.compute as pc
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    held: list[pa.RecordBatch] = []  # rows of the open run, without texts
    held_n, text, emitted = 0, None, False

    def finish(rows: pa.RecordBatch, ends, sizes, edges, texts) -> pa.RecordBatch:
        """rows: whole runs that end before ``ends``."""
        each = np.diff(np.concatenate([[0], ends]))
        which = pa.array(np.repeat(np.arange(len(each)), each))
        tail = np.zeros(rows.num_rows, bool)
        tail[np.cumsum(each) - 1] = True
        ids = rows.column(rows.schema.get_field_index(id_col)).take(pa.array(np.cumsum(each) - 1)).take(which)
        meta = [ids, pa.array(np.asarray(sizes, np.int64)).take(which), pa.array(tail), rows.column(rows.schema.get_field_index("__sha")), pa.array(np.full(rows.num_rows, pid, np.int32)), pa.array(np.asarray(edges, np.int32)).take(which)]
        edge_text = pa.array([texts.get(w) if t else None for w, t in zip(which.to_pylist(), tail, strict=True)] if texts else [None] * rows.num_rows, pa.string())
        return pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index(id_col)), *meta, edge_text], [id_col, *META])

    def close(final: bool) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        edge = (0 if emitted else 1) | (2 if final else 0)
        return finish(rows, [rows.num_rows], [held_n], [edge], {0: text} if edge else {})

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        words = batch.column(batch.schema.get_field_index("__text"))
        starts = np.ones(n, bool)
        starts[0] = not held or words[0].as_py() != text
        if n > 1:
            starts[1:] = pc.not_equal(words.slice(1), words.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        rows, at = batch.select([c for c in batch.schema.names if c not in ("__text", "__prefix", "__hash")]), np.flatnonzero(starts)
        first = int(at[0]) if len(at) else n
        if first:  # the open run goes on
            part = rows.slice(0, first)
            held, held_n = [*held, part], held_n + first
        if not len(at):
            continue
        if held:
            yield close(final=False)
            emitted = True
        if len(at) > 1:
            begin, end = int(at[0]), int(at[-1])
            edges = np.zeros(len(at) - 1, np.int32)
            texts = {}
            if not emitted:
                edges[0], texts = 1, {0: words[begin].as_py()}
            yield finish(rows.slice(begin, end - begin), at[1:] - begin, np.diff(at), edges, texts)
            emitted = True
        part = rows.slice(int(at[-1]))
        held, held_n, text = [part], part.num_rows, words[int(at[-1])].as_py()
    if held:
        yield close(final=True)


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical; null counts as empty, so nulls and empties form one group. Of equal texts the
    row with the largest id stays; of rows that repeat that id too, one stays. Null ids sort first: one stays
    only in a group that has no other. An empty table gives an empty one; other columns are ignored, whatever their names.
    ``prefix``: characters in the splitter key; the result doesn't depend on it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("__id"), text.alias("__text"), F.substring(text, 1, prefix).alias("__prefix"), F.xxhash64(text).alias("__hash"))
    dealt = keyed.repartitionByRange("__prefix", "__hash", "__id").sortWithinPartitions("__prefix", "__hash", "__text", "__id")
    dealt = dealt.withColumn("__sha", F.sha2(F.col("__text").cast("binary"), 256))
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(n, k) for n, k in zip(("__id", *META), (kind, kind, T.LongType(), T.BooleanType(), T.StringType(), T.IntegerType(), T.IntegerType(), T.StringType()), strict=True)])
    rows = materialise(dealt.mapInArrow(lean(lambda batches: _runs(batches, "__id")), schema))
    # at most two rows a partition: is this run the continuation of the one before? Digests first
    edges = rows.where(F.col("__edge_text").isNotNull()).select("__pid", "__edge", "__keep", "__size", "__sha").orderBy("__pid", "__edge").collect()
    alike = [(i, *(x for e in edges[i - 1 : i + 1] for x in (e["__pid"], e["__edge"]))) for i in range(1, len(edges)) if edges[i]["__sha"] == edges[i - 1]["__sha"]]
    same = _same_texts(rows, alike) if alike else set()
    chains: list[list] = []
    for i, e in enumerate(edges):
        if i in same:
            chains[-1].append(e)
        else:
            chains.append([e])
    mended = [(e["__pid"], e["__edge"], c[-1]["__keep"], sum(x["__size"] for x in c), i == len(c) - 1) for c in chains if len(c) > 1 for i, e in enumerate(c)]
    if mended:
        better = docs.sparkSession.createDataFrame(mended, T.StructType([T.StructField(n, k) for n, k in zip(("__pid", "__edge", "__keep2", "__size2", "__tail"), (T.IntegerType(), T.IntegerType(), kind, T.LongType(), T.BooleanType()), strict=True)]))
        rows = rows.join(F.broadcast(better), ["__pid", "__edge"], "left").withColumns(  # bounded by twice the number of partitions
            {"__keep": F.when(F.col("__tail").isNull(), F.col("__keep")).otherwise(F.col("__keep2")), "__size": F.coalesce("__size2", "__size"), "__last": F.col("__last") & F.coalesce("__tail", F.lit(True))}
        )
    return rows.select(F.col("__id").alias(id_col), F.col("__keep").alias("keep_id"), F.col("__size").alias("group_size"), F.col("__last").alias("kept"), F.col("__sha").alias("text_sha256"))


def _same_texts(rows: DataFrame, alike: list[tuple]) -> set[int]:
    """Of runs on two sides of partitions' edges whose digests agree, those whose whole texts do: compared where they are, not on the driver."""
    ends = rows.where(F.col("__edge_text").isNotNull())
    pairs = F.broadcast(rows.sparkSession.createDataFrame(alike, "i int, pid_a int, edge_a int, pid_b int, edge_b int"))  # at most one a partition
    a, b = (ends.select(F.col("__pid").alias(f"pid_{c}"), F.col("__edge").alias(f"edge_{c}"), F.col("__edge_text").alias(f"text_{c}")) for c in "ab")
    both = a.join(pairs, ["pid_a", "edge_a"]).select("i", "text_a").join(b.join(pairs, ["pid_b", "edge_b"]).select("i", "text_b"), "i")
    return {r["i"] for r in both.where("text_a = text_b").select("i").collect()}


def _last_of_runs(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    """Sorted rows -> the last row of each run of equal texts; one row is held over from batch to batch."""
    import numpy as np
    import pyarrow.compute as pc

    held, text = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        words = pc.fill_null(batch.column(batch.schema.get_field_index(text_col)), "")
        if held is not None and words[0].as_py() != text:
            yield held
        ends = np.flatnonzero(pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False))
        if len(ends):
            yield batch.take(pa.array(ends))
        held, text = batch.slice(batch.num_rows - 1), words[-1].as_py()
    if held is not None:
        yield held


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64) -> DataFrame:
    """The rows of ``docs`` that stay, all columns, by the rules of :func:`mark_copies`.

    Each task first sorts and thins out its own rows, so of a text's copies at most one a task is moved, however
    many there are; then splitters over (first bytes, digest) bring equal texts together.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    prefix_col, hash_col = fresh("prefix", docs.columns), fresh("hash", docs.columns)
    rows = docs.withColumns({prefix_col: F.substring(text, 1, prefix), hash_col: F.xxhash64(text)})

    def thin(df: DataFrame) -> DataFrame:
        return df.sortWithinPartitions(prefix_col, hash_col, text, id_col).mapInArrow(lean(lambda batches: _last_of_runs(batches, text_col)), rows.schema)

    dealt = thin(rows).repartitionByRange(prefix_col, hash_col)
    return thin(merged(dealt)).select(*docs.columns)  # a range stays in one task when small ones are merged
