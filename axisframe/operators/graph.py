"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import materialise, scratch, sized


def components(edges: DataFrame, write=materialise, most: int | None = None) -> DataFrame:
    """(id, root) of every node of the edges (a, b): the smallest id of its component.

    Each round every node takes the least root among its neighbours' and its own, then the root of that root, so
    long chains halve. A round is written to the shared folder before the next begins; the result is written by
    ``write``, the rounds are deleted. ``most``: a bound on the number of edges, if known, that sizes the files.
    """
    with scratch(edges.sparkSession) as keep:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        both = keep(both if most is None else sized(both, 2 * most))
        rows = both.count()  # bounds the nodes
        label = keep(sized(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")), rows))
        while True:
            near = both.join(label.select(F.col("id").alias("b"), F.col("root").alias("other")), "b").groupBy(F.col("a").alias("id")).agg(F.min("other").alias("other"))
            step = label.join(near, "id").select("id", F.col("root").alias("old"), F.least("root", "other").alias("mid"))
            jump = label.select(F.col("id").alias("mid"), F.col("root").alias("far"))
            new = keep(sized(step.join(jump, "mid").select("id", "old", F.least("mid", "far").alias("root")), rows))
            label = new.select("id", "root")
            if new.where(F.col("old") != F.col("root")).isEmpty():
                return write(sized(label, rows))
