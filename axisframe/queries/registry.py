"""Queries by name, each with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cube import Cube
from ..plans.timecube import TimeCube

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The views of the test tables, in DuckDB's spelling.
VIEWS = {
    "cube": "SELECT event_id % 5 AS a, (event_id // 5) % 20 AS b, event_id // 100 AS c, value FROM events",
    "sig": "SELECT event_id % 4 AS ch, event_id // 4 AS smp, value FROM events",
    "evt": "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, value FROM events",
    "holes": "SELECT event_id % 5 AS a, (event_id // 5) % 20 AS b, event_id // 100 AS c, CASE WHEN value > 150 THEN 'NaN'::DOUBLE ELSE value * 0.7310585 END AS value FROM events",
    "onset": "SELECT event_id AS ev, event_id // 4 AS smp FROM events WHERE event_type = 'purchase' AND event_id // 4 >= 20 AND event_id // 4 < (SELECT count(*) // 4 FROM events) - 20",
    "emb": "SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings",
}


def query(sql: str | None = None):
    """Registers ``f(views)``; ``sql`` may use the views by name."""

    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            used = [k for k in VIEWS if f" {k} " in f" {sql} ".replace("\n", " ").replace(")", " ").replace(",", " ")]
            ctes = ", ".join(f"{k} AS ({VIEWS[k]})" for k in used)
            body = sql.strip()
            start = next((w for w in ("WITH RECURSIVE ", "WITH ") if body.upper().startswith(w)), "")
            ORACLES[f.__name__] = f"{start or 'WITH '}{ctes}{',' if start else ''} {body[len(start) :]}" if used else body
        return f

    return keep


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def events(self) -> DataFrame:
        return self.table("events")

    @property
    def cube(self) -> Cube:
        i = F.col("event_id")
        rows = self.events.select((i % 5).alias("a"), F.expr("event_id div 5 % 20").alias("b"), F.expr("event_id div 100").alias("c"), "value")
        return Cube.from_positions(rows, ("a", "b", "c"))

    @property
    def holes(self) -> Cube:
        return self.cube.map(lambda v: F.when(v > 150, F.lit(float("nan"))).otherwise(v * 0.7310585))

    @property
    def sig(self) -> TimeCube:
        """4 channels, nominally at 200 Hz; labels of time are sample numbers."""
        rows = self.events.select((F.col("event_id") % 4).alias("ch"), F.expr("event_id div 4").alias("smp"), "value")
        return TimeCube.of(Cube.from_positions(rows, ("ch", "smp")), "smp", 200.0)

    @property
    def signal(self) -> DataFrame:
        return self.events.select(F.lit("rec").alias("esrc"), (F.col("event_id") % 4).cast("int").alias("channel"), F.expr("event_id div 4").alias("sample"), "value")

    @property
    def n_samples(self) -> int:
        return self.events.count() // 4

    @property
    def onsets(self) -> DataFrame:
        """Purchases at least 20 samples from either end: (event, esrc, eoffset in samples)."""
        smp, n = F.expr("event_id div 4"), self.n_samples
        rows = self.events.where((F.col("event_type") == "purchase") & (smp >= 20) & (smp < n - 20))
        return rows.select(F.col("event_id").alias("event"), F.lit("rec").alias("esrc"), smp.alias("eoffset"))

    @property
    def emb(self) -> DataFrame:
        return self.table("embeddings").select("vec_id", "label", F.posexplode("embedding").alias("k", "v")).withColumn("v", F.col("v").cast("double"))


def rows(cube: Cube | DataFrame, digits: int | None = 6, **rename: str) -> DataFrame:
    """Labels as BIGINT, values as rounded DOUBLE: what both engines are compared by."""
    if isinstance(cube, Cube):
        cols = [F.col(d).cast("long").alias(rename.get(d, d)) for d in cube.dims]
        v = F.col(cube.value)
        kind = dict(cube.df.dtypes)[cube.value]
        v = v.cast("long") if kind in ("int", "bigint") else v if kind == "boolean" else F.round(v.cast("double"), digits) + F.lit(0.0)
        return cube.df.select(*cols, v.alias("value"))
    out = []
    for name, kind in cube.dtypes:
        c = F.col(name)
        out.append((c.cast("long") if kind in ("int", "bigint", "smallint") else F.round(c.cast("double"), digits) + F.lit(0.0) if kind in ("double", "float") else c).alias(name))
    return cube.select(*out)
