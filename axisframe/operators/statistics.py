"""Resampling statistics and corrections for many tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.dist import normal_cdf, t_sf2, z_one_sided


def sorted_ranks(df: DataFrame, by: Column) -> DataFrame:
    """``__rank`` 1.. over the whole table in the order of ``by``: ranges of values are sorted apart and counted, so no task sorts all.

    Rows of one value are told apart by where they come from, so they too can be dealt over several ranges.
    """
    from ..plans.lineage import materialise

    keyed = df.withColumns({"__value": by, "__source": F.monotonically_increasing_id()})
    part = materialise(keyed.repartitionByRange("__value", "__source").withColumns({"__part": F.spark_partition_id(), "__by": F.struct("__value", "__source")}).drop("__value", "__source"))
    sizes = part.groupBy("__part").agg(F.count("*").alias("__n"))  # one row a partition
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__part", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    inner = Window.partitionBy("__part").orderBy("__by")
    return part.join(F.broadcast(sizes), "__part").withColumn("__rank", F.row_number().over(inner) + F.col("__before")).drop("__by", "__before")


def fdr(df: DataFrame, p: str = "p", alpha: float = 0.05, method: str = "indep") -> DataFrame:
    """``df`` with ``p_corrected`` and ``reject``: Benjamini-Hochberg ("indep") or Benjamini-Yekutieli ("negcorr").

    A test is rejected if its p-value is at or below the largest one that lies strictly below its line.
    """
    ranked = sorted_ranks(df, F.col(p))
    n = df.count()
    if method in ("indep", "poscorr"):
        factor = 1.0
    elif method in ("negcorr", "n"):
        factor = df.sparkSession.range(1, n + 1).agg(F.sum(1 / F.col("id"))).first()[0] or 1.0
    else:
        raise ValueError("method is 'indep' or 'negcorr'")
    raw = F.col(p) * F.lit(n * factor) / F.col("__rank")
    ranked = ranked.withColumn("__raw", raw).withColumn("__below", F.col(p) < F.col("__rank") * F.lit(alpha / (n * factor)))
    # the least corrected value from here on, and whether a later test is rejected: by partition, then inside
    ends = ranked.groupBy("__part").agg(F.min("__raw").alias("m"), F.max("__below").alias("b"))
    later = Window.orderBy("__part").rowsBetween(1, Window.unboundedFollowing)
    ends = ends.select("__part", F.min("m").over(later).alias("__m"), F.coalesce(F.max("b").over(later), F.lit(False)).alias("__b"))
    # from the end on: a frame that grows is carried along, one that shrinks would be summed up anew at each row
    on = Window.partitionBy("__part").orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0)
    out = ranked.join(F.broadcast(ends), "__part")  # one row a partition
    out = out.withColumn("p_corrected", F.least(F.lit(1.0), F.min("__raw").over(on), "__m")).withColumn("reject", F.max("__below").over(on) | F.col("__b"))
    return out.select(*df.columns, "p_corrected", "reject")


def holm(df: DataFrame, p: str = "p") -> DataFrame:
    """``df`` with ``p_corrected`` by Holm's step-down method."""
    ranked, n = sorted_ranks(df, F.col(p)), df.count()
    ranked = ranked.withColumn("__raw", F.col(p) * (F.lit(n) - F.col("__rank") + 1))
    ends = ranked.groupBy("__part").agg(F.max("__raw").alias("m"))
    ends = ends.select("__part", F.max("m").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__m"))
    upto = Window.partitionBy("__part").orderBy("__rank").rowsBetween(Window.unboundedPreceding, 0)
    out = ranked.join(F.broadcast(ends), "__part").withColumn("p_corrected", F.least(F.lit(1.0), F.greatest(F.max("__raw").over(upto), "__m")))
    return out.select(*df.columns, "p_corrected")


def order_key(i: Column, k: Column) -> Column:
    """Pseudo-random order of rows i in permutation k, by whole-number arithmetic that any engine repeats; permutation 0 keeps the order."""
    return F.when(k == 0, i.cast("long")).otherwise((i.cast("long") * 2654435761 + k.cast("long") * 40503 * (i.cast("long") % 97 + 1)) % 4294967296)


#: Rows of a group that a task sorts at once in a permutation, about.
DEAL = 1 << 17


def permutations(df: DataFrame, index: str, group: str | None, n: int) -> DataFrame:
    """(perm, ``index``, source): in permutation 0..n each row takes the place of ``source``; rows are shuffled inside their group only.

    Places are found once for all permutations. A large group is cut by its order keys, which fill their range evenly,
    into bins that are sorted apart and counted, so one group may hold all rows.
    """
    from ..plans.lineage import materialise

    rows = df.select(F.col(index).alias("__i"), (F.col(group) if group else F.lit(0)).alias("__g"))
    place = _ranks_within(rows, ["__g"], F.col("__i"))
    sizes = rows.groupBy("__g").agg(F.floor(F.count("*") / DEAL).alias("__bins")).where("__bins > 0")
    sizes = F.broadcast(materialise(sizes).withColumnRenamed("__g", "__of"))  # a row for each DEAL rows at most
    place = materialise(place.join(sizes, place["__g"].eqNullSafe(sizes["__of"]), "left").select("__i", "__g", "__r", (F.coalesce("__bins", F.lit(0)) + 1).alias("__bins")))
    dealt = place.select("__i", "__g", "__bins", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))).alias("perm")) if n else place.select("__i", "__g", "__bins", F.lit(0).cast("long").alias("perm")).limit(0)
    dealt = dealt.withColumn("__key", order_key(F.col("__i"), F.col("perm")))
    keys = ["perm", "__g", "__bin"]
    dealt = dealt.withColumn("__bin", F.shiftright(F.col("__key") * F.col("__bins"), 32))
    counts = dealt.where("__bins > 1").groupBy(*keys).agg(F.count("*").alias("__n"))
    w = Window.partitionBy("perm", "__g").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialise(counts.select(*keys, F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before")))
    before = F.broadcast(counts.toDF(*(f"{k}_" for k in keys), "__before"))  # a row a bin, n for each DEAL / 2 rows at most where keys fill their range
    inside = Window.partitionBy(*keys).orderBy("__key", "__i")
    ranked = dealt.withColumn("__r", F.row_number().over(inside)).drop("__key", "__bins")
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    ranked = ranked.join(before, same, "left").select("perm", "__g", (F.col("__r") + F.coalesce("__before", F.lit(0))).alias("__r"), F.col("__i").alias("source"))
    moved = ranked.join(place, [place["__g"].eqNullSafe(ranked["__g"]), place["__r"] == ranked["__r"]]).select("perm", F.col("__i").alias(index), "source")
    return place.select(F.lit(0).cast("long").alias("perm"), F.col("__i").alias(index), F.col("__i").alias("source")).unionByName(moved)


def _ranks_within(df: DataFrame, keys: list[str], by: Column) -> DataFrame:
    """``df`` with ``__r``: 1.. in the order of ``by`` among the rows of the same keys."""
    ranked = sorted_ranks(df, F.struct(*keys, by.alias("__order")))
    first = ranked.groupBy(*keys).agg(F.min("__rank").alias("__first"))
    other = first.select(*(F.col(k).alias(f"{k}_") for k in keys), "__first")
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    return ranked.join(other, same).withColumn("__r", F.col("__rank") - F.col("__first") + 1).select(*df.columns, "__r")


@F.pandas_udf(DoubleType())
def _z(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(z_one_sided(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of Student's t."""
    return pd.Series(t_sf2(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def normal_pvalue(z: pd.Series) -> pd.Series:
    """Two-sided p-value of a standard normal."""
    return pd.Series(2 * normal_cdf(-np.abs(z.to_numpy(float))))


def ttest_z(df: DataFrame, keys: list[str], value: str, is_x: Column) -> DataFrame:
    """(keys, t, z): pooled t-test of rows where ``is_x`` against the others, and its one-sided z."""
    v = F.col(value)
    x, y = F.when(is_x, v), F.when(~is_x, v)
    m = df.groupBy(*keys).agg(F.avg(x).alias("mx"), F.var_samp(x).alias("vx"), F.count(x).alias("nx"), F.avg(y).alias("my"), F.var_samp(y).alias("vy"), F.count(y).alias("ny"))
    df = F.col("nx") + F.col("ny") - 2
    pooled = ((F.col("nx") - 1) * F.col("vx") + (F.col("ny") - 1) * F.col("vy")) / df
    m = m.withColumns({"t": (F.col("mx") - F.col("my")) / F.sqrt(pooled * (1 / F.col("nx") + 1 / F.col("ny"))), "df": df.cast("double")})
    return m.select(*keys, "t", _z("t", "df").alias("z"))


def permutation_test(df: DataFrame, index: str, value: str, in_x: str, features: list[str] = (), iterations: int = 1000, paired: bool = False, parametric: bool = True) -> DataFrame:
    """(perm, features, t, z): perm 0 is the data, the others have their rows dealt anew to the two sides."""
    if paired:
        raise NotImplementedError("only tests of two samples that are not paired")
    if not parametric:
        raise NotImplementedError("only parametric tests")
    rows = df.select(index, in_x).distinct()
    perms = permutations(rows, index, None, iterations)
    side = rows.select(F.col(index), F.col(in_x).alias("__x"))
    # in a permutation the value of ``source`` stands on the side of ``index``
    dealt = perms.join(side, index).select("perm", F.col("source").alias(index), "__x")
    return ttest_z(df.select(index, *features, value).join(dealt, index), ["perm", *features], value, F.col("__x"))


def bootstrap_counts(df: DataFrame, unit: str, n: int) -> DataFrame:
    """(boot, unit, weight): how often each unit is drawn in each of n bootstrap samples with replacement, by whole-number arithmetic. Units are few."""
    units = df.select(unit).distinct().withColumn("__u", F.row_number().over(Window.orderBy(unit)) - 1)
    size = units.count()
    draws = df.sparkSession.range(n).withColumnRenamed("id", "boot").crossJoin(df.sparkSession.range(size).withColumnRenamed("id", "draw"))
    mixed = (F.col("boot") * 1103515245 + F.col("draw") * 40503 * (F.col("boot") % 89 + 1) + 12345) % 2147483648
    pick = F.floor((mixed * 48271 % 2147483647) * F.lit(size) / F.lit(2147483647.0))
    return draws.withColumn("__u", pick).groupBy("boot", "__u").agg(F.count("*").alias("weight")).join(units, "__u").select("boot", unit, "weight")


def stability(df: DataFrame, unit: str, features: list[str], value: str, n: int = 500) -> DataFrame:
    """(features, ratio, p): a feature's mean over units against its bootstrap standard deviation, as a two-sided t with units - 1 degrees.

    A feature's sums by unit are gathered in one row, and its bootstrap means are products of them with the table of
    weights (samples x units), so rows aren't multiplied by the samples.
    """
    counts = bootstrap_counts(df, unit, n).toPandas()  # samples x units, which are few
    names = {u: i for i, u in enumerate(counts[unit].drop_duplicates())}
    weights = np.zeros((n, len(names)))
    weights[counts["boot"], counts[unit].map(names)] = counts["weight"]

    @F.pandas_udf(DoubleType())
    def spread(units: pd.Series, sums: pd.Series, sizes: pd.Series, there: pd.Series) -> pd.Series:
        return pd.Series([_bootstrap_sd(weights, [names.get(u, -1) for u in us], *x) for us, *x in zip(units, sums, sizes, there, strict=True)], dtype=float)

    parts = df.groupBy(*features, unit).agg(F.sum(value).cast("double").alias("s"), F.count("*").alias("n"), F.count(value).alias("there"))
    lists = parts.where(F.col(unit).isNotNull()).groupBy(*features).agg(F.collect_list(F.struct(F.col(unit).alias("u"), F.coalesce("s", F.lit(0.0)).alias("s"), "n", "there")).alias("x"))
    spreads = lists.select(*features, spread("x.u", "x.s", "x.n", "x.there").alias("sd"))
    mean = parts.groupBy(*features).agg((F.sum("s") / F.when(F.sum("there") > 0, F.sum("there"))).alias("mean"), F.sum("n").alias("n"))
    out = mean.join(spreads, features).withColumn("ratio", F.col("mean") / F.when(F.col("sd") != 0, F.col("sd")))
    return out.select(*features, "ratio", t_pvalue("ratio", (F.col("n") - 1).cast("double")).alias("p"))


def _bootstrap_sd(weights: np.ndarray, at: list[int], sums, sizes, there) -> float | None:
    """Standard deviation of a feature's weighted means, over the samples that draw a unit of it with a value."""
    at = np.asarray(at)
    drawn = at >= 0  # some units are in no sample
    w = weights[:, at[drawn]]
    s, k, t = (np.asarray(x, float)[drawn] for x in (sums, sizes, there))
    some = w @ t > 0
    with np.errstate(invalid="ignore"):
        total = w @ s if np.isfinite(s).all() else np.where(w > 0, w * s, 0).sum(1)
        return float(np.std(total[some] / (w @ k)[some])) if some.any() else None


def histogram_mode(df: DataFrame, value: str, bins: int = 500) -> DataFrame:
    """(bin, low, high, n) of equal bins between the extremes, the fullest first."""
    lo, hi = df.agg(F.min(value), F.max(value)).first()
    width = (hi - lo) / bins or 1.0
    at = F.least(F.floor((F.col(value) - F.lit(float(lo))) / F.lit(float(width))), F.lit(bins - 1))
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n")).select("bin", (F.lit(lo) + F.col("bin") * width).alias("low"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("high"), "n").orderBy(F.desc("n"), "bin")


def online_variance(df: DataFrame, keys: list[str], value: str, ddof: int = 1) -> DataFrame:
    """Mean and variance by mergeable moments, in one pass."""
    n = F.count(value)
    return df.groupBy(*keys).agg(n.alias("n"), F.avg(value).alias("mean"), F.when(n > ddof, F.var_pop(value) * n / (n - ddof)).alias("variance"))
