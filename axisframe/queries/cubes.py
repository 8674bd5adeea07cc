"""Queries over labelled cubes."""

from pyspark.sql import functions as F

from ..plans.cube import Cube, take
from .registry import query, rows


@query("SELECT a, b, c, round(value, 6) + 0.0 AS value FROM cube WHERE b > 3 AND c < 50 AND a <> 2")
def filter_string(v):
    return rows(v.cube.where("b > 3", "c < 50", "a != 2"))


@query("SELECT a, b, c, value FROM cube WHERE b IN (1, 4, 9) AND a >= 2")
def filter_isin(v):
    c = v.cube
    return rows(c.where(c["b"].is_in([1, 4, 9]) & (c["a"] >= 2)))


@query("SELECT a, b, c, value FROM cube WHERE c > 4 AND (b < 5 OR b > 15) AND a IN (0, 2, 4)")
def filter_or(v):
    c = v.cube
    return rows(c.where((c["c"] > 4) & ((c["b"] < 5) | (c["b"] > 15)) & c["a"].is_in([0, 2, 4])))


@query("SELECT a, b, c, value FROM cube WHERE (b < 5) <> (b < 10)")
def filter_xor(v):
    return rows(v.cube.where("(b < 5) ^ (b < 10)"))


@query("SELECT b, c, value FROM cube WHERE a = 3 AND b < 10")
def filter_drop_dim(v):
    return rows(v.cube["a == 3", "b < 10"])


@query("SELECT a, b, c, value FROM cube WHERE b > 7 AND c % 10 = 4")
def filter_params(v):
    return rows(v.cube.where("b > kwargs['low'] and c % step == rest", low=7, step=10, rest=4))


@query("SELECT a, b, c, value FROM cube WHERE a IN (1, 3)")
def filter_mask(v):
    return rows(v.cube.select(a=[False, True, False, True, False]))


@query("SELECT a AS a_idx, b AS b_idx, c AS c_idx FROM cube WHERE b = 5 AND a > 2")
def find_index(v):
    return rows(v.cube.find("b == 5", "a > 2"))


@query("SELECT DISTINCT b AS b_idx, b FROM cube")
def axis_labels(v):
    return rows(v.cube["b"].labels())


@query("SELECT c, b - 5 AS b_idx, value FROM cube WHERE a = 2 AND b >= 5 AND b < 12")
def index_positions(v):
    got = v.cube[2, 5:12]
    return rows(got.df.select("c", "b_idx", "value"))


@query("SELECT a, b, c, value, 0::BIGINT AS newaxis_0 FROM cube")
def index_newaxis(v):
    return rows(v.cube[None].df.select("a", "b", "c", "value", "newaxis_0"))


@query("SELECT a AS a_idx, b AS b_idx, c AS c_idx FROM cube WHERE value <> 0 AND value > 200")
def nonzero(v):
    return rows(v.cube.map(lambda x: F.when(x > 200, x).otherwise(0.0)).nonzero())


@query("SELECT a, c, t.i::BIGINT AS b_idx, b, value FROM cube JOIN (VALUES (0, 7), (1, 3), (2, 3), (3, 19)) t(i, p) ON b = t.p")
def take_axis(v):
    return rows(take(v.cube, [7, 3, 3, 19], "b").df.select("a", "c", "b_idx", "b", "value"))


@query("SELECT t.i::BIGINT AS a_idx, a, b, c, value FROM cube JOIN (VALUES (0, 0), (1, 2), (2, 3)) t(i, p) ON a = t.p")
def compress_axis(v):
    return rows(v.cube.compress([True, False, True, True], "a").df.select("a_idx", "a", "b", "c", "value"))


@query("SELECT a * 3 + r AS a, b, c, value FROM cube, range(3) t(r)")
def repeat_axis(v):
    return rows(v.cube.repeat(3, "a"))


@query("SELECT s.first + r AS a, b, c, value FROM cube JOIN (VALUES (0, 0, 1), (2, 1, 3), (4, 4, 2)) s(p, first, n) ON a = s.p, range(3) t(r) WHERE r < n")
def repeat_each(v):
    return rows(v.cube.repeat([1, 0, 3, 0, 2], "a"))


@query("SELECT a, b, c, CASE WHEN b > 10 THEN -1.0 ELSE value END AS value FROM cube")
def update_where(v):
    return rows(v.cube.update("b > 10", -1.0))


@query("SELECT a, 1000 + 50 * b AS b, c, value FROM cube")
def relabel_axis(v):
    c = v.cube
    return rows(c.relabel("b", c.axis_table("b").withColumn("b", 1000 + 50 * F.col("b"))))


@query("SELECT a, b, c, round(22 * value - 3, 6) + 0.0 AS value FROM cube")
def arith_scalar(v):
    return rows(22 * v.cube - 3)


@query("SELECT a, b, c, round(sqrt(value), 6) + 0.0 AS value FROM cube")
def arith_ufunc(v):
    return rows(v.cube.map(F.sqrt))


@query("SELECT x.a, x.b, x.c, round(x.value - y.value, 6) + 0.0 AS value FROM cube x JOIN cube y ON x.a = y.a AND x.c = y.c AND y.b = 19 - x.b")
def arith_cubes(v):
    c = v.cube
    flipped = take(c, range(19, -1, -1), "b")
    return rows(c - flipped)


def _reduction(name: str, sql: str, digits: int = 6, cube: str = "cube", **kw):
    def f(v):
        return rows(getattr(getattr(v, cube), name)("b", **kw), digits)

    f.__name__ = f"reduce_{name}" + ("_ddof1" if kw.get("ddof") else "")
    kind = "" if name in ("all", "any") else "::BIGINT" if name.startswith("arg") else None
    value = f"round({sql}, {digits}) + 0.0" if kind is None else f"({sql}){kind}"
    query(f"SELECT a, c, {value} AS value FROM {cube} GROUP BY a, c")(f)


_reduction("sum", "sum(value)", 4)
_reduction("mean", "avg(value)")
_reduction("min", "min(value)")
_reduction("max", "max(value)")
_reduction("ptp", "max(value) - min(value)")
_reduction("var", "var_pop(value)", 8)
_reduction("var", "var_samp(value)", 4, ddof=1)
_reduction("std", "stddev_pop(value)", 5)
_reduction("std", "stddev_samp(value)", 5, ddof=1)
_reduction("all", "bool_and(value <> 0)")
_reduction("any", "bool_or(value <> 0)")
_reduction("argmax", "arg_min(b, (-value, b))")
_reduction("argmin", "arg_min(b, (value, b))")
_reduction("nanmean", "coalesce(avg(value) FILTER (WHERE NOT isnan(value)), 'NaN'::DOUBLE)", cube="holes")
_reduction("nanvar", "coalesce(var_pop(value) FILTER (WHERE NOT isnan(value)), 'NaN'::DOUBLE)", 5, cube="holes")
_reduction("nanstd", "coalesce(stddev_pop(value) FILTER (WHERE NOT isnan(value)), 'NaN'::DOUBLE)", 5, cube="holes")
_reduction("median", "median(value)")


@query("SELECT a, c, round(product(value / 1013 + 0.95), 9) + 0.0 AS value FROM cube GROUP BY a, c")
def reduce_prod(v):
    """Every position of b; values are brought near 1, so that products neither vanish nor outgrow the rounding."""
    return rows(v.cube.map(lambda x: x / 1013 + 0.95).prod("b"), 9)


@query("SELECT a, c, CASE WHEN bool_or(isnan(value)) THEN 'NaN'::DOUBLE ELSE round(min(value), 6) + 0.0 END AS value FROM holes GROUP BY a, c")
def reduce_min_nan(v):
    return rows(v.holes.min("b"))


@query("SELECT a, c, (CASE WHEN bool_or(isnan(value)) THEN min(CASE WHEN isnan(value) THEN b END) ELSE arg_min(b, (-value, b)) END)::BIGINT AS value FROM holes GROUP BY a, c")
def reduce_argmax_nan(v):
    return rows(v.holes.argmax("b"))


@query("SELECT round(avg(value), 6) + 0.0 AS value FROM cube")
def reduce_whole(v):
    return rows(v.cube.mean())


@query("SELECT a, b, c, round(sum(value) OVER (PARTITION BY a, c ORDER BY b), 4) + 0.0 AS value FROM cube")
def cumsum(v):
    return rows(v.cube.cumsum("b"), 4)


@query("SELECT ch, smp, round(sum(value) OVER (PARTITION BY ch ORDER BY smp), 3) + 0.0 AS value FROM sig")
def cumsum_chunked(v):
    return rows(Cube(v.sig.df, ("ch", "smp")).cumsum("smp", chunk=512), 3)


@query("SELECT a, b, c, round(product(value / 1013 + 0.95) OVER (PARTITION BY a, c ORDER BY b), 9) + 0.0 AS value FROM cube")
def cumprod(v):
    return rows(v.cube.map(lambda x: x / 1013 + 0.95).cumprod("b"), 9)


@query("SELECT a, row_number() OVER (PARTITION BY a, c ORDER BY value, b) - 1 AS b, c, b AS value FROM cube")
def argsort(v):
    return rows(v.cube.argsort("b"))


@query("SELECT a, row_number() OVER (PARTITION BY a, c ORDER BY value) - 1 AS b, c, value FROM cube")
def sort_axis(v):
    return rows(v.cube.sort_axis("b"))


@query("SELECT a, b, c, row_number() OVER (PARTITION BY a, c ORDER BY value, b) - 1 AS b_idx, value FROM cube")
def sort_with_labels(v):
    return rows(v.cube.sort_with_labels("b").df.select("a", "b", "c", "b_idx", "value"))


@query("""SELECT a, b, c, rank() OVER (PARTITION BY a, c ORDER BY floor(value / 25)) + (count(*) OVER (PARTITION BY a, c, floor(value / 25)) - 1) / 2.0 AS value FROM cube""")
def rankdata(v):
    return rows(v.cube.map(lambda x: F.floor(x / 25)).rankdata("b"))


@query("SELECT ch, smp, CASE WHEN sign(value - 100) <> lag(sign(value - 100)) OVER (PARTITION BY ch ORDER BY smp) THEN 1 ELSE 0 END::BIGINT AS value FROM sig")
def zero_crossings(v):
    return rows(Cube(v.sig.df, ("ch", "smp")).map(lambda x: x - 100).zero_crossings("smp"))


@query("""WITH q AS (SELECT ch, smp, value, lag(value) OVER w AS before, lead(value) OVER w AS after FROM sig WINDOW w AS (PARTITION BY ch ORDER BY smp))
          SELECT ch, smp, value FROM q WHERE value > before AND value > after
          UNION ALL
          SELECT ch, smp, value FROM (SELECT *, lead(value, 2) OVER (PARTITION BY ch ORDER BY smp) AS later FROM q) WHERE value > before AND value = after AND value > later""")
def local_maxima(v):
    return rows(Cube(v.sig.df, ("ch", "smp")).local_maxima("smp"))


@query("SELECT DISTINCT ch, smp + r AS smp_idx FROM sig, range(-3, 3) t(r) WHERE value > 200 AND smp + r >= 0 AND smp + r < (SELECT count(*) // 4 FROM events)")
def dilate(v):
    c = Cube(v.sig.df, ("ch", "smp")).map(lambda x: F.when(x > 200, x).otherwise(0.0))
    return rows(c.dilate(3, "smp").select("ch", "smp_idx"))


@query("SELECT a, (b // 5 * 5 + 2)::DOUBLE AS b, c, round(avg(value), 6) + 0.0 AS value FROM cube GROUP BY a, b // 5, c")
def bins_equal(v):
    got = v.cube.make_bins("b", 4)
    return rows(got.df.select(F.col("a"), F.col("b").cast("double"), "c", "value"))


@query("""WITH bins AS (SELECT a, c, value, CASE WHEN b < 14 THEN b // 7 ELSE 2 + (b - 14) // 6 END AS bin FROM cube)
          SELECT a, bin AS b, c, round(sum(value), 4) + 0.0 AS value FROM bins GROUP BY a, bin, c""")
def bins_uneven(v):
    return rows(v.cube.make_bins("b", 3, "sum", labels="sequential", exact=False), 4)


@query("SELECT a, i::BIGINT AS b, c, round(max(value), 6) + 0.0 AS value FROM cube JOIN (VALUES (0, 0, 8), (1, 5, 12), (2, 15, 100)) t(i, lo, hi) ON b >= lo AND b < hi GROUP BY a, i, c")
def bins_interval(v):
    return rows(v.cube.make_bins("b", [[0, 8], [5, 12], [15, 100]], "max", labels="sequential"))


@query("SELECT a, label, c, round(stddev_pop(value), 5) + 0.0 AS value FROM cube JOIN (VALUES ('low', 0, 6), ('mid', 6, 14), ('top', 14, 20)) t(label, lo, hi) ON b >= lo AND b < hi GROUP BY a, label, c")
def bins_labelled(v):
    got = v.cube.make_bins("b", [[0, 6, "low"], [6, 14, "mid"], [14, 20, "top"]], "std")
    return rows(got.df.select("a", F.col("b").alias("label"), "c", "value"), 5)


@query("SELECT a, b, c, value FROM cube UNION ALL SELECT a, b, c + (SELECT max(c) + 1 FROM cube), value * 2 FROM cube")
def extend_axis(v):
    c = v.cube
    other = c.map(lambda x: x * 2)
    got = c.extend(other, "c")
    return rows(got.df.select("a", "b", F.col("c_idx").alias("c"), "value"))


@query("SELECT r AS rep, a, b, c, value FROM cube, range(3) t(r)")
def add_dim(v):
    return rows(v.cube.add_dim("rep", [0, 1, 2]))


@query("SELECT c, a, b, value FROM cube")
def transpose(v):
    return rows(v.cube.transpose("c", "a", "b"))


@query("SELECT b, c, value FROM cube WHERE a = 1")
def squeeze(v):
    return rows(v.cube.where("a == 1").squeeze())


@query("SELECT (a * 20 + b) * (SELECT max(c) + 1 FROM cube) + c AS cell, value FROM cube")
def ravel(v):
    return rows(v.cube.ravel())


@query("""WITH o AS (SELECT (a * 20 + b) * (SELECT max(c) + 1 FROM cube) + c AS n, value FROM cube), k AS (SELECT count(*) // 50 AS w FROM o)
          SELECT n // w AS dim1, n % w AS dim2, value FROM o, k""")
def reshape(v):
    return rows(v.cube.reshape([50, -1]))


@query("SELECT c, a AS diagonal, value FROM cube WHERE a = b")
def diagonal(v):
    return rows(v.cube.diagonal("a", "b"))


@query("SELECT c, round(sum(value), 4) + 0.0 AS value FROM cube WHERE a = b GROUP BY c")
def trace(v):
    return rows(v.cube.trace("a", "b"), 4)


@query("SELECT user_id, seq, round(sum(value) OVER (PARTITION BY user_id ORDER BY seq), 3) + 0.0 AS value FROM evt")
def ragged_cumsum(v):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    evt = v.events.withColumn("seq", F.row_number().over(w) - 1)
    return rows(Cube.from_positions(evt, ("user_id", "seq")).cumsum("seq"), 3)
