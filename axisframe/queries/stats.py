"""Queries of statistics, clusters and decompositions."""

from pyspark.sql import functions as F

from ..operators import clusters, decomposition, mixed, statistics
from ..plans.cube import Cube
from .registry import query, rows

_P = "SELECT vec_id, (vec_id * 7919 % 1009 + 1) / 1010.0 * (CASE WHEN vec_id % 5 = 0 THEN 0.001 ELSE 1 END) AS p FROM embeddings"


def _pvalues(v):
    i = F.col("vec_id")
    return v.table("embeddings").select("vec_id", ((i * 7919 % 1009 + 1) / 1010.0 * F.when(i % 5 == 0, 0.001).otherwise(1.0)).alias("p"))


def _fdr_sql(factor: str) -> str:
    return f"""WITH p AS ({_P}), m AS (SELECT count(*) AS n FROM p), h AS (SELECT {factor} AS f FROM m),
        r AS (SELECT vec_id, p, row_number() OVER (ORDER BY p, vec_id) AS rk FROM p),
        q AS (SELECT vec_id, p, least(1, min(p * n * f / rk) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS c,
                     bool_or(p < rk * 0.05 / (n * f)) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS reject FROM r, m, h)
        SELECT vec_id, round(c, 8) + 0.0 AS p_corrected, reject FROM q"""


@query(_fdr_sql("1.0"))
def fdr_bh(v):
    return rows(statistics.fdr(_pvalues(v)).select("vec_id", "p_corrected", "reject"), 8)


@query(_fdr_sql("(SELECT sum(1.0 / i) FROM range(1, n + 1) t(i))"))
def fdr_by(v):
    return rows(statistics.fdr(_pvalues(v), method="negcorr").select("vec_id", "p_corrected", "reject"), 8)


@query(f"""WITH p AS ({_P}), r AS (SELECT vec_id, p, row_number() OVER (ORDER BY p, vec_id) AS rk, count(*) OVER () AS n FROM p)
           SELECT vec_id, round(least(1, max(p * (n - rk + 1)) OVER (ORDER BY rk)), 8) + 0.0 AS p_corrected FROM r""")
def holm(v):
    return rows(statistics.holm(_pvalues(v)).select("vec_id", "p_corrected"), 8)


@query("""WITH s AS (SELECT ch, smp, abs(value - 100) AS x FROM sig WHERE ch < 2), r AS (SELECT ch, smp, sum(CASE WHEN ch = 1 THEN 1 ELSE 0 END) OVER (ORDER BY x DESC RANGE UNBOUNDED PRECEDING) AS n FROM s)
          SELECT smp, round((n + 1) / ((SELECT count(*) FROM s WHERE ch = 1) + 1), 9) + 0.0 AS p FROM r WHERE ch = 0""")
def pval_histogram(v):
    """Every sample of a channel against the distribution of another."""
    s = v.sig.df.withColumn("value", F.col("value") - 100)
    got = clusters.pval_from_histogram(s.where("ch = 0").select("smp", "value"), s.where("ch = 1").select("value"))
    return rows(got.select("smp", "p"), 9)


_RUNS = """WITH i AS (SELECT ch, smp, value, smp - row_number() OVER (PARTITION BY ch ORDER BY smp) AS g FROM sig WHERE value >= 60)
           SELECT ch, min(smp) AS first, max(smp) AS last, count(*) AS size, round(sum(value), 4) + 0.0 AS sum FROM i GROUP BY ch, g"""


@query(_RUNS)
def clusters_1d(v):
    return rows(Cube(v.sig.df, ("ch", "smp")).runs("smp", 60.0, 1).select("ch", "first", "last", "size", "sum"), 4)


@query("SELECT i AS a, i + 1 AS b FROM range(49) t(i)")
def neighbors_1d(v):
    return rows(clusters.neighbors_1d(v.spark, 50))


@query("""SELECT (o * 4 + a) * 3 + i AS a, (o * 4 + a + 1) * 3 + i AS b FROM range(5) x(o), range(3) y(a), range(3) z(i)
          UNION ALL SELECT o * 3 + i, o * 3 + i + 1 FROM range(20) x(o), range(2) z(i)
          UNION ALL SELECT a * 12 + i, (a + 1) * 12 + i FROM range(4) x(a), range(12) z(i)""")
def connectivity(v):
    parts = [(clusters.neighbors_1d(v.spark, n), n) for n in (5, 4, 3)]
    return rows(clusters.grid_edges(parts))


@query("""WITH RECURSIVE g AS (SELECT c * 100 + b * 5 + a AS cell, a, b, c, value FROM cube WHERE value >= 40),
          e AS (SELECT x.cell AS p, y.cell AS q FROM g x JOIN g y ON x.c = y.c AND abs(x.a - y.a) + abs(x.b - y.b) = 1),
          r AS (SELECT cell, cell AS root FROM g UNION SELECT e.q, r.root FROM r JOIN e ON e.p = r.cell),
          m AS (SELECT cell, min(root) AS cluster FROM r GROUP BY cell)
          SELECT cluster, count(*) AS size, round(sum(value), 4) + 0.0 AS sum FROM m JOIN g USING (cell) GROUP BY cluster""")
def cluster_sums(v):
    """Every map of the cube: c is a third axis without edges."""
    cells = v.cube.df.select((F.col("c") * 100 + F.col("b") * 5 + F.col("a")).alias("cell"), "value")
    maps = v.cube.df.agg(F.max("c")).first()[0] + 1
    edges = clusters.grid_edges([(clusters.neighbors_1d(v.spark, 1), maps), (clusters.neighbors_1d(v.spark, 20), 20), (clusters.neighbors_1d(v.spark, 5), 5)])
    return rows(clusters.find_clusters(cells, edges, 40.0, 1)[1], 4)


@query("""WITH s AS (SELECT ch, smp, value / 100 AS x FROM sig), t AS (SELECT k, 0.25 + k * 0.25 AS h FROM range(60) r(k)),
          i AS (SELECT ch, smp, k, h, smp - row_number() OVER (PARTITION BY ch, k ORDER BY smp) AS g FROM s JOIN t ON x >= h),
          w AS (SELECT ch, smp, h, count(*) OVER (PARTITION BY ch, k, g) AS n FROM i)
          SELECT s.ch, s.smp, round(coalesce(sum(pow(n, 2e0 / 3e0) * h * h * 0.25), 0), 4) + 0.0 AS value FROM s LEFT JOIN w ON s.ch = w.ch AND s.smp = w.smp GROUP BY s.ch, s.smp""")
def tfce_1d(v):
    """Every sample of every channel."""
    c = Cube(v.sig.df, ("ch", "smp")).map(lambda x: x / 100)
    return rows(c.tfce_runs("smp", dt=0.25, tail=1, lo=0.25), 4)


_ORDER = "CASE WHEN k = 0 THEN i ELSE (i * 2654435761 + k * 40503 * (i % 97 + 1)) % 4294967296 END"


@query(f"""WITH d AS (SELECT smp AS i, smp % 2 = 0 AS x, value FROM sig WHERE ch = 0), k AS (SELECT k FROM range(51) r(k)),
           place AS (SELECT k, i, x, row_number() OVER (PARTITION BY k ORDER BY i) AS r FROM d, k),
           deal AS (SELECT k, value, row_number() OVER (PARTITION BY k ORDER BY {_ORDER}, i) AS r FROM d, k)
           SELECT k AS perm, round(avg(value) FILTER (WHERE x) - avg(value) FILTER (WHERE NOT x), 6) + 0.0 AS diff FROM place JOIN deal USING (k, r) GROUP BY k""")
def perm_means(v):
    """Every sample of the channel."""
    d = v.sig.df.where("ch = 0").select(F.col("smp").alias("i"), (F.col("smp") % 2 == 0).alias("x"), "value")
    perms = statistics.permutations(d, "i", None, 50)
    dealt = perms.join(d.select("i", "x"), "i").join(d.select(F.col("i").alias("source"), "value"), "source")
    return rows(dealt.groupBy("perm").agg((F.avg(F.when(F.col("x"), F.col("value"))) - F.avg(F.when(~F.col("x"), F.col("value")))).alias("diff")))


@query(f"""WITH d AS (SELECT event_id AS i, user_id AS g FROM events), k AS (SELECT k FROM range(6) r(k)),
           place AS (SELECT k, i, g, row_number() OVER (PARTITION BY k, g ORDER BY i) AS r FROM d, k),
           deal AS (SELECT k, g, i AS source, row_number() OVER (PARTITION BY k, g ORDER BY {_ORDER}, i) AS r FROM d, k)
           SELECT k AS perm, i, source FROM place JOIN deal USING (k, g, r)""")
def perm_groups(v):
    """Every event."""
    d = v.events.select(F.col("event_id").alias("i"), F.col("user_id").alias("g"))
    return rows(statistics.permutations(d, "i", "g", 5))


@query(f"""WITH d AS (SELECT ch, smp AS i, smp % 2 = 0 AS x, value FROM sig), k AS (SELECT k FROM range(31) r(k)),
           place AS (SELECT k, ch, i, x, row_number() OVER (PARTITION BY k, ch ORDER BY i) AS r FROM d, k),
           deal AS (SELECT k, ch, value, row_number() OVER (PARTITION BY k, ch ORDER BY {_ORDER}, i) AS r FROM d, k),
           m AS (SELECT k, ch, avg(value) FILTER (WHERE x) AS mx, var_samp(value) FILTER (WHERE x) AS vx, count(*) FILTER (WHERE x) AS nx, avg(value) FILTER (WHERE NOT x) AS my, var_samp(value) FILTER (WHERE NOT x) AS vy, count(*) FILTER (WHERE NOT x) AS ny FROM place JOIN deal USING (k, ch, r) GROUP BY k, ch)
           SELECT k AS perm, ch, round((mx - my) / sqrt(((nx - 1) * vx + (ny - 1) * vy) / (nx + ny - 2) * (1e0 / nx + 1e0 / ny)), 5) + 0.0 AS t FROM m""")
def permutation_t(v):
    """t of each permutation."""
    return rows(_permuted(v).select("perm", "ch", "t"), 5)


@query()
def permutation_test(v):
    """Its one-sided z, which takes the distribution of t."""
    return rows(_permuted(v).select("perm", "ch", "z"), 5)


def _permuted(v):
    d = v.sig.df.select("ch", F.col("smp").alias("i"), (F.col("smp") % 2 == 0).alias("x"), "value")
    return statistics.permutation_test(d, "i", "value", "x", ["ch"], 30)


@query("""WITH u AS (SELECT DISTINCT a FROM cube), n AS (SELECT count(*) AS n FROM u),
          draws AS (SELECT boot, floor(((boot * 1103515245 + draw * 40503 * (boot % 89 + 1) + 12345) % 2147483648 * 48271 % 2147483647) * n / 2147483647.0::DOUBLE) AS a
                    FROM range(100) b(boot), n, range(5) d(draw)),
          w AS (SELECT boot, a, count(*) AS weight FROM draws GROUP BY boot, a),
          m AS (SELECT boot, b, c, sum(value * weight) / sum(weight) AS m FROM cube JOIN w USING (a) GROUP BY boot, b, c),
          s AS (SELECT b, c, stddev_pop(m) AS sd FROM m GROUP BY b, c), o AS (SELECT b, c, avg(value) AS mean FROM cube GROUP BY b, c)
          SELECT b, c, round(mean / sd, 5) + 0.0 AS ratio FROM o JOIN s USING (b, c)""")
def bootstrap_ratio(v):
    return rows(statistics.stability(v.cube.df.select("a", "b", "c", "value"), "a", ["b", "c"], "value", 100).select("b", "c", "ratio"), 5)


@query("SELECT ch, count(*) AS n, round(avg(value), 6) + 0.0 AS mean, round(var_samp(value), 4) + 0.0 AS variance FROM sig GROUP BY ch")
def online_variance(v):
    got = statistics.online_variance(v.sig.df, ["ch"], "value")
    return got.select(F.col("ch").cast("long"), "n", (F.round("mean", 6) + 0.0).alias("mean"), (F.round("variance", 4) + 0.0).alias("variance"))


@query("""WITH l AS (SELECT min(value) AS lo, (max(value) - min(value)) / 50 AS w FROM events)
          SELECT least(floor((value - lo) / w), 49)::BIGINT AS bin, count(*) AS n FROM events, l GROUP BY 1""")
def histogram(v):
    return rows(statistics.histogram_mode(v.events, "value", 50).select("bin", "n"))


@query("SELECT x.k AS a, y.k AS b, round(covar_samp(x.v, y.v), 8) + 0.0 AS cov FROM emb x JOIN emb y ON x.vec_id = y.vec_id AND x.k <= y.k GROUP BY x.k, y.k")
def cov_matrix(v):
    return rows(decomposition.covariance(v.emb, "k", "vec_id", "v"), 8)


@query("""WITH m AS (SELECT ch, avg(value) AS m FROM sig GROUP BY ch)
          SELECT x.ch AS i, y.ch AS j, lag, round(avg(x.value * y.value) - any_value(mx.m) * any_value(my.m), 3) + 0.0 AS cov FROM range(4) l(lag), sig x JOIN sig y ON y.smp = x.smp + lag
          JOIN m mx ON mx.ch = x.ch JOIN m my ON my.ch = y.ch GROUP BY x.ch, y.ch, lag""")
def lagged_cov(v):
    s = v.sig.df.select(F.col("ch").alias("channel"), F.col("smp").alias("sample"), "value")
    cov = decomposition.lagged_covariance(s, lags=3)
    return rows(v.spark.createDataFrame([(i, j, k, float(cov[k, i, j])) for k in range(4) for i in range(4) for j in range(4)], "i long, j long, lag long, cov double"), 3)


@query()
def ica_sources(v):
    s = v.sig.df.select(F.col("ch").alias("channel"), F.col("smp").alias("sample"), "value")
    *_, comps = decomposition.ica(s, ar_max=4)
    return rows(comps.groupBy("component").agg(F.count("*").alias("n"), F.var_pop("value").alias("variance")), 5)


@query()
def wica_clean(v):
    s = v.sig.df.select(F.col("ch").alias("channel"), F.col("smp").alias("sample"), F.col("value") + F.when((F.col("ch") < 2) & F.col("smp").between(500, 520), 5000.0).otherwise(0.0))
    s = s.toDF("channel", "sample", "value")
    got = decomposition.remove_artifacts(s, 200.0, (0, 1), 0.3, ar_max=4)
    return rows(got.groupBy("channel").agg(F.count("*").alias("n"), F.round(F.stddev_pop("value"), 1).alias("sd")), 1)


def _study(v):
    """Groups of observations with two predictors and a small map of responses, all from the events."""
    i = F.col("event_id")
    e = v.events.select((i % 6).cast("string").alias("group"), F.expr("event_id div 6").alias("obs"), "value")
    pred = e.select("group", "obs", ((F.col("obs") * 37 % 101) / 101.0).alias("x"), F.when(F.col("obs") % 2 == 0, "lo").otherwise("hi").alias("cond"))
    noise = v.events.select(F.expr("event_id * 31 % 997").alias("n"))
    resp = pred.crossJoin(v.spark.range(8).withColumnRenamed("id", "feature")).select("group", "obs", F.col("feature").cast("int").alias("feature"), (F.when(F.col("feature") < 3, F.col("x")).otherwise(0.0) + F.sin(F.col("obs") * 12.9898 + F.col("feature") * 78.233 + F.col("group").cast("int") * 3.7) * 0.5).alias("value"))
    return pred, resp, noise


@query()
def lmer_terms(v):
    pred, resp, _ = _study(v)
    fits = mixed.lmer(resp.join(pred, ["group", "obs"]), ["feature"], "value", "value ~ x + cond + (1 | group)")
    return rows(fits, 3)


@query()
def meld_terms(v):
    pred, resp, _ = _study(v)
    m = mixed.FeatureMixedModel(resp, pred, "val ~ x", "(1 | group)", boots=200)
    return rows(mixed.p_features(m.run(10)), 3)


@query("SELECT n_nationkey::BIGINT AS label, round(corr(x, y), 6) + 0.0 AS corr FROM (SELECT c_nationkey AS n_nationkey, c_acctbal AS x, c_acctbal * 2 + c_custkey % 7 AS y FROM customer) GROUP BY n_nationkey")
def segment_correlation(v):
    c = v.table("customer").select(F.col("c_nationkey").alias("label"), "c_custkey", F.col("c_acctbal").alias("value"))
    other = c.withColumn("value", F.col("value") * 2 + F.col("c_custkey") % 7)
    return rows(decomposition.segment_correlation(c, other.drop("label"), ["c_custkey"], ["label"]))




