"""Statistics, clusters and decompositions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from axisframe.functions import algebra, dist
from axisframe.functions.mixed import design, mixed_model, parse_formula
from axisframe.operators import clusters, decomposition, mixed, statistics
from axisframe.operators.graph import components
from axisframe.plans.cube import Cube


def test_students_t():
    t = np.array([-2.0, 0.0, 0.5, 3.0])
    np.testing.assert_allclose(dist.t_sf2(t, 1), 1 - 2 * np.arctan(np.abs(t)) / np.pi, atol=1e-12)
    np.testing.assert_allclose(dist.t_sf2(t, 2), 1 - np.abs(t) / np.sqrt(2 + t**2), atol=1e-12)
    np.testing.assert_allclose(dist.normal_ppf(dist.normal_cdf(t)), t, atol=1e-9)


def test_fdr(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.8, 0.03]
    got = statistics.fdr(spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double")).orderBy("i").toPandas()
    order = np.argsort(p, kind="stable")
    raw = np.array(p)[order] * 6 / np.arange(1, 7)
    want = np.minimum(1, np.minimum.accumulate(raw[::-1])[::-1])
    np.testing.assert_allclose(got["p_corrected"].to_numpy()[order], want)
    assert got["reject"].tolist() == [True, True, True, True, False, True]
    with pytest.raises(ValueError):
        statistics.fdr(spark.range(1).withColumn("p", F.lit(0.1)), method="other")


def test_permutations(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "i int, g string")
    got = statistics.permutations(df, "i", "g", 4).toPandas()
    for k, part in got.groupby("perm"):
        assert sorted(part["source"]) == list(range(20)) and (part["i"] % 2 == part["source"] % 2).all()
        assert (part["i"] == part["source"]).all() == (k == 0)


def test_permutation_test(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, i < 20, float(rng.normal() + 2 * (i < 20))) for i in range(40)], "i int, x boolean, value double")
    z = statistics.permutation_test(df, "i", "value", "x", iterations=20).orderBy("perm").toPandas()["z"]
    assert len(z) == 21 and z[0] > 3 and z[1:].abs().max() < 3.5
    for kw in ({"paired": True}, {"parametric": False}):
        with pytest.raises(NotImplementedError):
            statistics.permutation_test(df, "i", "value", "x", **kw)


def test_stability(spark):
    rng = np.random.default_rng(1)
    rows = [(u, f, float(rng.normal() + (3 if f == 0 else 0))) for u in range(12) for f in range(2)]
    got = statistics.stability(spark.createDataFrame(rows, "u int, f int, value double"), "u", ["f"], "value", 200).orderBy("f").toPandas()
    assert got["p"][0] < 1e-4 < got["p"][1]


def test_histogram_p_values(spark):
    null = spark.createDataFrame([(float(x),) for x in [1, 2, 2, 3, -4]], "value double")
    stats = spark.createDataFrame([(0, 2.0), (1, -3.5), (2, 9.0)], "i int, value double")
    for tail, want in {0: [5 / 6, 2 / 6, 1 / 6], 1: [4 / 6, 6 / 6 - 1 / 6, 1 / 6], -1: [5 / 6, 2 / 6, 6 / 6]}.items():
        got = clusters.pval_from_histogram(stats, null, tail).orderBy("i").toPandas()["p"]
        np.testing.assert_allclose(got, want)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60) if i % 20 != 19], "a long, b long")
    got = dict(components(edges).collect())
    assert got == {i: i // 20 * 20 for i in range(60)}
    assert components(edges.limit(0)).count() == 0


def test_grid(spark):
    e = {tuple(r) for r in clusters.grid_edges([(clusters.neighbors_1d(spark, 2), 2), (clusters.neighbors_1d(spark, 3), 3)]).collect()}
    assert e == {(0, 1), (1, 2), (3, 4), (4, 5), (0, 3), (1, 4), (2, 5)}


def test_delaunay():
    square = np.array([[0, 0], [1, 0], [1, 1], [0, 1], [0.5, 0.45]])
    assert clusters.delaunay(square) == [(0, 1), (0, 3), (0, 4), (1, 2), (1, 4), (2, 3), (2, 4), (3, 4)]


def test_sensor_file(spark, tmp_path):
    (tmp_path / "locs").write_text("0 90 180 270 45\n1 1 1 1 0.1\n")
    assert clusters.sensor_neighbors(spark, str(tmp_path / "locs")).count() == 8


def brute_tfce(x, dt, e, h):
    out = np.zeros(x.shape)
    for k in range(200):
        t = x[x > 0].min() + k * dt
        inside = x >= t
        if not inside.any():
            break
        label = clusters.Islands(x.shape).labels(inside.ravel()).reshape(x.shape)
        for c in np.unique(label[inside]):
            m = (label == c) & inside
            out[m] += m.sum() ** e * t**h * dt
    return out


def test_tfce(spark):
    x = np.abs(np.random.default_rng(2).normal(size=(3, 12)))
    got = Cube.from_array(spark, x).tfce_runs("dim2", dt=0.2, tail=1, lo=float(x.min())).to_array()
    np.testing.assert_allclose(got, np.stack([brute_tfce(np.where(r < x.min(), 0, r)[None], 0.2, 2 / 3, 2)[0] if r.min() == x.min() else _from(r, x.min()) for r in x]), atol=1e-9)
    maps = clusters.tfce(Cube.from_array(spark, x[None]), ["dim2", "dim3"], (3, 12), dt=0.2, tail=1).to_array()[0]
    np.testing.assert_allclose(maps, brute_tfce(x, 0.2, 2 / 3, 2), atol=1e-9)
    both = clusters.tfce_both(x.ravel() - 0.7, clusters.Islands(x.shape), dt=0.1)
    assert (np.sign(both) == np.sign(x.ravel() - 0.7)).all()


def _from(r, lo, dt=0.2):
    out = np.zeros(len(r))
    for k in range(200):
        t = lo + k * dt
        inside = r >= t
        if not inside.any():
            break
        label = clusters.Islands((len(r),)).labels(inside)
        n = np.bincount(label[inside], minlength=len(r))
        out[inside] += n[label[inside]] ** (2 / 3) * t**2 * dt
    return out


def test_runs(spark):
    got = Cube.from_array(spark, np.array([[0.0, 5, 6, 0, 7, -8]])).runs("dim2", 5, 0).orderBy("first").toPandas()
    assert got[["first", "last", "size"]].to_numpy().tolist() == [[1, 2, 2], [4, 5, 2]] and got["sum"].tolist() == [11, -1]


# -- decompositions


@pytest.fixture(scope="module")
def mixed_sources(spark):
    rng = np.random.default_rng(0)
    n = 6000
    s = np.stack([np.convolve(rng.normal(size=n), h, "same") for h in ([1.0], [1, 0.8, 0.3], np.ones(9))])
    s /= s.std(1, keepdims=True)
    a = rng.normal(size=(3, 3))
    from axisframe.sources.base import from_array

    return s, a, a @ s, from_array(spark, a @ s)


def test_covariance(spark, mixed_sources):
    _, _, x, signal = mixed_sources
    got = decomposition.lagged_covariance(signal, lags=4)
    for k in range(5):
        n = x.shape[1] - k
        want = x[:, :n] @ x[:, k:].T / n - np.outer(x.mean(1), x.mean(1))
        np.testing.assert_allclose(got[k], want, atol=1e-9)
    pair = decomposition.covariance(signal, "channel", "sample").where("a = 0 AND b = 2").first()["cov"]
    assert pair == pytest.approx(np.cov(x)[0, 2])
    chunked = decomposition.gram(decomposition.chunks(signal, "channel", "sample", "value", size=700, halo=4), "values", 3, 4)
    np.testing.assert_allclose(chunked, got, atol=1e-9)


def test_pca(mixed_sources):
    _, _, x, signal = mixed_sources
    w, comps = decomposition.pca(signal, ncomps=2)
    assert w.shape == (2, 3)
    np.testing.assert_allclose(w @ np.cov(x, ddof=0) @ w.T, np.eye(2), atol=1e-8)
    assert comps.count() == 2 * x.shape[1]
    assert algebra.whitening(np.diag([1.0, 1e-9]), eigratio=1e6).shape == (1, 2)


def test_ica(mixed_sources):
    _, a, _, signal = mixed_sources
    w, first, isr, sources = decomposition.ica(signal, ar_max=6)
    for m in (w, first):
        g = np.abs(m @ a)
        g /= g.max(1, keepdims=True)
        assert np.sort(g, 1)[:, -2].max() < 0.12 and sorted(g.argmax(1)) == [0, 1, 2]
    assert isr.shape == (3, 3) and sources.count() == 3 * 6000


def test_artifacts(spark):
    rng = np.random.default_rng(3)
    n = 1500
    blink = np.where(np.abs(np.arange(n) - 700) < 15, 60.0, 0.0)
    x = np.stack([np.convolve(rng.normal(size=n), h, "same") for h in ([1.0], [1, 0.9], np.ones(5))])
    from axisframe.sources.base import from_array

    signal = from_array(spark, x + np.outer([1, 0.9, 0.05], blink))
    cleaner = decomposition.ArtifactCleaner(signal, 200.0, ar_max=5)
    back = cleaner.corrected().groupBy("channel").agg(F.count("*").alias("n")).collect()
    assert all(r["n"] == n for r in back)
    assert cleaner.pick([0, 1], 0.5)
    cleaner.clean()
    got = cleaner.corrected().where("channel = 0 AND sample BETWEEN 690 AND 710").agg(F.max(F.abs("value"))).first()[0]
    assert got < 30
    near = decomposition.blinks(signal, "channel", 10).where("channel = 0").agg(F.min("sample"), F.max("sample")).first()
    assert near[0] <= 690 and near[1] >= 700
    t = algebra.procrustes(x.T, x.T @ np.array([[0, 1, 0], [1, 0, 0], [0, 0, 1.0]]))
    np.testing.assert_allclose(t, [[0, 1, 0], [1, 0, 0], [0, 0, 1]], atol=1e-9)


# -- mixed models


def test_formula():
    assert parse_formula("y ~ a*b + c + (1 + a | g)") == ("y", [("a",), ("b",), ("c",), ("a", "b")], True, [(["a"], True, "g")])
    x, names = design(pd.DataFrame({"a": [1.0, 2.0, 3.0], "f": ["u", "v", "u"]}), [("a",), ("f",), ("a", "f")])
    assert names == ["(Intercept)", "a", "fv", "a:fv"]
    np.testing.assert_array_equal(x, [[1, 1, 0, 0], [1, 2, 1, 2], [1, 3, 0, 0]])
    with pytest.raises(ValueError):
        parse_formula("y ~ log(a)")


def test_mixed_model_equals_anova():
    """Balanced one-way layout: REML variance components are those of the analysis of variance."""
    rng = np.random.default_rng(0)
    k, n = 8, 10
    g = np.repeat(np.arange(k), n)
    y = rng.normal(size=k)[g] * 2 + rng.normal(size=k * n)
    model, names = mixed_model(pd.DataFrame({"y": y, "g": g}), "y ~ 1 + (1 | g)")
    fit = model.fit(y)
    means = y.reshape(k, n).mean(1)
    within = ((y.reshape(k, n) - means[:, None]) ** 2).sum() / (k * (n - 1))
    between = n * means.var(ddof=1)
    assert names == ["(Intercept)"]
    assert fit["sigma"] ** 2 == pytest.approx(within, rel=1e-4)
    assert fit["random_sd"][0] ** 2 == pytest.approx((between - within) / n, rel=1e-3)
    assert fit["se"][0] == pytest.approx(np.sqrt(between / (k * n)), rel=1e-4)


def test_mixed_model_recovers_slopes(spark):
    rng = np.random.default_rng(1)
    g = np.repeat(np.arange(20), 15)
    x = rng.normal(size=300)
    y = 1 + 2 * x + rng.normal(size=20)[g] + rng.normal(size=20)[g] * 0.5 * x + rng.normal(size=300) * 0.3
    df = pd.DataFrame({"k": "all", "g": g, "x": x, "value": y})
    got = mixed.lmer(spark.createDataFrame(df), ["k"], "value", "value ~ x + (1 + x | g)").toPandas().set_index("term")
    assert abs(got["beta"]["x"] - 2) < 0.4 and got["t"]["x"] > 8


def test_feature_model(spark):
    rng = np.random.default_rng(2)
    rows, preds = [], []
    for g in "abcdef":
        x = rng.normal(size=20)
        for o in range(20):
            preds.append((g, o, float(x[o])))
            rows += [(g, o, f, float(rng.normal() * 0.5 + (x[o] if f < 2 else 0))) for f in range(6)]
    m = mixed.FeatureMixedModel(spark.createDataFrame(rows, "group string, obs int, feature int, value double"), spark.createDataFrame(preds, "group string, obs int, x double"), "v ~ x", "(1 | group)", boots=100)
    runs = m.run(8).cache()
    assert runs.select("perm").distinct().count() == 9
    p = mixed.p_features(runs).orderBy("feature").toPandas()["p"].to_numpy()
    assert (p[:2] <= 1 / 9 + 1e-9).all() and (p[2:] > 0.1).all()
    assert set(mixed.p_features(runs, ["(Intercept)", "x"], conjunction=True).toPandas()["term"]) == {"(Intercept)&x"}
    enhanced = mixed.FeatureMixedModel(m.responses, m.predictors, "v ~ x", "(1 | group)", boots=50, use_ranks=True, shape=(2, 3), tfce={"dt": 0.2})
    t = enhanced.run(2).where("perm = 0 AND kind = 'feature' AND term = 'x'").orderBy("feature").toPandas()["t"].to_numpy()
    assert len(t) == 6 and np.abs(t[:2]).min() > np.abs(t[3:]).max()
    # features in blocks give what one block gives
    apart = mixed.FeatureMixedModel(m.responses, m.predictors, "v ~ x", "(1 | group)", boots=100, block=2).run(3)
    keys = ["perm", "kind", "term", "feature"]
    a, b = (df.where("perm <= 3").toPandas().sort_values(keys).reset_index(drop=True) for df in (runs, apart))
    assert a[keys].equals(b[keys])
    np.testing.assert_allclose(a["t"], b["t"], atol=1e-6)
    samples = m.run_boots(30).cache()
    ratio = mixed.boot_ratio(samples).orderBy("feature").toPandas()
    first = samples.where("kind = 'feature' AND term = 'x'").toPandas().pivot(index="perm", columns="feature", values="t")
    np.testing.assert_allclose(ratio["ratio"], (first.loc[0] / first.std(ddof=0)).where(first.std(ddof=0) > 0))
    q = mixed.fdr_boot(samples).orderBy("feature").toPandas()
    assert len(q) == 6 and q["reject"][:2].all()
