"""Queries over whole tables, on one that is longer than any prefix: nothing past it drops out."""

import numpy as np
import pytest

from axisframe.queries import QUERIES

LONG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{LONG}/events.parquet").toPandas().sort_values("event_id").reset_index(drop=True)


@pytest.fixture(scope="module")
def sig(events):
    n = len(events) // 4
    return events["value"].to_numpy()[: 4 * n].reshape(n, 4)


def got(spark, name):
    return QUERIES[name](spark, LONG).toPandas()


def test_pval_histogram(spark, sig):
    g = got(spark, "pval_histogram").sort_values("smp")
    null = np.sort(np.abs(sig[:, 1] - 100))
    want = (len(null) - np.searchsorted(null, np.abs(sig[:, 0] - 100), "left") + 1) / (len(null) + 1)
    assert g["smp"].tolist() == list(range(len(sig)))
    np.testing.assert_allclose(g["p"], want, atol=1e-8)


def test_tfce_1d(spark, sig):
    g = got(spark, "tfce_1d").sort_values(["smp", "ch"])
    assert len(g) == sig.size
    x, want = sig / 100, np.zeros(sig.shape)
    for k in range(int(x.max() / 0.25) + 1):
        t = 0.25 + k * 0.25
        for ch in range(4):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], x[:, ch] >= t, [0]])))
            for a, b in zip(edge[::2], edge[1::2]):
                want[a:b, ch] += (b - a) ** (2 / 3) * t * t * 0.25
    np.testing.assert_allclose(g["value"], want.ravel(), atol=2e-4)


def deal(i, k):
    """Rows in the order of permutation k."""
    return i if k == 0 else i[np.lexsort((i, (i * 2654435761 + k * 40503 * (i % 97 + 1)) % 4294967296))]


def test_perm_means(spark, sig):
    g = got(spark, "perm_means").set_index("perm")["diff"]
    i = np.arange(len(sig))
    assert sorted(g.index) == list(range(51))
    for k in range(51):
        v = sig[deal(i, k), 0]
        assert g[k] == pytest.approx(v[::2].mean() - v[1::2].mean(), abs=2e-6)


def test_perm_groups(spark, events):
    g = got(spark, "perm_groups")
    want = {(k, a, b) for _, e in events.groupby("user_id") for k in range(6) for a, b in zip(e["event_id"], deal(e["event_id"].to_numpy(), k))}
    assert len(g) == 6 * len(events) and set(g[["perm", "i", "source"]].itertuples(index=False, name=None)) == want


def test_tfce_2d_sees_every_map(spark, events):
    g = got(spark, "tfce_2d")
    assert len(g) == len(events)  # every cell


def test_permutation_test_sees_every_sample(spark, sig):
    from axisframe.functions.dist import ttest_z_one_sided

    g = got(spark, "permutation_test")
    x, y = sig[::2], sig[1::2]
    want = [float(ttest_z_one_sided(*(np.array([f]) for f in (a.mean(), a.var(ddof=1), len(a), b.mean(), b.var(ddof=1), len(b))))[0]) for a, b in zip(x.T, y.T)]
    np.testing.assert_allclose(g[g["perm"] == 0].sort_values("ch")["z"], want, atol=2e-5)
    assert len(g) == 31 * 4


def test_wica_clean_sees_every_sample(spark, sig):
    assert set(got(spark, "wica_clean")["n"]) == {len(sig)}


def test_study_has_every_event(spark, events):
    from axisframe.queries.registry import Views
    from axisframe.queries.stats import _study

    pred, resp, _ = _study(Views(spark, LONG))
    assert pred.count() == len(events) and resp.count() == 8 * len(events)
    fit = got(spark, "lmer_terms")
    p = pred.toPandas()
    x = np.column_stack([np.ones(len(p)), p["x"], p["cond"] == "lo"])
    r = resp.where("feature = 0").toPandas().merge(p, on=["group", "obs"])
    want = np.linalg.lstsq(np.column_stack([np.ones(len(r)), r["x"], r["cond"] == "lo"]).astype(float), r["value"], rcond=None)[0]
    f = fit[fit["feature"] == 0].set_index("term")["beta"]
    assert x.shape[0] == len(r)
    np.testing.assert_allclose([f["x"], f["condlo"]], want[1:], atol=5e-3)


# -- signals


def table_of(g, value="value", at="smp"):
    return g.pivot(index=at, columns="ch", values=value).to_numpy()


def test_fft_resample(spark, sig):
    n, m = len(sig), len(sig) // 4
    assert n % 4 == 0 and m % 2  # no term at half the rate
    want = np.fft.irfft(np.fft.rfft(sig, axis=0)[: m // 2 + 1], m, axis=0) * m / n
    np.testing.assert_allclose(table_of(got(spark, "fft_resample"), at="smp_idx"), want, atol=6e-5)


@pytest.mark.parametrize("name", ["swt_roundtrip", "emd_sum"])
def test_what_comes_back_is_the_signal(spark, sig, name):
    np.testing.assert_allclose(table_of(got(spark, name)), sig, atol=2e-5)


def test_instantaneous_frequency_sees_every_sample(spark):
    from axisframe.functions.emd import instantaneous
    from axisframe.queries.registry import Views

    x = table_of(Views(spark, LONG).sig.filtered((8.0, 14.0), "pass").df.select("ch", "smp", "value").toPandas())
    want = np.nanmean(instantaneous(np.ascontiguousarray(x.T), 200.0)[0], axis=1)
    np.testing.assert_allclose(got(spark, "instantaneous_frequency").sort_values("ch")["value"], want, atol=2e-3)


def test_eemd_sees_every_sample(spark, sig):
    g = got(spark, "eemd_modes")
    # the mean noisy input, int(log2 n) - 1 modes, the residue
    assert len(g) == 4 * (int(np.log2(len(sig))) - 1 + 2)
    np.testing.assert_allclose(g[g["mode"] == 0].sort_values("ch")["value"], sig.std(axis=0), rtol=5e-3)


# -- cubes


@pytest.fixture(scope="module")
def cube(events):
    """(c, b, a)"""
    return events["value"].to_numpy().reshape(-1, 20, 5)


def test_products(spark, cube):
    want = np.cumprod(cube / 1013 + 0.95, axis=1)
    g = got(spark, "cumprod").sort_values(["c", "b", "a"])
    np.testing.assert_allclose(g["value"].to_numpy().reshape(cube.shape), want, atol=2e-9)
    g = got(spark, "reduce_prod").sort_values(["c", "a"])
    np.testing.assert_allclose(g["value"].to_numpy().reshape(-1, 5), want[:, -1], atol=2e-9)


def test_add_dim(spark, cube):
    g = got(spark, "add_dim").sort_values(["rep", "c", "b", "a"])
    np.testing.assert_allclose(g["value"].to_numpy().reshape(3, *cube.shape), np.stack([cube] * 3), atol=1e-6)


def test_cluster_sums(spark, cube):
    flat, want, seen = cube.ravel(), {}, set()
    for start in np.flatnonzero(flat >= 40).tolist():
        if start in seen:
            continue
        seen.add(start)
        members = [start]
        for cell in members:  # grows as neighbours are found
            c, b, a = np.unravel_index(cell, cube.shape)
            for y, x in ((b - 1, a), (b + 1, a), (b, a - 1), (b, a + 1)):
                n = int(c * 100 + y * 5 + x)
                if 0 <= y < 20 and 0 <= x < 5 and flat[n] >= 40 and n not in seen:
                    seen.add(n)
                    members.append(n)
        want[start] = (len(members), flat[members].sum())
    g = got(spark, "cluster_sums").set_index("cluster")
    assert g["size"].to_dict() == {k: n for k, (n, _) in want.items()}
    np.testing.assert_allclose([g["sum"][k] for k in want], [s for _, s in want.values()], atol=1e-3)
