"""Cubes against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisframe.plans.cube import Cube, compact, take
from axisframe.plans.predicate import Predicate

A = np.arange(256).reshape(4, 4, 4, 4)
LABELS = {"one": [100, 200, 300, 400], "two": [30, 40, 50, 60], "three": [0, 1, 2, 3], "four": [1000, 1050, 1100, 1150]}


@pytest.fixture(scope="module")
def cube4(spark):
    return Cube.from_array(spark, A, LABELS, attrs={"test": "tst"})


@pytest.fixture(scope="module")
def nan3(spark):
    x = np.random.default_rng(0).normal(size=(4, 5, 3))
    x[0, 0, 0] = x[3, 4, 2] = x[1, 1, 1] = np.nan
    return x, Cube.from_array(spark, x)


@pytest.mark.parametrize("name", ["sum", "mean", "min", "max", "ptp", "prod", "var", "std", "all", "any", "argmin", "argmax"])
@pytest.mark.parametrize("axis", [0, 1, -1, None])
def test_reductions(nan3, name, axis):
    x, cube = nan3
    with np.errstate(invalid="ignore"):
        want = getattr(np, name)(x, axis=axis)
    got = getattr(cube, name)(axis).to_array()
    assert got.shape == (np.shape(want) or (1,))
    np.testing.assert_allclose(np.asarray(got, float), np.asarray(want, float).reshape(got.shape))


@pytest.mark.parametrize("name", ["nanmean", "nanvar", "nanstd"])
@pytest.mark.parametrize("axis", [0, "dim2", None])
def test_nan_reductions(nan3, name, axis):
    x, cube = nan3
    at = {"dim2": 1}.get(axis, axis)
    np.testing.assert_allclose(np.ravel(getattr(cube, name)(axis).to_array()).astype(float), np.ravel(getattr(np, name)(x, axis=at)))
    if name != "nanmean":
        np.testing.assert_allclose(np.ravel(getattr(cube, name)(axis, ddof=1).to_array()).astype(float), np.ravel(getattr(np, name)(x, axis=at, ddof=1)))


def test_all_nan_slice(spark):
    cube = Cube.from_array(spark, np.array([[np.nan, np.nan], [1.0, 3.0]]))
    np.testing.assert_array_equal(cube.nanmean(1).to_array(), [np.nan, 2.0])
    np.testing.assert_array_equal(cube.nanvar(1).to_array(), [np.nan, 1.0])


def test_documented_examples(spark):
    x = np.array([[np.nan, 2.0], [3.0, 4.0], [5.0, 6.0]])
    cube = Cube.from_array(spark, x)
    assert cube.nanvar().to_array()[0] == pytest.approx(2.0)
    np.testing.assert_allclose(cube.nanvar(0).to_array(), [1.0, 8 / 3])
    np.testing.assert_allclose(cube.nanvar(1).to_array(), [0.0, 0.25, 0.25])


@pytest.mark.parametrize("name", ["cumsum", "cumprod"])
def test_running(spark, name):
    x = np.random.default_rng(1).normal(size=(3, 6))
    np.testing.assert_allclose(getattr(Cube.from_array(spark, x), name)("dim2").to_array(), getattr(np, name)(x, axis=1))


def test_chunked_cumsum(spark):
    x = np.random.default_rng(1).normal(size=(2, 50))
    np.testing.assert_allclose(Cube.from_array(spark, x).cumsum("dim2", chunk=7).to_array(), np.cumsum(x, axis=1))


def test_sorting(spark):
    x = np.random.default_rng(2).integers(0, 5, size=(3, 7)).astype(float)
    cube = Cube.from_array(spark, x, {"a": [0, 1, 2], "b": [6, 5, 4, 3, 2, 1, 0]})
    np.testing.assert_array_equal(cube.argsort("b").to_array(), np.argsort(x, axis=1, kind="stable"))
    np.testing.assert_array_equal(cube.sort_axis("b").to_array(), np.sort(x, axis=1))
    assert cube.sort_axis("b").labels("b") == [0, 1, 2, 3, 4, 5, 6]
    kept = cube.sort_with_labels("b").df.where("a_idx = 0 AND b_idx = 0").first()
    assert x[0][6 - kept["b"]] == x[0].min()


def test_rankdata(spark):
    cube = Cube.from_array(spark, np.array([[3.0, 1.0, 3.0, 2.0]]))
    np.testing.assert_array_equal(cube.rankdata("dim2").to_array(), [[3.5, 1.0, 3.5, 2.0]])
    np.testing.assert_allclose(cube.rankdata("dim2", scaled=True).to_array(), [[2.5 / 3, 0, 2.5 / 3, 1 / 3]])


def test_bins(cube4):
    for dim, want in {"one": [150, 350], "two": [35, 55], "three": [0.5, 2.5], "four": [1025, 1125]}.items():
        got = cube4.make_bins(dim, 2)
        assert got.labels(dim) == want
        axis = list(LABELS).index(dim)
        np.testing.assert_allclose(got.to_array(), np.stack([h.mean(axis) for h in np.split(A, 2, axis)], axis))
    a, b = cube4.make_bins("four", [[1000, 1100], [1100, 2000]]), cube4.make_bins("four", 2)
    np.testing.assert_allclose(a.to_array(), b.to_array())
    np.testing.assert_allclose(cube4.make_bins("one", 2).make_bins("two", 2).to_array(), cube4.make_bins("two", 2).make_bins("one", 2).to_array())
    assert a.attrs == {"test": "tst"}


def test_uneven_bins(spark):
    x = np.arange(256).reshape(4, 16, 4)
    cube = Cube.from_array(spark, x, {"one": range(4), "two": range(16), "three": range(4)})
    with pytest.raises(ValueError):
        cube.make_bins("two", 3)
    got = cube.make_bins("two", 3, labels=["1st", "2nd", "3rd"], exact=False)
    same = cube.make_bins("two", [[0, 6, "1st"], [6, 11, "2nd"], [11, 16, "3rd"]])
    assert got.labels("two") == same.labels("two") == ["1st", "2nd", "3rd"]
    np.testing.assert_allclose(got.to_array(), same.to_array())
    np.testing.assert_allclose(got.to_array(), np.stack([p.mean(1) for p in np.array_split(x, 3, 1)], 1))


def test_bins_take_any_aggregate(spark):
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def middle(s: pd.Series) -> float:
        return float(s.median())

    got = Cube.from_array(spark, np.arange(12.0).reshape(2, 6)).make_bins("dim2", 2, middle)
    np.testing.assert_allclose(got.to_array(), [[1, 4], [7, 10]])


def test_predicates(spark):
    x = np.random.default_rng(3).normal(size=(2, 4, 5))
    cube = Cube.from_array(spark, x)
    assert cube["dim1 == 0"].dims == ("dim2", "dim3")
    assert cube.select("dim1 == 0").dims == cube.dims
    np.testing.assert_allclose(cube["dim1 == 0"].to_array(), x[0])
    np.testing.assert_allclose(cube["dim2 < 2"].to_array(), x[:, :2])
    np.testing.assert_allclose(cube["dim3 != 2"].to_array(), x[:, :, [0, 1, 3, 4]])
    np.testing.assert_allclose(cube["dim1 > 0", "dim2 > 0"].to_array(), x[1:, 1:])
    np.testing.assert_allclose(cube[cube["dim2"].is_in([1, 3])].to_array(), x[:, [1, 3]])
    np.testing.assert_allclose(cube.where("dim2 > low", low=1).to_array(), x[:, 2:])
    assert cube.find("dim1 == 1", "dim3 == 4").count() == 4


def test_select_keeps_axes(spark):
    cube = Cube.from_array(spark, np.array([[[6, 7, 8], [9, 10, 11]]]), {"d1": ["dim"], "d2": [1, 2], "d3": [3, 4, 5]})
    got = cube.select(cube["d2"] > 1, cube["d3"] > 3)
    assert got.shape == (1, 1, 2)
    np.testing.assert_array_equal(got.to_array(), [[[10, 11]]])


def test_or_across_axes(spark):
    cube = Cube.from_array(spark, np.zeros((20, 10, 30)), {"time": range(20), "freqs": range(10), "events": range(30)})
    got = cube[(cube["time"] > 10) & ((cube["events"] < 10) | (cube["events"] > 20)) & cube["freqs"].is_in([0, 2, 4, 6, 8])]
    assert got.shape == (9, 5, 19)


@pytest.mark.parametrize("text", ["nothing > 1", "1 < 2", "__import__('os').system('x')", "dim1.x > 0", "dim1 >", "open('x') == dim1", "lambda: dim1", "dim1 > missing"])
def test_predicates_that_are_refused(text):
    with pytest.raises(ValueError):
        Predicate(text, {"dim1": F.lit(1)})


def test_positions(spark):
    x = np.arange(60).reshape(3, 4, 5)
    cube = Cube.from_array(spark, x)
    for key in [(1,), (slice(1, 3),), (..., 2), (slice(None), [3, 1]), (-1,), (slice(None, None, 2),), ([True, False, True],), (0, slice(1, 3), -2), (None, 1)]:
        np.testing.assert_array_equal(cube[key].to_array(), x[tuple(np.array(k) if isinstance(k, list) else k for k in key)])
    np.testing.assert_array_equal(take(cube, [2, 0, 2], "dim2").to_array(), x.take([2, 0, 2], 1))
    np.testing.assert_array_equal(cube.compress([True, False, True], 0).to_array(), x.compress([True, False, True], 0))
    assert compact(cube.where("dim2 > 1"), "dim2").df.agg(F.max("dim2_idx")).first()[0] == 1


def test_shapes(spark):
    x = np.arange(24).reshape(2, 3, 4)
    cube = Cube.from_array(spark, x, attrs={"k": 1})
    np.testing.assert_array_equal(cube.transpose().to_array(), x.T)
    np.testing.assert_array_equal(cube.transpose("dim2", 0, 2).to_array(), x.transpose(1, 0, 2))
    np.testing.assert_array_equal(cube.swapaxes(0, 2).to_array(), x.swapaxes(0, 2))
    np.testing.assert_array_equal(cube.reshape([4, -1]).to_array(), x.reshape(4, -1))
    np.testing.assert_array_equal(cube.ravel().to_array(), x.ravel())
    np.testing.assert_array_equal(cube.repeat(2, 1).to_array(), x.repeat(2, 1))
    np.testing.assert_array_equal(cube.repeat([1, 0, 3], 1).to_array(), x.repeat([1, 0, 3], 1))
    np.testing.assert_array_equal(cube.diagonal(0, 1).to_array(), x.diagonal(0, 0, 1))
    np.testing.assert_array_equal(cube.trace(0, 1).to_array(), x.trace(0, 0, 1))
    np.testing.assert_array_equal(cube.add_dim("rep", range(3)).to_array(), np.stack([x] * 3))
    np.testing.assert_array_equal(cube.where("dim1 == 1").squeeze().to_array(), x[1])
    with pytest.raises(NotImplementedError):
        cube.resize(3)
    with pytest.raises(ValueError):
        cube.reshape([5, 5])
    with pytest.raises(ValueError):
        cube.transpose("dim1")
    assert Cube.from_metadata(cube.df, cube.metadata()).attrs == {"k": 1}


def test_arithmetic(spark):
    x, y = np.random.default_rng(4).normal(size=(2, 3, 4))
    a, b = Cube.from_array(spark, x), Cube.from_array(spark, y, {"p": "uvw", "q": range(4)})
    np.testing.assert_allclose((22 * a).to_array(), 22 * x)
    np.testing.assert_allclose((a - b).to_array(), x - y)
    np.testing.assert_allclose((1 / (a * a + 1)).to_array(), 1 / (x * x + 1))
    np.testing.assert_allclose(a.update("dim1 == 1", 0.0).to_array(), np.where(np.arange(3)[:, None] == 1, 0, x))


def test_extend(cube4, spark):
    other = Cube.from_array(spark, A + 256, LABELS | {"three": [4, 5, 6, 7]})
    got = cube4.extend(other, "three")
    np.testing.assert_array_equal(got.to_array(), np.concatenate([A, A + 256], 2))
    assert got.labels("three") == list(range(8))
    with pytest.raises(ValueError):
        cube4.extend(Cube.from_array(spark, A, LABELS | {"one": [1, 2, 3, 4]}), "three")
    with pytest.raises(ValueError):
        cube4.extend(other.transpose(), "three")


@pytest.mark.parametrize("names", [("a", "a"), ("dim 1",), ("$dim1",), ("1dim1",), ("dim:2",), ("",)])
def test_bad_names(spark, names):
    with pytest.raises(ValueError):
        Cube.from_array(spark, np.zeros((1,) * len(names)), dict.fromkeys(names, [0])) if len(set(names)) == len(names) else Cube(spark.range(1), names)


def test_bad_shapes(spark):
    with pytest.raises(ValueError):
        Cube.from_array(spark, np.zeros((2, 2)), {"a": [1, 2, 3], "b": [1, 2]})
    with pytest.raises(ValueError):
        Cube(spark.range(3), ("id",))


def test_from_labels(spark):
    df = spark.createDataFrame([("x", 2, 1.0), ("y", 2, 2.0), ("x", 5, 3.0), ("y", 5, 4.0)], "c string, t int, value double")
    cube = Cube.from_labels(df, ["c", "t"])
    np.testing.assert_array_equal(cube.to_array(), [[1, 3], [2, 4]])


def test_reduction_is_partial(spark):
    plan = Cube.from_array(spark, np.zeros((2, 3))).mean(0).df._jdf.queryExecution().executedPlan().toString()
    assert "partial_avg" in plan


def test_local_maxima_and_crossings(spark):
    x = np.array([[0.0, 2, 2, 1, 3, 0, 0, 5, 5, 5, 1]])
    got = sorted(r["dim2_idx"] for r in Cube.from_array(spark, x).local_maxima("dim2").df.collect())
    assert got == [1, 4, 8]
    z = Cube.from_array(spark, np.array([[1.0, -1.0, -2.0, 3.0]])).zero_crossings("dim2").to_array()
    np.testing.assert_array_equal(z, [[0, 1, 0, 1]])
