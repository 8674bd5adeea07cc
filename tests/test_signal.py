"""Signal kernels by their properties, and their Spark forms."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from axisframe.functions import design, emd, filters, wavelets
from axisframe.operators import align, epochs
from axisframe.plans.cube import Cube
from axisframe.plans.timecube import TimeCube

T = np.arange(800) / 200
SINES = np.stack([np.sin(2 * np.pi * 10 * T), np.sin(2 * np.pi * 5 * T)])


@pytest.fixture(scope="module")
def dat200(spark):
    return TimeCube.of(Cube.from_array(spark, SINES, {"channel": [0, 1], "time": T - 1.0}), "time", 200)


def test_butterworth():
    b, a = design.butter(2, 0.5)
    np.testing.assert_allclose(b, [0.29289322, 0.58578644, 0.29289322], atol=1e-8)
    np.testing.assert_allclose(a, [1, 0, 0.17157288], atol=1e-8)
    for kind, band in [("pass", [0.1, 0.2]), ("stop", [0.1, 0.2]), ("high", 0.3), ("low", 0.3)]:
        b, a = design.butter(4, band, kind)
        np.testing.assert_allclose(np.abs(design.response(b, a, np.atleast_1d(band))), 0.5**0.5, rtol=1e-6)


def test_chebyshev_ripple():
    b, a = design.cheby1(8, 0.05, 0.4)
    gain = 20 * np.log10(np.abs(design.response(b, a, np.linspace(0, 0.4, 200))))
    assert -0.0501 < gain.min() and gain.max() < 1e-6


@pytest.mark.parametrize("band", [0, 1, [0.5, 0.2], [0.1]])
def test_bands_that_are_refused(band):
    with pytest.raises(ValueError):
        design.butter(4, band, "pass" if np.size(band) > 1 or band == [0.1] else "low")


def test_firls():
    h = design.firls(31, [0, 0.2, 0.4, 1], [1, 1, 0, 0])
    np.testing.assert_allclose(h, h[::-1])
    assert np.abs(np.abs(design.response(h, np.ones(1), np.array([0.05, 0.1, 0.15]))) - 1).max() < 0.01


def test_steady_state():
    b, a = design.butter(3, 0.2)
    zi = filters.lfilter_zi(b, a)
    np.testing.assert_allclose(filters.lfilter(b, a, np.ones((1, 50)), zi[:, None]), 1.0, atol=1e-9)


@settings(max_examples=20, deadline=None)
@given(st.floats(-3, 3), st.floats(-3, 3), st.integers(0, 2**31))
def test_filtfilt_is_linear_and_has_no_phase(p, q, seed):
    x, y = np.random.default_rng(seed).normal(size=(2, 120))
    b, a = design.butter(2, [0.1, 0.3], "pass")
    np.testing.assert_allclose(filters.filtfilt(b, a, p * x + q * y), p * filters.filtfilt(b, a, x) + q * filters.filtfilt(b, a, y), atol=1e-9)
    np.testing.assert_allclose(filters.filtfilt(b, a, np.stack([x, y]))[1], filters.filtfilt(b, a, y))


def test_filtfilt_needs_length():
    with pytest.raises(ValueError):
        filters.filtfilt(*design.butter(4, 0.2), np.zeros(10))


def test_extensions():
    x = np.array([1.0, 2, 4, 7])
    np.testing.assert_array_equal(filters.extend(x, 2), [-2, 0, 1, 2, 4, 7, 10, 12])
    np.testing.assert_array_equal(filters.extend(x, 2, "even"), [4, 2, 1, 2, 4, 7, 4, 2])
    np.testing.assert_array_equal(filters.extend(x, 2, "constant"), [1, 1, 1, 2, 4, 7, 7, 7])


def test_band_stop(dat200):
    got = dat200.filtered((8.0, 12.0), "stop").to_array()
    assert np.abs(got[0, 200:600]).max() < 0.02 and np.abs(got[1, 200:600] - SINES[1, 200:600]).max() < 0.02


def test_resample(dat200):
    t = np.arange(200) / 50
    native = np.stack([np.sin(2 * np.pi * 10 * t), np.sin(2 * np.pi * 5 * t)])
    got = dat200.resampled(50)
    assert got.samplerate == 50 and got.shape == (2, 200)
    np.testing.assert_allclose(got.remove_buffer(1).to_array(), native[:, 50:-50], atol=1e-6)
    np.testing.assert_allclose(got.labels("time"), t - 1.0, atol=1e-12)


def test_remove_buffer(dat200):
    assert dat200.remove_buffer(1).shape == dat200.remove_buffer((1, 1)).shape == (2, 400)
    with pytest.raises(ValueError):
        dat200.remove_buffer(-1)


def test_time_axis_is_checked(dat200):
    with pytest.raises(ValueError):
        TimeCube.of(dat200, "nothing", 200)
    with pytest.raises(ValueError):
        TimeCube.of(dat200, "time", -1)
    assert type(dat200.mean("time")) is Cube and type(dat200.mean("channel")) is TimeCube


def test_baseline(dat200):
    got = dat200.baseline_corrected((-1.0, -0.5)).to_array()
    np.testing.assert_allclose(got, SINES - SINES[:, :101].mean(1, keepdims=True), atol=1e-12)


def test_decimate():
    got = filters.decimate(SINES, 4)
    assert got.shape == (2, 200) and np.abs(got - SINES[:, ::4])[:, 20:-20].max() < 0.02
    with pytest.raises(TypeError):
        filters.decimate(SINES, 2.5)
    assert filters.decimate(SINES, 4, kind="fir").shape == (2, 200)


def test_morlet():
    np.testing.assert_allclose(wavelets.morlet(3, 2, 1, True).real, [1.73752399e-09, 6.49471756e-01, 1.73752399e-09], rtol=1e-6)
    np.testing.assert_allclose(wavelets.morlet(3, 2, 1, False).real, [2.00947715e-09, 7.51125544e-01, 2.00947715e-09], rtol=1e-6)
    (k,) = wavelets.morlet_kernels(10, 5, 200)
    assert len(k) == 112 and (np.abs(k) ** 2).sum() / 200 == pytest.approx(1)
    many = wavelets.morlet_kernels([10, 10, 10, 10, 10, 10], [3, 6], 200, [7, 8, 9])
    np.testing.assert_array_equal(many[0], many[1])
    np.testing.assert_array_equal(many[4], many[5])
    for bad in ([], [1, 2, 3]):
        with pytest.raises(ValueError):
            wavelets.morlet_kernels([10, 20] if bad else bad, bad or 5)


def test_convolution_is_direct_convolution():
    x, k = np.random.default_rng(0).normal(size=(2, 40)), np.random.default_rng(1).normal(size=7) + 1j
    for mode in ("full", "same", "valid"):
        np.testing.assert_allclose(wavelets.fft_convolve([k], x, mode)[0], [np.convolve(r, k, mode) for r in x], atol=1e-10)


def test_wavelet(spark):
    x = np.stack([np.arange(1000.0)] * 2)
    tc = TimeCube.of(Cube.from_array(spark, x, {"row": [0, 1], "time": np.arange(1000) / 100}), "time", 100)
    power, phase = tc.wavelet([2, 5]), tc.wavelet([2, 5], what="phase").to_array()
    assert power.dims == ("freqs", "row", "time") and power.shape == (2, 2, 1000)
    p = power.to_array()
    assert (p >= 0).all() and (np.abs(phase) <= np.pi).all()
    np.testing.assert_array_equal(p[:, 0], p[:, 1])
    with pytest.raises(ValueError):
        wavelets.phase_power(x[:, :10], [2], 100)


def test_chunks_change_nothing(spark):
    """Runs of a long series with halos give what the whole series gives."""
    x = np.random.default_rng(3).normal(size=(2, 3000))
    tc = TimeCube.of(Cube.from_array(spark, x, {"row": [0, 1], "time": np.arange(3000) / 200}), "time", 200)
    np.testing.assert_allclose(tc.wavelet([10.0, 30.0], chunk=300).to_array(), wavelets.phase_power(x, [10.0, 30.0], 200)[1], atol=1e-9)
    np.testing.assert_allclose(tc.filtered((20.0, 40.0), "pass", chunk=100).to_array(), filters.buttfilt(x, (20, 40), 200, "pass"), atol=1e-7)
    plan = tc.wavelet([10.0], chunk=300).df._jdf.queryExecution().executedPlan().toString()
    assert "__chunk" in plan


def test_closed_form():
    phase, power = wavelets.phase_power_closed(SINES, [5.0, 10.0], 200)
    assert power.shape == (2, 2, 800) and power[1, 0, 400] > 100 * power[0, 0, 400] and np.abs(phase).max() <= np.pi


def test_swt():
    x = np.random.default_rng(0).normal(size=(3, 64))
    np.testing.assert_allclose(wavelets.iswt(wavelets.swt(x, 4)), x, atol=1e-9)
    low = wavelets.DB3
    assert (low**2).sum() == pytest.approx(1) and low.sum() == pytest.approx(2**0.5)
    with pytest.raises(ValueError):
        wavelets.swt(x[:, :60], 4)


def test_hilbert(dat200):
    got = dat200.hilbert_amplitude({"low": (3, 7), "mid": (8, 12)}).to_array()
    assert np.abs(got[1, 0, 200:600] - 1).max() < 0.05 and got[1, 1, 200:600].max() < 0.05 and np.abs(got[0, 1, 200:600] - 1).max() < 0.05
    z = filters.analytic(SINES)
    np.testing.assert_allclose(z.real, SINES, atol=1e-10)


def test_spline_is_exact_for_cubics():
    x = np.array([-2.0, -1, 0.5, 1, 2.5, 4])
    f = np.poly1d([1, -2, 0.5, 3])
    np.testing.assert_allclose(emd.cubic_spline(x, f(x), np.linspace(-3, 5, 60)), f(np.linspace(-3, 5, 60)), atol=1e-10)


def test_emd(dat200):
    x = SINES.sum(0) + T
    modes = emd.emd(x)
    np.testing.assert_allclose(modes.sum(0), x, atol=1e-10)
    assert len(emd.emd(x, max_modes=1)) == 2
    np.testing.assert_allclose(dat200.emd().sum("mode").transpose("channel", "time").to_array(), SINES, atol=1e-9)
    freq = emd.instantaneous(SINES, 200)[0]
    assert np.isnan(freq[:, [0, -1]]).all() and np.abs(np.nanmedian(freq, 1) - [10, 5]).max() < 0.1


def test_eemd(spark):
    x = np.sin(np.arange(64) / 3)[None] * 2
    tc = TimeCube.of(Cube.from_array(spark, x, {"row": [0], "time": np.arange(64) / 64}), "time", 64)
    got = tc.eemd(num_ensembles=6, num_sifts=2).to_array()
    assert got.shape == (7, 1, 64)
    np.testing.assert_allclose(got[1:].sum(0), got[0], atol=1e-9)
    np.testing.assert_array_equal(got, tc.eemd(num_ensembles=6, num_sifts=2).to_array())


# -- events


@pytest.fixture(scope="module")
def recording(spark):
    from axisframe.sources.base import from_array

    x = np.random.default_rng(5).normal(size=(10, 1000))
    return x, from_array(spark, x, "rec")


@pytest.mark.parametrize("start, end, slices", [(-0.1, 0.4, [(60, 161), (120, 221), (250, 351)]), (0.1, 0.6, [(100, 201), (160, 261), (290, 391)])])
def test_epochs(spark, recording, start, end, slices):
    x, signal = recording
    events = spark.createDataFrame([(i, "rec", float(o)) for i, o in enumerate((80, 140, 270))], "event int, esrc string, eoffset double")
    got = epochs.epochs(events, signal, 200, start, end, channels=[3], in_seconds=False)
    np.testing.assert_allclose(got.to_array()[0], [x[3, a:b] for a, b in slices])
    seconds = events.withColumn("eoffset", F.col("eoffset") / 200)
    np.testing.assert_allclose(epochs.epochs(seconds, signal, 200, start, end, channels=[3], buffer=0.1).to_array(), got.to_array())
    assert epochs.epochs(seconds, signal, 200, start, end, buffer=0.1, keep_buffer=True, channels=[3]).shape == (1, 3, 141)


def test_epochs_filter_and_resample(spark, recording):
    x, signal = recording
    events = spark.createDataFrame([(0, "rec", 2.0)], "event int, esrc string, eoffset double")
    got = epochs.epochs(events, signal, 200, -0.5, 0.495, resample=50, band=(20.0, 30.0), channels=[0, 1])
    want = filters.resample(filters.buttfilt(x[:2, 300:500], (20, 30), 200, "stop"), 50)
    np.testing.assert_allclose(got.to_array()[:, 0], want, atol=1e-9)


def test_epoch_errors(spark, recording):
    _, signal = recording
    events = spark.createDataFrame([(0, "rec", 0.05), (1, "other", 2.0)], "event int, esrc string, eoffset double")
    with pytest.raises(OSError):
        epochs.epochs(events.limit(1), signal, 200, -0.1, 0.1)
    with pytest.raises(OSError):
        epochs.epochs(events.where("event = 1"), signal, 200, -0.1, 0.1)
    with pytest.raises(ValueError):
        epochs.epochs(events, signal, 200, 0.2, 0.1)
    with pytest.raises(ValueError):
        epochs.epochs(events.drop("esrc"), signal, 200, 0, 0.1)


def test_epoch_join_is_an_equality(spark, recording):
    events = spark.createDataFrame([(0, "rec", 2.0)], "event int, esrc string, eoffset double")
    plan = epochs.epochs(events, recording[1], 200, -0.1, 0.1, check=False).df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_event_fields(spark):
    e = spark.createDataFrame([(1.0, 2, "bla1"), (3.0, 4, "bla2")], "x double, y int, z string")
    assert epochs.remove_fields(e, "y", "nothing").columns == ["x", "z"]
    assert epochs.add_fields(e, w=F.col("x") + 1).select("w").collect()[0][0] == 2.0
    with pytest.raises(ValueError):
        epochs.add_fields(e, x=1)


def test_channel_choice(spark):
    table = spark.createDataFrame([(1, "Fz", "uV"), (2, "Cz", "uV"), (3, "EOG", "mV")], "number int, name string, unit string")
    assert epochs.choose_channels(table, ["Cz", 1]) == [1, 2]
    assert epochs.choose_channels(table, {"unit": "mV"}) == [3]
    assert epochs.choose_channels(table, None) is None
    with pytest.raises(ValueError):
        epochs.choose_channels(table, "Pz")


def test_alignment(spark):
    beh = np.cumsum(np.random.default_rng(0).uniform(0.5, 2, 60)) + 7
    eeg = beh * 1.0001 + 33
    slope, intercept = align.times_to_offsets(np.concatenate([[1.0, 2.5], eeg]), beh)
    assert slope == pytest.approx(1.0001, abs=1e-6) and intercept == pytest.approx(33, abs=1e-3)
    slope, intercept = align.times_to_offsets_ends(eeg * 500, beh * 1000, 500, window=20)
    assert slope * 1000 == pytest.approx(1.0001, abs=1e-6) and intercept == pytest.approx(33, abs=1e-3)
    assert align.find_needle(np.array([1, 2]), np.array([5, 1, 2]), 0.1) == 1
    assert align.find_needle(np.array([1, 2]), np.array([5, 1, 9]), 0.1) == -1
    with pytest.raises(ValueError):
        align.match_pulses(np.arange(5.0), beh)
    ann = spark.createDataFrame([(float(x), "S255") for x in eeg], "onset double, annotation string")
    ev = spark.createDataFrame([(float(beh[5] * 1000),)], "mstime double")
    got = align.align(ev, ann, spark.createDataFrame([(float(b * 1000),) for b in beh], "time double"), "rec").first()
    assert got["esrc"] == "rec" and got["eoffset"] == pytest.approx(eeg[5], abs=1e-3)
