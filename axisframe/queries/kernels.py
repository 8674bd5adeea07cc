"""Queries over kernels and designs whose SQL writes the same sums out: recursions step by step, transforms as double sums."""

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions import algebra, design, filters, wavelets
from ..operators import clusters, decomposition
from ..plans.timecube import TimeCube
from .registry import query, rows

_N = "(SELECT max(smp) + 1 FROM sig)"


# -- axes and cells


@query("SELECT a, CASE b WHEN 1 THEN 1 ELSE 3 END AS b, c, round(value, 6) + 0.0 AS value FROM cube WHERE b IN (1, 3)")
def axis_index(v):
    """Positions of an axis as a condition."""
    return rows(v.cube.where(v.cube["b"].index([1, 3])))


@query("SELECT row_number() OVER (ORDER BY c, b, a) - 1 AS cell_idx, (c * 20 + b) * 5 + a AS cell, round(value, 6) + 0.0 AS value FROM cube WHERE value > 120 AND (a + b) % 2 = 0")
def mask_dimless(v):
    """A mask over several axes leaves a flat run of cells in row-major order."""
    got = v.cube.transpose("c", "b", "a").flat((F.col("value") > 120) & ((F.col("a") + F.col("b")) % 2 == 0))
    return rows(got.df.select("cell_idx", "cell", "value"))


@query("SELECT b * 5 * (SELECT max(c) + 1 FROM cube) + c * 5 + a AS cell, round(value, 6) + 0.0 AS value FROM cube")
def swap_axes(v):
    """Row-major numbers after two axes have changed places."""
    got = v.cube.transpose("c", "b", "a").swapaxes("b", "c").ravel()
    return rows(got.df.select("cell", "value"))


@query("SELECT 0::BIGINT AS number, 'a' AS name, 5::BIGINT AS length UNION ALL SELECT 1, 'b', 20 UNION ALL SELECT 2, 'c', (SELECT max(c) + 1 FROM cube) UNION ALL SELECT -1, 'c', (SELECT max(c) + 1 FROM cube)")
def axis_names(v):
    c = v.cube
    return v.spark.createDataFrame([(i, c.axis(i), c.length(i)) for i in (0, 1, 2, -1)], "number long, name string, length long")


@query("WITH m AS (SELECT b, avg(value) AS m FROM cube GROUP BY b) SELECT a, b, c, round(m, 6) + 0.0 AS value FROM cube JOIN m USING (b)")
def repeat_to_match(v):
    """A mean by one axis repeated along the others."""
    return rows(v.cube.mean("a").mean("c").repeat_to_match(v.cube))


@query("WITH m AS (SELECT b, avg(value) AS m FROM cube GROUP BY b) SELECT a, b, c, round(value - m, 6) + 0.0 AS value FROM cube JOIN m USING (b)")
def combine_fewer_axes(v):
    """A cube less one that has fewer axes."""
    return rows(v.cube - v.cube.mean("a").mean("c"))


@query(f"WITH n AS (SELECT {_N} AS n) SELECT ch, smp - (n - 99) // 2 AS smp, round(value, 6) + 0.0 AS value FROM sig, n WHERE smp >= (n - 99) // 2 AND smp < (n - 99) // 2 + 99")
def centered_middle(v):
    """The middle 99 samples."""
    got = v.sig.apply(lambda x, t: (filters.centered(x, 99), t[:99]))
    return rows(got.df.select("ch", F.col("smp_idx").alias("smp"), "value"))


def _extension(kind: str):
    edge = {"odd": "2 * e.value - s.value", "even": "s.value", "constant": "e.value"}[kind]
    source = "20 - i" if kind != "constant" else "0"
    mirror = "2 * n - 2 - (i - 20)" if kind != "constant" else "n - 1"
    return f"""WITH n AS (SELECT {_N} AS n), p AS (SELECT i, n, CASE WHEN i < 20 THEN {source} WHEN i >= n + 20 THEN {mirror} ELSE i - 20 END AS at, CASE WHEN i < 20 THEN 0 WHEN i >= n + 20 THEN n - 1 END AS edge FROM n, range(0, {_N} + 40) r(i))
              SELECT s.ch, i AS smp, round(CASE WHEN edge IS NULL THEN s.value ELSE {edge} END, 6) + 0.0 AS value FROM p JOIN sig s ON s.smp = p.at LEFT JOIN sig e ON e.smp = p.edge AND e.ch = s.ch"""


def _extended(v, kind: str):
    got = v.sig.apply(lambda x, t: (filters.extend(x, 20, kind), t[0] + np.arange(x.shape[-1] + 40)))
    return rows(got.df.select("ch", F.col("smp_idx").alias("smp"), "value"))


@query(_extension("odd"))
def extension_odd(v):
    return _extended(v, "odd")


@query(_extension("even"))
def extension_even(v):
    return _extended(v, "even")


@query(_extension("constant"))
def extension_constant(v):
    return _extended(v, "constant")


@query("""WITH p AS (SELECT ch, smp, value - 2 * pi() * floor((value + pi()) / (2 * pi())) AS x FROM sig),
          d AS (SELECT ch, smp, x, x - lag(x) OVER w AS s FROM p WINDOW w AS (PARTITION BY ch ORDER BY smp)),
          m AS (SELECT ch, smp, x, s, (s + pi()) - 2 * pi() * floor((s + pi()) / (2 * pi())) - pi() AS q FROM d)
          SELECT ch, smp, round(x + sum(CASE WHEN s IS NULL OR abs(s) < pi() THEN 0 ELSE q - s END) OVER (PARTITION BY ch ORDER BY smp), 4) + 0.0 AS value FROM m""")
def unwrap_phase(v):
    """Angles without jumps."""
    from ..functions.scalar import rewrap

    return rows(v.sig.map(rewrap).unwrap("smp").df.select("ch", "smp", "value"), 4)


@query("""WITH l AS (SELECT ch, smp, log10(CASE WHEN value - 5 <= 0 THEN 2.220446049250313e-16 ELSE value - 5 END) AS l FROM sig), b AS (SELECT ch, avg(l) AS m, stddev_samp(l) AS s FROM l WHERE smp < 100 GROUP BY ch)
          SELECT ch, smp, round((l - m) / s, 5) + 0.0 AS value FROM l JOIN b USING (ch)""")
def log_power_z_baseline(v):
    """Log power as z-scores of a stretch before."""
    from ..functions.scalar import log10_floor

    got = v.sig.map(lambda x: log10_floor(x - 5)).zscored("smp", F.col("smp") < 100)
    return rows(got.df.select("ch", "smp", "value"), 5)


# -- wavelets


@query("SELECT i, round(exp(-pow((i - 20) / 200.0, 2) / (2 * s * s)) * cos(2 * pi() * 20 * (i - 20) / 200.0) / sqrt(s * sqrt(pi())), 9) + 0.0 AS re, round(exp(-pow((i - 20) / 200.0, 2) / (2 * s * s)) * sin(2 * pi() * 20 * (i - 20) / 200.0) / sqrt(s * sqrt(pi())), 9) + 0.0 AS im FROM range(41) t(i), (SELECT 5 / (2 * pi() * 20) AS s)")
def morlet_closed(v):
    k = wavelets.morlet_at(20.0, (np.arange(41) - 20) / 200.0, 5.0)
    return rows(v.spark.createDataFrame([(i, float(x.real), float(x.imag)) for i, x in enumerate(k)], "i long, re double, im double"), 9)


_CLOSED = len(np.arange(-3.5 * 5 / (2 * np.pi * 20), 3.5 * 5 / (2 * np.pi * 20), 1 / 200))


@query(f"""WITH k AS (SELECT i, exp(-t * t / (2 * s * s)) * cos(2 * pi() * 20 * t) / sqrt(s * sqrt(pi())) AS re, exp(-t * t / (2 * s * s)) * sin(2 * pi() * 20 * t) / sqrt(s * sqrt(pi())) AS im
                      FROM (SELECT i, s, -3.5 * s + i / 200.0 AS t FROM range({_CLOSED}) r(i), (SELECT 5 / (2 * pi() * 20) AS s))),
              c AS (SELECT ch, smp + i - {-(-_CLOSED // 2) - 1} AS smp, sum(value * re) AS re, sum(value * im) AS im FROM sig, k GROUP BY 1, 2)
           SELECT ch, smp, round(re * re + im * im, 2) + 0.0 AS value FROM c WHERE smp >= 0 AND smp < {_N}""")
def wavelet_closed(v):
    """Power by the closed form and direct convolution."""
    return rows(v.sig.wavelet_closed(20.0).df.select("ch", F.col("smp").cast("long").alias("smp"), "value"), 2)


_TAPS = [0.5, -1.0, 2.0, 0.25, 0.125]


@query(f"WITH k(i, w) AS (VALUES {', '.join(f'({i}, {w})' for i, w in enumerate(_TAPS))}) SELECT ch, smp + i - 2 AS smp, round(sum(value * w), 6) + 0.0 AS value FROM sig, k WHERE smp + i - 2 BETWEEN 0 AND {_N} - 1 GROUP BY 1, 2")
def convolve_direct(v):
    return rows(v.sig.convolved(_TAPS).df.select("ch", F.col("smp").cast("long").alias("smp"), "value"))


_FREQS, _WIDTHS = np.geomspace(4, 60, 8).tolist(), [3.0] * 4 + [6.0] * 4


def _kernels() -> str:
    """Kernels by frequency: their lengths are constants of the parameters, their points come from a range."""
    parts = []
    for f, w in zip(_FREQS, _WIDTHS, strict=True):
        n = len(wavelets.morlet_kernels(f, w, 200.0)[0])
        s = f * n / (2 * w * 200.0)
        parts.append(f"({f!r}, {w!r}, {n}, {s!r})")
    return f"""f(f, w, n, s) AS (VALUES {", ".join(parts)}), x AS (SELECT f, w, n, i, -2 * pi() * s + 4 * pi() * s * i / (n - 1) AS x FROM f, range(2000) r(i) WHERE i < n),
               raw AS (SELECT f, n, i, (cos(w * x) - exp(-0.5 * w * w)) * exp(-0.5 * x * x) * pow(pi(), -0.25) AS re, sin(w * x) * exp(-0.5 * x * x) * pow(pi(), -0.25) AS im FROM x),
               norm AS (SELECT f, sqrt(sum(re * re + im * im) / 200) AS norm FROM raw GROUP BY f),
               kernel AS (SELECT f, i - (n - 1) // 2 AS i, re / norm AS re, im / norm AS im FROM raw JOIN norm USING (f))"""


@query(f"""WITH {_kernels()}, c AS (SELECT f, ch, smp + i AS smp, sum(value * re) AS re, sum(value * im) AS im FROM sig, kernel GROUP BY 1, 2, 3)
           SELECT round(f::DOUBLE, 3) + 0.0 AS freqs, ch, round(avg(re * re + im * im), 2) + 0.0 AS value FROM c WHERE smp >= 0 AND smp < {_N} GROUP BY f, ch""")
def wavelet_multi(v):
    """Mean power of each channel at eight frequencies."""
    got = v.sig.wavelet(np.array(_FREQS), widths=[3.0, 6.0]).mean("smp")
    return got.df.select((F.round("freqs", 3) + 0.0).alias("freqs"), F.col("ch").cast("long").alias("ch"), (F.round("value", 2) + 0.0).alias("value"))


def _swt_sql(levels: int) -> str:
    """Each level's sums over the six taps, which stand 2**level apart, around the ends."""
    low = wavelets.DB3
    high = low[::-1] * (-1.0) ** np.arange(6)
    taps = ", ".join(f"({k}, {a!r}, {b!r})" for k, (a, b) in enumerate(zip(low.tolist(), high.tolist(), strict=True)))
    m = f"({_N} // {1 << levels} * {1 << levels})"
    parts = [f"k(k, lo, hi) AS (VALUES {taps}), n AS (SELECT {m} AS n), a0 AS MATERIALIZED (SELECT ch, smp, value AS a FROM sig, n WHERE smp < n)"]
    for j in range(levels):
        parts.append(f"l{j + 1} AS MATERIALIZED (SELECT x.ch, x.smp, sum(y.a * lo) AS a, sum(y.a * hi) AS d FROM (SELECT ch, smp, n FROM a0, n) x CROSS JOIN k JOIN {'a0' if not j else f'l{j}'} y ON y.ch = x.ch AND y.smp = (x.smp + k * {1 << j}) % x.n GROUP BY 1, 2)")
    tops = " UNION ALL ".join([f"SELECT 0 AS level, ch, a AS v FROM l{levels}"] + [f"SELECT {j + 1}, ch, d FROM l{j + 1}" for j in range(levels)])
    return f"WITH {', '.join(parts)} SELECT level::BIGINT AS level, ch, round(avg(v * v), 3) + 0.0 AS power, round(avg(v), 4) + 0.0 AS mean FROM ({tops}) GROUP BY 1, 2"


@query(_swt_sql(4))
def swt_details(v):
    """Mean power of details and approximation of the stationary wavelet transform; a transform of 4 levels takes whole sixteens of samples."""
    n = v.n_samples // 16 * 16
    got = TimeCube.of(v.sig.where(F.col("smp_idx") < n), "smp", 200.0).swt(4)
    return got.df.groupBy(F.col("level").cast("long").alias("level"), F.col("ch").cast("long").alias("ch")).agg((F.round(F.avg(F.col("value") ** 2), 3) + 0.0).alias("power"), (F.round(F.avg("value"), 4) + 0.0).alias("mean"))


# -- filters: designs


@query("""WITH c AS (SELECT tan(pi() * 0.3 / 2) AS k), d AS (SELECT k, 1 + sqrt(2) * k + k * k AS d FROM c)
          SELECT 0 AS i, round(k * k / d, 9) + 0.0 AS b, 1.0::DOUBLE AS a FROM d UNION ALL SELECT 1, round(2 * k * k / d, 9) + 0.0, round(2 * (k * k - 1) / d, 9) + 0.0 FROM d
          UNION ALL SELECT 2, round(k * k / d, 9) + 0.0, round((1 - sqrt(2) * k + k * k) / d, 9) + 0.0 FROM d""")
def butter_lowpass(v):
    """A Butterworth low-pass of order 2 against its closed form."""
    b, a = design.butter(2, 0.3, "low")
    return rows(v.spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(b, a, strict=True))], "i int, b double, a double"), 9)


@query("SELECT n AS order_, f AS freq, round(1 / sqrt(1 + pow(tan(pi() * f / 2) / tan(pi() * 0.4 / 2), 2 * n)), 7) + 0.0 AS gain FROM (VALUES (1), (2), (3), (4), (5)) o(n), (SELECT (i + 1) / 20e0 AS f FROM range(18) t(i))")
def butter_response(v):
    """Gain of Butterworth low-passes of five orders over frequency."""
    freq, out = (np.arange(18) + 1) / 20, []
    for n in range(1, 6):
        out += [(n, float(f), float(g)) for f, g in zip(freq, np.abs(design.response(*design.butter(n, 0.4, "low"), freq)), strict=True)]
    return v.spark.createDataFrame(out, "order_ int, freq double, gain double").select("order_", "freq", (F.round("gain", 7) + 0.0).alias("gain"))


@query("""WITH e AS (SELECT sqrt(pow(10, 0.005) - 1) AS eps), x AS (SELECT f, tan(pi() * f / 2) / tan(pi() * 0.2 / 2) AS x FROM (SELECT (i + 1) / 20e0 AS f FROM range(18) t(i))),
          t AS (SELECT f, CASE WHEN x <= 1 THEN cos(8 * acos(x)) ELSE cosh(8 * acosh(x)) END AS t FROM x)
          SELECT f AS freq, round(1 / sqrt(1 + eps * eps * t * t), 7) + 0.0 AS gain FROM t, e""".replace("cosh(8 * acosh(x))", "(pow(x + sqrt(x * x - 1), 8) + pow(x - sqrt(x * x - 1), 8)) / 2"))
def cheby_response(v):
    """Gain of the Chebyshev low-pass that goes before taking every fourth sample."""
    freq = (np.arange(18) + 1) / 20
    g = np.abs(design.response(*design.cheby1(8, 0.05, 0.2), freq))
    return v.spark.createDataFrame([(float(f), float(x)) for f, x in zip(freq, g, strict=True)], "freq double, gain double").select("freq", (F.round("gain", 7) + 0.0).alias("gain"))


@query("SELECT i::INT AS i, round(CASE WHEN i = 15 THEN 0.3 ELSE sin(pi() * 0.3 * (i - 15)) / (pi() * (i - 15)) END, 9) + 0.0 AS h FROM range(31) t(i)")
def firls_lowpass(v):
    """Least squares over the whole band gives the cut-off ideal response."""
    h = design.firls(31, [0, 0.3, 0.3, 1], [1, 1, 0, 0])
    return rows(v.spark.createDataFrame([(i, float(x)) for i, x in enumerate(h)], "i int, h double"), 9).withColumn("i", F.col("i").cast("int"))


# -- filters: recursions


def _filtfilt(b, a, source: str = "sig", out: str = "y", older: bool = False) -> str:
    """CTEs of a zero-phase filter: ends mirrored through the end point, the recursion forwards and backwards step by step from steady states."""
    b, a = (np.asarray(x, float) / a[0] for x in (b, a))
    n, edge, zi = len(a), 3 * len(a) - older, filters.lfilter_zi(b, a)
    front, back = (f"{edge + 1} - i", f"2 * n + {edge} - 1 - i") if older else (f"{edge} - i", f"2 * n - 2 - (i - {edge})")
    state = lambda x, y, z: ", ".join((f"{z(i + 1)} + " if i < n - 2 else "") + f"{float(b[i + 1])!r} * {x} - {float(a[i + 1])!r} * {y} AS z{i}" for i in range(n - 1))

    def passed(name: str, src: str) -> str:
        first = f"{float(b[0])!r} * x + {float(zi[0])!r} * x"
        start = ", ".join((f"{float(zi[i + 1])!r} * x + " if i < n - 2 else "") + f"{float(b[i + 1])!r} * x - {float(a[i + 1])!r} * ({first}) AS z{i}" for i in range(n - 1))
        now = f"({float(b[0])!r} * s.x + r.z0)"
        return f"{name} AS (SELECT ch, i, {first} AS y, {start} FROM {src} WHERE i = 0 UNION ALL SELECT r.ch, s.i, {now} AS y, {state('s.x', now, lambda k: f'r.z{k}')} FROM {name} r JOIN {src} s ON s.ch = r.ch AND s.i = r.i + 1)"

    n_ = f"(SELECT max(smp) + 1 FROM {source})"
    return f"""{out}_p AS (SELECT i, n, CASE WHEN i < {edge} THEN {front} WHEN i >= n + {edge} THEN {back} ELSE i - {edge} END AS at, CASE WHEN i < {edge} THEN 0 WHEN i >= n + {edge} THEN n - 1 END AS e FROM (SELECT {n_} AS n), range(0, {n_} + {2 * edge}) r(i)),
        {out}_x AS (SELECT s.ch, i, CASE WHEN e.value IS NULL THEN s.value ELSE 2 * e.value - s.value END AS x FROM {out}_p p JOIN {source} s ON s.smp = p.at LEFT JOIN {source} e ON e.smp = p.e AND e.ch = s.ch),
        {passed(out + "_f", out + "_x")}, {out}_r AS (SELECT ch, {n_} + {2 * edge} - 1 - i AS i, y AS x FROM {out}_f), {passed(out + "_b", out + "_r")},
        {out} AS (SELECT ch, {n_} + {2 * edge} - 1 - i - {edge} AS smp, y AS value FROM {out}_b WHERE i >= {edge} AND i < {n_} + {edge})"""


def _butter(band, kind: str):
    return design.butter(4, np.asarray(band) / 100.0, kind)


@query(f"WITH RECURSIVE {_filtfilt(*_butter((10.0, 40.0), 'pass'))} SELECT s.ch, round(var_pop(s.value), 3) + 0.0 AS before, round(var_pop(y.value), 3) + 0.0 AS after FROM sig s JOIN y ON y.ch = s.ch AND y.smp = s.smp GROUP BY s.ch")
def bandpass(v):
    """Variance of each channel before and after a band-pass of 10 to 40 Hz."""
    before, after = v.sig.var("smp"), v.sig.filtered((10.0, 40.0), "pass").var("smp")
    return rows(before.df.select("ch", F.col("value").alias("before")).join(after.df.select("ch", F.col("value").alias("after")), "ch"), 3)


@query(f"WITH RECURSIVE {_filtfilt(*_butter((10.0, 20.0), 'stop'))} SELECT ch, smp, round(value, 2) + 0.0 AS value FROM y")
def bandstop(v):
    """Every sample behind a band-stop of 10 to 20 Hz."""
    return rows(v.sig.filtered((10.0, 20.0)).df.select("ch", F.col("smp").cast("long").alias("smp"), "value"), 2)


@query(f"WITH RECURSIVE {_filtfilt(*design.cheby1(8, 0.05, 0.8 / 4), older=True)} SELECT ch, smp // 4 AS smp, round(value, 2) + 0.0 AS value FROM y WHERE smp % 4 = 0")
def decimate(v):
    """Every fourth sample behind the Chebyshev low-pass."""
    return rows(v.sig.decimated(4).df.select("ch", F.col("smp_idx").cast("long").alias("smp"), "value"), 2)


def _amplitude(source: str, name: str) -> str:
    """CTE: amplitude of the analytic signal, its imaginary part as a circular sum with the discrete Hilbert kernel (for an even number of samples)."""
    return f"""{name}_h AS (SELECT k, 2.0 / n / tan(pi() * k / n) AS h FROM (SELECT max(smp) + 1 AS n FROM {source}), range(1, (SELECT max(smp) + 1 FROM {source}), 2) r(k)),
        {name}_n AS (SELECT max(smp) + 1 AS n FROM {source}), {name}_i AS (SELECT x.ch, (x.smp + k) % n AS smp, sum(x.value * h) AS im FROM {source} x, {name}_h, {name}_n GROUP BY 1, 2),
        {name} AS (SELECT x.ch, x.smp, sqrt(x.value * x.value + im * im) AS value FROM {source} x JOIN {name}_i i ON i.ch = x.ch AND i.smp = x.smp)"""


_BANDS = {"theta": (4, 8), "alpha": (9, 14), "beta": (16, 26)}


@query("WITH RECURSIVE " + ", ".join(_filtfilt(*_butter(b, "pass"), out=f"{k}_y") + ", " + _amplitude(f"{k}_y", f"{k}_a") for k, b in _BANDS.items()) + " " + " UNION ALL ".join(f"SELECT '{k}' AS band, ch, round(avg(value), 3) + 0.0 AS value FROM {k}_a GROUP BY ch" for k in _BANDS))
def hilbert_bands(v):
    got = v.sig.hilbert_amplitude(_BANDS).mean("smp")
    return got.df.select(F.col("freqs").alias("band"), F.col("ch").cast("long").alias("ch"), (F.round("value", 3) + 0.0).alias("value"))


@query(f"WITH RECURSIVE {_filtfilt(*_butter((9, 14), 'pass'))}, {_amplitude('y', 'a')} SELECT 'alpha' AS band, ch, round(avg(value * value), 2) + 0.0 AS value FROM a GROUP BY ch")
def hilbert_power(v):
    got = v.sig.hilbert_power({"alpha": (9, 14)}).mean("smp")
    return got.df.select(F.col("freqs").alias("band"), F.col("ch").cast("long").alias("ch"), (F.round("value", 2) + 0.0).alias("value"))


@query("""WITH n AS (SELECT max(smp) + 1 AS n, (max(smp) + 1) // 4 AS m FROM sig), g AS (SELECT n, k, m, 2 * pi() * (j * 1.0 / m - smp * 1.0 / n) / 2 AS u, ch, j, value FROM sig, n, range((SELECT max(smp) + 1 FROM sig) // 4) r(j), (SELECT ((max(smp) + 1) // 4) // 2 AS k FROM sig))
          SELECT ch, j AS smp_idx, round(sum(value * CASE WHEN m % 2 = 0 THEN CASE WHEN abs(sin(u)) < 1e-12 THEN 2 * k + 1 ELSE sin((2 * k - 1) * u) / sin(u) + 2 * cos(2 * k * u) END ELSE CASE WHEN abs(sin(u)) < 1e-12 THEN 2 * k + 1 ELSE sin((2 * k + 1) * u) / sin(u) END END / n), 4) + 0.0 AS value FROM g GROUP BY ch, j""")
def fft_resample(v):
    """Every sample to a quarter of the rate; the SQL writes the Fourier sums out as Dirichlet kernels."""
    return rows(v.sig.resampled(50.0).df.select("ch", "smp_idx", "value"), 4)


# -- components and clusters

_TWO = """WITH RECURSIVE d AS (SELECT ch, smp, value FROM {s}), n AS (SELECT ch, max(smp) AS last FROM d GROUP BY ch), m AS (SELECT ch, avg(value) AS s FROM d WHERE smp < 10 GROUP BY ch),
          rev AS (SELECT d.ch, last - smp AS smp, value FROM d JOIN n USING (ch)), w AS (SELECT ch, avg(value) AS s FROM rev WHERE smp < 10 GROUP BY ch),
          f AS (SELECT ch, smp, 0.5e0 * (value - s) AS f, 0.975e0 * s + 0.025e0 * value AS s FROM d JOIN m USING (ch) WHERE smp = 0
                UNION ALL SELECT f.ch, d.smp, 0.5e0 * f.f + 0.5e0 * (d.value - f.s), 0.975e0 * f.s + 0.025e0 * d.value FROM f JOIN d ON d.ch = f.ch AND d.smp = f.smp + 1),
          g AS (SELECT ch, smp, 0.5e0 * (value - s) AS f, 0.975e0 * s + 0.025e0 * value AS s FROM rev JOIN w USING (ch) WHERE smp = 0
                UNION ALL SELECT g.ch, r.smp, 0.5e0 * g.f + 0.5e0 * (r.value - g.s), 0.975e0 * g.s + 0.025e0 * r.value FROM g JOIN rev r ON r.ch = g.ch AND r.smp = g.smp + 1)"""


@query(_TWO.format(s="sig") + """, b AS (SELECT a.ch, a.smp, abs(a.f * g.f / 2) AS b FROM (SELECT row_number() OVER (PARTITION BY ch ORDER BY smp) - 1 AS i, ch, smp, f FROM f) a JOIN (SELECT row_number() OVER (PARTITION BY ch ORDER BY smp) - 1 AS i, ch, f FROM g) g ON g.ch = a.ch AND g.i = a.i),
          t AS (SELECT ch, stddev_pop(b) AS t FROM b GROUP BY ch), h AS (SELECT ch, smp FROM b JOIN t USING (ch) WHERE b > t)
          SELECT DISTINCT s.ch AS channel, s.smp AS sample FROM sig s JOIN h ON h.ch = s.ch AND s.smp >= h.smp - 20 AND s.smp < h.smp + 20""")
def find_blinks(v):
    """Samples near a large product of forward and backward averages."""
    s = v.sig.df.select(F.col("ch").alias("channel"), F.col("smp").alias("sample"), "value")
    return rows(decomposition.blinks(s, "channel", 20))


@query("SELECT i::BIGINT AS i, j::BIGINT AS j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END::DOUBLE AS cov FROM range(4) a(i), range(4) b(j)")
def pca_project(v):
    """Whitened components are uncorrelated and of variance 1: their whole covariance."""
    s = v.sig.df.select(F.col("ch").alias("channel"), F.col("smp").alias("sample"), "value")
    _, comps = decomposition.pca(s)
    cov = decomposition.lagged_covariance(comps.withColumnRenamed("component", "channel"))[0]
    return rows(v.spark.createDataFrame([(i, j, float(cov[i, j])) for i in range(4) for j in range(4)], "i long, j long, cov double"), 6)


@query("""WITH e AS (SELECT vec_id, max(v) FILTER (WHERE k = 0) AS x, max(v) FILTER (WHERE k = 1) AS y FROM emb GROUP BY vec_id),
          r AS (SELECT x, y, 0.8 * x - 0.6 * y + 0.01 * x * x AS p, 0.6 * x + 0.8 * y AS q FROM e), m AS (SELECT sum(x * p) AS a, sum(x * q) AS b, sum(y * p) AS c, sum(y * q) AS d FROM r),
          t AS (SELECT atan2(b - c, a + d) AS t FROM m)
          SELECT 0 AS i, 0 AS j, round(cos(t), 7) + 0.0 AS r FROM t UNION ALL SELECT 0, 1, round(sin(t), 7) + 0.0 FROM t UNION ALL SELECT 1, 0, round(-sin(t), 7) + 0.0 FROM t UNION ALL SELECT 1, 1, round(cos(t), 7) + 0.0 FROM t""")
def procrustes_plane(v):
    """The rotation of the plane that best takes points to where they went; from the sums of products."""
    e = v.table("embeddings").select(F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    e = e.select("x", "y", (0.8 * F.col("x") - 0.6 * F.col("y") + 0.01 * F.col("x") * F.col("x")).alias("p"), (0.6 * F.col("x") + 0.8 * F.col("y")).alias("q"))
    a, b, c, d = e.agg(*(F.sum(F.col(m) * F.col(n)) for m in "xy" for n in "pq")).first()
    r = algebra.procrustes_of(np.array([[a, b], [c, d]]))
    return v.spark.createDataFrame([(i, j, round(float(r[i, j]), 7) + 0.0) for i in range(2) for j in range(2)], "i int, j int, r double")


def _tfce_sql(sides: str) -> str:
    return f"""WITH RECURSIVE x AS ({sides}), lim AS (SELECT side, c, min(x) AS lo FROM x WHERE x > 0 GROUP BY side, c),
        t AS (SELECT x.side, x.c, cell, k, lo + k * 0.25e0 AS t FROM x JOIN lim ON lim.side = x.side AND lim.c = x.c, range(60) r(k) WHERE x >= lo + k * 0.25e0),
        e AS (SELECT p.side, p.c, p.k, p.cell AS a, q.cell AS b FROM t p JOIN t q ON p.side = q.side AND p.c = q.c AND p.k = q.k AND (q.cell IN (p.cell + 5, p.cell - 5) OR (q.cell = p.cell + 1 AND q.cell % 5 > 0) OR (q.cell = p.cell - 1 AND p.cell % 5 > 0))),
        r AS (SELECT side, c, k, cell, cell AS root FROM t UNION SELECT e.side, e.c, e.k, e.b, r.root FROM r JOIN e ON e.side = r.side AND e.c = r.c AND e.k = r.k AND e.a = r.cell),
        m AS (SELECT side, c, k, cell, min(root) AS root FROM r GROUP BY 1, 2, 3, 4), s AS (SELECT side, c, k, root, count(*) AS n FROM m GROUP BY 1, 2, 3, 4),
        g AS (SELECT m.side, m.c, m.cell, sum(pow(n, 2e0 / 3e0) * t * t * 0.25) * m.side AS v FROM m JOIN s ON s.side = m.side AND s.c = m.c AND s.k = m.k AND s.root = m.root JOIN t ON t.side = m.side AND t.c = m.c AND t.k = m.k AND t.cell = m.cell GROUP BY 1, 2, 3)"""


@query(_tfce_sql("SELECT 1 AS side, c, b * 5 + a AS cell, value / 50 AS x FROM cube") + " SELECT c.a, c.b, c.c, round(coalesce(v, 0), 3) + 0.0 AS value FROM cube c LEFT JOIN g ON g.c = c.c AND g.cell = c.b * 5 + c.a")
def tfce_2d(v):
    """Cluster enhancement of every map."""
    return rows(clusters.tfce(v.cube.transpose("c", "b", "a").map(lambda x: x / 50), ["b", "a"], (20, 5), dt=0.25, tail=1).transpose("a", "b", "c"), 3)


@query(_tfce_sql("SELECT s AS side, c, b * 5 + a AS cell, s * (value - 100) / 50 AS x FROM cube, (VALUES (1), (-1)) y(s)") + ", h AS (SELECT c, cell, sum(v) AS v FROM g GROUP BY 1, 2) SELECT c.a, c.b, c.c, round(coalesce(v, 0), 3) + 0.0 AS value FROM cube c LEFT JOIN h ON h.c = c.c AND h.cell = c.b * 5 + c.a")
def tfce_both_sides(v):
    """Both signs enhanced apart."""
    return rows(clusters.tfce_signed(v.cube.transpose("c", "b", "a").map(lambda x: (x - 100) / 50), ["b", "a"], (20, 5), dt=0.25).transpose("a", "b", "c"), 3)
