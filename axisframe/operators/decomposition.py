"""Components of channels: covariances are Spark aggregates, the algebra on matrices of channels is done on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.algebra import ar_covariance, autoregression, clean_component, crlb_isr, running_averages, wasobi, whitening
from ..plans.lineage import from_driver


def covariance(cells: DataFrame, var: str, obs: str, value: str = "value", ddof: int = 1) -> DataFrame:
    """(a, b, cov) of all pairs of variables a <= b over observations.

    Each observation's cells are gathered once; tasks sum products of whole blocks of observations by BLAS, shifted by
    the first of them so that large means cost no digits, and the d x d sums of tasks are merged by moments. Variables
    missing from an observation take no part in it, as if it weren't there for their pairs.
    """
    names = [r[0] for r in cells.select(var).distinct().orderBy(var).collect()]
    d, kind = len(names), cells.schema[var].dataType
    place = {x: i for i, x in enumerate(names)}
    whole = cells.groupBy(obs).agg(F.collect_list(F.struct(F.col(var).alias("k"), F.col(value).cast("double").alias("v"))).alias("cells"))

    def run(batches):
        shift, n, sx, sxy = None, np.zeros((d, d)), np.zeros((d, d)), np.zeros((d, d))
        for batch in batches:
            lists = batch.column(0)
            inner, ends = lists.flatten(), np.diff(lists.offsets.to_numpy())
            x = np.full((len(lists), d), np.nan)
            x[np.repeat(np.arange(len(lists)), ends), [place[k] for k in inner.field("k").to_pylist()]] = inner.field("v").to_numpy(zero_copy_only=False)
            there = ~np.isnan(x)
            if shift is None:
                shift = np.where(there.any(0), np.nan_to_num(x[there.argmax(0), np.arange(d)]), 0.0)
            y, m = np.where(there, x - shift, 0.0), there.astype(float)
            n, sx, sxy = n + m.T @ m, sx + y.T @ m, sxy + y.T @ y  # of a pair: observations that have both, sum of its first, of products
        if shift is not None:
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()]) for a in (shift, n, sx, sxy)], ["shift", "n", "sx", "sxy"])

    parts = whole.select("cells").mapInArrow(run, "shift binary, n binary, sx binary, sxy binary").collect()  # d x d blocks, one a task
    n, mean, moment = np.zeros((d, d)), np.zeros((d, d)), np.zeros((d, d))  # pair (i, j): count, mean of i, centred sum of products
    for r in parts:
        shift, m, sx, sxy = (np.frombuffer(r[k]).reshape(-1, d) for k in ("shift", "n", "sx", "sxy"))
        some = np.where(m > 0, m, 1)
        here = shift[0][:, None] + sx / some
        gap, both = here - mean, n + m
        moment = moment + (sxy - sx * sx.T / some) + gap * gap.T * n * m / np.where(both > 0, both, 1)
        mean = np.where(both > 0, mean + gap * m / np.where(both > 0, both, 1), 0)
        n = both
    got = [(names[i], names[j], float(moment[i, j] / (n[i, j] - ddof))) for i in range(d) for j in range(i, d) if n[i, j] > ddof]
    return cells.sparkSession.createDataFrame(got, T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("cov", T.DoubleType())]))


def gram(series: DataFrame, values: str, d: int, lags: int = 0, center: bool = True) -> np.ndarray:
    """(lags + 1, d, d) lagged covariances of rows of arrays (one row: the d channels at one time, ``t``, in chunks).

    ``series``: (chunk, start, ``values`` array of d-vectors flattened row-major by time, with ``lags`` rows of halo
    after the chunk, ``own`` rows counted). Each task sums its own blocks by BLAS; only d x d sums come back.
    """

    def run(batches):
        total, n, s = np.zeros((lags + 1, d, d)), np.zeros(lags + 1), np.zeros(d)
        for pdf in batches:
            for own, flat in zip(pdf["own"], pdf[values], strict=True):
                x = np.asarray(flat, float).reshape(-1, d)
                s += x[:own].sum(0)
                for k in range(lags + 1):
                    m = min(own, len(x) - k)
                    if m > 0:
                        total[k] += x[:m].T @ x[k : k + m]
                        n[k] += m
        yield pd.DataFrame({"n": [n.tobytes()], "s": [s.tobytes()], "total": [total.tobytes()]})

    parts = series.mapInPandas(run, "n binary, s binary, total binary").collect()  # one d x d block a task
    n = sum(np.frombuffer(r["n"]) for r in parts)
    total = sum(np.frombuffer(r["total"]) for r in parts).reshape(lags + 1, d, d)
    mean = sum(np.frombuffer(r["s"]) for r in parts) / n[0]
    cov = total / n[:, None, None]
    return cov - np.outer(mean, mean) if center else cov


def chunks(signal: DataFrame, channel: str, sample: str, value: str, size: int = 16_384, halo: int = 0) -> DataFrame:
    """Channel vectors by time in chunks for :func:`gram`: no row holds more than size + halo samples of all channels."""
    home = F.floor(F.col(sample) / size)
    copies = F.array(home, F.when((F.col(sample) % size < halo) & (home > 0), home - 1)) if halo else F.array(home)
    cells = signal.withColumn("chunk", F.explode(F.array_compact(copies)))
    cell = F.struct(F.col(sample).alias("s"), F.col(channel).alias("c"), F.col(value).cast("double").alias("v"))
    own = F.countDistinct(F.when(F.floor(F.col(sample) / size) == F.col("chunk"), F.col(sample)))
    return cells.groupBy("chunk").agg(F.array_sort(F.collect_list(cell)).alias("cells"), own.cast("int").alias("own")).select("chunk", "own", F.transform("cells", lambda x: x.v).alias("values"))


def lagged_covariance(signal: DataFrame, channel: str = "channel", sample: str = "sample", value: str = "value", lags: int = 0, center: bool = True) -> np.ndarray:
    d = signal.agg(F.countDistinct(channel)).first()[0]
    return gram(chunks(signal, channel, sample, value, halo=lags), "values", d, lags, center)


def project(signal: DataFrame, weights: np.ndarray, channel: str = "channel", sample: str = "sample", value: str = "value", name: str = "component") -> DataFrame:
    """(component, sample, value): rows of ``weights`` over the channels in the order of their numbers."""
    channels = [r[0] for r in signal.select(channel).distinct().orderBy(channel).collect()]
    rows = [(int(i), c, float(w)) for i, row in enumerate(weights) for c, w in zip(channels, row, strict=True)]
    table = from_driver(signal.sparkSession, rows, f"{name} int, {channel} {signal.schema[channel].dataType.simpleString()}, __w double")
    return signal.join(table, channel).groupBy(name, sample).agg(F.sum(F.col(value) * F.col("__w")).alias(value))  # components x channels rows


def pca(signal: DataFrame, ncomps: int | None = None, eigratio: float = 1e6, **cols) -> tuple[np.ndarray, DataFrame]:
    """(W, components): whitening by the channel covariance; the data are not centred when projected."""
    w = whitening(lagged_covariance(signal, lags=0, **cols)[0], ncomps, eigratio)
    return w, project(signal, w, **cols)


def ica(signal: DataFrame, ar_max: int = 10, rmax: float = 0.99, eps0: float = 5e-7, **cols) -> tuple[np.ndarray, np.ndarray, np.ndarray, DataFrame]:
    """(W, first W, ISR bound, sources) by weighted joint diagonalisation of lagged covariances."""
    cov = lagged_covariance(signal, lags=ar_max, **cols)
    w, first = wasobi(cov, rmax, eps0)
    acov = np.einsum("ia,kab,ib->ik", w, (cov + cov.transpose(0, 2, 1)) / 2, w)
    models = [autoregression(r, rmax) for r in acov]
    return w, first, crlb_isr([p for p, _ in models], [v for _, v in models]), project(signal, w, **cols)


@dataclass
class ArtifactCleaner:
    """PCA, ICA, choice and cleaning of components, and the way back to channels."""

    signal: DataFrame
    samplerate: float
    ar_max: int = 10
    ncomps: int | None = None
    eigratio: float = 1e6
    unmixing: np.ndarray = field(init=False)
    mixing: np.ndarray = field(init=False)
    components: DataFrame = field(init=False)
    chosen: list[int] = field(init=False, default_factory=list)

    def __post_init__(self):
        cov = lagged_covariance(self.signal, lags=self.ar_max)
        white = whitening(cov[0], self.ncomps, self.eigratio)
        w = wasobi(np.einsum("ia,kab,jb->kij", white, cov, white))[0] @ white
        mixing = np.linalg.pinv(w)
        order = np.argsort(np.abs(mixing).sum(0))[::-1]  # the loudest component first
        self.unmixing, self.mixing = w[order], mixing[:, order]
        self.components = project(self.signal, self.unmixing)

    def loading(self, component: int) -> np.ndarray:
        return self.mixing[:, component]

    def pick(self, channels: list[int] = (0, 1), factor: float = 1.5) -> list[int]:
        """Components that load on the eye channels beyond ``factor`` standard deviations, among components and among channels."""
        a = np.abs(self.mixing)
        by_comp, by_chan = a.mean(1, keepdims=True) + factor * a.std(1, keepdims=True), a.mean(0) + factor * a.std(0)
        good = ((a > by_comp) & (a > by_chan))[list(channels)].any(0)
        self.chosen = [int(i) for i in np.flatnonzero(good)]
        return self.chosen

    def clean(self, components: list[int] | None = None, ratio: float = 2.5) -> DataFrame:
        """Components with those chosen cleaned, each by one task."""
        chosen, radius = list(self.chosen if components is None else components), int(np.rint(self.samplerate * 0.1))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("stretch")
            cleaned = clean_component(np.concatenate(pdf["value"].to_list()), ratio, radius)[0]
            return pdf[["component", "sample"]].assign(value=np.split(cleaned, np.cumsum(pdf["value"].map(len))[:-1]))

        # a component moves as arrays of its stretches, several times smaller than its rows
        hit, kind = F.col("component").isin(chosen), self.components.schema["sample"].dataType.simpleString()
        cells = F.array_sort(F.collect_list(F.struct("sample", "value")))
        stretches = self.components.where(hit).groupBy("component", F.floor(F.col("sample") / 65_536).alias("stretch")).agg(cells.alias("x")).select("component", "stretch", "x.sample", "x.value")
        done = stretches.groupBy("component").applyInPandas(run, f"component int, sample array<{kind}>, value array<double>")
        done = done.select("component", F.explode(F.arrays_zip("sample", "value")).alias("x")).select("component", "x.sample", "x.value")
        self.components = self.components.where(~hit).unionByName(done)
        return self.components

    def corrected(self) -> DataFrame:
        """(channel, sample, value) from the components."""
        channels = [r[0] for r in self.signal.select("channel").distinct().orderBy("channel").collect()]
        got = project(self.components, self.mixing, channel="component", name="__at")
        names = from_driver(self.signal.sparkSession, list(enumerate(channels)), f"__at int, channel {self.signal.schema['channel'].dataType.simpleString()}")
        return got.join(names, "__at").select("channel", "sample", "value")


def remove_artifacts(signal: DataFrame, samplerate: float, channels=(0, 1), factor: float = 1.5, ratio: float = 2.5, **kw) -> DataFrame:
    """All steps in one: decompose, pick by the eye channels, clean, and back."""
    c = ArtifactCleaner(signal, samplerate, **kw)
    c.pick(list(channels), factor)
    c.clean(ratio=ratio)
    return c.corrected()


def blinks(series: DataFrame, key: str, radius: int, fast: float = 0.5, slow: float = 0.975, threshold: float | None = None) -> DataFrame:
    """(key, sample) of samples near a blink, of (key, sample, value).

    The averages run in chunks whose halo is as long as they remember (to 1e-12). As in
    :func:`axisframe.functions.algebra.find_blinks` the forward average at a place is multiplied with the backward one
    that far from the end. The standard deviation of the product, if no threshold is given, is an aggregate; what is
    near a blink is spread out from each.
    """
    from ..plans.cube import Cube
    from ..plans.timecube import CHUNK, TimeCube

    cells = series.select(F.lit(0).alias("k_idx"), F.col(key).alias("k"), F.col("sample").cast("int").alias("s_idx"), F.col("sample").alias("s"), "value")
    halo = int(np.ceil(np.log(1e-12) / np.log(max(fast, slow)))) + 10
    cube = TimeCube.of(Cube(cells, ("k", "s")), "s", 1.0)
    averages = [cube.apply_chunked(f, max(CHUNK, 4 * halo), halo).df for f in (
        lambda rows, t: {None: np.stack([running_averages(r, fast, slow) for r in rows])},
        lambda rows, t: {None: np.stack([running_averages(r[::-1], fast, slow)[::-1] for r in rows])},
    )]
    last = cells.groupBy("k").agg(F.max("s_idx").alias("__last"))
    back = averages[1].join(last, "k").select("k", (F.col("__last") - F.col("s_idx")).alias("s_idx"), F.col("value").alias("__back"))
    both = averages[0].join(back, ["k", "s_idx"]).select("k", "s_idx", F.abs(F.col("value") * F.col("__back") / 2).alias("value"))
    limits = both.groupBy("k").agg(F.stddev_pop("value").alias("__sd"), F.max("s_idx").alias("__last"))
    hits = both.join(limits, "k").where(F.col("value") > (F.col("__sd") if threshold is None else F.lit(float(threshold))))
    near = hits.select("k", F.explode(F.sequence(F.greatest(F.col("s_idx") - radius, F.lit(0)), F.least(F.col("s_idx") + radius - 1, "__last"))).alias("sample")).distinct()
    return near.select(F.col("k").alias(key), F.col("sample").cast(series.schema["sample"].dataType).alias("sample"))


def segment_correlation(a: DataFrame, b: DataFrame, on: list[str], keys: list[str]) -> DataFrame:
    """Correlation of two signals' values over their common cells, by ``keys``."""
    both = a.withColumnRenamed("value", "__a").join(b.withColumnRenamed("value", "__b"), on)
    return both.groupBy(*keys).agg(F.corr("__a", "__b").alias("corr"))


__all__ = ["ArtifactCleaner", "ar_covariance", "blinks", "chunks", "covariance", "gram", "ica", "lagged_covariance", "pca", "project", "remove_artifacts", "segment_correlation"]
