"""Cubes with a time axis of even steps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cube import Cube


#: Samples of a series that a task works on at once.
CHUNK = 1 << 19

#: Members of an ensemble that a task adds up.
MEMBERS = 10


def _pairs(got):
    """A kernel's labels and rows: of a dict, or made one after the other."""
    return got.items() if isinstance(got, dict) else got


@dataclass(frozen=True, eq=False)
class TimeCube(Cube):
    """A cube one axis of which, ``tdim``, is time in seconds at ``samplerate`` a second."""

    tdim: str = "time"
    samplerate: float = 1.0

    def __post_init__(self):
        super().__post_init__()
        if self.tdim not in self.dims:
            raise ValueError(f"no time axis {self.tdim!r} among {self.dims}")
        if not self.samplerate > 0:
            raise ValueError("the sample rate must be positive")

    @staticmethod
    def of(cube: Cube, tdim: str, samplerate: float) -> TimeCube:
        return TimeCube(cube.df, cube.dims, cube.value, cube.attrs, cube.axis_attrs, tdim=tdim, samplerate=float(samplerate))

    def with_(self, df, dims=None, value=None) -> Cube:
        """Without its time axis it is a plain cube."""
        dims = self.dims if dims is None else dims
        if self.tdim in dims:
            return super().with_(df, dims, value)
        return Cube(df, dims, value or self.value, self.attrs, {k: v for k, v in self.axis_attrs.items() if k in dims})

    # -- series kernels

    def apply(self, kernel: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], samplerate: float | None = None) -> TimeCube:
        """``kernel(rows, times) -> (rows, times)`` over whole series, one at a time."""
        return self.apply_named(lambda rows, t: {None: kernel(rows, t)}, None, samplerate)

    def apply_named(self, kernel, name: str | None, samplerate: float | None = None, label_type: T.DataType | None = None) -> TimeCube:
        """``kernel(rows, times) -> {label: (rows, times)}`` or pairs of them; the labels become a new first axis ``name``."""
        series = self.to_series(self.tdim)
        keys = self.keys(self.tdim)
        fields = [series.schema[k] for k in keys]
        if name:
            fields = [T.StructField(f"{name}_idx", T.IntegerType()), T.StructField(name, label_type or T.DoubleType()), *fields]
        array = T.ArrayType(T.DoubleType())
        schema = T.StructType([*fields, T.StructField("labels", array), T.StructField("values", array)])
        dims = ((name,) if name else ()) + self.dims

        def run(batches):
            for batch in batches:
                for r in range(batch.num_rows):  # a series and a label at a time
                    times, values = (np.asarray(batch.column(len(keys) + k)[r].values.to_numpy(zero_copy_only=False), float) for k in (0, 1))
                    rest = [batch.column(j)[r].as_py() for j in range(len(keys))]
                    for k, (label, (rows, new)) in enumerate(_pairs(kernel(values[None], times))):
                        cells = ([k, label] if name else []) + rest + [new, rows[0]]
                        yield pa.RecordBatch.from_arrays([pa.array([c], type=f) for c, f in zip(cells, arrow.types, strict=True)], names=arrow.names)

        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        done = series.mapInArrow(run, schema)
        from ..operators.reshape import from_series

        plain = Cube(self.df, self.dims, self.value, self.attrs, self.axis_attrs)
        rest = tuple(d for d in dims if d != self.tdim)
        shape = replace(plain, df=done.select(*(c for d in rest for c in (f"{d}_idx", d)), F.lit(0).alias(f"{self.tdim}_idx"), F.lit(0.0).alias(self.tdim), F.lit(0.0).alias(self.value)), dims=(*rest, self.tdim), _lengths={})
        got = from_series(done, shape, self.tdim)
        return TimeCube.of(got.with_(got.df, dims), self.tdim, samplerate or self.samplerate)

    def apply_chunked(self, kernel, chunk: int, halo: int, name: str | None = None, label_type: T.DataType | None = None) -> TimeCube:
        """``kernel(rows, times) -> {label: rows}`` (or pairs of them) of the same length, over runs of ``chunk`` positions with ``halo`` more at
        either side, which are cut off again: no task holds a whole series, however long. Exact where what lies beyond
        the halo doesn't reach the run."""
        from pyspark.sql.pandas.types import to_arrow_schema

        keys, pos = self.keys(self.tdim), F.col(f"{self.tdim}_idx")
        home, rest = F.floor(pos / chunk), pos % chunk
        copies = F.array_compact(F.array(home, F.when((rest < halo) & (home > 0), home - 1), F.when(rest >= chunk - halo, home + 1)))
        cell = F.struct(pos.alias("i"), F.col(self.tdim).cast("double").alias("t"), F.col(self.value).cast("double").alias("v"))
        runs = self.df.withColumn("__chunk", F.explode(copies)).groupBy(*keys, "__chunk").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
        series = runs.select(*keys, "__chunk", *(F.col(f"cells.{n}").alias(n) for n in "itv"))
        array = T.ArrayType(T.DoubleType())
        extra = [T.StructField(f"{name}_idx", T.IntegerType()), T.StructField(name, label_type or T.DoubleType())] if name else []
        schema = T.StructType([*extra, *(series.schema[k] for k in keys), T.StructField("i", T.ArrayType(T.IntegerType())), T.StructField("t", array), T.StructField("v", array)])
        arrow, at_chunk = to_arrow_schema(schema), len(keys)

        def run(batches):
            for batch in batches:
                for r in range(batch.num_rows):  # a run and a label at a time
                    i, t, v = (np.asarray(batch.column(at_chunk + k)[r].values.to_numpy(zero_copy_only=False)) for k in (1, 2, 3))
                    own = i // chunk == batch.column(at_chunk)[r].as_py()
                    if not own.any():
                        continue
                    rest = [batch.column(j)[r].as_py() for j in range(len(keys))]
                    for k, (label, rows) in enumerate(_pairs(kernel(v[None], t))):
                        cells = ([k, label] if name else []) + rest + [i[own], t[own], rows[0][own]]
                        yield pa.RecordBatch.from_arrays([pa.array([c], type=f) for c, f in zip(cells, arrow.types, strict=True)], names=arrow.names)

        done = series.mapInArrow(run, schema)
        names = [f.name for f in schema.fields[:-3]]
        cells = done.select(*names, F.explode(F.arrays_zip("i", "t", "v")).alias("x"))
        dims = ((name,) if name else ()) + self.dims
        df = cells.select(*names, F.col("x.i").alias(f"{self.tdim}_idx"), F.col("x.t").alias(self.tdim), F.col("x.v").alias(self.value))
        return TimeCube(df.select(*(c for d in dims for c in (f"{d}_idx", d)), self.value), dims, self.value, self.attrs, self.axis_attrs, tdim=self.tdim, samplerate=self.samplerate)

    # -- time operators

    def remove_buffer(self, duration: float | tuple[float, float]) -> TimeCube:
        """Cut seconds off both ends (or each its own)."""
        begin, end = duration if isinstance(duration, tuple | list) else (duration, duration)
        if begin < 0 or end < 0:
            raise ValueError("a buffer can't be negative")
        b, e, t = int(np.rint(self.samplerate * begin)), int(np.rint(self.samplerate * end)), f"{self.tdim}_idx"
        test = F.col(t) >= b
        if e:
            test = test & (F.col(t) < self.length(self.tdim) - e)
        return self.with_(self.df.where(test).withColumn(t, F.col(t) - b))

    def baseline_corrected(self, base: tuple[float, float]) -> TimeCube:
        """Less each series' mean over times from ``base[0]`` to ``base[1]``, both included."""
        t, v, keys = F.col(self.tdim), F.col(self.value), [f"{d}_idx" for d in self.dims if d != self.tdim]
        inside = F.when((t >= base[0]) & (t <= base[1]), v)
        # partial sums first; the means, a row a series, are joined back
        means = self.df.groupBy(*keys).agg(F.avg(inside).alias("__mean"))
        df = self.df.join(means, keys) if keys else self.df.crossJoin(F.broadcast(means))  # one row
        return self.with_(df.withColumn(self.value, v - F.col("__mean")).select(*self.df.columns))

    def filtered(self, band, kind: str = "stop", order: int = 4, chunk: int = CHUNK) -> TimeCube:
        """Zero-phase Butterworth filter, in chunks whose halo is as long as the filter rings (to 1e-12)."""
        from ..functions.design import butter
        from ..functions.filters import buttfilt

        sr = self.samplerate
        _, a = butter(order, np.asarray(band, float) / (sr / 2), kind)
        ring = int(np.ceil(np.log(1e-12) / np.log(min(np.abs(np.roots(a)).max(), 1 - 1e-6))))
        return self.apply_chunked(lambda rows, t: {None: buttfilt(rows, band, sr, kind, order)}, max(chunk, 4 * ring), ring + 3 * len(a))

    def resampled(self, rate: float, pad: bool = False) -> TimeCube:
        """Fourier resampling. The rate asked for is kept; times show the step that rounding gives."""
        from ..functions.filters import resampled

        sr = self.samplerate

        def kernel(rows, t):
            out = resampled(rows, sr, rate, pad)
            step = (t[1] - t[0]) if len(t) > 1 else 1 / sr
            return out, t[0] + np.arange(out.shape[-1]) * step * rows.shape[-1] / out.shape[-1]

        return self.apply(kernel, samplerate=rate)

    def decimated(self, q: int, order: int | None = None, kind: str = "iir") -> TimeCube:
        """Every q-th sample behind a low-pass, which runs in chunks whose halo is as long as it rings (to 1e-12)."""
        from ..functions.design import cheby1
        from ..functions.filters import decimate, smooth

        if not isinstance(q, int | np.integer) or kind not in ("iir", "fir"):
            decimate(np.zeros((1, 1)), q, order, kind)  # says what is wrong
        if kind == "iir":
            _, a = cheby1(8 if order is None else order, 0.05, 0.8 / q)
            halo = int(np.ceil(np.log(1e-12) / np.log(min(np.abs(np.roots(a)).max(), 1 - 1e-6)))) + 3 * len(a)
        else:
            halo = (30 if order is None else order) + 1
        got = self.apply_chunked(lambda rows, t: {None: smooth(rows, q, order, kind)}, max(CHUNK, 4 * halo), halo)
        pos = F.col(f"{self.tdim}_idx")
        kept = got.with_(got.df.where(pos % q == 0).withColumn(f"{self.tdim}_idx", F.floor(pos / q).cast("int")))
        return TimeCube.of(kept, self.tdim, self.samplerate / q)

    def convolved(self, kernel, chunk: int = CHUNK) -> TimeCube:
        """Direct convolution with a kernel in the driver's memory, the middle as long as the series; in chunks with the kernel's halo."""
        from ..functions.filters import centered

        k = np.asarray(kernel, float)
        return self.apply_chunked(lambda rows, t: {None: np.stack([centered(np.convolve(r, k), max(len(r), len(k)))[: len(r)] for r in rows])}, max(chunk, 2 * len(k)), len(k))

    def wavelet_closed(self, freqs, width: float = 5.0, what: str = "power", name: str = "freqs", chunk: int = CHUNK) -> TimeCube:
        """Power or phase by the closed form of Morlet wavelets, direct convolution; on a new first axis, in chunks."""
        from ..functions.wavelets import phase_power_closed

        freqs, sr = [float(f) for f in np.atleast_1d(freqs)], self.samplerate
        if what not in ("power", "phase"):
            raise ValueError("what is 'power' or 'phase'")
        longest = int(7 * width / (2 * np.pi * min(freqs)) * sr) + 2
        return self.apply_chunked(lambda rows, t: dict(zip(freqs, phase_power_closed(rows, freqs, sr, width)[what == "power"], strict=True)), max(chunk, 2 * longest), longest, name)

    def wavelet(self, freqs, widths=5.0, windows=7.0, complete: bool = True, what: str = "power", name: str = "freqs", chunk: int = CHUNK) -> TimeCube:
        """Power or phase at each frequency by Morlet wavelets, on a new first axis; in chunks with a halo of the longest wavelet."""
        from ..functions.wavelets import morlet_kernels, phase_powers

        freqs, sr = [float(f) for f in np.atleast_1d(freqs)], self.samplerate
        if what not in ("power", "phase"):
            raise ValueError("what is 'power' or 'phase'")

        def kernel(rows, t):
            return zip(freqs, (x[what == "power"] for x in phase_powers(rows, freqs, sr, widths, windows, complete)), strict=True)

        longest = max(map(len, morlet_kernels(freqs, widths, sr, windows, complete)))
        return self.apply_chunked(kernel, max(chunk, 2 * longest), longest, name)

    def hilbert_amplitude(self, bands: dict[str, tuple[float, float]] | None = None, pad: bool = False, name: str = "freqs") -> TimeCube:
        """Amplitude of the analytic signal in each band, on a new first axis."""
        from ..functions.filters import hilbert_amplitude

        sr = self.samplerate
        return self.apply_named(lambda rows, t: {k: (v, t) for k, v in hilbert_amplitude(rows, sr, bands, pad).items()}, name, label_type=T.StringType())

    def hilbert_power(self, bands=None, pad: bool = False, name: str = "freqs") -> TimeCube:
        got = self.hilbert_amplitude(bands, pad, name)
        return got.with_(got.df.withColumn(got.value, F.col(got.value) ** 2))

    def swt(self, level: int, name: str = "level") -> TimeCube:
        """Details of levels level..1 and, as label 0, the coarsest approximation, on a new first axis."""
        from ..functions.wavelets import swt

        def kernel(rows, t):
            coefs = swt(rows, level)
            yield 0.0, (coefs[0][0], t)
            for i, (_, d) in enumerate(coefs):
                yield float(level - i), (d, t)

        return self.apply_named(kernel, name)

    def emd(self, max_modes: int = 10, name: str = "mode") -> TimeCube:
        """Empirical modes of each series; the residue is the last of its modes, so series may differ in their number."""
        from ..functions.emd import emd

        def kernel(rows, t):
            modes = [emd(r, max_modes) for r in rows]
            most = max(map(len, modes))
            return {float(k): (np.stack([m[k] if k < len(m) else np.zeros(len(t)) for m in modes]), t) for k in range(most)}

        return self.apply_named(kernel, name)

    def instantaneous(self, what: str = "frequency") -> TimeCube:
        from ..functions.emd import instantaneous

        sr, at = self.samplerate, ("frequency", "amplitude", "phase").index(what)
        return self.apply(lambda rows, t: (instantaneous(rows, sr)[at], t))

    def eemd(self, noise_std: float = 0.2, num_ensembles: int = 100, num_sifts: int = 10, seed: int = 0, name: str = "mode") -> TimeCube:
        """Ensemble modes: a task adds up ``MEMBERS`` members of a series, and their sums are added up in stretches."""
        from ..functions.emd import eemd_member
        from .lineage import materialise

        series, keys = materialise(self.to_series(self.tdim)), self.keys(self.tdim)
        starts = F.explode(F.sequence(F.lit(0), F.lit(num_ensembles - 1), F.lit(MEMBERS)))
        tasks = max(1, series.count() * -(-num_ensembles // MEMBERS))
        array = T.ArrayType(T.DoubleType())
        schema = T.StructType([T.StructField(f"{name}_idx", T.IntegerType()), *(series.schema[k] for k in keys), T.StructField("__from", T.IntegerType()), T.StructField("labels", array), T.StructField("values", array)])
        names = schema.names

        def run(batches):
            for pdf in batches:
                for r in pdf.to_dict("records"):
                    x, total = np.asarray(r["values"], float), 0.0
                    for m in range(r["__first"], min(r["__first"] + MEMBERS, num_ensembles)):
                        total = total + eemd_member(x, noise_std, num_sifts, seed * 1_000_003 + m)
                    for k, mode in enumerate(total):
                        for at in range(0, len(x), 1 << 16):
                            yield pd.DataFrame([[k, *(r[c] for c in keys), at, r["labels"][at : at + (1 << 16)], mode[at : at + (1 << 16)]]], columns=names)

        def add_up(pdf):
            return pdf.iloc[:1].assign(values=[sum(pdf["values"]) / num_ensembles])

        parts = series.withColumn("__first", starts).repartition(min(tasks, 10_000)).mapInPandas(run, schema)
        means = parts.groupBy(f"{name}_idx", *keys, "__from").applyInPandas(add_up, schema)
        cells = means.select(f"{name}_idx", *keys, "__from", F.posexplode(F.arrays_zip("labels", "values")).alias("__at", "__x"))
        df = cells.select(F.col(f"{name}_idx"), F.col(f"{name}_idx").cast("double").alias(name), *keys, (F.col("__from") + F.col("__at")).alias(f"{self.tdim}_idx"), F.col("__x.labels").alias(self.tdim), F.col("__x.values").alias(self.value))
        dims = (name, *(d for d in self.dims if d != self.tdim), self.tdim)
        return TimeCube(df.select(*(c for d in dims for c in (f"{d}_idx", d)), self.value), dims, self.value, self.attrs, {}, tdim=self.tdim, samplerate=self.samplerate)
