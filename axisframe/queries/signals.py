"""Queries over signals, events and epochs."""

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.wavelets import morlet_kernels
from ..operators import epochs
from ..plans.cube import Cube
from ..plans.timecube import CHUNK
from .registry import query, rows

_EPOCHS = """WITH e AS (SELECT s.ch AS channel, o.ev AS event, s.smp - o.smp AS k, s.value FROM onset o, range(-20, 21) r(k) JOIN sig s ON s.smp = o.smp + r.k)"""


def _epochs(v, **kw):
    return epochs.epochs(v.onsets, v.signal, 200.0, -0.1, 0.1, in_seconds=False, **kw)


@query(_EPOCHS + " SELECT channel, event, k + 20 AS time_idx, value FROM e")
def epochs_cells(v):
    return rows(_epochs(v).df.select("channel", "event", "time_idx", "value"))


@query(_EPOCHS + " SELECT channel, k + 20 AS time_idx, round(k / 200.0, 6) + 0.0 AS time, round(avg(value), 6) + 0.0 AS value FROM e GROUP BY channel, k")
def epochs_mean(v):
    return rows(_epochs(v).mean("event").df.select("channel", "time_idx", "time", "value"))


@query(_EPOCHS + " SELECT channel, event, k + 10 AS time_idx, value FROM e WHERE k BETWEEN -10 AND 10")
def epochs_buffered(v):
    got = epochs.epochs(v.onsets, v.signal, 200.0, -0.05, 0.05, buffer=0.05, in_seconds=False)
    return rows(got.df.select("channel", "event", "time_idx", "value"))


@query(_EPOCHS + " SELECT channel, event, k + 20 AS time_idx, value FROM e WHERE channel IN (1, 3)")
def epochs_channels(v):
    return rows(_epochs(v, channels=[3, 1]).df.select("channel", "event", "time_idx", "value"))


@query(_EPOCHS + " SELECT channel, event, k + 20 AS time_idx, round(value - avg(CASE WHEN k BETWEEN -20 AND 0 THEN value END) OVER (PARTITION BY channel, event), 6) + 0.0 AS value FROM e")
def baseline_corrected(v):
    return rows(_epochs(v).baseline_corrected((-0.1, 0.0)).df.select("channel", "event", "time_idx", "value"))


@query(_EPOCHS + " SELECT channel, event, k + 12 AS time_idx, value FROM e WHERE k BETWEEN -12 AND 12")
def remove_buffer(v):
    return rows(_epochs(v).remove_buffer(0.04).df.select("channel", "event", "time_idx", "value"))


@query("SELECT event_id AS event, event_type, round(value * 2, 6) + 0.0 AS twice FROM events WHERE event_type = 'purchase'")
def events_fields(v):
    e = epochs.add_fields(v.events.withColumnRenamed("event_id", "event"), twice=F.col("value") * 2)
    return rows(epochs.remove_fields(e.where("event_type = 'purchase'"), "ts", "user_id", "value", "props", "unknown"))


@query("SELECT channel, sample, time, value FROM (SELECT ch AS channel, smp AS sample, round(smp / 200.0, 6) + 0.0 AS time, value FROM sig) WHERE channel IN (0, 2)")
def all_data(v):
    from ..sources.base import all_data as read

    return rows(read(v.signal, 200.0, [2, 0]).select("channel", "sample", "time", "value"))



def _kernel_sql() -> str:
    """The 20 Hz kernel in SQL: its length is a constant of the parameters, its points come from a range."""
    n = len(morlet_kernels(20.0, 5.0, 200.0)[0])
    s = 20.0 * n / (2 * 5.0 * 200.0)
    x = f"(-2 * pi() * {s!r} + 4 * pi() * {s!r} * i / {n - 1})"
    wave = f"exp(-0.5 * pow({x}, 2)) * pow(pi(), -0.25)"
    return f"""raw AS (SELECT i, (cos(5 * {x}) - exp(-12.5)) * {wave} AS re, sin(5 * {x}) * {wave} AS im FROM range({n}) t(i)),
               kernel AS (SELECT i, re / norm AS re, im / norm AS im FROM raw, (SELECT sqrt(sum(re * re + im * im) / 200) AS norm FROM raw))"""


_N = len(morlet_kernels(20.0, 5.0, 200.0)[0])
_CONV = f"""{_kernel_sql()}, c AS (SELECT s.ch AS ch, s.smp + k.i - {(_N - 1) // 2} AS smp, sum(s.value * k.re) AS re, sum(s.value * k.im) AS im FROM sig s, kernel k GROUP BY 1, 2)"""


@query(f"WITH {_kernel_sql()} SELECT i, round(re, 9) + 0.0 AS re, round(im, 9) + 0.0 AS im FROM kernel")
def morlet_kernel(v):
    k = morlet_kernels(20.0, 5.0, 200.0)[0]
    return rows(v.spark.createDataFrame([(i, float(x.real), float(x.imag)) for i, x in enumerate(k)], "i long, re double, im double"), 9)


@query(f"WITH {_CONV} SELECT ch, smp, round(re * re + im * im, 3) + 0.0 AS value FROM c WHERE smp >= 0 AND smp < (SELECT count(*) // 4 FROM events)")
def wavelet_power(v):
    got = v.sig.wavelet(20.0)
    return rows(got.df.select("ch", F.col("smp").cast("long").alias("smp"), "value"), 3)


@query(f"WITH {_CONV} SELECT ch, smp, round(cos(atan2(im, re)), 5) + 0.0 AS value FROM c WHERE smp >= 0 AND smp < (SELECT count(*) // 4 FROM events)")
def wavelet_phase(v):
    got = v.sig.wavelet(20.0, what="phase")
    return rows(got.df.select("ch", F.col("smp").cast("long").alias("smp"), F.cos("value").alias("value")), 5)


@query(f"WITH {_CONV} SELECT ch, smp, round(re * re + im * im, 3) + 0.0 AS value FROM c WHERE smp >= 0 AND smp < (SELECT count(*) // 4 FROM events)")
def wavelet_join(v):
    """The same power by relational convolution: each sample meets the kernel's few points, keyed by where they land."""
    k = morlet_kernels(20.0, 5.0, 200.0)[0]
    n = v.n_samples
    kernel = v.spark.createDataFrame([(i - (len(k) - 1) // 2, float(x.real), float(x.imag)) for i, x in enumerate(k)], "i int, re double, im double")
    cells = v.sig.df.select("ch", "smp", "value").crossJoin(F.broadcast(kernel))  # as many rows as the kernel has samples
    c = cells.groupBy("ch", (F.col("smp") + F.col("i")).alias("smp")).agg(F.sum(F.col("value") * F.col("re")).alias("re"), F.sum(F.col("value") * F.col("im")).alias("im"))
    return rows(c.where((F.col("smp") >= 0) & (F.col("smp") < n)).select("ch", "smp", (F.col("re") ** 2 + F.col("im") ** 2).alias("value")), 3)


@query("SELECT ch, smp, round((l - avg(l) OVER w) / stddev_samp(l) OVER w, 5) + 0.0 AS value FROM (SELECT ch, smp, log10(CASE WHEN value - 5 <= 0 THEN 2.220446049250313e-16 ELSE value - 5 END) AS l FROM sig) WINDOW w AS (PARTITION BY ch)")
def log_power_z(v):
    got = v.sig.map(lambda x: scalar.log10_floor(x - 5)).zscored("smp")
    return rows(got.df.select("ch", "smp", "value"), 5)


@query("""SELECT c_custkey, round(radius * cos(theta), 6) + 0.0 AS x, round(radius * sin(theta), 6) + 0.0 AS y,
                 round(atan2(radius * sin(theta), radius * cos(theta)), 6) + 0.0 AS back, round(radians(c_acctbal), 6) + 0.0 AS rad, round(degrees(theta), 6) + 0.0 AS deg
          FROM (SELECT c_custkey, c_acctbal, (c_custkey % 360) * 0.017 - 3 AS theta, abs(c_acctbal) + 1 AS radius FROM customer)""")
def polar_cartesian(v):
    c = v.table("customer").select("c_custkey", "c_acctbal", ((F.col("c_custkey") % 360) * 0.017 - 3).alias("theta"), (F.abs("c_acctbal") + 1).alias("radius"))
    c = c.withColumn("p", scalar.pol2cart(F.col("theta"), F.col("radius")))
    back = scalar.cart2pol(F.col("p.x"), F.col("p.y"))
    return rows(c.select("c_custkey", F.col("p.x").alias("x"), F.col("p.y").alias("y"), back["theta"].alias("back"), scalar.deg2rad(F.col("c_acctbal")).alias("rad"), scalar.rad2deg(F.col("theta")).alias("deg")))


@query("""SELECT event_id, round(atanh(greatest(least(value / 400 - 0.5, 0.9999), -0.9999)), 6) + 0.0 AS z, ceil(log2(event_id + 1 - 1e-9))::BIGINT AS p2,
                 round(value + pi() - 2 * pi() * floor((value + pi()) / (2 * pi())) - pi(), 6) + 0.0 AS wrapped, round_even(value / 10, 0) AS even FROM events WHERE event_id > 0""")
def scalar_functions(v):
    x = F.col("value")
    e = v.events.where("event_id > 0")
    return rows(e.select("event_id", scalar.fisher_z(x / 400 - 0.5).alias("z"), scalar.next_pow2_column(F.col("event_id") + 1).alias("p2"), scalar.rewrap(x).alias("wrapped"), scalar.rint(x / 10).alias("even")))


@query("""WITH g AS (SELECT (max(abs(value - 250)) * 2 * 1.1) / (32767 * 2) AS gain FROM sig)
          SELECT ch, smp, trunc((value - 250) / gain)::BIGINT AS stored, round(trunc((value - 250) / gain) * gain, 6) + 0.0 AS value FROM sig, g""")
def quantise_int16(v):
    from ..sources import store

    s = v.sig.df.withColumn("value", F.col("value") - 250)
    gain = store.gain_of(s, "short")
    stored = store.quantise(F.col("value"), gain, "short")
    return rows(s.select("ch", "smp", stored.alias("stored"), (stored.cast("double") * gain).alias("value")))


@query("SELECT ch, smp, round(value, 5) + 0.0 AS value FROM sig")
def swt_roundtrip(v):
    """Every sample as it comes back; a length that is no multiple of 2**5 is padded with the last sample, and cut back.

    In runs with a halo of what the filters of both ways reach; at the ends a run, not the series, goes round, which
    the way back undoes all the same.
    """
    from ..functions.wavelets import iswt, swt

    def kernel(x, t):
        n = x.shape[-1]
        return {None: iswt(swt(np.pad(x, [(0, 0)] * (x.ndim - 1) + [(0, -n % 32)], "edge"), 5))[..., :n]}

    return rows(v.sig.apply_chunked(kernel, CHUNK, 2 * 5 * 31), 5)


@query("SELECT ch, smp, round(value, 5) + 0.0 AS value FROM sig")
def emd_sum(v):
    """Modes and residue of every sample."""
    return rows(v.sig.emd().sum("mode"), 5)


@query()
def eemd_modes(v):
    got = v.sig.eemd()
    return rows(Cube(got.df, got.dims).std("smp"), 3)


@query()
def instantaneous_frequency(v):
    return rows(v.sig.filtered((8.0, 14.0), "pass").instantaneous().nanmean("smp"), 3)


@query("SELECT ch, count(*) AS n, round(sum(value), 2) + 0.0 AS total, round(max(CASE WHEN smp = 3 THEN value END), 6) + 0.0 AS fourth FROM sig GROUP BY ch")
def series_layout(v):
    """One row a series: its samples in order in an array."""
    s = v.sig.to_series("smp")
    return rows(s.select("ch", F.size("values").alias("n"), F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 2).alias("total"), F.element_at("values", 4).alias("fourth")))


@query("SELECT ch, (1 << ceil(log2(count(*)))::INT)::BIGINT AS n FROM sig GROUP BY ch")
def pad_to_pow2(v):
    from ..functions.filters import pad_to_pow2 as pad

    s = v.sig
    return rows(s.apply(lambda x, t: (pad(x), t[0] + np.arange(pad(x).shape[-1]))).df.groupBy("ch").agg(F.count("*").alias("n")))


@query("""WITH e AS (SELECT ev, smp, ev % 2 AS src FROM onset)
          SELECT s.ch AS channel, e.ev AS event, r.k + 4 AS time_idx, s.value FROM e, range(-4, 5) r(k) JOIN sig s ON s.smp = e.smp + r.k AND s.ch // 2 = e.src""")
def epochs_sources(v):
    """Events of several recordings at once: the source is part of the join's key."""
    signal = v.signal.withColumn("esrc", F.concat(F.lit("r"), F.expr("channel div 2")))
    events = v.onsets.withColumn("esrc", F.concat(F.lit("r"), F.col("event") % 2))
    got = epochs.epochs(events, signal, 200.0, -0.02, 0.02, in_seconds=False)
    return rows(got.df.select("channel", "event", "time_idx", "value"))


@query("SELECT ch AS channel, 2 * count(*) AS n, (2 * count(*) - 1)::BIGINT AS last, round(2 * sum(value), 2) + 0.0 AS total FROM sig GROUP BY ch")
def signal_store(v):
    """A recording stored, appended to and read back."""
    import uuid

    from ..plans.lineage import shared_folder
    from ..sources.store import SignalStore

    store = SignalStore.create(v.signal, f"{shared_folder(v.spark)}/axisframe/store-{uuid.uuid4().hex}", 200.0)
    store.append(v.signal)
    return rows(store.signal().groupBy("channel").agg(F.count("*").alias("n"), F.max("sample").alias("last"), F.sum("value").alias("total")), 2)


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS start, count(value) AS n, round(avg(value), 8) + 0.0 AS mean FROM events
          GROUP BY 1 HAVING time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)""")
def stream_bins(v):
    """Tumbling bins of a stream run to its end: every bin that the watermark has passed."""
    import uuid

    from ..plans.lineage import shared_folder
    from ..streaming.signal import binned

    folder = f"{shared_folder(v.spark)}/axisframe/stream-{uuid.uuid4().hex}"
    live = v.spark.readStream.schema(v.events.schema).parquet(f"{v.sf_dir}/event[s].parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.lit(0).alias("channel"), "value")
    out = binned(live, "1 hour", "10 minutes")
    q = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = v.spark.read.schema(out.schema).parquet(f"{folder}/out")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", (F.round("mean", 8) + 0.0).alias("mean"))


