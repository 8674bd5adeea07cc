"""Queries over readers, the signal store, alignment and streams: the test samples are written as recordings and read back."""

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .. import sources
from ..operators import align, clusters
from ..plans.cube import Cube
from ..plans.lineage import temporary
from ..sources import base, brainvision, edf, rawbin
from ..sources.files import join_files, write_bytes
from ..sources.store import SignalStore, read_pulses
from ..streaming import signal as streams
from .registry import query, rows

#: Samples in a record of the EDF files made here: a quarter of a second.
RECORD = 50

#: Samples of all channels that a task puts into bytes at once: whole records.
PIECE = RECORD * 2048


def _steps(v, file=0):
    """(file, piece, channel, sample, step) with values as whole numbers, tenths of them cut towards 0, and by file how many samples there are."""
    steps = v.sig.df.select(F.lit(file).alias("file") if isinstance(file, int) else file.cast("int").alias("file"), F.floor(F.col("smp") / PIECE).alias("piece"), F.col("ch").cast("int").alias("ch"), F.col("smp").cast("long").alias("smp"), (F.col("value") * 10).cast("long").alias("step"))
    return steps, {r[0]: r[1] for r in steps.groupBy("file").agg(F.max("smp") + 1).collect()}


def _pieces(cells, lengths: dict[int, int], folder: str, encode) -> dict[int, list[str]]:
    """By file the paths of its pieces in their order: each holds what ``encode(rows, piece, samples)`` gives. Tasks
    write them, one that runs twice under other names, so the driver sees paths only."""

    def write(pdf, file: int, piece: int) -> str:
        path = f"{folder}/pieces/{uuid.uuid4().hex}"
        write_bytes(path, encode(pdf, piece, min(PIECE, lengths[file] - piece * PIECE)))
        return path

    def run(key, pdf):
        return pd.DataFrame({"file": [key[0]], "piece": [key[1]], "path": [write(pdf, *map(int, key))]})

    got = {(r[0], r[1]): r[2] for r in cells.groupBy("file", "piece").applyInPandas(run, "file int, piece long, path string").collect()}
    none = pd.DataFrame({c: pd.Series(dtype=int) for c in cells.columns})
    return {f: [got.get((f, k)) or write(none, f, k) for k in range(-(-n // PIECE))] for f, n in lengths.items()}


def _matrix(pdf, piece: int, n: int, channels: int = 4) -> np.ndarray:
    """(channel, sample) of a piece's steps, 0 where there is none."""
    x = np.zeros((channels, n), int)
    x[pdf["ch"], pdf["smp"] - piece * PIECE] = pdf["step"]
    return x


def write_edf(path: str, steps, lengths: dict[int, int], notes, wide: bool = False, record: int = RECORD, seconds: float = 0.25, channels: int = 4) -> None:
    """A file of these steps, 0.1 each, the last record filled up with 0, and of annotations without duration: (onset, text)."""
    size, samples = 3 if wide else 2, lengths[0]
    records = -(-samples // record)
    notes = notes.withColumn("record", F.floor(F.col("onset") / seconds))
    entry = F.length(F.format_string("+%.6f", "onset")) + F.octet_length("text") + 5  # two bytes and three marks around them
    longest = notes.groupBy("record").agg(F.sum(entry).alias("n")).agg(F.max("n")).first()[0] or 0
    room = -(-(len(f"+{int(records * seconds)}.123456") + 3 + longest) // size)

    def encode(pdf, piece, n):
        held = -(-n // record)
        body, first = np.zeros((channels, held * record), int), piece * PIECE // record
        body[:, :n] = _matrix(pdf[pdf["ch"] >= 0], piece, n, channels)
        marks = [f"+{(first + r) * seconds:.6f}".rstrip("0").rstrip(".").encode() + b"\x14\x14\x00" for r in range(held)]
        some = pdf[pdf["ch"] < 0].sort_values("onset", kind="stable")
        for r, onset, text in zip(some["smp"], some["onset"], some["text"], strict=True):
            marks[r - first] += f"+{onset:.6f}\x150\x14{text}\x14\x00".encode()
        digits = body.astype("<i4").view(np.uint8).reshape(channels, held, record, 4)[..., :size].transpose(1, 0, 2, 3).reshape(held, -1)
        beside = np.frombuffer(b"".join(m.ljust(room * size, b"\x00") for m in marks), np.uint8).reshape(held, -1)
        return np.concatenate([digits, beside], 1).tobytes()

    cells = steps.withColumns({"onset": F.lit(None).cast("double"), "text": F.lit(None).cast("string")})
    beside = notes.select(F.lit(0).alias("file"), F.floor(F.col("record") * record / PIECE).alias("piece"), F.lit(-1).alias("ch"), F.col("record").alias("smp"), F.lit(None).cast("long").alias("step"), "onset", "text")
    parts = _pieces(cells.unionByName(beside), lengths, path.rpartition("/")[0], encode)[0]
    n, pad = channels + 1, lambda s, k: str(s).ljust(k).encode()
    kinds = [f"C{i + 1}" for i in range(channels)] + ["BDF Annotations" if wide else "EDF Annotations"]
    head = [b"\xffBIOSEMI" if wide else pad(0, 8), pad("", 160), pad("01.01.24", 8), pad("00.00.00", 8), pad(256 * (n + 1), 8), pad("", 44), pad(records, 8), pad(seconds, 8), pad(n, 4)]
    head += [b"".join(pad(k, 16) for k in kinds), pad("", 88 * n), pad(-3276.7, 8) * n, pad(3276.7, 8) * n, pad(-32767, 8) * n, pad(32767, 8) * n, pad("", 80 * n), pad(record, 8) * channels + pad(room, 8), pad("", 32 * n)]
    join_files(path, b"".join(head), parts)


def _onsets(v):
    """(onset in seconds, text)."""
    return v.onsets.select((F.col("eoffset") / 200).alias("onset"), F.lit("purchase").alias("text"))


_SAMPLES = "SELECT ch + 1 AS channel, smp AS sample, round(trunc(value * 10) * 0.1, 6) + 0.0 AS value FROM sig"


def _cells(df):
    return rows(df.select("channel", "sample", "value"))


@query(_SAMPLES)
def rawbin_samples(v):
    """Files of whole numbers, one a channel, with parameters beside them."""
    sources.register(v.spark)
    folder = temporary(v.spark)
    steps, lengths = _steps(v, F.col("ch"))
    for c, parts in _pieces(steps.withColumn("ch", F.lit(0)), lengths, folder, lambda pdf, piece, n: _matrix(pdf, piece, n, 1).astype("<i2").tobytes()).items():
        join_files(f"{folder}/rec.{c + 1:03d}", b"", parts)
    write_bytes(f"{folder}/params.txt", b"samplerate 200.0\ngain 0.1\ndataformat 'short'\n")
    return _cells(v.spark.read.format("rawbin").load(f"{folder}/rec"))


@query("SELECT 'gain' AS name, '0.1' AS text UNION ALL SELECT 'samplerate', '200.0' UNION ALL SELECT 'dataformat', 'short' UNION ALL SELECT 'note', '__import__(''os'')'")
def rawbin_params(v):
    """Parameters are read as literals or text, never evaluated."""
    folder = temporary(v.spark)
    write_bytes(f"{folder}/rec.params", b"samplerate 200.0\ngain 0.1\ndataformat 'short'\nnote __import__('os')\n")
    return v.spark.createDataFrame([(k, str(x)) for k, x in rawbin.read_params(f"{folder}/rec").items()], "name string, text string")


def _edf(v, wide: bool) -> str:
    path = f"{temporary(v.spark)}/rec.{'bdf' if wide else 'edf'}"
    write_edf(path, *_steps(v), _onsets(v), wide)
    sources.register(v.spark)
    return path


@query(_SAMPLES)
def edf_samples(v):
    return _cells(v.spark.read.format("edf").load(_edf(v, False)))


@query(_SAMPLES)
def bdf_samples(v):
    return _cells(v.spark.read.format("edf").load(_edf(v, True)))


@query(_SAMPLES + " WHERE ch = 2 AND smp >= 33 AND smp < 200")
def edf_span(v):
    """A stretch of one channel: only its records are read."""
    return _cells(v.spark.read.format("edf").load(_edf(v, False)).where("channel = 3 AND sample >= 33 AND sample < 200"))


@query("SELECT ch AS signal, 4::BIGINT AS signals, count(*) AS samples, 200.0::DOUBLE AS samplerate FROM sig GROUP BY ch")
def edf_header(v):
    """Number of signals, and of each its samples and its rate."""
    h = edf.read_header(_edf(v, False))
    return v.spark.createDataFrame([(i, len(h.signals), h.samples(i), h.samplerate(i)) for i in range(len(h.signals))], "signal long, signals long, samples long, samplerate double")


_NOTES = "SELECT round(smp / 200.0, 6) + 0.0 AS onset, '0' AS duration, 'purchase' AS annotation FROM onset"


@query(_NOTES)
def edf_annotations(v):
    return rows(v.spark.read.format("edf_annotations").load(_edf(v, False)).select("onset", "duration", "annotation"))


@query(_NOTES)
def bdf_annotations(v):
    return rows(v.spark.read.format("edf_annotations").load(_edf(v, True)).select("onset", "duration", "annotation"))


def _brainvision(v, kind: str) -> str:
    folder, (steps, lengths) = temporary(v.spark), _steps(v)
    info = "".join(f"Ch{c + 1}=E\\1{c + 1},,{0.1 * (c + 1):g},uV\n" for c in range(4))
    head = f"Brain Vision Data Exchange Header File Version 1.0\n[Common Infos]\nDataFile=$b.eeg\nMarkerFile=$b.vmrk\nDataFormat=BINARY\nDataOrientation=MULTIPLEXED\nNumberOfChannels=4\nSamplingInterval=5000\n[Binary Infos]\nBinaryFormat={kind}\n[Channel Infos]\n{info}[Comment]\nImpedance [kOhm] :\n" + "".join(f"E,{c + 1}: {5 + c}\n" for c in range(3))
    write_bytes(f"{folder}/rec.vhdr", head.encode())
    join_files(f"{folder}/rec.eeg", b"", _pieces(steps, lengths, folder, lambda pdf, piece, n: _matrix(pdf, piece, n).T.astype(brainvision.FORMATS[kind]).tobytes())[0])
    places = v.onsets.select(F.lit(0).alias("file"), F.floor(F.col("eoffset") / PIECE).alias("piece"), F.col("eoffset").alias("smp"))
    before, number = {}, 2
    for piece, n in sorted(places.groupBy("piece").count().collect()):  # one row a piece
        before[piece], number = number, number + n

    def marks(pdf, piece, _):
        return "".join(f"Mk{before[piece] + i}=Stimulus,S255,{at + 1},1,0\n" for i, at in enumerate(sorted(pdf["smp"]))).encode()

    title = b"Brain Vision Data Exchange Marker File, Version 1.0\n[Marker Infos]\nMk1=New Segment,,1,1,0,2024\n"
    join_files(f"{folder}/rec.vmrk", title, _pieces(places, lengths, folder, marks)[0])
    sources.register(v.spark)
    return f"{folder}/rec.vhdr"


_SCALED = "SELECT ch + 1 AS channel, smp AS sample, round(trunc(value * 10) * 0.1 * (ch + 1), 6) + 0.0 AS value FROM sig"


@query(_SCALED)
def brainvision_samples(v):
    return _cells(v.spark.read.format("brainvision").load(_brainvision(v, "INT_16")))


@query(_SCALED)
def brainvision_floats(v):
    return _cells(v.spark.read.format("brainvision").load(_brainvision(v, "IEEE_FLOAT_32")))


@query("SELECT i AS number, 'E,' || i AS name, round(0.1e0 * i, 6) + 0.0 AS scale, 'uV' AS unit, CASE WHEN i < 4 THEN 4.0::DOUBLE + i END AS impedance FROM range(1, 5) t(i)")
def brainvision_channels(v):
    return rows(brainvision.channel_table(v.spark, _brainvision(v, "INT_16")))


@query("SELECT 0.0::DOUBLE AS onset, '1' AS duration, 'New Segment' AS annotation UNION ALL SELECT round(smp / 200.0, 6) + 0.0, '1', 'S255' FROM onset")
def brainvision_markers(v):
    return rows(v.spark.read.format("brainvision_markers").load(_brainvision(v, "INT_16")).select("onset", "duration", "annotation"))


@query("SELECT i % 3 AS channel, i // 3 AS sample, (i * 7 % 11)::DOUBLE AS value FROM range(60) t(i)")
def memory_source(v):
    """An array in the driver's memory as a recording."""
    i = np.arange(60)
    x = np.zeros((3, 20))
    x[i % 3, i // 3] = i * 7 % 11
    return _cells(base.from_array(v.spark, x))


@query("SELECT smp * 5 AS time FROM sig WHERE ch = 0 AND smp % 7 = 0")
def pulse_log(v):
    """A tab-separated log of pulses: rows of one label."""
    path = f"{temporary(v.spark)}/eeg.log"
    lines = [f"{s * 5}\t1\t{'UP' if s % 7 == 0 else 'DN'}\n" for s in range(v.n_samples)]
    write_bytes(path, "".join(lines).encode())
    return rows(read_pulses(v.spark, path))


_RING = [(20.0 * i, 1.0 + 0.01 * (i % 3)) for i in range(18)] + [(0.0, 0.05)]


@query(f"""WITH p AS (SELECT i, r * cos(radians(t)) AS x, r * sin(radians(t)) AS y FROM (VALUES {", ".join(f"({i}, {t}, {r})" for i, (t, r) in enumerate(_RING))}) s(i, t, r)),
            c AS (SELECT a.i AS i, b.i AS j, c.i AS k, a.x AS ax, a.y AS ay, b.x - a.x AS bx, b.y - a.y AS b_y, c.x - a.x AS cx, c.y - a.y AS cy FROM p a JOIN p b ON a.i < b.i JOIN p c ON b.i < c.i),
            o AS (SELECT *, (cy * (bx * bx + b_y * b_y) - b_y * (cx * cx + cy * cy)) / (2 * (bx * cy - b_y * cx)) AS ux, (bx * (cx * cx + cy * cy) - cx * (bx * bx + b_y * b_y)) / (2 * (bx * cy - b_y * cx)) AS uy FROM c WHERE abs(bx * cy - b_y * cx) > 1e-12),
            t AS (SELECT i, j, k FROM o WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.i NOT IN (o.i, o.j, o.k) AND pow(p.x - ax - ux, 2) + pow(p.y - ay - uy, 2) < ux * ux + uy * uy - 1e-9))
            SELECT DISTINCT a, b FROM (SELECT i AS a, j AS b FROM t UNION ALL SELECT j, k FROM t UNION ALL SELECT i, k FROM t)""")
def sensor_file(v):
    """Neighbours of a ring of sensors, with one near the middle, read from a file of angles and radii; the SQL tries every triple for an empty circle."""
    path = f"{temporary(v.spark)}/sensors.txt"
    write_bytes(path, "\n".join(" ".join(str(x[k]) for x in _RING) for k in range(2)).encode())
    return rows(clusters.sensor_neighbors(v.spark, path))


# -- the store


@query("SELECT ch AS channel, smp AS sample, CASE WHEN ch = 1 THEN smp * 0.5 ELSE round(value, 6) END + 0.0 AS value FROM sig")
def store_set_channel(v):
    """One channel of a stored recording replaced, the others as they were."""
    store = SignalStore.create(v.signal, temporary(v.spark), 200.0)
    store.set_channel(1, v.signal.where("channel = 1").select("sample", (F.col("sample") * 0.5).alias("value")))
    return _cells(store.signal())


@query("SELECT 0::BIGINT AS channel, 0::BIGINT AS sample, 1.0::DOUBLE AS value UNION ALL SELECT 0, 1, 2.0")
def store_append_to_one(v):
    """A store whose last sample is number 0 is appended to."""
    one = v.spark.createDataFrame([(0, 0, 1.0)], "channel int, sample long, value double")
    store = SignalStore.create(one, temporary(v.spark), 200.0)
    store.append(one.withColumn("value", F.lit(2.0)))
    return _cells(store.signal())


@query("SELECT round(smp / 200.0, 6) + 0.0 AS onset, '0' AS duration, 'purchase' AS annotation FROM onset")
def store_annotations(v):
    store = SignalStore.create(v.signal, temporary(v.spark), 200.0)
    store.set_annotations(v.onsets.select((F.col("eoffset") / 200).alias("onset"), F.lit("0").alias("duration"), F.lit("purchase").alias("annotation")))
    return rows(store.annotations())


@query("SELECT DISTINCT ch AS number, 'Ch' || ch AS name FROM sig")
def store_channels(v):
    return rows(SignalStore.create(v.signal, temporary(v.spark), 200.0).channels())


@query("SELECT a, b, c, round(value, 6) + 0.0 AS value, 'V' AS unit FROM cube")
def cube_metadata(v):
    """A cube's rows and its metadata, written apart and put together again."""
    path, cube = temporary(v.spark), v.cube
    cube = Cube(cube.df, cube.dims, cube.value, {"unit": "V"})
    cube.df.write.parquet(f"{path}/cells")
    write_bytes(f"{path}/cube.json", cube.metadata().encode())
    from ..sources.files import read_bytes

    back = Cube.from_metadata(v.spark.read.parquet(f"{path}/cells"), read_bytes(f"{path}/cube.json").decode())
    return rows(back).withColumn("unit", F.lit(back.attrs["unit"]))


@query("SELECT ch AS channel, 2 * count(*) AS n, (2 * count(*) - 1)::BIGINT AS last, round(2 * sum(value), 2) + 0.0 AS total FROM sig GROUP BY ch")
def stream_store(v):
    """A stream appended to the store in micro-batches, after a recording that was there."""
    store = SignalStore.create(v.signal, temporary(v.spark), 200.0)
    live = _live(v, "ch AS channel, smp AS sample, value")
    store.append_stream(live, f"{temporary(v.spark)}/state").awaitTermination()
    return rows(store.signal().groupBy("channel").agg(F.count("*").alias("n"), F.max("sample").alias("last"), F.sum("value").alias("total")), 2)


# -- streams run to their end


def _live(v, columns: str):
    schema = v.events.schema
    live = v.spark.readStream.schema(schema).parquet(f"{v.sf_dir}/event[s].parquet")
    return live.selectExpr("event_id % 4 AS ch", "event_id div 4 AS smp", "value", "event_id", "event_type", "cast(ts AS timestamp) AS ts").selectExpr(*_split(columns))


def _split(columns: str) -> list[str]:
    return [c.strip() for c in columns.split(", ")]


def _drained(v, df, mode: str = "append"):
    """The rows a stream gives by its end. A mode other than append keeps the last micro-batch."""
    path = temporary(v.spark)
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    else:
        q = df.writeStream.foreachBatch(lambda part, _: part.write.mode("overwrite").parquet(f"{path}/out")).option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return v.spark.read.schema(df.schema).parquet(f"{path}/out")


@query("SELECT ch AS channel, count(*) AS n, round(avg(value), 6) + 0.0 AS mean, round(var_samp(value), 4) + 0.0 AS variance FROM sig GROUP BY ch")
def stream_moments(v):
    got = _drained(v, streams.running_moments(_live(v, "ch AS channel, value")), "complete")
    return got.select(F.col("channel").cast("long"), "n", (F.round("mean", 6) + 0.0).alias("mean"), (F.round("variance", 4) + 0.0).alias("variance"))


@query("""WITH e AS (SELECT ts, value, event_id, ts - lag(ts) OVER (ORDER BY ts, event_id) >= INTERVAL '20 minutes' AS new FROM events),
          s AS (SELECT ts, value, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id) AS k FROM e)
          SELECT min(ts) AS start, count(*) AS n, round(avg(value), 6) + 0.0 AS mean FROM s GROUP BY k HAVING max(ts) + INTERVAL '20 minutes' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)""")
def stream_sessions(v):
    """Stretches without a pause of 20 minutes that the watermark has passed."""
    got = _drained(v, streams.sessions(_live(v, "0 AS channel, value, ts"), "20 minutes", "10 minutes"))
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", (F.round("mean", 6) + 0.0).alias("mean"))


_AVERAGES = """WITH RECURSIVE d AS (SELECT ch, smp, value FROM sig), m AS (SELECT ch, avg(value) AS s FROM d WHERE smp < 10 GROUP BY ch),
          r AS (SELECT ch, 0::BIGINT AS smp, 0.5 * (value - s) AS fast, 0.975 * s + 0.025 * value AS slow FROM d JOIN m USING (ch) WHERE smp = 0
                UNION ALL SELECT r.ch, d.smp, 0.5 * fast + 0.5 * (d.value - slow), 0.975 * slow + 0.025 * d.value FROM r JOIN d ON d.ch = r.ch AND d.smp = r.smp + 1)"""


@query(_AVERAGES + " SELECT ch AS channel, smp AS sample, round(fast, 6) + 0.0 AS fast, round(slow, 6) + 0.0 AS slow FROM r")
def stream_averages(v):
    """Recursive averages with state: fast and slow ones of every sample."""
    got = _drained(v, streams.averages(_live(v, "cast(ch AS int) AS channel, smp AS sample, value")))
    return rows(got.select("channel", "sample", "fast", "slow"))


@query("""WITH e AS (SELECT event_id AS ev, ts AS at FROM events WHERE event_type = 'purchase')
          SELECT ev AS event, s.ts, round(s.value, 6) + 0.0 AS value, round(epoch_us(s.ts) / 1e6 - epoch_us(e.at) / 1e6, 4) + 0.0 AS time FROM e JOIN events s ON s.ts BETWEEN e.at - INTERVAL '5 minutes' AND e.at + INTERVAL '5 minutes'""")
def stream_epochs(v):
    """Purchases and what happened within five minutes of each: an interval join of two streams."""
    events = _live(v, "event_id AS event, 'r' AS esrc, ts AS event_ts, event_type").where("event_type = 'purchase'").drop("event_type")
    signal = _live(v, "'r' AS esrc, 0 AS channel, value, ts")
    got = _drained(v, streams.epochs(events, signal, "5 minutes", "5 minutes"))
    return got.select(F.col("event").cast("long"), F.col("ts").cast("timestamp_ntz").alias("ts"), (F.round("value", 6) + 0.0).alias("value"), (F.round("time", 4) + 0.0).alias("time"))


# -- alignment


def _pulse_times(v):
    """Pulse times in seconds of a behaviour log and of the recording, whose clock is a little fast and which begins 3 pulses later."""
    i = np.arange(v.n_samples)
    beh = i * 1.5 + i * i % 100003 * i % 100003 * 7919 % 100003 / 200006 + 40
    return beh, 1.00001372913 * beh[3:] - 30.5


_PULSES = "WITH b AS (SELECT smp AS i, smp * 1.5e0 + (smp * smp * smp * 7919 % 100003) / 200006e0 + 40 AS beh FROM sig WHERE ch = 0), p AS (SELECT i, beh, 1.00001372913e0 * beh - 30.5e0 AS eeg FROM b)"


@query(_PULSES + " SELECT round(regr_slope(eeg, beh), 8) + 0.0 AS slope, round(regr_intercept(eeg, beh), 5) + 0.0 AS intercept FROM p WHERE i >= 3")
def pulse_align_fit(v):
    """The recording's first pulses found in the log, all later ones paired, and the line through the pairs."""
    beh, eeg = _pulse_times(v)
    slope, intercept = align.times_to_offsets(eeg, beh)
    return v.spark.createDataFrame([(round(slope, 8), round(intercept, 5))], "slope double, intercept double")


@query(_PULSES + " SELECT i AS pulse, round(beh, 6) + 0.0 AS beh, round(eeg, 6) + 0.0 AS eeg FROM p WHERE i >= 3")
def pulse_pairs(v):
    """Which pulse of the log is which of the recording."""
    beh, eeg = _pulse_times(v)
    pairs = align.match_pulses(eeg, beh)
    return rows(v.spark.createDataFrame([(i + 3, float(b), float(e)) for i, (b, e) in enumerate(pairs)], "pulse long, beh double, eeg double"))


@query(_PULSES + " SELECT i AS pulse, round(beh, 6) + 0.0 AS beh, round(beh + 3, 6) + 0.0 AS eeg FROM p WHERE i >= 15")
def pulse_pairs_late_log(v):
    """The other way: the log begins after the recording."""
    beh, _ = _pulse_times(v)
    pairs = align.match_pulses(beh + 3, beh[15:])
    return rows(v.spark.createDataFrame([(i + 15, float(b), float(e)) for i, (b, e) in enumerate(pairs)], "pulse long, beh double, eeg double"))


@query("SELECT event_id AS event, 'rec' AS esrc, round(1.00001372913e0 * event_id * 0.25e0 - 30.5e0, 5) + 0.0 AS eoffset FROM events WHERE event_type = 'purchase'")
def align_events(v):
    """Events get their source and offset in seconds by the first and last pulses of both clocks; the log is in milliseconds."""
    beh = v.spark.range(3, v.n_samples).selectExpr("id * 1.5D + id * id % 100003 * id % 100003 * 7919 % 100003 / 200006 + 40 AS beh")  # as _pulse_times has them
    notes = beh.selectExpr("1.00001372913D * beh - 30.5D AS onset", "'S255' AS annotation").unionAll(v.spark.sql("SELECT 1.0D, 'other'"))
    pulses = beh.selectExpr("beh * 1000 AS time")
    events = v.events.where("event_type = 'purchase'").select(F.col("event_id").alias("event"), (F.col("event_id") * 250.0).alias("mstime"))
    return align.align(events, notes, pulses, "rec").select("event", "esrc", (F.round("eoffset", 5) + 0.0).alias("eoffset"))


@query("SELECT 3::BIGINT AS found UNION ALL SELECT -1")
def find_pulses(v):
    """Where a run of gaps stands in a longer one; -1 where it doesn't."""
    beh, _ = _pulse_times(v)
    gaps = np.diff(beh)
    return v.spark.createDataFrame([(align.find_needle(gaps[3:20], gaps, 1e-6),), (align.find_needle(gaps[3:20] + 5, gaps, 1e-6),)], "found long")
