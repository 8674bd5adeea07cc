"""Readers and the store on files made here."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisframe import sources
from axisframe.sources import brainvision, edf, rawbin, store
from axisframe.sources.base import all_data, default_channels, from_array


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    sources.register(spark)


def values(df, channel):
    return np.array([r[0] for r in df.where(F.col("channel") == channel).orderBy("sample").select("value").collect()])


def test_rawbin(spark, tmp_path):
    x = {1: np.arange(-50, 50, dtype="<i2"), 2: np.arange(100, dtype="<i2")}
    for c, v in x.items():
        (tmp_path / f"rec.{c:03d}").write_bytes(v.tobytes())
    (tmp_path / "params.txt").write_text("samplerate 500.0\ngain 0.25\nname __import__('os')\n")
    df = spark.read.format("rawbin").load(str(tmp_path / "rec"))
    for c, v in x.items():
        np.testing.assert_allclose(values(df, c), v * 0.25)
    assert df.where("channel = 2 AND sample >= 90 AND sample < 95").count() == 5
    assert rawbin.read_params(str(tmp_path / "rec"))["name"] == "__import__('os')"
    timed = all_data(df, 500.0, [1])
    assert timed.agg(F.max("time")).first()[0] == pytest.approx(99 / 500)
    (tmp_path / "params.txt").write_text("gain 1\n")
    with pytest.raises(ValueError):
        rawbin.read_params(str(tmp_path / "rec"))


def write_edf(path, signals, annotations, wide=False):
    """signals: (label, samples a record, records of digital values)."""
    per = [s[1] for s in signals] + [30]
    n, records = len(per), len(signals[0][2]) // signals[0][1]
    labels = [s[0] for s in signals] + ["BDF Annotations" if wide else "EDF Annotations"]
    pad = lambda x, k: str(x).ljust(k).encode()
    head = (b"\xffBIOSEMI" if wide else pad("0", 8)) + pad("", 160) + pad("01.01.20", 8) + pad("00.00.00", 8) + pad(256 * (n + 1), 8) + pad("", 44) + pad(records, 8) + pad(1, 8) + pad(n, 4)
    cols = [b"".join(pad(x, 16) for x in labels), pad("", 80 * n), pad("", 8 * n), pad(-200, 8) * n, pad(200, 8) * n, pad(-2000, 8) * n, pad(2000, 8) * n, pad("", 80 * n), b"".join(pad(p, 8) for p in per), pad("", 32 * n)]
    width = 3 if wide else 2
    enc = lambda v: b"".join(int(x).to_bytes(width, "little", signed=True) for x in v)
    body = b""
    for r in range(records):
        for _, p, v in signals:
            body += enc(v[r * p : (r + 1) * p])
        tal = f"+{r}\x14\x14\x00".encode() + b"".join(f"+{o}\x15{d}\x14{t}\x14\x00".encode() for o, d, t in annotations if int(o) == r)
        body += tal.ljust(30 * width, b"\x00")
    path.write_bytes(head + b"".join(cols) + body)


@pytest.mark.parametrize("wide", [False, True])
def test_edf(spark, tmp_path, wide):
    a, b = np.arange(-30, 30) * 10, np.arange(30) * 5
    path = tmp_path / "x.edf"
    write_edf(path, [("Fz", 20, a), ("Cz", 10, b)], [(0.5, 0.25, "go"), (2.1, 1, "stop")], wide)
    df = spark.read.format("edf").option("esrc", "r1").load(str(path))
    np.testing.assert_allclose(values(df, 1), a / 10)
    np.testing.assert_allclose(values(df, 2), b / 10)
    assert df.first()["esrc"] == "r1"
    h = edf.read_header(str(path))
    assert len(h.signals) == 2 and h.samples(0) == 60 and h.samplerate(1) == 10
    np.testing.assert_allclose(edf.read_samples(h, 0, 15, 10), a[15:25] / 10)
    assert len(edf.read_samples(h, 0, 55, 100)) == 5
    notes = spark.read.format("edf_annotations").load(str(path)).orderBy("onset").collect()
    assert [(r["onset"], r["duration"], r["annotation"]) for r in notes] == [(0.5, "0.25", "go"), (2.1, "1", "stop")]


def test_not_edf(tmp_path):
    (tmp_path / "x").write_bytes(b"nothing")
    with pytest.raises(ValueError):
        edf.read_header(str(tmp_path / "x"))


VHDR = """Brain Vision Data Exchange Header File Version 1.0
[Common Infos]
DataFile={stem}.eeg
MarkerFile={stem}.vmrk
DataFormat=BINARY
DataOrientation={orientation}
NumberOfChannels=2
SamplingInterval=4000
[Binary Infos]
BinaryFormat={fmt}
[Channel Infos]
Ch1=Fz,,0.5,uV
Ch2=C\\1z,,,uV
[Comment]
Impedance [kOhm] :
Fz:  5
C,z: 7
"""


@pytest.mark.parametrize("fmt, kind", [("INT_16", "<i2"), ("IEEE_FLOAT_32", "<f4")])
def test_brainvision(spark, tmp_path, fmt, kind):
    x = np.arange(40).reshape(20, 2)
    (tmp_path / "a.vhdr").write_text(VHDR.format(stem="a", fmt=fmt, orientation="MULTIPLEXED"))
    (tmp_path / "a.eeg").write_bytes(x.astype(kind).tobytes())
    (tmp_path / "a.vmrk").write_text("title\n[Marker Infos]\nMk2=Stimulus,S255,11,1,0\nMk1=New Segment,,1,1,0,2020\n")
    path = str(tmp_path / "a.vhdr")
    df = spark.read.format("brainvision").load(path)
    np.testing.assert_allclose(values(df, 1), x[:, 0] * 0.5)
    np.testing.assert_allclose(values(df, 2), x[:, 1])
    marks = spark.read.format("brainvision_markers").load(path).orderBy("onset").collect()
    assert [(r["onset"], r["annotation"]) for r in marks] == [(0.0, "New Segment"), (0.04, "S255")]
    table = brainvision.channel_table(spark, path).orderBy("number").collect()
    assert [(r["name"], r["impedance"]) for r in table] == [("Fz", 5.0), ("C,z", 7.0)]


def test_brainvision_vectorized(tmp_path):
    (tmp_path / "b.vhdr").write_text(VHDR.format(stem="b", fmt="INT_16", orientation="VECTORIZED"))
    with pytest.raises(ValueError):
        brainvision.read_header(str(tmp_path / "b.vhdr"))


def test_store(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(3, 100)) * 40
    signal = from_array(spark, x)
    s = store.SignalStore.create(signal, str(tmp_path / "st"), 250.0, dtype="short")
    assert s.samplerate == 250.0 and s.channels().count() == 3
    step = s.meta["gain"]
    assert step == pytest.approx(np.abs(x).max() * 1.1 / 32767)
    for c in range(3):
        np.testing.assert_allclose(values(s.signal(), c), np.trunc(x[c] / step) * step)
    s.append(signal)
    assert s.signal().count() == 600 and s.signal().agg(F.max("sample")).first()[0] == 199
    s.set_channel(1, spark.range(200).select(F.col("id").alias("sample"), F.lit(0.0).alias("value")))
    assert np.abs(values(s.signal(), 1)).max() == 0 and len(values(s.signal(), 2)) == 200
    s.set_annotations(spark.createDataFrame([(1.5, "0", "x")], "onset double, duration string, annotation string"))
    assert s.annotations().first()["annotation"] == "x"
    assert default_channels(spark, 2).collect()[1]["name"] == "Ch2"
    plan = s.signal().where("channel = 1 AND sample > 10")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(channel" in plan and "GreaterThan(sample" in plan


def test_pulses(spark, tmp_path):
    (tmp_path / "p.txt").write_text("1000\t1\tUP\n1010\t1\tDN\n2000\t1\tUP\n")
    assert [r[0] for r in store.read_pulses(spark, str(tmp_path / "p.txt")).collect()] == [1000, 2000]


def test_struct_is_little_endian():
    np.testing.assert_array_equal(edf.decode(struct.pack("<hh", -2, 300), 2), [-2, 300])
    np.testing.assert_array_equal(edf.decode((-2).to_bytes(3, "little", signed=True), 3), [-2])
