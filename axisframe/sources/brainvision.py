"""BrainVision recordings: header (.vhdr), markers (.vmrk) and multiplexed binary data."""

from __future__ import annotations

import configparser
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource

from .base import ANNOTATION, Recording, RowReader, SignalReader
from .files import file_size, read_bytes, read_lines

# The header's names of sample formats.
FORMATS = {"INT_16": "<i2", "IEEE_FLOAT_32": "<f4"}


def read_ini(path: str) -> configparser.ConfigParser:
    """The first line is a title, and what follows ``[Comment]`` is free text."""
    text = read_bytes(path).decode("utf-8", "replace").partition("\n")[2].partition("[Comment]")[0]
    ini = configparser.ConfigParser(interpolation=None, strict=False, comment_prefixes=(";",))
    ini.read_string(text)
    return ini


@dataclass
class Header:
    data: str
    markers: str | None
    kind: np.dtype
    samplerate: float
    channels: list[tuple[int, str, float, str]]  # number, name, scale, unit
    impedances: dict[str, float]


def read_header(path: str) -> Header:
    ini = read_ini(path)
    common = ini["Common Infos"]
    if common.get("DataOrientation", "MULTIPLEXED") != "MULTIPLEXED":
        raise ValueError("only multiplexed data are read")
    fmt = ini["Binary Infos"]["BinaryFormat"]
    if fmt not in FORMATS:
        raise ValueError(f"no sample format {fmt!r}")
    channels = []
    for k, v in ini["Channel Infos"].items():
        name, _, scale, unit = ([x.replace("\\1", ",") for x in v.split(",")] + ["", "", ""])[:4]
        channels.append((int(k.lower().removeprefix("ch")), name, float(scale or 1), unit))
    folder = path.rpartition("/")[0]
    beside = lambda f: f"{folder}/{f}" if folder else f
    stem = path.rpartition("/")[2].rpartition(".")[0]
    fill = lambda f: f.replace("$b", stem)
    impedances = {}
    comment = read_bytes(path).decode("utf-8", "replace").partition("[Comment]")[2]
    if "Impedance" in comment:
        for line in comment.partition("Impedance")[2].splitlines()[1:]:
            name, _, value = line.partition(":")
            try:
                impedances[name.strip()] = float(value)
            except ValueError:
                continue
    return Header(beside(fill(common["DataFile"])), beside(fill(common["MarkerFile"])) if "MarkerFile" in common else None, np.dtype(FORMATS[fmt]), 1e6 / float(common["SamplingInterval"]), sorted(channels), impedances)


def channel_table(spark: SparkSession, path: str) -> DataFrame:
    h = read_header(path)
    return spark.createDataFrame([(n, name, scale, unit, h.impedances.get(name)) for n, name, scale, unit in h.channels], "number int, name string, scale double, unit string, impedance double")


def find_markers(path: str) -> tuple[int, int, bool]:
    """(first byte, end, whether the first segment begins at 1) of a marker file's list, looked through 4 MB at a time."""
    size, at, first, shift, carry = file_size(path), 0, None, False, b""
    while at < size:
        raw = read_bytes(path, at, 4 << 20)
        at += len(raw)
        lines = carry + raw
        whole = len(lines) if at >= size else lines.rfind(b"\n") + 1
        lines, carry = lines[:whole], lines[whole:]
        begin = at - len(carry) - whole
        for m in re.finditer(rb"^\[[^\]\n]*\]", lines, re.M):
            if first is None and m[0].lower() == b"[marker infos]":
                first = begin + m.end()
            elif first is not None and begin + m.start() > first:
                return first, begin + m.start(), shift or bool(_FIRST.search(lines[: m.start()]))
        if first is not None:
            shift = shift or bool(_FIRST.search(lines))
    if first is None:
        raise ValueError(f"{path} has no list of markers")
    return first, size, shift


# A marker's line, and that of a segment that begins at 1.
_MARKER = re.compile(r"\s*mk(\d+)\s*[=:]\s*(.*)", re.I)
_FIRST = re.compile(rb"^\s*mk\d+\s*[=:]\s*New Segment,[^,\n]*,\s*1\s*(?:,|$)", re.I | re.M)


def read_markers(h: Header, start: int, stop: int, first: int, end: int, shift: bool) -> Iterator[tuple[float, str, str]]:
    """(onset in seconds, duration in samples as it stands, description) of the markers whose lines begin from byte ``start`` to before ``stop``. Positions count from 1 where the first segment begins at 1."""
    for line in read_lines(h.markers, start, stop, first, end):
        if m := _MARKER.match(line.decode("utf-8", "replace")):
            kind, text, position, size = ([x.replace("\\1", ",") for x in m[2].rstrip().split(",")] + [""] * 4)[:4]
            yield (int(position) - shift) / h.samplerate, size, text or kind


class BrainVisionReader(SignalReader):
    together = True

    def __init__(self, options: dict):
        super().__init__()
        self.header = h = read_header(options["path"])
        self.source = options.get("esrc", options["path"])
        n = file_size(h.data) // (h.kind.itemsize * len(h.channels))
        self.at = {c[0]: i for i, c in enumerate(h.channels)}
        self.channels = {c[0]: n for c in h.channels}

    def load(self, channels, start, stop):
        h, width = self.header, len(self.header.channels)
        raw = read_bytes(h.data, start * width * h.kind.itemsize, (stop - start) * width * h.kind.itemsize)
        block = np.frombuffer(raw, h.kind).reshape(-1, width)
        for c in channels:
            yield c, block[:, self.at[c]].astype(float) * h.channels[self.at[c]][2]


class BrainVision(Recording):
    """Format ``brainvision``; path is the header file."""

    @classmethod
    def name(cls) -> str:
        return "brainvision"

    def reader(self, schema):
        return BrainVisionReader(dict(self.options))


class BrainVisionMarkers(DataSource):
    """Format ``brainvision_markers``."""

    @classmethod
    def name(cls) -> str:
        return "brainvision_markers"

    def schema(self):
        return ANNOTATION

    def reader(self, schema):
        path, esrc = self.options["path"], self.options.get("esrc", self.options["path"])
        h = read_header(path)
        first, end, shift = find_markers(h.markers)
        return RowReader(lambda start, stop: ((esrc, *m) for m in read_markers(h, start, stop, first, end, shift)), first, end, 8 << 20)
