"""European Data Format: EDF, EDF+, BDF and BDF+."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql.datasource import DataSource

from .base import ANNOTATION, Recording, RowReader, SignalReader
from .files import read_bytes


@dataclass(eq=False)
class Header:
    path: str
    width: int  # bytes a sample
    size: int  # of the header
    records: int
    duration: float  # of a record, in seconds
    labels: list[str]
    per_record: list[int]
    scale: list[float]
    offset: list[float]

    @property
    def signals(self) -> list[int]:
        """Places of the ordinary signals, without those of annotations."""
        return [i for i, x in enumerate(self.labels) if x not in ("EDF Annotations", "BDF Annotations")]

    def samples(self, signal: int) -> int:
        return self.per_record[self.signals[signal]] * self.records

    def samplerate(self, signal: int) -> float:
        return self.per_record[self.signals[signal]] / self.duration

    @property
    def record_bytes(self) -> int:
        return sum(self.per_record) * self.width


def read_header(path: str) -> Header:
    head = read_bytes(path, 0, 256)
    if len(head) < 256 or not (head[:8] == b"0       " or head[:8] == b"\xffBIOSEMI"):
        raise ValueError(f"{path} is neither EDF nor BDF")
    width, n = (3 if head[0] == 0xFF else 2), int(head[252:256])
    rest, at = read_bytes(path, 256, 256 * n), 0

    def column(size: int) -> list[str]:
        nonlocal at
        out = [rest[at + i * size : at + (i + 1) * size].decode("latin-1").strip() for i in range(n)]
        at += n * size
        return out

    labels = column(16)
    at += n * 88  # transducer, physical dimension
    pmin, pmax, dmin, dmax = ([float(x) for x in column(8)] for _ in range(4))
    at += n * 80  # prefiltering
    per = [int(x) for x in column(8)]
    scale = [(b - a) / (d - c) if d != c else 1.0 for a, b, c, d in zip(pmin, pmax, dmin, dmax, strict=True)]
    offset = [a - s * c for a, s, c in zip(pmin, scale, dmin, strict=True)]
    return Header(path, width, int(head[184:192]), int(head[236:244]), float(head[244:252]), labels, per, scale, offset)


def decode(raw: bytes, width: int) -> np.ndarray:
    """Little-endian whole numbers of 2 or 3 bytes."""
    if width == 2:
        return np.frombuffer(raw, "<i2").astype(float)
    b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
    v = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
    return np.where(v >= 1 << 23, v - (1 << 24), v).astype(float)


def read_records(h: Header, first: int, last: int) -> np.ndarray:
    """(record, byte) of the records from ``first`` to ``last``, read at once."""
    raw = read_bytes(h.path, h.size + first * h.record_bytes, (last + 1 - first) * h.record_bytes)
    return np.frombuffer(raw, np.uint8).reshape(-1, h.record_bytes)


def read_samples(h: Header, signal: int, start: int, n: int, read=read_records) -> np.ndarray:
    """Physical values of a signal, cut off at the end of the file."""
    i = h.signals[signal]
    per, total = h.per_record[i], h.samples(signal)
    start, stop = max(start, 0), min(start + n, total)
    if stop <= start:
        return np.zeros(0)
    before = sum(h.per_record[:i]) * h.width
    first, last = start // per, (stop - 1) // per
    raw = read(h, first, last)[:, before : before + per * h.width].tobytes()
    return decode(raw, h.width)[start - first * per : stop - first * per] * h.scale[i] + h.offset[i]


def read_annotations(h: Header, start: int = 0, stop: int | None = None) -> Iterator[tuple[float, str, str]]:
    """(onset in seconds, duration as it stands, text) of the records from ``start`` to before ``stop``; the time stamps of records have no text and are left out."""
    places = [(sum(h.per_record[:i]) * h.width, h.per_record[i] * h.width) for i in range(len(h.labels)) if i not in h.signals]
    stop = h.records if stop is None else stop
    step = max(1, (8 << 20) // h.record_bytes)  # records read at once
    for first in range(start, stop if places else start, step):
        for record in read_records(h, first, min(first + step, stop) - 1):
            for before, size in places:
                for entry in record[before : before + size].tobytes().split(b"\x00"):
                    if not entry:
                        continue
                    when, *texts = entry.split(b"\x14")
                    onset, _, duration = when.partition(b"\x15")
                    for t in texts:
                        if t:
                            yield float(onset), duration.decode(), t.decode("utf-8", "replace")


class EdfReader(SignalReader):
    together = True  # records hold a stretch of every signal

    def __init__(self, options: dict):
        super().__init__()
        self.header = read_header(options["path"])
        self.source = options.get("esrc", options["path"])
        self.channels = {k + 1: self.header.samples(k) for k in range(len(self.header.signals))}

    def load(self, channels, start, stop):
        read = cache(read_records)  # signals of one rate lie in the same records
        for c in channels:
            yield c, read_samples(self.header, c - 1, start, stop - start, read)


class Edf(Recording):
    """Format ``edf``; channels are numbered from 1 in file order."""

    @classmethod
    def name(cls) -> str:
        return "edf"

    def reader(self, schema):
        return EdfReader(dict(self.options))


class EdfAnnotations(DataSource):
    """Format ``edf_annotations``."""

    @classmethod
    def name(cls) -> str:
        return "edf_annotations"

    def schema(self):
        return ANNOTATION

    def reader(self, schema):
        path, esrc = self.options["path"], self.options.get("esrc", self.options["path"])
        h = read_header(path)
        return RowReader(lambda start, stop: ((esrc, *a) for a in read_annotations(h, start, stop)), 0, h.records, (16 << 20) // h.record_bytes)
