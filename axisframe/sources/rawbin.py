"""Raw binary recordings: one little-endian file ``root.NNN`` a channel, parameters in ``root.params`` or ``params.txt``."""

from __future__ import annotations

import ast
import re

import numpy as np

from .base import Recording, SignalReader
from .files import file_size, list_files, read_bytes

# Names of sample formats.
FORMATS = {"single": "<f4", "short": "<i2", "int16": "<i2", "double": "<f8"}


def read_params(root: str) -> dict:
    """Lines of ``name value``; values are Python literals or plain text, never evaluated. Sample rate and gain must be there."""
    folder = root.rpartition("/")[0] or "."
    for path in (f"{root}.params", f"{folder}/params.txt"):
        try:
            text = read_bytes(path).decode()
        except OSError:
            continue
        out = {}
        for line in text.splitlines():
            name, _, value = line.strip().partition(" ")
            if name:
                try:
                    out[name] = ast.literal_eval(value.strip())
                except (ValueError, SyntaxError):
                    out[name] = value.strip()
        if missing := {"samplerate", "gain"} - set(out):
            raise ValueError(f"{path} has no {sorted(missing)}")
        return out
    raise OSError(f"no parameter file for {root}")


class RawBinReader(SignalReader):
    def __init__(self, options: dict):
        super().__init__()
        self.root = options["path"]
        params = {k: options[k] for k in ("samplerate", "gain", "format", "dataformat") if k in options}
        if "samplerate" not in params:
            params = read_params(self.root) | params
        name = params.get("format", params.get("dataformat", "int16"))
        if name not in FORMATS:
            raise ValueError(f"no sample format {name!r}")
        self.kind, self.gain, self.source = np.dtype(FORMATS[name]), float(params.get("gain", 1)), options.get("esrc", self.root)
        base, _, stem = self.root.rpartition("/")
        self.files = {int(m[1]): f for f in list_files(base or ".") if (m := re.fullmatch(re.escape(stem) + r"\.(\d+)", f.rpartition("/")[2]))}
        if not self.files:
            raise OSError(f"no channel files {self.root}.NNN")
        self.channels = {c: file_size(f) // self.kind.itemsize for c, f in self.files.items()}

    def load(self, channels, start, stop):
        for c in channels:
            raw = read_bytes(self.files[c], start * self.kind.itemsize, (min(stop, self.channels[c]) - start) * self.kind.itemsize)
            yield c, np.frombuffer(raw, self.kind).astype(float) * self.gain


class RawBin(Recording):
    """Format ``rawbin``: path is the root; options samplerate, gain, format, esrc override the parameter file."""

    @classmethod
    def name(cls) -> str:
        return "rawbin"

    def reader(self, schema):
        return RawBinReader(dict(self.options))
