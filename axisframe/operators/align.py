"""Alignment of two clocks by a train of pulses: arrays in the driver's memory, or tables whose pulses tasks look through."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def find_needle(needle: np.ndarray, hay: np.ndarray, most: float) -> int:
    """First place where every value of ``hay`` is within ``most`` of the needle's, the last place too; -1 if there is none."""
    needle, hay = np.asarray(needle, float), np.asarray(hay, float)
    if len(needle) > len(hay):
        return -1
    return _first_window(hay, len(needle), lambda windows: (np.abs(windows - needle) <= most).all(axis=1))


def _first_window(hay: np.ndarray, size: int, test: Callable[[np.ndarray], np.ndarray], block: int = 1 << 16) -> int:
    """Where the first run of ``size`` values that passes the test begins, a block of runs at a time; -1 if there is none."""
    windows = np.lib.stride_tricks.sliding_window_view(hay, size)
    for start in range(0, len(windows), block):
        good = np.flatnonzero(test(windows[start : start + block]))
        if len(good):
            return start + int(good[0])
    return -1


def match_pulses(eeg: np.ndarray, beh: np.ndarray, length: int = 10, tolerance: float = 0.0015) -> list[tuple[float, float]]:
    """Pairs of pulse times of two clocks: the gaps of the recording's first ``length`` pulses are looked for in the
    behaviour log, and where they aren't there, those of the log's first pulses in the recording; then pulses are paired
    in order as long as their distance from the pair before agrees."""
    eeg, beh = np.asarray(eeg, float), np.asarray(beh, float)
    j, i = _first_match(eeg, beh, length, tolerance), 0
    if j is None:
        i, j = _first_match(beh, eeg, length, tolerance), 0
    if i is None:
        raise ValueError("the pulses of the two clocks don't match")
    pairs, j = [(beh[j], eeg[i])], j + 1
    for k in range(i + 1, len(eeg)):
        while j < len(beh) and (beh[j] - pairs[-1][0]) < (eeg[k] - pairs[-1][1]) - tolerance:
            j += 1
        if j == len(beh):
            break
        if abs((beh[j] - pairs[-1][0]) - (eeg[k] - pairs[-1][1])) <= tolerance:
            pairs.append((beh[j], eeg[k]))
            j += 1
    return pairs


def _first_match(needle: np.ndarray, hay: np.ndarray, length: int, tolerance: float) -> int | None:
    """Where in ``hay`` the gaps of the first ``length`` pulses of ``needle`` first occur; None if nowhere."""
    gaps = np.diff(needle[:length])
    if not len(gaps) or len(hay) <= len(gaps):
        return None
    at = _first_window(np.diff(hay), len(gaps), lambda windows: np.abs(windows - gaps).sum(axis=1) < tolerance * length)
    return None if at < 0 else at


def fit_line(pairs: DataFrame, x: str = "beh", y: str = "eeg") -> tuple[float, float]:
    """(slope, intercept) by least squares."""
    return tuple(pairs.agg(F.regr_slope(y, x), F.regr_intercept(y, x)).first())


def times_to_offsets(eeg, beh, length: int = 10, tolerance: float = 0.0015) -> tuple[float, float]:
    """(slope, intercept) from behaviour time to recording time by all matched pulses."""
    b, e = np.array(match_pulses(eeg, beh, length, tolerance)).T
    slope, intercept = np.polyfit(b, e, 1) if len(b) > 1 else (1.0, e[0] - b[0])
    return float(slope), float(intercept)


def times_to_offsets_ends(eeg, beh, samplerate: float = 1.0, window: int = 100, threshold: float = 10) -> tuple[float, float]:
    """(slope, intercept) from behaviour time in ms to seconds of the recording, by the first and the last ``window`` pulses."""
    eeg_ms, beh = np.asarray(eeg, float) * 1000 / samplerate, np.asarray(beh, float)
    x, y = [], []
    window = min(window, len(beh))
    for part in (beh[:window], beh[-window:]):
        at = find_needle(np.diff(part), np.diff(eeg_ms), threshold)
        if at < 0:
            raise ValueError("the pulses of the two clocks don't match")
        x.append(part)
        y.append(eeg_ms[at : at + window])
    slope, intercept = np.polyfit(np.concatenate(x), np.concatenate(y), 1)
    return float(slope) / 1000, float(intercept) / 1000


def apply_line(time: Column, line: tuple[float, float]) -> Column:
    return time * F.lit(line[0]) + F.lit(line[1])


def times_to_offsets_tables(eeg: DataFrame, beh: DataFrame, samplerate: float = 1.0, window: int = 100, threshold: float = 10) -> tuple[float, float]:
    """:func:`times_to_offsets_ends` of tables of one column each: only the runs of ``window`` pulses reach the driver."""
    from .statistics import sorted_ranks

    e, b = F.col(eeg.columns[0]), F.col(beh.columns[0])
    first, last = (np.array([r[0] for r in beh.orderBy(by).limit(window).collect()], float) for by in (b.asc(), b.desc()))
    parts, window = [first, last[::-1]], len(first)
    ranked = sorted_ranks(eeg.select((e.cast("double") * 1000 / samplerate).alias("ms")), F.col("ms")).select((F.col("__rank") - 1).alias("i"), "ms")
    at = _find_runs([np.diff(p) for p in parts], ranked, threshold)
    if min(at) < 0:
        raise ValueError("the pulses of the two clocks don't match")
    y = [r[0] for a in at for r in ranked.where((F.col("i") >= a) & (F.col("i") < a + window)).orderBy("i").select("ms").collect()]
    slope, intercept = np.polyfit(np.concatenate(parts), np.array(y), 1)
    return float(slope) / 1000, float(intercept) / 1000


def _find_runs(needles: list[np.ndarray], ranked: DataFrame, most: float, size: int = 1 << 16) -> list[int]:
    """Of each needle the first place ``i`` of (i, ms) from which the gaps are the needle's; in stretches with a halo of the longest."""
    halo = max(map(len, needles))
    size, i = max(size, halo), F.col("i")
    home = F.floor(i / size)
    stretches = ranked.withColumn("stretch", F.explode(F.array_compact(F.array(home, F.when((i % size < halo) & (home > 0), home - 1)))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        gaps, start = np.diff(pdf["ms"].to_numpy()), int(pdf["i"].iloc[0])
        got = [(k, start + at) for k, needle in enumerate(needles) if (at := find_needle(needle, gaps, most)) >= 0]
        return pd.DataFrame(got, columns=["needle", "at"])

    found = stretches.groupBy("stretch").applyInPandas(run, "needle int, at long").groupBy("needle").agg(F.min("at")).collect()
    return [dict(map(tuple, found)).get(k, -1) for k in range(len(needles))]


def align(events: DataFrame, annotations: DataFrame, pulses: DataFrame, esrc: str, annotation: str = "S255", time_col: str = "mstime", **kw) -> DataFrame:
    """Events with ``esrc`` and ``eoffset`` in seconds. ``annotations``: (onset, annotation) of the recording; ``pulses``: (time) in ms."""
    line = times_to_offsets_tables(annotations.where(F.col("annotation") == annotation).select("onset"), pulses.select("time"), **kw)
    return events.withColumns({"esrc": F.lit(esrc), "eoffset": apply_line(F.col(time_col), line)})
