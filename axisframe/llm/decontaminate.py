"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters with an error budget of k edits is cut into k + 1 pieces. Where the item occurs with at
most k edits, one piece at least occurs unchanged, so exact hits of pieces are the only places to look. They are found
by rolling hashes: pieces have few lengths, and for each the hash of every window of a text is looked up in a table of
all pieces. A hit is verified by Myers' bit-parallel distance, first against the neighbouring pieces: of two
neighbouring groups of pieces with budgets a and b, one at least keeps to its own if both together keep to a + b + 1.
So short checks turn away most hits before the whole item is compared, and none is lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, new_key, once_per_process

U = np.uint64
STEP, BACK = 0xD1B54A32D192ED03, pow(0xD1B54A32D192ED03, -1, 1 << 64)

_GAPS = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    """Lower case; everything but letters and digits becomes one space; a space at either end."""
    return " " + _GAPS.sub(" ", (text or "").lower()).strip() + " "


def budget(n: int, share: float) -> int:
    return int(n * share)


class Myers:
    """Least edit distance between a pattern and any substring of a text."""

    def __init__(self, pattern: str):
        self.m = len(pattern)
        self.mask = (1 << self.m) - 1
        self.high = 1 << (self.m - 1)
        self.at: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.at[c] = self.at.get(c, 0) | 1 << i

    def search(self, text: str) -> int:
        at, mask, high = self.at.get, self.mask, self.high
        up, down, score = mask, 0, self.m
        best = score
        for c in text:
            eq = at(c, 0)
            vertical = eq | down
            horizontal = (((eq & up) + up) ^ up) | eq
            plus = (down | ~(horizontal | up)) & mask
            minus = up & horizontal
            if plus & high:
                score += 1
            elif minus & high:
                score -= 1
                if score < best:
                    best = score
            plus = plus << 1
            up = ((minus << 1) | ~(vertical | plus)) & mask
            down = plus & vertical & mask
        return best


class Rolling:
    """Hashes of windows of an array of codes: differences of one running sum, in powers of an odd number modulo 2**64."""

    ahead, behind = np.ones(1, U), np.ones(1, U)

    def __init__(self, codes: np.ndarray):
        n = len(codes) + 1
        if len(Rolling.ahead) < n:
            size = 1 << n.bit_length()
            Rolling.ahead = np.cumprod(np.concatenate([np.ones(1, U), np.full(size, STEP, U)]))
            Rolling.behind = np.cumprod(np.concatenate([np.ones(1, U), np.full(size, BACK, U)]))
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(codes.astype(U) * Rolling.ahead[: n - 1])])

    def windows(self, length: int) -> np.ndarray:
        """Hash of every window of ``length`` codes, by where it begins."""
        n = max(0, len(self.sums) - length)
        return (self.sums[length : length + n] - self.sums[:n]) * Rolling.behind[:n] * U(0x9E3779B97F4A7C15)

    def at(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[begin]) * Rolling.behind[begin] * U(0x9E3779B97F4A7C15)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Matcher:
    """All items' pieces in one table; ``find`` gives (item, edits) of every item a text contains."""

    stretch = 1 << 18  # characters hashed at once

    def __init__(self, items: list[tuple[object, str]], share: float):
        self.items = items
        self.budgets = [budget(len(t), share) for _, t in items]
        self.checks: dict[tuple[int, int, int], Myers] = {}
        size, pieces = np.array([len(t) for _, t in items], np.int64), np.array(self.budgets, np.int64) + 1
        number = np.repeat(np.arange(len(items)), pieces)
        leaf = np.arange(len(number)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, last = size[number] * leaf // pieces[number], size[number] * (leaf + 1) // pieces[number]
        hashes = np.zeros(len(number), U)
        part, total = [], 0
        for i in range(len(items) + 1):  # items are hashed some at a time
            if part and (i == len(items) or total > self.stretch):
                rolling, begin = Rolling(codes_of("".join(items[j][1] for j in part))), np.concatenate([[0], np.cumsum(size[part])])
                of = slice(np.searchsorted(number, part[0]), np.searchsorted(number, part[-1], "right"))
                shift = begin[number[of] - part[0]]
                hashes[of] = rolling.at(shift + first[of], shift + last[of])
                part, total = [], 0
            if i < len(items):
                part.append(i)
                total += len(items[i][1])
        #: by the length of pieces: hashes in order, and whose pieces they are
        self.pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in np.unique(last - first).tolist():
            of = np.flatnonzero(last - first == length)
            of = of[np.argsort(hashes[of], kind="stable")]
            self.pieces[length] = hashes[of], number[of].astype(np.int32), leaf[of].astype(np.int32)
        bits = max(12, (8 * len(number)).bit_length())
        self.shift, self.seen = U(64 - bits), np.zeros(1 << bits, bool)  # which leading bits any piece has
        self.seen[hashes >> self.shift] = True

    def cut(self, number: int, j: int) -> int:
        return len(self.items[number][1]) * j // (self.budgets[number] + 1)

    def check(self, number: int, a: int, b: int) -> Myers:
        """Comparison with the stretch of pieces a..b-1 of an item."""
        got = self.checks.get((number, a, b))
        if got is None:
            if len(self.checks) > 20_000:
                self.checks.clear()
            got = self.checks[number, a, b] = Myers(self.items[number][1][self.cut(number, a) : self.cut(number, b)])
        return got

    def verify(self, text: str, number: int, leaf: int, at: int) -> int | None:
        """Edits of the item around the exact hit of a piece that begins at ``at``; None beyond the budget."""
        first, last = self.cut(number, leaf), self.cut(number, leaf + 1)
        if not text.startswith(self.items[number][1][first:last], at):
            return None  # only the hashes agree
        # the way from the root of a balanced tree of pieces down to the leaf
        way, a, b = [], 0, self.budgets[number] + 1
        while b - a > 1:
            way.append((a, b))
            mid = (a + b) // 2
            a, b = (a, mid) if leaf < mid else (mid, b)
        origin, edits = at - first, 0
        for a, b in reversed(way):
            k = b - a - 1
            edits = self.check(number, a, b).search(text[max(0, origin + self.cut(number, a) - k) : origin + self.cut(number, b) + k])
            if edits > k:
                return None
        return edits

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, item number, piece) wherever a window's hash is that of a piece."""
        rolling, out = Rolling(codes), []
        for length, (hashes, number, leaf) in self.pieces.items():
            h = rolling.windows(length)
            at = np.flatnonzero(self.seen[h >> self.shift])
            h = h[at]
            low, high = np.searchsorted(hashes, h), np.searchsorted(hashes, h, "right")
            n = high - low
            of = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            out.append((np.repeat(at, n), number[of], leaf[of]))
        return tuple(np.concatenate([x[i] for x in out]) for i in range(3))

    def find_all(self, texts: list[str | None]) -> list[list[tuple[object, int]]]:
        """For each text (item id, least edits), in the order of items."""
        out: list[list] = [[] for _ in texts]
        if not self.items:
            return out
        part, size = [], 0
        for i, text in enumerate(texts):
            part.append((i, normalise(text)))
            size += len(part[-1][1])
            if size > self.stretch or i == len(texts) - 1:
                self._find(part, out)
                part, size = [], 0
        return out

    def _find(self, part: list[tuple[int, str]], out: list[list]) -> None:
        codes = codes_of("\0".join([t for _, t in part]))
        begin = np.cumsum([0] + [len(t) + 1 for _, t in part[:-1]])
        found: dict[tuple[int, int], int] = {}
        done = set()
        longest = max(self.pieces)
        for base in range(0, len(codes), self.stretch):  # a stretch at a time, so that one long text needs no more
            place, number, leaf = self.hits(codes[base : base + self.stretch + longest - 1])
            place = place + base
            which = np.searchsorted(begin, place, "right") - 1
            for w, at, n, k in zip(which.tolist(), (place - begin[which]).tolist(), number.tolist(), leaf.tolist(), strict=True):
                origin = (w, n, at - self.cut(n, k))
                if found.get((w, n)) == 0 or origin in done:
                    continue
                edits = self.verify(part[w][1], n, k, at)
                if edits is not None:
                    done.add(origin)  # other pieces of this occurrence give nothing new
                    found[w, n] = min(edits, found.get((w, n), edits))
        for (w, n), edits in sorted(found.items()):
            out[part[w][0]].append((self.items[n][0], edits))

    def find(self, text: str | None) -> list[tuple[object, int]]:
        return self.find_all([text])[0]


def blocks(benchmark: DataFrame, id_col: str, text_col: str, chars: int) -> Iterator[list[tuple[object, str]]]:
    """The items, normalised, in blocks of about ``chars`` characters, so that no block grows with the benchmark.

    Nulls and items without a letter or digit hold nothing to look for and are left out.
    """
    part, size = [], 0
    rows = benchmark.select(id_col, text_col).where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).distinct().orderBy(id_col, text_col)
    for item, text in rows.toLocalIterator():
        text = normalise(text)
        if text.strip():
            part.append((item, text))
            size += len(text)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def _matcher(docs: DataFrame, items: list[tuple[object, str]], share: float):
    """A function that gives each worker process its matcher, made once."""
    shared, key = docs.sparkSession.sparkContext.broadcast((items, share)), new_key()
    return lambda: once_per_process("decontaminate", key, lambda: Matcher(*shared.value))


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.1, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", chars: int = 16_000_000) -> DataFrame:
    """One row per document and item that it contains: id, item id, ``edits`` (least over its occurrences).

    Texts are compared in lower case, runs of other than letters and digits as one space. An item of n such
    characters may differ by ``int(share * n)`` edits, so items under 1 / share characters are matched exactly, as
    whole words. Null and wordless texts and items match nothing; ids are of any type; rows that repeat an id give one
    row an item, a null id too; items that share an id are one item with several texts (the least edits count). Other
    columns are ignored, whatever their names; empty tables give an empty one. The benchmark is read in blocks of
    ``chars`` characters, each a pass over ``docs``, so a worker's memory doesn't grow with it.
    """
    pick, kind = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), benchmark.schema[item_col].dataType
    parts = []
    for items in blocks(benchmark, item_col, "text", chars):
        matcher = _matcher(docs, list(enumerate(t for _, t in items)), share)

        def run(batches: Iterator[pa.RecordBatch], matcher=matcher) -> Iterator[pa.RecordBatch]:
            find = matcher().find_all
            for batch in batches:
                found = find(batch.column(1).to_pylist())
                of = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), pa.array([n for f in found for n, _ in f], pa.int64()), pa.array([e for f in found for _, e in f], pa.int64())], ["id", "number", "edits"])

        hit = pick.mapInArrow(lean(run), T.StructType([T.StructField("id", pick.schema[0].dataType), T.StructField("number", T.LongType()), T.StructField("edits", T.LongType())]))
        ids = docs.sparkSession.createDataFrame([(n, i) for n, (i, _) in enumerate(items)], T.StructType([T.StructField("number", T.LongType()), T.StructField("item", kind)]))
        parts.append(hit.join(F.broadcast(ids), "number").select("id", "item", "edits"))  # of a block's items, bounded as it is
    if not parts:
        parts = [docs.sparkSession.createDataFrame([], T.StructType([T.StructField("id", pick.schema[0].dataType), T.StructField("item", kind), T.StructField("edits", T.LongType())]))]
    # an item's texts may stand in two blocks
    found = reduce(DataFrame.unionByName, parts).groupBy("id", "item").agg(F.min("edits").alias("edits"))
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "edits")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.1, text_col: str = "text", item_col: str = "item_id", chars: int = 16_000_000) -> DataFrame:
    """The rows of ``docs`` that contain no item of the benchmark, all columns, by the rules of :func:`find_leaks`.

    Null and wordless texts stay, as do all rows that repeat one that stays.
    """
    for items in blocks(benchmark, item_col, "text", chars):
        matcher, at = _matcher(docs, items, share), docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch], matcher=matcher, at=at) -> Iterator[pa.RecordBatch]:
            find = matcher().find_all
            for batch in batches:
                yield batch.filter(pa.array([not f for f in find(batch.column(at).to_pylist())], pa.bool_()))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs
