"""Token counts of a piece-BPE model (scores, dummy prefix, byte fallback) without making ids.

The symbols of a text start as its characters, linked left and right; a heap gives the adjacent pair whose
merged piece has the best rank, leftmost first. Each merge takes one from the count. A character that is no
piece counts as its UTF-8 bytes.

A piece that has U+2581 after another character does not exist in the models this reads (checked on
loading), so no merge crosses the front of a word, and words are counted apart and remembered.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, new_key, once_per_process

SPACE = "▁"


def read_pieces(path: str) -> dict:
    """``rank`` of every mergeable piece, and the normaliser's switches, read from the model file."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    spec = m.normalizer_spec
    if m.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not m.trainer_spec.byte_fallback:
        raise ValueError("a BPE model with identity normalisation, kept white space and byte fallback is needed")
    if any(p.type == 4 for p in m.pieces):
        raise ValueError("user-defined symbols are not read")
    # normal (1) and unused (5) pieces take part in merges; control, unknown and byte pieces don't
    scored = {p.piece: -p.score for p in m.pieces if p.type in (1, 5)}
    return {"rank": scored, "dummy_prefix": bool(spec.add_dummy_prefix)}


class PieceCounter:
    def __init__(self, model: dict, memo: int = 64_000_000):
        self.rank, self.prefix = model["rank"], SPACE if model["dummy_prefix"] else ""
        self.single = {p for p in self.rank if len(p) == 1}
        inside = {c for p in self.rank if len(p) > 1 for c in p}
        cross = any(SPACE in p.lstrip(SPACE) for p in self.rank)
        # chunks that no merge can cross
        if cross:
            self.chunks = lambda s: [s]
        else:
            self.chunks = re.compile(f"{SPACE}+[^{SPACE}\\n]*|[^{SPACE}\\n]+|\\n" if "\n" not in inside else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
        self.most = memo
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = _Counts(self, self.most)

    def chunk(self, s: str) -> int:
        """Initial symbols minus merges, plus what byte fallback adds."""
        rank, n = self.rank, len(s)
        if s in rank and n == 1:
            return 1
        part: list[str | None] = list(s)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, s[i : i + 2]) for i in range(n - 1) if (r := rank.get(s[i : i + 2])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = right[i]
            if part[i] is None or j >= n or part[i] + part[j] != joined:
                continue
            part[i], part[j] = joined, None
            merges += 1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := rank.get(joined + part[k])) is not None:
                    heapq.heappush(heap, (r, i, joined + part[k]))
            if (k := left[i]) >= 0 and (r := rank.get(part[k] + joined)) is not None:
                heapq.heappush(heap, (r, k, part[k] + joined))
        more = 0
        if not self.single.issuperset(s):
            more = sum(len(p.encode()) - 1 for p in part if p is not None and len(p) == 1 and p not in self.single)
        return n - merges + more

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(self.memo.__getitem__, self.chunks(self.prefix + text.replace(" ", SPACE))))


class _Counts(dict):
    """Chunk -> count, in two generations of about ``most`` / 2 bytes each, as in :mod:`axisframe.llm.bpe`."""

    def __init__(self, counter: PieceCounter, most: int):
        self.counter, self.most, self.size, self.old = counter, most // 2, 0, {}

    def __missing__(self, s: str) -> int:
        n = self.old.get(s)
        if n is None:
            n = self.counter.chunk(s)
        if len(s) <= 64:
            self.size += 150 + 2 * len(s)
            if self.size > self.most:
                self.old, self.size = dict(self), 0
                self.clear()
            self[s] = n
        return n


def count_tokens(docs: DataFrame, model: dict, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).

    A null or empty text has 0 bytes and 0 tokens. Repeated rows are each counted; other columns are ignored; an empty
    table gives an empty one. Texts of any length are counted whole, a word at a time.
    ``model`` (see :func:`read_pieces`) is one vocabulary, broadcast once.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(model), new_key()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = once_per_process("pieces", key, lambda: PieceCounter(shared.value))
        counter.forget()  # a memo is a task's own: workers that wait hold none
        count = counter.count
        for batch in batches:
            sizes, counts = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                sizes.append(len(text) if text.isascii() else len(text.encode()))
                counts.append(count(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                [id_col, "n_bytes", "n_tokens", "over_limit"],
            )
        counter.forget()

    pick = docs.select(id_col, text_col)
    return pick.mapInArrow(lean(run), f"`{id_col}` {pick.schema[0].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
