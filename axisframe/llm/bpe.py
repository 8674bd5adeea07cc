"""Byte-level byte-pair encoding by a rank file, and its inverse.

Two tiers. A pre-token that is itself in the vocabulary is found by a minimal perfect hash (hash and
displace, one slot for each token, the stored bytes compared). Any other is merged: its bytes form a
doubly linked list, and a heap gives the adjacent pair of lowest rank, leftmost first.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import lean, new_key, once_per_process

MIX = 0x9E3779B97F4A7C15
M64 = (1 << 64) - 1


class PerfectHash:
    """Minimal perfect hash from byte strings to 0..n-1; ``slot`` gives None for strangers."""

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.buckets = max(1, n // 3)
        groups: dict[int, list[tuple[int, bytes]]] = {}
        for k in keys:
            h = xxhash.xxh3_64_intdigest(k)
            groups.setdefault(h % self.buckets, []).append((h, k))
        self.shift = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * n
        order = sorted(groups.items(), key=lambda g: -len(g[1]))
        singles = []
        for b, members in order:
            if len(members) == 1:
                singles.append((b, members[0]))
                continue
            d = 1
            while True:
                places = {self._place(h, d) for h, _ in members}
                if len(places) == len(members) and all(self.keys[p] is None for p in places):
                    break
                d += 1
            self.shift[b] = d
            for h, k in members:
                self.keys[self._place(h, d)] = k
        free = (i for i, k in enumerate(self.keys) if k is None)
        for b, (_, k) in singles:
            i = next(free)
            self.shift[b] = -i - 1
            self.keys[i] = k

    def _place(self, h: int, d: int) -> int:
        x = (h ^ (d * MIX & M64)) * 0xFF51AFD7ED558CCD & M64
        return (x ^ x >> 33) % self.n

    def slot(self, key: bytes) -> int | None:
        if not self.n:
            return None
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        i = -d - 1 if d < 0 else self._place(h, d) if d else None
        return i if i is not None and self.keys[i] == key else None


class ByteBpe:
    """Encoder and decoder for ranks ``{token bytes: id}`` and a splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.text_of = {b"%d" % i: b for b, i in ranks.items()}
        self.hash = PerfectHash(list(ranks))
        self.id_at = [ranks[k] for k in self.hash.keys]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token by heap and linked list.

        A token is known by where it begins: ``end`` links it to the next one, ``left`` to the one before, ``pair`` is the
        rank of it with the next one (-1: none). A heap entry is rank and place in one number, and is out of date where
        ``pair`` says otherwise.
        """
        get, n, low = self.ranks.get, len(piece), (1 << 40) - 1
        pair = [get(piece[i : i + 2], -1) for i in range(n - 1)]
        pair.append(-1)
        heap = [r << 40 | i for i, r in enumerate(pair) if r >= 0]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        end, left = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            x = pop(heap)
            i = x & low
            if pair[i] != x >> 40:
                continue  # one side has been merged since
            j = end[i]
            end[i] = e = end[j]
            pair[j] = pair[i] = -1
            if e < n:
                left[e] = i
                if (r := get(piece[i : end[e]], -1)) >= 0:
                    pair[i] = r
                    push(heap, r << 40 | i)
            if (k := left[i]) >= 0:
                pair[k] = r = get(piece[k:e], -1)
                if r >= 0:
                    push(heap, r << 40 | k)
        out, i, ranks = [], 0, self.ranks
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def piece(self, text: str) -> list[int]:
        """Ids of one pre-token."""
        raw = text.encode()
        i = self.hash.slot(raw)
        return [self.id_at[i]] if i is not None else self.merge(raw)

    def encode(self, text: str | None) -> list[int]:
        return [i for p in self.find(text or "") for i in self.piece(p)]

    def decode(self, ids) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def decode_text(self, ids: bytes) -> bytes:
        """The same of decimal ids joined by commas."""
        return b"".join(map(self.text_of.__getitem__, ids.split(b","))) if ids else b""


class _Memo(dict):
    """Pre-token -> its ids as text, in two generations of about ``most`` / 2 bytes each.

    When the young one is full it becomes the old one, and what is met again comes back from there; so common pre-tokens
    stay, and memory is bounded.
    """

    def __init__(self, bpe: ByteBpe, most: int):
        self.bpe, self.most, self.size, self.old = bpe, most // 2, 0, {}

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            got = b",".join([b"%d" % i for i in self.bpe.piece(piece)])
        if len(piece) <= 64:
            self.size += 190 + len(piece) + len(got)
            if self.size > self.most:
                self.old, self.size = dict(self), 0
                self.clear()
            self[piece] = got
        return got


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encode_documents(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", memo: int = 96_000_000
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    A null text counts as empty (0 tokens, digests of nothing). Repeated rows are each encoded. Other columns
    are ignored. A lone pre-token may be as long as the text; it is merged in O(n log n). ``ranks`` is the
    vocabulary file, tens of thousands of entries, broadcast once. ``memo`` bounds the bytes each task
    keeps of pre-tokens it has met; results don't depend on it. An empty table gives an empty one.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast((ranks, pattern)), new_key()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = once_per_process("bpe", key, lambda: ByteBpe(*shared.value))
        get, find, sha = _Memo(bpe, memo).__getitem__, bpe.find, hashlib.sha256  # a task's own: workers that wait hold none
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                csv = b",".join(map(get, find(text.as_py() or "")))
                counts.append(csv.count(b",") + 1 if csv else 0)
                ids_sha.append(sha(csv).hexdigest())
                text_sha.append(sha(bpe.decode_text(csv)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names)

    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
    pick = docs.select(id_col, text_col)
    kind = pick.schema[0].dataType.simpleString()
    return pick.mapInArrow(lean(run), f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_to_ids(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``token_ids`` array<int>: the encoding itself, for training shards. Null text: empty array."""
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    from pyspark.sql import types as T

    schema = T.StructType([f for f in docs.schema.fields if f.name != "token_ids"] + [T.StructField("token_ids", T.ArrayType(T.IntegerType()))])
    rest = [f.name for f in schema.fields[:-1]]

    def run(batches):
        bpe = ByteBpe(*shared.value)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in rest], pa.array(ids, pa.list_(pa.int32()))], [*rest, "token_ids"])

    return docs.mapInArrow(lean(run), schema)
