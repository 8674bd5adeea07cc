"""Language identification by bit-sliced Bloom filters of n-grams.

Every n-gram of a language's training sample is in that language's set. All sets share one table of Bloom-filter
slots, bit-sliced by language: a slot is a bitmask with a bit for each language (as many machine words as there need
be), so the AND of an n-gram's few slots names every language whose set holds it. A document's bits are counted by
language, each count is corrected for the rate at which that language's filter says yes to strangers, and the largest
count decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, lean, new_key, once_per_process, sample_rows, splitmix

N = 4
U = np.uint64


def letter_table() -> np.ndarray:
    """Code point -> its lower case if it is a letter, else a space."""
    return np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 32 for c in range(0x110000)], np.uint32)


def _codes(text: str, letters: np.ndarray) -> np.ndarray:
    return letters[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def _squeezed(codes: np.ndarray) -> np.ndarray:
    """Where to keep codes so that runs of spaces are one."""
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    return keep


def _windows(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of N codes, and whether it keeps clear of what stands between texts (0)."""
    n = max(0, len(codes) - N + 1)
    wide, inside = codes.astype(U), codes != 0
    h, whole = wide[:n] * U(0x9E3779B97F4A7C15), inside[:n].copy()
    for k in range(1, N):
        h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9) + wide[k : n + k]
        whole &= inside[k : n + k]
    return splitmix(h), whole


def grams(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of N code points (lower case, other than letters as one space) and where each text's begin.

    A text is padded by a space at either end. Runs of spaces count as one, and no n-gram reaches into the next text.
    """
    codes = _codes("".join([f" {t} \0" for t in texts]), letters)
    ends = np.cumsum([len(t) + 3 for t in texts], dtype=np.int64)
    codes[ends - 1] = 0  # what stands between texts
    keep = _squeezed(codes)
    at = np.concatenate([[0], np.cumsum(keep)])
    h, whole = _windows(codes[keep])
    before = np.concatenate([[0], np.cumsum(whole)])
    starts = at[np.concatenate([[0], ends[:-1]])] if texts else np.zeros(0, np.int64)
    return h[whole], before[np.minimum(starts, len(whole))]


def long_grams(text: str, letters: np.ndarray, chars: int) -> Iterator[np.ndarray]:
    """The same hashes of one text of any length, ``chars`` characters at a time; each n-gram comes once."""
    tail = np.full(1, 32, np.uint32)
    for at in range(0, len(text) + 1, chars):
        piece = text[at : at + chars]
        codes = np.concatenate([tail, _codes(piece + " " * (at + chars > len(text)), letters)])
        codes = codes[_squeezed(codes)]
        yield _windows(codes)[0]
        tail = codes[-(N - 1) :]


@dataclass
class Filters:
    languages: list[str]
    table: np.ndarray  # slots x words of language bits
    probes: int
    rate: np.ndarray  # share of strangers each language's filter says yes to

    @property
    def width(self) -> int:
        """Languages in a word."""
        return self.table.dtype.itemsize * 8

    def places(self, h: np.ndarray) -> Iterator[np.ndarray]:
        shift = U(64 - (len(self.table).bit_length() - 1))
        for k in range(self.probes):
            yield (h * U(2 * k + 1) + U(k) * (h >> U(7))) >> shift

    def add(self, language: int, h: np.ndarray) -> None:
        word, bit = divmod(language, self.width)
        for at in self.places(h):
            self.table[at, word] |= self.table.dtype.type(1 << bit)

    def masks(self, h: np.ndarray) -> np.ndarray:
        """For each n-gram the words of the bits of all languages that hold it."""
        places = self.places(h)
        got = self.table[next(places)]
        for at in places:
            got &= self.table[at]
        return got

    def bits(self, masks: np.ndarray, language: int) -> np.ndarray:
        word, bit = divmod(language, self.width)
        return (masks[:, word] >> masks.dtype.type(bit)) & masks.dtype.type(1)


def build(sets: dict[str, np.ndarray], probes: int = 2, room: int = 8) -> Filters:
    """Filters of the n-gram hashes of each language, all of them.

    The table has a power of two of slots, ``room`` times the largest set at least, so its size follows from the
    training sample, which is bounded.
    """
    languages = sorted(sets)
    most = max([len(np.unique(s)) for s in sets.values()], default=0)
    slots = 1 << max(10, (room * most - 1).bit_length())
    size = next((k for k in (8, 16, 32) if len(languages) <= k), 64)
    got = Filters(languages, np.zeros((slots, max(1, -(-len(languages) // size))), f"uint{size}"), probes, np.zeros(len(languages)))
    for i, language in enumerate(languages):
        got.add(i, sets[language])
        got.rate[i] = float(got.bits(got.table, i).mean()) ** probes
    return got


def train(samples: list[tuple[str, str]]) -> Filters:
    """Filters from (language, text)."""
    letters = letter_table()
    return build({lang: np.unique(grams([t or "" for one, t in samples if one == lang], letters)[0]) for lang in {lang for lang, _ in samples}})


def decide(texts: list[str], model: Filters, letters: np.ndarray, chars: int = 500_000) -> tuple[list[str], list[float]]:
    """Language and score of each text, by corrected popcounts. Without a letter: ``und`` and 0. Ties go to the first language by name."""
    k = len(model.languages)
    if not k:
        return ["und"] * len(texts), [0.0] * len(texts)
    seen, total = np.zeros((k, len(texts))), np.zeros(len(texts))
    short = [i for i, t in enumerate(texts) if len(t) <= chars]
    if short:
        h, starts = grams([texts[i] for i in short], letters)
        ends = np.concatenate([starts[1:], [len(h)]])
        total[short] = ends - starts
        masks = model.masks(h)
        for i in range(k):
            run = np.concatenate([[0], np.cumsum(model.bits(masks, i), dtype=np.int64)])
            seen[i, short] = run[ends] - run[starts]
    for j in set(range(len(texts))).difference(short):
        for h in long_grams(texts[j], letters, chars):
            masks = model.masks(h)
            total[j] += len(h)
            for i in range(k):
                seen[i, j] += int(model.bits(masks, i).sum(dtype=np.int64))
    rate = model.rate[:, None]
    score = np.maximum(0.0, (seen - total * rate) / (1 - np.minimum(rate, 0.99)))
    best = score.argmax(axis=0)
    share = (score.max(axis=0) + 1 / k) / (score.sum(axis=0) + 1)
    pred, out = [], []
    for t, b, s in zip(texts, best, share, strict=True):
        some = any(map(str.isalpha, t))
        pred.append(model.languages[b] if some else "und")
        out.append(float(s) if some else 0.0)
    return pred, out


def fit(docs: DataFrame, per_language: int = 300, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", chars: int = 500_000) -> Filters:
    """Filters from about ``per_language`` rows of each language outside the held-out third.

    ``per_language`` bounds the sample, the only bound there is: of the sampled rows' whole texts every n-gram goes in,
    for any number of languages. Rows are picked by a hash of the id. Distinct n-grams, not texts, come to the driver.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(~held_out(F.col("id")) & F.col("text").isNotNull())
    rows = sample_rows(known, "id", "lang", per_language).select(F.col("lang").cast("string").alias("lang"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                for h in long_grams(text.as_py(), letters, chars):
                    h = np.unique(h).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(h)), pa.array(h)], ["lang", "gram"])

    got = rows.mapInArrow(lean(run), "lang string, gram long").distinct().toPandas()
    return build({str(lang): g.to_numpy().view(U) for lang, g in got.groupby("lang")["gram"]})


def predict(docs: DataFrame, model: Filters, id_col: str = "doc_id", text_col: str = "text", chars: int = 500_000) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``lang_pred``, ``score``.

    Only the text decides. Null texts and texts without a letter are ``und`` with score 0; a model without languages
    gives ``und`` to all. Texts of any length are read whole, about ``chars`` characters at a time. Repeated rows are
    each predicted; other columns are ignored; an empty table gives an empty one. The filters' size is set by the
    bounded training sample (a megabyte or two), broadcast once.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(model), new_key()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, letters = once_per_process("langid", key, lambda: (shared.value, letter_table()))
        for batch in batches:
            pred, score, part, size = [], [], [], 0
            for i, value in enumerate(batch.column(2)):
                part.append(value.as_py() or "")
                size += len(part[-1])
                if size > chars or i == batch.num_rows - 1:
                    a, b = decide(part, model, letters, chars)
                    pred, score, part, size = pred + a, score + b, [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())], [id_col, "held_out", "lang_pred", "score"])

    pick = docs.select(id_col, held_out(F.col(id_col)).alias("held_out"), text_col)
    return pick.mapInArrow(lean(run), f"`{id_col}` {pick.schema[0].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
