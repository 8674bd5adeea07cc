"""Near-duplicates by BagMinHash signatures of word shingles.

A text is the multiset of its runs of five words. Every shingle drives Poisson processes over its weight, which is
discretised to whole numbers: the weight axis is cut into dyadic intervals [0,1), [1,2), [2,4), ... and each has a
process whose rate is the interval's length, seeded by shingle and interval. A point has a time, a place in the
interval and a register; it counts if its place lies below the shingle's weight. A register keeps the earliest
time it meets. Two texts agree in a register with the probability of their weighted Jaccard similarity, without
bias, and as points come in order of time only about m log m of them are made for a text, however long it is.

Registers are banded. Texts of equal multisets are one group from the start. In each bucket of a band all members are
compared with the bucket's centre, exactly, by multiset overlap, never all with all. Where members are then still in
different classes, the pairs across classes that can be links are found by what sets each apart from the centre.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from ..plans.lineage import materialise, scratch, sized
from .common import fresh, lean, splitmix

U = np.uint64
_WORD = re.compile(r"\w+")
GOLD = U(0x9E3779B97F4A7C15)


class Words(dict):
    """Word -> 64-bit hash, remembered up to a bound."""

    most = 150_000

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(texts: list[str | None], width: int, words: Words) -> list[np.ndarray]:
    """Hashes of each text's runs of ``width`` words (\\w+, lower case), repeats kept; shorter texts are one run, wordless ones none."""
    out, get = [], words.__getitem__
    for t in texts:
        w = _WORD.findall((t or "").lower())
        h = np.fromiter(map(get, w), U, len(w))
        if not len(w):
            out.append(h)
            continue
        k = min(width, len(w))
        s = np.zeros(len(w) - k + 1, U)
        for i in range(k):
            s = s * U(0x9FB21C651E98DF25) + h[i : len(w) - k + 1 + i]
        out.append(splitmix(s + U(k)))
    return out


def bag(sh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(sh, return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets; 0 if one is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    same = a[0][at] == b[0]
    both = int(np.minimum(a[1][at[same]], b[1][same]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """A row of ``m`` (a power of two) register times for each multiset; infinite for empty ones."""
    docs = len(bags)
    sizes = np.array([len(b[0]) for b in bags], np.int64)
    regs = np.full(docs * m, np.inf)
    if not sizes.sum():
        return regs.reshape(docs, m)
    key, weight = np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags]).astype(np.int64)
    owner = np.repeat(np.arange(docs), sizes)
    # processes: one for each dyadic interval that begins below the weight
    deep = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1  # weight 1: [0,1); 2: and [1,2); 3, 4: and [2,4)
    proc = np.repeat(np.arange(len(key)), deep)
    level = np.arange(len(proc)) - np.repeat(np.cumsum(deep) - deep, deep)
    low = np.where(level > 0, np.left_shift(1, np.maximum(level - 1, 0)), 0)
    length = np.maximum(low, 1).astype(float)
    part = (weight[proc] - low) / length  # share of the interval below the weight
    seed = splitmix(key[proc] + GOLD * level.astype(U))
    doc = owner[proc]
    mass = np.bincount(owner, weight, docs)
    limit = m * (np.log(m) + 2.5) / np.maximum(mass, 1)  # of time: by then most texts have a point in every register
    count, time = np.zeros(len(proc), U), np.zeros(len(proc))

    def draw(which: np.ndarray) -> np.ndarray:
        """Adds the next gap to these processes' times; gives the random bits of the new points."""
        count[which] += U(1)
        bits = splitmix(seed[which] + GOLD * count[which])
        time[which] -= np.log(((bits >> U(12)).astype(float) + 0.5) * 2.0**-52) / length[which]
        return bits

    active, pending = np.arange(len(proc)), []  # pending: processes whose next point is beyond the limit
    bits = draw(active)
    while True:
        while len(active):
            go = time[active] <= limit[doc[active]]
            now, b = active[go], bits[go]
            if not len(now):
                break
            ok = slice(None)
            if (part[now] < 1).any():
                ok = (splitmix(b ^ U(0xD6E8FEB86659FD93)) >> U(11)).astype(float) * 2.0**-53 < part[now]
            np.minimum.at(regs, doc[now][ok] * m + (b[ok] & U(m - 1)).astype(np.int64), time[now][ok])
            if not go.all():
                pending.append((active[~go], bits[~go]))
            bits, active = draw(now), now
        if len(active):
            pending.append((active, bits))
        short = np.isinf(regs.reshape(docs, m)).any(axis=1) & (mass > 0)
        if not short.any():
            return regs.reshape(docs, m)
        limit = limit * np.where(short, 2, 1)
        held = np.concatenate([p[0] for p in pending]), np.concatenate([p[1] for p in pending])
        again = short[doc[held[0]]]
        active, bits = held[0][again], held[1][again]
        pending = []


def _signed(batch_texts: list[str | None], width: int, m: int, rows_per_band: int, words: Words):
    """Band hashes (a list for each text, empty for wordless ones) and two 64-bit sums that name the multiset."""
    bags = [bag(s) for s in shingles(batch_texts, width, words)]
    sig = signatures(bags, m).view(U)
    bands = m // rows_per_band
    h = np.zeros((len(bags), bands), U)
    for r in range(rows_per_band):
        h = splitmix(h * U(31) + sig[:, r * bands : (r + 1) * bands] + U(r + 1))
    h = splitmix(h + np.arange(bands, dtype=U) * GOLD).view(np.int64)
    names = []
    for k, c in bags:
        mixed = splitmix(k + GOLD * c.astype(U))
        names.append((int(mixed.sum(dtype=U).view(np.int64)), int(splitmix(mixed ^ GOLD).sum(dtype=U).view(np.int64))))
    return [list(x) if len(b[0]) else [] for x, b in zip(h, bags, strict=True)], names


def sign(docs: DataFrame, id_col: str, text_col: str, width: int, m: int, rows_per_band: int) -> DataFrame:
    """(id, name_a, name_b, bands, bytes of the text) of every row."""
    pick = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            bands, a, b, part, size = [], [], [], [], 0
            for i, value in enumerate(batch.column(1)):
                part.append(value.as_py())
                size += len(part[-1] or "")
                if size > 500_000 or i == batch.num_rows - 1:
                    got, names = _signed(part, width, m, rows_per_band, words)
                    bands += got
                    a += [n[0] for n in names]
                    b += [n[1] for n in names]
                    part, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pc.binary_length(batch.column(1)).cast(pa.int64())], ["id", "name_a", "name_b", "bands", "bytes"])

    return pick.mapInArrow(lean(run), f"id {pick.schema[0].dataType.simpleString()}, name_a long, name_b long, bands array<long>, bytes long")


def with_texts(pairs: DataFrame, texts: DataFrame, keep, rows: int, load: int = 1000) -> DataFrame:
    """``pairs`` (a, b, ...) with ``text_a`` and ``text_b``.

    A ``b`` of more than ``load`` pairs is dealt out in parts of about that many, its text sent to each part, so no
    key holds a family's whole texts however large the family is. ``rows``: about how many pairs there are, to size files.
    """
    crowds = pairs.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > load).select("b", F.ceil(F.col("n") / load).cast("int").alias("parts"))
    crowds = keep(sized(crowds, rows // load))
    left = pairs.join(crowds, "b", "left").withColumn("part", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")).join(crowds, "b", "left")
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return left.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(right, ["b", "part"]).drop("part")


def compare(pairs: DataFrame, texts: DataFrame, width: int, keep, rows: int) -> DataFrame:
    """``pairs`` (a, b) with ``similarity``: the exact overlap of the two texts' multisets."""
    joined = with_texts(pairs.select("a", "b"), texts, keep, rows).select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            out, last = [], (None, None)
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                y = y.as_py()
                if last[0] != y:
                    last = (y, bag(shingles([y], width, words)[0]))
                out.append(overlap(bag(shingles([x.as_py()], width, words)[0]), last[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["a", "b", "similarity"])

    kind = pairs.schema["a"].dataType.simpleString()
    return joined.mapInArrow(lean(run), f"a {kind}, b {kind}, similarity double")


def may_contain(ids: DataFrame, x: Column, bits: int = 23) -> Column:
    """False for most ``x`` that are not among ``ids``, never for one that is: rows that needn't be moved to the join after it.

    One bit an id in a table of 2**bits, a megabyte whatever the data; with far more ids than bits it lets all pass.
    """
    place = F.pmod(F.xxhash64("id"), F.lit(1 << bits))
    words = ids.select(F.shiftright(place, 6).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    table = [0] * (1 << bits - 6)
    for w, b in words.collect():
        table[w] = b
    at = F.pmod(F.xxhash64(x), F.lit(1 << bits))
    packed = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")
    return F.getbit(F.element_at(packed, F.shiftright(at, 6).cast("int") + 1), (at % 64).cast("int")) == 1


def deltas(pairs: DataFrame, texts: DataFrame, width: int, similarity: float, keep, rows: int, most: int = 500_000) -> DataFrame:
    """For each (rep, centre): ``elements``, by which the multisets differ, and the numbers the search below needs.

    An element is a shingle with a sign (the text lacks it, or adds it) and a copy number, as one hash. Rows go out
    whenever ``most`` elements have gathered.
    """
    joined = with_texts(pairs.select(F.col("rep").alias("a"), F.col("centre").alias("b"), "root"), texts, keep, rows)
    k = similarity / (1 + similarity)

    def copies(keys: np.ndarray, counts: np.ndarray, sign: int) -> np.ndarray:
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return splitmix(np.repeat(keys, counts) * U(2) + U(sign) + at.astype(U) * GOLD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            elements, cost, free, apart, last, begin, held = [], [], [], [], (None, None), 0, 0
            for i, (x, y) in enumerate(zip(batch.column(3), batch.column(4), strict=True)):
                y = y.as_py()
                if last[0] != y:
                    last = (y, bag(shingles([y], width, words)[0]))
                a, c = bag(shingles([x.as_py()], width, words)[0]), last[1]
                keys = np.union1d(a[0], c[0])
                diff = np.zeros(len(keys), np.int64)
                diff[np.searchsorted(keys, a[0])] += a[1]
                diff[np.searchsorted(keys, c[0])] -= c[1]
                more, less = diff > 0, diff < 0
                elements.append(np.concatenate([copies(keys[more], diff[more], 1), copies(keys[less], -diff[less], 0)]).view(np.int64))
                held += len(elements[-1])
                cost.append(float((1 - k) * -diff[less].sum() + k * diff[more].sum()))
                free.append(float((1 - 2 * k) * c[1].sum()))
                apart.append(overlap(a, c) < similarity)
                if held > most or i == batch.num_rows - 1:
                    rows = batch.slice(begin, i + 1 - begin)
                    yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(elements, pa.list_(pa.int64())), pa.array(cost, pa.float64()), pa.array(free, pa.float64()), pa.array(apart, pa.bool_())], ["rep", "centre", "root", "elements", "cost", "free", "apart"])
                    elements, cost, free, apart, begin, held = [], [], [], [], i + 1, 0

    kind = pairs.schema["rep"].dataType.simpleString()
    return joined.select("a", "b", "root", "text_a", "text_b").mapInArrow(lean(run), f"rep {kind}, centre {kind}, root {kind}, elements array<long>, cost double, free double, apart boolean")


def _across(placed: DataFrame, roots: DataFrame, texts: DataFrame, similarity: float, width: int, keep, rows: int) -> DataFrame:
    """Links between members of one bucket that their links to centres leave in different classes.

    Against a common centre C a text X lacks m and adds a shingles; let cost(X) = (1-k) m + k a with
    k = s / (1 + s), and free = (1-2k) |C|. Then X and Y are linked if and only if they share at least
    cost(X) + cost(Y) - free elements of what sets them apart from C. X is linked to C just if cost(X) <= free,
    so of a pair across classes one, X, has cost(X) > free, and then more than cost(Y) elements are shared. With
    elements in the order of how rare they are around C, two texts that share t of them share one among the first
    n - t + 1 of each: an exact prefix filter, in which what a family of copies has in common takes no part. Of the
    texts that share an element, those of the class most of them belong to meet only those of other classes.
    """
    seen = placed.where("rep != centre").select("rep", "centre").distinct()
    seen = seen.join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    mixed = seen.groupBy("centre").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("centre")
    mixed = keep(sized(mixed, rows))  # a row a centre: written, so that Spark knows its size and the crowd of a hot centre needn't move
    apart = keep(sized(deltas(seen.join(mixed, "centre"), texts, width, similarity, keep, rows), rows, 1024))
    each = apart.select("rep", "centre", F.explode("elements").alias("element"))
    rare = each.groupBy("centre", "element").agg(F.count("*").alias("n")).where("n > 1")
    # where an element stands in its text's order: those of one text alone come first and find nobody
    shared = each.join(rare, ["centre", "element"])
    order = Window.partitionBy("rep", "centre").orderBy(F.desc("n"), "element")
    behind = shared.withColumn("behind", F.row_number().over(order))  # 1: the commonest
    least = 1e-9
    facts = apart.select("rep", "centre", "root", "cost", "free", "apart")
    # how far beyond the centre's reach the nearest text that isn't linked to it is
    beyond = keep(sized(facts.where("apart").groupBy("centre").agg(F.min(F.col("cost") - F.col("free")).alias("gap")), rows))
    # ``behind`` counts the elements from this one on: no more can be shared by texts whose rarest shared element it is
    ranked = behind.join(facts, ["rep", "centre"]).join(beyond, "centre")
    ranked = ranked.withColumn("near", F.col("behind") >= F.col("cost") + F.greatest("gap", F.lit(0.0)) - least)
    ranked = ranked.withColumn("far", F.col("apart") & (F.col("behind") >= F.col("cost") - F.col("free") - least))
    ranked = keep(sized(ranked.where("near OR far"), rows, 1024))
    # the class that most entries of an element have, and elements that more than one class has
    by_class = ranked.groupBy("centre", "element", "root").agg(F.count("*").alias("n"))
    home = by_class.groupBy("centre", "element").agg(F.max_by("root", F.struct("n", "root")).alias("home"), F.count("*").alias("classes")).where("classes > 1").drop("classes")
    ranked = keep(sized(ranked.join(home, ["centre", "element"]).withColumn("at_home", F.col("root") == F.col("home")), rows * 8))
    x = ranked.where("far").select("centre", "element", "at_home", F.col("rep").alias("a"), F.col("root").alias("ra"), F.col("cost").alias("ca"), F.col("behind").alias("na"), "free")
    y = ranked.where("near").select("centre", "element", F.col("at_home").alias("home_b"), F.col("rep").alias("b"), F.col("root").alias("rb"), F.col("cost").alias("cb"), F.col("behind").alias("nb"))
    enough = (F.col("ra") != F.col("rb")) & (F.col("ca") + F.col("cb") - F.col("free") <= F.least("na", "nb") + least)
    pairs = x.where("NOT at_home").join(y, ["centre", "element"]).where(enough).select("a", "b")
    pairs = pairs.union(x.where("at_home").join(y.where("NOT home_b"), ["centre", "element"]).where(enough).select("a", "b"))
    pairs = keep(sized(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), rows * 8))
    if pairs.isEmpty():
        return pairs
    need = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    return keep(compare(pairs, texts.join(need, "id", "left_semi"), width, keep, rows).where(F.col("similarity") >= similarity).select("a", "b"))


def classes(docs: DataFrame, similarity: float = 0.8, width: int = 5, m: int = 64, rows_per_band: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``class_id`` (least id of its class), ``class_size``, ``kept`` (id = class_id).

    Two texts are linked if the weighted Jaccard similarity of their shingle multisets is ``similarity`` or more; a
    class is a connected component of links. Words are ``\\w+`` in lower case. Texts of fewer than ``width`` words are
    one shingle. Null and wordless texts are each their own class. Ids are of any type that can be ordered. Rows with a
    null id are their own class (of size 1, id null); rows that repeat an id share the least class id among those of
    its texts. Other columns are ignored; an empty table gives an empty one. At similarity s a pair shares no bucket
    with probability (1 - s**r)**(m // r): 3e-7 at 0.8 for the defaults.
    """
    with scratch(docs.sparkSession) as keep:
        signed = keep(sign(docs, id_col, text_col, width, m, rows_per_band))
        rows, volume = signed.agg(F.count("*"), F.sum("bytes")).first()
        bands = m // rows_per_band
        whole = signed.where(F.col("id").isNotNull() & (F.size("bands") > 0))
        # equal multisets: one stands for all
        named = keep(sized(whole.groupBy("name_a", "name_b").agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands")), rows, 32 + 8 * bands))
        entries = named.select("rep", F.explode("bands").alias("band"))
        crowds = entries.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
        crowded = keep(sized(entries.join(crowds, "band"), rows * bands, 24))
        # a bucket's centre is the member with the most company over all bands: of a family of copies, one close to their origin
        company = crowded.groupBy("rep").agg(F.sum("n").alias("company"))
        crowded = crowded.join(company, "rep")
        centres = crowded.groupBy("band").agg(F.min_by("rep", F.struct(-F.col("company"), "rep")).alias("centre"))
        placed = keep(sized(crowded.select("band", "rep").join(centres, "band"), rows * bands, 24))
        texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        wanted = placed.select(F.col("rep").alias("id")).distinct()
        texts = keep(sized(texts.where(may_contain(wanted, F.col("id"))).join(wanted, "id", "left_semi"), volume or 0, 1))
        pairs = placed.where("rep != centre").select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct()
        links = keep(sized(compare(pairs, texts, width, keep, rows).where(F.col("similarity") >= similarity).select("a", "b"), rows * 8))
        roots = components(links, keep, links.count())
        more = _across(placed, roots, texts, similarity, width, keep, rows)
        if not more.isEmpty():
            # links between classes: components of classes, then each text's
            a, b = (roots.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}")) for c in ("a", "b"))
            above = components(more.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).where("a != b"), keep, more.count())
            every = roots.select("id", "root").unionByName(above.select("id", F.col("id").alias("root")).join(roots.select("id"), "id", "left_anti"))
            roots = keep(sized(every.join(above.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left").select("id", F.coalesce("top", "root").alias("root")), rows))
        whose = whole.select("id", "name_a", "name_b").join(named.select("name_a", "name_b", "rep"), ["name_a", "name_b"]).select("id", "rep")
        rooted = whose.join(roots.withColumnRenamed("id", "rep"), "rep", "left").groupBy("id").agg(F.min(F.coalesce("root", "rep")).alias("class_id"))
        every = signed.select("id").join(rooted, "id", "left").withColumn("class_id", F.coalesce("class_id", "id"))
        every = materialise(sized(every, rows))
        # written first, so that the join below has exchanges of its own and one large class can be split over tasks
        size = materialise(sized(every.where(F.col("class_id").isNotNull()).groupBy("class_id").agg(F.count("*").alias("class_size")).where("class_size > 1"), rows))
    return every.join(size, "class_id", "left").select(F.col("id").alias(id_col), "class_id", F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("kept"))


def kept_rows(docs: DataFrame, marked: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """One row of each class that ``marked`` gives the rows of ``docs``, all columns: that with the least id.

    Of rows that repeat an id, which are one class, that with the least text stays (null before all others; of equal
    texts, the least row written as JSON). Rows with a null id all stay.
    """
    dropped = marked.where("NOT kept").select(F.col(id_col).alias("id")).distinct()
    # most rows needn't move: they can't be among those dropped
    doubt = may_contain(dropped, F.col(id_col))
    out = fresh("out", docs.columns)
    kept = docs.where(F.col(id_col).isNull() | ~doubt).unionByName(sized(docs.where(doubt).join(dropped.withColumnRenamed("id", out), F.col(id_col) == F.col(out), "left_anti"), dropped.count(), 4096))
    again = fresh("again", docs.columns)
    repeated = marked.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(again)).agg(F.count("*").alias("n")).where("n > 1").select(again)
    if repeated.isEmpty():
        return kept
    # partial aggregates: an id that very many rows repeat is settled task by task first
    one = kept.join(repeated, F.col(id_col) == F.col(again), "left_semi").groupBy(id_col).agg(F.min_by(F.struct(*docs.columns), F.struct(text_col, F.to_json(F.struct(*docs.columns)))).alias(again))
    return kept.join(repeated, F.col(id_col) == F.col(again), "left_anti").unionByName(one.select(f"{again}.*"))
