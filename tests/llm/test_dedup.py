"""Exact and near-duplicates against brute force."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from axisframe.llm import exact, near

from ..conftest import DATA, comparable

U = np.uint64


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return groups


def check_exact(df):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    groups = brute_exact(rows)
    got = exact.mark_copies(df)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    got = got.collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    import hashlib

    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_sha[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert sum(r["kept"] for r in got) == len(groups)


def test_exact_odd(odd):
    check_exact(odd)
    check_exact(odd.repartition(7))


def test_exact_empty(odd):
    assert exact.mark_copies(odd.limit(0)).count() == 0
    assert exact.drop_copies(odd.limit(0)).columns == odd.columns


def test_exact_documents(documents):
    check_exact(documents)


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_runs_that_cross_partitions(spark, parts):
    """One text in most rows: its run spans partitions and is mended."""
    df = spark.range(300).select((F.col("id") * 7 % 300).alias("doc_id"), F.when(F.col("id") % 3 < 2, "same").otherwise(F.concat(F.lit("t"), F.col("id") % 5)).alias("text"))
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check_exact(df)
        kept = exact.drop_copies(df)
        assert kept.count() == 6 and kept.where("text = 'same'").first()["doc_id"] == df.where("text = 'same'").agg(F.max("doc_id")).first()[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_shared_prefix(spark):
    df = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("p" * 500), (F.col("id") % 20).cast("string")).alias("text"))
    check_exact(df)


def test_drop_copies_keeps_columns(odd):
    got = exact.drop_copies(odd)
    assert got.columns == odd.columns
    rows = got.collect()
    assert len(rows) == len({r["text"] or "" for r in odd.collect()})
    assert {r["doc_id"] for r in rows if r["text"] and "quick" in r["text"]} == {6}


def test_columns_with_inner_names(spark):
    df = spark.createDataFrame([(1, "t", "p", "q", "r", "s"), (2, "t", "p2", "q2", "r2", "s2")], "doc_id long, text string, __prefix string, __hash string, prefix string, hash string")
    assert [tuple(r) for r in exact.drop_copies(df).collect()] == [(2, "t", "p2", "q2", "r2", "s2")]
    check_exact(df.withColumnsRenamed({"__prefix": "__keep", "__hash": "__id"}))


# -- near


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=60), st.lists(st.integers(0, 30), max_size=60))
def test_overlap_is_weighted_jaccard(a, b):
    x, y = Counter(a), Counter(b)
    lo, hi = sum((x & y).values()), sum((x | y).values())
    assert near.overlap(near.bag(np.array(a, U)), near.bag(np.array(b, U))) == pytest.approx(lo / hi if lo else 0)


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    error = []
    for _ in range(40):
        base = rng.integers(0, 2**63, rng.integers(3, 60)).astype(U)
        a, b = (near.bag(np.repeat(base, rng.integers(0, 7, len(base)))) for _ in range(2))
        s = near.signatures([a, b], 1024)
        error.append((s[0] == s[1]).mean() - near.overlap(a, b) if len(a[0]) and len(b[0]) else 0)
    assert abs(np.mean(error)) < 0.006 and np.std(error) < 0.02


def test_signatures_by_hand():
    """Registers of a small multiset equal the minimum over every point drawn one by one."""
    key, gold = np.array([11, 12], U), near.GOLD
    weight = np.array([1, 6])
    got = near.signatures([(key, weight)], 16)[0]
    want = np.full(16, np.inf)
    for k, w in zip(key, weight, strict=True):
        level, low = 0, 0
        while low < w:
            size = max(low, 1)
            seed, t, count = near.splitmix(np.array([k + gold * U(level)], U)), 0.0, 0
            while t < 100:
                count += 1
                bits = near.splitmix(seed + gold * U(count))
                t -= float(np.log((float(bits[0] >> U(12)) + 0.5) * 2.0**-52)) / size
                place = float(near.splitmix(bits ^ U(0xD6E8FEB86659FD93))[0] >> U(11)) * 2.0**-53
                if low + place * size < w:
                    r = int(bits[0] & U(15))
                    want[r] = min(want[r], t)
            low, level = low + size, level + 1
    np.testing.assert_allclose(got, want)


def brute_classes(rows, similarity=0.8):
    words = near.Words()
    bags = {i: near.bag(s) for (i, _), s in zip(rows, near.shingles([t for _, t in rows], 5, words), strict=True)}
    root = {i: i for i in bags}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in bags if len(bags[i][0]))
    shared = defaultdict(set)
    for i in ids:
        for k in bags[i][0].tolist():
            shared[k].add(i)
    pairs = {(i, j) for i in ids for k in bags[i][0].tolist() for j in shared[k] if i < j}
    for i, j in pairs:
        if near.overlap(bags[i], bags[j]) >= similarity:
            root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in bags}


def check_near(df):
    rows = [(r["doc_id"], r["text"]) for r in df.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()]
    want = brute_classes(rows)
    got = near.classes(df)
    assert got.columns == ["doc_id", "class_id", "class_size", "kept"]
    got = got.collect()
    assert len(got) == df.count()
    size = Counter(r["class_id"] for r in got if r["doc_id"] is not None)
    for r in got:
        if r["doc_id"] is None:
            assert r["class_id"] is None and r["class_size"] == 1 and r["kept"]
        else:
            assert r["class_id"] == want[r["doc_id"]] and r["class_size"] == size[r["class_id"]] and r["kept"] == (r["doc_id"] == r["class_id"])


def test_near_odd(odd):
    check_near(odd)


def test_near_empty(odd):
    assert near.classes(odd.limit(0)).count() == 0
    assert near.classes(odd.where("text IS NULL")).where("kept").count() == 2


def test_near_documents(documents):
    check_near(documents)


def test_family_of_near_copies(spark):
    """Many copies of one text, each with its own edits: classes are those of brute force, though no all-pairs comparison is made."""
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in rng.integers(0, 400, 110)]
    rows = []
    for i in range(220):
        w = list(base)
        for k in rng.integers(0, len(w), rng.integers(0, 7)):
            w[k] = f"n{rng.integers(0, 10**6)}" if rng.random() < 0.6 else w[(k + 1) % len(w)]
        if rng.random() < 0.3:
            del w[rng.integers(0, len(w))]
        rows.append((i, " ".join(w)))
    check_near(spark.createDataFrame(rows, "doc_id long, text string"))


def test_two_families_in_one_bucket(spark):
    rng = np.random.default_rng(2)
    first = [f"a{i}" for i in range(100)]
    second = first[:70] + [f"b{i}" for i in range(30)]
    rows = []
    for i in range(120):
        w = list(first if i % 2 else second)
        for k in rng.integers(0, 100, rng.integers(0, 4)):
            w[k] = f"x{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(w)))
    check_near(spark.createDataFrame(rows, "doc_id long, text string"))


def test_kept_rows(documents):
    marked = near.classes(documents)
    got = near.kept_rows(documents, marked, "doc_id")
    assert got.columns == documents.columns and got.count() == marked.select("class_id").distinct().count()


def test_ids_of_any_type(spark, documents):
    """Classes with text ids are those with numbers."""
    docs = documents.select(F.format_string("d%05d", "doc_id").alias("doc_id"), "text", F.lit(1).alias("id"), F.lit(2).alias("root"), F.lit(3).alias("class_id"))
    got = {int(r["doc_id"][1:]): int(r["class_id"][1:]) for r in near.classes(docs).collect()}
    assert got == {r["doc_id"]: r["class_id"] for r in near.classes(documents).collect()}


def test_rows_that_repeat_an_id(spark):
    """One row of a class stays, also where several rows have its least id; null ids all stay."""
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(5, text, 1), (5, text + " more", 2), (7, text + " and more", 3), (9, "something else entirely that is not alike", 4), (9, "something else entirely that is not alike", 4), (None, text, 5), (None, text, 6), (11, None, 7), (11, None, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, out int")
    kept = near.kept_rows(df, near.classes(df), "doc_id").collect()
    assert sorted(map(tuple, kept), key=str) == sorted([rows[0], rows[3], rows[5], rows[6], rows[7]], key=str)


def test_hot_centres_are_dealt_out(spark):
    """A centre's pairs are split, none lost, whatever the load."""
    texts = spark.range(60).select("id", F.concat(F.lit("t"), "id").alias("text"))
    pairs = spark.range(1, 60).select(F.col("id").alias("a"), F.when(F.col("id") < 50, 0).otherwise(1).cast("long").alias("b"))
    from axisframe.plans.lineage import materialise

    for load in (1, 7, 1000):
        got = near.with_texts(pairs, texts, materialise, 59, load)
        assert sorted((r["a"], r["b"], r["text_a"], r["text_b"]) for r in got.collect()) == [(a, int(a >= 50), f"t{a}", f"t{int(a >= 50)}") for a in range(1, 60)]


def test_family_that_lacks_what_the_centre_has(spark):
    """Texts that share what sets them apart from the centre: found, though those of one class never meet."""
    rng = np.random.default_rng(4)
    whole = [f"a{i}" for i in range(120)]
    rows = []
    for i in range(160):
        w = list(whole) if i % 2 else whole[:40] + whole[72:]  # half lack a passage and are not linked to the others
        for k in rng.integers(0, len(w), rng.integers(0, 3)):
            w[k] = f"x{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(w)))
    check_near(spark.createDataFrame(rows, "doc_id long, text string"))


def test_queries_equal_sql(spark, duck):
    from axisframe.llm.queries import oracle_sql, queries

    for name, sql in oracle_sql().items():
        df = queries()[name](spark, DATA)
        columns = sorted(df.columns)
        assert comparable(df.select(*columns).collect()) == comparable(duck.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()), name
