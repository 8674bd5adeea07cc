"""The pipeline's stages, each on its own input, and the whole of it."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from axisframe.llm import decontaminate, queries

from ..conftest import DATA
from .test_dedup import brute_classes

pytest.importorskip("public_tokenizers")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [k for k, _ in pipeline.STAGES] == ["quality", "exact dedup", "near dedup", "decontamination", "byte bpe"]
    columns, seen = docs.columns, {}
    for name, stage in pipeline.STAGES:
        before = docs
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        if name != "byte bpe":
            assert docs.columns == columns and docs.exceptAll(before).isEmpty()
        seen[name] = (before, docs)

    before, after = seen["quality"]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    lost = before.join(after, "doc_id", "left_anti").join(labels, "doc_id")
    assert lost.where("quality = 0").count() >= 0.9 * before.join(labels, "doc_id").where("quality = 0").count()
    assert lost.where("quality = 1").count() <= 0.02 * before.count()

    before, after = seen["exact dedup"]
    want = before.groupBy(F.coalesce("text", F.lit(""))).agg(F.max("doc_id").alias("doc_id"))
    assert {r["doc_id"] for r in want.collect()} == {r["doc_id"] for r in after.collect()}

    before, after = seen["near dedup"]
    roots = brute_classes([(r["doc_id"], r["text"]) for r in before.collect()])
    assert {r["doc_id"] for r in after.collect()} == set(roots.values())

    before, after = seen["decontamination"]
    bench = [decontaminate.normalise(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    leaked = {r["doc_id"] for r in before.collect() if any(t in decontaminate.normalise(r["text"]) for t in bench)}
    assert leaked and leaked == {r["doc_id"] for r in before.join(after, "doc_id", "left_anti").collect()}

    before, after = seen["byte bpe"]
    assert before.count() == after.count()
    whole = {r["doc_id"]: r["ids_sha256"] for r in queries.queries()["op9_byte_bpe"](spark, DATA).collect()}
    assert all(whole[r["doc_id"]] == r["ids_sha256"] for r in after.collect())
    assert {tuple(r) for r in pipeline.run(spark, DATA).collect()} == {tuple(r) for r in after.collect()}


def test_odd_documents(spark, odd, tmp_path):
    """Nulls in every column, empty and very long texts, ties, repeated rows and clashing names: each stage's rows are those of brute force."""
    from collections import Counter

    from axisframe.llm import quality

    def rows(df):
        return Counter(tuple(r) for r in df.collect())

    stages, docs = dict(pipeline.STAGES), odd
    text, key = odd.columns.index("text"), odd.columns.index("doc_id")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")

    after = stages["quality"](spark, docs, DATA)
    verdict = {r["doc_id"]: r["predicted"] for r in quality.score_documents(docs, quality.fit(docs, labels)).collect()}
    before = rows(docs)
    assert after.columns == odd.columns and rows(after) == Counter({r: n for r, n in before.items() if verdict[r[key]]})

    docs, before = odd, rows(odd)  # the other stages get all odd rows
    after = rows(stages["exact dedup"](spark, docs, DATA))
    best = {}
    for r in before:
        best[r[text] or ""] = max(best.get(r[text] or "", -1), -1 if r[key] is None else r[key])
    assert after == Counter(r for r in before if (-1 if r[key] is None else r[key]) == best[r[text] or ""])

    after = rows(stages["near dedup"](spark, docs, DATA))
    roots = brute_classes(list({(r[key], r[text]) for r in before if r[key] is not None}))
    assert after == Counter(r for r in before if r[key] is None or r[key] == roots[r[key]])  # equal rows once

    after = rows(stages["decontamination"](spark, docs, DATA))
    assert after == before

    after = stages["byte bpe"](spark, docs, DATA)
    want = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.encode(odd).collect())
    assert after.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and rows(after) == want and sum(want.values()) == sum(before.values())

    for _, stage in pipeline.STAGES:
        empty = stage(spark, odd.limit(0), DATA)
        assert empty.count() == 0


def test_all_stages_over_odd_documents(spark, odd):
    docs = odd
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == docs.select("doc_id").distinct().count() > 0
