"""The pipeline against a plain version of its stages, and its place among the queries."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from occspark.llm import decontaminate, pii, quality

from .test_corpus import brute_components, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    dice = random.Random(20)
    item = prose(dice, 30)
    texts = {k: prose(dice, dice.randrange(60, 160)) for k in range(60)}
    texts[60] = texts[3]
    near = texts[4].split()
    near[20] = "other"
    texts[61] = " ".join(near)
    texts[62] = prose(dice, 40) + " " + item + " " + prose(dice, 40)
    texts[63] = prose(dice, 60) + " write to ann.lee@mail.example.com or +1 (415) 555-7788 " + prose(dice, 30)
    texts[64], texts[65] = None, "too short"
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), texts


def test_stages_equal_plain_versions(spark, folder):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    verdict = {r["doc_id"]: r["kept"] for r in quality.judged(docs).collect()}
    left = {k: t for k, t in texts.items() if verdict[k]}
    assert not {64, 65} & set(left) and {3, 4, 60, 61, 62, 63} <= set(left)
    root = brute_components(left, 5, 4, 5)
    left = {k: t for k, t in left.items() if root[k][1] == k}
    assert not {60, 61} & set(left)
    items = next(decontaminate.item_blocks(spark.read.parquet(f"{path}/benchmark.parquet")))
    left = {k: t for k, t in left.items() if not decontaminate.scan([t], items)[0]}
    assert 62 not in left
    field = pii.train(docs.where(F.col("doc_id").isin(list(left))))
    clean = {k: pii.redact(t, field) for k, t in left.items()}
    assert "[EMAIL]" in clean[63] and "[PHONE]" in clean[63]
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, path)
        assert frame.columns == docs.columns, name
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in frame.collect()} == {k: (t, len(t)) for k, t in clean.items()}
    packed = corpus_pipeline.run(spark, path)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(clean)


def test_rows_with_null_and_repeated_ids_are_judged_each(spark, tmp_path):
    dice = random.Random(21)
    clean = [prose(dice, 100) for _ in range(8)]
    near = lambda t, w: " ".join([*t.split()[:50], w, *t.split()[51:]])
    rows = [(None, "too short"), (5, "too short"), (None, clean[0]), (None, clean[1]), (5, clean[2]), (5, clean[3])]
    rows += [(None, clean[4]), (None, near(clean[4], "x")), (6, clean[5]), (6, near(clean[5], "x"))]  # groups without an id, and of one id
    rows += [(None, near(clean[6], "x")), (9, clean[6]), (8, near(clean[6], "y")), (7, clean[7])]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(f"{tmp_path}/d")
    for docs in (frame, spark.read.parquet(f"{tmp_path}/d")):
        left = corpus_pipeline.quality_rules(spark, docs, "")
        assert sorted((r["doc_id"] or 0, r["text"]) for r in left.collect()) == sorted((i or 0, t) for i, t in rows if t != "too short")
        kept = corpus_pipeline.near_duplicates(spark, left, "")
        got = [(r["doc_id"], r["text"]) for r in kept.collect()]
        assert kept.columns == docs.columns and len(got) == 8 and set(got) <= set(rows)
        assert {(None, clean[0]), (None, clean[1]), (5, clean[2]), (5, clean[3]), (8, near(clean[6], "y")), (7, clean[7])} <= set(got)
        assert sum(t in (clean[4], near(clean[4], "x")) for _, t in got) == sum(t in (clean[5], near(clean[5], "x")) for _, t in got) == 1


def test_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]
