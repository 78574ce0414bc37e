"""Nearest-neighbour voting against a plain version, held-out labels and odd rows."""

from __future__ import annotations

import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from occspark.llm import neighbours

from .test_corpus import prose

SAMPLE = Path("/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def labelled():
    dice = random.Random(8)
    rows = []
    for k in range(200):
        text = prose(dice, dice.randrange(20, 120))
        bad = k % 4 == 0
        rows.append((k, "!! ".join(text.upper().split()) if bad and k % 8 else " ".join([text.split()[0] + chr(97 + k % 26) + str(k)] * 60) if bad else text, 0 if bad else 1))
    return rows


def test_votes_equal_a_plain_version(labelled):
    counted = [neighbours.term_counts(t) for _, t, _ in labelled]
    voters = neighbours.fit([(a, b, float(y)) for (a, b), (_, _, y) in zip(counted, labelled, strict=True)])
    dice = random.Random(9)
    asked = [prose(dice, 50), prose(dice, 50).upper(), labelled[0][1], labelled[5][1], "", None]
    got = neighbours.vote(asked, voters)
    for text, score in zip(asked, got, strict=True):
        terms, counts = neighbours.term_counts(text)
        own = sum(w * voters.axes[t].astype(float) for t, w in zip(terms, neighbours._shares(terms, counts), strict=True))
        own = own / np.linalg.norm(own) if np.linalg.norm(own) > 1e-9 else own
        alike = sorted(((round(float(own @ v), 5), y) for v, y in zip(voters.vectors.astype(float), voters.labels, strict=True)), reverse=True)
        votes = [(max(s, 0) ** 8, y) for s, y in alike if s >= alike[neighbours.NEIGHBOURS - 1][0]]
        want = (sum(w * y for w, y in votes) + neighbours.PRIOR * voters.prior) / (sum(w for w, _ in votes) + neighbours.PRIOR)
        assert score == pytest.approx(want, abs=0.01)
    assert got[0] > 0.9 and got[1] < 0.3 and got[2] < 0.3 and got[3] > 0.9 and got[4] == got[5]
    assert np.allclose(neighbours.vote(asked[::-1], voters)[::-1], got)


def test_terms_do_not_depend_on_where_a_text_is_cut(monkeypatch):
    text = prose(random.Random(10), 400) + "\n\n" + "x" * 90 + " AB 12 éÉ \U00020000\ud800"
    whole = neighbours.term_counts(text)
    monkeypatch.setattr(neighbours, "BLOCK_CHARS", 101)
    cut = neighbours.term_counts(text)
    assert whole[0].tolist() == cut[0].tolist() and whole[1].tolist() == cut[1].tolist()


def test_train_takes_labels_of_the_documents_chosen(spark, labelled):
    docs = spark.createDataFrame([(k, t, 9) for k, t, _ in labelled] + [(3, "short", 9), (None, "no id", 9)], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(k, y, "x") for k, _, y in labelled] + [(1, 0, "x"), (2, None, "x"), (None, 1, "x"), (9999, 1, "x")], "doc_id long, quality int, text string")
    voters = neighbours.train(docs, labels)
    assert len(voters.labels) == 200 and sorted(set(voters.labels)) == [0, 0.5, 1]  # document 1 has two labels
    assert len(neighbours.train(docs, labels, rows=50).labels) <= 50
    copies = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000))
    more = labels.unionByName(labels.withColumn("doc_id", F.col("doc_id") + 1000))
    assert len(neighbours.train(copies, more).labels) == 200


def test_odd_rows_have_scores(spark, labelled):
    voters = neighbours.fit([(*neighbours.term_counts(t), float(y)) for _, t, y in labelled])
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "Good words here, and more."), (4, "word " * 200_000), (5, "x" * 1_000_000), (6, labelled[5][1]), (6, labelled[5][1])]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    got = [(r["doc_id"], r["score"]) for r in neighbours.scores(docs, voters).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got)
    by = dict(got)
    assert by[1] == by[2] == by[3] == pytest.approx(voters.prior, abs=1e-5) and [s for i, s in got if i == 6] == [by[6]] * 2
    none = neighbours.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in neighbours.scores(docs, none).collect()} == {0.5}
    assert neighbours.scores(docs.limit(0), voters).collect() == []


@pytest.mark.skipif(not SAMPLE.exists(), reason="no test tables here")
def test_query_tells_held_out_labels(spark):
    got = neighbours.op11_quality_votes(spark, str(SAMPLE))
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    told = {r["doc_id"]: r for r in got.collect()}
    assert len(told) == spark.read.parquet(f"{SAMPLE}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7) for i, r in told.items())
    held = [(told[r["doc_id"]]["predicted"], r["quality"]) for r in spark.read.parquet(f"{SAMPLE}/labels.parquet").collect() if told[r["doc_id"]]["held_out"]]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
