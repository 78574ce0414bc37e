"""Cuts, clashing names and short items: where whole texts, whole values and all lengths count alike."""

from __future__ import annotations

import dataclasses
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from occspark.llm import decontaminate, langid, sharding

from .test_corpus import changed, prose


def test_ngrams_of_a_long_text_do_not_depend_on_cuts(monkeypatch):
    text = prose(random.Random(30), 300) + "  --  Straße 12 \U00030000\U00030001 " + "é" * 40 + "!"
    whole = langid.bucket_counts(text)
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(langid, "BLOCK_CHARS", size)
        assert (langid.bucket_counts(text) == whole).all()


def test_predictions_equal_a_plain_naive_bayes(spark):
    dice = random.Random(31)
    words = {"a": ["alba", "mano", "terra"], "b": ["baum", "haus", "über"], "c": ["χώρα", "νερό", "γη"]}
    rows = [(k, " ".join(dice.choice(words[x]) for _ in range(dice.randrange(1, 9))), x) for k, x in enumerate(dice.choices("aabc", k=80))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    counts = {x: sum((langid.bucket_counts(t) for _, t, y in rows if y == x), start=0) + langid.ALPHA for x in "abc"}
    priors = Counter(x for _, _, x in rows)
    asked = [(100, "terra über haus"), (101, "νερό mano"), (102, "\U00030000"), (103, "12 !"), (104, None)]
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    for i, text in asked[:3]:
        logs = {x: math.log(priors[x] / len(rows)) + sum(n * math.log(c / counts[x].sum()) for n, c in zip(langid.bucket_counts(text), counts[x]) if n) for x in "abc"}
        best = max(sorted(logs), key=logs.__getitem__)
        assert got[i]["lang_pred"] == best and got[i]["score"] == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()), rel=1e-3)
    assert got[102]["lang_pred"] != "und" and got[103]["lang_pred"] == got[104]["lang_pred"] == "und"


def test_sources_with_a_common_start_are_told_apart(spark):
    rows = [(k, "t", "en", f"https://example.org/{k % 8}") for k in range(800)] + [(k, "t", None, None) for k in range(800, 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    cells = {r["value"]: r["cell"] for r in sharding.value_cells(docs, "source", 8).collect()}
    assert cells[None] == 0 and len(cells) == 9 and len(set(cells.values())) == 8
    assert [cells[f"https://example.org/{k}"] for k in range(8)] == sorted(cells[f"https://example.org/{k}"] for k in range(8))
    shards = sharding.hilbert_shards(docs, 10)
    ranges = sharding.shard_ranges(shards, docs).collect()
    assert sum(r["rows"] for r in ranges) == 900 and all(r["rows"] == 90 for r in ranges)
    of = shards.select("doc_id", "shard").join(docs, "doc_id").groupBy("shard").agg(F.count_distinct(F.coalesce("source", F.lit(""))).alias("n"))
    assert sum(r["n"] for r in of.collect()) <= 45  # of 90, if sources were no dimension
    # a hot value takes its own share of the cells
    hot = spark.createDataFrame([("b",)] * 600 + [("a",)] * 100 + [("c",)] * 100, "source string")
    assert {r["value"]: r["cell"] for r in sharding.value_cells(hot, "source", 8).collect()} == {"a": 0, "b": 4, "c": 7}


@pytest.mark.parametrize("length", [5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 17, 20, 26, 40, 63, 80])
def test_hits_reach_all_lengths(length):
    dice = random.Random(32 + length)
    vocabulary = [f"w{k}" for k in range(3_000)]
    items = [" ".join(dice.choices(vocabulary, k=length)) for _ in range(100)]
    known = decontaminate.prepare(list(enumerate(items)))
    found = 0
    for i, item in enumerate(items):
        own = item.split()
        for at in dice.sample(range(length), int(known.edits[i])):
            own[at] = "zz" + own[at]
        hashed, _ = decontaminate.kernels.hash_words([" ".join([*dice.choices(vocabulary, k=30), *own, *dice.choices(vocabulary, k=30)]).encode()], strip_punctuation=True)
        found += i in decontaminate.hits(hashed, known)[0]
    assert found >= 97


def test_short_items_with_inserted_and_lost_words_are_found():
    dice = random.Random(33)
    vocabulary = [f"w{k}" for k in range(500)]
    items = [" ".join(dice.choices(vocabulary, k=dice.randrange(5, 15))) for _ in range(200)]
    known = decontaminate.prepare(list(enumerate(items)))
    texts = [" ".join([*dice.choices(vocabulary, k=20), *changed(dice, x.split(), int(known.edits[i])), *dice.choices(vocabulary, k=20)]) for i, x in enumerate(items)]
    got = decontaminate.scan(texts, known)
    assert sum(i in [m[0] for m in own] for i, own in enumerate(got)) >= 194


def test_pairs_of_words_keep_the_hits_of_short_items_few():
    dice = random.Random(34)
    vocabulary = [f"w{k}" for k in range(2_000)]
    weights = [1 / (k + 1) for k in range(2_000)]
    items = [" ".join(dice.choices(vocabulary, weights, k=6)) for _ in range(500)]
    hashed, _ = decontaminate.kernels.hash_words([" ".join(dice.choices(vocabulary, weights, k=4_000)).encode()], strip_punctuation=True)
    item, _ = decontaminate.hits(hashed, decontaminate.prepare(list(enumerate(items))))
    assert len(item) <= 0.1 * 500 * 4_000


class Counted:
    """The taken slots of a table, and how many windows were looked up in them."""

    def __init__(self, taken):
        self.taken, self.asked = taken, 0

    def take(self, slots):
        self.asked += len(slots)
        return self.taken.take(slots)


def test_windows_whose_walks_have_met_are_looked_up_once():
    dice = random.Random(36)
    vocabulary = [f"w{k}" for k in range(3_000)]
    items = [" ".join(dice.choices(vocabulary, k=dice.randrange(15, 60))) for _ in range(100)]
    known = decontaminate.prepare(list(enumerate(items)))
    hashed, _ = decontaminate.kernels.hash_words([" ".join([*dice.choices(vocabulary, k=4_000), *items]).encode()], strip_punctuation=True)
    counted = dataclasses.replace(known, tables={key: (Counted(table[0]), *table[1:]) for key, table in known.tables.items()})
    item, start = decontaminate.hits(hashed, counted)
    assert set(item) == set(range(100)) and set(zip(*map(np.ndarray.tolist, decontaminate.hits(hashed, known)), strict=True)) == set(zip(item.tolist(), start.tolist(), strict=True))
    assert sum(table[0].asked for table in counted.tables.values()) <= 0.4 * len(hashed) * len(known.tables)


@pytest.mark.parametrize("words", [1, 2, 20, 500])
def test_hits_are_those_of_each_window_walked_alone(words):
    dice = random.Random(37 + words)
    vocabulary = [f"w{k}" for k in range(words)]
    items = [" ".join(dice.choices(vocabulary, k=k)) for k in (1, 4, 6, 7, 8, 11, 12, 17, 18, 30, 64, 150)]
    known = decontaminate.prepare(list(enumerate(items)))
    hashed, _ = decontaminate.kernels.hash_words([" ".join([*dice.choices(vocabulary, k=100), *items, *dice.choices(vocabulary, k=100)]).encode()], strip_punctuation=True)
    want = set()
    for key, signature, _ in decontaminate.signatures(hashed, known.lengths, np.arange(len(hashed))):
        _, sorted_signatures, piece = known.tables[key]
        pieces: dict[int, list[int]] = {}
        for s, p in zip(sorted_signatures.tolist(), piece.tolist(), strict=True):
            pieces.setdefault(s, []).append(p)
        want |= {(int(known.item[p]), k - int(known.offset[p])) for k, s in enumerate(signature.tolist()) for p in pieces.get(s, [])}
    item, start = decontaminate.hits(hashed, known)
    assert len(item) == len(want) and set(zip(item.tolist(), start.tolist(), strict=True)) == want


def test_columns_of_any_name_pass_the_pipeline_filters(spark, tmp_path):
    dice = random.Random(35)
    odd = ["row_key", "_row_key", "rejected_row", "row_path", "row_place", "Row_File", "row_known", "_row", "_of", "_at", "_path", "_file", "_metadata", "member", "component", "fp", "moved_fp"]
    rows = [(k, prose(dice, 90), "en", "s", 1, *[f"{c}{k}" for c in odd]) for k in range(6)] + [(6, "short", "en", "s", 1, *["x"] * len(odd))]
    rows.append((7, rows[2][1], "en", "s", 1, *["y"] * len(odd)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in odd))
    docs.write.parquet(f"{tmp_path}/d")
    for frame in (docs, spark.read.parquet(f"{tmp_path}/d")):
        kept = corpus_pipeline.quality_rules(spark, frame, "")
        assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == sorted(r for r in rows if r[0] != 6)
        kept = corpus_pipeline.near_duplicates(spark, kept, "")
        assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == rows[:6]


def test_empty_tables_pass_the_pipeline(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
