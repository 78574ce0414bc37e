"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is counted as terms of three families: runs of up to four character classes (how it is
written), how often words and pairs of words come again, and hashed words (what it says).
Each family is the square root of its shares, so that a family's inner product is the
overlap of two distributions; terms are weighted by their rarity, and a truncated singular
value decomposition of the labelled rows gives the space. All labelled vectors are broadcast,
their number being bounded; every document meets all of them in blocked products of unit
vectors, and the nearest vote by their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels

#: Labelled documents that the fit takes and the voters that are broadcast, at most (DIMENSIONS float32 each): the first by a hash of doc_id.
TRAIN_ROWS = 4_096
#: Dimensions of the space.
DIMENSIONS = 64
#: Voters of a document; those as near as the last of them vote too.
NEIGHBOURS = 16
#: A vote weighs its similarity to this power.
POWER = 8
#: Weight of the share of label 1 among all voters.
PRIOR = 1e-3
#: Buckets of the hashed families.
BUCKETS = 1 << 12
#: Families' weights: character classes, repetition, words.
WEIGHTS = (1.0, 1.0, 0.5)
#: Lengths of the runs of character classes.
RUNS = (1, 2, 3, 4)
#: Characters that are counted at once. A word of more counts as several.
BLOCK_CHARS = 1 << 19
#: Documents of one product.
BLOCK_ROWS = 256
_REPEATS = 7
TERMS = 2 * BUCKETS + _REPEATS
#: First term of each family.
_FIRST = (0, BUCKETS, BUCKETS + _REPEATS, TERMS)
_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """Classes of code points: capital, other letter, digit, blank, line break, other ASCII as it is, the rest."""
    if not _CLASSES:
        kinds = np.full(0x110000, 6, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                kinds[c] = 1 if x.isupper() else 2
            elif x.isdigit():
                kinds[c] = 3
            elif c < 128:
                kinds[c] = 4 if x in " \t" else 5 if x in "\n\v\f\r" else c
        _CLASSES.append(kinds)
    return _CLASSES[0]


def _run_counts(text: str) -> np.ndarray:
    """Buckets' counts of all runs of classes; blocks overlap, so none is lost at a cut."""
    counts, tail = np.zeros(BUCKETS), np.empty(0, np.uint32)
    for at in range(0, len(text), BLOCK_CHARS):
        own = _classes()[np.frombuffer(text[at : at + BLOCK_CHARS].encode("utf-32-le", "surrogatepass"), np.uint32)]
        kinds = np.concatenate([tail, own])
        hashed = np.zeros(len(kinds), np.uint32)
        for n in RUNS:
            if len(kinds) < n:
                break
            hashed = hashed[: len(kinds) - n + 1] * np.uint32(0x01000193) + (kinds[n - 1 :] + np.uint32(7)) * np.uint32(0x9E3779B1)
            x = hashed[max(0, len(tail) - n + 1) :]
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(n)
            counts += np.bincount((x ^ (x >> np.uint32(13))) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
        tail = kinds[max(0, len(kinds) - max(RUNS) + 1) :]
    return counts


def _word_hashes(text: str) -> np.ndarray:
    found, at = [], 0
    while at < len(text):
        to = at + BLOCK_CHARS
        if to < len(text):
            blank = max(text.rfind(x, at, to) for x in " \n\t\r\v\f")
            to = blank + 1 if blank >= at else to
        found.append(kernels.hash_words([text[at:to].encode("utf-8", "surrogatepass")])[0])
        at = to
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def term_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(terms, counts) of a text, ascending; a text without words has the term for that alone."""
    text = text or ""
    words = _word_hashes(text)
    counts = np.zeros(TERMS)
    repeats = counts[_FIRST[1] : _FIRST[2]]
    if len(words):
        counts[: BUCKETS] = _run_counts(text)
        counts[_FIRST[2] :] = np.bincount((words & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        pairs = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]
        twice, new, new_pairs = int((words[1:] == words[:-1]).sum()), len(np.unique(words)), len(np.unique(pairs))
        repeats[:6] = twice, len(pairs) - twice, len(pairs) - new_pairs, new_pairs, len(words) - new, new
    else:
        repeats[6] = 1
    terms = np.flatnonzero(counts)
    return terms, counts[terms]


def _shares(terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Weighted square roots of the terms' shares in their families."""
    out = np.empty(len(terms))
    edges = np.searchsorted(terms, _FIRST)
    for weight, a, b in zip(WEIGHTS, edges, edges[1:], strict=False):
        out[a:b] = weight * np.sqrt(counts[a:b] / max(counts[a:b].sum(), 1))
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=-1, keepdims=True)
    return np.where(length > 1e-9, rows / np.maximum(length, 1e-9), 0)


@dataclass(frozen=True)
class Voters:
    """axes: (TERMS, dimensions), rarity included; vectors: unit rows; labels: their shares of label 1; prior: the mean of those."""

    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> Voters:
    """The space and the voters of rows (terms, counts, label). Without rows all texts get 0.5."""
    dense = np.zeros((len(rows), TERMS), np.float32)
    for k, (terms, counts, _) in enumerate(rows):
        dense[k, terms] = _shares(terms, counts)
    labels = np.array([x[2] for x in rows], float)
    rarity = (np.log((1 + len(rows)) / (1 + (dense > 0).sum(0))) + 1).astype(np.float32)
    dense *= rarity
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9)
    size = min(DIMENSIONS, len(rows))
    # randomised range finder with power steps
    axes = np.random.default_rng(0).normal(size=(TERMS, min(size + 8, len(rows)))).astype(np.float32)
    for _ in range(4):
        axes = np.linalg.qr(dense.T @ (dense @ axes))[0] if size else axes
    axes = axes @ np.linalg.svd(dense @ axes, full_matrices=False)[2][:size].T if size else np.zeros((TERMS, 0), np.float32)
    return Voters((axes * rarity[:, None]).astype(np.float32), _unit(dense @ axes).astype(np.float32), labels, float(labels.mean()) if len(labels) else 0.5)


def vote(texts: list[str | None], voters: Voters) -> np.ndarray:
    """Scores of some texts: the weighted share of label 1 among their neighbours."""
    if not len(voters.labels):
        return np.full(len(texts), voters.prior)
    rows = np.zeros((len(texts), voters.axes.shape[1]), np.float32)
    for k, text in enumerate(texts):
        terms, counts = term_counts(text)
        rows[k] = _shares(terms, counts).astype(np.float32) @ voters.axes[terms]
    # rounded, so that voters that are equally near stay so whatever block they are in
    alike = np.round(_unit(rows) @ voters.vectors.T, 5)
    nearest = min(NEIGHBOURS, alike.shape[1])
    last = np.partition(alike, -nearest, axis=1)[:, -nearest, None]
    weight = np.where(alike >= last, np.maximum(alike, 0).astype(float) ** POWER, 0)
    score = (weight @ voters.labels + PRIOR * voters.prior) / (weight.sum(1) + PRIOR)
    return np.round(np.clip(score, 0, 1), 6)


def _term_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [term_counts(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x[0] for x in found], pa.list_(pa.int32())), pa.array([x[1] for x in found], pa.list_(pa.float64()))], names=["doc_id", "label", "terms", "counts"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Voters:
    """Voters from the documents of ``labels`` (doc_id and ``label``, 0 or 1), at most ``rows`` of them by a hash of doc_id.

    A label that is null doesn't count; several of one doc_id count by their mean, several
    documents of one doc_id as the one of least terms. Copies are one voter with the mean of
    their labels. What reaches the driver is bounded: ``rows`` times TERMS counts.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("double").alias("label")).where("_id is not null and label is not null")
    chosen = marked.groupBy("_id").agg(F.avg("label").alias("label")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = thin.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label")
    counted = joined.mapInArrow(_term_batches, "doc_id long, label double, terms array<int>, counts array<double>")
    found = counted.groupBy("doc_id").agg(F.min(F.struct("terms", "counts", "label")).alias("x")).select("x.*").toArrow()
    seen: dict[tuple[bytes, bytes], list[float]] = {}
    for terms, counts, own in zip(found["terms"], found["counts"], found["label"].to_pylist(), strict=True):
        seen.setdefault((terms.values.to_numpy().tobytes(), counts.values.to_numpy().tobytes()), []).append(own)
    return fit([(np.frombuffer(t, np.int32), np.frombuffer(c), float(np.mean(own))) for (t, c), own in sorted(seen.items())])


def scores(docs: DataFrame, voters: Voters) -> DataFrame:
    """(doc_id, score) of every row of ``docs``, each judged by its whole text.

    Null and empty texts, and those of blanks alone, are one kind: labelled ones vote on them,
    without such they get the mean of all labels. Repeated rows score alike, an empty table
    gives no rows, other columns aren't read; very long texts are counted block by block.
    """
    sent = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                some = batch.slice(at, BLOCK_ROWS)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(vote(some.column(1).to_pylist(), sent.value), pa.float64())], names=["doc_id", "score"])

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return thin.mapInArrow(run, "doc_id long, score double")


def op11_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from three quarters of the labelled ones.

    A null doc_id has no checksum: it isn't held out (false) and isn't learnt from either.
    """
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    told = scores(docs, train(docs, labels.where(~held)))
    return told.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
