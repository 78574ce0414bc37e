"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting runs over all labelled rows: each task adds up n-gram counts by language in one
matrix and sends its non-zero cells. The log-probability matrix (languages x buckets) has a
fixed number of buckets and is broadcast; scoring is sparse: only the buckets that a text
touches are gathered and summed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of the n-gram hash; the matrix has languages x BUCKETS cells.
BUCKETS = 1 << 15
#: n-gram lengths in characters.
ORDERS = (1, 2, 3)
#: Added to every count.
ALPHA = 0.5
#: Languages that a matrix may hold (BUCKETS float32 each: 64 MB in all).
MOST_LANGUAGES = 500
UNKNOWN = "und"
#: Characters hashed at once.
BLOCK_CHARS = 1 << 19
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@dataclass(frozen=True)
class LanguageModel:
    """languages in order, log priors, and log probabilities as (BUCKETS, languages)."""

    languages: list[str]
    prior: np.ndarray
    log_prob: np.ndarray


def bucket_counts(text: str) -> np.ndarray:
    """Counts by bucket of all n-grams of the lower-cased text; anything but letters is one blank.

    Blocks of characters are hashed one after another; each takes the last characters before
    it along, so no n-gram is lost at a cut.
    """
    counts = np.zeros(BUCKETS, np.int64)
    lower = text.lower()
    tail, after_letter = np.empty(0, np.uint32), True
    for at in range(0, len(lower), BLOCK_CHARS):
        codes = np.frombuffer(lower[at : at + BLOCK_CHARS].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _is_letter(codes)
        codes = np.where(letter, codes, np.uint32(32))
        codes = codes[letter | np.concatenate([[after_letter], letter[:-1]])]  # one blank for a run of them
        after_letter = bool(letter[-1])
        codes = np.concatenate([tail, codes])
        hashed = np.zeros(len(codes), np.uint32)
        for n in ORDERS:
            if len(codes) < n:
                break
            hashed = hashed[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :] * _ODD[n - 1]
            x = hashed[max(0, len(tail) - n + 1) :]
            x = x ^ (x >> np.uint32(15))
            x = x * np.uint32(0x2C1B3C6D) + np.uint32(n)
            counts += np.bincount((x ^ (x >> np.uint32(13))) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
        tail = codes[max(0, len(codes) - max(ORDERS) + 1) :]
    return counts


_LETTERS: list[np.ndarray] = []


def _is_letter(codes: np.ndarray) -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTERS[0][codes]


def has_letter(text: str | None) -> bool:
    """Whether a text has any Unicode letter; null has none."""
    return text is not None and any(map(str.isalpha, text))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            rows[lang] = rows.get(lang, 0) + 1
            if lang not in sums:
                sums[lang] = np.zeros(BUCKETS, np.int64)
            sums[lang] += bucket_counts(text.as_py() or "")
    for lang, n in rows.items():
        own = sums.get(lang, np.zeros(BUCKETS, np.int64))
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1), pa.string()), pa.array(np.concatenate([[-1], at]), pa.int32()), pa.array(np.concatenate([[n], own[at]]), pa.int64())], names=["lang", "bucket", "count"])


def train(labelled: DataFrame) -> LanguageModel:
    """Naive Bayes from all rows of ``labelled`` (text, lang) with a lang; null texts count as empty.

    The counts that reach the driver are languages x BUCKETS at most; more than
    MOST_LANGUAGES different lang values are an error.
    """
    thin = labelled.where(F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = thin.mapInArrow(_count_batches, "lang string, bucket int, count long").groupBy("lang", "bucket").agg(F.sum("count").alias("count"))
    languages = sorted(r["lang"] for r in counts.where("bucket = -1").select("lang").limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    found = counts.toArrow()
    place = {lang: k for k, lang in enumerate(languages)}
    matrix, rows = np.full((len(languages), BUCKETS), ALPHA), np.zeros(len(languages))
    if len(languages):
        lang = np.array([place[x] for x in found["lang"].to_pylist()])
        bucket, count = found["bucket"].to_numpy(), found["count"].to_numpy()
        np.add.at(matrix, (lang[bucket >= 0], bucket[bucket >= 0]), count[bucket >= 0])
        np.add.at(rows, lang[bucket < 0], count[bucket < 0])
    log_prob = np.log(matrix / matrix.sum(1, keepdims=True)).T.astype(np.float32) if len(languages) else np.zeros((BUCKETS, 0), np.float32)
    return LanguageModel(languages, np.log(rows / rows.sum()) if len(languages) else rows, np.ascontiguousarray(log_prob))


def score(text: str | None, model: LanguageModel) -> tuple[str, float]:
    """(most probable language, its posterior); ties go to the first in order. ``und`` and 0 without letters."""
    if not model.languages or not has_letter(text):
        return UNKNOWN, 0.0
    counts = bucket_counts(text)
    bucket = np.flatnonzero(counts)
    logs = model.prior + counts[bucket] @ model.log_prob[bucket].astype(np.float64)
    best = int(np.argmax(logs))
    return model.languages[best], float(1 / np.exp(logs - logs[best]).sum())


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, each judged by its whole text.

    Null and empty texts and those without a letter are ``und`` with score 0; ties go to the
    first language in order. Repeated rows are judged alike, a null doc_id stays null, very
    long texts are hashed block by block, an empty table gives no rows, and other columns,
    whatever their names, aren't read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [score(t.as_py(), sent.value) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in told], pa.string()), pa.array([x[1] for x in told], pa.float64())], names=["doc_id", "lang_pred", "score"])

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return thin.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for all documents, learnt from three quarters of them.

    A null doc_id has no checksum: it isn't held out (false) and isn't learnt from either.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = train(docs.where(fold != 2))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
