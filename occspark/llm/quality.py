"""Quality rules from tokenizer fertility.

A public vocabulary with byte fallback is run over every word. Text that the vocabulary
knows takes few tokens a character, hardly any raw bytes, and spreads over many tokens; junk
leaves the band of its language in one of the three. Bands come from the corpus itself:
median and spread of each measure over all documents of a language (or of a script, where
the language is unknown) and of about the same length, as all three drift with length. Small
groups lean on their language, then on their script, never on other scripts.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import stored
from .tokens import vocabulary_path

_WORD = re.compile("[^\x20\x09-\x0d]+")
_SYMBOLS = "#*$%&|<>"
#: Words whose tokens a Python worker remembers; then it starts anew.
CACHE_WORDS = 100_000
#: A measure is out of its band this many spreads below or above the median. Spread: the
#: distance between the quartiles, which a tenth of junk hardly moves, with a floor for each.
REACH = {"chars_per_token": (5.0, 5.0), "byte_share": (8.0, 8.0), "token_entropy": (4.0, 7.0)}
FLOOR = {"chars_per_token": 0.05, "byte_share": 0.01, "token_entropy": 0.05}
#: Groups with fewer measured documents are shrunk, by their count, towards the wider group around them.
LEAST_GROUP = 30
#: Rows of the band table that may be broadcast.
BROADCAST_GROUPS = 10_000

#: First and last code points of scripts, most common first.
_SCRIPTS = (("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF),
            ("devanagari", 0x900, 0x97F), ("thai", 0xE00, 0xE7F), ("kana", 0x3040, 0x30FF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF))


@lru_cache(maxsize=2)
def _pieces(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, np.array([model.is_byte(i) for i in range(model.get_piece_size())])


def _room(array: np.ndarray, size: int) -> np.ndarray:
    """The array, or one of twice the size that starts like it."""
    if size <= len(array):
        return array
    larger = np.zeros(max(size, 2 * len(array)), array.dtype)
    larger[: len(array)] = array
    return larger


class WordTokens:
    """Token ids of words, remembered while a worker lives."""

    def __init__(self, path: str) -> None:
        self.model, self.is_byte = _pieces(path)
        self.clear()

    def clear(self) -> None:
        """Forgets all words."""
        self.place: dict[str, int] = {}
        self.at, self.ids = np.zeros(1 << 16, np.int64), np.empty(1 << 18, np.int32)

    def of(self, words: list[str]) -> np.ndarray:
        """The ids of all tokens of ``words``, in no certain order."""
        if len(self.place) > CACHE_WORDS:
            self.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.place]
        if new:
            coded = self.model.encode(new, num_threads=1)
            start, filled = len(self.place), int(self.at[len(self.place)])
            self.place.update(zip(new, range(start, start + len(new)), strict=True))
            ends = filled + np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)))
            self.at = _room(self.at, start + len(new) + 1)
            self.ids = _room(self.ids, int(ends[-1]))
            self.at[start + 1 : start + len(new) + 1] = ends
            self.ids[filled : ends[-1]] = list(chain.from_iterable(coded))
        where = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        first, size = self.at[where], self.at[where + 1] - self.at[where]
        ends = np.cumsum(size)
        return self.ids[np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    """The words that this worker has seen, over all its tasks."""
    return WordTokens(path)


def base_counts(text: str) -> tuple[list[str], int, int, int, int]:
    """(words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text."""
    words = _WORD.findall(text)
    lines = [x for x in text.split("\n") if x and _WORD.search(x)]
    repeated = 0
    if len(set(zip(words, words[1:], words[2:]))) < len(words) - 2:  # most texts repeat no window
        windows = list(zip(words, words[1:], words[2:]))
        seen = Counter(windows)
        covered = np.zeros(len(words) + 2, bool)
        at = np.flatnonzero(np.fromiter(map(seen.__getitem__, windows), np.int64, len(windows)) > 1)
        covered[at] = covered[at + 1] = covered[at + 2] = True
        repeated = int(covered.sum())
    symbols = sum(map(text.count, _SYMBOLS))
    return words, sum(map(len, words)), symbols, len(lines) - len(set(lines)), repeated


def fertility(words: list[str], chars: int, tokens: WordTokens) -> tuple[float, float, float] | None:
    """(characters per token, share of byte tokens, token entropy).

    The entropy is the collision entropy -log P[two tokens are equal], whose estimate from
    pairs of a text's tokens has no bias in short texts.
    """
    ids = tokens.of(words)
    if not len(ids):
        return None
    count = np.unique(ids, return_counts=True)[1]
    pairs = len(ids) * (len(ids) - 1)
    equal = max(int((count * (count - 1)).sum()), 1) / max(pairs, 1)
    return chars / len(ids), float(tokens.is_byte[ids].mean()), float(-np.log(equal))


@lru_cache(maxsize=1 << 16)
def _script(letter: str) -> str:
    """The script of a letter; one that isn't listed goes by the first word of its Unicode name."""
    return next((name for name, low, high in _SCRIPTS if low <= ord(letter) <= high), None) or unicodedata.name(letter, "other").split()[0].lower()


def script_of(text: str) -> str:
    """The script of most letters of a text."""
    if text.isascii():
        return "latin" if text.lower() != text.upper() else "none"
    votes = Counter()
    for c, n in Counter(text).items():
        if c.isalpha():
            votes[_script(c)] += n
    return max(sorted(votes), key=votes.__getitem__) if votes else "none"


_MEASURED = "doc_id long, lang string, script string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars_per_token double, byte_share double, token_entropy double"


def _measure_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    tokens = word_tokens(path)
    for batch in batches:
        rows = []
        for text in batch.column(1):
            text = text.as_py() or ""
            words, chars, symbols, lines, repeated = base_counts(text)
            measures = fertility(words, chars, tokens) or (None, None, None)
            rows.append((script_of(text), len(words), chars, symbols, lines, repeated, *measures))
        kinds = [pa.string()] + [pa.int64()] * 5 + [pa.float64()] * 3
        columns = list(zip(*rows, strict=True)) or [[]] * 9
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=[x.split()[0] for x in _MEASURED.split(", ")])


def measured(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The base counts and the three fertility measures of every row; null texts are empty, without measures."""
    path = path or vocabulary_path("piece_bpe_32k.model")
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return thin.mapInArrow(lambda it: _measure_batches(it, path), _MEASURED)


def bands(rows: DataFrame) -> DataFrame:
    """(group, weight, median and spread of each measure) from all documents that pass the base rules, for each of _LEVELS.

    weight: 1 from LEAST_GROUP documents on, less in proportion below.
    """
    judged = rows.where(~_base_failed() & F.col("chars_per_token").isNotNull())
    grouped = judged.select(F.explode(F.array_compact(F.array(*[_group(x) for x in _LEVELS]))).alias("group"), *REACH)
    out = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(m, [0.25, 0.5, 0.75], 1000).alias(m) for m in REACH])
    for m in REACH:
        out = out.withColumn(f"{m}_median", F.col(m)[1]).withColumn(f"{m}_spread", F.greatest(F.col(m)[2] - F.col(m)[0], F.lit(FLOOR[m])))
    return out.select("group", F.least(F.lit(1.0), F.col("n") / LEAST_GROUP).alias("weight"), *[f"{m}_{x}" for m in REACH for x in ("median", "spread")])


def _base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: Groups of a document, each shrunk towards the one before where it is small.
_LEVELS = ("script", "script_sized", "lang", "lang_sized")


def _group(level: str) -> Column:
    """Script or language (null without one), and if sized the power of two of the number of words."""
    kind, _, sized = level.partition("_")
    name = F.concat(F.lit(f"{kind}:"), F.col(kind))
    return F.concat(name, F.lit(":"), F.floor(F.log2(F.col("n_words"))).cast("string")) if sized else name


def _band(m: str) -> tuple[Column, Column]:
    """(low, high) of a measure from the joined groups, null where no document of the script was measured.

    A script has nothing to lean on, so its band widens as documents get few. Any other group
    counts by its weight, and the group before it by the rest; how far the two are apart goes
    into the band while the weight is between, as the truth may be at either.
    """
    middle, spread, between = F.col(f"script_{m}_median"), F.col(f"script_{m}_spread") / F.col("script_weight"), F.lit(0.0)
    for level in _LEVELS[1:]:
        w = F.coalesce(F.col(f"{level}_weight"), F.lit(0.0))
        own, width = F.coalesce(f"{level}_{m}_median", F.lit(0.0)), F.coalesce(f"{level}_{m}_spread", F.lit(0.0))
        between = (1 - w) * between + F.sqrt(w * (1 - w)) * F.abs(own - middle)
        middle, spread = w * own + (1 - w) * middle, w * width + (1 - w) * spread
    below, above = REACH[m]
    return middle - below * spread - between, middle + above * spread + between


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, measures).

    base_failed: fewer than 50 words, or more than half of them in repeated three-word
    windows. kept: not base_failed and every measure inside the band of its group. Null and
    blank texts fail; repeated rows are judged alike; an empty table gives no rows.
    """
    rows = stored(measured(docs), "measured")
    found = stored(bands(rows), "bands")
    few = found.count() <= BROADCAST_GROUPS
    told = rows
    for level in _LEVELS:
        side = found.select(*[F.col(c).alias(f"{level}_{c}") for c in found.columns])
        told = told.join(F.broadcast(side) if few else side, _group(level) == F.col(f"{level}_group"), "left")
    failed = _base_failed()
    inside = F.lit(True)
    for m in REACH:
        inside = inside & F.coalesce(F.col(m).between(*_band(m)), F.lit(True))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return told.select("doc_id", *counts, failed.alias("base_failed"), (~failed & inside).alias("kept"), *REACH)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on all documents."""
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
