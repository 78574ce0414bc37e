"""Spelling variants: words one edit apart, found by dense tiles of common prefixes and suffixes.

Two words are one edit apart if their common prefix and suffix together reach the longer
length L less one. Where the edit lies, the length p of the common prefix, is one of 0 to
L - 1. A tile holds all words that may be the longer or the shorter of a pair with p in
[lo, hi): they share the first lo and the last L - hi code points. Tiles with too many words
are cut in two at the middle of their range, as often as needed; a range of one place leaves
at most one word for each letter. Every pair thus has one tile, and within it padded
code-point matrices of the part between prefix and suffix are compared block by block. A
tile sends one row for each word, not its pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import remove, stored

#: Words of a tile, and words times the width of its range; larger tiles are cut.
TILE_WORDS = 1_024
TILE_CELLS = 1 << 20
#: Rows of a matrix block, whose pairs are compared at once.
BLOCK = 512
#: Distinct words that a task counts before it sends what it has.
WORDS_PER_FLUSH = 200_000
#: Rows and code points of the table of large tiles that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 50_000
BROADCAST_CHARS = 4_000_000
#: A form occurs at least so many times as often as the word.
FORM_RATIO = 10
_TILE = ("long", "lo", "hi", "prefix", "suffix")


def _mutated(run: str, head: bytes, every: int) -> str:
    """The run, or what is left of it where the checksum asks for a code point to go."""
    h = zlib.crc32(head + run.encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count_batches(batches: Iterator[pa.RecordBatch], least: int, every: int) -> Iterator[pa.RecordBatch]:
    runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}")
    seen: Counter[str] = Counter()

    def sent() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
        seen.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            head = b"%d:" % doc_id if doc_id is not None else b":"
            # bytes.lower changes A-Z alone
            for run in runs.finditer((text.as_py() or "").encode().lower().decode()):
                word = _mutated(run[0], head, every) if every else run[0]
                if len(word) >= least:
                    seen[word] += 1
                    if len(seen) >= WORDS_PER_FLUSH:
                        yield sent()
    yield sent()


def word_counts(docs: DataFrame, least: int = 7, often: int = 2, every: int = 0) -> DataFrame:
    """(word, n): letter runs of at least ``least`` code points that occur ``often`` times or more.

    Runs are maximal in A-Z, a-z and U+00C0 to U+00FF; only A-Z is lower-cased. With
    ``every``, a run loses a code point in documents where its checksum is a multiple.
    """
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = thin.mapInArrow(lambda it: _count_batches(it, least, every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def _tiled(rows: DataFrame) -> DataFrame:
    """(word, n, long, lo, hi) with the prefix and suffix that the range leaves."""
    return rows.select("word", "n", "long", "lo", "hi", F.expr("substring(word, 1, lo)").alias("prefix"), F.expr("right(word, long - hi)").alias("suffix"))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row once for either half of its range."""
    middle = ((F.col("lo") + F.col("hi")) / 2).cast("int")
    both = F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi").alias("hi")))
    return _tiled(rows.select("word", "n", "long", F.explode(both).alias("part")).select("word", "n", "long", "part.lo", "part.hi"))


def tiles(words: DataFrame, most: int = TILE_WORDS) -> DataFrame:
    """(word, n) of ``words`` with each of its tiles (long, lo, hi, prefix, suffix), at most ``most`` words to a tile of a range over one.

    A word of length l is in tiles of longer length l and l + 1.
    """
    size = F.length("word")
    start = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("long")).select("word", "n", "long", F.lit(0).alias("lo"), F.col("long").alias("hi"))
    rows, settled = stored(_halves(start), "tiles"), None
    while True:
        width = F.col("hi") - F.col("lo")
        too_large = (F.col("c") > most) | (F.col("c") * width > TILE_CELLS)
        large = stored(rows.groupBy(*_TILE).agg(F.count(F.lit(1)).alias("c")).where(too_large & (F.col("c") > 1) & (width > 1)).select(*_TILE), "large")
        n, chars = large.agg(F.count(F.lit(1)), F.sum(F.length("prefix").cast("long") + F.length("suffix"))).first()
        if not n:
            return rows if settled is None else settled.unionByName(rows)
        key = F.broadcast(large) if n <= BROADCAST_ROWS and chars <= BROADCAST_CHARS else large
        done = stored(rows.join(key, list(_TILE), "left_anti").select(*rows.columns), "settled")
        spent, rows = rows, stored(_halves(rows.join(key, list(_TILE), "left_semi")), "tiles")
        settled = done if settled is None else settled.unionByName(done)
        remove(spent)
        remove(large)


def _codes(words: list[str]) -> np.ndarray:
    """The words' code points as rows, padded with zeros on the right."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    out = np.zeros((len(words), int(size.max(initial=0))), np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out


def near_in_tile(words: list[str], long: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word of a tile the number of words one edit away with p in [lo, hi), and the first of them in order (-1 without).

    Only the columns between the common prefix and the common suffix are compared: from the
    left the part at lo, from the right the part that ends before the suffix.
    """
    tail, width = long - hi, hi - lo
    # a shorter word's part is as wide: it takes one more code point from the suffix, or from the prefix
    left = _codes([w[lo:hi] for w in words])
    right = _codes([w[max(0, len(w) - tail - width) : len(w) - tail][::-1] for w in words])
    is_long = np.fromiter(map(len, words), np.int64, len(words)) == long
    n_near, first = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
    for a in range(0, len(words), BLOCK):
        for b in range(0, len(words), BLOCK):
            rows, columns = slice(a, a + BLOCK), slice(b, b + BLOCK)
            prefix, suffix = (_common(m, rows, columns, width) for m in (left, right))
            near = (prefix < width) & (prefix + suffix >= width - 1) & (is_long[rows, None] | is_long[None, columns])
            found = near.any(1)
            n_near[rows] += near.sum(1)
            first[rows] = np.where(found & (first[rows] < 0), b + near.argmax(1), first[rows])
    return n_near, first


def _common(matrix: np.ndarray, rows: slice, columns: slice, width: int) -> np.ndarray:
    """Length of the common start of each row of one block with each row of another, at most ``width``; padding equals padding."""
    a, b = matrix[rows], matrix[columns]
    alive = np.ones((len(a), len(b)), bool)
    length = np.zeros(alive.shape, np.int32)
    for k in range(matrix.shape[1]):
        alive &= a[:, k, None] == b[None, :, k]
        if not alive.any():
            break
        length += alive
    return length if matrix.shape[1] == width else np.where(alive, width, length)


def _small_tiles(words: list[str], tile: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`near_in_tile` for many small tiles at once, one after another: rows meet the rows 1, 2, ... further on.

    tile: number of each row's tile; shape: (long, lo, hi) of each row.
    """
    size = np.fromiter(map(len, words), np.int64, len(words))
    long, lo, hi = shape.T
    width = hi - lo
    left = _codes([w[a:b] for w, a, b in zip(words, lo.tolist(), hi.tolist(), strict=True)])
    right = _codes([w[max(0, n - t - k) : n - t][::-1] for w, n, t, k in zip(words, size.tolist(), (long - hi).tolist(), width.tolist(), strict=True)])
    n_near, first = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)
    for step in range(1, len(words)):
        at = np.flatnonzero(tile[:-step] == tile[step:])
        if not len(at):
            break
        to = at + step
        common = []
        for m in (left, right):
            same = np.logical_and.accumulate(m[at] == m[to], axis=1) if m.shape[1] else np.ones((len(at), 0), bool)
            common.append(np.minimum(same.sum(1), width[at]))
        near = (common[0] < width[at]) & (common[0] + common[1] >= width[at] - 1) & ((size[at] == long[at]) | (size[to] == long[at]))
        at, to = at[near], to[near]
        n_near += np.bincount(at, minlength=len(words)) + np.bincount(to, minlength=len(words))
        np.minimum.at(first, at, to)
        np.minimum.at(first, to, at)
    return n_near, np.where(first == len(words), -1, first)


#: Tiles of up to so many words are compared many at once.
SMALL_TILE = 24
#: Cells of the matrices for that.
SMALL_CELLS = 1 << 18


def _near_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial results of sorted rows: one for each word of a tile that has a near word in it."""

    def sent(words: list[str], n: list[int], found: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        at = np.flatnonzero(found[0])
        best = found[1][at]
        return pa.RecordBatch.from_arrays([pa.array([words[k] for k in at], pa.string()), pa.array(found[0][at], pa.int64()), pa.array([n[k] for k in best], pa.int64()), pa.array([words[k] for k in best], pa.string())], names=["word", "n_near", "best_n", "best"])

    held: list[tuple[str, int]] = []
    of: list[int] = []
    shapes: list[tuple[int, int, int]] = []
    widest = 0

    def flushed() -> Iterator[pa.RecordBatch]:
        if held:
            words, n = [w for w, _ in held], [k for _, k in held]
            yield sent(words, n, _small_tiles(words, np.array(of), np.array(shapes)))
        held.clear()
        of.clear()
        shapes.clear()

    for number, (key, rows) in enumerate(_groups(batches)):
        if len(rows) > SMALL_TILE:
            words = [w for w, _ in rows]
            yield sent(words, [k for _, k in rows], near_in_tile(words, *key[:3]))
        elif len(rows) > 1:
            widest = max(widest, key[2] - key[1])
            if (len(held) + len(rows)) * widest > SMALL_CELLS:
                yield from flushed()
                widest = key[2] - key[1]
            held += rows
            of += [number] * len(rows)
            shapes += [key[:3]] * len(rows)
    yield from flushed()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple[str, int]]]]:
    """(tile, its words with counts) from rows that are sorted by tile."""
    key, rows = None, []
    for batch in batches:
        *tile, word, n = (batch.column(c).to_pylist() for c in (*_TILE, "word", "n"))
        for own, w, k in zip(zip(*tile, strict=True), word, n, strict=True):
            if own != key:
                if rows:
                    yield key, rows
                key, rows = own, []
            rows.append((w, k))
    if rows:
        yield key, rows


def near_words(words: DataFrame, most: int = TILE_WORDS) -> DataFrame:
    """(word, n_near, best, best_n) of the words of ``words`` (word, n; distinct) that are one edit from others of them.

    best is the near word of largest n, ties to the first in code-point order.
    """
    tiled = tiles(words, most)
    dealt = tiled.repartition(*_TILE).sortWithinPartitions(*_TILE, F.desc("n"), "word")
    parts = dealt.mapInArrow(_near_batches, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("_best")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("_best.word").alias("best"), (-F.col("_best.n")).alias("best_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms are followed to the last. Each is more frequent than its word, so a few doublings end it."""
    current = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = current.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        jumped = stored(current.join(step, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "roots")
        if jumped.where("moved").isEmpty():
            return jumped.select("word", "root")
        remove(current)
        current = jumped.select("word", "root")


def spelling_variants(docs: DataFrame, least: int = 7, often: int = 2, every: int = 0, ratio: int = FORM_RATIO, most: int = TILE_WORDS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of all words of ``docs`` (:func:`word_counts`).

    form: the near word of largest n if that is at least ``ratio`` times the word's, else
    null with form_n. root: where forms lead to, the word itself without one. Null texts have
    no words, a null doc_id counts as an empty one in the checksum; repeated rows count each;
    texts are read run by run, whatever their length; an empty table gives no rows; other
    columns aren't read.
    """
    words = stored(word_counts(docs, least, often, every), "words")
    near = near_words(words, most)
    told = words.join(near.withColumnRenamed("word", "_word"), F.col("word") == F.col("_word"), "left")
    has = F.col("best_n") >= ratio * F.col("n")
    told = stored(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")), "near")
    roots = _roots(told.where("form is not null")).withColumnRenamed("word", "_word")
    return told.join(roots, F.col("word") == F.col("_word"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among the words of all documents, of which a thirty-first lost a code point."""
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"), least=7, often=2, every=31)
