"""Benchmark decontamination by CGK random-walk embedding and bit-sampling LSH.

A random walk over a window of words stays on a word or moves to the next by a random bit of
(step, word) and writes down the word it is on. This turns edits into few changed places:
windows at a small edit distance get strings at a small Hamming distance, as their walks meet
again behind an edit. Each repeat draws a new walk and samples some places of its string.
Every window of a text, at every word, is embedded so for every length that items have; those
that agree with an item in the sampled places of any repeat are its only candidates. Then
the exact word edit distance decides.

A walk doesn't depend on how long its window is, so all lengths share it. It doesn't depend on
where it came from either: windows whose walks have met share all that follows, so a text is
walked by what comes to each word, not by windows. Items of more than PIECE words are looked for by pieces: of an
item with few edits, some piece has no more than its share of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, floor, isqrt

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels

#: Word edits allowed, as a share of an item's words.
EDIT_SHARE = 0.2
#: Walks, repeats of the sampling (so many of each walk), sampled places of each, and steps from
#: one place to the next. At EDIT_SHARE a repeat whose places are on different words finds about
#: 0.45 of the alignments; all together miss about 0.002 (tests/llm measures the recall of the
#: hits alone).
WALKS, REPEATS, PLACES, GAP = 6, 36, 3, 2
#: An item is also looked for by places that share words if fewer repeats than this have none.
LEAST_REPEATS = 4
#: Items shorter than this are sampled at two places, and at one if they are single words.
SHORT = 8
#: Shorter items have few places, so each of their repeats draws a walk of its own.
OWN_WALKS = 12
#: Items up to this length have the places of just their length.
OWN_LENGTH = 18
#: Longer items are looked for by pieces of so many words.
PIECE = 64
#: Lengths within this factor share their places.
LENGTH_STEP = 1.5
#: UTF-8 bytes of items that one block, and so one broadcast, holds at most (an item is whole in one).
BLOCK_ITEM_BYTES = 16 << 20
_PAD = np.uint64(0)
#: Repeats sample at multiples of so many steps, so that they can share lookups.
_STRIDE = 4
#: Places that a walk can get beyond the last word (under 256: see all_signatures).
_BEYOND = 2 * PIECE + 2 * _STRIDE
_SLOTS = 16
#: Cells of hits x words looked at together.
_CELLS = 1 << 20
#: Hits that are held before those found twice are dropped.
_HELD = 1 << 22


def _draws() -> tuple[np.ndarray, np.ndarray]:
    """(odd multipliers by walk and 64 steps, where in its walk each repeat samples, 0 to 1). Repeats r, r + WALKS, ... share a walk; walks from WALKS on are of one repeat each."""
    random = np.random.default_rng(10)
    odd = random.integers(0, 1 << 63, (WALKS, 1 + _BEYOND // 64), np.uint64) * np.uint64(2) + np.uint64(1)
    where = (np.arange(REPEATS) + random.random(REPEATS)) / REPEATS
    more = random.integers(0, 1 << 63, (REPEATS, odd.shape[1]), np.uint64) * np.uint64(2) + np.uint64(1)
    return np.concatenate([odd, more]), where


_ODD, _WHERE = _draws()


def length_class(words: int) -> int:
    """The shortest length whose places are used for windows of ``words`` words."""
    if words < OWN_LENGTH:
        return words
    length = OWN_LENGTH
    while (longer := ceil(length * LENGTH_STEP)) <= words:
        length = longer
    return length


def first_place(length: int, repeat: int) -> int:
    """The step of the first place that a repeat samples; later ones follow at GAP."""
    span = 2 * length - isqrt(length) - (GAP if length < SHORT else PLACES * GAP)
    return 0 if length < 1 / EDIT_SHARE else int(_WHERE[repeat] * max(0, span)) // _STRIDE * _STRIDE


def _sampled(lengths: list[int]) -> Iterator[tuple[int, dict[int, set[int]]]]:
    """(walk, step -> numbers of places) for some length classes; repeats and classes that sample a walk at one step share what they sample."""
    for walk in range(WALKS + REPEATS):
        wanted: dict[int, set[int]] = {}
        for repeat in range(walk, REPEATS, WALKS) if walk < WALKS else [walk - WALKS]:
            for length in lengths:
                if (length < OWN_WALKS) == (walk >= WALKS):
                    wanted.setdefault(first_place(length, repeat), set()).add(1 if length == 1 else 2 if length < SHORT else PLACES)
        if wanted:
            yield walk, wanted


def _bits(padded: np.ndarray, walk: int, step: int) -> np.ndarray:
    """A random bit of each word for 64 steps of a walk."""
    return kernels.mix(padded * _ODD[walk, step // 64])


def _moved(at: np.ndarray, bits: np.ndarray, step: int) -> np.ndarray:
    return at + ((bits.take(at) >> np.uint64(step % 64)) & np.uint64(1)).view(np.int64)


def _places(at: np.ndarray, bits: np.ndarray, mixed: list[np.ndarray], step: int, numbers: set[int]) -> Iterator[tuple[int, np.ndarray, tuple[np.ndarray, ...]]]:
    """(number of places, signature, places) of walks that are on the words ``at``: the first place, then one each GAP steps."""
    places, signature = (at,), mixed[0].take(at)
    for number in range(1, max(numbers) + 1):
        if number > 1:
            for k in range(GAP):
                at = _moved(at, bits, step + GAP * (number - 2) + k)
            places, signature = (*places, at), signature + mixed[number - 1].take(at)
        if number in numbers:
            yield number, signature, places


def _padded(words: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(the words and padding behind, on which walks stay; what each word adds to a signature at each place)"""
    padded = np.append(words, np.full(2, _PAD))
    return padded, [kernels.mix(padded + np.uint64(k + 1)) * np.uint64(2 * k + 3) for k in range(PLACES)]


def signatures(words: np.ndarray, lengths: list[int], starts: np.ndarray) -> Iterator[tuple[tuple[int, int, int], np.ndarray, tuple[np.ndarray, ...]]]:
    """((walk, step, number of places), signature, places) of the windows from each start.

    ``lengths`` are length classes. places: the words that the walk is on at the sampled
    places. Behind the words everything is padding.
    """
    padded, mixed = _padded(words)
    for walk, wanted in _sampled(lengths):
        at = np.asarray(starts, np.int64)
        for step in range(max(wanted) + 1):
            if step % 64 == 0:
                bits = _bits(padded, walk, step)
            if step in wanted:
                for number, signature, places in _places(at, bits, mixed, step, wanted[step]):
                    yield (walk, step, number), signature, places
            at = _moved(at, bits, step)


def _slot(hashed: np.ndarray) -> np.ndarray:
    return (hashed >> np.uint64(64 - _SLOTS)).view(np.int64)


def all_signatures(words: np.ndarray, lengths: list[int], first: dict[tuple[int, int], np.ndarray]) -> Iterator[tuple[tuple[int, int, int], np.ndarray, np.ndarray, np.ndarray]]:
    """((walk, step, number of places), signature, first place, behind) of the windows from every word, each place once.

    first: (walk, step) -> the slots of words that can be first places; others are left out.
    Walks from neighbouring words soon meet, and then go on as one. behind: how far before
    each word the first window starts whose walk has come to it or beyond, so that of word p
    the windows start from p - behind[p] until p + 1 - behind[p + 1]; the next step changes it.
    """
    padded, mixed = _padded(words)
    slot = _slot(padded)
    for walk, wanted in _sampled(lengths):
        behind = np.zeros(len(padded), np.uint8)
        behind[-1] = 1  # no window starts at the padding
        apart, move = np.empty_like(behind[1:]), np.empty_like(behind[1:])
        for step in range(max(wanted) + 1):
            if step % 64 == 0:
                bits = _bits(padded, walk, step)
                planes = np.ascontiguousarray(bits[:-1].view(np.uint8).reshape(-1, 8).T)
            if step in wanted:
                at = np.flatnonzero(behind[1:] <= behind[:-1])
                at = at[first[walk, step].take(slot.take(at))]
                for number, signature, _ in _places(at, bits, mixed, step, wanted[step]):
                    yield (walk, step, number), signature, at, behind
            # those who come to a word are those who were there, or one before and move
            np.right_shift(planes[step % 64 // 8], np.uint8(step % 8), out=move)
            np.bitwise_and(move, np.uint8(1), out=move)
            np.subtract(behind[:-1], behind[1:], out=apart)
            np.add(apart, np.uint8(1), out=apart)
            np.multiply(apart, move, out=apart)
            behind[1:] += apart


@dataclass(frozen=True)
class Items:
    """Benchmark items of one block: words, allowed edits, and the signature tables of their pieces.

    runs, grams: the length of the word runs that survivors are counted by, and each item's.
    lengths: the length classes of the pieces. first: (walk, step) -> which slots of words are
    taken by first places. tables: (walk, step, places) -> (which slots are taken, sorted
    signatures, their pieces).
    """

    ids: list
    words: list[np.ndarray]
    edits: np.ndarray
    runs: np.ndarray
    grams: list[np.ndarray]
    item: np.ndarray
    offset: np.ndarray
    lengths: list[int]
    first: dict[tuple[int, int], np.ndarray]
    tables: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _runs(words: np.ndarray, q: int) -> np.ndarray:
    return kernels.hash_ngrams(words, np.array([0, len(words)]), q, whole_if_short=False)[0]


def prepare(rows: list[tuple[object, str | None]], share: float = EDIT_SHARE) -> Items:
    """The tables of some items; items without words are left out."""
    ids, words = [], []
    for first, raws in kernels.blocks([text for _, text in rows]):
        hashed, at = kernels.hash_words(raws, strip_punctuation=True)
        for k in range(len(raws)):
            if at[k + 1] > at[k]:
                ids.append(rows[first + k][0])
                words.append(hashed[at[k] : at[k + 1]])
    edits = np.array([floor(share * len(w) + 1e-9) for w in words], np.int64)
    runs = np.array([max(1, min(3, (len(w) - e) // (e + 1))) for w, e in zip(words, edits, strict=True)], np.int64)
    pieces = [(i, o, min(PIECE, len(w))) for i, w in enumerate(words) for o in sorted({*range(0, max(1, len(w) - PIECE + 1), PIECE), max(0, len(w) - PIECE)})]
    item, offset, size = (np.array([p[k] for p in pieces], np.int64) for k in range(3))
    own = np.array([length_class(int(n)) for n in size], np.int64)
    lengths = sorted(set(own.tolist()))
    sampled: dict[tuple[int, int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
    first_slots = {(walk, step): np.zeros(1 << _SLOTS, bool) for walk, wanted in _sampled(lengths) for step in wanted}
    gap = np.full(_BEYOND, _PAD)
    for length in lengths:
        of = np.flatnonzero(own == length)
        parts = [np.concatenate([words[item[p]][offset[p] : offset[p] + size[p]], gap]) for p in of]
        starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]).astype(np.int64)
        laid = np.concatenate(parts)
        drawn = list(signatures(laid, [length], starts))
        # a walk that runs out of its piece says nothing, and one that stays on a word little
        inside = [places[-1] < starts + size[of] for _, _, places in drawn]
        apart = [np.logical_and.reduce([a < b for a, b in zip(places, places[1:], strict=False)] or [np.ones(len(of), bool)]) & x for x, (_, _, places) in zip(inside, drawn, strict=True)]
        few = np.sum(apart, 0) < LEAST_REPEATS
        for (key, signature, places), x, y in zip(drawn, inside, apart, strict=True):
            told = np.flatnonzero(np.where(few, x, y))
            first_slots[key[:2]][_slot(laid[places[0][told]])] = True
            sampled.setdefault(key, []).append((signature[told], of[told]))
    tables = {}
    for key, parts in sampled.items():
        signature, piece = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.argsort(signature, kind="stable")
        taken = np.zeros(1 << _SLOTS, bool)
        taken[_slot(signature)] = True
        tables[key] = (taken, signature[order], piece[order])
    return Items(ids, words, edits, runs, [np.unique(_runs(w, int(q))) for w, q in zip(words, runs, strict=True)], item, offset, lengths, first_slots, tables)


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each range."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def hits(words: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(item, where it would start) of every window that agrees with an item in some repeat's places, each once."""
    found = [np.empty((0, 2), np.int64)]
    held = 0
    for key, signature, at, behind in all_signatures(words, items.lengths, items.first):
        taken, known, piece = items.tables[key]
        near = np.flatnonzero(taken.take(_slot(signature)))
        low, high = np.searchsorted(known, signature[near], "left"), np.searchsorted(known, signature[near], "right")
        told = np.repeat(at[near], high - low)
        first = told - behind[told]
        many = told + 1 - behind[told + 1] - first
        which = np.repeat(piece[_ranges(low, high - low)], many)
        found.append(np.stack([items.item[which], _ranges(first, many) - items.offset[which]], 1))
        held += len(which)
        if held > _HELD:  # repeats find the same hits again
            found = [np.unique(np.concatenate(found), axis=0)]
            held = len(found[0]) // 2
    both = np.unique(np.concatenate(found), axis=0)
    return both[:, 0], both[:, 1]


def best_window(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, first word, end) of the window of ``text`` nearest to ``item`` in word edits; of equal ones the first, shortest."""
    one = len(text) + 1
    place = np.arange(one) * one
    row = np.arange(one)  # edits * one + start
    for word in item:
        new = row + one
        new[1:] = np.minimum(new[1:], row[:-1] + (text != word) * one)
        row = np.minimum.accumulate(new - place) + place
    end = int(row.argmin())
    return int(row[end] // one), int(row[end] % one), end


def matches(words: np.ndarray, bounds: np.ndarray, items: Items) -> list[tuple[int, object, int, int, int]]:
    """(text, item id, first word, words, edits) of the best window of each item that some texts hold.

    ``words`` of text d: bounds[d] to bounds[d + 1].
    """
    which, start = hits(words, items)
    text = np.searchsorted(bounds, np.clip(start, 0, len(words) - 1), "right") - 1
    cut = np.flatnonzero(np.diff(which)) + 1
    runs: dict[int, np.ndarray] = {}
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for own in np.split(np.arange(len(which)), cut) if len(which) else []:
        i = int(which[own[0]])
        m, e, q = len(items.words[i]), int(items.edits[i]), int(items.runs[i])
        reach = e + isqrt(min(m, PIECE)) + 1
        low, high = start[own] - reach, start[own] + m + e + reach
        # runs of q words of which e edits leave m - q + 1 - e * q at least
        if q not in runs:
            runs[q] = np.append(_runs(words, q), np.zeros(max(1, len(words) + 1 - max(0, len(words) - q + 1)), np.uint64))
        need, span = max(1, m - q + 1 - e * q), m + e + 2 * reach
        kept = []
        for k in range(0, len(own), max(1, _CELLS // span)):
            at = np.clip(low[k : k + max(1, _CELLS // span), None] + np.arange(span), 0, len(words))
            grams = items.grams[i]
            seen = runs[q][at]
            same = grams[np.minimum(np.searchsorted(grams, seen), len(grams) - 1)] == seen
            same[:, 1:] &= np.diff(at, axis=1) > 0
            kept.append(k + np.flatnonzero(same.sum(1) >= need))
        kept = np.concatenate(kept)
        if not len(kept):
            continue
        apart = np.flatnonzero((np.diff(start[own][kept]) > m) | (np.diff(text[own][kept]) > 0)) + 1
        for region in np.split(kept, apart):
            for d in range(int(text[own[region[0]]]), int(text[own[region[-1]]]) + 1):
                a, b = max(int(low[region[0]]), int(bounds[d])), min(int(high[region[-1]]), int(bounds[d + 1]))
                edits, first, end = best_window(items.words[i], words[a:b])
                if edits <= e:
                    told = (edits, a + first - int(bounds[d]), end - first)
                    best[d, i] = min(best.get((d, i), told), told)
    return [(d, items.ids[i], first, size, edits) for (d, i), (edits, first, size) in sorted(best.items())]


def scan(texts: list[str | None], items: Items) -> list[list[tuple[object, int, int, int]]]:
    """The matches (item id, first word, words, edits) of each text."""
    out: list[list[tuple[object, int, int, int]]] = [[] for _ in texts]
    if not items.ids:
        return out
    for first, raws in kernels.blocks(texts):
        words, at = kernels.hash_words(raws, strip_punctuation=True)
        if len(words):
            for d, *match in matches(words, at, items):
                out[first + d].append(tuple(match))
    return out


def _id_type(benchmark: DataFrame) -> str:
    """Item ids stay whole numbers, or else are text."""
    return "long" if isinstance(benchmark.schema["item_id"].dataType, T.IntegralType) else "string"


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The items, at most BLOCK_ITEM_BYTES of text at a time, from one pass over the benchmark; at least one block."""
    thin = benchmark.select(F.col("item_id").cast(_id_type(benchmark)).alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    rows, size, none = [], 0, True
    for row in thin.toLocalIterator():
        if rows and size + len(row["text"].encode()) > BLOCK_ITEM_BYTES:
            yield prepare(rows)
            rows, size, none = [], 0, False
        rows.append((row["item_id"], row["text"]))
        size += len(row["text"].encode())
    if rows or none:
        yield prepare(rows)


def _found(texts: list[str | None], blocks: list[Broadcast]) -> list[list[tuple[object, int, int, int]]]:
    """The matches of each text with all blocks; of several, a task holds one at a time."""
    out: list[list[tuple[object, int, int, int]]] = [[] for _ in texts]
    for block in blocks:
        for own, more in zip(out, scan(texts, block.value), strict=True):
            own += more
        if len(blocks) > 1:
            del block._value  # read again from the executor's disk for the next texts
    return out


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, edits): each item that a document holds, at its best window.

    Words are runs of letters and digits, without case of A-Z. An item is held if some window
    is within EDIT_SHARE of its words in word edits; items of fewer than five words must
    occur exactly. Null and empty texts hold nothing, an empty benchmark or table gives no
    rows, repeated rows and items match each. Documents are read once, whatever the benchmark's size.
    """
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = [docs.sparkSession.sparkContext.broadcast(b) for b in item_blocks(benchmark)]
    names = ("doc_id", "item_id", "first_word", "n_words", "edits")
    kinds = (pa.int64(), pa.int64() if _id_type(benchmark) == "long" else pa.string(), pa.int64(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(doc_id, *match) for doc_id, own in zip(ids, _found(batch.column(1).to_pylist(), sent), strict=True) for match in own]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return thin.mapInArrow(run, f"doc_id long, item_id {_id_type(benchmark)}, first_word long, n_words long, edits long")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text holds no item, from one pass over them."""
    sent = [docs.sparkSession.sparkContext.broadcast(b) for b in item_blocks(benchmark)]

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not x for x in _found(batch.column("text").to_pylist(), sent)], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return contaminations(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
