"""Word hashing in numpy: whole batches of texts at once, no per-word Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Text bytes hashed at once; bounds the arrays below, whatever a batch holds.
BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_ODD = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3,
                 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9FB21C651E98DF25], np.uint64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Word separators: the blank and \t \n \v \f \r.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything but letters, digits and bytes beyond ASCII, for words without punctuation.
_PUNCT = np.ones(256, bool)
_PUNCT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def blocks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, UTF-8 of some texts), about BLOCK_BYTES at a time; null is empty."""
    first, some, size = 0, [], 0
    for k, text in enumerate(texts):
        raw = b"" if text is None else text.encode()
        if some and size + len(raw) > BLOCK_BYTES:
            yield first, some
            first, some, size = k, [], 0
        some.append(raw)
        size += len(raw) + 1
    if some:
        yield first, some


def hash_words(raws: list[bytes], strip_punctuation: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, offsets): words offsets[i]:offsets[i + 1] are those of raws[i].

    Words are runs of non-blanks, A-Z lower-cased; with strip_punctuation, runs of ASCII
    letters, digits and non-ASCII characters. The polynomial of a word's bytes comes from a
    running sum over the block, so the cost is a few array passes.
    """
    ends = np.cumsum([len(r) + 1 for r in raws])
    buffer = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    gap = (_PUNCT if strip_punctuation else _BLANK)[buffer]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate([[0], edge])
    start, stop = edge[0::2], edge[1::2]
    offsets = np.concatenate([[0], np.searchsorted(start, ends)]).astype(np.int64)
    up, down = _powers(len(buffer))
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum((_LOWER[buffer].astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return mix((sums[stop] - sums[start]) * down[start]), offsets


def hash_ngrams(words: np.ndarray, offsets: np.ndarray, n: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of n words, offsets). A shorter text gives one run of all its words, or none."""
    count = np.diff(offsets)
    runs = np.maximum(count - n + 1, ((count > 0) & whole_if_short).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(runs)]).astype(np.int64)
    total = len(words) - n + 1
    hashed = np.zeros(max(total, 0), np.uint64)
    for k in range(n if total > 0 else 0):
        hashed += words[k : k + total] * _ODD[k]
    grams = np.empty(out[-1], np.uint64)
    full = np.flatnonzero(count >= n)
    if len(full):
        at = np.repeat(offsets[full] - out[full], runs[full])
        where = np.repeat(out[full], runs[full]) + (np.arange(runs[full].sum()) - np.repeat(np.cumsum(runs[full]) - runs[full], runs[full]))
        grams[where] = mix(hashed[where + at])
    if whole_if_short:
        for i in np.flatnonzero((count > 0) & (count < n)):
            own = words[offsets[i] : offsets[i + 1]]
            grams[out[i]] = mix((own * _ODD[: len(own)]).sum(keepdims=True) + np.uint64(len(own)))[0]
    return grams, out
