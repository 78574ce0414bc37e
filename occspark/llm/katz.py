"""Katz backoff bigram model over a corpus, and the probability of every document under it.

The corpus is stored once as chunks: about a million tokens each, as codes into the chunk's own
vocabulary. Every exchange then moves one array for each chunk and bucket of keys, never a
row for each token, and a key that a chunk holds a million times travels once, so a hot word
or word pair costs no more than others:

1. words: training counts by bucket of words, summed there, go back to the chunks;
2. pairs: the same by bucket of word pairs; one chunk is named the owner of each pair;
3. contexts: owners add up, for each context, the discounted mass and the lower-order mass of
   the pairs seen after it; both go back and give the backoff weight, about
   (1 - first) / (1 - second).

Each table between them is written to the shared folder, partitioned by key bucket, and what
its exchange left on disk goes with that write. A document's score is then a local recursion:
the discounted pair probability where the pair was seen, else the context's backoff weight
times the word's probability. Once the scores are written the tables between are deleted.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .storage import remove, stored

_LOG = logging.getLogger(__name__)

#: Tokens of a chunk, about; one document is never cut.
CHUNK_TOKENS = 1_000_000
#: Keys that one bucket's task holds at once, about.
BUCKET_KEYS = 1_200_000
#: Counts up to this are discounted.
MOST_DISCOUNTED = 5
END = np.uint64(0xE27D_0000_0000_0001)
START = np.uint64(0x57A2_0000_0000_0001)
_CHUNKS = "chunk string, doc_ids array<long>, train array<boolean>, held array<boolean>, ends array<long>, codes binary, vocabulary binary"
_SENT = "bucket int, chunk string, keys binary, first binary, second binary"
_ANSWER = "chunk string, kind string, bucket int, answer binary, stats array<long>"


#: Whether the shuffle files of an execution go at its end, not when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _stored(df: DataFrame, name: str) -> DataFrame:
    """As stored, without the write's shuffle files: nothing reads them again."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP)
    conf.set(_CLEANUP, "true")
    try:
        return stored(df, name)
    finally:
        conf.set(_CLEANUP, before)


def _packed(array: np.ndarray) -> bytes:
    """Compressed bytes of an integer array, by byte planes."""
    planes = np.ascontiguousarray(array).view(np.uint8).reshape(len(array), array.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[np.ndarray] = []
    ids, train, held, sizes = [], [], [], []

    def made() -> pa.RecordBatch:
        words, inverse, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")  # frequent words get small codes, which pack well
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        row = {"chunk": uuid.uuid4().hex, "doc_ids": ids, "train": train, "held": held, "ends": np.cumsum(sizes), "codes": _packed(rank[inverse]), "vocabulary": words[order].tobytes()}
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), (pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary()), strict=True)], names=list(row))

    for batch in batches:
        texts = batch.column(3).to_pylist()
        meta = [c.to_pylist() for c in batch.columns[:3]]
        for first, raws in kernels.blocks(texts):
            words, at = kernels.hash_words(raws)
            n = len(raws)
            tokens = np.empty(len(words) + n, np.uint64)
            stops = at[1:] + np.arange(n)
            inside = np.ones(len(tokens), bool)
            inside[stops] = False
            tokens[inside], tokens[stops] = words, END
            parts.append(tokens)
            sizes += (np.diff(at) + 1).tolist()
            ids += meta[0][first : first + n]
            train += meta[1][first : first + n]
            held += meta[2][first : first + n]
            if sum(map(len, parts)) >= CHUNK_TOKENS:
                yield made()
                parts, ids, train, held, sizes = [], [], [], [], []
    if parts:
        yield made()


class _Chunk:
    """A chunk's arrays: codes by token, hash by code, and which tokens are training tokens."""

    def __init__(self, row: pd.Series) -> None:
        self.row = row
        self.codes = _unpacked(row["codes"], np.int32).astype(np.int64)
        self.vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
        ends = np.asarray(row["ends"], np.int64)
        self.starts = np.concatenate([[0], ends[:-1]])
        self.sizes = ends - self.starts
        self.train = np.repeat(np.asarray(row["train"], bool), self.sizes)

    def counts(self) -> np.ndarray:
        """Training count by code."""
        return np.bincount(self.codes[self.train], minlength=len(self.vocabulary))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(context code, word code) of the different pairs, pair of each token, training count of each pair. START is one past the words."""
        before = np.concatenate([[0], self.codes[:-1]])
        before[self.starts] = len(self.vocabulary)
        both = before * len(self.vocabulary) + self.codes
        found, inverse = np.unique(both, return_inverse=True)
        return found // len(self.vocabulary), found % len(self.vocabulary), inverse, np.bincount(inverse[self.train], minlength=len(found))

    def pair_keys(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        hashes = np.append(self.vocabulary, START)
        return kernels.mix(hashes[context] * np.uint64(0xA0761D6478BD642F) + self.vocabulary[word] * np.uint64(0xE7037ED1A0B428DB))


def _sent(chunk: str, buckets: int, keys: np.ndarray, first: np.ndarray, second: np.ndarray | None = None) -> pd.DataFrame:
    """A row for each bucket: its keys, in the chunk's order, and what goes with them."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = []
    for b in range(buckets):
        own = order[cut[b] : cut[b + 1]]
        if len(own):
            rows.append((b, chunk, keys[own].tobytes(), _packed(first[own]), _packed(second[own]) if second is not None else b""))
    return pd.DataFrame(rows, columns=["bucket", "chunk", "keys", "first", "second"])


def _answers(keys: np.ndarray, buckets: int, rows: pd.DataFrame, kind: type) -> np.ndarray:
    """The answers of all buckets in the order of ``keys``."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    out = np.zeros(len(keys), kind)
    for b, answer in zip(rows["bucket"], rows["answer"], strict=True):
        out[order[cut[b] : cut[b + 1]]] = _unpacked(answer, kind)
    return out


def _count_bucket(kind: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Sums counts by key; answers 2 * sum, plus 1 for the owner of a key; stats: counts of counts, keys, sum."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(k, np.uint64) for k in rows["keys"]])
        sizes = [len(k) // 8 for k in rows["keys"]]
        _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        total = np.bincount(inverse, np.concatenate([_unpacked(x, np.int32) for x in rows["first"]])).astype(np.int64)
        answer = 2 * total[inverse]
        answer[first] += 1
        few = np.bincount(np.minimum(total, MOST_DISCOUNTED + 2), minlength=MOST_DISCOUNTED + 3)[1 : MOST_DISCOUNTED + 2]
        stats = [*few.tolist(), int((total > 0).sum()), int(total.sum())]
        out = [(c, kind, int(rows["bucket"].iloc[0]), _packed(a), None) for c, a in zip(rows["chunk"], np.split(answer, np.cumsum(sizes)[:-1]), strict=True)]
        return pd.DataFrame([*out, (None, kind, int(rows["bucket"].iloc[0]), None, stats)], columns=["chunk", "kind", "bucket", "answer", "stats"])

    return run


def _weigh_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums, by context, the discounted mass of what was seen after it and the lower-order mass of the same words."""
    keys = np.concatenate([np.frombuffer(k, np.uint64) for k in rows["keys"]])
    _, inverse = np.unique(keys, return_inverse=True)
    sizes = np.cumsum([len(k) // 8 for k in rows["keys"]])[:-1]
    out = []
    for kind, column in (("seen", "first"), ("lower", "second")):
        total = np.bincount(inverse, np.concatenate([_unpacked(x, np.float64) for x in rows[column]]))[inverse]
        out += [(c, kind, int(rows["bucket"].iloc[0]), _packed(a), None) for c, a in zip(rows["chunk"], np.split(total, sizes), strict=True)]
    return pd.DataFrame(out, columns=["chunk", "kind", "bucket", "answer", "stats"])


def backoff(seen: np.ndarray, lower: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(backoff weight, scale of seen pairs) of contexts, so that both together sum to 1.

    A context whose counts are all too large to be discounted gives one more occurrence to
    what follows it unseen. One after which every word was seen keeps nothing back. An unseen
    context leaves all to the lower order.
    """
    every = lower >= 1 - 1e-12
    scale = np.where(every, 1 / np.maximum(seen, 1e-300), np.where(seen >= 1 - 1e-9, count / (count + 1), 1.0))
    weight = np.where(every, 0.0, (1 - scale * seen) / np.maximum(1 - lower, 1e-300))
    return np.where(count > 0, weight, 1.0), scale


def _turing(ratios: np.ndarray, common: float) -> np.ndarray | None:
    """Katz's discounts from r* / r and (k + 1) n[k+1] / n[1], where all lie in (0, 1)."""
    found = (ratios - common) / (1 - common) if common < 1 else np.zeros(len(ratios))
    return found if ((found > 0) & (found < 1)).all() else None


def _fitted_slope(n: np.ndarray) -> float | None:
    """Slope of log n[r] over log r, each n[r] averaged over the gaps beside it, as in simple Good-Turing."""
    r = np.flatnonzero(n)
    if len(r) < 2:
        return None
    low, high = np.append(0, r[:-1]), np.append(r[1:], 2 * r[-1] - r[-2])
    return float(np.polyfit(np.log(r), np.log(2 * n[r] / (high - low)), 1)[0])


def discounts_used(counts_of_counts: list[int]) -> tuple[str, np.ndarray]:
    """Which discounts the counts of counts allow, and those of :func:`discounts`.

    Copies lift single counts of counts in corpora of any size, so that raw Good-Turing ratios
    leave (0, 1). Then a line through their logarithms gives the ratios, and the discounted
    mass is set to that of Good-Turing, n[1]. Only where no falling line fits (hardly any rare
    items) is there no Good-Turing discount; absolute ones leave mass for what was not seen.
    """
    n = np.array([0, *counts_of_counts], float)
    k = MOST_DISCOUNTED
    r = np.arange(1, k + 1)
    out = np.ones(k + 2)
    raw = _turing((r + 1) * n[r + 1] / (r * n[r]), (k + 1) * n[k + 1] / n[1]) if (n[1:] > 0).all() else None
    if raw is not None:
        out[1 : k + 1] = raw
        return "Good-Turing", out
    slope = _fitted_slope(n)
    if slope is not None and (fitted := _turing((1 + 1 / r) ** (slope + 1), (k + 1) ** (slope + 1))) is not None:
        lost = (n[r] * r * (1 - fitted)).sum()
        scaled = 1 - (1 - fitted) * n[1] / lost if lost else fitted
        out[1 : k + 1] = scaled if ((scaled > 0) & (scaled < 1)).all() else fitted
        return "smoothed Good-Turing", out
    part = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    out[1 : k + 1] = 1 - part / r
    return "absolute", out


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """Good-Turing discount of counts 0, 1, ..., MOST_DISCOUNTED, and 1 for larger ones."""
    return discounts_used(counts_of_counts)[1]


class _Model:
    """Sums and discounts of both orders."""

    def __init__(self, words: list[int], pairs: list[int] | None, documents: int) -> None:
        k = MOST_DISCOUNTED
        self.n_tokens, self.n_types, self.documents = words[k + 2], words[k + 1], documents
        self.word_method, self.word_discount = discounts_used(words[: k + 1])
        left = sum(words[r - 1] * r * (1 - self.word_discount[r]) for r in range(1, k + 1))
        self.unknown = left / self.n_tokens if self.n_tokens else 1.0
        if not self.unknown:  # no rare word: as much as one token
            self.unknown = 1 / (self.n_tokens + 1)
        self.scale = (1 - self.unknown) / (1 - left / self.n_tokens) if self.n_tokens else 0.0
        self.pair_method, self.pair_discount = discounts_used(pairs[: k + 1]) if pairs else (None, None)
        for what, method, counts in (("words", self.word_method, words), ("pairs", self.pair_method, pairs)):
            if self.n_tokens and method:
                _LOG.log(logging.INFO if method == "Good-Turing" else logging.WARNING, "%s: %s discounts, counts of counts %s", what, method, counts[: k + 1])

    def word(self, counts: np.ndarray) -> np.ndarray:
        """Probability of words by training count; unseen words are one class."""
        seen = self.scale * self.word_discount[np.minimum(counts, MOST_DISCOUNTED + 1)] * counts / max(self.n_tokens, 1)
        return np.where(counts > 0, seen, self.unknown)

    def pair(self, counts: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """Discounted probability of pairs by their and their contexts' counts; 0 if not seen."""
        return self.pair_discount[np.minimum(counts, MOST_DISCOUNTED + 1)] * counts / np.maximum(contexts, 1)


def _stats(answers: DataFrame) -> list[int]:
    width = MOST_DISCOUNTED + 3
    row = answers.where("stats is not null").agg(*[F.coalesce(F.sum(F.col("stats")[k]), F.lit(0)) for k in range(width)]).first()
    return list(map(int, row))


def corpus_scores(docs: DataFrame, train: Column, held: Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    The model learns from the rows where ``train`` holds. Tokens: words without case of A-Z,
    and one end. base_score adds log10((c + 0.5) / (N + 0.5 * (V + 1))) over the tokens; score
    is the log10 probability of the text under the model, whose unseen words are one class.
    Null and empty texts are the end alone. Repeated rows count and are scored each. Without
    training rows every token is the unknown word, of probability 1. No rows give no rows.
    """
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(held, F.lit(False)).alias("held"), F.col("text").cast("string").alias("text"))
    chunks = stored(thin.mapInArrow(_chunk_batches, _CHUNKS), "chunks")
    size = chunks.agg(F.sum(F.octet_length("vocabulary")), F.sum(F.element_at("ends", -1)), F.sum(F.size(F.filter("train", lambda t: t)))).first()
    n_words, n_tokens, n_train = (int(x or 0) for x in size)
    word_buckets, pair_buckets = max(4, ceil(n_words / 8 / BUCKET_KEYS)), max(4, ceil(n_tokens / BUCKET_KEYS))

    def by_bucket(sent: DataFrame, run: Callable, name: str) -> DataFrame:
        return _stored(sent.groupBy("bucket").applyInPandas(run, _ANSWER), name)

    def words_out(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in it:
            for _, row in frame.iterrows():
                chunk = _Chunk(row)
                yield _sent(row["chunk"], word_buckets, chunk.vocabulary, chunk.counts().astype(np.int32))

    def pairs_out(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in it:
            for _, row in frame.iterrows():
                chunk = _Chunk(row)
                context, word, _, count = chunk.pairs()
                yield _sent(row["chunk"], pair_buckets, chunk.pair_keys(context, word), count.astype(np.int32))

    words = by_bucket(chunks.mapInPandas(words_out, _SENT), _count_bucket("words"), "words")
    pairs = by_bucket(chunks.mapInPandas(pairs_out, _SENT), _count_bucket("pairs"), "pairs")
    model = _Model(_stats(words), _stats(pairs), n_train)

    def known(chunk: _Chunk, answers: pd.DataFrame) -> tuple:
        """Counts by word and pair, and the pairs themselves."""
        kind = answers["kind"]
        counts = _answers(chunk.vocabulary, word_buckets, answers[kind == "words"], np.int64) >> 1
        context, word, inverse, _ = chunk.pairs()
        told = _answers(chunk.pair_keys(context, word), pair_buckets, answers[kind == "pairs"], np.int64)
        after = np.append(np.where(chunk.vocabulary == END, 0, counts), model.documents)
        return counts, context, word, inverse, told >> 1, (told & 1).astype(bool), after

    def contexts_out(_key: tuple, mine: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        chunk = _Chunk(mine.iloc[0])
        counts, context, word, _, seen, owner, after = known(chunk, answers)
        own = owner & (seen > 0)
        n = len(chunk.vocabulary) + 1
        mass = np.bincount(context[own], model.pair(seen, after[context])[own], minlength=n)
        lower = np.bincount(context[own], model.word(counts)[word[own]], minlength=n)
        return _sent(mine["chunk"].iloc[0], word_buckets, np.append(chunk.vocabulary, START), mass, lower)

    def scores_out(_key: tuple, mine: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        chunk = _Chunk(mine.iloc[0])
        counts, context, word, inverse, seen, _, after = known(chunk, answers)
        own = np.append(chunk.vocabulary, START)
        sums = [_answers(own, word_buckets, answers[answers["kind"] == k], np.float64) for k in ("seen", "lower")]
        weight, scale = backoff(*sums, after)
        backed = weight[context] * model.word(counts)[word]
        log_pair = np.log10(np.where(seen > 0, scale[context] * model.pair(seen, after[context]), backed))
        base = np.log10((counts + 0.5) / (model.n_tokens + 0.5 * (model.n_types + 1)))
        row = chunk.row
        per_doc = lambda x: np.add.reduceat(x, chunk.starts)
        ids = pd.array(row["doc_ids"], dtype="Int64") if not isinstance(row["doc_ids"], np.ndarray) else pd.array([None if x is None or x != x else int(x) for x in row["doc_ids"]], dtype="Int64")
        return pd.DataFrame({"doc_id": ids, "held_out": np.asarray(row["held"], bool), "n_tokens": chunk.sizes, "n_known": per_doc((counts > 0).astype(np.int64)[chunk.codes]),
                             "train_tokens": model.n_tokens, "base_score": per_doc(base[chunk.codes]), "score": per_doc(log_pair[inverse])})

    by_chunk = lambda *tables: _all([t.where("chunk is not null").drop("stats") for t in tables]).groupBy("chunk")
    sent = chunks.groupBy("chunk").cogroup(by_chunk(words, pairs)).applyInPandas(contexts_out, _SENT)
    contexts = by_bucket(sent, _weigh_bucket, "contexts")
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scores = _stored(chunks.groupBy("chunk").cogroup(by_chunk(words, pairs, contexts)).applyInPandas(scores_out, out), "scores")
    for table in (chunks, words, pairs, contexts):
        remove(table)
    return scores


def _all(tables: list[DataFrame]) -> DataFrame:
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t)
    return whole


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by a model of four fifths of them. A null doc_id is neither learnt from nor held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    return corpus_scores(docs, fold != 1, fold == 1)
