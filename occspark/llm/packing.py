"""Packing of token sequences: shortest pack first over the length histogram.

Documents become pieces of at most ``room`` tokens. Only the histogram of piece lengths (at
most ``room`` counts) reaches the driver, where lengths are placed longest first, each into
the shortest pack that has room, with counts instead of pieces. The patterns come back as
ranges of ranks: the i-th piece of a length belongs where the i-th place for it is.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranking import ranked
from .storage import stored
from .tokens import bpe_ids, vocabulary_path

END = 1
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _piece_batches(batches: Iterator[pa.RecordBatch], room: int, json_path: str, ranks_path: str | None, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    def made() -> pa.RecordBatch:
        arrays = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
        return pa.RecordBatch.from_arrays(arrays + [pa.array(kept, pa.list_(pa.int32()))] * keep_ids, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids)

    for batch in batches:
        rows, kept = [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.append(bpe_ids(text.as_py() or "", json_path, ranks_path), END).astype("<u4")
            for start in range(0, len(ids), room):
                piece = ids[start : start + room]
                rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
                if keep_ids:
                    kept.append(piece.astype(np.int32))
            if len(rows) > 20_000 or keep_ids and len(rows) > 500:
                yield made()
                rows, kept = [], []
        if rows:
            yield made()


def token_pieces(docs: DataFrame, room: int, json_path: str, ranks_path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): each document's ids and END, cut every ``room``."""
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return thin.mapInArrow(lambda it: _piece_batches(it, room, json_path, ranks_path, keep_ids), _PIECES + ", ids array<int>" * keep_ids)


def place_lengths(counts: dict[int, int], room: int) -> list[tuple[int, tuple[int, ...]]]:
    """(how often, lengths) of each packing pattern. Longest lengths first, each into the shortest pack with room.

    No more packs are opened than all left pieces of a length fill, so copies share packs. A group of equal packs is split when fewer pieces are left than packs, so the number of
    patterns stays near the number of different lengths, whatever the counts.
    """
    open_packs: list[tuple[int, int, int, tuple[int, ...]]] = []  # by tokens used, fewest first
    full: list[tuple[int, tuple[int, ...]]] = []
    made = 0
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        left = counts[length]
        while left:
            if open_packs and open_packs[0][0] + length <= room:
                used, _, packs, lengths = heapq.heappop(open_packs)
            else:
                used, packs, lengths = 0, -(-left // (room // length)), ()
            take = min(left, packs)
            if take < packs:
                heapq.heappush(open_packs, (used, made := made + 1, packs - take, lengths))
            if used + length == room:
                full.append((take, (*lengths, length)))
            else:
                heapq.heappush(open_packs, (used + length, made := made + 1, take, (*lengths, length)))
            left -= take
    return full + [(packs, lengths) for _, _, packs, lengths in sorted(open_packs)]


def packed(pieces: DataFrame, room: int) -> DataFrame:
    """``pieces`` with sequence_id and offset; ``pieces`` must give the same rows each time it is read."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most room rows
    places, sequence, taken = [], 0, dict.fromkeys(counts, 0)
    for packs, lengths in place_lengths(counts, room):
        offset = 0
        for length, equal in groupby(lengths):  # equal pieces of a pack are one range, dealt round its packs
            times = len(list(equal))
            places.append((length, taken[length], taken[length] + times * packs, sequence, packs, offset))
            taken[length] += times * packs
            offset += times * length
        sequence += packs
    # a length has a few ranges only: the table is bounded by room, not by the documents
    table = spark.createDataFrame(places, "_length long, _from long, _to long, _sequence long, _packs long, _offset long")
    run = ranked(pieces, "length", ["doc_id", "start", "ids_crc32"])
    at = (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_to"))
    nth = F.col("rank") - F.col("_from")
    told = run.join(F.broadcast(table), at).withColumn("sequence_id", F.col("_sequence") + nth % F.col("_packs")).withColumn("offset", F.col("_offset") + F.col("length") * F.expr("(rank - _from) div _packs"))
    return told.drop("_length", "_from", "_to", "_sequence", "_packs", "_offset", "rank")


def pack_documents(docs: DataFrame, room: int = 2048, json_path: str | None = None, ranks_path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]), one row for each piece.

    A null or empty text is the END token alone; repeated rows are packed as often as they
    occur; an empty table gives no rows. sequence_id runs from 0 without gaps.
    """
    if json_path is None:
        json_path, ranks_path = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("byte_bpe_50k.tiktoken")
    return packed(stored(token_pieces(docs, room, json_path, ranks_path, keep_ids), "pieces"), room)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    found = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
