"""Public tokenizers inside tasks: opened once in each Python worker."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

#: Units longer than this go through the tokenizers library, whose merges don't slow with length.
LONG_RUN = 20_000


def vocabulary_path(name: str) -> str:
    """Where the vocabulary file ``name`` of the installed public tokenizers lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def byte_bpe(path: str):
    """The byte-level BPE of a tokenizers file; special tokens in a text are ordinary text."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


@lru_cache(maxsize=4)
def byte_bpe_ranks(path: str):
    """The same vocabulary as ranks, several times faster; gives the same ids."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def bpe_ids(text: str, json_path: str, ranks_path: str | None) -> np.ndarray:
    """uint32 token ids of a text. Without a ranks file, or on very long unbroken runs, by tokenizers itself."""
    if ranks_path is not None and (len(text) < LONG_RUN or max(map(len, text.split()), default=0) < LONG_RUN):
        return byte_bpe_ranks(ranks_path).encode_to_numpy(text, disallowed_special=())
    return np.array(byte_bpe(json_path).encode(text, add_special_tokens=False).ids, np.uint32)
