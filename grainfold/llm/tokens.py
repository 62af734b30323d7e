"""Token counts with a public byte-level tokenizer whose file is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


#: How text falls into pieces before merging (fixed value that belongs to the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def byte_lengths(path: str):
    """Length in bytes of every token."""
    import numpy as np

    out = np.zeros(encoding(path).n_vocab, dtype=np.int64)
    with open(path, "rb") as f:
        for a, b in map(bytes.split, f):
            out[int(b)] = len(base64.b64decode(a))
    return out
