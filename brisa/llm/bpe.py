"""Byte-level BPE; the vocabulary file's path is a parameter."""

from __future__ import annotations

import base64
from array import array

import numpy as np
import tiktoken

DEFAULT_VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict[str, "Bpe"] = {}


class Bpe:
    """``encode`` gives little-endian ids; ``width`` bytes each."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.size = max(ranks.values()) + 1
        self.eos = self.size  # the id after the last rank is free
        self.dtype = np.dtype("<u2") if self.eos < 1 << 16 else np.dtype("<u4")
        self.encoding = tiktoken.Encoding("file", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.code = "H" if self.dtype.itemsize == 2 else "I"

    def encode(self, text: str) -> bytes:
        return array(self.code, self.encoding.encode_ordinary(text)).tobytes()

    def decode(self, ids) -> str:
        return b"".join(self.bytes_of.get(int(i), b"") for i in ids).decode("utf-8", "replace")


def load(path: str = DEFAULT_VOCAB) -> Bpe:
    """One tokenizer for each file and worker process."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]
