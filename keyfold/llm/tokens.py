"""Tokens of public vocabularies, counted in Arrow batches. The vocabulary files are read where they lie."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

#: Folder of the vocabulary files; on a cluster it is the same on every executor.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern by which the byte-level vocabularies part a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def byte_bpe(folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken"):
    """A byte-level tokenizer; held once by each worker process."""
    import tiktoken

    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def pieces(folder: str = TOKENIZERS, name: str = "piece_bpe_32k.model"):
    """A tokenizer with byte fallback, and which of its ids are single bytes."""
    import numpy as np
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, name))
    return sp, np.array([sp.is_byte(i) for i in range(sp.get_piece_size())])
