"""Public byte-level BPE vocabularies (a file of base64 token and rank per line); never trained here."""

from __future__ import annotations

import base64
import functools
import os

#: The pre-tokeniser's pattern that belongs to byte_bpe_50k.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_VOCABULARY = os.environ.get("LEXWEAVE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def encoding(path: str):
    import tiktoken

    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


def forget() -> None:
    """Drops what is kept of vocabularies: a worker that goes on to other work mustn't hold them."""
    encoding.cache_clear()
    ranks.cache_clear()
