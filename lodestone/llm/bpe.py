"""Byte-level BPE of public rank files. The path is a parameter; the file is read by the driver and travels with the job."""

from __future__ import annotations

import base64
import os

PATH = os.environ.get("LODESTONE_BPE", "/opt/tokenizers/byte_bpe_50k.tiktoken")

#: The split that comes before the merges, for Java (Unicode classes on) and for tiktoken.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
JAVA_PATTERN = "(?U)" + PATTERN

_made: dict[int, object] = {}


def ranks(path: str = PATH) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoding(raw: bytes):
    """The encoder of a rank file's content, made once in a process."""
    key = hash(raw)
    if key not in _made:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        _made[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _made[key]
