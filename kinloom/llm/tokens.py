"""Token ids of a public byte-level BPE vocabulary, on the executors."""

from __future__ import annotations

import functools
import json

import numpy as np


def _byte_of_symbol() -> dict[str, int]:
    """The usual printable alphabet of byte-level BPE files: the byte that each symbol stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.lru_cache(maxsize=2)
def encoding(path: str):
    """The merges of a ``tokenizers`` file, run by a faster engine with the same ids.

    A lower id is an earlier merge in such files, so ids serve as ranks. Added
    tokens are the encoding's special ones.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    vocab, added = file["model"]["vocab"], file.get("added_tokens", [])
    if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path}: added tokens that are not found by their exact string")
    byte = _byte_of_symbol()
    ranks = {bytes(byte[c] for c in piece): i for piece, i in vocab.items() if all(c in byte for c in piece)}
    special = {p for p in vocab if p.startswith("<|") and p.endswith("|>")}
    for p in special | {t["content"] for t in added}:
        ranks.pop(p.encode(), None)
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in added})


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def ids(text: str, path: str | None = None, added: bool = False) -> np.ndarray:
    """Ids of a whole text as unsigned 32-bit numbers; strings of added tokens have their
    own ids, as the library gives by default, only with ``added``."""
    allowed = "all" if added else set()
    return encoding(path or default_path()).encode_to_numpy(text, allowed_special=allowed, disallowed_special=()).astype("<u4", copy=False)
