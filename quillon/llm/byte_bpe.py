"""Exact encoding of whole texts with a byte-level BPE file of the tokenizers library, at the speed of tiktoken where both must agree."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: The pre-tokenizer's published pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Beyond these code points the two libraries' Unicode tables could differ; such texts go to the tokenizers library itself.
_UNUSUAL = re.compile("[^\0-ԯ -⁯]")


def byte_names() -> dict[str, int]:
    """The character by which byte-level vocabularies name each byte: itself if printable, else the next from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def byte_lengths(path: str) -> np.ndarray:
    """How many bytes each id of a byte-level vocabulary stands for."""
    spec, names = json.loads(open(path, encoding="utf-8").read()), byte_names()
    added = {t["id"] for t in spec["added_tokens"]}
    vocab = {v: len(k) for k, v in spec["model"]["vocab"].items() if v not in added and all(c in names for c in k)}
    out = np.zeros(max([*vocab, *added]) + 1, np.int64)
    out[list(vocab)] = list(vocab.values())
    for t in spec["added_tokens"]:
        out[t["id"]] = len(t["content"].encode())
    return out


@lru_cache(maxsize=4)
def encoder(path: str, special: bool = True) -> Callable[[str], bytes]:
    """text -> little-endian uint32 ids as bytes; truncation and padding off, no special tokens added. Strings of special tokens in a text are such tokens, or with special=False ordinary text."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = not special
    spec = json.loads(open(path, encoding="utf-8").read())
    added = [t["content"] for t in spec["added_tokens"]]

    def whole(text: str) -> bytes:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    model, names = spec["model"], byte_names()
    vocab = {k: v for k, v in model["vocab"].items() if k not in added}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ranked = [vocab.get(a + b) for a, b in merges]
    simple = (
        spec["normalizer"] is None
        and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": spec["pre_tokenizer"].get("trim_offsets"), "use_regex": True}
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and None not in ranked
        and all(a < b for a, b in zip(ranked, ranked[1:], strict=False))
        and all(all(c in names for c in k) for k in vocab)
    )
    if not simple:
        return whole
    import tiktoken

    # A merge's rank is its result's id, single bytes come first: taking the lowest id is taking the first merge.
    table = {bytes(names[c] for c in k): v for k, v in vocab.items()}
    fast = tiktoken.Encoding("from-file", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(text: str) -> bytes:
        if _UNUSUAL.search(text) or (special and any(a in text for a in added)):
            return whole(text)
        return np.array(fast.encode_ordinary(text), "<u4").tobytes()

    return encode
