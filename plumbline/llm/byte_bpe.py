"""Byte-level BPE ids from a ``tokenizers`` file."""

from __future__ import annotations

import json
from functools import cache, cached_property

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

DEFAULT = public_tokenizers.path("byte_bpe_50k.json")

# Fixed value: the pattern of byte-level pre-tokenization.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_names() -> dict[str, int]:
    """The printable stand-in of each byte: itself, or else the next free code point from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    names = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return names | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBPE:
    """The ids of the file's tokenizer: ``ids`` as the library gives them, ``encode`` with special strings taken as ordinary text.

    Where the file's merges are in the order of the ids they make, merging by
    rank gives the same ids several times faster; otherwise, and for a text the
    fast form refuses, the ``tokenizers`` library encodes.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        names, vocabulary = _byte_names(), model["model"]["vocab"]
        added = model.get("added_tokens", [])
        special = {t["content"] for t in added if t["special"]}
        self.added = {t["content"]: t["id"] for t in added}
        # Added tokens that the fast form finds as the library does: no choice between two, nothing around them counts.
        self.plain = not any(t[k] for t in added for k in ("lstrip", "rstrip", "single_word", "normalized")) and (
            not any(a != b and a in b for a in self.added for b in self.added)
        )
        made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["model"]["merges"]]
        ranks = {bytes(names[c] for c in t): i for t, i in vocabulary.items() if t not in special}
        ordered = all(a < b for a, b in zip(made, made[1:])) and len(made) + 256 == len(ranks)
        byte_level = (model.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not model["pre_tokenizer"].get("add_prefix_space")
        self.fast = None
        if ordered and byte_level and not model.get("normalizer"):
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.added)

    # Loaded when first needed: a worker keeps what it has loaded.
    @cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    @cached_property
    def slow(self) -> Tokenizer:
        out = Tokenizer.from_file(self.path)
        out.encode_special_tokens = True
        return out

    def ids(self, text: str) -> np.ndarray:
        """The library's ids without the post-processor's tokens; an added token in the text is one id."""
        if self.fast is not None and (self.plain or not any(t in text for t in self.added)):
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all", disallowed_special=())
            except (ValueError, RuntimeError):  # beyond the limits of the pattern engine
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except (ValueError, RuntimeError):  # beyond the limits of the pattern engine
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@cache
def byte_bpe(path: str) -> ByteBPE:
    """One tokenizer per file and Python worker."""
    return ByteBPE(path)
