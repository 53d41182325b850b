"""Token ids of whole texts by a byte-level BPE file of the `tokenizers` library."""

from __future__ import annotations

import functools
import json
import re

import numpy as np

from .common import give_back

SPECIAL = "<|endoftext|>"
#: Characters whose classes no Unicode version has changed; other texts go through `tokenizers` itself.
_STEADY = re.compile("[^\t\n\r -~¡-ɏ‐-―‘-‟…€]")
PROBES = ["It's  a test,\n\n 12 été!", "\r\n\t xéß 3.14 -- (ok) we'll ", "   ", "thhe’s €5…"]


def _byte_of() -> dict[str, int]:
    """The inverse of the byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """The fast encoder of a file; the library's own tokenizer is read only where a text needs it, since each holds the vocabulary once more."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t != SPECIAL}
        self.fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def slow(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def check(self) -> None:
        """Compares both encoders on probes; the library's is let go again."""
        for x in PROBES:
            if self.fast.encode_ordinary(x) != self.slow.encode(x, add_special_tokens=False).ids:
                raise ValueError(f"{self.path} is not a byte-level BPE whose ids are its merge ranks")
        del self.slow

    def ids(self, text: str) -> np.ndarray:
        if SPECIAL in text or _STEADY.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    made = Encoder(path)
    made.check()
    give_back()  # what the file's text and the probes took
    return made
