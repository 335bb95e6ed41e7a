"""Byte-level BPE vocabularies: read from their JSON once on the driver, sent to tasks as ranks, applied by a fast encoder."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from functools import cached_property

import numpy as np

#: Where the vocabularies of public tokenizers lie; another folder may be named in the environment.
FOLDER = os.environ.get("COHORTRY_TOKENIZERS", "/opt/tokenizers")
#: The pattern that byte-level tokenizers split text by before they merge (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary(name: str) -> str:
    return os.path.join(FOLDER, name)


def _byte_of() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(prints)]
    return {**{chr(b): b for b in prints}, **{chr(256 + i): b for i, b in enumerate(rest)}}


@dataclass
class ByteLevel:
    """``ranks`` of byte strings, which are their ids, and special strings with theirs."""

    ranks: dict[bytes, int]
    specials: dict[str, int]

    @classmethod
    def load(cls, path: str) -> "ByteLevel":
        """From a tokenizer's JSON. Its merges must stand in the order of the ids that they make, as in all public byte-level files."""
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, byte_of = whole["model"], _byte_of()
        specials = {t["content"]: t["id"] for t in whole.get("added_tokens", [])}
        made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if made != sorted(made) or len(set(made)) != len(made) or whole.get("normalizer"):
            raise ValueError(f"{path}: not a byte-level table whose ids are merge ranks")
        return cls({bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in specials}, specials)

    @cached_property
    def _encoding(self):
        import tiktoken

        return tiktoken.Encoding("bytelevel", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens=self.specials)

    def ids(self, text: str, specials: bool) -> np.ndarray:
        """Ids of a text; with ``specials`` its special strings are tokens of their own, without they are plain text."""
        got = self._encoding.encode(text, allowed_special="all") if specials else self._encoding.encode_ordinary(text)
        return np.array(got, np.int64)

    @cached_property
    def tokens(self) -> list[bytes]:
        """The bytes of each id."""
        out = [b""] * (max([*self.ranks.values(), *self.specials.values()]) + 1)
        for t, i in self.ranks.items():
            out[i] = t
        for t, i in self.specials.items():
            out[i] = t.encode()
        return out

    def __getstate__(self):
        return {"ranks": self.ranks, "specials": self.specials}

    def __setstate__(self, state):
        self.ranks, self.specials = state["ranks"], state["specials"]
