"""Token ids of whole texts with a given public tokenizer file.

Byte-level tokenizers cut a text before they merge, and a single space between
two other characters always begins a new cut. Texts are therefore divided there
and the parts, most of which were met before, are looked up in a bounded table
per worker; the tokenizers library encodes the parts not yet known, many at
once. The ids equal those of the whole text.
"""

from __future__ import annotations

import os
import re

import numpy as np

from entitystats.llm.common import kept

#: Ids are stored in this type: little-endian, unsigned, 32 bits.
ID_TYPE = np.dtype("<u4")
#: Parts a worker remembers, and how many parts may go unremembered before it starts afresh.
MAX_KNOWN = 500_000
MAX_MISSED = 5_000_000

#: Unknown parts that are encoded at once.
TOGETHER = 4096

_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_OTHER_SPACE = re.compile(r"[^\S \n]")


class Encoder:
    """Encodes texts to bytes of ``ID_TYPE`` ids."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        # a space at the front of a token is written as this letter in the vocabulary
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        for token, at in self.tokenizer.get_vocab().items():
            self.spaced[at] = token.startswith("\u0120")
        self.parts: dict[str, bytes] = {}
        self.missed = 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, ID_TYPE)

    def _remember(self, part: str, ids: bytes) -> None:
        if len(part) > 64:
            return
        if len(self.parts) < MAX_KNOWN:
            self.parts[part] = ids
            return
        self.missed += 1
        if self.missed > MAX_MISSED:
            self.parts.clear()
            self.missed = 0

    def _learn(self, parts: list[str]) -> list[bytes]:
        """Ids of each part with a space before it.

        Parts that hold no space themselves are encoded as one text; each of
        them then begins at a token that begins with a space.
        """
        ids = self._ids(" " + " ".join(parts))
        starts = np.flatnonzero(self.spaced[ids])
        if len(starts) == len(parts) and starts[0] == 0:
            raw, at = ids.tobytes(), (starts * ID_TYPE.itemsize).tolist()
            found = [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)])]
        else:
            found = [self._ids(" " + part).tobytes() for part in parts]
        for part, got in zip(parts, found):
            self._remember(part, got)
        return found

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        plain = not (text[0].isspace() or text[-1].isspace() or "  " in text or " \n" in text or "\n " in text or _OTHER_SPACE.search(text))
        first, *rest = text.split(" ") if plain else _SAFE_SPACE.split(text)
        out = list(map(self.parts.get, rest))
        if None in out:
            unknown = list(dict.fromkeys([part for part, got in zip(rest, out) if got is None]))
            step = TOGETHER if plain else 1
            new: dict[str, bytes] = {}
            for at in range(0, len(unknown), step):
                some = unknown[at : at + step]
                new.update(zip(some, self._learn(some)))
            out = [new[part] if got is None else got for part, got in zip(rest, out)]
        return b"".join([self._ids(first).tobytes(), *out])


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, made once in each worker."""
    return kept(("tokens", path), lambda: Encoder(path))
