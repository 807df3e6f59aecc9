"""Token ids by a byte-level BPE tokenizer file (JSON of the tokenizers library).

The file's vocabulary lists its tokens in the order of their merges, so its
ids are merge ranks and the compiled rank encoder gives the library's ids.
An added token's string in a text is its id, special or not, as in the
library (add_special_tokens=False only adds none around a text): a text is cut
there, and what stands between is encoded alone.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import tiktoken

#: The byte-level pre-tokenizer's pattern (a fixed value of the file format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of_sign() -> dict[str, int]:
    """The format's printable sign of each byte: printable bytes are themselves, the rest follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Vocabulary:
    def __init__(self, blob: bytes):
        file = json.loads(blob)
        kind = file["pre_tokenizer"]
        model = file["model"]
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or file.get("normalizer") \
                or model.get("type") != "BPE":
            raise ValueError("a byte-level BPE file without prefix space or normalizer is needed")
        added = [t for t in file.get("added_tokens") or [] if t["content"]]
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")) \
                or len({bool(t.get("normalized")) for t in added}) > 1:
            raise ValueError("added tokens that are found as they stand are needed")
        self.added = {t["content"].encode(): t["id"] for t in added}
        # leftmost, then longest; no match without added tokens
        self._added = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or b"(?!)")
        byte_of = _byte_of_sign()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items()
                 if token.encode() not in self.added}
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        made = [bytes(byte_of[c] for c in m.replace(" ", "")) for m in merges]
        if [ranks[m] for m in made] != sorted(ranks[m] for m in made):
            raise ValueError("the ids do not follow the merges")
        self.bytes_of = {i: w for w, i in (ranks | self.added).items()}
        self.size = max(self.bytes_of) + 1
        self._encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: bytes) -> np.ndarray:
        ids, at = [], 0
        for found in self._added.finditer(text):
            ids += self._encoding.encode_ordinary(text[at:found.start()].decode())
            ids.append(self.added[found.group()])
            at = found.end()
        ids += self._encoding.encode_ordinary((text[at:] if at else text).decode())
        return np.array(ids, np.uint32)

    def encode_plain(self, text: bytes) -> list[int]:
        """Ids of a text in which the strings of added tokens are ordinary text."""
        return self._encoding.encode_ordinary(text.decode())


_KEPT: dict[bytes, Vocabulary] = {}


def vocabulary(blob: bytes) -> Vocabulary:
    """The vocabulary of a file's bytes, built once in a Python worker."""
    key = hashlib.sha256(blob).digest()
    if key not in _KEPT:
        _KEPT[key] = Vocabulary(blob)
    return _KEPT[key]
