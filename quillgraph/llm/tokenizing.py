"""Encoding with the tokenizers library, each distinct piece of text once."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillgraph.llm.segments import SegmentEncoder

#: Words of which normalising and splitting leave one piece: Latin letters, behind at most one space.
_PLAIN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+\Z")
#: Pieces that a worker remembers.
REMEMBERED = 500_000
_ENCODERS: dict[str, SegmentEncoder] = {}


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: printable Latin-1 stays, the others follow U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def encoder(path: str) -> SegmentEncoder:
    """The worker's encoder for the tokenizer file at ``path``. As the library does, a string of one of its added
    tokens in a text becomes that token; texts that have one are handed to the library whole."""
    if path in _ENCODERS:
        return _ENCODERS[path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        settings = json.load(f)
    lower = '"Lowercase"' in json.dumps(settings["normalizer"])
    added = [t["content"] for t in settings["added_tokens"]]
    folded = any(t["normalized"] for t in settings["added_tokens"])  # then they may be spelt otherwise in the text

    def whole(column: pa.Array) -> pa.Array:
        out = pa.array(np.full(len(column), folded))
        for a in added:
            out = pc.or_(out, pc.match_substring(column, a))
        return out

    letters, tokenize, match, normal = _byte_letters(), tokenizer.model.tokenize, _PLAIN.match, unicodedata.is_normalized
    space = letters[32]

    def encode(pieces: list[str]) -> list[bytes]:
        """Plain words by the library's model alone, the others by the whole of it."""
        out, other = [], []
        for i, word in enumerate(pieces):
            if not match(word):
                other.append(i)
                out.append(b"")
                continue
            if lower:
                word = word.strip(" ").lower()
            if word.isascii():
                if word[0] == " ":
                    word = space + word[1:]
            elif normal("NFC", word):
                word = "".join([letters[b] for b in word.encode()])
            else:
                other.append(i)
                out.append(b"")
                continue
            out.append(array("i", [t.id for t in tokenize(word)]).tobytes())
        for i in range(0, len(other), 10_000):
            some = other[i : i + 10_000]
            for k, e in zip(some, tokenizer.encode_batch_fast([pieces[k] for k in some], add_special_tokens=False)):
                out[k] = np.array(e.ids, "<i4").tobytes()
        return out

    _ENCODERS[path] = SegmentEncoder(encode, whole, remembered=REMEMBERED)
    return _ENCODERS[path]
