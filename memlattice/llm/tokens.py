"""Token ids of whole texts from a `tokenizers` file, encoding each distinct piece of text once.

Texts are cut at ASCII white space, and between an ASCII letter and an ASCII sign other than the apostrophe:
places where the tokenizer's own splitting (white space dropped; runs of letters, single digits, runs of
other signs, English contractions) cuts too, so the ids of a text are those of its pieces in a row. Pieces
are told apart by 64-bit hashes; a bounded cache keeps their ids. The result equals encode() of the whole
text (tested), in a fraction of the time.

Only for tokenizers that split like word_bpe_49k.json (checked when the file is opened).
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np

from memlattice.llm import _text

CACHE = 600_000  # pieces, of about 30 bytes with their ids
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # fixed value: the split of the tokenizer file

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
_SIGN = np.zeros(256, bool)
_SIGN[list(_SIGNS)] = True
_RUN = re.compile(rb"[A-Za-z]+(?![A-Za-z\x80-\xff])")


def _byte_characters() -> dict[int, int]:
    """Byte-level BPE's character for each byte: printable Latin-1 bytes stand for themselves, the others are counted from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        splits = [x.get("pattern", {}).get("Regex") for x in said["pre_tokenizer"]["pretokenizers"]]
        if _PATTERN not in splits:
            raise ValueError(f"{path} doesn't split texts in the way that this encoder relies on")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.map = _byte_characters()
        self.cache = _text.IdCache(CACHE)

    def _encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int] | None] = [None] * len(pieces)
        slow = []
        for i, b in enumerate(pieces):
            if b.isalpha():  # only ASCII letters
                out[i] = [t.id for t in self.model.tokenize(b.lower().decode())]
                continue
            s = b.decode("utf-8")
            if max(b) < 0xCA and s.isalpha() and "İ" not in s and unicodedata.is_normalized("NFC", s):
                out[i] = [t.id for t in self.model.tokenize(s.lower().encode().decode("latin-1").translate(self.map))]
            elif not b.translate(None, _SIGNS):
                out[i] = [t.id for t in self.model.tokenize(s)]
            else:
                slow.append(i)
        if slow:
            for i, e in zip(slow, self.tokenizer.encode_batch_fast([pieces[i].decode("utf-8") for i in slow], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return out

    def first_ids(self, words: list[bytes]) -> list[int]:
        """The first id of each word, 0 for one without ids. A word that begins with ASCII letters is split behind them, unless a letter of another kind may follow."""
        out, others = [0] * len(words), []
        for i, b in enumerate(words):
            run = _RUN.match(b)
            if run:
                out[i] = self.model.tokenize(run[0].lower().decode())[0].id
            else:
                others.append(i)
        for i, ids in zip(others, self._encode_pieces([words[i] for i in others]), strict=True):
            out[i] = ids[0] if ids else 0
        return out

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the last's end)."""
        starts, ends, _ = _text.spans(buf, offsets)
        if not len(starts):
            return np.zeros(0, np.uint16), np.zeros(len(offsets), np.int64)
        letter, sign = _LETTER[buf], _SIGN[buf]
        cut = np.flatnonzero((letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])) + 1
        word = np.zeros(len(buf) + 1, bool)  # cuts at text borders are starts already
        word[starts] = True
        cut = cut[~word[cut]]
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
        first = np.searchsorted(starts, offsets)
        raw = buf.tobytes()
        make = lambda new: self._encode_pieces([raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
        ids, end = self.cache.ids(_text.word_hashes(buf, starts, ends), make)
        return ids, np.concatenate([[0], end])[first]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder, with its cache, for each worker process."""
    return Encoder(path)
