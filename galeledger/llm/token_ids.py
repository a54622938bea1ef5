"""Token ids of whole texts with a file of the tokenizers library.

Distinct pieces between safe boundaries are encoded once per task: white space
never belongs to a token, and between a letter and common ASCII punctuation the
word pattern always cuts. Boundaries next to other characters are left alone, also
around the characters of special tokens and contractions.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from galeledger.llm import hashing
from galeledger.llm.pieces import Pieces, resolve

_LETTER, _POINT, _OTHER, _BLANK = 1, 2, 0, 3
_KIND = np.zeros(256, np.uint8)
_KIND[np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = _LETTER
_KIND[np.frombuffer(b".,!?;:*$&#%()", np.uint8)] = _POINT
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = _BLANK
#: Words encoded in one call.
_JOINED = 1000
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch


class Encoder:
    """Encodes texts without added special tokens; their strings inside a text are
    handled as the library does by default."""

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(resolve(model))
        # Splitting is sound for this pipeline only; others get whole texts.
        probe = self.model.encode("a.b a, (c)\tD", add_special_tokens=False).ids
        parts = [self.model.encode(x, add_special_tokens=False).ids for x in ("a", ".", "b", "a", ",", "(", "c", ")", "d")]
        self.split = probe == [i for ids in parts for i in ids]
        self.ends = np.zeros(self.model.get_vocab_size(), bool)
        self.ends[[i for t, i in self.model.get_vocab().items() if t.endswith("</w>")]] = True
        self.folded, self.exact = Pieces(self._encode, lower=self.split), Pieces(self._encode)

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces; words of plain letters are encoded many in one call."""
        texts = [p.decode() for p in pieces]
        plain = np.zeros(len(texts), bool)
        if self.split:
            plain[:] = [_PLAIN(t) is not None for t in texts]
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        number = int(plain.sum())
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        for low in range(0, number, _JOINED):
            ids, size = self._joined([texts[r] for r in order[low : min(number, low + _JOINED)]])
            parts.append(ids)
            sizes.append(size)
        ids, size = self._single([texts[r] for r in order[number:]])
        flat = np.concatenate([*parts, ids])
        size = np.concatenate([*sizes, size])
        # Back into the order of the pieces.
        first, place = np.cumsum(size) - size, np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        own = size[place]
        begins = np.cumsum(own) - own
        at = np.arange(len(flat)) + np.repeat(first[place] - begins, own)
        return flat[at], own

    def _single(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.model.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        made = [x.ids for x in found]
        size = np.fromiter(map(len, made), np.int64, len(made))
        return np.fromiter((i for ids in made for i in ids), np.uint32, int(size.sum())), size

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words encoded together: each ends with its only end-of-word token."""
        ids = np.array(self.model.encode(" ".join(words), add_special_tokens=False).ids, np.uint32)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            return self._single(words)
        return ids, np.diff(cuts, prepend=0)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text, and their number per text."""
        data, offsets = hashing.text_bytes(texts)
        starts, stops = self._spans(data, offsets)
        # Letter case matters only to special tokens, all of which hold "<".
        pieces = self.exact if (data == 0x3C).any() else self.folded
        known = pieces.look_up(data, starts, stops)
        ids, size = pieces.sequences(known)
        ends = np.concatenate([[0], np.cumsum(size)])
        bounds = ends[np.searchsorted(starts, offsets)]
        return ids, np.diff(bounds)

    def _spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        heads = offsets[:-1][np.diff(offsets) > 0]
        if not self.split or len(data) < 2:
            return heads, np.append(heads[1:], len(data)).astype(np.int64)
        kind = _KIND[data]
        # Two-byte Latin letters; the other characters of that block are signs.
        two = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))
        kind[two] = _LETTER
        kind[two + 1] = _LETTER
        cut = np.zeros(len(data) + 1, bool)
        a, b = kind[:-1], kind[1:]
        cut[1:-1] = (a != b) & ((a | b) == (_LETTER | _POINT)) | ((a == _BLANK) != (b == _BLANK))
        cut[offsets] = True
        at = np.flatnonzero(cut)
        starts, stops = at[:-1], at[1:]
        full = kind[starts] != _BLANK
        return starts[full], stops[full]
