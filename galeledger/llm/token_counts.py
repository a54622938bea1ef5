"""Token counts of whole texts with a SentencePiece model.

Arrow tasks cut their rows into batches of about equal bytes, encode them and return
only lengths. Texts are split at safe boundaries, and each distinct piece of a batch
is encoded once. A boundary is safe where no entry of the vocabulary reaches over
it, which is read off the model: before a space that follows something else, if no
entry has the space mark after another character; and before a line break, if no
entry has one. Models that merge over these, or rewrite white space, are given whole
texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeledger.llm import hashing
from galeledger.llm.pieces import Pieces, resolve, sums

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
_MARK = "▁"
_MARK_BYTES = np.frombuffer(_MARK.encode(), np.uint8)


def count_tokens(
    docs: DataFrame,
    model: str = MODEL,
    limit: int = LIMIT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` per row of ``docs``.

    No begin, end or special tokens are added. Null counts as the empty text, which
    has no tokens. Other columns are ignored; repeated rows are counted each.
    """
    plain = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(model)
        for part in hashing.slices(batches):
            n_bytes, n_tokens = counter.count(part.column("text"))
            yield pa.record_batch(
                [part.column("doc_id"), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return plain.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


class _Counter:
    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=resolve(model))
        entries = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        plain = not any(_MARK in e.lstrip(_MARK) for e in entries)
        probe = lambda text: self.model.encode(text, out_type=str)
        # White space is kept as it is, and one space is put before a text.
        faithful = probe("") == [] and "".join(probe(" x  x ")) == f"{_MARK * 2}x{_MARK * 2}x{_MARK}"
        lone = self.model.piece_to_id(_MARK) != self.model.unk_id()
        self.at_spaces = plain and faithful and lone
        self.at_lines = self.at_spaces and not any("\n" in e for e in entries)
        self.alone = len(probe("\n"))  # with the space that is put before it
        self.breaks = len(probe("\n\n")) - self.alone
        self.at_lines = self.at_lines and self.alone == self.breaks + 1
        self.pieces = Pieces(self._encode)

    def _encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = self.model.encode([t.decode() for t in texts], num_threads=1)
        # Nothing is left of a single space, which is a token.
        counts = [len(ids) if text else 1 for text, ids in zip(texts, found)]
        return np.array(counts, np.uint32), np.ones(len(counts), np.int64)

    def count(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = hashing.text_bytes(texts)
        starts, later = self._cuts(data, offsets)
        stops = np.append(starts[1:], len(data))
        # A later piece loses its first space, which the model puts back; one that
        # starts with a line break does not have that space.
        spaced = later & (data[starts] == 0x20)
        known = self.pieces.look_up(data, starts + spaced, stops)
        counts = self.pieces.values[self.pieces.first[known]].astype(np.int64)
        counts -= later & ~spaced
        return np.diff(offsets), sums(counts, np.searchsorted(starts, offsets))

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte of every piece, and whether it is inside a text."""
        cut = np.zeros(len(data), bool)
        if self.at_spaces and len(data) > 3:
            cut[1:] = (data[1:] == 0x20) & (data[:-1] != 0x20)
            if self.at_lines:
                cut[1:] |= data[1:] == 0x0A
            # The mark itself counts as a space to the model.
            marks = np.flatnonzero(
                (data[:-2] == _MARK_BYTES[0]) & (data[1:-1] == _MARK_BYTES[1]) & (data[2:] == _MARK_BYTES[2])
            )
            after = marks[marks + 3 < len(data)] + 3
            cut[after[data[after] == 0x20]] = False
        heads = offsets[:-1][np.diff(offsets) > 0]
        later = cut.copy()
        cut[heads] = True
        later[heads] = False
        starts = np.flatnonzero(cut)
        return starts, later[starts]
