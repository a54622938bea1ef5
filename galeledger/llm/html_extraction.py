"""Main text of HTML pages by a linear-chain conditional random field.

A page is the sequence of its leaf blocks (:mod:`galeledger.llm.html_blocks`). The
field scores each block as main text or not by the elements around it, their names and
its text, and each pair of neighbours by their labels; the labels with the best total
are found by the Viterbi algorithm. Weights are those of greatest likelihood, with a
quadratic penalty, on labelled pages of a fixed number; pages are then read in Arrow
tasks, each for itself, without a shuffle.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeledger.llm import hashing
from galeledger.llm.html_blocks import blocks, features, score
from galeledger.llm.labelled_pages import MARK, labelled_pages

STEPS = 200
PENALTY = 0.01


class Field(NamedTuple):
    """Weights of the features for main text, and of pairs of neighbouring labels."""

    weights: dict[str, float]
    start: float
    pairs: tuple[tuple[float, float], tuple[float, float]]


def extract(
    pages: DataFrame,
    labelled: Sequence[str] | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page.

    The text is the blocks of the article in page order, joined by an empty line. Character
    references are decoded, white space of any kind inside a block is one space and none
    is left at its ends. Null, empty and text-free pages have the empty text, of 0
    characters. Every row of the input gives one row, repeated ones too; null ids and urls
    stay null. An empty table gives an empty result. Other columns are ignored. ``labelled``
    pages (:mod:`galeledger.llm.labelled_pages`) replace the ones built in.
    """
    field = trained(tuple(labelled) if labelled is not None else None)
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in hashing.slices(batches, "html"):
            texts = [main_text(page.as_py(), field) for page in batch.column("html")]
            yield pa.record_batch(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array(map(len, texts), pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def main_text(page: str, field: Field) -> str:
    """Main text of one page."""
    found = blocks(page, field.weights)
    labels = best_labels([score(b, field.weights) for b in found], field)
    return "\n\n".join(b.text for b, label in zip(found, labels) if label)


def best_labels(scores: Sequence[float], field: Field) -> list[int]:
    """The labels with the greatest total (Viterbi); ties go to main text."""
    if not scores:
        return []
    (stay_out, enter), (leave, stay_in) = field.pairs
    out, inside = 0.0, scores[0] + field.start
    came = []
    for emitted in scores[1:]:
        to_out = inside + leave >= out + stay_out
        to_in = inside + stay_in >= out + enter
        came.append((to_out, to_in))
        out, inside = (
            (inside + leave if to_out else out + stay_out),
            (inside + stay_in if to_in else out + enter) + emitted,
        )
    label = int(inside >= out)
    labels = [label]
    for step in reversed(came):
        label = int(step[label])
        labels.append(label)
    return labels[::-1]


# --- training -------------------------------------------------------------------


@functools.lru_cache(maxsize=4)
def trained(labelled: tuple[str, ...] | None = None, steps: int = STEPS, penalty: float = PENALTY) -> Field:
    """The field of greatest penalised likelihood on the labelled pages, by gradient
    steps of a size that adapts to each weight. The same pages give the same field."""
    names: dict[str, int] = {}
    found, labels = [], []
    for page in labelled if labelled is not None else labelled_pages():
        blocks_ = blocks(page, {})
        if blocks_:
            labels.append([int(b.text.startswith(MARK)) for b in blocks_])
            plain = [b._replace(text=b.text.removeprefix(MARK).strip() or ".") for b in blocks_]
            found.append([[names.setdefault(f, len(names)) for f in features(b)] for b in plain])
    pages, longest = len(found), max(map(len, found), default=0)
    x = np.zeros((pages, longest, len(names)), np.float32)
    y = np.zeros((pages, longest), np.int64)
    real = np.zeros((pages, longest), bool)
    for i, (rows, own) in enumerate(zip(found, labels)):
        real[i, : len(own)] = True
        y[i, : len(own)] = own
        for j, row in enumerate(rows):
            x[i, j, row] = 1
    flat = x[real].astype(np.float64)
    theta = np.zeros(len(names) + 5)
    size, before = np.full_like(theta, 0.1), np.zeros_like(theta)
    for _ in range(steps if pages else 0):
        _, slope = likelihood(theta, flat, y, real, penalty)
        turn = slope * before
        size = np.clip(np.where(turn > 0, size * 1.2, np.where(turn < 0, size * 0.5, size)), 1e-6, 1.0)
        before = np.where(turn < 0, 0.0, slope)
        theta += np.sign(before) * size
    theta = [round(v, 9) for v in theta.tolist()]
    start, *pairs = theta[len(names) :]
    return Field({n: theta[k] for n, k in names.items()}, start, (tuple(pairs[:2]), tuple(pairs[2:])))


def likelihood(
    theta: np.ndarray, flat: np.ndarray, y: np.ndarray, real: np.ndarray, penalty: float
) -> tuple[float, np.ndarray]:
    """Penalised log-likelihood per block of label sequences, and its slope.

    ``flat`` has the features of all real blocks; ``theta`` their weights, that of a first
    block in the main text, and those of label pairs (from, to).
    """
    k = flat.shape[1]
    emitted = np.zeros(real.shape)
    emitted[real] = flat @ theta[:k]
    emitted[:, 0] += theta[k]
    (p00, p01), (p10, p11) = pairs = theta[k + 1 :].reshape(2, 2)
    pages, longest = real.shape
    # Per page and block: log of the sum over all labels before it (or after it) for
    # either label, as the value for "out" and how much more "main" has.
    base, ahead = np.zeros(real.shape), np.zeros(real.shape)
    ahead[:, 0] = emitted[:, 0]
    for t in range(1, longest):
        out = np.logaddexp(p00, p10 + ahead[:, t - 1])
        more = np.logaddexp(p01, p11 + ahead[:, t - 1]) - out + emitted[:, t]
        base[:, t] = base[:, t - 1] + np.where(real[:, t], out, 0.0)
        ahead[:, t] = np.where(real[:, t], more, ahead[:, t - 1])
    total = base[:, -1] + np.logaddexp(0.0, ahead[:, -1])
    behind = np.zeros(real.shape)
    joint = np.zeros((pages, 2, 2))
    for t in range(longest - 1, 0, -1):
        weight = emitted[:, t] + behind[:, t]
        out = np.logaddexp(p00, p01 + weight)
        behind[:, t - 1] = np.where(real[:, t], np.logaddexp(p10, p11 + weight) - out, 0.0)
        # Chances of the four pairs of labels at t - 1 and t.
        four = np.stack([p00 + 0 * weight, p01 + weight, p10 + ahead[:, t - 1], p11 + ahead[:, t - 1] + weight])
        four = np.exp(four - np.logaddexp.reduce(four)) * real[:, t]
        joint += four.T.reshape(pages, 2, 2)
    inside = 1 / (1 + np.exp(-(ahead + behind)))
    follows = real[:, 1:]
    counted = np.zeros((2, 2))
    np.add.at(counted, (y[:, :-1][follows], y[:, 1:][follows]), 1)
    value = (emitted * y)[real].sum() + (counted * pairs).sum() - total.sum()
    slope = np.zeros_like(theta)
    slope[:k] = flat.T @ (y - inside)[real]
    slope[k] = (y[:, 0] - inside[:, 0]).sum()
    slope[k + 1 :] = (counted - joint.sum(axis=0)).ravel()
    n = max(1, int(real.sum()))
    return value / n - penalty * (theta**2).sum() / n, slope / n - 2 * penalty * theta / n
