"""Text quality by supervised subword embeddings.

A text is the average of the vectors of its words, of the runs of 2 to 5 words, and of
the character n-grams of 3 and 4 bytes in its words, all hashed into one table of
buckets; a softmax layer on the average gives the two classes. Table and layer are
trained together by stochastic gradient descent in numpy, one text at a time, with a
falling learning rate. Rate, epochs and orders were chosen on a part of the rows that
are not held out.

Training takes a sample of bounded size (``SAMPLE_ROWS`` labelled texts per class,
chosen by a hash of their id, whole texts) in one task. As the layer is linear, a
trained bucket is worth one number in the score, the difference of its two class
scores, so tasks hold a table of one number per bucket (4 MB) and score by sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeledger.llm import hashing
from galeledger.llm.language_id import held_out

#: Labelled texts per class in the training sample, about.
SAMPLE_ROWS = 3000
#: Bits of a bucket's number.
BITS = 20
BUCKETS = 1 << BITS
#: Longest run of words.
WORDS = 5
DIMENSIONS = 16
EPOCHS = 5
RATE = 40.0
THRESHOLD = 0.7


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = THRESHOLD,
    sample_rows: int = SAMPLE_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row of ``docs``.

    ``score`` is the probability of label 1, ``predicted`` is 1 from ``threshold`` on.
    Learns from rows that are not held out and have one label (rows of one id that
    disagree or are null don't count). Null texts are empty; an empty text gets the
    score of the bias. Without any label every score is 0.5, with one class only the
    share of label 1 with one text added to each class. Rows of equal texts get equal
    scores, repeated rows one each; a null id stays null and is not held out. An empty
    table gives an empty result. Other columns are ignored.
    """
    weights = train(docs, labels, sample_rows, id_col, text_col, label_col)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    plain = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        held_out(F.col(id_col)).alias("held_out"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worth, bias = shared.value
        for part in hashing.slices(batches):
            score = _scores(part.column("text"), worth, bias)
            chosen = (score >= threshold).astype(np.int32)
            yield pa.record_batch(
                [part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array(chosen)],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return plain.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, with all columns.

    Null texts count as empty and stay as they are; repeated rows are all kept or all
    dropped; an empty table gives an empty one. See :func:`score_quality`.
    """
    weights = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worth, bias = shared.value
        for part in hashing.slices(batches):
            score = _scores(part.column("text"), worth, bias)
            yield part.filter(pa.array(score >= threshold)).select(columns)

    return docs.mapInArrow(run, docs.schema)


def train(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = SAMPLE_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> tuple[np.ndarray, float]:
    """What each bucket adds to the log odds of label 1, and the bias."""
    known = (
        labels.filter(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).cast("long").alias("__id"))
        .agg(F.min(label_col).alias("label"), F.max(label_col).alias("other"))
        .filter("label = other AND __id IS NOT NULL")
        .select("__id", "label")
    )
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not sizes:
        return np.zeros(BUCKETS, np.float32), 0.0
    share = F.when(F.col("label") == 1, min(1.0, sample_rows / sizes.get(1, 1))).otherwise(
        min(1.0, sample_rows / sizes.get(0, 1))
    )
    chance = (F.xxhash64("__id").bitwiseAND((1 << 53) - 1)) / float(1 << 53)
    # About twice sample_rows ids, so every scan task may hold them.
    sample = F.broadcast(known.filter(chance < share))
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chosen = texts.join(sample, "__id").select("__id", "text", "label")
    found = chosen.repartition(1).mapInArrow(_train_task, "worth binary, bias double").first()
    if found is None:
        return np.zeros(BUCKETS, np.float32), 0.0
    return np.frombuffer(found["worth"], np.float32), found["bias"]


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for part in hashing.slices(batches):
        keys, text, _ = _features(part.column("text"))
        ids, label = part.column("__id").to_pylist(), part.column("label").to_pylist()
        order = np.argsort(text, kind="stable")
        keys, text = keys[order], text[order]
        bounds = np.searchsorted(text, np.arange(len(ids) + 1))
        for i, name in enumerate(ids):
            found, count = np.unique(keys[bounds[i] : bounds[i + 1]], return_counts=True)
            rows.append((name, label[i], found, count.astype(np.float32)))
    if not rows:
        return
    rows.sort(key=lambda r: (r[0], r[1], len(r[2])))
    worth, bias = descend([r[2] for r in rows], [r[3] for r in rows], np.array([r[1] for r in rows]))
    yield pa.record_batch([pa.array([worth.tobytes()], pa.binary()), pa.array([bias])], ["worth", "bias"])


def descend(
    keys: list[np.ndarray], counts: list[np.ndarray], labels: np.ndarray, seed: int = 6
) -> tuple[np.ndarray, float]:
    """Stochastic gradient descent over texts given as buckets and counts."""
    positive = int(labels.sum())
    prior = float(np.log((positive + 1) / (len(labels) - positive + 1)))
    if positive in (0, len(labels)):
        return np.zeros(BUCKETS, np.float32), prior
    rng = np.random.Generator(np.random.PCG64(seed))
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer = np.zeros((2, DIMENSIONS), np.float32)
    bias = np.array([0.0, prior], np.float32)
    steps = EPOCHS * len(labels)
    step = 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(labels)):
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            if not len(keys[i]):
                continue
            share = (counts[i] / counts[i].sum())[:, None]
            mean = (vectors[keys[i]] * share).sum(axis=0)
            logits = layer @ mean + bias
            chance = np.exp(logits - logits.max())
            error = chance / chance.sum()
            error[labels[i]] -= 1
            toward = error @ layer
            # Rare and frequent features move alike: the root of the share, not the share.
            vectors[keys[i]] -= (rate * np.minimum(1, np.sqrt(share)) * 0.1) * toward
            layer -= (rate * 0.1) * np.outer(error, mean)
            bias -= (rate * 0.001) * error
    worth = vectors @ (layer[1] - layer[0])
    return worth.astype(np.float32), float(bias[1] - bias[0])


def _bucket(code: np.ndarray, seed: int) -> np.ndarray:
    odd = np.uint32((0x9E3779B1 + 2 * 0x1000193 * seed) & 0xFFFFFFFF)
    mixed = (code ^ (code >> np.uint32(15))) * odd
    return ((mixed ^ (mixed >> np.uint32(13))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)


def _parts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per kind of feature: buckets at all positions, where they are valid, and the
    positions where texts begin."""
    data, offsets = hashing.text_bytes(texts)
    # A space before, between and after the texts bounds their words.
    padded = np.full(len(data) + len(offsets), 0x20, np.uint8)
    room = np.ones(len(padded), bool)
    heads = offsets + np.arange(len(offsets))
    room[heads] = False
    padded[room] = data
    blank = hashing._SPACE[padded]
    padded[blank] = 0x20
    wide = padded.astype(np.uint32)
    three = wide[:-2] | (wide[1:-1] << np.uint32(8)) | (wide[2:] << np.uint32(16))
    valid = ~blank[1:-1]
    yield _bucket(three, 1), valid, heads
    four = three[:-1] | (wide[3:] << np.uint32(24))
    yield _bucket(four, 2), valid[:-1] & valid[1:], heads
    starts, stops, first = hashing.word_spans(data, offsets)
    words = hashing.hash_spans(data, starts, stops)
    # Words from each one to the end of its text.
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(words))
    for n in range(1, WORDS + 1):
        found = words if n == 1 else hashing.window_hashes(words, n)
        bucket = np.zeros(len(words), np.uint32)
        bucket[: len(found)] = found >> np.uint64(64 - BITS)
        yield bucket, left >= n, first


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Bucket and text of every feature."""
    keys, owner = [], []
    for bucket, valid, heads in _parts(texts):
        at = np.flatnonzero(valid)
        keys.append(bucket[at])
        owner.append(np.searchsorted(heads, at, side="right") - 1)
    return np.concatenate(keys), np.concatenate(owner), len(texts)


def _scores(texts: pa.Array, worth: np.ndarray, bias: float) -> np.ndarray:
    total, number = np.zeros((2, len(texts)))
    for bucket, valid, heads in _parts(texts):
        value = worth[bucket] * valid
        ends = np.minimum(heads, len(value))
        total += _between(value, ends)
        number += _between(valid, ends)
    logit = bias + np.divide(total, number, out=np.zeros(len(texts)), where=number > 0)
    return 1 / (1 + np.exp(-np.clip(logit, -700, 700)))


def _between(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums between consecutive bounds, each the same whatever else is in the batch."""
    out = np.zeros(len(bounds) - 1)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.add.reduceat(values, bounds[full], dtype=np.float64)
    last = bounds[-1]
    if len(full) and last < len(values):
        row = full[-1]
        out[row] = values[bounds[row] : last].sum(dtype=np.float64)
    return out
