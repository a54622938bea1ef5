"""Token ids of a corpus in files of Re-Pair compressed shards.

A shard holds consecutive documents in ascending order of their ids, each followed by
the end id. Documents are dealt to parts by ranges of ids, which Spark finds from a
sample of bounded size; the rows of one id are spread over several ranges if they are
many. A part is read in order and cut into shards of :data:`SHARD_BYTES` of text, so no
task holds more than a shard, however long the texts of a range are.

Shards are rows of a Parquet table (written by Spark, so a lost task leaves nothing
behind), with the columns

* ``part``, ``shard``, ``n_tokens``, ``base``: its part in id order, its number in the
  part, its ids, and the first symbol that is a rule;
* ``doc_ids`` (int64) and ``doc_tokens`` (uint32): its documents and their ids with
  the end id, little-endian;
* ``low`` and ``high`` (uint16), ``rules`` (uint32 pairs) and ``lengths`` (uint32): the
  halves of the symbols, which compress better apart, the rules, and the expansion
  length of each rule for random access.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galeledger.llm import hashing, repair
from galeledger.llm.order import range_count
from galeledger.llm.pieces import worker_state
from galeledger.llm.tables import documents, row_bytes
from galeledger.llm.token_ids import Encoder

MODEL = "word_bpe_49k.json"
END_ID = 2
#: Larger than every id of the vocabulary; two-byte ids travel below it.
BASE = 1 << 16
#: Bytes of text in a shard, about; a longer text is a shard of its own.
SHARD_BYTES = 2 << 20

_SHARD = (
    "part int, shard int, n_tokens long, base long, doc_ids binary, doc_tokens binary, "
    "low binary, high binary, rules binary, lengths binary"
)


def write_token_files(
    docs: DataFrame,
    path: str,
    model: str = MODEL,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode every text and write the shards to ``path``.

    Null texts are empty and consist of the end id. Rows with the same id follow each
    other in an order that depends on their texts; repeated rows are written each. A null
    id counts as the greatest. An empty table gives a table without rows. Other columns
    are ignored.
    """
    plain = documents(docs, id_col=id_col, text_col=text_col)
    _, total = row_bytes(plain)
    # The hash and the row's number let Spark cut through the rows of one id.
    keyed = plain.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    keys = ["doc_id", "h", "row"]
    ranged = keyed.repartitionByRange(range_count(total), *keys).sortWithinPartitions(*keys)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state(("Encoder", model), lambda: Encoder(model))
        held, size, number, part = [], 0, 0, 0
        for piece in hashing.slices(batches):
            part = piece.column("part")[0].as_py()
            ids, count = encoder.encode(piece.column("text"))
            ends = np.cumsum(count + 1)
            out = np.full(int(ends[-1]), end_id, np.uint32)
            room = np.ones(len(out), bool)
            room[ends - 1] = False
            out[room] = ids
            held.append((np.asarray(piece.column("doc_id"), np.int64), count + 1, out))
            size += piece.column("text").nbytes
            if size >= SHARD_BYTES:
                yield _shard(part, number, held)
                held, size, number = [], 0, number + 1
        if held:
            yield _shard(part, number, held)

    (
        ranged.select(F.spark_partition_id().alias("part"), "doc_id", "text")
        .mapInArrow(encode, _SHARD)
        .write.option("compression", "zstd")
        .parquet(path)
    )


def _shard(part: int, number: int, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """One shard of the documents' ids, their numbers of tokens and the tokens."""
    doc_ids, sizes, ids = (np.concatenate(x) for x in zip(*held))
    base = max(BASE, int(ids.max()) + 1)
    sequence, rules, lengths = repair.compress(ids, base)
    columns = {
        "part": pa.array([part], pa.int32()),
        "shard": pa.array([number], pa.int32()),
        "n_tokens": pa.array([len(ids)], pa.int64()),
        "base": pa.array([base], pa.int64()),
    }
    packed = {
        "doc_ids": doc_ids.astype("<i8"),
        "doc_tokens": sizes.astype("<u4"),
        "low": sequence.astype("<u2"),
        "high": (sequence >> np.uint32(16)).astype("<u2"),
        "rules": rules.astype("<u4"),
        "lengths": lengths.astype("<u4"),
    }
    return pa.RecordBatch.from_pydict(columns | {k: pa.array([v.tobytes()], pa.binary()) for k, v in packed.items()})


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32, ids)`` of every document in the files.

    ``start`` counts the ids of all documents before it, ``ids_crc32`` is the unsigned
    crc32 of its ids as little-endian unsigned 32-bit integers, ``ids`` these bytes, or
    null if they are not asked for.
    """
    shards = spark.read.schema(_SHARD).parquet(path)
    # Where a part begins, from one number a part, and where a shard begins in its part.
    sizes = shards.select("part", "shard", "n_tokens")
    earlier = (Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*earlier)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", before.alias("part_first"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(*earlier)
    within = sizes.select("part", "shard", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("in_part"))
    starts = within.join(parts, "part").select("part", "shard", (F.col("part_first") + F.col("in_part")).alias("first"))
    found = shards.drop("n_tokens").mapInArrow(
        lambda it: _decode(it, with_ids),
        "part int, shard int, doc_id long, within long, n_tokens long, ids_crc32 long, ids binary",
    )
    return found.join(starts, ["part", "shard"]).select(
        "doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "ids"
    )


def _decode(batches: Iterator[pa.RecordBatch], with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            one = {c: batch.column(c)[row] for c in batch.schema.names}
            read = lambda c, kind: np.frombuffer(one[c].as_buffer(), kind)  # noqa: B023, E731
            rules = read("rules", "<u4").reshape(-1, 2)
            lengths = read("lengths", "<u4").astype(np.int64)
            ids = repair.expand(_symbols(read), rules, one["base"].as_py(), lengths).astype("<u4")
            size = read("doc_tokens", "<u4").astype(np.int64)
            bounds = np.concatenate([[0], np.cumsum(size)])
            raw = ids.tobytes()
            view = memoryview(raw)
            checks = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(bounds[:-1], bounds[1:])]
            n = len(size)
            yield pa.record_batch(
                [
                    pa.array(np.full(n, one["part"].as_py(), np.int32)),
                    pa.array(np.full(n, one["shard"].as_py(), np.int32)),
                    pa.array(read("doc_ids", "<i8")),
                    pa.array(bounds[:-1]),
                    pa.array(size),
                    pa.array(np.array(checks, np.int64)),
                    hashing.binary_array(ids, bounds) if with_ids else pa.nulls(n, pa.binary()),
                ],
                ["part", "shard", "doc_id", "within", "n_tokens", "ids_crc32", "ids"],
            )


def _symbols(read) -> np.ndarray:
    high = read("high", "<u2").astype(np.uint32) << np.uint32(16)
    return high | read("low", "<u2")


def token_slice(spark: SparkSession, path: str, part: int, shard: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of one shard, expanding only the symbols that cover them."""
    shards = spark.read.schema(_SHARD).parquet(path)
    row = shards.filter((F.col("part") == part) & (F.col("shard") == shard)).first()
    if row is None:
        return np.zeros(0, np.uint32)
    read = lambda c, kind: np.frombuffer(row[c], kind)
    rules, lengths = read("rules", "<u4").reshape(-1, 2), read("lengths", "<u4").astype(np.int64)
    return repair.decode(_symbols(read), rules, lengths, row["base"], start, stop)
