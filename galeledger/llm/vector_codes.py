"""Vector compression by product codes, assigned through memoised grid cells.

Vectors are cut into equal parts, and every part becomes the index of the nearest
entry of its position's codebook. Nearest entries are found by cells: a part's coarse
cell in an integer grid is hashed, and for each cell the entries are kept that can be
nearest to some point of it. An entry whose least distance to the cell's box is
greater than another entry's greatest distance is dominated over the whole box and
left out. Only the entries that remain are compared exactly, in integers; parts of
one cell share the list.

Codebooks are trained by rounds over the whole table. Tasks send their sums per entry,
which Spark adds up, so one codebook (entries x dimension numbers) a round comes to
the driver and goes out with the next round. Sums are of integers: the result doesn't
depend on how rows are dealt to tasks or how often a task is run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeledger.llm import hashing
from galeledger.llm.tables import materialise
from galeledger.operators.joins import per_key

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Cells remembered per part position in a task; beyond them the memory begins anew.
CELLS = 1 << 16
#: Numbers in a block of work.
BLOCK = 1 << 21
_LAST = (1 << 63) - 1

CODED = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def compress(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` per vector.

    Vectors that are null or hold null or non-finite components are dropped. Components
    become ``floor(scale * x)``. The codebooks begin as the vectors with the smallest
    ids; equal ids go by their components, a null id after all others. With fewer vectors
    than entries, each vector is an entry. Equal vectors get equal codes, and every row
    of the input that isn't dropped gives one row. The dimension is the most frequent
    length that ``parts`` divides (ties: the smaller); a vector of another length, or
    with a component so large that its squared distances could leave 64 bits, stays out of the
    codebooks and has null code and error. ``label_error`` is the sum of the errors of
    the rows with an equal label, nulls together; null where all of them are null, or beyond
    64 bits. An empty table gives an empty result. Other columns are ignored.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).alias("label"),
        F.col(vector_col).alias("v"),
    )
    dimension = _dimension(rows, parts)
    books = first_codebooks(rows, dimension, parts, entries, scale)
    for _ in range(rounds):
        books = improved(rows, books, dimension, scale)
    numbers = ",".join(str(x) for book in books for x in book.ravel().tolist())
    digest = hashlib.sha256(numbers.encode()).hexdigest()
    coded = materialise(assigned(rows, books, dimension, scale), "vector-codes")
    sums = per_key(coded, "label").agg(F.try_sum("error").alias("label_error"))
    sums = sums.select(F.col("key.label").alias("of"), "label_error")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


def _dimension(rows: DataFrame, parts: int) -> int:
    """The most frequent vector length that the parts divide; 0 without any."""
    sizes = rows.select(F.size("v").alias("n")).filter(f"n > 0 AND n % {int(parts)} = 0")
    most = sizes.groupBy("n").count().orderBy(F.desc("count"), "n").first()
    return most["n"] if most else 0


def largest(dimension: int) -> int:
    """Components up to this keep the squared distance of two vectors under 2^61."""
    return int((2.0**59 / max(dimension, 1)) ** 0.5)


def integers(column: pa.Array, dimension: int, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which vectors are kept, which of these can be coded, and the components of these."""
    lengths = np.asarray(column.value_lengths().fill_null(-1), np.int64)
    values = np.asarray(column.flatten().cast(pa.float64()).fill_null(np.nan), np.float64)
    ends = np.cumsum(np.maximum(lengths, 0))
    begins = ends - np.maximum(lengths, 0)
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    kept = (lengths >= 0) & (wrong[ends] == wrong[begins])
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(values * scale)
        far = np.concatenate([[0], np.cumsum(~(np.abs(values) <= largest(dimension)))])
    usable = kept & (lengths == dimension) & (far[ends] == far[begins]) & (dimension > 0)
    at = begins[usable][:, None] + np.arange(dimension)
    return kept, usable, values[at].astype(np.int64)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("vec_id").fill_null(_LAST), np.int64)


# --- codebooks ------------------------------------------------------------------


def first_codebooks(rows: DataFrame, dimension: int, parts: int, entries: int, scale: int) -> list[np.ndarray]:
    """The parts of the vectors with the smallest ids; a task sends no more than that."""

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nulls, ids = np.zeros(0, bool), np.zeros(0, np.int64)
        found = np.zeros((0, dimension), np.int64)
        for batch in batches:
            _, usable, more = integers(batch.column("v"), dimension, scale)
            new = _ids(batch)[usable]
            absent = np.asarray(batch.column("vec_id").is_null().to_numpy(zero_copy_only=False))[usable]
            if len(ids) == entries:
                near = new <= ids[-1]
                new, more, absent = new[near], more[near], absent[near]
            elif len(new) > entries:
                near = new <= np.partition(new, entries - 1)[entries - 1]
                new, more, absent = new[near], more[near], absent[near]
            ids, found = np.concatenate([ids, new]), np.concatenate([found, more])
            nulls = np.concatenate([nulls, absent])
            order = np.lexsort((*found.T[::-1], nulls, ids))[:entries]
            ids, found, nulls = ids[order], found[order], nulls[order]
        if len(ids):
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(ids) + 1, dtype=np.int32) * dimension), pa.array(found.ravel())
            )
            yield pa.record_batch([pa.array(ids), pa.array(nulls), lists], ["id", "absent", "v"])

    if not dimension:
        return [np.zeros((0, 0), np.int64)] * parts
    firsts = rows.select("vec_id", "v").mapInArrow(smallest, "id long, absent boolean, v array<long>")
    taken = firsts.orderBy("id", "absent", "v").limit(entries).collect()
    whole = np.array([r["v"] for r in taken], np.int64).reshape(len(taken), dimension)
    return np.split(whole, parts, axis=1)


def improved(rows: DataFrame, books: list[np.ndarray], dimension: int, scale: int) -> list[np.ndarray]:
    """Each entry replaced by the floored mean of the parts nearest to it."""
    if not len(books[0]):
        return books
    k, d = books[0].shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [Cells(book) for book in books]
        total = np.zeros((len(books), k, d + 1), np.int64)
        for batch in batches:
            _, _, whole = integers(batch.column("v"), dimension, scale)
            for p, finder in enumerate(finders):
                part = whole[:, p * d : (p + 1) * d]
                index, _ = finder.nearest(part)
                order = np.argsort(index, kind="stable")
                used, begins = np.unique(index[order], return_index=True)
                if len(used):
                    total[p, used, :d] += np.add.reduceat(part[order], begins, axis=0)
                    total[p, used, d] += np.diff(np.append(begins, len(order)))
        at = np.flatnonzero(np.repeat(total[:, :, d].ravel() > 0, d + 1))
        if len(at):
            yield pa.record_batch([pa.array(at), pa.array(total.ravel()[at])], ["place", "total"])

    added = rows.select("v").mapInArrow(sums, "place long, total long")
    # At most parts x entries x (part dimension + 1) numbers.
    found = added.groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    total = np.zeros(len(books) * k * (d + 1), object)
    for row in found:
        total[row["place"]] = int(row["total"])
    total = total.reshape(len(books), k, d + 1)
    out = []
    for p, book in enumerate(books):
        new = book.copy()
        used = np.flatnonzero(total[p, :, d])
        new[used] = total[p, used, :d] // total[p, used, d:]
        out.append(new)
    return out


def assigned(rows: DataFrame, books: list[np.ndarray], dimension: int, scale: int) -> DataFrame:
    """``(vec_id, label, code, error)`` of the kept vectors."""
    d = dimension // max(len(books), 1)
    digits = np.array([f"{i:02x}" for i in range(256)]) if len(books[0]) <= 256 else None

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [Cells(book) for book in books]
        for batch in batches:
            kept, usable, whole = integers(batch.column("v"), dimension, scale)
            text = np.zeros(len(whole), f"<U{2 * len(books)}") if digits is not None else None
            names = np.full(batch.num_rows, None, object)
            error = np.zeros(len(whole), np.int64)
            pieces = []
            for p, finder in enumerate(finders):
                index, distance = finder.nearest(whole[:, p * d : (p + 1) * d])
                pieces.append(digits[index] if digits is not None else np.array([f"{i:x}" for i in index]))
                error += distance
            if len(whole):
                text = pieces[0]
                for piece in pieces[1:]:
                    text = np.char.add(text, piece)
                names[usable] = text
            errors = np.zeros(batch.num_rows, np.int64)
            errors[usable] = error
            out = pa.record_batch(
                [
                    batch.column("vec_id"),
                    batch.column("label"),
                    pa.array(names, pa.string()),
                    pa.array(errors, mask=~usable),
                ],
                ["vec_id", "label", "code", "error"],
            )
            yield out.filter(pa.array(kept))

    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(code, f"vec_id long, label {kind}, code string, error long")


# --- cells ------------------------------------------------------------------------


class Cells:
    """Nearest entries of one codebook, found by remembered cells of a grid.

    The width of a cell is a power of two, about an eighth of how far the entries spread
    in a direction, so the lists stay short; any width gives the same answers.
    """

    def __init__(self, book: np.ndarray, width: int | None = None):
        self.book = book
        self.floats = book.astype(np.float64)
        self.squares = np.einsum("ij,ij->i", self.floats, self.floats)
        spread = float(self.floats.std(axis=0).mean()) if book.size else 0.0
        self.width = width or 1 << max(0, int(np.log2(max(spread / 8, 1.0))))
        seeds = np.arange(1, book.shape[1] + 1, dtype=np.uint64)
        self.odd = hashing.mix(seeds) | np.uint64(1)
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.corners = np.zeros((0, self.book.shape[1]), np.int64)
        self.counts = np.zeros(0, np.int64)
        self.begins = np.zeros(0, np.int64)
        self.lists = np.zeros(0, np.int64)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (ties: the lowest) and the squared distance."""
        index, distance = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        step = max(1, BLOCK // max(1, self.book.size))
        for begin in range(0, len(points), step):
            some = slice(begin, begin + step)
            index[some], distance[some] = self._block(points[some])
        return index, distance

    def _block(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        corners = np.floor_divide(points, self.width)
        keys = hashing.mix((corners.astype(np.uint64) * self.odd).sum(axis=1, dtype=np.uint64))
        place = self._places(keys, corners)
        counts = self.counts[place]
        ends = np.cumsum(counts)
        # The candidates of every point, one after the other, in ascending order.
        inside = np.arange(int(ends[-1])) - np.repeat(ends - counts, counts)
        entry = self.lists[np.repeat(self.begins[place], counts) + inside]
        off = np.repeat(points, counts, axis=0) - self.book[entry]
        distance = np.einsum("ij,ij->i", off, off)
        least = np.minimum.reduceat(distance, ends - counts)
        best = np.flatnonzero(distance == np.repeat(least, counts))
        owner = np.searchsorted(ends, best, side="right")
        _, first = np.unique(owner, return_index=True)
        return entry[best[first]], least

    def _places(self, keys: np.ndarray, corners: np.ndarray) -> np.ndarray:
        """Where the cells stand in the memory, which learns the new ones."""
        if len(self.keys) > CELLS or len(self.keys) != len(self.corners):
            self.forget()
        known = np.isin(keys, self.keys)
        if not known.all():
            new, first = np.unique(keys[~known], return_index=True)
            self._learn(new, corners[~known][first])
        at = np.searchsorted(self.keys, keys)
        if (self.corners[at] == corners).all():
            return at
        # Different cells of one hash: this block goes by its corners, and is forgotten.
        self.forget()
        cells, place = np.unique(corners, axis=0, return_inverse=True)
        self._learn(np.arange(len(cells), dtype=np.uint64), cells)
        self.keys = np.zeros(0, np.uint64)
        return place.ravel()

    def _learn(self, keys: np.ndarray, corners: np.ndarray) -> None:
        counts, lists = self._undominated(corners)
        begins = len(self.lists) + np.cumsum(counts) - counts
        order = np.argsort(np.concatenate([self.keys, keys]), kind="stable")
        self.lists = np.concatenate([self.lists, lists])
        self.keys = np.concatenate([self.keys, keys])[order]
        self.corners = np.concatenate([self.corners, corners])[order]
        self.counts = np.concatenate([self.counts, counts])[order]
        self.begins = np.concatenate([self.begins, begins])[order]

    def _undominated(self, corners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per cell the number of entries that no other dominates, and these.

        The ball around a box leaves out most entries at once; the rest is measured
        against the box itself. Rounding is allowed for, so no entry is lost to it.
        """
        half = (self.width - 1) / 2
        centre = corners * float(self.width) + half
        own = np.einsum("ij,ij->i", centre, centre)
        square = own[:, None] + self.squares - 2 * (centre @ self.floats.T)
        slack = (own.max(initial=0) + self.squares.max(initial=0)) * 2.0**-40
        radius = half * centre.shape[1] ** 0.5
        reach = np.sqrt(np.maximum(square.min(axis=1) + slack, 0)) + 2 * radius
        cell, entry = np.nonzero(square - slack <= (reach**2 * (1 + 1e-9))[:, None])
        off = np.abs(centre[cell] - self.floats[entry])
        near = np.maximum(off - half, 0)
        nearest = np.einsum("ij,ij->i", near, near)
        off += half
        farthest = np.einsum("ij,ij->i", off, off)
        starts = np.searchsorted(cell, np.arange(len(corners)))
        bound = np.minimum.reduceat(farthest, starts) * (1 + 1e-9)
        left = nearest <= bound[cell]
        return np.bincount(cell[left], minlength=len(corners)), entry[left]
