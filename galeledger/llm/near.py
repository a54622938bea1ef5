"""Classes of near-duplicate texts from banded signatures, verified exactly.

Copies (texts with the same shingles) are one node. Nodes that share a band are
candidates; two nodes are linked if the exact Jaccard similarity of their shingle
sets reaches the threshold, and a class is a connected component of links.

No pairs of a whole group are made. The members of a band are compared with its hub,
those that fail once more with a hub of their own, so a group of copies costs one or
two pairs per member. That joins most of what belongs together. Of the other pairs
in a band only those of different components can matter, and of them only those
that can be similar after what both have in common with the hub; these are found by
what they share outside the hub, between components whose sizes allow a similar pair,
and compared too. So no link between components is lost. Labels, pairs and shingles are
tables throughout.

Elements are compared by 32-bit hashes: of two texts of n different elements each, some
two are taken for equal with a chance of about n * n / 2^32.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galeledger.llm import hashing
from galeledger.llm.tables import ascending, documents, materialise, packed

#: Texts and number of shingles per word window to bands: one row of hashes per text.
Bands = Callable[[np.ndarray, np.ndarray], np.ndarray]

SIMILARITY = 0.8
SHINGLE_WORDS = 5


def near_classes(
    docs: DataFrame,
    bands: Bands,
    threshold: float = SIMILARITY,
    words: int = SHINGLE_WORDS,
    counted: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, class_id)`` per row of ``docs``; the class id is the smallest id in
    the class.

    With ``counted`` the k-th occurrence of a shingle is an element of its own, which
    makes the similarity the weighted Jaccard similarity of the counts. Texts of fewer
    words than a shingle have one shingle of all their words; texts without words are
    alike only if they are equal, null counting as empty. A null id is the greatest.
    """
    named = _components(docs, bands, threshold, words, counted, id_col, text_col)
    least = named.groupBy(F.struct("component").alias("key")).agg(F.min("doc_id").alias("class_id"))
    return named.join(least.select("key.component", "class_id"), "component").select(
        "doc_id", "class_id"
    )


def keep_one(
    docs: DataFrame,
    bands: Bands,
    threshold: float = SIMILARITY,
    words: int = SHINGLE_WORDS,
    counted: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their class, with all columns; of
    rows that have it and the same shingles, one stays."""
    named = _components(docs, bands, threshold, words, counted, id_col, text_col)
    least = named.groupBy("component").agg(F.min(F.struct("doc_id", "tid")).alias("kept"))
    kept = least.select("kept.doc_id", "kept.tid").toDF("__id", "__tid")
    keyed = docs.select(
        packed(docs),
        ascending(F.col(id_col)).alias("__id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    schema = T.StructType([*keyed.schema.fields[:2], T.StructField("__tid", T.BinaryType())])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in hashing.slices(batches):
            texts = part.column("text")
            tids = pa.array(_tids(texts, *hashing.shingles(texts, words), counted), pa.binary())
            yield part.select(["row", "__id"]).append_column("__tid", tids)

    return (
        keyed.mapInArrow(name, schema)
        .join(kept, ["__id", "__tid"], "left_semi")
        .dropDuplicates(["__id", "__tid"])
        .select("row.*")
    )


def _components(docs, bands, threshold, words, counted, id_col, text_col) -> DataFrame:
    """``(doc_id, tid, component)`` of every row."""
    plain = documents(docs, id_col=id_col, text_col=text_col)
    signed = materialise(
        plain.mapInArrow(
            lambda it: _sign(it, bands, words, counted),
            "doc_id long, tid binary, bands array<long>",
        ),
        "signatures",
    )
    nodes = signed.groupBy("tid").agg(
        F.min("doc_id").alias("doc_id"), F.min_by("bands", "doc_id").alias("bands")
    )
    entries = nodes.select("tid", "doc_id", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialise(entries.join(shared, "bucket"), "buckets")
    # Merged, not broadcast, at every size: the candidates grow with the input.
    wanted = members.select("doc_id").distinct().hint("merge")
    grams = materialise(
        plain.join(wanted, "doc_id", "left_semi").mapInArrow(
            lambda it: _grams(it, words, counted), "tid binary, grams array<int>"
        ),
        "shingles",
    )
    placed = materialise(_with_hub(members), "hubs")
    one = materialise(_compared(_pairs(placed), grams), "compared")
    failed = one.filter(~_similar(threshold)).select(F.col("a").alias("tid"), F.col("b").alias("hub"))
    again = placed.filter("tid != hub").join(failed, ["tid", "hub"], "left_semi")
    two = materialise(_compared(_pairs(_with_hub(again.drop("hub"))), grams), "compared")
    links = _linked(one, threshold).unionByName(_linked(two, threshold))
    labels = _merge(placed.select("tid", F.col("tid").alias("component")).distinct(), links)
    rest = materialise(_compared(_unlinked(one, labels, threshold), grams), "compared")
    labels = _merge(labels, _linked(rest, threshold))
    return signed.join(labels, "tid", "left").select(
        "doc_id", "tid", F.coalesce("component", "tid").alias("component")
    )


def _elements(x: np.ndarray, begins: np.ndarray, counted: bool) -> list[np.ndarray]:
    """The sorted distinct 32-bit elements of each text."""
    out = []
    for a, b in zip(begins[:-1], begins[1:]):
        own = np.sort(x[a:b])
        new = np.ones(len(own), bool)
        new[1:] = own[1:] != own[:-1]
        if counted and not new.all():
            first = np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
            own = hashing.mix(own + (np.arange(len(own)) - first).astype(np.uint64) * _STEP)
        else:
            own = hashing.mix(own[new])
        out.append(np.unique((own >> np.uint64(32)).astype(np.uint32)))
    return out


_STEP = np.uint64(0xA24BAED4963EE407)


def _tids(texts: pa.Array, x: np.ndarray, begins: np.ndarray, counted: bool) -> list[bytes]:
    """16-byte name of each text: of its shingles, or of the text if it has none."""
    out = []
    for row, (a, b) in enumerate(zip(begins[:-1], begins[1:])):
        if a == b:
            data, offsets = hashing.text_bytes(texts.slice(row, 1))
            whole = hashing.hash_spans(data, offsets[:1], offsets[1:])
            out.append(np.concatenate([whole, hashing.mix(whole, 5)]).tobytes())
        else:
            own = x[a:b] if counted else np.unique(x[a:b])
            out.append(
                np.array([hashing.mix(own, 3).sum(), hashing.mix(own, 4).sum()]).tobytes()
            )
    return out


def _sign(
    batches: Iterator[pa.RecordBatch], bands: Bands, words: int, counted: bool
) -> Iterator[pa.RecordBatch]:
    for part in hashing.slices(batches):
        texts = part.column("text")
        x, begins = hashing.shingles(texts, words)
        found = bands(x, begins)
        full = np.diff(begins) > 0
        lengths = np.where(full, found.shape[1], 0)
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)),
            pa.array(found[full].ravel().view(np.int64)),
        )
        tids = pa.array(_tids(texts, x, begins, counted), pa.binary())
        yield pa.record_batch([part.column("doc_id"), tids, lists], ["doc_id", "tid", "bands"])


def _grams(
    batches: Iterator[pa.RecordBatch], words: int, counted: bool
) -> Iterator[pa.RecordBatch]:
    for part in hashing.slices(batches):
        texts = part.column("text")
        x, begins = hashing.shingles(texts, words)
        tids = pa.array(_tids(texts, x, begins, counted), pa.binary())
        found = [e.view(np.int32) for e in _elements(x, begins, counted)]
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        flat = np.concatenate(found) if found else np.zeros(0, np.int32)
        grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
        yield pa.record_batch([tids, grams], ["tid", "grams"])


def _with_hub(members: DataFrame) -> DataFrame:
    """``(bucket, tid, n, hub)``: each member with the hub of its bucket, the member with
    the most company in its buckets, which for a group of copies is one that was changed
    least."""
    members = members.select("bucket", "tid", "n")
    company = members.groupBy("tid").agg(F.sum("n").alias("company"))
    hubs = (
        members.join(company, "tid")
        .groupBy(F.struct("bucket").alias("key"))
        .agg(F.max(F.struct("company", "tid")).alias("top"))
        .select("key.bucket", F.col("top.tid").alias("hub"))
    )
    return members.join(hubs, "bucket")


def _pairs(placed: DataFrame) -> DataFrame:
    """Every member of a bucket with the bucket's hub."""
    pairs = placed.select(F.col("tid").alias("a"), F.col("hub").alias("b"))
    return pairs.filter("a != b").distinct()


def _compared(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """``pairs`` with the sizes of both sets, of what they share, and what only ``a`` has."""
    one = grams.select(F.col("tid").alias("a"), F.col("grams").alias("one"))
    two = grams.select(F.col("tid").alias("b"), F.col("grams").alias("two"))
    added = F.array_except("one", "two")
    return (
        pairs.join(one, "a")
        .join(two, "b")
        .select("a", "b", F.size("one").alias("size_a"), F.size("two").alias("size_b"), added.alias("added"))
        .withColumn("same", F.col("size_a") - F.size("added"))
    )


def _similar(threshold: float) -> Column:
    """Exact similarity of at least the threshold."""
    either = F.col("size_a") + F.col("size_b") - F.col("same")
    return F.col("same") / either >= threshold


def _linked(compared: DataFrame, threshold: float) -> DataFrame:
    return compared.filter(_similar(threshold)).select("a", "b")


def _unlinked(compared: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """All pairs of different components around one hub that can be similar.

    Let ``s`` fail with hub ``c``. What ``s`` and ``x`` share is what they share outside
    ``c``, plus at most the lesser of what each shares with ``c``; to be similar it must
    reach ``t / (1 + t)`` of the sum of their sizes. So either ``x`` is so much shorter
    than ``c`` that what ``s`` shares with ``c`` is enough (where no ``x`` of the hub is as
    short as that, nothing is joined), or both must share at least some number of
    elements outside ``c``. Then, with the elements of a hub in order from rare to
    frequent, they share one among their first ones: all but that number less one.
    Elements that the same texts have are joined as one.
    """
    need = threshold / (1 + threshold)
    slack = 1e-6
    around = materialise(
        compared.join(labels.toDF("a", "component"), "a").select(
            "b", "a", "component", F.col("size_a").alias("size"), "same",
            (~_similar(threshold)).alias("failed"), "added",
        ),
        "around",
    )
    shortest = around.groupBy("b").agg(F.min("size").alias("shortest"))
    apart = F.col("component") != F.col("x_component")

    least = F.greatest(F.col("shortest"), threshold * F.col("size"))
    outside = F.greatest(F.lit(1), F.ceil(need * (F.col("size") + least) - F.col("same") - slack))
    rows = (
        around.join(shortest, "b")
        .withColumn("first", F.size("added") - outside + 1)
        .filter("first > 0")
        .select("b", "a", "component", "failed", "size", "first", F.explode("added").alias("element"))
    )
    kinds = rows.groupBy("b", "element").agg(
        F.count(F.lit(1)).alias("texts"), F.bit_xor(F.xxhash64("a")).alias("kind")
    )
    before = Window.partitionBy("b", "a").orderBy("texts", "kind").rowsBetween(Window.unboundedPreceding, -1)
    first = materialise(
        rows.join(kinds, ["b", "element"])
        .groupBy("b", "a", "component", "failed", "size", "first", "texts", "kind")
        .agg(F.count(F.lit(1)).alias("weight"))
        .withColumn("before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .filter("texts > 1 AND before < first")
        .select("b", "texts", "kind", "a", "component", "failed", "size"),
        "places",
    )
    place = ["b", "texts", "kind"]
    alike = lambda one, two: F.least(one, two) >= threshold * F.greatest(one, two) - slack
    # Components that meet in a place; those of quite different sizes have no similar pair.
    parts = first.groupBy(*place, "component").agg(
        F.min("size").alias("low"), F.max("size").alias("high"), F.max("failed").alias("any")
    )
    failures = parts.filter("any").select(
        *place, F.col("component").alias("x_component"), F.col("low").alias("x_low"), F.col("high").alias("x_high")
    )
    near = (F.col("high") >= threshold * F.col("x_low") - slack) & (F.col("x_high") >= threshold * F.col("low") - slack)
    meeting = parts.join(failures, place).filter(apart & near).select(*place, "component", "x_component")
    through = (
        first.select(*place, F.col("a").alias("x"), "component", F.col("size").alias("x_size"))
        .join(meeting, [*place, "component"])
        .join(
            first.filter("failed").select(*place, F.col("a").alias("s"), F.col("component").alias("x_component"), "size"),
            [*place, "x_component"],
        )
        .filter(alike("size", "x_size"))
        .select("s", "x")
    )

    other = around.select(
        "b", F.col("a").alias("x"), F.col("component").alias("x_component"), F.col("size").alias("x_size")
    )
    reach = F.col("same") / need - F.col("size") + slack
    short = (
        around.filter("failed").drop("added")
        .join(shortest, "b")
        .filter(reach >= F.col("shortest"))
        .join(other, "b")
        .filter(apart & (F.col("x_size") <= reach) & (F.col("x_size") >= threshold * F.col("size") - slack))
        .select(F.col("a").alias("s"), "x")
    )
    both = through.unionByName(short)
    return both.select(F.least("s", "x").alias("a"), F.greatest("s", "x").alias("b")).distinct()


def _merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels with linked components joined: the smallest name of a component spreads
    along links, halving the way at every step, until nothing changes."""
    if links.isEmpty():
        return labels
    of = labels.select("tid", "component")
    edges = (
        links.join(of.toDF("a", "x"), "a")
        .join(of.toDF("b", "y"), "b")
        .filter("x != y")
        .select("x", "y")
    )
    edges = materialise(
        edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(),
        "edges",
    )
    names = materialise(
        edges.groupBy(F.col("x").alias("name")).agg(F.min("y").alias("root")).select(
            "name", F.least("name", "root").alias("root")
        ),
        "names",
    )
    while True:
        own = names.select("name", "root", F.col("root").alias("before"))
        seen = edges.join(names.toDF("y", "root"), "y").select(
            F.col("x").alias("name"), "root", F.lit(None).cast("binary").alias("before")
        )
        lower = own.unionByName(seen).groupBy("name").agg(
            F.min("root").alias("root"), F.max("before").alias("before")
        )
        above = lower.select(F.col("name").alias("root"), F.col("root").alias("top"))
        names = materialise(
            lower.join(above, "root").select("name", F.least("root", "top").alias("root"), "before"),
            "names",
        )
        settled = names.filter("root != before").isEmpty()
        names = names.drop("before")
        if settled:
            break
    renamed = labels.join(names.toDF("component", "root"), "component", "left")
    return materialise(
        renamed.select("tid", F.coalesce("root", "component").alias("component")), "labels"
    )
