"""Language identification by prediction by partial matching.

Per language, a tree of byte contexts of length 0 to 3 holds frozen counts. A byte
that was seen ``c`` times after a context seen ``n`` times, with ``d`` different
bytes, costs ``-log2(c / (n + d))`` bits there; another byte costs the escape
``-log2(d / (n + d))`` and is looked up in the next shorter context, at last at 8
bits. A context that a language never saw costs nothing to leave. The language with
the shortest code for the whole text is predicted; the score is its share of the
probabilities of all languages.

The trees are learned from a sample of bounded size: of each language, whole texts in
the order of a hash of their id until :data:`SAMPLE_BYTES` are reached, one at least.
Bytes are counted in Spark. Languages are dealt to blocks, and one task a block lays the
counts out as sorted tables with the costs of the block's languages, which scoring tasks
search once per distinct four bytes of a text. There may be any number of languages; a
task's memory grows with the number of blocks, the work on a text with that of languages.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeledger.llm import hashing
from galeledger.llm.tables import materialise

#: Bytes of text per language that the trees are learned from: reached by whole texts, and
#: passed by a tenth and one text at most.
SAMPLE_BYTES = 2 << 20
#: Languages whose trees are laid out together.
BLOCK = 64
#: Languages up to which a table of them is sent to every task.
FEW_LANGUAGES = 100_000
#: Numbers in a matrix of costs.
_CELLS = 1 << 22
ORDER = 3
UNDECIDED = "und"
_FOLD = hashing._LOWER.copy()
_FOLD[hashing._SPACE] = 0x20


def held_out(doc_id: Column) -> Column:
    """Rows kept for testing: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict_languages(
    docs: DataFrame,
    sample_bytes: int = SAMPLE_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` per row of ``docs``.

    Learns from text and language of the rows that are not held out and have both. Null
    texts and texts without a letter are ``und`` with score 0, as is every text if no
    row has a language. Ties go to the first language in order. Equal texts get equal
    answers, repeated rows one each; a null id stays null and is not held out. An empty
    table gives an empty result. Other columns are ignored.
    """
    seen = docs.filter(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    )
    blocks = learn(seen, sample_bytes)
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        held_out(F.col(id_col)).alias("held_out"),
        text.alias("text"),
        text.rlike(r"\p{L}").alias("letters"),
    )
    shared = docs.sparkSession.sparkContext.broadcast([(t.langs, t.levels) for t in blocks])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Trees(*block) for block in shared.value]
        for part in hashing.slices(batches):
            names, score = predict(trees, part.column("text"))
            letters = np.asarray(part.column("letters").to_numpy(zero_copy_only=False), bool)
            names[~letters] = UNDECIDED
            score[~letters] = 0.0
            yield pa.record_batch(
                [part.column("doc_id"), part.column("held_out"), pa.array(names.tolist(), pa.string()), pa.array(score)],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return plain.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def sample(seen: DataFrame, sample_bytes: int) -> DataFrame:
    """``(text, lang)`` of the texts to learn from.

    Texts are ordered by a hash of their id, in steps that are each a tenth longer; the
    first steps of a language that hold the wanted bytes are taken whole.
    """
    chance = (F.xxhash64("doc_id").bitwiseAND((1 << 53) - 1) + 1) / float(1 << 53)
    keyed = seen.filter("octet_length(text) > 0").select(
        "text", "lang", F.floor(-8 * F.log2(chance)).cast("int").alias("step")
    )
    steps = keyed.groupBy("lang", "step").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    before = Window.partitionBy("lang").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    needed = steps.withColumn("before", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    last = needed.filter(F.col("before") < sample_bytes).groupBy("lang").agg(F.min("step").alias("last"))
    last = materialise(last, "language-steps")
    # A row a language, of which so many are known to fit; then the texts stay in place.
    last = F.broadcast(last) if last.count() <= FEW_LANGUAGES else last
    return keyed.join(last, "lang").filter("step >= last").select("text", "lang")


def learn(seen: DataFrame, sample_bytes: int = SAMPLE_BYTES, block: int = BLOCK) -> list[Trees]:
    """Trees of all languages of ``(doc_id, text, lang)``, some languages together; the
    languages ascend. The driver gets the finished trees, one row a block."""
    chosen = sample(seen, sample_bytes)
    counts = (
        chosen.mapInArrow(_count, "lang string, length int, gram long, n long")
        .groupBy("lang", "length", "gram")
        .agg(F.sum("n").alias("n"))
    )
    counts = materialise(counts, "language-grams")
    langs = [r["lang"] for r in counts.select("lang").distinct().orderBy("lang").collect()]
    if not langs:
        return []
    names = counts.sparkSession.createDataFrame(
        [(lang, i // block, i % block) for i, lang in enumerate(langs)], "lang string, block int, number int"
    )
    made = (
        counts.join(names, "lang")
        .select("block", "number", "length", "gram", "n")
        .groupBy("block")
        .applyInArrow(lambda t: _lay_out(t, langs, block), "block int, trees binary")
    )
    return [Trees(*pickle.loads(r["trees"])) for r in made.orderBy("block").collect()]


def _lay_out(counts: pa.Table, langs: list[str], block: int) -> pa.Table:
    of = counts["block"][0].as_py()
    trees = Trees.build(langs[of * block : (of + 1) * block], counts)
    raw = pickle.dumps((trees.langs, trees.levels), protocol=5)
    return pa.table({"block": pa.array([of], pa.int32()), "trees": pa.array([raw], pa.binary())})


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The last four bytes at every position of the texts (spaces before a text), and
    the offsets of the texts."""
    data, offsets = hashing.text_bytes(texts)
    data = _FOLD[data].astype(np.uint32)
    code = data.copy()
    for back in range(1, ORDER + 1):
        before = np.full(len(data), 0x20, np.uint32)
        before[back:] = data[:-back]
        for step in range(back):
            at = offsets[:-1] + step
            before[at[at < offsets[1:]]] = 0x20
        code |= before << np.uint32(8 * back)
    return code, offsets


def _per_text(code: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, code and number of each distinct code of each text."""
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
    key = np.sort((text << np.uint64(32)) | code)
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    count = np.diff(np.append(at, len(key)))
    return (key[at] >> np.uint64(32)).astype(np.int64), (key[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32), count


def _suffix(code: np.ndarray, length: int) -> np.ndarray:
    """The last ``length`` bytes of codes."""
    return code & np.uint32((1 << (8 * length)) - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in hashing.slices(batches):
        code, offsets = _grams(part.column("text"))
        names = part.column("lang").dictionary_encode()
        own = np.asarray(names.indices, np.uint64)
        lang = np.repeat(own, np.diff(offsets))
        for length in range(1, ORDER + 2):
            found, n = np.unique((lang << np.uint64(32)) | _suffix(code, length), return_counts=True)
            yield pa.record_batch(
                [
                    names.dictionary.take(pa.array((found >> np.uint64(32)).astype(np.int64))),
                    pa.array(np.full(len(found), length, np.int32)),
                    pa.array((found & np.uint64(0xFFFFFFFF)).astype(np.int64)),
                    pa.array(n.astype(np.int64)),
                ],
                ["lang", "length", "gram", "n"],
            )


class Trees:
    """Frozen costs in bits. ``levels[k]``: grams of ``k + 1`` bytes, sorted, with a row
    of costs per gram; contexts of ``k`` bytes with a row of escape costs."""

    def __init__(self, langs: list[str], levels: list[tuple]):
        self.langs, self.levels = langs, levels

    @classmethod
    def build(cls, langs: list[str], counts: pa.Table) -> Trees:
        """From rows ``(number, length, gram, n)``: language, and count of a gram in it."""
        trees = cls(langs, [])
        every = {c: counts[c].to_numpy() for c in ("number", "length", "gram", "n")}
        for length in range(1, ORDER + 2):
            number, gram, times = (every[c][every["length"] == length] for c in ("number", "gram", "n"))
            grams, at = np.unique(gram.astype(np.uint32), return_inverse=True)
            n = np.zeros((len(grams), len(langs)))
            n[at, number] = times
            contexts, of = np.unique(grams >> np.uint32(8), return_inverse=True)
            total, kinds = np.zeros((2, len(contexts), len(langs)))
            np.add.at(total, of, n)
            np.add.at(kinds, of, n > 0)
            # The gram of a context's own last byte is its predecessor's; length 1 has one context.
            escape = np.zeros_like(total)
            np.divide(kinds, total + kinds, out=escape, where=total > 0)
            escape = np.where(total > 0, -np.log2(np.where(escape > 0, escape, 1)), 0.0)
            lower = trees._cost(_suffix(grams, length - 1), length - 1)
            here = (total + kinds)[of]
            cost = np.where(n > 0, -np.log2(np.where(n > 0, n, 1) / np.where(here > 0, here, 1)), escape[of] + lower)
            trees.levels.append((grams, cost.astype(np.float32), contexts, escape.astype(np.float32)))
        return trees

    def _cost(self, code: np.ndarray, length: int) -> np.ndarray:
        """Costs of the last byte of each gram of ``length`` bytes after the others."""
        if not length:
            return np.full((len(code), len(self.langs)), 8.0, np.float32)
        grams, costs, contexts, escapes = self.levels[length - 1]
        at = np.minimum(np.searchsorted(grams, code), len(grams) - 1)
        out = costs[at]
        missing = np.flatnonzero(grams[at] != code)
        if len(missing):
            rest = code[missing]
            context = rest >> np.uint32(8)
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            left = np.where((contexts[at] == context)[:, None], escapes[at], np.float32(0))
            out[missing] = left + self._cost(_suffix(rest, length - 1), length - 1)
        return out

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Code length in bits of each text in each language."""
        code, offsets = _grams(texts)
        text, distinct, count = _per_text(code, offsets)
        total = np.zeros((len(texts), len(self.langs)))
        step = max(1, _CELLS // len(self.langs))
        for begin in range(0, len(distinct), step):
            some = slice(begin, begin + step)
            own = text[some]
            cost = self._cost(distinct[some], ORDER + 1).astype(np.float64) * count[some, None]
            heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            total[own[heads]] += np.add.reduceat(cost, heads, axis=0)
        return total


def predict(blocks: list[Trees], texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The language with the shortest code for each text, and its share."""
    langs = [lang for trees in blocks for lang in trees.langs]
    if not langs:
        return np.full(len(texts), UNDECIDED, object), np.zeros(len(texts))
    bits = np.concatenate([trees.lengths(texts) for trees in blocks], axis=1)
    best = bits.argmin(axis=1)
    share = np.exp2(-(bits - bits.min(axis=1, keepdims=True))).sum(axis=1)
    return np.array(langs, object)[best], 1.0 / share
