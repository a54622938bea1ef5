"""Matching articles against gazetteer tables of any size.

A table is first brought to one form by one rule. A form that an aggregate has
measured to be small becomes a literal list, and matching is a narrow per-row
expression; a larger one is joined on exact keys, so neither side is broadcast on
faith and no article x place pairs are formed. Both give the same rows. Texts are
identified by their digest: copies of a text collapse before they are regrouped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeledger.functions.columns import constant, let, once, strings
from galeledger.functions.events import first_of, locations, place_names
from galeledger.functions.text import likely_names, name_marks, name_tokens
from galeledger.operators.filters import hash_filter, key_filter
from galeledger.operators.joins import per_key
from galeledger.session import materialise
from galeledger.vocab import LOCATION_STOPWORDS, Place

#: A table of at most so many rows and characters becomes a literal list.
SMALL_ROWS = 1000
SMALL_CHARS = 50_000
#: Characters of the piece that stands for a stem.
PIECE = 4
MENTION = "array<struct<name:string,type:string,confidence:double>>"
_LAST = (1 << 63) - 1


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _keyed(articles: DataFrame, text: str) -> DataFrame:
    """``(text_key, text)``, hashed before a generator multiplies the rows."""
    texts = articles.select(F.col(text).alias("text")).filter("text IS NOT NULL")
    return texts.select(once(text_key(F.col("text")), "text_key"), "text")


def small_rows(table: DataFrame, limit: int, chars_limit: int = SMALL_CHARS) -> list | None:
    """All rows of a table measured to be small, else nothing."""
    kinds = dict(table.dtypes)
    chars = sum((F.coalesce(F.length(c), F.lit(0)) for c in table.columns if kinds[c] == "string"), F.lit(0))
    size = table.agg(F.count(F.lit(1)).alias("n"), F.sum(chars).alias("chars")).first()
    if size["n"] > limit or (size["chars"] or 0) > chars_limit:
        return None
    return table.collect()


# --- substring gazetteers -----------------------------------------------------


def clean_stems(gazetteer: DataFrame) -> DataFrame:
    """Rows that can match: a name and a stem that is not empty, in lower case. Rows
    without an order come last."""
    return gazetteer.select(
        F.coalesce(F.col("ord").cast("long"), F.lit(_LAST)).alias("ord"),
        "name", "type", "confidence", F.lower("stem").alias("stem"),
    ).filter("name IS NOT NULL AND stem IS NOT NULL AND stem != ''")


def _pieces(low: Column, size: int) -> Column:
    """Distinct pieces of ``size`` characters of a text, cut in one pass."""
    return F.array_distinct(F.regexp_extract_all(low, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def keyed_stems(stems: DataFrame, size: int = PIECE) -> DataFrame:
    """Clean stems with ``piece``, the piece of ``size`` characters that fewest stems
    share (ties: the least); a shorter stem is its own piece. One row per stem."""
    whole = F.struct("ord", "name", "type", "confidence", "stem")
    cut = F.when(F.length("stem") < size, F.array("stem")).otherwise(_pieces(F.col("stem"), size))
    pieces = stems.distinct().select(whole.alias("place"), F.explode(cut).alias("piece"))
    counts = per_key(pieces, "piece").agg(F.count(F.lit(1)).alias("n")).select("key.*", "n")
    rarest = pieces.join(counts, "piece").groupBy("place").agg(F.min(F.struct("n", "piece")).alias("least"))
    return rarest.select("place", "least.piece")


def stem_candidates(articles: DataFrame, stems: DataFrame, text: str = "text", size: int = PIECE) -> DataFrame:
    """``(text_key, places)``: per text the places whose rarest piece it has.

    A text gives its distinct pieces of one size, and of the shorter sizes that stems have,
    however many lengths stems have; of these only the ones that a filter of the pieces
    in use lets through are shuffled. At most ``size`` numbers and a filter of bounded size
    come to the driver.
    """
    keyed = materialise(keyed_stems(stems, size), "stems")
    sizes = [r["n"] for r in keyed.select(F.length("piece").alias("n")).distinct().collect()]
    known = key_filter(keyed.select("piece").distinct(), "piece")
    pieces = let(F.lower("text"), lambda low: F.concat(strings(), *[_pieces(low, n) for n in sorted(sizes)]))
    found = _keyed(articles, text).select("text_key", F.explode(F.filter(pieces, known)).alias("piece"))
    grouped = per_key(found.join(keyed, "piece"), "text_key").agg(F.collect_set("place").alias("places"))
    return grouped.select("key.*", "places")


def _mentions(low: Column, places: Column) -> Column:
    """The places whose stem the text contains, in gazetteer order, each name once."""
    found = F.array_sort(F.filter(places, lambda p: F.contains(low, p["stem"])))
    return F.transform(
        first_of("name", found),
        lambda p: F.struct(p["name"].alias("name"), p["type"].alias("type"), p["confidence"].alias("confidence")),
    )


def with_locations(
    articles: DataFrame,
    gazetteer: DataFrame,
    text: str = "text",
    name: str = "locations",
    small: int = SMALL_ROWS,
) -> DataFrame:
    """Add the places of a gazetteer table whose stem occurs in the text.

    ``gazetteer`` has ``(ord, name, type, confidence, stem)``; mentions come in
    ``ord`` order. Rows without a name or a stem match nothing. For a large gazetteer
    the articles themselves are shuffled once, so drop columns that are not needed
    first.
    """
    stems = clean_stems(gazetteer)
    rows = small_rows(stems, small)
    if rows is not None:
        order = lambda r: [(v is not None, v) for v in (r["ord"], r["name"], r["type"], r["confidence"])]
        places = [
            Place(r["name"], r["type"], r["confidence"], (r["stem"],))
            for r in sorted(rows, key=order)
        ]
        return articles.select("*", once(locations(text, tuple(places)), name))
    found = stem_candidates(articles, stems, text)
    keyed = articles.select("*", once(text_key(F.col(text)), "text_key"))
    mentions = let(F.lower(text), lambda low: _mentions(low, F.col("places")))
    return (
        keyed.join(found, "text_key", "left")
        .withColumn(name, F.when(F.col("places").isNotNull(), mentions).otherwise(constant([], MENTION)))
        .drop("text_key", "places")
    )


# --- whole names ----------------------------------------------------------------


def clean_names(names: DataFrame, stopwords: Sequence[str] = LOCATION_STOPWORDS) -> DataFrame:
    """``(key, words, name)`` of the names that can match: cut into words as texts
    are, of any length, without stopwords. Names that differ only between their words
    are one, reported as the first of them in order."""
    allowed = names.filter(~F.lower("name").isin([w.lower() for w in stopwords]))
    tokens = allowed.select("name", name_tokens(F.col("name")).alias("tokens")).filter("size(tokens) > 0")
    return per_key(
        tokens.select(F.array_join("tokens", " ").alias("key"), F.size("tokens").alias("words"), "name"),
        "key", "words",
    ).agg(F.min("name").alias("name")).select("key.*", "name")


def name_hits(articles: DataFrame, listed: DataFrame, text: str = "text") -> DataFrame:
    """``(text_key, found)``: the listed names in a text, by position.

    Runs of words are formed only where a word stands that is a name or, with the next
    word, begins one, and only those that a filter of all names lets through are
    shuffled; the filters are of bounded size. One number per different length comes to the
    driver. Both sides of the join are distinct per text and name, so a frequent name makes
    only the article side hot, which adaptive execution splits; copies of a text merge
    map-side.
    """
    lengths = [r["words"] for r in listed.select("words").distinct().collect()]
    first, second = (F.xxhash64(F.get(F.split("key", " "), n)) for n in (0, 1))
    longer = listed.filter("words > 1").select(first.alias("first"), second.alias("second"))
    pairs = longer.select(F.xxhash64("first", "second").alias("hash")).distinct()
    known, pair = key_filter(listed, "key"), hash_filter(pairs, "hash")
    marks = name_marks(
        lambda token: F.xxhash64(token),
        hash_filter(listed.filter("words = 1").select(F.xxhash64("key").alias("hash")), "hash"),
        hash_filter(longer.select("first").distinct(), "first"),
        lambda one, two: pair(F.xxhash64(one, two)),
    )
    runs = likely_names(F.col("text"), lengths, lambda token: F.lit(True), known, marks)
    keys = _keyed(articles, text).select("text_key", F.posexplode(runs).alias("at", "key"))
    found = per_key(keys.join(listed.select("key", "name"), "key"), "text_key")
    return found.agg(F.collect_set(F.struct("at", "name")).alias("found")).select(
        "key.*", F.transform(F.array_sort("found"), lambda f: f["name"]).alias("found")
    )


def with_other_names(
    articles: DataFrame,
    names: DataFrame,
    stopwords: Sequence[str] = LOCATION_STOPWORDS,
    text: str = "text",
    name: str = "other_names",
    small: int = SMALL_ROWS,
    small_chars: int = SMALL_CHARS,
) -> DataFrame:
    """Add the ``array<string>`` of listed names in the text, by position.

    The column is what :func:`galeledger.functions.events.locations` takes as
    ``others``. ``names`` has a ``name`` column; names may have any number of words,
    and what stands between the words does not matter. Names without a word and
    stopwords match nothing.
    """
    listed = clean_names(names, stopwords)
    rows = small_rows(listed, small, small_chars)
    if rows is not None:
        short = tuple((r["key"], r["name"]) for r in rows)
        return articles.select("*", once(place_names(F.col(text), short), name))
    found = name_hits(articles, materialise(listed, "names"), text)
    keyed = articles.select("*", once(text_key(F.col(text)), "text_key"))
    return (
        keyed.join(found, "text_key", "left")
        .withColumn(name, F.coalesce("found", strings()))
        .drop("text_key", "found")
    )
