"""License scans by canonical digests.

A text is brought to a canonical form: copyright notices at the start of lines left out,
lower case, equivalent spellings replaced, and everything but letters and digits turned
to single spaces. The digest of the form is looked up among the digests of known licences
by a hash join; so are the digests of single lines, which finds notices inside longer
texts. Only DataFrame operations are used.

A notice is a mark with a year or a second mark, and the rest of its line up to a phrase
of a licence; or a line of the word "Copyright" and a holder alone, whose words are names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeledger.llm.license_forms import forms

# Licence texts and notices, as published.
_SHORT = {
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above copyright notice
and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO
THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of
this software and associated documentation files (the "Software"), to deal in the
Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to the following
conditions:

The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE.""",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-notice": "Released under the MIT License.",
}
#: These and the whole texts of ``license_texts``, each in the forms it is found in.
LICENSES = forms(_SHORT)
#: Spellings that count as one, as whole words of the canonical form.
SPELLINGS = {
    "licence": "license",
    "licenced": "licensed",
    "sublicence": "sublicense",
    "https": "http",
    "organisation": "organization",
    "whilst": "while",
    "authorised": "authorized",
    "non commercial": "noncommercial",
    "ver": "version",
    "v": "version",
}
#: Phrases of a licence that may follow a notice on its line.
PHRASES = (
    "licensed under", "licenced under", "released under", "distributed under", "made available under", "permission is",
    "permission to", "redistribution and use", "this program is", "this software is", "this library is", "this file is",
    "this work is", "everyone is permitted", "subject to the terms", "use of this source", "spdx license identifier",
    "spdx-license-identifier",
)
#: Words without a capital that a holder's name may have.
NAME_WORDS = (
    "and", "or", "of", "the", "by", "for", "other", "others", "its", "their", "contributors", "authors", "developers",
    "team", "rights", "reserved", "all", "de", "van", "von", "et", "al",
)
_START = r"^[^\p{L}\p{N}]*"
_YEAR = r"(?:(?:19|20)\d\d|[<\[{](?:yyyy|year))"
_MARKED = rf"(?i){_START}(?:(?:copyright|©)[ \t:]*(?:\(c\)|©)|(?:copyright|©|\(c\))[ \t:]*{_YEAR})"
_UP_TO_PHRASE = rf"[^\n]*?((?:{'|'.join(PHRASES)})|$)"
#: In capitals the word also stands in disclaimers.
_HOLDER = rf"{_START}Copyright[ \t\r]+[^\p{{L}}\p{{N}}]*[\p{{Lu}}\p{{N}}]"
_NAME = rf"^[^\p{{L}}\p{{N}}]*(?:[\p{{Lu}}\p{{N}}].*|(?:{'|'.join(NAME_WORDS)})[^\p{{L}}\p{{N}}]*)?$"


def without_notice(line: Column) -> Column:
    """A line without its copyright notice."""

    def plain(line: Column) -> Column:
        words = F.slice(F.split(F.regexp_replace(line, r"^[^\p{L}\p{N}]+", ""), r"[ \t\r]+"), 2, 1 << 30)
        names = F.forall(words, lambda w: w.rlike(_NAME))
        return (
            F.when(line.rlike(_MARKED), F.regexp_replace(line, _MARKED + _UP_TO_PHRASE, " $1"))
            .when(line.rlike(_HOLDER) & names, F.lit(" "))
            .otherwise(line)
        )

    # Most lines have no mark at all.
    return F.when(line.rlike(r"(?i)copyright|©|\(c\)"), plain(line)).otherwise(line)


def _canonical(form: Column) -> Column:
    form = F.regexp_replace(F.lower(form), r"[^\p{L}\p{N}]+", " ")
    form = F.concat(F.lit(" "), F.trim(form), F.lit(" "))
    for other, usual in SPELLINGS.items():
        form = F.replace(form, F.lit(f" {other} "), F.lit(f" {usual} "))
    return F.trim(form)


def canonical(text: Column) -> Column:
    """Canonical form of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.transform(F.split(text, "\n"), without_notice)
    marked = text.rlike(r"(?i)copyright|©|\(c\)")
    return _canonical(F.when(marked, F.array_join(lines, "\n")).otherwise(text))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licenses(spark, licenses: dict[str, str] | None = None) -> DataFrame:
    """``(license, text)`` of the built-in licences or of others."""
    return spark.createDataFrame(list((licenses or LICENSES).items()), "license string, text string")


def scan(
    docs: DataFrame, licenses: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, digest, license, notices)`` per row of ``docs``.

    ``license`` is the licence (the first in order, if several have one form) whose
    canonical text is the whole text's, else null; ``notices`` lists the licences whose
    canonical text is that of a line, in order. Texts and lines without a letter or
    digit match nothing. ``licenses`` has ``license`` and ``text``; rows without either
    don't count. Equal rows of ``docs`` give equal rows.
    """
    known = (
        licenses.filter("license IS NOT NULL AND text IS NOT NULL")
        .select("license", canonical(F.col("text")).alias("form"))
        .filter("form != ''")
        .groupBy(F.sha2("form", 256).alias("known"))
        .agg(F.min("license").alias("license"))
    )
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = keyed.select(
        F.xxhash64("doc_id").alias("h"), "doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")
    )
    found = (
        lines.withColumn("known", digest(F.col("line")))
        .join(known, "known")
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_set("license")).alias("notices"))
    )
    whole = keyed.select("doc_id", digest(F.col("text")).alias("digest"))
    named = whole.join(known, whole["digest"] == known["known"], "left").drop("known")
    same = named["doc_id"].eqNullSafe(found["doc_id"])
    return named.join(found, same, "left").select(
        named["doc_id"], "digest", "license", F.coalesce("notices", F.array().cast("array<string>")).alias("notices")
    )
