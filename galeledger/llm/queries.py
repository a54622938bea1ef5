"""The registered queries of this package, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeledger.llm import (
    dart_minhash,
    decontaminate,
    html_extraction,
    language_id,
    licenses,
    minhash,
    mixing,
    quality,
    resample,
    substring_dedup,
    token_counts,
    token_files,
    vector_codes,
)
from galeledger.session import scratch_path


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left after removing 50-word windows of documents with smaller ids."""
    kept = substring_dedup.remove_repeats(_documents(spark, sf_dir))
    return kept.select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents chosen for the weighted tree of domains, languages and sources."""
    levels = mixing.default_levels()
    chosen = mixing.mix(_documents(spark, sf_dir), levels, mixing.DEFAULT_WEIGHTS)
    return chosen.select(
        "doc_id",
        levels[0][1].alias("domain"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        mixing.count_words(F.col("text")).alias("n_tokens"),
        F.col("mix_epoch").alias("epoch"),
    )


def op3_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-duplicates of every document."""
    return dart_minhash.near_duplicates(_documents(spark, sf_dir))


def op4_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of an edited copy of it."""
    return minhash.against_edits(_documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts.count_tokens(_documents(spark, sf_dir))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score_quality(_documents(spark, sf_dir), labels)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence every document is, and the notices in its lines."""
    found = licenses.scan(_documents(spark, sf_dir), licenses.known_licenses(spark))
    return found.withColumn("notices", F.array_join("notices", ","))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the ids of every document stand in the files, read back from them."""
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(_documents(spark, sf_dir), path)
    return token_files.read_token_files(spark, path, with_ids=False).drop("ids")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contaminated(_documents(spark, sf_dir), items)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    return language_id.predict_languages(_documents(spark, sf_dir))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector under trained codebooks."""
    return vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the words of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resample.resample(_documents(spark, sf_dir), items)


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extraction.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_mixing": op2_mixing,
    "op3_dart_minhash": op3_dart_minhash,
    "op4_minhash_fingerprints": op4_minhash_fingerprints,
    "op5_token_counts": op5_token_counts,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_license_scan": op7_license_scan,
    "op8_token_files": op8_token_files,
    "op9_decontamination": op9_decontamination,
    "op10_language_id": op10_language_id,
    "op11_vector_codes": op11_vector_codes,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_html_extraction": op13_html_extraction,
}


def _fill_sql(source: str, parent: str, name: str, out: str) -> str:
    """Budgets of the children in ``source`` (lim, w, share), as named subqueries."""
    part = f"PARTITION BY {parent} " if parent else ""
    order = f"{part}ORDER BY lim / w, {name}"
    keys = f"{parent}, {name}" if parent else name
    return f"""
{out}_a AS (
  SELECT *, lim * sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= w * (share - coalesce(sum(lim) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS whole
  FROM {source}),
{out} AS (
  SELECT {keys}, CASE WHEN whole THEN lim::DOUBLE ELSE
    (share - coalesce(sum(CASE WHEN whole THEN lim END) OVER ({part}), 0)::DOUBLE) * w
    / sum(CASE WHEN NOT whole THEN w END) OVER ({part}) END AS share
  FROM {out}_a)"""


_MIXING_SQL = f"""
WITH t AS (
  SELECT doc_id,
    'domain' || (coalesce(try_cast(regexp_extract(source, '(\\d+)$', 1) AS BIGINT), 0) % 4)::VARCHAR AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens
  FROM documents),
leaf AS (
  SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * 2)::DOUBLE AS lim
  FROM t GROUP BY ALL),
one AS (
  SELECT domain, sum(lim) AS lim, CASE WHEN domain = 'domain0' THEN 2 ELSE 1 END AS w,
    (SELECT sum(tokens) FROM leaf)::DOUBLE AS share
  FROM leaf GROUP BY domain),
{_fill_sql("one", "", "domain", "one_b")},
two AS (
  SELECT domain, lang, sum(lim) AS lim, CASE WHEN lang = 'en' THEN 3 ELSE 1 END AS w, any_value(share) AS share
  FROM leaf JOIN one_b USING (domain) GROUP BY domain, lang),
{_fill_sql("two", "domain", "lang", "two_b")},
three AS (
  SELECT domain, lang, source, lim, tokens, 1 AS w, share FROM leaf JOIN two_b USING (domain, lang)),
{_fill_sql("three", "domain, lang", "source", "three_b")},
plan AS (
  SELECT domain, lang, source, whole_epochs, floor(share - whole_epochs * tokens) AS rest
  FROM (SELECT *, CASE WHEN tokens > 0 THEN floor(share / tokens) ELSE 0 END::BIGINT AS whole_epochs
        FROM leaf JOIN three_b USING (domain, lang, source))),
placed AS (
  SELECT t.*, whole_epochs, rest,
    coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source
      ORDER BY md5('mix:' || (whole_epochs + 1)::VARCHAR || ':' || coalesce(doc_id::VARCHAR, ''))
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM t JOIN plan USING (domain, lang, source)),
taken AS (
  SELECT *, whole_epochs + CASE WHEN start < rest THEN 1 ELSE 0 END AS n FROM placed)
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(1, n + 1))::INTEGER AS epoch FROM taken WHERE n > 0
"""


# Written apart from the operator: notices by patterns over the whole text, spellings in
# a list of their own.
_SPELLINGS_SQL = [
    ("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("https", "http"),
    ("organisation", "organization"), ("whilst", "while"), ("authorised", "authorized"),
    ("non commercial", "noncommercial"), ("ver", "version"), ("v", "version"),
]
_LICENSE_START_SQL = (
    "licen[sc]ed under|released under|distributed under|made available under|permission (?:is|to)|redistribution and use|"
    "this (?:program|software|library|file|work) is|everyone is permitted|subject to the terms|use of this source|"
    "spdx[ -]license[ -]identifier"
)
_SMALL_SQL = "and|or|of|the|by|for|others?|its|their|contributors|authors|developers|team|rights|reserved|all|de|van|von|et|al"


def _canonical_sql(text: str) -> str:
    year = r"(?:(?:19|20)\d\d|[<\[{](?:yyyy|year))"
    mark = rf"(?:(?:copyright|©)[ \t:]*(?:\(c\)|©)|(?:copyright|©|\(c\))[ \t:]*{year})"
    notice = rf"(?im)^[^\p{{L}}\p{{N}}\n]*{mark}[^\n]*?({_LICENSE_START_SQL}|$)"
    lead = r"[^\p{L}\p{N} \t\r\n]*"
    first, later = rf"{lead}[\p{{Lu}}\p{{N}}][^ \t\r\n]*", rf"{lead}(?:[\p{{Lu}}\p{{N}}][^ \t\r\n]*|(?:{_SMALL_SQL}){lead})?"
    holder = rf"(?m)^[^\p{{L}}\p{{N}}\n]*Copyright[ \t\r]+{first}(?:[ \t\r]+{later})*[ \t\r]*$"
    form = f"regexp_replace(coalesce({text}, ''), '{notice}', ' \\1', 'g')"
    form = f"lower(regexp_replace({form}, '{holder}', ' ', 'g'))"
    form = rf"' ' || trim(regexp_replace({form}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' '"
    for other, usual in _SPELLINGS_SQL:
        form = f"replace({form}, ' {other} ', ' {usual} ')"
    return f"trim({form})"


_KNOWN_SQL = ", ".join(
    "('{}', '{}')".format(name, text.replace("'", "''")) for name, text in licenses.LICENSES.items()
)
_LICENSES_SQL = f"""
WITH known AS (
  SELECT sha256({_canonical_sql("body")}) AS known, min(license) AS license
  FROM (VALUES {_KNOWN_SQL}) v(license, body) GROUP BY 1),
lines AS (SELECT DISTINCT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
found AS (
  SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
  FROM (SELECT doc_id, sha256({_canonical_sql("line")}) AS known FROM lines) JOIN known USING (known) GROUP BY doc_id),
whole AS (SELECT doc_id, sha256({_canonical_sql("text")}) AS digest FROM documents)
SELECT doc_id, digest, license, coalesce(notices, '') AS notices
FROM whole LEFT JOIN known ON digest = known.known LEFT JOIN found USING (doc_id)
"""

_SUBSTRINGS_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM t WHERE len(w) >= 50)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY md5(s)) AS owner FROM p) WHERE owner < doc_id),
g AS (SELECT doc_id, list(i) AS starts FROM f GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 50)) AS i FROM f),
kept AS (
  SELECT x.doc_id, count(gone.i) AS n_removed,
    coalesce(string_agg(CASE WHEN gone.i IS NULL THEN x.word END, ' ' ORDER BY x.i), '') AS kept
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM t) x
  LEFT JOIN gone ON x.doc_id = gone.doc_id AND x.i = gone.i GROUP BY x.doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
"""


def _shingles_sql(name: str, table: str, key: str) -> str:
    """Words and five-word shingles with their counts, as named subqueries."""
    return rf"""
{name}_w AS (
  SELECT {key}, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}),
{name} AS (
  SELECT {key}, g, count(*) AS c FROM (
    SELECT {key}, array_to_string(w[i:i + 4], ' ') AS g
    FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM {name}_w WHERE len(w) > 0))
  GROUP BY ALL)"""


_CONTAINED_SQL = f"""
WITH {_shingles_sql("d", "documents", "doc_id")},
{_shingles_sql("b", "benchmark", "item_id")},
short AS (SELECT DISTINCT len(w) AS k FROM b_w WHERE len(w) BETWEEN 1 AND 4),
every AS (
  SELECT doc_id, g FROM d UNION
  SELECT doc_id, array_to_string(w[i:i + k - 1], ' ') FROM (
    SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d_w, short WHERE len(w) >= k)),
n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY 1)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
FROM (SELECT doc_id, item_id, count(*) AS n_shared FROM every JOIN b USING (g) GROUP BY ALL) JOIN n USING (item_id)
WHERE n_shared >= 0.8::DOUBLE * n_shingles
"""

_CLASSES_SQL = f"""
WITH RECURSIVE {_shingles_sql("d", "documents", "doc_id")},
n AS (SELECT doc_id, sum(c) AS n FROM d GROUP BY 1),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.c, b.c)) AS same
  FROM d a JOIN d b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
  WHERE same::DOUBLE / (p.n + q.n - same) >= 0.8
  UNION ALL
  SELECT a.doc_id, b.doc_id FROM d_w a JOIN d_w b ON a.text = b.text AND a.doc_id <> b.doc_id
  WHERE len(a.w) = 0),
reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT doc_id, y FROM reached JOIN links ON other = x)
SELECT doc_id, min(other) AS class_id FROM reached GROUP BY 1
"""


def _rounds_sql(rounds: int) -> str:
    """Assignment and new entries of each round, as named subqueries."""
    return ",".join(
        f"""
near{r} AS MATERIALIZED (
  SELECT i, part, min(d * 256 + entry) AS best
  FROM (SELECT i, part, entry, sum((x - y) * (x - y))::BIGINT AS d
        FROM parts JOIN book{r} USING (part, pos) GROUP BY ALL) GROUP BY ALL),
new{r} AS (
  SELECT part, best % 256 AS entry, pos, floor(sum(x) / count(*))::BIGINT AS y
  FROM near{r} JOIN parts USING (i, part) GROUP BY ALL),
book{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.pos, coalesce(n.y, b.y) AS y
  FROM book{r} b LEFT JOIN new{r} n ON b.part = n.part AND b.entry = n.entry AND b.pos = n.pos)"""
        for r in range(rounds)
    )


_CODES_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS i, vec_id, label, embedding
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT i, (k - 1) // (n // 4) AS part, (k - 1) % (n // 4) AS pos, floor(1024 * v::DOUBLE)::BIGINT AS x
  FROM (SELECT i, len(embedding) AS n, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS k FROM kept)),
book0 AS MATERIALIZED (SELECT part, i AS entry, pos, x AS y FROM parts WHERE i < 256),
{_rounds_sql(4)},
last AS (
  SELECT i, part, min(d * 256 + entry) AS best
  FROM (SELECT i, part, entry, sum((x - y) * (x - y))::BIGINT AS d
        FROM parts JOIN book4 USING (part, pos) GROUP BY ALL) GROUP BY ALL),
coded AS (
  SELECT vec_id, label, string_agg(right('0' || lower(to_hex(best % 256)), 2), '' ORDER BY part) AS code,
    sum(best // 256)::BIGINT AS error
  FROM last JOIN kept USING (i) GROUP BY i, vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, entry, pos)) FROM book4) AS codebooks_sha256
FROM coded
"""

ORACLE: dict[str, str] = {
    "op1_substring_dedup": _SUBSTRINGS_SQL.replace("\\\\", "\\"),
    "op3_dart_minhash": _CLASSES_SQL.replace("\\\\", "\\"),
    "op9_decontamination": _CONTAINED_SQL.replace("\\\\", "\\"),
    "op2_mixing": _MIXING_SQL.replace("\\\\", "\\"),
    "op7_license_scan": _LICENSES_SQL.replace("\\\\", "\\"),
    "op11_vector_codes": _CODES_SQL,
}
