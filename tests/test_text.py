from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from galeledger.functions.columns import python_round2
from galeledger.functions.geo import dms_to_degrees
from galeledger.functions.text import (
    ascii_digits,
    likely_names,
    listed_marks,
    listed_values,
    mentions_any,
    name_tokens,
    scan_groups,
    whole_word_hits,
)
from galeledger.vocab import WEATHER


def hits_of(word, text):
    """Whole-word hits of one word."""
    return re.findall(rf"(?i)\b{re.escape(word)}\b", text)


def test_words_that_share_text_are_scanned_apart():
    groups = scan_groups(WEATHER.all_words)
    assert [sorted(g) for g in groups[1:]] == [
        ["infrastruktuuri kahjustused", "katkenud liinid"]
    ]
    assert sorted(w for g in groups for w in g) == sorted(WEATHER.all_words)


@pytest.mark.parametrize(
    "words",
    [
        WEATHER.all_words,
        ("a", "b", "a b", "b a", "a b a", "ab"),
        ("c++", "c", "[x", "x", "x-y", "y"),
        ("is", "ski", "kiss"),
    ],
)
def test_hits_equal_one_search_per_word(evaluate, words):
    rng = random.Random(7)
    pieces = list(words) + [w.upper() for w in words] + ["x", "torms", "ſki", "ıs", "İs", "é"]
    gaps = [" ", "  ", ",", "-", "\n", "", "̇", "_", "7", " "]
    samples = [
        "".join(rng.choice(pieces) + rng.choice(gaps) for _ in range(rng.randint(0, 12)))
        for _ in range(300)
    ]
    found = evaluate(samples, lambda t: whole_word_hits(F.lower(t), words))
    for text, hits in zip(samples, found):
        expected = [h for w in words for h in hits_of(w, text.lower())]
        assert sorted(hits) == sorted(expected), text


def test_cheap_test_never_misses_a_case_insensitive_match(evaluate):
    stems = ["klienti", "kiss", "äike"]
    samples = ["KLIENTI", "klıentı", "KLİENTİ", "kiſſ", "KIẞ", "ÄIKE", "klient", "", "KKiss"]
    found = evaluate(samples, lambda t: mentions_any(F.lower(t), stems))
    for text, hit in zip(samples, found):
        if any(re.search(re.escape(s), text, re.I) for s in stems):
            assert hit, text


def test_python_rounding(spark):
    rng = random.Random(3)
    values = [0.625, 0.825, 0.925, 0.975, 0.005, 2.675, 1234567.125, 100.0]
    values += [rng.random() * rng.choice([1, 100]) for _ in range(2000)]
    values += [a / b * 100 for b in range(1, 60) for a in range(b)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for r in rows.select("v", python_round2(F.col("v")).alias("r")).collect():
        assert r["r"] == round(r["v"], 2)


def test_digits_of_any_script(evaluate):
    assert evaluate(["٢٥", "12", "１２३", "𝟗", "a"], ascii_digits) == ["25", "12", "123", "9", "a"]


def test_likely_names(evaluate):
    every = lambda v: F.lit(True)
    grams = evaluate(["Lääne-Nigula vald, X", "", None], lambda t: likely_names(t, [1, 2], every, every))
    assert grams[0] == ["Lääne-Nigula", "Lääne-Nigula vald", "vald", "vald X", "X"]
    assert not grams[1] and not grams[2]
    names = evaluate(["a b a b", "a"], lambda t: likely_names(t, [1, 2, 3], every, every))
    assert names == [["a", "a b", "a b a", "b", "b a", "b a b"], ["a"]]
    some = evaluate(["a b a b"], lambda t: likely_names(t, [1, 2, 3], lambda v: v == "b", lambda v: v != "b a"))
    assert some == [["b", "b a b"]]


def test_runs_are_formed_only_where_a_name_may_stand(evaluate):
    """However many names begin with a frequent word, longer runs start in few places."""
    keys = ["Suur", "tee", *[f"Suur k{i} tee" for i in range(2000)]]
    value = "Suur x Suur k7 tee Suur"
    assert evaluate([value], lambda t: listed_marks(keys)(name_tokens(t))) == [[1, 0, 3, 0, 1, 1]]
    names = evaluate([value], lambda t: listed_values(name_tokens(t), [("tee", "T."), ("Suur", "S.")]))
    assert names == [["S.", "S.", "T.", "S."]]


def test_coordinates(evaluate):
    values = evaluate(
        ["N 58°51’59”", "S 58°51'59\"", "W 0°30’0”", "58°51’", "", None], dms_to_degrees
    )
    assert values[0] == pytest.approx(58 + 51 / 60 + 59 / 3600)
    assert values[1] == pytest.approx(-(58 + 51 / 60 + 59 / 3600))
    assert values[2] == pytest.approx(-0.5)
    assert values[3:] == [None, None, None]
