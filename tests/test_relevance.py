from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from galeledger.functions.relevance import confidence_table, is_relevant, verdict
from galeledger.operators.relevance import relevance_gate, relevant_only
from galeledger.vocab import WEATHER, Category, Vocabulary

MIXED = Vocabulary(
    (Category("a", ("storm", "big storm"), 0.7), Category("b", ("fire",), 0.1)), ("match",)
)

# Text, hits per category (weather, infrastructure, emergency, impact), kept categories
# with their rounded shares, confidence; worked out by hand from weights 1, 1, 0.8, 0.6.
WORKED = [
    ("Torm.", (1, 0, 0, 0), {"severe_weather": 1.0}, 0.62),
    ("TORM, rahe!", (2, 0, 0, 0), {"severe_weather": 1.0}, 0.68),
    ("oht", (0, 0, 0, 1), {"impact": 1.0}, 0.62),
    ("Torm ja oht", (1, 0, 0, 1), {"severe_weather": 0.62, "impact": 0.37}, 0.75),
    ("torm rahe äike oht kriis", (3, 0, 0, 2), {"severe_weather": 0.71, "impact": 0.29}, 0.9),
    ("päästjad, torm, elektrita, kriis", (1, 1, 1, 1), None, 0.95),
    ("päästjad " + "oht " * 20, (0, 0, 1, 20), {"impact": 0.94}, 0.82),
    ("tormid ja päästjate kriisid", (0, 0, 0, 0), None, None),
]


def test_worked_verdicts(evaluate):
    found = evaluate([w[0] for w in WORKED], verdict)
    names = [c.name for c in WEATHER.categories]
    for (text, hits, kept, confidence), row in zip(WORKED, found):
        assert row["relevant"] == (confidence is not None), text
        counts = {c["name"]: len(c["matches"]) for c in row["categories"]}
        assert all(n == hits[names.index(name)] for name, n in counts.items()), text
        if kept is not None:
            assert {c["name"]: c["score"] for c in row["categories"]} == kept, text
        if confidence is not None:
            assert row["confidence"] == pytest.approx(confidence, abs=0.011), text
            assert row["confidence"] in {v for r in confidence_table(4) for v in r}


def test_overlapping_words_count_each(evaluate):
    (row,) = evaluate(["A big storm, storm and fire"], lambda t: verdict(t, MIXED))
    assert row["categories"][0]["matches"] == ["storm", "storm", "big storm"]
    assert row["categories"][0]["score"] == 0.95 and len(row["categories"]) == 1
    (row,) = evaluate(["big storm match"], lambda t: verdict(t, MIXED))
    assert (row["relevant"], row["confidence"]) == (False, 0.8)


@pytest.mark.parametrize("vocab", [WEATHER, MIXED, Vocabulary(WEATHER.categories)])
def test_verdict_invariants(evaluate, vocab):
    """What holds for every text, whatever the vocabulary."""
    rng = random.Random(11)
    words = list(vocab.all_words)
    gaps = [" ", ", ", ".\n", " - "]
    samples, used = [], []
    for _ in range(200):
        some = [rng.choice(words) for _ in range(rng.randint(1, 6))]
        used.append(some)
        samples.append("".join(w + rng.choice(gaps) for w in some))
    found = evaluate(samples, lambda t: verdict(t, vocab))
    shuffled = evaluate([s.upper() for s in samples], lambda t: verdict(t, vocab))
    for some, row, upper in zip(used, found, shuffled):
        assert row["relevant"] == (not set(some) & set(vocab.negatives))
        shares = [c["score"] for c in row["categories"]]
        assert sum(shares) <= 1.02 and all(s >= 0.1 for s in shares)
        if row["relevant"]:
            assert 0.62 <= row["confidence"] <= 1.0 and shares
            assert sum(len(c["matches"]) for c in row["categories"]) >= 1
        order = [c.name for c in vocab.categories]
        names = [c["name"] for c in row["categories"]]
        assert names == sorted(names, key=order.index)
        assert (upper["relevant"], upper["confidence"]) == (row["relevant"], row["confidence"])


def test_words_need_boundaries(evaluate):
    texts = ["torm", "torm-", "tormi", "augusti_torm", "eeltorm", "(torm)", "torm1", "ÄIKE", "äiket"]
    found = evaluate(texts, verdict)
    assert [r["relevant"] for r in found] == [True, True, False, False, False, True, False, True, False]


def test_share_just_above_the_cutoff_is_kept(evaluate):
    (row,) = evaluate(["päästjad " + "oht " * 12], verdict)
    assert [c["name"] for c in row["categories"]] == ["emergency_response", "impact"]


def test_confidences():
    table = confidence_table(4)
    assert len({v for row in table for v in row}) <= 20
    assert table[0][0] == 0.62 and table[2][4] == 0.97 and table[3][4] == 1.0


def test_early_outcomes(evaluate):
    rows = evaluate(["", None, "   ", "KONTSERT jäi tormi tõttu ära, torm", "ilus ilm"], verdict)
    assert [(r["relevant"], r["confidence"], r["reason"]) for r in rows] == [
        (False, 1.0, "Empty text"),
        (False, 1.0, "Empty text"),
        (False, 0.9, "No relevant patterns found"),
        (False, 0.8, "Contains non-relevant context"),
        (False, 0.9, "No relevant patterns found"),
    ]


def test_gate_keeps_relevant_rows_and_copies(texts):
    rows = texts(["rahe"] * 3 + ["rahe ja torm", "kontsert", None])
    assert relevance_gate(rows, 0.6).count() == 4
    assert relevance_gate(rows, 0.65).count() == 1
    assert relevant_only(rows).columns == ["id", "text"]
    assert rows.filter(is_relevant(F.col("text"))).count() == 4


def test_each_text_is_scanned_once(texts):
    gated = relevance_gate(texts(["torm"]), 0.65).select("relevance.confidence")
    plan = gated._jdf.queryExecution().executedPlan().toString()
    first_scan = "(?<!"
    assert plan.count("inline(") == 1
    assert plan.index("Filter") < plan.index(first_scan)
