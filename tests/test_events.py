from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from galeledger.functions.events import classification, damage_types, locations, severity
from galeledger.vocab import GAZETTEER, Place

MONEY = [
    ("Remont läheb maksma 1.5 miljonit eurot.", 1_500_000, "major", 0.9),
    ("Arve oli 500000€.", 500_000, "moderate", 0.8),
    ("Sild, hind 2,5 miljoni euro ringis.", 2_500_000, "major", 0.9),
    ("Vald küsib ligi 800 tuhat eurot.", 800_000, "moderate", 0.8),
    ("Katuse eest 50000 eurot.", 50_000, "unknown", 0.0),
    ("Raha kulus palju.", None, "unknown", 0.0),
    ("Eelarve on kolm miljonit eurot.", None, "unknown", 0.0),
    ("Esmalt 1.5 miljonit ja siis 500 tuhat eurot.", 500_000_000, "major", 0.9),
    ("Pakkumine 100000€ või 120000 krooni.", 100_000, "moderate", 0.8),
    ("Saldo on -500000 eurot.", 500_000, "moderate", 0.8),
    ("Kahju 1.500.000 EUROT", 500.0, "unknown", 0.0),
    ("Kahju 7 eurot", 7.0, "unknown", 0.0),
]

CUSTOMERS = [
    ("22 000 klienti", 22_000, "major"),
    ("22 000 klienti", 22_000, "major"),
    ("1,500 klienti", 1_500, "moderate"),
    ("25,5 klienti", 255, "minor"),
    ("20001 klienti", 21_000, "major"),
    ("100050 KLIENTI", 150_000, "major"),
    ("1000000 majapidamist", 1_000, "minor"),
    ("000 klienti", None, "unknown"),
    ("000 klienti, umbes 500 tarbijat", 500, "minor"),
    ("000 klienti, 500 tarbijat", None, "unknown"),
    ("22 000 Elektrilevi klienti", None, "unknown"),
    ("٢٥ klienti", 25, "minor"),
    ("1" + "2" * 24 + " klienti", int(float("1" + "2" * 24)), "major"),
    ("9" * 60 + " klienti", None, "major"),
]

DURATIONS = [
    ("veel 3 päeva", (3, "days"), "unknown", 0.0),
    ("60 tundi", (60, "hours"), "moderate", 0.7),
    ("49 MINUTIT", (49, "minutes"), "moderate", 0.7),
    ("48 tundi", (48, "hours"), "unknown", 0.0),
    ("5 minutit ja 3 tundi", (3, "hours"), "unknown", 0.0),
    ("mõni päev", None, "unknown", 0.0),
    ("50 tundi, 500 klienti", (50, "hours"), "moderate", 1.0),
    ("9" * 25 + " päeva", (int("9" * 25), "days"), "moderate", 0.7),
    ("9" * 39 + " päeva", (None, "days"), "unknown", 0.0),
]


def test_money(evaluate):
    found = evaluate([c[0] for c in MONEY], severity)
    for (text, amount, scale, confidence), row in zip(MONEY, found):
        money = row["financial_damage"]
        if amount is None:
            assert money is None, text
        else:
            assert money["amount"] == pytest.approx(amount), text
            assert (money["currency"], money["confidence"]) == ("EUR", 0.9)
        assert (row["scale"], row["confidence"]) == (scale, confidence), text


def test_customers(evaluate):
    found = evaluate([c[0] for c in CUSTOMERS], severity)
    for (text, count, scale), row in zip(CUSTOMERS, found):
        assert row["scale"] == scale, text
        if count is not None and count > 2**53:
            assert float(row["affected_customers"]) == float(count), text
        else:
            assert row["affected_customers"] == count, text
        assert row["confidence"] == (0.0 if scale == "unknown" else 1.0)


def test_duration(evaluate):
    found = evaluate([c[0] for c in DURATIONS], severity)
    for (text, expected, scale, confidence), row in zip(DURATIONS, found):
        value = row["duration"] and (row["duration"]["value"], row["duration"]["unit"])
        assert value == expected, text
        assert (row["scale"], row["confidence"]) == (scale, confidence), text


def test_combined_severity(evaluate):
    text = (
        "Vooluta jäi 15000 klienti, rikked maksavad 2.5 miljoni euro võrra rohkem ja\n"
        "parandamine võtab 3 päeva."
    )
    (row,) = evaluate([text], severity)
    assert row["affected_customers"] == 15_000
    assert row["financial_damage"]["amount"] == 2_500_000
    assert row["duration"]["value"] == 3 and row["duration"]["unit"] == "days"
    assert (row["scale"], row["confidence"]) == ("major", 1.0)


def test_places_in_gazetteer_order(evaluate):
    found = evaluate(
        ["Kagu-Eestis ja LÕUNA-EESTIS, Lääne-Virumaal, harjutusväljal", "", None], locations
    )
    assert [(p["name"], p["type"], p["confidence"]) for p in found[0]] == [
        ("Lõuna-Eesti", "region", 0.9),
        ("Kagu-Eesti", "region", 0.9),
        ("Harjumaa", "county", 1.0),
        ("Läänemaa", "county", 1.0),
        ("Lääne-Virumaa", "county", 1.0),
    ]
    assert found[1:] == [[], []]


def test_inflected_forms_add_no_mention(evaluate):
    suffixes = {"region": ("", "s", "sse"), "county": ("maa", "maale", "maalt", "")}
    full = [
        Place(p.name, p.kind, p.confidence, tuple(p.variants[0] + s for s in suffixes[p.kind]))
        for p in GAZETTEER
    ]
    samples = [v for p in full for v in p.variants] + ["Harju ja Tartumaalt Ida-Eestisse"]
    assert evaluate(samples, lambda t: locations(t, full)) == evaluate(samples, locations)


def test_a_name_listed_twice_is_mentioned_once(evaluate):
    places = [Place("A", "x", 0.5, ("foo",)), Place("A", "y", 0.6, ("bar",))]
    (both,) = evaluate(["bar foo"], lambda t: locations(t, places))
    assert [(p["name"], p["type"]) for p in both] == [("A", "x")]


def test_other_places_follow_known_ones(evaluate):
    (found,) = evaluate(
        ["Tartu"],
        lambda t: locations(t, others=F.array(F.lit("Antsla"), F.lit("Tartumaa"), F.lit("Antsla"))),
    )
    assert [(p["name"], p["type"], p["confidence"]) for p in found] == [
        ("Tartumaa", "county", 1.0),
        ("Antsla", "other", 0.7),
    ]


def test_damage_types(evaluate):
    found = evaluate(
        ["Tulvavesi. Elektrivarustus, ELEKTRITA. lumetorm", "tulvavesi", "elektrivarustus", None],
        damage_types,
    )
    assert [[(d["type"], d["confidence"]) for d in row] for row in found] == [
        [("power_outage", 1.0), ("snow_storm", 1.0), ("storm", 0.9), ("flooding", 0.9)],
        [("flooding", 0.9)],
        [("power_outage", 0.8)],
        [],
    ]


def test_missing_text_is_classified_as_nothing(evaluate):
    (row,) = evaluate([None], classification)
    assert row["locations"] == [] and row["damage_types"] == []
    assert (row["severity"]["scale"], row["severity"]["confidence"]) == ("unknown", 0.0)
