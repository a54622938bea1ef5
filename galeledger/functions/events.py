"""Places, severity and damage types of one article as column expressions."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from galeledger import schemas
from galeledger.functions.columns import column_function, constant, let, strings
from galeledger.functions.text import (
    SPACE,
    ascii_digits,
    checksum,
    contains_any,
    likely_names,
    likely_sums,
    listed_marks,
    listed_values,
    quote,
    search_text,
)
from galeledger.vocab import (
    AMOUNT_SHAPE,
    COUNT_SHAPE,
    DAMAGE_PHRASES,
    GAZETTEER,
    SEVERITY,
    DamagePhrase,
    Place,
    SeverityRules,
)

# Confidence attached to each kind of fact.
CUSTOMERS_CONFIDENCE = 1.0
FACT_CONFIDENCE = 0.9
AMOUNT_MAJOR_CONFIDENCE = 0.9
AMOUNT_MODERATE_CONFIDENCE = 0.8
LONG_DURATION_CONFIDENCE = 0.7
OTHER_PLACE_CONFIDENCE = 0.7

_NUMBER_START = r"(?iU)(?<!\d)"
_COUNT = f"({COUNT_SHAPE.replace('{space}', SPACE)})"


def first_of(key: str, rows: Column) -> Column:
    """Keep the first row per ``key``, order unchanged."""
    return let(
        F.transform(rows, lambda r: r[key]),
        lambda keys: F.filter(rows, lambda r, i: F.array_position(keys, r[key]) == i + 1),
    )


# --- severity ---------------------------------------------------------------


def _whole(number: Column) -> Column:
    """A number as a whole decimal, null beyond 38 digits."""
    return number.try_cast(schemas.WHOLE)


def _needed(rules: SeverityRules) -> list[str]:
    """Words without which no number pattern can match."""
    stems = [s for _, unit in rules.durations for s in unit]
    return [*rules.customer_nouns, *rules.currency_marks, *stems]


def _number_after(text: Column, search: Column, needed: Sequence[str], pattern: str) -> Column:
    """First number of ``pattern``, '' if none; texts without any of the needed
    words skip the scan."""
    return F.when(contains_any(search, needed), F.regexp_extract(text, pattern, 1)).otherwise("")


def _count(number: Column) -> Column:
    """Number of customers written in ``number``; null if it is not one.

    ``000`` anywhere stands for thousands and every ``000`` is dropped.
    """

    def parse(digits: Column) -> Column:
        thousands = ascii_digits(F.replace(digits, F.lit("000"), F.lit("")))
        return F.when(
            F.contains(digits, F.lit("000")), thousands.try_cast("double") * 1000
        ).otherwise(ascii_digits(digits).try_cast("double"))

    return let(F.regexp_replace(number, rf"(?U){SPACE}|,", ""), parse)


def customers(text: Column, search: Column, rules: SeverityRules = SEVERITY) -> Column:
    """Affected customers as a double, null if the text names none."""
    nouns = "|".join(map(quote, rules.customer_nouns))
    leads = "|".join(map(quote, rules.customer_leads))
    tail = rf"{_COUNT}{SPACE}*(?:{nouns})"

    def parse(number: Column) -> Column:
        # A first number that is no count, such as a bare 000, sends the search
        # on to the first number introduced by a lead word.
        led = F.when(number != "", F.regexp_extract(text, rf"(?iU)(?:{leads}){SPACE}*{tail}", 1))
        return F.coalesce(_count(number), _count(led))

    return let(_number_after(text, search, rules.customer_nouns, _NUMBER_START + tail), parse)


def amount(
    text: Column, low: Column, search: Column, rules: SeverityRules = SEVERITY
) -> Column:
    """Financial damage, null if the text names none. A multiplier word anywhere
    in the text scales the first amount."""
    words = "".join(rf"(?:{w})?{SPACE}*" for w in rules.amount_words)
    marks = "|".join(map(quote, rules.currency_marks))
    pattern = rf"{_NUMBER_START}({AMOUNT_SHAPE}){SPACE}*{words}(?:{marks})"
    number = _number_after(text, search, rules.currency_marks, pattern)
    value = ascii_digits(F.replace(number, F.lit(","), F.lit("."))).try_cast("double")
    scaled = F.lit(1.0)
    for word, factor in reversed(rules.multipliers):
        scaled = F.when(F.contains(low, F.lit(word.lower())), factor).otherwise(scaled)
    return let(value, lambda v: F.when(v.isNotNull(), v * scaled))


def duration(text: Column, search: Column, rules: SeverityRules = SEVERITY) -> Column:
    """First duration of the first unit found: ``{value, unit, confidence}``."""

    def in_unit(unit: str, stems: Sequence[str]) -> Column:
        pattern = rf"{_NUMBER_START}(\d+){SPACE}*(?:{'|'.join(map(quote, stems))})"
        number = _number_after(text, search, stems, pattern)
        return let(
            number,
            lambda n: F.when(
                n != "",
                F.struct(
                    _whole(ascii_digits(n)).alias("value"),
                    F.lit(unit).alias("unit"),
                    F.lit(FACT_CONFIDENCE).alias("confidence"),
                ),
            ),
        )

    return F.coalesce(*[in_unit(unit, stems) for unit, stems in rules.durations])


def _grade(facts: Column, rules: SeverityRules) -> Column:
    """Fold the facts into scale and confidence: customers, then money, then time."""
    people, money, time = facts["customers"], facts["amount"], facts["duration"]

    scale = (
        F.when(people > rules.customers_major, "major")
        .when(people > rules.customers_moderate, "moderate")
        .when(people.isNotNull(), "minor")
        .otherwise("unknown")
    )
    confidence = F.when(people.isNotNull(), CUSTOMERS_CONFIDENCE).otherwise(0.0)

    large, medium = money >= rules.amount_major, money >= rules.amount_moderate
    scale, confidence = (
        F.when(large, "major").when(medium & (scale != "major"), "moderate").otherwise(scale),
        F.when(large, F.greatest(confidence, F.lit(AMOUNT_MAJOR_CONFIDENCE)))
        .when(medium, F.greatest(confidence, F.lit(AMOUNT_MODERATE_CONFIDENCE)))
        .otherwise(confidence),
    )

    # The raw number is compared whatever its unit.
    long = (time["value"] > rules.duration_limit) & (scale != "major")
    return F.struct(
        F.when(people.isNotNull(), _whole(people)).alias("affected_customers"),
        time.alias("duration"),
        F.when(
            money.isNotNull(),
            F.struct(
                money.alias("amount"),
                F.lit(rules.currency).alias("currency"),
                F.lit(FACT_CONFIDENCE).alias("confidence"),
            ),
        ).alias("financial_damage"),
        F.when(long, "moderate").otherwise(scale).alias("scale"),
        F.when(long, F.greatest(confidence, F.lit(LONG_DURATION_CONFIDENCE)))
        .otherwise(confidence)
        .alias("confidence"),
    )


def _severity(text: Column, low: Column, rules: SeverityRules) -> Column:
    def facts(search: Column) -> Column:
        return F.struct(
            customers(text, search, rules).alias("customers"),
            amount(text, low, search, rules).alias("amount"),
            duration(text, search, rules).alias("duration"),
        )

    found = let(search_text(low, _needed(rules)), facts)
    return let(found, lambda f: _grade(f, rules))


@column_function
def severity(text: Column, rules: SeverityRules = SEVERITY) -> Column:
    """Affected customers, duration, financial damage, scale and confidence."""
    return let(F.lower(text), lambda low: _severity(text, low, rules))


# --- places -----------------------------------------------------------------


def _stems(place: Place) -> list[str]:
    """Variants of a place that do not contain a shorter variant."""
    low = sorted({v.lower() for v in place.variants}, key=len)
    return [v for i, v in enumerate(low) if not any(short in v for short in low[:i])]


def _known_places(low: Column, gazetteer: Sequence[Place]) -> Column:
    rows = constant(
        [
            {"stem": s, "name": p.name, "type": p.kind, "confidence": p.confidence}
            for p in gazetteer
            for s in _stems(p)
        ],
        "array<struct<stem:string,name:string,type:string,confidence:double>>",
    )
    found = F.filter(rows, lambda p: F.contains(low, p["stem"]))
    return F.transform(
        let(found, lambda f: first_of("name", f)),
        lambda p: F.struct(
            p["name"].alias("name"), p["type"].alias("type"), p["confidence"].alias("confidence")
        ),
    )


def _others(names: Column, known: Column) -> Column:
    """``names`` as further places, without those already known."""
    fresh = F.array_except(names, F.transform(known, lambda k: k["name"]))
    return F.transform(
        F.coalesce(fresh, strings()),
        lambda n: F.struct(
            n.alias("name"),
            F.lit("other").alias("type"),
            F.lit(OTHER_PLACE_CONFIDENCE).alias("confidence"),
        ),
    )


def _locations(low: Column, gazetteer: Sequence[Place], others: Column | None) -> Column:
    if not gazetteer:
        known = constant([], schemas.CLASSIFICATION["locations"].dataType.simpleString())
    else:
        known = _known_places(low, gazetteer)
    if others is None:
        return known
    return let(known, lambda k: F.concat(k, _others(others, k)))


@column_function
def locations(
    text: Column, gazetteer: Sequence[Place] = GAZETTEER, others: Column | None = None
) -> Column:
    """Places mentioned anywhere in the text, in gazetteer order, each once.

    ``others`` is an optional ``array<string>`` column of further place names
    (see :mod:`galeledger.operators.places`); they follow the known places.
    """
    return let(F.lower(text), lambda low: _locations(low, gazetteer, others))


# --- damage -----------------------------------------------------------------


def _damage_types(low: Column, phrases: Sequence[DamagePhrase]) -> Column:
    rows = constant(
        [{"phrase": p.phrase.lower(), "type": p.kind, "confidence": p.confidence} for p in phrases],
        "array<struct<phrase:string,type:string,confidence:double>>",
    )
    found = F.filter(rows, lambda p: F.contains(low, p["phrase"]))
    return F.transform(
        let(found, lambda f: first_of("type", f)),
        lambda p: F.struct(p["type"].alias("type"), p["confidence"].alias("confidence")),
    )


@column_function
def damage_types(text: Column, phrases: Sequence[DamagePhrase] = DAMAGE_PHRASES) -> Column:
    """Damage types in phrase order; the first phrase of a type sets its confidence."""
    return let(F.lower(text), lambda low: _damage_types(low, phrases))


PARTS = ("locations", "severity", "damage_types")


@column_function
def classification(
    text: Column,
    gazetteer: Sequence[Place] = GAZETTEER,
    rules: SeverityRules = SEVERITY,
    phrases: Sequence[DamagePhrase] = DAMAGE_PHRASES,
    others: Column | None = None,
    parts: Sequence[str] = PARTS,
) -> Column:
    """Locations, severity and damage types together; the text is lower-cased
    once. ``parts`` leaves out what a report does not need."""

    def extract(low: Column) -> Column:
        made = {
            "locations": lambda: _locations(low, gazetteer, others),
            "severity": lambda: _severity(text, low, rules),
            "damage_types": lambda: _damage_types(low, phrases),
        }
        return F.struct(*[made[part]().alias(part) for part in parts])

    return let(F.lower(text), extract)


def place_names(text: Column, listed: Sequence[tuple[str, str]]) -> Column:
    """Names of a short list that occur in the text as whole words, by position,
    each once.

    ``listed`` has, for each name, its tokens joined by a space and the name as it
    is reported. The work on a text grows with its words, whatever the list: filters
    tell the places where a name may stand, and what they let through is looked up.
    """
    names = dict(listed)
    if not names:
        return strings()
    whole = likely_sums(zlib.crc32(key.encode()) for key in names)
    likely = likely_names(
        text,
        sorted({key.count(" ") + 1 for key in names}),
        lambda token: F.lit(True),
        lambda run: whole(checksum(run)),
        listed_marks(names),
    )
    return F.coalesce(let(likely, lambda keys: listed_values(keys, names.items())), strings())
