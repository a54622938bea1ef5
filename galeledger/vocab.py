"""Default vocabularies, gazetteers and thresholds.

Everything here is configuration: each operator takes these as parameters and
uses the Estonian defaults below when none are given.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property


@dataclass(frozen=True)
class Category:
    """One weighted group of whole-word keywords."""

    name: str
    words: tuple[str, ...]
    weight: float


@dataclass(frozen=True)
class Vocabulary:
    """Keyword categories plus the words that veto an article."""

    categories: tuple[Category, ...]
    negatives: tuple[str, ...] = ()

    @cached_property
    def all_words(self) -> tuple[str, ...]:
        words = [w for c in self.categories for w in c.words] + list(self.negatives)
        return tuple(dict.fromkeys(w.lower() for w in words))


@dataclass(frozen=True)
class Place:
    """A named place and the spellings that count as a mention of it."""

    name: str
    kind: str
    confidence: float
    variants: tuple[str, ...]


@dataclass(frozen=True)
class DamagePhrase:
    phrase: str
    kind: str
    confidence: float


@dataclass(frozen=True)
class SeverityRules:
    """Words around numbers that turn them into severity facts."""

    customer_nouns: tuple[str, ...]
    customer_leads: tuple[str, ...]
    currency_marks: tuple[str, ...]
    currency: str
    amount_words: tuple[str, ...]
    multipliers: tuple[tuple[str, float], ...]
    durations: tuple[tuple[str, tuple[str, ...]], ...]
    duration_limit: int = 48
    customers_major: int = 10_000
    customers_moderate: int = 1_000
    amount_major: float = 1_000_000.0
    amount_moderate: float = 100_000.0


# --- fixed values -----------------------------------------------------------
# The word lists, weights, phrases, place spellings and limits below must equal
# the published ones for results to agree.

WEATHER = Vocabulary(
    categories=(
        Category(
            "severe_weather",
            (
                "torm", "orkaan", "tugev tuul", "lumetorm", "äike", "paduvihm",
                "tugev vihm", "rahe", "üleujutus", "tulvavesi", "tugev lumesadu",
                "jäide", "ekstreemsed ilmastikuolud",
            ),
            1.0,
        ),
        Category(
            "infrastructure_damage",
            (
                "elektrikatkestus", "elektrita", "vooluta", "liinid", "murdunud puu",
                "murdunud puud", "katkenud liin", "katkenud liinid", "üleujutatud",
                "kahjustused", "infrastruktuuri kahjustused", "teed suletud",
                "liiklustakistused",
            ),
            1.0,
        ),
        Category(
            "emergency_response",
            (
                "päästjad", "päästeamet", "häirekeskus", "evakueerimine",
                "kriisikomisjon", "elektrilevi", "avariibrigaad",
            ),
            0.8,
        ),
        Category(
            "impact",
            (
                "kahjustada", "häiritud", "takistatud", "ohtlik", "raskendatud",
                "katkestus", "kriis", "oht", "hoiatus",
            ),
            0.6,
        ),
    ),
    negatives=(
        "spordivõistlus", "kontsert", "etendus", "festival", "ilmaennustus",
        "ilmateade", "prognoos", "kultuurisündmus",
    ),
)

REGION_NAMES = (
    "Põhja-Eesti", "Lõuna-Eesti", "Ida-Eesti", "Lääne-Eesti", "Kagu-Eesti", "Kirde-Eesti",
)
COUNTY_STEMS = (
    "Harju", "Hiiu", "Ida-Viru", "Jõgeva", "Järva", "Lääne", "Lääne-Viru", "Põlva",
    "Pärnu", "Rapla", "Saare", "Tartu", "Valga", "Viljandi", "Võru",
)

LOCATION_STOPWORDS = (
    "aga", "aastal", "igal", "tähendab", "vahter", "kuigi", "läinud", "nädalavahetusel",
)

DAMAGE_PHRASES = (
    DamagePhrase("elektrikatkestus", "power_outage", 1.0),
    DamagePhrase("elektrita", "power_outage", 1.0),
    DamagePhrase("vooluta", "power_outage", 1.0),
    DamagePhrase("elektrivarustus", "power_outage", 0.8),
    DamagePhrase("murdunud puu", "fallen_trees", 1.0),
    DamagePhrase("murdunud puud", "fallen_trees", 1.0),
    DamagePhrase("puu murdus", "fallen_trees", 1.0),
    DamagePhrase("puud murdusid", "fallen_trees", 1.0),
    DamagePhrase("katkenud liin", "broken_line", 1.0),
    DamagePhrase("katkenud liinid", "broken_line", 1.0),
    DamagePhrase("liinirikked", "power_lines", 0.9),
    DamagePhrase("elektriliinid", "power_lines", 0.8),
    DamagePhrase("raske lumi", "heavy_snow", 1.0),
    DamagePhrase("tugev lumesadu", "heavy_snowfall", 1.0),
    DamagePhrase("lumetorm", "snow_storm", 1.0),
    DamagePhrase("torm", "storm", 0.9),
    DamagePhrase("tormikahjustused", "storm_damage", 1.0),
    DamagePhrase("rikked", "malfunction", 0.7),
    DamagePhrase("üleujutus", "flooding", 1.0),
    DamagePhrase("tulvavesi", "flooding", 0.9),
)

SEVERITY = SeverityRules(
    customer_nouns=("klienti", "majapidamist", "tarbijat"),
    customer_leads=("umbes", "ligi", "üle", "kokku"),
    currency_marks=("euro", "€"),
    currency="EUR",
    amount_words=("miljonit?", "tuhat?"),
    multipliers=(("miljon", 1_000_000.0), ("tuhat", 1_000.0)),
    durations=(("days", ("päev",)), ("hours", ("tund",)), ("minutes", ("minut",))),
)

# Numbers as they are written in texts; ``{space}`` is any white space.
COUNT_SHAPE = r"\d+(?:,\d+)?(?:{space}*000)?"
AMOUNT_SHAPE = r"\d+(?:[.,]\d+)?"

PREFILTER_STEMS = ("torm", "elektrikatk", "üleuju", "rahe")
HEADING_PREFIX = r"^UUDISED.\s+"
SAMPLE_POSITIONS = (3, 37, 70, 75, 86)

DEFAULT_MIN_CONFIDENCE = 0.6
REPORT_MIN_CONFIDENCE = 0.65
SHARE_CUTOFF = 0.1
THRESHOLDS = (0.5, 0.6, 0.7, 0.8, 0.9)
BORDERLINE = (0.55, 0.65)
BORDERLINE_ROWS = 5
MAX_PERCENT_DROPPED = 30.0
MAX_ARTICLES_DROPPED = 50
TOP_LOCATIONS = 10

WIND_YEAR = 2023
WIND_ELEMENT = "DWSX"
# --- end of fixed values ----------------------------------------------------


# A region is spelled by its name and a county by its stem: every inflected form
# (``-s``, ``-sse``; ``-maa``, ``-maale``, ``-maalt``) contains that spelling, so
# the longer forms add no mention.
REGIONS = tuple(Place(name, "region", 0.9, (name,)) for name in REGION_NAMES)
COUNTIES = tuple(
    Place(f"{stem}maa", "county", 1.0, (stem,))
    for stem in COUNTY_STEMS
)
GAZETTEER = REGIONS + COUNTIES
