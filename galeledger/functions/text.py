"""Unicode-exact text matching on native expressions.

Keyword lists are compiled on the driver into a few literal patterns, so one
scan of a text finds every word instead of one scan per word.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Iterable, Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from galeledger.functions.columns import constant, let, strings

WORD_CHAR = r"[\p{L}\p{N}_]"
# Java's White_Space lacks the four information separators.
SPACE = r"[\s\x1c-\x1f]"
NAME_TOKEN = r"[\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)*"


@lru_cache(maxsize=1)
def _case_twins() -> dict[str, str]:
    """Letter -> lower-case letters that match it ignoring case but stay apart
    under ``lower`` (long s for ``s``, dotless i for ``i`` and so on)."""
    twins: dict[str, str] = {}
    for code in range(0x80, 0x20000):
        letter = chr(code)
        low, fold = letter.lower(), letter.upper().lower()
        if len(low) == 1 == len(fold) and low != fold:
            twins[fold] = twins.get(fold, "") + low
    return twins


def quote(text: str) -> str:
    """``text`` as a literal in a Java pattern, inside or outside a class."""
    return re.sub(r"([\\^$.|?*+()\[\]{}&~#-])", r"\\\1", text)


def _with_twins(char: str) -> str:
    return quote(char) + _case_twins().get(char, "")


def _literal(char: str) -> str:
    return f"[{_with_twins(char)}]" if char in _case_twins() else quote(char)


def _is_word_char(char: str) -> bool:
    return char == "_" or char.isalnum()


def _left_edge(word: str) -> str:
    return f"(?<!{WORD_CHAR})" if _is_word_char(word[0]) else f"(?<={WORD_CHAR})"


def _right_edge(word: str) -> str:
    return f"(?!{WORD_CHAR})" if _is_word_char(word[-1]) else f"(?={WORD_CHAR})"


def _prefix_tree(words: Sequence[str]) -> str:
    """Pattern matching any of ``words``, sharing their common prefixes."""
    branches: dict[str, list[str]] = {}
    for word in words:
        if word:
            branches.setdefault(word[0], []).append(word[1:])
    parts = [_literal(c) + _prefix_tree(rest) for c, rest in branches.items()]
    if not parts:
        return ""
    body = parts[0] if len(parts) == 1 and "" not in words else f"(?:{'|'.join(parts)})"
    return body + "?" if "" in words else body


def _any_letter(letters: Iterable[str]) -> str:
    """Class of the given letters and their twins; anything if a word has ended."""
    letters = sorted(set(letters))
    if "" in letters:
        return ""
    return "[" + "".join(map(_with_twins, letters)) + "]"


def whole_words_pattern(words: Iterable[str]) -> str:
    """Java pattern for any of ``words`` as a whole word in lower-cased text.

    Word characters are letters, numbers and ``_`` - unlike Java's Unicode
    ``\\b``, combining marks are not part of a word.
    """
    words = sorted({w.lower() for w in words})
    plain = [w for w in words if _is_word_char(w[0]) and _is_word_char(w[-1])]
    parts = []
    if plain:
        # Most words of a text already fail on their first two letters.
        start = "".join(_any_letter(w[i : i + 1] for w in plain) for i in (0, 1))
        parts.append(f"(?<!{WORD_CHAR})(?={start}){_prefix_tree(plain)}(?!{WORD_CHAR})")
    for word in words:
        if word not in plain:
            parts.append(_left_edge(word) + "".join(map(_literal, word)) + _right_edge(word))
    return "|".join(parts)


def raw_whole_words_pattern(words: Iterable[str]) -> str:
    """As :func:`whole_words_pattern` for text that has not been lower-cased."""
    parts = [_left_edge(w) + "".join(map(_literal, w)) + _right_edge(w) for w in words]
    return "(?iU)" + "|".join(parts)


def _inside_word(text: str, i: int) -> bool:
    return 0 < i < len(text) and _is_word_char(text[i - 1]) and _is_word_char(text[i])


def _may_overlap(a: str, b: str) -> bool:
    for x, y in ((a, b), (b, a)):
        for i in range(len(x)):
            tail = x[i:]
            if _inside_word(x, i):
                continue
            if y.startswith(tail) and not _inside_word(y, len(tail)):
                return True
            if tail.startswith(y) and not _inside_word(x, i + len(y)):
                return True
    return False


@lru_cache(maxsize=64)
def scan_groups(words: tuple[str, ...]) -> tuple[tuple[str, ...], ...]:
    """Split ``words`` so that no two hits of one group can share text.

    Within a group a single left-to-right scan finds exactly the hits that
    separate scans per word would find.
    """
    groups: list[list[str]] = []
    for word in dict.fromkeys(w.lower() for w in words):
        for group in groups:
            if not any(_may_overlap(word, other) for other in group):
                group.append(word)
                break
        else:
            groups.append([word])
    return tuple(tuple(g) for g in groups)


def _twin_pairs(words: Iterable[str]) -> list[tuple[str, str]]:
    letters = sorted({c for w in words for c in w.lower()})
    return [(twin, c) for c in letters for twin in _case_twins().get(c, "")]


def fold_case_twins(value: Column, words: Iterable[str]) -> Column:
    """Map case twins of the letters used in ``words`` to those letters."""
    pairs = _twin_pairs(words)
    if not pairs:
        return value
    return F.translate(value, "".join(p[0] for p in pairs), "".join(p[1] for p in pairs))


def search_text(low: Column, stems: Sequence[str]) -> Column:
    """Lower-cased text in which plain containment of a stem is true wherever a
    case-insensitive search would succeed.

    A capital dotted I lower-cases to two characters, so the combining dot is
    dropped together with folding the case twins - on the rare texts having any.
    """
    pairs = _twin_pairs(stems)
    rare = [p[0] for p in pairs] + ["\u0307"]
    folded = F.translate(low, "".join(rare), "".join(p[1] for p in pairs))
    return F.when(contains_any(low, rare), folded).otherwise(low)


def contains_any(text: Column, stems: Iterable[str]) -> Column:
    return F.exists(strings(s.lower() for s in stems), lambda s: F.contains(text, s))


def mentions_any(low: Column, stems: Sequence[str]) -> Column:
    """Cheap test before a case-insensitive search for one of ``stems``."""
    return let(search_text(low, stems), lambda text: contains_any(text, stems))


def whole_word_hits(low: Column, words: Sequence[str]) -> Column:
    """All whole-word hits of ``words`` in lower-cased text."""
    scans = []
    for i, group in enumerate(scan_groups(tuple(words))):
        hits = F.regexp_extract_all(low, F.lit(whole_words_pattern(group)), F.lit(0))
        if i > 0:  # the few words set aside are rare: look before scanning
            hits = F.when(mentions_any(low, group), hits).otherwise(strings())
        scans.append(hits)
    return scans[0] if len(scans) == 1 else F.concat(*scans)


@lru_cache(maxsize=1)
def _digit_tables() -> tuple[str, str]:
    others = [
        chr(c) for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) == "Nd"
    ]
    return "".join(others), "".join(str(unicodedata.digit(c)) for c in others)


def ascii_digits(value: Column) -> Column:
    """Write every Unicode decimal digit as 0-9, so that a cast accepts it."""
    other = F.translate(value, *_digit_tables())
    return F.when(value.rlike(r"[^\x00-\x7f]"), other).otherwise(value)


def name_tokens(text: Column) -> Column:
    """Words of a text in order, hyphens inside words kept."""
    return F.regexp_extract_all(text, F.lit(NAME_TOKEN), F.lit(0))


#: Bits of a filter for each listed value, and the binary logarithm of the most in all.
VALUE_BITS = 16
MOST_WIDTH = 20


def bit_test(words: Sequence[int]) -> Callable[[Column], Column]:
    """Whether the bit at a place of a field is set, given as signed 64-bit words."""
    field = constant(list(words), "array<bigint>")

    def is_set(spot: Column) -> Column:
        word = F.element_at(field, (F.shiftright(spot, 6) + 1).cast("int"))
        return F.getbit(word, spot.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1

    return is_set


def checksum(value: Column) -> Column:
    """The CRC-32 of a string, which the driver knows too."""
    return F.crc32(value.cast("binary"))


def likely_sums(sums: Iterable[int]) -> Callable[[Column], Column]:
    """A test that is true for the given numbers below 2^38, and false for most others, by
    their last bits in a literal field."""
    sums = set(sums)
    mask = (1 << min(MOST_WIDTH, max(12, (VALUE_BITS * len(sums)).bit_length()))) - 1
    words = [0] * (mask + 1 >> 6)
    for number in sums:
        words[(number & mask) >> 6] |= 1 << (number & 63)
    is_set = bit_test([w - (1 << 64) if w >> 63 else w for w in words])
    return lambda number: is_set(number.bitwiseAND(F.lit(mask).cast("long")))


def listed_values(keys: Column, rows: Iterable[tuple[str, str]]) -> Column:
    """The values that a list of ``(key, value)`` with different keys has for ``keys``,
    in their order. A key is compared with those of equal checksum bits only."""
    rows = list(rows)
    size = 1 << max(0, len(rows) - 1).bit_length()
    places: list[list[dict[str, str]]] = [[] for _ in range(size)]
    for key, value in rows:
        places[zlib.crc32(key.encode()) & size - 1].append({"key": key, "value": value})
    table = constant(places, "array<array<struct<key:string,value:string>>>")

    def of(key: Column) -> Column:
        place = F.element_at(table, (checksum(key).bitwiseAND(F.lit(size - 1).cast("long")) + 1).cast("int"))
        return F.transform(F.filter(place, lambda r: r["key"] == key), lambda r: r["value"])

    return F.flatten(F.transform(keys, of))


#: Per token, 1 if it may be a name, plus 2 if a longer name may begin there.
Marks = Callable[[Column], Column]


def name_marks(
    hashed: Callable[[Column], Column],
    single: Callable[[Column], Column],
    first: Callable[[Column], Column],
    pair: Callable[[Column, Column], Column],
) -> Marks:
    """Marks by the hash of each token, computed once: whether it may be a name, or begin
    one together with the next token."""

    def of(hashes: Column) -> Column:
        return F.transform(
            hashes,
            lambda h, i: F.when(single(h), 1).otherwise(0)
            + F.when((i + 1 < F.size(hashes)) & first(h) & pair(h, F.get(hashes, i + 1)), 2).otherwise(0),
        )

    return lambda tokens: let(F.transform(tokens, hashed), of)


def listed_marks(keys: Iterable[str]) -> Marks:
    """Marks for a list of names, given by their tokens joined by a space."""
    sums = [[zlib.crc32(t.encode()) for t in key.split(" ")] for key in keys]
    joined = lambda one, two: one * 31 + two
    pair = likely_sums(joined(s[0], s[1]) for s in sums if len(s) > 1)
    return name_marks(
        checksum,
        likely_sums(s[0] for s in sums if len(s) == 1),
        likely_sums(s[0] for s in sums if len(s) > 1),
        lambda one, two: pair(joined(one, two)),
    )


def likely_names(
    text: Column,
    lengths: Sequence[int],
    begins: Callable[[Column], Column],
    known: Callable[[Column], Column],
    marks: Marks | None = None,
) -> Column:
    """The different runs of tokens of the given lengths, by first position, shorter runs
    first, whose first token passes ``begins`` and which pass ``known`` themselves. With
    ``marks``, runs are formed only where these allow them."""
    longer = sorted({n for n in lengths if n > 1})
    sizes = constant(longer, "array<int>")
    mark = (1 if 1 in lengths else 0) + (2 if longer else 0)

    def at(tokens: Column, i: Column, mark: Column) -> Column:
        fitting = F.filter(sizes, lambda n: n <= F.size(tokens) - i + 1)
        runs = F.filter(F.transform(fitting, lambda n: F.array_join(F.slice(tokens, i, n), " ")), known)
        single = F.array(F.element_at(tokens, i))
        return F.when(mark == 1, single).when(mark == 2, runs).otherwise(F.concat(single, runs))

    def every(tokens: Column) -> Column:
        return F.transform(tokens, lambda t: F.when(begins(t), mark).otherwise(0))

    def runs(tokens: Column) -> Column:
        placed = F.transform((marks or every)(tokens), lambda m, i: i * 4 + m.bitwiseAND(F.lit(mark)) + 4)
        marked = F.filter(placed, lambda m: m % 4 > 0)
        found = F.flatten(F.transform(marked, lambda m: at(tokens, F.shiftright(m, 2), m % 4)))
        return F.filter(F.array_distinct(found), known)

    return let(name_tokens(text), lambda t: F.when(F.size(t) > 0, runs(t)).otherwise(strings()))
