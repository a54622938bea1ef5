"""Decontamination, mixing and licence scans."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from galeledger.llm import decontaminate, licenses, mixing
from tests.llm import brute

LAST = (1 << 63) - 1


def pairs(frame):
    return {(r.doc_id, r.item_id) for r in frame.collect()}


def test_contamination_equals_brute_force(table):
    rnd = random.Random(8)
    make = lambda n: [f"w{rnd.randrange(400)}" for _ in range(n)]
    items = [(k, make(n)) for k, n in enumerate([5, 6, 7, 8, 9, 12, 20, 30, 31, 59, 130] * 2)]
    docs = []
    for i in range(80):
        text = make(rnd.randint(0, 300))
        if i % 2:
            item = list(rnd.choice(items)[1])
            if i % 4 == 1 and len(item) > 20:
                item[rnd.randrange(len(item))] = "changed"
            if i % 8 == 3:
                item = item[: len(item) // 2]
            at = rnd.randint(0, len(text))
            text = text[:at] + item + text[at:]
        docs.append((i, " ".join(text)))
    items = [(k, " ".join(t)) for k, t in items]
    frame = table(items, "item_id long, text string")
    got = decontaminate.contaminated(table(docs), frame)
    assert pairs(got) == brute.contained(docs, items) and len(pairs(got)) > 20
    for row in got.collect():
        assert row.n_shared / row.n_shingles == row.containment >= 0.8
    clean = decontaminate.without_contaminated(table(docs), frame)
    bad = {i for i, _ in pairs(got)}
    assert sorted(r.doc_id for r in clean.collect()) == [i for i, _ in docs if i not in bad]


def test_contamination_of_odd_rows(table, odd_rows):
    items = [(1, "one two three four five six seven"), (1, "x"), (2, None), (3, ""), (None, "two three four five six")]
    frame = table(items, "item_id long, text string").withColumn("keys", F.lit(1))
    docs = table(odd_rows).withColumn("segment", F.lit(1)).withColumn("own_id", F.lit("o"))
    assert pairs(decontaminate.contaminated(docs, frame)) == {(1, 1), (LAST, 1), (1, None), (LAST, None), (7, 1)}
    clean = decontaminate.without_contaminated(docs, frame)
    assert clean.columns == docs.columns
    # Of the rows with id 1 and without id, those that hold nothing stay.
    left = sorted(str(r.doc_id) for r in clean.collect())
    assert left == sorted(map(str, [1, 2, 3, 4, None, 5, 6]))
    assert decontaminate.contaminated(docs, frame.limit(0)).collect() == []
    assert decontaminate.contaminated(docs.limit(0), frame).collect() == []
    assert decontaminate.without_contaminated(docs, frame.limit(0)).count() == len(odd_rows)


MIT = licenses._SHORT["MIT"]


@pytest.mark.parametrize(
    "notice",
    [
        "Copyright (c) 2020 The Foo Authors", "Copyright The Foo Authors", "Copyright FOO GMBH",
        "Copyright Joyent, Inc. and other Node contributors. All rights reserved.",
        "Copyright (c) 2020 Foo, Bar and Permissive Labs", "Copyright (c) 2018 Distributed Systems Ltd",
        "Copyright © " + " ".join(f"Holder{i}" for i in range(45)), "(c) 2019 licence lovers <me@example.org>",
        "// Copyright 2019-2021 someone, somewhere (https://example.org)\r", "Copyright (C) <year> <name>",
        "Copyright " + " ".join(f"Holder{i}" for i in range(20_000)), "# Copyright 2001 A\n# Copyright 2002 B",
    ],
)
def test_notices_are_left_out(spark, table, notice):
    """A whole licence file is found whoever holds it, and on one line too."""
    texts = [f"MIT License\n\n{notice}\n\n{MIT}", f"{notice}\n{MIT}"]
    if re.search(r"\b20\d\d|©", notice) and "\n" not in notice:
        texts.append(notice + " " + MIT.replace("\n", " "))
    found = licenses.scan(table(list(enumerate(texts))), licenses.known_licenses(spark)).collect()
    assert [r.license for r in found] == ["MIT"] * len(texts)


def test_other_words_about_copyright_stay(table):
    lines = [
        "Copyright law protects works of 2020.", "Copyright and Similar Rights means rights", "(c) an item of a list",
        '"Copyright Holder" means the individual', "The copyright (c) of 2020 is theirs", "Copyright", "copyright foo",
    ]
    rows = table(list(enumerate(lines))).select("doc_id", "text", licenses.canonical(F.col("text")).alias("form"))
    for r in rows.collect():
        assert r.form == " ".join(re.findall(r"[^\W_]+", r.text.lower()))


def test_short_items_inside_long_documents(table):
    rnd = random.Random(23)
    other = lambda n: [f"o{rnd.randrange(50)}" for _ in range(n)]
    items = [(1, "four word test item"), (2, "item"), (3, "two words"), (4, "five words are one shingle"), (5, "o1 o2")]
    docs = [(0, "four word test"), (1, "item"), (2, ""), (3, "word test item two words")]
    for k, (_, item) in enumerate(items * 6):
        docs.append((10 + k, " ".join(other(k * 20) + item.split() + other(300))))
        docs.append((100 + k, " ".join(other(30) + item.split()[1:] + other(5) + item.split()[:1])))
    got = pairs(decontaminate.contaminated(table(docs), table(items, "item_id long, text string")))
    assert got == brute.contained(docs, items) and {i for _, i in got} == {1, 2, 3, 4, 5}


def test_rows_are_dropped_by_their_text(table):
    item = "this is the text of an item that is looked for"
    docs = [(1, item), (1, "clean"), (1, "clean"), (None, item), (None, "clean too"), (2, f"before {item} after")]
    clean = decontaminate.without_contaminated(table(docs), table([(1, item)], "item_id long, text string"))
    assert sorted(map(tuple, clean.collect()), key=str) == [(1, "clean"), (1, "clean"), (None, "clean too")]


def test_sketches_have_the_size_of_their_class(table):
    rnd = random.Random(3)
    sets = [(k, n, [rnd.getrandbits(60) for _ in range(n)]) for k, n in enumerate([1, 2, 3, 7, 8, 15, 16, 40, 100])]
    frame = table(sets, "set_id long, n_shingles long, shingles array<long>")
    found = {}
    for r in decontaminate._sketches(frame, 0.8).collect():
        found.setdefault(r.set_id, []).append(r.need)
    for k, n, _ in sets:
        small = 1 << (n.bit_length() - 1)
        large = 2 * small - 1
        need = min(-(-8 * small // 10), 4)
        # A document with 80 % of any item of the class holds so many of the sketch.
        assert len(found[k]) == min(n, large - -(-8 * large // 10) + need) and set(found[k]) == {need}
        assert len(found[k]) - (n - -(-8 * n // 10)) >= need


def test_contamination_by_items_that_are_spread(table):
    """Question, answer and parts of an item with other text between them."""
    rnd = random.Random(17)
    other = lambda n: [f"o{rnd.randrange(10 ** 6)}" for _ in range(n)]
    items, docs = [], []
    for k, n in enumerate([20, 34, 59, 66, 90, 130, 300] * 6):
        item = [f"w{rnd.randrange(10 ** 6)}" for _ in range(n)]
        cut = rnd.randint(n // 3, n // 2)
        gap = (1, n // 2, 5 * n)[k % 3]
        items.append((k, " ".join(item)))
        docs.append((k, " ".join(other(k) + item[:cut] + other(gap) + item[cut:] + other(40))))
        docs.append((1000 + k, " ".join(other(k) + item[cut:] + other(gap) + item[:cut])))
        docs.append((2000 + k, " ".join(other(k) + item[: int(0.7 * n)] + other(gap))))
    got = pairs(decontaminate.contaminated(table(docs), table(items, "item_id long, text string")))
    assert got == brute.contained(docs, items) and len(got) > 70


def test_contamination_by_repetitive_items(table):
    """Items of 56 shingles of which six are distinct."""
    items, docs = [], []
    for k in range(80):
        cycle = [f"r{k}x{i}" for i in range(6)]
        text = [cycle[i % 6] for i in range(60)]
        items.append((k, " ".join(text)))
        other = [f"o{k}x{i}" for i in range(400)]
        docs.append((k, " ".join(other[:200] + text[:10] + other[200:])))
    got = pairs(decontaminate.contaminated(table(docs), table(items, "item_id long, text string")))
    assert got == brute.contained(docs, items) and len(got) == 80


def levels():
    return [(name, F.col(name)) for name in ("domain", "lang", "source")]


SCHEMA = "doc_id long, text string, domain string, lang string, source string"


def share_out(budget, children):
    """``{child: budget}`` for ``{child: (limit, weight)}`` by raising the level bit by bit."""
    out = dict.fromkeys(children, 0.0)
    todo = {c for c, (_, w) in children.items() if w}
    left = budget
    while todo and left > 1e-9:
        weight = sum(children[c][1] for c in todo)
        full = [c for c in todo if children[c][0] - out[c] <= left * children[c][1] / weight + 1e-12]
        if not full:
            for c in todo:
                out[c] += left * children[c][1] / weight
            return out
        for c in full:
            left -= children[c][0] - out[c]
            out[c] = children[c][0]
        todo -= set(full)
    return out


def brute_mix(rows, weights, share, epochs, seed):
    leaves = defaultdict(list)
    for doc_id, text, *path in rows:
        leaves[tuple(p or "" for p in path)].append((doc_id, len(brute.words(text))))
    tokens = {leaf: sum(n for _, n in docs) for leaf, docs in leaves.items()}
    budget = {(): float(int(sum(tokens.values()) * share))}
    for depth, level in enumerate(("domain", "lang", "source"), 1):
        below = defaultdict(lambda: defaultdict(int))
        for leaf, n in tokens.items():
            below[leaf[: depth - 1]][leaf[:depth]] += n * epochs
        for parent, children in below.items():
            given = {c: (n, weights.get((level, c[-1]), 1)) for c, n in children.items()}
            budget |= share_out(budget.get(parent, 0.0), given)
    out = []
    for leaf, docs in leaves.items():
        full = int(budget[leaf] / tokens[leaf] + 1e-9) if tokens[leaf] else 0
        rest = int(budget[leaf] - full * tokens[leaf] + 1e-9)
        order = sorted((hashlib.md5(f"{seed}:{full + 1}:{i}".encode()).hexdigest(), i, n) for i, n in docs)
        begun = 0
        for _, i, n in order:
            out += [(i, e) for e in range(1, full + (begun < rest) + 1)]
            begun += n
    return sorted(out)


@pytest.mark.parametrize("share, epochs", [(1.0, 2), (0.4, 1), (1.7, 2), (5.0, 3)])
def test_mixing_equals_brute_force(table, monkeypatch, share, epochs):
    rnd = random.Random(11)
    rows = []
    for i in range(300):
        hot = i % 3 == 0
        path = ("d0", "en", "s0") if hot else (f"d{rnd.randrange(3)}", rnd.choice(["en", "de", None]), f"s{rnd.randrange(4)}")
        rows.append((i, " ".join(["w"] * rnd.randint(0, 20)), *path))
    weights = {("domain", "d1"): 3, ("lang", "en"): 2, ("source", "s3"): 0}
    monkeypatch.setattr(mixing, "SLICE_ROWS", 7)
    docs = table(rows, SCHEMA).withColumn("place", F.lit(1)).withColumn("__id", F.lit("x"))
    chosen = mixing.mix(docs, levels(), weights, share=share, epochs=epochs, seed="s")
    assert chosen.columns == [*docs.columns, "mix_epoch"]
    got = sorted((r.doc_id, r.mix_epoch) for r in chosen.collect())
    assert got == brute_mix(rows, weights, share, epochs, "s")


def test_shortage_goes_to_siblings_first(table):
    """A short source's budget stays in its language, a short language's in its domain."""
    one = [(i, "w " * 10, "a", "en", "s1") for i in range(2)]
    two = [(10 + i, "w " * 10, "a", "en", "s2") for i in range(50)]
    other = [(100 + i, "w " * 10, "b", "en", "s3") for i in range(50)]
    docs = table(one + two + other, SCHEMA)
    got = mixing.mix(docs, levels(), total=400, epochs=1).collect()
    assert sum(r.domain == "a" for r in got) == 20 and sum(r.source == "s1" for r in got) == 2
    got = mixing.mix(docs, levels(), total=800, epochs=1).collect()
    assert sum(r.domain == "a" for r in got) == 40


def test_mixing_odd_rows(table, odd_rows):
    rows = [(i, t, None, None, None) for i, t in odd_rows]
    docs = table(rows, SCHEMA).withColumn("mix_epoch", F.lit("old"))
    everything = mixing.mix(docs, levels(), share=9.0, epochs=1)
    assert everything.count() == len(rows) and {r.mix_epoch for r in everything.collect()} == {1}
    assert mixing.mix(docs.limit(0), levels()).collect() == []
    assert mixing.mix(docs.filter("text IS NULL"), levels()).collect() == []


def test_license_digests(table, spark):
    mit = licenses.LICENSES["MIT"]
    rows = [
        (1, "Copyright (c) 2020 Somebody\n\n" + mit),
        (2, mit.upper().replace("SUBLICENSE", "SUBLICENCE").replace("\n", " ")),
        (3, mit + " and more"),
        (4, "text\n  Released under the MIT Licence!\nmore\nReleased under the MIT License."),
        (5, None),
        (6, ""),
        (6, ""),
        (None, "Licensed under CC BY 4.0."),
        (7, "!!!\n---"),
    ]
    docs = table(rows).withColumn("license", F.lit(1)).withColumn("known", F.lit(2))
    got = sorted(licenses.scan(docs, licenses.known_licenses(spark)).collect(), key=str)
    assert len(got) == len(rows)
    found = {r.doc_id: (r.license, r.notices) for r in got}
    assert found[1] == ("MIT", []) and found[2] == ("MIT", ["MIT"]) and found[3] == (None, [])
    assert found[4] == (None, ["MIT-notice"]) and found[None] == ("CC-BY-4.0", ["CC-BY-4.0"])
    assert found[5] == found[6] == found[7] == (None, [])


def test_license_table_with_odd_rows(spark, table):
    known = table([("b", "Same  text"), ("a", "same text."), (None, "x"), ("c", None), ("d", "--")], "license string, text string")
    docs = table([(1, "SAME TEXT"), (2, "x"), (3, "--")])
    assert {(r.doc_id, r.license) for r in licenses.scan(docs, known).collect()} == {(1, "a"), (2, None), (3, None)}
    assert licenses.scan(docs, known.limit(0)).count() == 3
    assert licenses.scan(docs.limit(0), known).collect() == []


def published(name):
    return (Path(licenses.__file__).parent / "license_texts" / f"{name}.txt").read_text()


def test_whole_license_files(table, spark):
    """Files as they are commonly found: titles, holders, other line lengths."""
    mit, isc = licenses.LICENSES["MIT"], licenses.LICENSES["ISC"]
    apache = published("Apache-2.0")
    bsd = next(t for n, t in licenses.LICENSES.items() if n == "BSD-3-Clause")
    files = {
        "MIT": ["MIT License\n\nCopyright (c) 2020 Some Body\n\n" + mit, "The MIT License (MIT)\n\n" + mit],
        "ISC": ["ISC License\n\nCopyright (c) 2021, Some Body\n\n" + isc],
        "Apache-2.0": [
            apache,
            apache.replace("[yyyy] [name of copyright owner]", "2019 Some Body"),
            apache[: apache.index("   APPENDIX")],
            apache[apache.rindex("   Licensed under the") :],
        ],
        "BSD-3-Clause": ["BSD 3-Clause License\n\nCopyright (c) 2015, Some Body\nAll rights reserved.\n\n" + bsd],
    }
    files |= {n: [published(n)] for n in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "CC-BY-SA-4.0", "Unlicense")}
    wanted = dict(enumerate(name for name, texts in files.items() for _ in texts))
    docs = table(list(enumerate(text for texts in files.values() for text in texts)))
    got = licenses.scan(docs, licenses.known_licenses(spark)).collect()
    assert {r.doc_id: r.license for r in got} == wanted


def test_only_the_copyright_notice_is_removed(table, spark):
    mit = " ".join(licenses.LICENSES["MIT"].split())
    texts = [
        "Copyright 2020 Foo. Licensed under CC BY 4.0.",
        "Copyright (c) 2020 Foo Bar, Inc. " + mit,
        "Copyright (c) 2019-2021 Foo Bar " + mit,
        "© 2020 Foo Bar <foo@bar.org>. All rights reserved.\n" + mit,
        mit.replace("OR COPYRIGHT", "OR\nCOPYRIGHT").replace("above copyright", "above\ncopyright"),
        "Copyright reform passed the vote",
        "Copyright reform failed",
        "(c) a third item",
        "(c) another item",
    ]
    got = sorted(licenses.scan(table(list(enumerate(texts))), licenses.known_licenses(spark)).collect())
    assert [r.license for r in got] == ["CC-BY-4.0"] + ["MIT"] * 4 + [None] * 4
    assert len({r.digest for r in got}) == 6
