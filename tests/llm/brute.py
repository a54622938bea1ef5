"""Plain Python versions of what the operators compute."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def shingles(text, n=5):
    found = words(text)
    if len(found) < n:
        return Counter([tuple(found)] if found else [])
    return Counter(tuple(found[i : i + n]) for i in range(len(found) - n + 1))


def without_repeats(rows, window):
    """``(doc_id, n_words, n_removed, kept)`` for ``(doc_id, text)`` rows."""
    owner = {}
    for doc_id, text in rows:
        found = words(text)
        for k in range(len(found) - window + 1):
            key = tuple(found[k : k + window])
            owner[key] = min(owner.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        found = words(text)
        gone = set()
        for k in range(len(found) - window + 1):
            if owner[tuple(found[k : k + window])] < doc_id:
                gone.update(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(found) if k not in gone)
        out.append((doc_id, len(found), len(gone), kept))
    return sorted(out)


def near_classes(rows, threshold=0.8, counted=True):
    """``(doc_id, class_id)`` by comparing all texts that share a shingle."""
    sets = [shingles(text) for _, text in rows]
    if not counted:
        sets = [Counter(set(s)) for s in sets]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, own in enumerate(sets):
        near = {j for s in own for j in holders[s]}
        if not own:
            near = {j for j in range(i) if not sets[j] and (rows[j][1] or "") == (rows[i][1] or "")}
        for j in near:
            both, either = sum((own & sets[j]).values()), sum((own | sets[j]).values())
            if not own or both / either >= threshold:
                root[find(i)] = find(j)
        for s in own:
            holders[s].append(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((doc_id, least[find(i)]) for i, (doc_id, _) in enumerate(rows))


def contained(docs, items, threshold=0.8):
    """``(doc_id, item_id)`` where a document has the share of an item's shingles."""
    found = set()
    for item_id, item in items:
        wanted = set(shingles(item))
        short = len(words(item)) if len(words(item)) < 5 else 5
        for doc_id, text in docs:
            own = set(shingles(text, short or 5))
            if wanted and len(wanted & own) >= threshold * len(wanted):
                found.add((doc_id, item_id))
    return found
