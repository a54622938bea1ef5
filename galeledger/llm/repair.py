"""Re-Pair grammar compression of token ids, in numpy.

Frequent pairs of neighbours are replaced by new symbols, until no pair is left that
pays for its rule. A round counts the pairs by sorting and replaces many at once: those
that are more frequent than the pairs that overlap them. Of occurrences that overlap
each other, every other one from the left counts. Only pairs that are new since the last
round, or were frequent in it, are counted again: others can't become more frequent. The
sequence is a linked list meanwhile, so a round costs as much as it counts.

Symbols from ``base`` on are rules; a rule is a pair of earlier symbols. With the
expansion length of each rule, any part of the sequence is decoded without decoding the
rest.
"""

from __future__ import annotations

import numpy as np

#: A rule is three stored numbers (a pair and its expansion length), and each use saves
#: one; so rules of fewer uses make the files longer.
LEAST_USES = 4
#: Bits of a symbol and of a place that fit into one sorted number.
_SYMBOL, _PLACE = np.uint64(20), np.uint64(24)


def compress(ids: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence of symbols, rules (n x 2) and expansion length of every rule.

    In the sequence no pair has :data:`LEAST_USES` occurrences that don't overlap.
    """
    sequence = ids.astype(np.uint64)
    n, removed = len(sequence), 0
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    gone, busy = np.zeros(n, bool), np.zeros(n, bool)
    # How frequent the pair at a place is, as a rank; one more place on either side.
    rank_at = np.zeros(n + 2, np.uint32)
    rules: list[np.ndarray] = []
    lengths = np.zeros(0, np.int64)
    at = np.arange(max(n - 1, 0))
    while len(at):
        if removed > n // 4:
            # Close the gaps, so that neighbours are near each other in memory.
            left = ~gone
            at = (np.cumsum(left) - 1)[at]
            sequence = sequence[left]
            n, removed = len(sequence), 0
            after, before = after[:n], before[:n]
            after[:], before[:] = np.arange(1, n + 1), np.arange(-1, n - 1)
            gone, busy, rank_at = np.zeros(n, bool), np.zeros(n, bool), rank_at[: n + 2]
        # At first every place is looked at, one after the other.
        whole = len(at) == n - 1
        follows = after[:-1] if whole else after[at]
        first, then = (sequence[:-1], sequence[1:].copy()) if whole else (sequence[at], sequence[follows])
        odd = _overlapped(first, then, at, follows)
        waiting = at[odd]
        # No symbol is as great, so these count for no pair.
        symbols = base + len(lengths) + 1
        then[odd] = symbols
        pairs, ranks = _ranked(first, then, symbols)
        ranks[odd] = 0
        frequent = np.flatnonzero(ranks)
        if not len(frequent):
            break
        # A pair is replaced where it outranks its neighbours; the first of all always is.
        if whole:
            rank_at[1:n] = ranks
            best = ((ranks > rank_at[: n - 1]) & (ranks > rank_at[2 : n + 1]))[frequent]
            at, ranks, follows = frequent, ranks[frequent], frequent + 1
            waiting_ranks = rank_at[waiting]
            rank_at[:] = 0
        else:
            at, ranks, follows = at[frequent], ranks[frequent], follows[frequent]
            rank_at[at + 1] = ranks
            best = (ranks > rank_at[before[at] + 1]) & (ranks > rank_at[follows + 1])
            waiting_ranks = rank_at[before[waiting] + 1]
            rank_at[at + 1] = 0
        paying = np.bincount(ranks[best], minlength=len(pairs)) >= LEAST_USES
        pays = paying[ranks]
        best &= pays
        made = pairs[paying]
        symbol = (base + len(lengths) + np.cumsum(paying) - 1).astype(np.uint64)
        size = np.ones(made.shape, np.int64)
        deeper = made >= base
        size[deeper] = lengths[made[deeper].astype(np.int64) - base]
        rules.append(made)
        lengths = np.concatenate([lengths, size.sum(axis=1)])
        place, of = [at[best]], [ranks[best]]
        busy[place[0]] = busy[follows[best]] = True
        # Where such a pair still stands untouched, it is replaced too.
        more = pays & ~best
        late = paying[waiting_ranks]
        rest, rest_ranks = np.concatenate([at[more], waiting[late]]), np.concatenate([ranks[more], waiting_ranks[late]])
        while len(rest):
            free = ~(busy[rest] | busy[after[rest]])
            rest, rest_ranks = rest[free], rest_ranks[free]
            rank_at[rest + 1] = rest_ranks
            top = (rest_ranks > rank_at[before[rest] + 1]) & (rest_ranks >= rank_at[after[rest] + 1])
            rank_at[rest + 1] = 0
            place.append(rest[top])
            of.append(rest_ranks[top])
            busy[rest[top]] = busy[after[rest[top]]] = True
            rest, rest_ranks = rest[~top], rest_ranks[~top]
        place, of = np.concatenate(place), np.concatenate(of)
        second = after[place]
        busy[place] = False
        sequence[place] = symbol[of]
        gone[second] = True
        removed += len(second)
        follows = after[second]
        after[place] = follows
        inside = follows < n
        before[follows[inside]] = place[inside]
        left = before[place]
        at = _ascending(np.concatenate([at[~best], waiting, place, left[left >= 0]]), gone)
        at = at[:-1] if len(at) and after[at[-1]] == n else at
    flat = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    return sequence[~gone].astype(np.uint32), flat, lengths


def _ascending(at: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """The places that are left, each once, in order."""
    if len(at) > len(gone) // 32:
        mark = np.zeros(len(gone), bool)
        mark[at] = True
        mark &= ~gone
        return np.flatnonzero(mark)
    at = np.sort(at[~gone[at]])
    return at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at


def _overlapped(first: np.ndarray, then: np.ndarray, at: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Which pairs of one symbol overlap an occurrence that counts."""
    equal = np.flatnonzero(first == then)
    joined = np.zeros(len(equal), bool)
    joined[1:] = (follows[equal[:-1]] == at[equal[1:]]) & (first[equal[1:]] == first[equal[:-1]])
    number = np.arange(len(equal))
    return equal[(number - np.maximum.accumulate(np.where(joined, 0, number))) % 2 == 1]


def _ranked(first: np.ndarray, then: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent pairs by rank (rarest first, none at 0), and the rank of each place."""
    order, key = _sorted(first, then, symbols)
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(begin, len(key)))
    often = np.flatnonzero(count >= LEAST_USES)
    by_count = often[np.argsort(count[often], kind="stable")]
    rank = np.zeros(len(count), np.uint32)
    rank[by_count] = np.arange(1, len(by_count) + 1)
    ranks = np.empty(len(first), np.uint32)
    ranks[order] = np.repeat(rank, count)
    some = order[begin[by_count]]
    pairs = np.zeros((len(by_count) + 1, 2), np.uint32)
    pairs[1:, 0], pairs[1:, 1] = first[some], then[some]
    return pairs, ranks


def _sorted(first: np.ndarray, then: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the pairs, and a key of each in it. Small symbols and places are sorted
    as one number, which is several times faster."""
    if symbols >= 1 << int(_SYMBOL) or len(first) > 1 << int(_PLACE):
        key = (first << np.uint64(32)) | then
        order = np.argsort(key, kind="stable")
        return order, key[order]
    whole = first << _SYMBOL
    whole |= then
    whole <<= _PLACE
    whole |= np.arange(len(first), dtype=np.uint64)
    whole.sort()
    order = (whole & np.uint64((1 << int(_PLACE)) - 1)).astype(np.int64)
    whole >>= _PLACE
    return order, whole


def expand(
    sequence: np.ndarray, rules: np.ndarray, base: int, lengths: np.ndarray | None = None
) -> np.ndarray:
    """The ids of a sequence of symbols. With the rules' expansion lengths, the rules are
    expanded once and copied from there."""
    if lengths is not None and len(lengths):
        return _copied(sequence, rules, base, lengths)
    out = sequence.astype(np.uint32)
    while True:
        made = out >= base
        number = int(np.count_nonzero(made))
        if not number:
            return out
        place = np.arange(len(out)) + np.cumsum(made) - made
        longer = np.empty(len(out) + number, np.uint32)
        longer[place[~made]] = out[~made]
        pair = rules[out[made] - base]
        longer[place[made]] = pair[:, 0]
        longer[place[made] + 1] = pair[:, 1]
        out = longer


def _copied(sequence, rules, base, lengths) -> np.ndarray:
    """Every symbol copied from a table of all ids and the expansions of all rules."""
    table = np.concatenate([
        np.arange(base, dtype=np.uint32), expand(np.arange(base, base + len(rules)), rules, base)
    ])
    begin = np.concatenate([np.arange(base), base + np.cumsum(lengths) - lengths])
    size = np.concatenate([np.ones(base, np.int64), lengths])[sequence]
    ends = np.cumsum(size)
    at = np.repeat(begin[sequence] - ends + size, size)
    at += np.arange(len(at))
    return table[at]


def decode(
    sequence: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int, start: int, stop: int
) -> np.ndarray:
    """Ids ``start`` to ``stop`` of the expansion, from the symbols that cover them."""
    stop = max(start, stop)
    size = np.ones(len(sequence), np.int64)
    made = sequence >= base
    size[made] = lengths[sequence[made] - base]
    ends = np.cumsum(size)
    a = int(np.searchsorted(ends, start, side="right"))
    b = int(np.searchsorted(ends, stop, side="left")) + 1
    before = int(ends[a - 1]) if a else 0
    return expand(sequence[a:b], rules, base)[start - before : stop - before]
