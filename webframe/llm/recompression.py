"""Recompression of word sequences: rounds that name runs and pairs, and the places where equal windows must agree.

A round first replaces every maximal run of one symbol by one symbol, then every
pair of a left and the following right symbol by one symbol. Which symbols are
left or right, and every new name, is a digest of what the symbols stand for, so
all tasks of a job agree on the names without a dictionary.

With each symbol go the words that its parsing depends on: its own and those of
the neighbours that were looked at. A symbol is *certain* for a window that holds
all of them; equal windows have the same certain symbols, wherever they stand.
:func:`stretches` picks one of them for each window, the one of smallest digest, and
joins neighbouring windows with the same pick.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

#: Rounds; windows of 20 words hold few certain symbols of higher ones.
ROUNDS = 2
#: Windows of one stretch at most.
LONGEST = 64
#: Bytes of text that are cut into words together, and the longest word whose digest is not made on its own.
PIECE, LONG_WORD = 1 << 20, 64

_U = np.uint64
_RUN, _PAIR, _SIDE = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)
#: Multipliers of the two digest lanes, odd and 5 modulo 8.
_LANES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_LAST = _U(2**64 - 1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: What each byte stands for in the digests of words, per lane.
_BYTES = tuple(mix(np.arange(1, 257, dtype=np.uint64) * _U(k)) for k in _LANES)


def word_digests(
    data: np.ndarray, begins: np.ndarray, inside: np.ndarray = ~_SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Words of texts that lie end to end in ``data``, text k from ``begins[k]``; ``inside`` tells the bytes that words are made of.

    Returns where each word starts and ends, its text, and its digests in two lanes.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, (none.view(np.uint64), none.view(np.uint64))
    word = inside[data]
    edge = np.zeros(n + 1, bool)  # a word cannot go on across this place
    edge[begins] = True
    edge[n] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    digests = Digests(tuple(t[data] for t in _BYTES))
    lanes = tuple(digests.of(k, start, end) for k in (0, 1))
    for w in np.flatnonzero(end - start > LONG_WORD):
        whole = xxhash.xxh3_128_intdigest(data[start[w]: end[w]].tobytes())
        lanes[0][w], lanes[1][w] = whole & int(_LAST), whole >> 64
    return start, end, np.searchsorted(begins, start, "right") - 1, lanes


class Digests:
    """Digests of any stretch of a sequence, in two lanes, from prefix sums modulo 2**64."""

    def __init__(self, lanes: tuple[np.ndarray, np.ndarray]):
        self.sums, self.back = [], []
        for values, times in zip(lanes, _LANES, strict=True):
            n = len(values)
            power = _powers(times, n)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power[:n], dtype=np.uint64)]))
            self.back.append(_powers(pow(times, -1, 1 << 64), n))

    def of(self, lane: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        sums = self.sums[lane]
        return mix((sums[end] - sums[start]) * self.back[lane][start] + (end - start).astype(np.uint64) * _SIDE)


_KNOWN: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _KNOWN.get(base)
    if known is None or len(known) <= n:
        size = max(1 << 16, 2 * n + 1)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        known = _KNOWN[base] = np.cumprod(steps, dtype=np.uint64)
    return known[:n + 1]


@dataclass
class Level:
    """Symbols of one round, in order: name, own words [start, end), words [lo, hi) that the parse depends on."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    border: np.ndarray


def words_level(values: np.ndarray, border: np.ndarray) -> Level:
    at = np.arange(len(values))
    return Level(values, at, at + 1, at, at + 1, border)


def next_level(x: Level) -> Level:
    """One round: runs of equal symbols, then pairs of a left and a right symbol. Borders take no part."""
    n = len(x.name)
    new = np.ones(n, bool)
    new[1:] = (x.name[1:] != x.name[:-1]) | x.border[1:] | x.border[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    count = (last - first + 1).astype(np.uint64)
    name = np.where(count > 1, mix((x.name[first] ^ _RUN) + mix(count)), x.name[first])
    lo = np.concatenate([[-1], x.lo[first[1:] - 1]])
    hi = np.append(x.hi[last[:-1] + 1], x.end[-1] + 1)
    start, end, border = x.start[first], x.end[last], x.border[first]
    # pairs
    right = (mix(name ^ _SIDE) >> _U(63)).astype(bool)
    joined = np.zeros(len(name), bool)
    joined[:-1] = ~right[:-1] & right[1:] & ~border[:-1] & ~border[1:]
    taken = np.zeros(len(name), bool)
    taken[1:] = joined[:-1]
    after = np.append(name[1:], _U(0))
    paired = mix(mix(name ^ _PAIR) + after)
    left_of, right_of = np.concatenate([[-1], lo[:-1]]), np.append(hi[1:], x.end[-1] + 1)
    end_of = np.append(end[1:], end[-1:])
    keep = ~taken
    return Level(
        np.where(joined, paired, name)[keep], start[keep], np.where(joined, end_of, end)[keep],
        np.where(right, left_of, lo)[keep], np.where(right, hi, right_of)[keep], border[keep],
    )


def _changes(x: Level) -> Level:
    """Places where a word differs from the one before it, for windows that hold hardly more than a run or two."""
    at = np.flatnonzero((x.name[1:] != x.name[:-1]) & ~x.border[1:] & ~x.border[:-1]) + 1
    name = mix(mix(x.name[at - 1] ^ _PAIR) + x.name[at])
    return Level(name, at - 1, at + 1, at - 1, at + 1, np.zeros(len(at), bool))


def _certain(level: Level, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window start below ``n - size + 1``: first and last symbol that it is certain of (empty: last < first)."""
    starts = n - size + 1
    below = np.cumsum(np.bincount(np.clip(level.lo + 1, 0, n + 1), minlength=n + 2))
    until = np.cumsum(np.bincount(np.clip(level.hi, 0, n + 1), minlength=n + 2))
    p = np.arange(starts)
    return below[p], until[p + size] - 1


def _least(rank: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Place of the smallest rank from i to j, the first of several; from tables of the smallest of 1, 2, 4, ... places."""
    out = np.zeros(len(i), np.int64)
    steps = np.zeros(len(i), np.int64) if not len(i) else np.frexp((j - i + 1).astype(np.float64))[1] - 1
    table, width = np.arange(len(rank)), 1
    for k in range(int(steps.max(initial=-1)) + 1):
        here = np.flatnonzero(steps == k)
        a, b = table[i[here]], table[j[here] - width + 1]
        out[here] = np.where(rank[a] <= rank[b], a, b)
        a, b = table[:-width], table[width:]
        table = np.concatenate([np.where(rank[a] <= rank[b], a, b), table[len(table) - width:]])
        width *= 2
    return out


def stretches(lanes: tuple[np.ndarray, np.ndarray], border: np.ndarray, size: int, rounds: int = ROUNDS, longest: int = LONGEST):
    """``first, count, anchor, key`` of the stretches of windows of a sequence, and its digests.

    ``border`` marks places that no window may hold. Windows ``first`` to
    ``first + count - 1`` share one anchor (a digest of some words that all of them
    hold, in lane 0); the key is a digest of all their words, in lane 1.
    """
    n = len(border)
    digests = Digests(lanes)
    none = np.zeros(0, np.int64)
    if n < size:
        return none, none, none.view(np.uint64), none.view(np.uint64), digests
    blocked = np.concatenate([[0], np.cumsum(border)])
    starts = n - size + 1
    fine = blocked[size:] == blocked[:starts]
    best = np.full(starts, _LAST, np.uint64)
    begin, stop = np.zeros(starts, np.int64), np.zeros(starts, np.int64)
    level = words_level(lanes[0], border)
    changes = _changes(level)
    levels = []
    for _ in range(rounds):
        level = next_level(level)
        levels.append(level)
    for level in [*levels, changes]:
        rank = mix(level.name ^ _RUN)
        rank[level.border] = _LAST
        i, j = _certain(level, n, size)
        chosen = np.flatnonzero((i <= j) & ((best == _LAST) if level is changes else True))
        pick = _least(rank, i[chosen], j[chosen])
        better = rank[pick] < best[chosen]
        chosen, pick = chosen[better], pick[better]
        best[chosen], begin[chosen], stop[chosen] = rank[pick], level.lo[pick], level.hi[pick]
    at = np.flatnonzero(fine)
    if not len(at):
        return none, none, none.view(np.uint64), none.view(np.uint64), digests
    bare = best[at] == _LAST  # one word over and over: the window stands for itself
    lo, hi = np.where(bare, at, begin[at]), np.where(bare, at + size, stop[at])
    anchor = digests.of(0, lo, hi)
    same = np.zeros(len(at), bool)
    same[1:] = (at[1:] == at[:-1] + 1) & (anchor[1:] == anchor[:-1]) & (bare[1:] == bare[:-1]) & (bare[1:] | (lo[1:] == lo[:-1]))
    change = ~same
    # equal windows in a row: the first is a stretch of its own, so that the others repeat it
    change[1:] |= bare[1:] & ~same[:-1]
    run = np.flatnonzero(change)
    place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
    run = np.flatnonzero(place % longest == 0)
    count = np.diff(np.append(run, len(at)))
    first = at[run]
    end = first + count + size - 1
    return first, count, anchor[run], digests.of(1, first, end), digests
