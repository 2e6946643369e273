"""Suffix arrays by induced sorting, and permuted common prefixes, with NumPy.

Suffixes are classified as S (smaller than the next) or L.  The leftmost S suffixes (LMS)
are sorted first: one induction sorts their substrings, which gives them names, and where
names repeat the string of names is sorted in the same way, recursively.  From the sorted
LMS suffixes all others are induced.

Over a small alphabet (the bytes of a shard) the induction goes bucket by bucket, in time linear in the
text: a run of equal characters is expanded at once.  Strings of names have about as many
characters as positions; there a bucket each would be a step each, so the chains of
positions that induce one another are sorted together, by doubling.
"""

from __future__ import annotations

import numpy as np

#: Largest alphabet that is induced bucket by bucket.
BUCKETS = 1 << 12


def classify(text: np.ndarray) -> np.ndarray:
    """True for S-type positions; the end of the text is smaller than anything."""
    n = len(text)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    step = np.sign(text[1:].astype(np.int64) - text[:-1])
    change = np.flatnonzero(step)
    # a position's type is that of the first unequal pair at or after it; none: L
    at = np.searchsorted(change, np.arange(n - 1))
    some = at < len(change)
    out[:-1][some] = step[change[at[some]]] > 0
    return out


def _runs_before(text: np.ndarray) -> np.ndarray:
    """For each position, how many equal characters stand directly before it."""
    at = np.arange(len(text))
    first = np.append(True, text[1:] != text[:-1])
    return at - np.maximum.accumulate(np.where(first, at, 0))


def _by_depth(found: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """``found`` - 1 of all with a depth of 1 or more, then ``found`` - 2 of those with 2 or more, and so on."""
    total = int(depth.sum())
    if not total:
        return found[:0]
    who = np.repeat(np.arange(len(found)), depth)
    level = np.arange(total) - np.repeat(np.cumsum(depth) - depth, depth) + 1
    order = np.argsort(level, kind="stable")
    return (found[who] - level)[order]


def _induce_buckets(text: np.ndarray, is_s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All positions in order, given the LMS positions in order; bucket by bucket."""
    n, runs = len(text), _runs_before(text)
    counts = np.bincount(text)
    tails = np.cumsum(counts)
    heads = tails - counts
    used = np.flatnonzero(counts)
    out = np.full(n, -1, np.int64)
    grouped = lms[np.argsort(text[lms], kind="stable")]
    ends = np.cumsum(np.bincount(text[lms], minlength=len(counts)))
    begins = np.append(0, ends[:-1])

    def spread(found: np.ndarray) -> tuple[np.ndarray, ...]:
        """``found`` by character: positions, buckets, sizes and places inside the buckets."""
        c = text[found]
        order = np.argsort(c, kind="stable")
        found, c = found[order], c[order]
        first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        sizes = np.diff(np.append(first, len(c)))
        return found, c[first], sizes, np.arange(len(c)) - np.repeat(first, sizes)

    def before(found: np.ndarray, kind: bool) -> np.ndarray:
        """Predecessors of the given type."""
        found = found[found > 0] - 1
        return found[is_s[found] == kind]

    # L from left to right; the end of the text comes first and precedes the last position
    head = heads.copy()

    def put_left(found: np.ndarray) -> None:
        found, buckets, sizes, place = spread(found)
        out[np.repeat(head[buckets], sizes) + place] = found
        head[buckets] += sizes

    if not is_s[n - 1]:
        put_left(np.array([n - 1]))
    for c in used:
        own = out[heads[c] : head[c]]
        chain = _by_depth(own, runs[own])
        out[head[c] : head[c] + len(chain)] = chain
        head[c] += len(chain)
        every = np.concatenate([out[heads[c] : head[c]], grouped[begins[c] : ends[c]]])
        every = before(every, False)
        every = every[text[every] != c]
        if len(every):
            put_left(every)
    # S from right to left
    tail = tails.copy()

    def put_right(found: np.ndarray) -> None:
        """``found`` in the order of discovery, from the right."""
        found, buckets, sizes, place = spread(found)
        out[np.repeat(tail[buckets], sizes) - 1 - place] = found
        tail[buckets] -= sizes

    for c in used[::-1]:
        own = out[tail[c] : tails[c]][::-1]
        chain = _by_depth(own, runs[own])
        out[tail[c] - len(chain) : tail[c]] = chain[::-1]
        tail[c] -= len(chain)
        every = np.concatenate([out[tail[c] : tails[c]][::-1], out[heads[c] : head[c]][::-1]])
        every = before(every, True)
        every = every[text[every] != c]
        if len(every):
            put_right(every)
    return out


def _sort_chains(text: np.ndarray, members: np.ndarray, exits: np.ndarray, exits_first: bool) -> np.ndarray:
    """``members`` and ``exits`` together in order.

    ``exits`` are in order; the successor of a member is a member, an exit or the end.  Inside a
    character, exits come before or after the members.  Ranks of members are refined by those
    of the positions they reach, one step first, then two, four and so on.
    """
    n = len(text)
    every = np.concatenate([members, exits])
    is_exit = np.arange(len(every)) >= len(members)
    exit_rank = np.concatenate([np.zeros(len(members), np.int64), np.arange(len(exits))])
    order = np.lexsort((exit_rank, is_exit != exits_first, text[every]))
    fresh = np.append(True, (text[every[order]][1:] != text[every[order]][:-1]) | (is_exit[order][1:] | is_exit[order][:-1]))[: len(order)]
    rank = np.zeros(n + 1, np.int64)  # the end has rank 0
    rank[every[order]] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1] + 1
    jump = np.full(n + 1, n)
    jump[members] = members + 1
    jump[exits] = exits
    starts = rank[every[order]]
    while True:
        same = starts[1:] == starts[:-1]
        open_ = np.flatnonzero(np.append(same, False) | np.append(False, same))  # places whose rank is shared
        if not len(open_):
            return every[order]
        who = every[order][open_]
        keys = rank[jump[who]]
        # places of one rank are side by side: sort inside them by the rank reached
        inner = np.lexsort((keys, starts[open_]))
        order[open_] = order[open_][inner]
        groups, keys = starts[open_][inner], keys[inner]
        new = np.append(True, (groups[1:] != groups[:-1]) | (keys[1:] != keys[:-1]))
        starts[open_] = (open_ + 1)[np.flatnonzero(new)[np.cumsum(new) - 1]]
        rank[every[order][open_]] = starts[open_]
        jump[:n] = jump[jump[:n]]


def _induce_chains(text: np.ndarray, is_s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All positions in order, given the LMS positions in order; all buckets at once."""
    exits = lms[np.argsort(text[lms], kind="stable")]
    left = _sort_chains(text, np.flatnonzero(~is_s), exits, False)
    return _sort_chains(text, np.flatnonzero(is_s), left[~is_s[left]], True)


def _names(text: np.ndarray, lms: np.ndarray, by_substring: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings (up to and with the next LMS position), in text order; equal ones are equal."""
    n = len(text)
    size = np.zeros(n, np.int64)
    size[lms] = np.append(lms[1:] + 1, n + 1) - lms
    a, b = by_substring[:-1], by_substring[1:]
    same = (size[a] == size[b]) & (np.maximum(a, b) + size[a] <= n)
    alive, k = np.flatnonzero(same), 0
    while len(alive):
        alive = alive[size[a[alive]] > k]
        differ = text[a[alive] + k] != text[b[alive] + k]
        same[alive[differ]] = False
        alive = alive[~differ]
        k += 1
    names = np.zeros(n, np.int64)
    names[by_substring] = np.append(0, np.cumsum(~same))
    return names[lms]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of ``text`` (non-negative integers) in order."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    is_s = classify(text)
    induce = _induce_buckets if int(text.max()) < BUCKETS else _induce_chains
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if not len(lms):
        return induce(text, is_s, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    by_substring = induce(text, is_s, lms)
    by_substring = by_substring[is_lms[by_substring]]
    names = _names(text, lms, by_substring)
    ordered = by_substring if int(names.max()) == len(lms) - 1 else lms[suffix_array(names)]
    return induce(text, is_s, ordered)


def _common(text: np.ndarray, i: int, j: int) -> int:
    """Length of the common prefix of two suffixes, by blocks of growing size."""
    done, block, limit = 0, 64, len(text) - max(i, j)
    while done < limit:
        block = min(block, limit - done)
        differ = np.flatnonzero(text[i + done : i + done + block] != text[j + done : j + done + block])
        if len(differ):
            return done + int(differ[0])
        done += block
        block *= 4
    return done


def permuted_lcp(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each position, the common prefix with the suffix before it in order.

    Where the characters before both are equal too, the value is that of the position before less
    one; only the others are compared, four characters at a time.
    """
    n = len(text)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    some = (at > 0) & (before > 0)
    follows = np.zeros(n, bool)
    follows[some] = text[at[some] - 1] == text[before[some] - 1]
    own = np.flatnonzero(~follows & (before >= 0))
    # four characters in a word; characters past the end differ from all others
    wide = np.concatenate([text.astype(np.uint64) + np.uint64(1), np.zeros(4, np.uint64)])
    words = wide[:n] | wide[1 : n + 1] << np.uint64(16) | wide[2 : n + 2] << np.uint64(32) | wide[3 : n + 3] << np.uint64(48)
    words = np.append(words, np.zeros(4, np.uint64))
    alive, k = own, 0
    while len(alive):
        if len(alive) < 32:  # few long ones: by blocks
            for i in alive:
                out[i] = k + _common(text, i + k, before[i] + k)
            break
        a, b = alive + k, before[alive] + k
        inside = np.maximum(a, b) < n
        differ = np.ones(len(alive), np.uint64)
        differ[inside] = words[a[inside]] ^ words[b[inside]]
        done = differ != 0
        for j in range(1, 4):  # characters equal in the word where the comparison ends
            out[alive[done & inside]] += (differ[done & inside] & np.uint64((1 << (16 * j)) - 1)) == 0
        out[alive[~done]] += 4
        alive = alive[~done]
        k += 4
    source = np.maximum.accumulate(np.where(follows, 0, at))
    return np.where(follows, out[source] - (at - source), out)
