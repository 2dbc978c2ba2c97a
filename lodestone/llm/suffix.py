"""Suffix arrays of byte buffers in numpy: refinement by rank doubling, Kasai's common prefixes, merging by binary search."""

from __future__ import annotations

import numpy as np


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a big-endian number; zeros stand behind the end."""
    padded = np.concatenate([data, np.zeros(16 + (-len(data)) % 8, np.uint8)])
    out = np.empty(len(data) + (-len(data)) % 8, np.uint64)
    for k in range(8):
        out[k::8] = padded[k : k + len(out)].view(">u8")
    return out[: len(data)]


def sorted_suffixes(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes that start at `at` (ascending positions), ordered by their first `depth` bytes (at least 8); equal ones
    stay in order of position.

    Larsson and Sadakane's refinement: suffixes are sorted by eight bytes, and those with an equal start form a group
    whose number is its members' rank. A round splits each group by the ranks at the distance sorted so far, which
    doubles it; groups of one are never sorted again. The last round's distance makes up exactly `depth`, and a round
    takes only positions that a later one asks for.
    """
    steps, have = [], 8
    while have < depth:
        steps.append(min(2 * have, depth) - have)
        have += steps[-1]
    wanted = [np.zeros(len(words), bool)]
    wanted[0][at] = True
    for off in reversed(steps):
        more = wanted[0].copy()
        more[off:] |= wanted[0][: len(more) - off]
        wanted.insert(0, more)
    order = np.flatnonzero(wanted[0])
    order = order[np.argsort(words[order], kind="stable")]
    rank = np.zeros(len(words), np.int64)
    rank[order] = np.cumsum(_heads(words[order])) - 1
    for off, keep in zip(steps, wanted[1:], strict=True):
        order = order[keep[order]]
        head = _heads(rank[order])
        open_ = np.flatnonzero(~(head & np.append(head[1:], True)))
        mine = order[open_]
        key = (np.cumsum(head[open_]) << 32) | rank[mine + off]
        by = np.argsort(key, kind="stable")
        order[open_] = mine[by]
        head[open_] = _heads(key[by])
        rank[order] = np.cumsum(head) - 1
    return order


def _heads(keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    out = np.ones(len(keys), bool)
    out[1:] = keys[1:] != keys[:-1]
    return out


def common_prefixes(words: np.ndarray, order: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many bytes each suffix of a sorted list shares with the one before it (0 for the first). room: how many
    bytes each suffix of the list has.

    Kasai's rule in text order: where a suffix and its neighbour both follow, by one byte, a suffix and that one's
    neighbour, they share one byte less than those. Only where this breaks are bytes compared, eight at a time.
    """
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    by = np.argsort(order[1:], kind="stable") + 1
    p, q, most = order[by], order[by - 1], np.minimum(room[by], room[by - 1])
    first = np.flatnonzero(np.append(True, (np.diff(p) != 1) | (np.diff(q) != 1)))
    last, shared = np.append(first[1:], len(p)), np.zeros(len(p), np.int64)
    while len(first):
        n = _compared(words, p[first], q[first], most[first])
        ahead = np.minimum(n, last - first - 1)
        run = np.repeat(np.arange(len(first)), ahead + 1)
        step = np.arange(len(run)) - np.repeat(np.cumsum(ahead + 1) - ahead - 1, ahead + 1)
        shared[first[run] + step] = n[run] - step
        first += ahead + 1
        left = first < last
        first, last = first[left], last[left]
    out[by] = shared
    return out


def _compared(words: np.ndarray, p: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many bytes, up to most, the suffixes at p and q share."""
    out, same, off = most.copy(), np.arange(len(p)), 0
    while len(same := same[most[same] > off]):
        differ = words[p[same] + off] ^ words[q[same] + off]
        apart = differ != 0
        byte = (differ[apart].astype(">u8").view(np.uint8).reshape(-1, 8) != 0).argmax(axis=1)
        out[same[apart]] = np.minimum(off + byte, out[same[apart]])
        same, off = same[~apart], off + 8
    return out


def merge(shards: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For sorted distinct strings of fixed length with a value each, shard by shard: the least value that each string
    has in any shard. Every shard's strings are found in the others by binary search."""
    out = [least.copy() for _, least in shards]
    for i, (a, _) in enumerate(shards):
        for j in range(i + 1, len(shards)):
            b = shards[j][0]
            if not len(a) or not len(b):
                continue
            at = np.minimum(np.searchsorted(a, b), len(a) - 1)
            hit = np.flatnonzero(a[at] == b)
            both = np.minimum(out[i][at[hit]], out[j][hit])
            out[i][at[hit]], out[j][hit] = both, both
    return out
