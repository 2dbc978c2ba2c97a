r"""Suffix-array dedup: removes every byte covered by a 50 byte string that also starts in a document with a smaller id.

Texts are dealt into groups by a hash of their id, in one shuffle that all steps read again. What can't repeat is
left out first, and what is left is decided by suffix arrays:

1. anchors: each 50 byte window has an anchor, its 16 byte string of least hash, so equal windows have equal anchors.
   A group sends each distinct anchor once, by hash, with a mark if two of its documents have it.
2. shared: anchors of two documents are sent back to the groups that have them, marked if very many groups do.
3. contexts: a group cuts out the maximal runs of windows around shared anchors, keeps each distinct one once with its
   least document id, and sends it by its anchor's hash: equal windows meet in one place. Runs of a marked anchor are
   cut up by anchors of 32 bytes and sent by those, so that no place gets all contexts of a frequent string.
4. match: equal rows are merged. Rows that share their anchor with others are laid out in shards of bounded size; each gets
   a suffix array by rank doubling, and neighbours whose common prefix (Kasai) has 50 bytes form a class with a least
   document id; the shards' classes are merged by binary search. The ids go back by runs of windows.
5. remove: a group covers the windows of its documents whose class has a smaller id.

So a passage of millions of documents costs each group its anchors and contexts once, not once for each document.

Edge cases: a null text is empty; a document with a null id keeps all and takes nothing from others; rows with one id
don't take from one another; texts under 50 bytes keep all; an empty table gives an empty result; extra columns are
kept by `cut_spans`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from lodestone.llm.common import shuffle_buckets
from lodestone.llm.suffix import common_prefixes, merge, sorted_suffixes, words_at

LENGTH, ANCHOR = 50, 16
#: Anchor positions in a window, and bytes of the longest run of windows with one anchor.
REACH = LENGTH - ANCHOR + 1
RUN = LENGTH + REACH - 1
ROW = RUN + 1 + (-(RUN + 1)) % 8
#: Bytes of text whose windows are computed at a time, and of contexts in one suffix array.
CHUNK, SHARD = 2 << 20, 4 << 20
#: Groups that have an anchor, beyond which its runs are cut up by longer anchors and so go to many places.
CROWD = 1000
WIDE_MARK, FAR = 128, np.uint64(2**64 - 1)
SPANS = ArrayType(StructType([StructField("begin", IntegerType()), StructField("end", IntegerType())]))
PACKED = "to int, back int, payload binary"


def _sliding(x: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f over x[i : i + width] for each i; shorter at the end."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[: len(out) - step] = f(out[: len(out) - step], out[step:]) if len(out) > step else out[: len(out) - step]
        have += step
    return out


def _mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A hash, at least 2 and even, of two words."""
    with np.errstate(over="ignore"):
        z = first * np.uint64(0x9E3779B97F4A7C15)
        z ^= z >> np.uint64(32)
        z += second
        z *= np.uint64(0xD6E8FEB86659FD93)
        z ^= z >> np.uint64(32)
        z *= np.uint64(0xD6E8FEB86659FD93)
        z ^= z >> np.uint64(32)
    return (z | np.uint64(2)) & ~np.uint64(1)


def _anchor_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the ANCHOR bytes from each position on."""
    w = words_at(data)
    second = np.zeros_like(w)
    second[: max(0, len(w) - 8)] = w[8:]
    return _mixed(w, second)


def _hashes_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The same for some positions with ANCHOR bytes behind them."""
    if not len(at):
        return np.empty(0, np.uint64)
    both = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, ANCHOR)[at]).view(">u8").astype(np.uint64)
    return _mixed(both[:, 0], both[:, 1])


class Windows:
    """The windows of some texts laid end to end, and their anchors. part: which texts take part."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, part: np.ndarray):
        h = _anchor_hashes(data)
        ends = np.repeat(np.cumsum(sizes), sizes)
        whole = (np.arange(len(data)) + LENGTH <= ends) & np.repeat(part, sizes)
        self.least = np.where(whole, _sliding(h, REACH, np.minimum), np.uint64(0))
        back = _sliding(self.least[::-1].copy(), REACH, np.maximum)[::-1]
        self.at = np.flatnonzero(back == h)
        self.hash = h[self.at]
        self.whole = whole

    def runs(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last window, and the anchor, of each run of windows with one anchor among the (sorted) shared."""
        if not len(self.at) or not len(shared):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        near = np.minimum(np.searchsorted(shared, self.hash), len(shared) - 1)
        known = shared[near] == self.hash
        p = self._near(self.at[known])
        k = np.searchsorted(self.at, p)
        wrong = np.flatnonzero(self.hash[k] != self.least[p])
        while len(wrong):
            k[wrong] += 1
            wrong = wrong[self.hash[k[wrong]] != self.least[p[wrong]]]
        keep = known[k]
        p, k = p[keep], k[keep]
        if not len(p):
            return p, p, p
        new = np.ones(len(p), bool)
        new[1:] = (k[1:] != k[:-1]) | (p[1:] != p[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(p)) - 1
        return p[first], p[last], self.at[k[first]]

    def _near(self, at: np.ndarray) -> np.ndarray:
        """Whole windows that hold one of some (ascending) anchors."""
        if not len(at):
            return at
        first, last = np.maximum(at - REACH + 1, 0), at + 1
        first[1:] = np.maximum(first[1:], last[:-1])
        n = last - first
        p = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return p[self.whole[p]]


def in_order(table: pa.Table) -> pa.Table:
    """A group's documents by id, then text: a shuffle that is read again gives its rows in another order."""
    by = table.append_column("size", pc.binary_length(table.column("text"))).select(["doc_id", "size"])
    order = pc.sort_indices(by, [("doc_id", "ascending"), ("size", "ascending")])
    table, by = table.take(order), by.take(order)
    same = pc.and_kleene(*(pc.equal(c.slice(1).fill_null(-1), c.slice(0, max(0, len(c) - 1)).fill_null(-1)) for c in by.combine_chunks().columns)) if len(by) > 1 else None
    if same is None or not pc.any(same).as_py():
        return table
    rows = sorted(range(len(table)), key=lambda i, ids=table.column("doc_id").to_pylist(), texts=table.column("text").to_pylist(): (ids[i] is None, ids[i] or 0, texts[i] is not None, texts[i] or ""))
    return table.take(pa.array(rows))


class Group:
    """Documents of one group: their bytes end to end."""

    def __init__(self, table: pa.Table):
        self.table = table = in_order(table)
        self.ids = table.column("doc_id").combine_chunks()
        text = table.column("text").combine_chunks().cast(pa.large_binary()).fill_null(b"")
        edges = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, 8 * text.offset) if len(text) else np.zeros(1, np.int64)
        self.data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
        self.sizes, self.starts = np.diff(edges), edges[:-1] - edges[0]
        #: Documents without an id take no part.
        self.part = self.ids.is_valid().to_numpy(zero_copy_only=False)
        self.id_values = self.ids.fill_null(0).to_numpy()

    def chunks(self) -> Iterator[tuple[int, Windows]]:
        """Where some documents' bytes begin, and their windows."""
        turn = (np.cumsum(self.sizes) - self.sizes) // CHUNK
        for docs in np.split(np.arange(len(self.sizes)), np.flatnonzero(np.diff(turn)) + 1):
            if len(docs) and self.sizes[docs].sum() >= LENGTH:
                start = int(self.starts[docs[0]])
                yield start, Windows(self.data[start : start + int(self.sizes[docs].sum())], self.sizes[docs], self.part[docs])

    def owners(self, at: np.ndarray) -> np.ndarray:
        """The documents that some positions lie in."""
        return np.searchsorted(self.starts, at, side="right") - 1

    def runs(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the runs of windows around shared anchors, in order: where they begin, how many windows, the anchor."""
        found = [(start + first, last - first + 1, anchor + start) for start, windows in self.chunks() for first, last, anchor in [windows.runs(shared)]]
        if not found:
            none = np.empty(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def rows(self, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Runs' texts as rows of a length, bytes, and zeros."""
        out, size = np.zeros((len(begin), ROW), np.uint8), n + LENGTH - 1
        padded = np.concatenate([self.data, np.zeros(RUN, np.uint8)])
        out[:, 1 : RUN + 1] = np.lib.stride_tricks.sliding_window_view(padded, RUN)[begin]
        out[:, 1 : RUN + 1][np.arange(RUN)[None, :] >= size[:, None]] = 0
        out[:, 0] = size
        return out

    def pieces(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What is sent of the runs around known (sorted) anchors, in order: where it begins, how many windows it has,
        the anchor's place in it (plus WIDE_MARK if it is a wide one), and the anchor's hash. A run is sent whole; that of an
        anchor marked as crowded is cut up by the anchors of twice that length in its windows."""
        plain = known & ~np.uint64(1)
        begin, n, anchor = self.runs(plain)
        h = _hashes_at(self.data, anchor)
        crowded = (known[np.searchsorted(plain, h)] & np.uint64(1)).astype(bool) if len(h) else np.empty(0, bool)
        lies = (anchor - begin).astype(np.uint8)
        if not crowded.any():
            return begin, n, lies, h
        short = _anchor_hashes(self.data)
        wide = np.full(len(short), FAR)
        wide[:-ANCHOR] = _mixed(short[:-ANCHOR], short[ANCHOR:])
        least, reach = _sliding(wide, LENGTH - 2 * ANCHOR + 1, np.minimum), LENGTH - 2 * ANCHOR + 1
        many = n[crowded]
        run = np.repeat(np.arange(len(many)), many)
        at = begin[crowded][run] + np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many)
        first = np.flatnonzero(np.append(True, (np.diff(run) != 0) | (least[at[1:]] != least[at[:-1]])))
        cut, size = at[first], np.diff(np.append(first, len(at)))
        place = np.lib.stride_tricks.sliding_window_view(wide, reach)[cut].argmin(axis=1) + WIDE_MARK
        parts = ((begin, cut), (n, size), (lies, place.astype(np.uint8)), (h, least[cut]))
        order = np.argsort(np.concatenate([begin[~crowded], cut]))
        return tuple(np.concatenate([x[~crowded], y])[order] for x, y in parts)


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each distinct row, and each row's number among those. Rows are compared whole where 64 bits agree;
    should two rows differ there, some are named twice, which their users allow."""
    names, words = _names(rows), np.ascontiguousarray(rows).view(np.uint64)
    order = np.argsort(names, kind="stable")
    new = np.ones(len(rows), bool)
    new[1:] = (names[order][1:] != names[order][:-1]) | (words[order[1:]] != words[order[:-1]]).any(axis=1)
    of = np.empty(len(rows), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of


def _packed(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    """Payloads are compressed here, better than the shuffle would: contexts are text, and lie together."""
    to, back, payload = zip(*rows, strict=True) if rows else ((), (), ())
    coder = zstandard.ZstdCompressor(level=3)
    payload = [coder.compress(p) for p in payload]
    return pa.table({"to": pa.array(to, pa.int32()), "back": pa.array(back, pa.int32()), "payload": pa.array(payload, pa.binary())})


def _by_place(place: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Places, and which of some things go there, in a given order."""
    order = order[np.argsort(place[order].astype(np.int32), kind="stable")]
    for which in np.split(order, np.flatnonzero(np.diff(place[order])) + 1) if len(order) else ():
        yield int(place[which[0]]), which


def _place(hashes: np.ndarray, places: int) -> np.ndarray:
    return ((hashes >> np.uint64(33)) % np.uint64(places)).astype(np.int64)


def _payloads(table: pa.Table) -> list[bytes]:
    coder = zstandard.ZstdDecompressor()
    return [coder.decompress(p.as_py()) for p in table.column("payload")]


def _planes(hashes: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte by byte, which packs their leading bytes away."""
    steps = np.diff(hashes, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64)


def anchors(table: pa.Table, places: int) -> pa.Table:
    group, seen = Group(table), []
    for start, windows in group.chunks():
        seen.append((windows.hash, group.id_values[group.owners(windows.at + start)]))
    if not seen:
        return _packed([])
    h, ids = (np.concatenate(x) for x in zip(*seen, strict=True))
    order = np.argsort(h)
    h, ids = h[order], ids[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    several = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
    marked = h[first] | several.astype(np.uint64)
    me = table.column("db")[0].as_py()
    return _packed([(to, me, _planes(marked[which])) for to, which in _by_place(_place(h[first], places), np.arange(len(first)))])


def shared(table: pa.Table, crowd: int) -> pa.Table:
    """Replies: the anchors of a group that two documents have, marked if so many groups have them that their contexts
    would crowd one place."""
    parts, back = [_from_planes(p) for p in _payloads(table)], table.column("back").to_numpy()
    h, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    marked, h = (h & np.uint64(1)).astype(bool), h & ~np.uint64(1)
    order = np.argsort(h)
    first = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
    size = np.diff(np.append(first, len(h)))
    some = np.logical_or.reduceat(marked[order], first) | (size > 1)
    keep, reply = np.empty(len(h), bool), np.empty(len(h), np.uint64)
    keep[order] = np.repeat(some, size)
    reply[order] = h[order] | np.repeat(size > crowd, size).astype(np.uint64)
    return _packed([(int(back[i]), 0, _planes(reply[which])) for i, which in _by_place(owner, np.flatnonzero(keep))])


def _shared_of(table: pa.Table) -> np.ndarray:
    """Sorted, with the marks of crowded ones."""
    return np.sort(np.concatenate([_from_planes(p) for p in _payloads(table)]))


def contexts(table: pa.Table, replies: pa.Table, places: int) -> pa.Table:
    """Payload: n, then least ids, where the row first begins in its group, its anchor's place, whether several ids have
    it, and the rows."""
    if not len(table) or not len(replies):
        return _packed([])
    group = Group(table)
    begin, n, lies, h = group.pieces(_shared_of(replies))
    if not len(begin):
        return _packed([])
    rows, ids = group.rows(begin, n), group.id_values[group.owners(begin)]
    one, of = distinct(rows)
    order = np.argsort(of, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(of[order]) != 0))
    low, high = np.minimum.reduceat(ids[order], first), np.maximum.reduceat(ids[order], first)
    rows, lies, begin, h = rows[one], lies[one], begin[one], h[one]
    start = np.ascontiguousarray(rows[:, 1:9]).view(">u8").ravel().astype(np.uint64)
    me, out = table.column("db")[0].as_py(), []
    for to, w in _by_place(_place(h, places), np.argsort(start)):
        out.append((to, me, len(w).to_bytes(8, "little") + b"".join(x[w].tobytes() for x in (low, begin, lies, low != high, rows))))
    return _packed(out)


def match(table: pa.Table) -> pa.Table:
    """Reply payload: n, then where the row first begins in its group, a least id, and the first (plus WIDE_MARK if the row's
    anchor is a wide one) and last window of the row that have this id."""
    raw, back = _payloads(table), table.column("back").to_numpy()
    sizes = np.array([int.from_bytes(p[:8], "little") for p in raw])
    parts, at = [], 0
    for kind, width in ((np.int64, 8), (np.int64, 8), (np.uint8, 1), (bool, 1), (np.uint8, ROW)):
        parts.append(np.concatenate([np.frombuffer(p, kind, n * width // np.dtype(kind).itemsize, 8 + at * n) for p, n in zip(raw, sizes, strict=True)]))
        at += width
    low, begin, lies, several, rows = parts
    rows, owner = rows.reshape(-1, ROW), np.repeat(np.arange(len(raw)), sizes)
    del raw, parts
    one, of = distinct(rows)
    order = np.argsort(of, kind="stable")
    least = np.minimum.reduceat(low[order], np.flatnonzero(np.append(True, np.diff(of[order]) != 0)))
    # Rows that can't share a window with another are settled; the others' windows go through suffix arrays.
    text = rows[one]
    open_ = np.flatnonzero(_entangled(text, lies[one]))
    step = max(1, SHARD // ROW)
    shards = [_classes(text[open_[k : k + step]], least[open_[k : k + step]]) for k in range(0, len(open_), step)]
    values = merge([(keys, value) for keys, value, _, _ in shards])
    a, b, r, v = (np.empty(0, np.int64) for _ in range(4))
    if shards:
        row = np.concatenate([open_[k * step + w] for k, (_, _, w, _) in enumerate(shards)])
        value = np.concatenate([x[c] for x, (_, _, _, c) in zip(values, shards, strict=True)])
        new = np.append(True, (row[1:] != row[:-1]) | (value[1:] != value[:-1]))
        first, top = np.flatnonzero(new), np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        window = np.arange(len(row)) - np.repeat(top, np.diff(np.append(top, len(row))))
        a, b, r, v = window[first], window[np.append(first[1:], len(row)) - 1], row[first], value[first]
    settled = np.ones(len(one), bool)
    settled[open_] = False
    s = np.flatnonzero(settled)
    a, b = np.concatenate([a, np.zeros(len(s), np.int64)]), np.concatenate([b, text[s, 0].astype(np.int64) - LENGTH])
    r, v = np.concatenate([r, s]), np.concatenate([v, least[s]])
    # What is known of a distinct row, for each group that sent it.
    by = np.argsort(r, kind="stable")
    lo, hi = np.searchsorted(r[by], of, side="left"), np.searchsorted(r[by], of, side="right")
    n = hi - lo
    sent = np.repeat(np.arange(len(of)), n)
    told = by[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    useful = (v[told] < low[sent]) | several[sent]
    sent, told = sent[useful], told[useful]
    out, a, b = [], a.astype(np.uint8), b.astype(np.uint8)
    for i, w in _by_place(owner[sent], np.argsort(begin[sent], kind="stable")):
        out.append((int(back[i]), 0, len(w).to_bytes(8, "little") + b"".join(x.tobytes() for x in (begin[sent[w]], v[told[w]], a[told[w]] | (lies[sent[w]] & WIDE_MARK), b[told[w]]))))
    return _packed(out)


def _entangled(rows: np.ndarray, lies: np.ndarray) -> np.ndarray:
    """Which distinct rows may share a window with another. Such rows have one anchor, and, as a window has 34 bytes beside it,
    the same 16 bytes before the anchor or behind it."""
    flat, wide, lies = rows.ravel(), lies >= WIDE_MARK, (lies % WIDE_MARK).astype(np.int64)
    at = np.arange(len(rows)) * ROW + 1 + lies
    h = _hashes_at(flat, at)
    h[wide] = _mixed(h[wide], _hashes_at(flat, at[wide] + ANCHOR))
    before, behind = ~wide & (lies >= ANCHOR), ~wide & (rows[:, 0] - lies >= 2 * ANCHOR)
    out = np.zeros(len(rows), bool)
    for which, shift in ((wide, 0), (before, -ANCHOR), (behind, ANCHOR)):
        i = np.flatnonzero(which)
        key = _mixed(h[i], _hashes_at(flat, at[i] + shift)) if shift else h[i]
        by = np.argsort(key)
        twin = np.zeros(len(i) + 1, bool)
        twin[1:-1] = key[by][1:] == key[by][:-1]
        out[i[by[twin[:-1] | twin[1:]]]] = True
    return out


def _names(rows: np.ndarray) -> np.ndarray:
    """A 64 bit name of each row's content."""
    out = np.zeros(len(rows), np.uint64)
    with np.errstate(over="ignore"):
        for column in np.ascontiguousarray(rows).view(np.uint64).T:
            out = (out ^ column) * np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(29)
    return out


def _classes(rows: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows of a shard in order with their least ids; then of each window in order of place: its row and class."""
    flat = rows.ravel()
    n = rows[:, 0].astype(np.int64) - LENGTH + 1
    row = np.repeat(np.arange(len(rows)), n)
    window = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = row * ROW + 1 + window
    words = words_at(flat)
    order = sorted_suffixes(words, at, LENGTH)
    which = np.searchsorted(at, order)
    head = common_prefixes(words, order, (n[row] + LENGTH - 1 - window)[which]) < LENGTH
    first = np.flatnonzero(head)
    least = np.minimum.reduceat(low[row[which]], first)
    keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(np.append(flat, np.zeros(LENGTH, np.uint8)), LENGTH)[order[first]]).view(f"S{LENGTH}").ravel()
    of = np.empty(len(at), np.int64)
    of[which] = np.cumsum(head) - 1
    return keys, least, row, of


def joined(begin: np.ndarray, end: np.ndarray, group: Group) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges as the fewest that cover them, in order; none reaches from one document into the next."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    owner = group.owners(begin)
    new = np.ones(len(begin), bool)
    new[1:] = (begin[1:] > end[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return begin[first], end[np.append(first[1:], len(begin)) - 1] if len(first) else end


def removed(group: Group, known: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings and ends of the byte ranges that the replies take from a group."""
    parts = []
    for p in _payloads(known):
        n = int.from_bytes(p[:8], "little")
        parts.append([np.frombuffer(p, kind, n, 8 + k * n) for kind, k in ((np.int64, 0), (np.int64, 8), (np.uint8, 16), (np.uint8, 17))])
    told, least, a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    short = _anchor_hashes(group.data)
    marked = np.lib.stride_tricks.sliding_window_view(short, REACH)[told].min(axis=1) | (a // WIDE_MARK)
    a %= WIDE_MARK
    begin, n, _, _ = group.pieces(np.unique(marked))
    _, of = distinct(group.rows(begin, n))
    text = of[np.searchsorted(begin, told)]
    by = np.argsort(of, kind="stable")
    lo, hi = np.searchsorted(of[by], text, side="left"), np.searchsorted(of[by], text, side="right")
    m = hi - lo
    which = by[np.repeat(lo - (np.cumsum(m) - m), m) + np.arange(m.sum())]
    reply = np.repeat(np.arange(len(told)), m)
    hit = group.id_values[group.owners(begin[which])] > least[reply]
    which, reply = which[hit], reply[hit]
    return joined(begin[which] + a[reply], begin[which] + b[reply] + LENGTH, group)


def remove(table: pa.Table, known: pa.Table) -> pa.Table:
    """The documents, with the spans that the replies in `known` cover and the bytes that they leave."""
    group, none = Group(table), np.empty(0, np.int64)
    begin, end = removed(group, known) if len(table) and len(known) else (none, none)
    owner = group.owners(begin)
    cuts = np.searchsorted(owner, np.arange(len(table) + 1))
    table, spans, kept = group.table, [], []
    for i, (start, size) in enumerate(zip(group.starts.tolist(), group.sizes.tolist(), strict=True)):
        b, e = begin[cuts[i] : cuts[i + 1]].tolist(), end[cuts[i] : cuts[i + 1]].tolist()
        spans.append([{"begin": x - start, "end": y - start} for x, y in zip(b, e, strict=True)])
        kept.append(b"".join([group.data[x:y] for x, y in zip([start, *e], [*b, start + size], strict=True)]))
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    return table.drop_columns(["db"]).append_column("spans", pa.array(spans, kind)).append_column("kept", pa.array(kept, pa.binary()))


def cut_spans(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """docs' columns, then spans (the byte ranges of text that go: begin, and end behind the last) and kept (the bytes that
    stay; a range may begin or end inside a character): a row for each document. Columns of these names are replaced.

    One plan: the shuffle that groups the texts is planned three times and run once (exchange reuse). Other columns ride in it.
    A group is a partition of its own, so that none holds several by chance.
    """
    places = 2 * shuffle_buckets(docs.sparkSession)
    place = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(places)).cast("int")
    others = [c for c in docs.columns if c not in ("doc_id", "text", "spans", "kept")]
    rest = [F.struct(*others).alias("rest")] if others else []
    at = lambda df, column: df.repartitionById(places, F.col(column)).groupBy(column)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", place.alias("db"), *rest)
    sent = at(texts, "db").applyInArrow(lambda t: anchors(t, places), PACKED)
    back = at(sent, "to").applyInArrow(lambda t: shared(t, crowd), PACKED)
    cut = at(texts, "db").cogroup(at(back, "to")).applyInArrow(lambda t, r: contexts(t, r, places), PACKED)
    known = at(cut, "to").applyInArrow(match, PACKED)
    result = texts.drop("db").schema.add("spans", SPANS).add("kept", BinaryType())
    found = at(texts, "db").cogroup(at(known, "to")).applyInArrow(remove, result)
    named = [F.col("rest").getField(c).alias(c) if c in others else F.col(c) for c in docs.columns if c not in ("spans", "kept")]
    return found.select(*named, "spans", "kept")


def deduplicate(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of cut_spans: a row for each document."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return cut_spans(docs.select("doc_id", "text"), crowd).select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
