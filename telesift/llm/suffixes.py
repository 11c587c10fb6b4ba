"""Suffix sorting of one shard by external induced sorting, with common prefixes."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np

BLOCK = 1 << 18
#: Shorter strings of names are sorted by doubling, longer ones by another level of induction.
INNER = 1 << 22
LOW = np.int64(255)
#: Symbols that are compared at a time; so many more than its own a text should hold.
PAD = 8


def room(n: int, dtype, memory: int) -> np.ndarray:
    """An array of n, on disk if it is larger than `memory` items.  The file has no name, so nothing stays behind."""
    return np.zeros(n, dtype) if n <= memory else np.memmap(tempfile.TemporaryFile(), dtype, "w+", shape=(n,))


class DiskQueue:
    """A priority queue of suffix tuples by symbol; those of one symbol leave in the order in which they came.

    A tuple is suffix << 8 | common prefix with the tuple before it.  Beyond `memory` tuples, what is held goes to disk
    as a run sorted by symbol.
    """

    def __init__(self, memory: int):
        self.memory, self.size = memory, 0
        self.held: dict[int, list[np.ndarray]] = {}
        self.runs: list[dict[int, tuple[int, int]]] = []
        self.file = None

    def push(self, symbol: int, items: np.ndarray) -> None:
        self.held.setdefault(symbol, []).append(items)
        self.size += len(items)
        if self.size > self.memory:
            self.file = self.file or tempfile.TemporaryFile()
            at, index = self.file.seek(0, 2), {}
            for s in sorted(self.held):
                begin = at
                for x in self.held[s]:
                    at += self.file.write(x.tobytes())
                index[s] = begin, (at - begin) // 8
            self.runs.append(index)
            self.held, self.size = {}, 0

    def stored(self, at: int, n: int, back: bool) -> Iterator[np.ndarray]:
        for k in range(0, n, BLOCK)[:: -1 if back else 1]:
            self.file.seek(at + 8 * k)
            yield np.frombuffer(self.file.read(8 * min(BLOCK, n - k)), np.int64)

    def read(self, symbol: int, back: bool = False) -> Iterator[np.ndarray]:
        """The tuples of a symbol in blocks; back: the last comes first."""
        runs = [r[symbol] for r in self.runs if symbol in r]
        held = self.held.get(symbol, [])
        if back:
            yield from (x[::-1] for x in reversed(held))
            for at, n in reversed(runs):
                yield from (x[::-1] for x in self.stored(at, n, True))
        else:
            for at, n in runs:
                yield from self.stored(at, n, False)
            yield from held

    def pop(self, symbol: int) -> Iterator[np.ndarray]:
        """Takes out the tuples of a symbol, and those that are pushed for it meanwhile."""
        while True:
            runs = [r.pop(symbol) for r in self.runs if symbol in r]
            held = self.held.pop(symbol, [])
            if not runs and not held:
                return
            self.size -= sum(map(len, held))
            for at, n in runs:
                yield from self.stored(at, n, False)
            if held:
                yield np.concatenate(held)


def range_min(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(x[lo:hi]) for each pair, from minima over powers of two."""
    power = np.frexp((hi - lo).astype(np.float64))[1] - 1
    out = np.empty(len(lo), x.dtype)
    for j in range(int(power.max()) + 1):
        size = 1 << j
        m = np.flatnonzero(power == j)
        out[m] = np.minimum(x[lo[m]], x[hi[m] - size])
        x = np.minimum(x[:-size], x[size:])
    return out


class Scan:
    """Pushes, for suffixes that are met in order, those that are one symbol longer."""

    def __init__(self, text: np.ndarray, symbols: int, queue: DiskQueue, most: int | None):
        self.text, self.queue, self.most = text, queue, most
        # the least common prefix met since the last push of each symbol
        self.since = None if most is None else np.zeros(symbols, np.uint8)

    def feed(self, items: np.ndarray, wanted: Callable[[np.ndarray], np.ndarray]) -> None:
        at = items >> 8
        symbol = self.text[np.maximum(at - 1, 0)]
        found = np.flatnonzero((at > 0) & wanted(symbol))
        order = found[np.argsort(symbol[found], kind="stable")]
        s = symbol[order]
        begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
        new = at[order] - 1 << 8
        if self.since is not None:
            common = (items & LOW).astype(np.uint8)
            if len(s):
                lo = np.concatenate([[0], order[:-1] + 1])
                lo[begin] = 0
                least = range_min(common, lo, order + 1)
                least[begin] = np.minimum(least[begin], self.since[s[begin]])
                new |= np.minimum(least.astype(np.int64) + 1, self.most)
            np.minimum(self.since, common.min(), out=self.since)
            if len(s):
                rest = np.append(np.minimum.accumulate(common[::-1])[::-1], np.uint8(255))
                last = order[np.append(begin[1:], len(s)) - 1]
                self.since[s[begin]] = rest[last + 1]
        for a, b in zip(begin.tolist(), np.append(begin[1:], len(s)).tolist(), strict=False):
            self.queue.push(int(s[a]), new[a:b])


def stretch(text: np.ndarray, at: int, most: int) -> int:
    """How often the symbol at a place follows itself, `most` at most."""
    x = text[at : at + most]
    other = np.flatnonzero(x != x[0])
    return int(other[0]) if len(other) else len(x)


def turned(blocks: Iterator[np.ndarray], head: int) -> Iterator[np.ndarray]:
    """Blocks read from the back: each common prefix moves to the tuple on its other side, head comes to the first."""
    for block in blocks:
        common = block & LOW
        yield block & ~LOW | np.concatenate([[np.int64(head)], common[:-1]])
        head = int(common[-1])


def headed(blocks: Iterator[np.ndarray], head: int) -> Iterator[np.ndarray]:
    """Blocks whose first tuple has the common prefix head."""
    for i, block in enumerate(blocks):
        yield block if i else np.concatenate([block[:1] & ~LOW | head, block[1:]])


def induce(text: np.ndarray, n: int, symbols: int, seeds: DiskQueue, most: int | None, memory: int) -> Iterator[np.ndarray]:
    """All suffixes in order, from the leftmost-smaller ones (seeds) in order.

    Upwards, every suffix that is larger than its successor follows from that one; downwards, every smaller one does.
    Common prefixes (up to `most`) are one more than the least between the two sources; where larger and smaller
    suffixes of one symbol meet, they share the shorter of the two stretches of that symbol.
    """
    up, down, larger, smaller = (DiskQueue(memory) for _ in range(4))

    def meet(a: int, b: int) -> int:
        return 0 if most is None or a < 0 or b < 0 else min(stretch(text, a, most), stretch(text, b, most))

    def first(blocks: Iterator[np.ndarray]) -> int:
        return next((int(x[0] >> 8) for x in blocks), -1)

    scan = Scan(text, symbols, up, most)
    up.push(int(text[n - 1]), np.array([n - 1 << 8], np.int64))
    for c in range(symbols):
        last = -1
        for block in headed(up.pop(c), 0):
            larger.push(c, block)
            scan.feed(block, lambda s: s >= c)
            last = int(block[-1] >> 8)
        for block in headed(seeds.read(c), meet(last, first(seeds.read(c)))):
            scan.feed(block, lambda s: s > c)
    scan = Scan(text, symbols, down, most)
    for c in reversed(range(symbols)):
        last = -1
        for block in headed(down.pop(c), 0):
            smaller.push(c, block)
            scan.feed(block, lambda s: s <= c)
            last = int(block[-1] >> 8)
        for block in turned(larger.read(c, back=True), meet(last, first(larger.read(c, back=True)))):
            scan.feed(block, lambda s: s < c)
    for c in range(symbols):
        last = -1
        for block in larger.read(c):
            yield block
            last = int(block[-1] >> 8)
        yield from turned(smaller.read(c, back=True), meet(last, first(smaller.read(c, back=True))))


def leftmost_smaller(text: np.ndarray, n: int, memory: int) -> np.ndarray:
    """Places that are smaller than their successor while the place before is larger (the end is smallest), ascending."""
    found, sizes, after = None if n <= memory else tempfile.TemporaryFile(), [], False
    held: list[np.ndarray] = []
    for b in range(n, 0, -BLOCK):
        a = max(0, b - BLOCK)
        x = np.asarray(text[a : min(b + 1, n)]).astype(np.int64)
        # each place is like the next place at which the symbol changes
        change = np.flatnonzero(x[1:] != x[:-1])
        rise = x[change + 1] > x[change]
        kind = np.full(b - a, after)
        kind[: change[-1] + 1 if len(change) else 0] = np.repeat(rise, np.diff(np.concatenate([[-1], change])))
        both = np.append(kind, after) if b < n else kind
        places = a + 1 + np.flatnonzero(both[1:] & ~both[:-1])
        sizes.append(len(places))
        if found is None:
            held.append(places)
        else:
            found.write(places.astype(np.int64).tobytes())
        after = bool(kind[0])
    # the last block was found first
    out, at, end = room(sum(sizes), np.int64, memory), 0, 8 * sum(sizes)
    for i in reversed(range(len(sizes))):
        if found is None:
            x = held[i]
        else:
            end -= 8 * sizes[i]
            found.seek(end)
            x = np.frombuffer(found.read(8 * sizes[i]), np.int64)
        out[at : at + sizes[i]] = x
        at += sizes[i]
    return out


def alike(text: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many of `size` symbols are equal from places a and b on."""
    out, live = np.zeros(len(a), np.int64), np.arange(len(a))
    rows = np.lib.stride_tricks.sliding_window_view(text, PAD)
    while len(live):
        other = rows[np.minimum(a[live] + out[live], len(rows) - 1)] != rows[np.minimum(b[live] + out[live], len(rows) - 1)]
        got = np.where(other.any(axis=1), other.argmax(axis=1), PAD)
        out[live] = np.minimum(out[live] + got, size[live])
        live = live[(got == PAD) & (out[live] < size[live])]
    return out


def doubled(names: np.ndarray, most: int) -> np.ndarray:
    """Suffixes of a string of names in order, by rank pairs of doubling distance, as far as `most` names."""
    rank, size = np.asarray(names).astype(np.int64), 1
    while True:
        nxt = np.zeros_like(rank)
        nxt[:-size] = rank[size:] + 1
        key = rank * (int(rank.max()) + 2) + nxt
        order = np.argsort(key)
        rank[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        size *= 2
        if size >= min(most, len(rank)) or rank.max() == len(rank) - 1:
            return order


def pairs(blocks: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each block with the places before its own; -1 stands before all."""
    before = np.int64(-1)
    for x in blocks:
        if len(x):
            yield np.concatenate([[before], x[:-1]]), x
            before = x[-1]


def suffixes(text: np.ndarray, n: int, symbols: int, depth: int, most: int | None = None, memory: int = 1 << 23, inner: int = INNER) -> Iterator[np.ndarray]:
    """Suffixes of text[:n] (symbols 0 to symbols - 1) as blocks of suffix << 8 | common prefix with the one before.

    Right to `depth` symbols; what is equal so far may stand in any order.  Common prefixes count up to `most` (0 if
    None).  Leftmost-smaller suffixes are named by an induction over their substrings, the string of names is sorted
    by the same steps again, and a second induction brings in all others.  Text and names are on disk if they are long.
    """
    if len(text) < n + PAD:
        text = np.append(text[:n], np.zeros(n + PAD - len(text), text.dtype))
    lms = leftmost_smaller(text, n, memory)
    if not len(lms):
        yield from induce(text, n, symbols, DiskQueue(memory), most, memory)
        return
    rough = DiskQueue(memory)
    sizes = lambda i: np.where(i + 1 < len(lms), lms[np.minimum(i + 1, len(lms) - 1)] - lms[i] + 1, n - lms[i])

    def put(queue: DiskQueue, at: np.ndarray, common: np.ndarray | int = 0) -> None:
        s = text[at]
        order = np.argsort(s, kind="stable")
        tuples = (at << 8 | common)[order]
        s = s[order]
        edge = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1).tolist(), len(s)]
        for a, b in zip(edge, edge[1:], strict=False):
            queue.push(int(s[a]), tuples[a:b])

    for k in range(0, len(lms), BLOCK):
        put(rough, np.asarray(lms[k : k + BLOCK]))
    names, count = room(len(lms) + PAD, np.int64, memory), -1

    def chosen() -> Iterator[np.ndarray]:
        for block in induce(text, n, symbols, rough, None, memory):
            i = np.searchsorted(lms, block >> 8)
            yield i[lms[np.minimum(i, len(lms) - 1)] == block >> 8]

    for before, i in pairs(chosen()):
        a, size = sizes(np.maximum(before, 0)), sizes(i)
        m = np.flatnonzero((a == size) & (before >= 0))
        new = np.ones(len(i), bool)
        new[m] = alike(text, lms[before[m]], lms[i[m]], size[m]) < size[m]
        names[i] = count + np.cumsum(new)
        count += int(new.sum())
    count += 1
    if len(lms) <= inner:
        order = iter([doubled(names[: len(lms)], depth)])
    else:
        order = (x >> 8 for x in suffixes(names, len(lms), count, depth, None, memory, inner))
    seeds = DiskQueue(memory)
    for before, i in pairs(order):
        common: np.ndarray | int = 0
        if most is not None:
            common = np.zeros(len(i), np.int64)
            m = np.flatnonzero(before >= 0)
            common[m] = alike(text, lms[before[m]], lms[i[m]], np.full(len(m), most))
        put(seeds, lms[i], common)
    yield from induce(text, n, symbols, seeds, most, memory)
