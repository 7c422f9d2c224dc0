"""External induced sorting of suffixes, with common prefixes.

The order of all suffixes follows from that of the S* suffixes (those that start a rise after a fall). S* substrings are
sorted and named, and their names are a string of at most half the length whose suffixes are sorted by recursion, or in
memory once it is small. Then two scans induce the rest: a suffix tuple (position, common prefix with its forerunner) is
pushed under its first symbol into a priority queue, smallest symbol first for L suffixes, largest first for S suffixes.
Within a symbol tuples leave as they came, so the queue is a heap of symbols over first-in-first-out buckets, which go
to disk when memory is full. A pushed tuple's common prefix is one more than the least common prefix passed since the
last push under its symbol.

Everything is exact to a depth: suffixes that agree that far may come in any order, and common prefixes stop there.

Every array with an item for each suffix, substring or symbol (types, starts, names, orders, common prefixes, what the
queues hold) is a file of the given folder once it has more than `memory` items; what is worked on in memory at a time is
a multiple of `memory`, not of the text.
"""

from __future__ import annotations

import heapq
import os
import tempfile
from collections.abc import Iterator

import numpy as np


def scratch(folder: str, n: int, dtype, memory: int) -> np.ndarray:
    """n items, on disk if they are more than memory. The file has no name any more and goes with the array."""
    if n <= memory:
        return np.empty(n, dtype=dtype)
    with tempfile.TemporaryFile(dir=folder) as f:
        f.truncate(n * np.dtype(dtype).itemsize)
        return np.memmap(f, dtype=dtype, mode="r+", shape=(n,))


def pieces(n: int, memory: int) -> Iterator[tuple[int, int]]:
    for at in range(0, n, memory):
        yield at, min(n, at + memory)


#: Ranges that a queue over more than four times as many symbols deals its tuples into.
FAN = 256


class Queue:
    """A priority queue of (symbol, position, prefix) tuples; arrays beyond `memory` tuples go to disk.

    A small alphabet, or few tuples (a bucket costs much more than a tuple), have a bucket for each symbol. A large one
    is cut into ranges of symbols, whose tuples wait unsorted; the range that is next becomes a queue of its own.
    """

    def __init__(self, folder: str, memory: int, sign: int, symbols: int, items: int, base: int = 0):
        self.folder, self.memory, self.sign, self.base = folder, memory, sign, base
        self.wide = 1 if symbols <= 4 * FAN or items <= memory // 16 else -(-symbols // FAN)
        self.heap: list[int] = []
        self.buckets: dict[int, list] = {}
        self.inner: dict[int, Queue] = {}
        self.held = self.spilled = 0
        self.file = None
        self.pending: list[tuple[np.ndarray, ...]] = []  # pushes that are not dealt to ranges yet
        self.waiting = 0

    def _group(self, symbol):
        return symbol if self.wide == 1 else (symbol - self.base) // self.wide

    def push(self, symbols: np.ndarray, positions: np.ndarray, prefixes: np.ndarray) -> None:
        if not len(symbols):
            return
        if self.wide > 1:
            self._wait(symbols, positions, prefixes)
            return
        order = np.argsort(symbols, kind="stable")
        s, p, l = symbols[order], positions[order], prefixes[order]
        edges = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            c = int(s[a])
            self._known(c)
            self.buckets[c].append((p[a:b], l[a:b]))
        self.held += len(s)
        if self.held > self.memory:
            self.spill()

    def _known(self, group: int) -> None:
        if group not in self.buckets:
            self.buckets[group] = []
            heapq.heappush(self.heap, self.sign * group)

    def _wait(self, s: np.ndarray, p: np.ndarray, l: np.ndarray) -> None:
        """Tuples of ranges that are open go there; the others wait, as few pushes are large and a bucket's part each
        would take far more than its tuples."""
        g = self._group(s)
        rest = np.ones(len(s), dtype=bool)
        for c in np.unique(g).tolist():
            self._known(c)
            if c in self.inner:
                mine = g == c
                self.inner[c].push(s[mine], p[mine], l[mine])
                rest &= ~mine
        if rest.any():
            self.pending.append((p[rest], l[rest], s[rest].astype(np.int64)))
            self.waiting += int(rest.sum())
            if self.waiting > 1 << 16 or len(self.pending) > 1 << 11:
                self._deal()

    def _deal(self) -> None:
        if not self.pending:
            return
        p, l, s = (np.concatenate([x[i] for x in self.pending]) for i in range(3))
        self.pending, self.waiting = [], 0
        g = self._group(s)
        order = np.argsort(g, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], np.diff(g[order]) != 0, [True]]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            at = order[a:b]
            self.buckets[int(g[at[0]])].append((p[at], l[at], s[at]))
        self.held += len(s)
        if self.held > self.memory:
            self.spill()

    def spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(dir=self.folder)
        self.file.seek(0, os.SEEK_END)
        for parts in self.buckets.values():
            mine = [x for x in parts if not isinstance(x, list)]
            if not mine:
                continue
            arrays = [np.concatenate([x[i] for x in mine]) for i in range(len(mine[0]))]
            at, n = self.file.tell(), len(arrays[0])
            for x, kind in zip(arrays, ("<i8", "u1", "<i8")):
                self.file.write(x.astype(kind).tobytes())
            # What is in memory came after all that is on disk. On disk: where, tuples taken, tuples.
            parts[:] = [x for x in parts if isinstance(x, list)] + [[at, 0, n]]
            self.spilled += n
        self.held = 0

    def _take(self, group: int) -> tuple[np.ndarray, ...] | None:
        """The next tuples of a bucket, at most `memory` of those on disk; None if there are none now."""
        parts = self.buckets.get(group)
        if not parts:
            return None
        if not isinstance(parts[0], list):
            mine, self.buckets[group] = parts, []
            out = tuple(np.concatenate([x[i] for x in mine]) for i in range(len(mine[0])))
            self.held -= len(out[0])
            return out
        at, taken, whole = parts[0]
        n = min(whole - taken, self.memory)
        out = []
        for before, kind in ((0, "<i8"), (8 * whole, "u1"), (9 * whole, "<i8"))[: 2 if self.wide == 1 else 3]:
            size = np.dtype(kind).itemsize
            self.file.seek(at + before + size * taken)
            out.append(np.frombuffer(self.file.read(size * n), dtype=kind))
        if taken + n == whole:
            parts.pop(0)
        else:
            parts[0] = [at, taken + n, whole]
        return tuple(out)

    def _open(self, group: int) -> "Queue":
        if group not in self.inner:
            self._deal()
            items = sum(x[2] - x[1] if isinstance(x, list) else len(x[0]) for x in self.buckets[group])
            queue = Queue(self.folder, self.memory, self.sign, self.wide, items, self.base + group * self.wide)
            while (got := self._take(group)) is not None:
                queue.push(got[2], got[0], got[1])
            self.inner[group] = queue
        return self.inner[group]

    def first(self) -> int | None:
        while self.heap:
            group = self.sign * self.heap[0]
            if self.wide == 1:
                return group
            if (c := self._open(group).first()) is not None:
                return c
            self._drop(group)
        return None

    def _drop(self, group: int) -> None:
        """Nothing waits in a bucket, which is the first one."""
        del self.buckets[group]
        heapq.heappop(self.heap)
        if group in self.inner:
            self.inner.pop(group).close()

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The next tuples of a symbol; None if there are none now."""
        if self.wide == 1:
            return self._take(symbol)
        group = int(self._group(symbol))
        return self._open(group).pop(symbol) if group in self.buckets else None

    def done(self, symbol: int) -> None:
        """No tuple of this symbol will come any more."""
        if self.wide > 1:
            group = int(self._group(symbol))
            if group in self.inner:
                self.inner[group].done(symbol)
        elif symbol in self.buckets:
            self._drop(symbol)

    def close(self) -> None:
        for queue in self.inner.values():
            queue.close()
        if self.file is not None:
            self.file.close()


class _Column:
    """Positions and prefixes appended to disk."""

    def __init__(self, folder: str):
        self.files = [tempfile.TemporaryFile(dir=folder) for _ in range(2)]
        self.count = 0

    def add(self, positions: np.ndarray, prefixes: np.ndarray) -> None:
        self.files[0].write(positions.astype("<i8").tobytes())
        self.files[1].write(prefixes.astype("u1").tobytes())
        self.count += len(positions)

    def read(self) -> tuple[np.ndarray, np.ndarray]:
        for f in self.files:
            f.flush()
        if not self.count:
            return np.zeros(0, "<i8"), np.zeros(0, "u1")
        return np.memmap(self.files[0], dtype="<i8", mode="r"), np.memmap(self.files[1], dtype="u1", mode="r")

    def close(self) -> None:
        for f in self.files:
            f.close()


class _Prefixes:
    """Common prefixes of pushed tuples. latest[v] is the last source whose prefix was v or less; so the least prefix
    after source r is the first v whose latest lies beyond r."""

    def __init__(self, depth: int, symbols: int, folder: str, memory: int):
        self.depth = depth
        self.latest = np.full(depth + 1, -1, dtype=np.int64)
        self.pushed = scratch(folder, symbols, np.int64, memory)
        self.pushed[:] = -1
        self.seen = 0

    def step(self, prefixes: np.ndarray, at: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """prefixes: of all sources of this step; at, symbols: those that push, and under which symbol."""
        m = len(prefixes)
        order = np.argsort(symbols, kind="stable")
        s, j = symbols[order], at[order]
        out = np.zeros(len(s), dtype=np.int64)
        fresh = np.ones(len(s), dtype=bool)
        fresh[1:] = s[1:] != s[:-1]
        # Those whose forerunner is in this step: least prefix between the two, from a table of powers of two.
        again = np.flatnonzero(~fresh)
        if len(again):
            lo, hi = j[again - 1] + 1, j[again]
            table, width = [prefixes], 1
            while 2 * width <= int((hi - lo + 1).max()):
                t = table[-1]
                table.append(np.minimum(t[:-width], t[width:]))
                width *= 2
            level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
            for k in np.unique(level).tolist():
                which = level == k
                t = table[k]
                out[again[which]] = np.minimum(t[lo[which]], t[hi[which] - (1 << k) + 1])
        first = np.flatnonzero(fresh)
        s = s.astype(np.int64)
        before = self.pushed[s[first]]
        old = np.searchsorted(self.latest, before, side="right")
        out[first] = np.minimum(old, np.minimum.accumulate(prefixes)[j[first]] if m else 0)
        out = np.minimum(out + 1, self.depth)
        out[first[before < 0]] = 0
        self.pushed[s] = self.seen + j  # the last of equal symbols stays
        last = np.full(self.depth + 1, -1, dtype=np.int64)
        np.maximum.at(last, prefixes.astype(np.int64), self.seen + np.arange(m))
        self.latest = np.maximum(self.latest, np.maximum.accumulate(last))
        self.seen += m
        back = np.empty_like(out)
        back[order] = out
        return back


def _types(text: np.ndarray, folder: str, wide: int) -> np.ndarray:
    """True for S suffixes, from the right in pieces."""
    n = len(text)
    out = scratch(folder, n, bool, wide)
    out[n - 1] = True
    end = n - 1
    while end > 0:
        start = max(0, end - wide)
        d = np.sign(text[start + 1 : end + 1].astype(np.int64) - text[start:end].astype(np.int64))
        at = np.where(d != 0, np.arange(end - start), end - start)
        at = np.minimum.accumulate(at[::-1])[::-1]
        rises = np.concatenate([d > 0, [out[end]]])
        out[start:end] = rises[at]
        end = start
    return out


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of suffixes a and b, up to depth. Symbols are compared 8 bytes at a time; near the end of the
    text one by one."""
    n, size = len(text), text.dtype.itemsize
    step = 8 // size
    out = np.zeros(len(a), dtype=np.int64)
    live = np.arange(len(a))
    if n > 2 * step:
        words = np.ndarray(shape=(n - step + 1,), dtype="<u8", buffer=text, strides=(size,))
        ends = np.zeros(0, dtype=np.int64)
        while len(live):
            x, y = a[live] + out[live], b[live] + out[live]
            inside = np.maximum(x, y) <= n - step
            ends = np.concatenate([ends, live[~inside]])
            live, x, y = live[inside], x[inside], y[inside]
            odd = words[x] ^ words[y]
            same = odd == 0
            # The lowest bit that differs tells how many symbols agree.
            low = (odd & (~odd + np.uint64(1))).astype(np.float64)
            run = np.where(same, step, (np.frexp(low)[1] - 1) // (8 * size))
            out[live] += run
            live = live[same & (out[live] < depth)]
        live = ends[out[ends] < depth]
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        same = (x < n) & (y < n)
        same[same] = text[x[same]] == text[y[same]]
        live = live[same]
        out[live] += 1
        live = live[out[live] < depth]
    return np.minimum(out, depth)


def _in_memory(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a small string by doubling, exact to depth."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    h = 1
    while True:
        later = np.zeros(n, dtype=np.int64)
        later[: n - h] = rank[h:] + 1
        key = rank * (n + 1) + later
        order = np.argsort(key)  # equal keys stay equal ranks, so their order does not matter
        k = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        h *= 2
        if rank[order[-1]] == n - 1 or h >= depth or h >= n:
            return order


def _stars(rises: np.ndarray, folder: str, memory: int) -> np.ndarray:
    """Where S* suffixes start, and the text's last place, which ends the last S* substring."""
    n = len(rises)
    found = lambda lo, hi: np.flatnonzero(rises[lo + 1 : hi + 1] & ~rises[lo:hi]) + lo + 1
    out = scratch(folder, 1 + sum(len(found(lo, hi)) for lo, hi in pieces(n - 1, memory)), np.int64, memory)
    at = 0
    for lo, hi in pieces(n - 1, memory):
        here = found(lo, hi)
        out[at : at + len(here)] = here
        at += len(here)
    out[at] = n - 1
    return out


def _named(text: np.ndarray, starts: np.ndarray, folder: str, memory: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Order and names (from 1, in text order) of the S* substrings, each from one of starts to the next, which is part
    of it; and the number of names. Substrings are dealt into ranges of their first symbols that fit in memory, one range
    after the other. Where one ends and another goes on, the latter's symbol there is that of an L suffix, so it comes
    first: the end counts as the largest symbol. The text's own end counts as the smallest."""
    symbols = max((int(text[lo:hi].max()) for lo, hi in pieces(len(text), memory)), default=0)
    bits = (symbols + 2).bit_length()
    past = (1 << bits) - 1
    per = max(1, 40 // bits)

    def key(which: np.ndarray, offset: int) -> np.ndarray:
        out = np.zeros(len(which), dtype=np.int64)
        begin, end = np.asarray(starts[which]), np.asarray(starts[which + 1])
        for i in range(per):
            at = begin + offset + i
            symbol = np.where(at < len(text) - 1, text[np.minimum(at, len(text) - 1)].astype(np.int64) + 1, 0)
            out = (out << bits) | np.where(at <= end, symbol, past)
        return out

    n = len(starts) - 1
    names, order = scratch(folder, n, np.int64, memory), scratch(folder, n, np.int64, memory)
    firsts = scratch(folder, n, np.int64, memory)
    for lo, hi in pieces(n, memory):
        firsts[lo:hi] = key(np.arange(lo, hi), 0)
    ranges = max(1, -(-n // memory))
    cuts = np.zeros(0, dtype=np.int64)
    if ranges > 1:
        # Cut at quantiles of evenly spread substrings, of which as many are looked at as fit in memory.
        cuts = np.unique(np.quantile(firsts[:: -(-n // memory)], np.linspace(0, 1, ranges + 1)[1:-1], method="lower"))
    done = name = 0
    for r in range(len(cuts) + 1):
        ids = np.concatenate([np.flatnonzero(np.searchsorted(cuts, firsts[lo:hi], side="right") == r) + lo for lo, hi in pieces(n, memory)] or [np.zeros(0, np.int64)])
        if not len(ids):
            continue
        f = np.asarray(firsts[ids])
        turn = np.argsort(f)
        ids, f = ids[turn], f[turn]
        group = np.concatenate([[0], np.cumsum(f[1:] != f[:-1])])
        sizes = starts[ids + 1] - starts[ids]
        offset = per
        while True:
            # Only groups of several substrings that have not all ended need a closer look.
            size = np.bincount(group)
            open_ = np.flatnonzero((size[group] > 1) & (offset <= sizes + 1))
            if not len(open_):
                break
            whole = np.flatnonzero(np.bincount(group[open_], minlength=len(size))[group] > 0)
            k = key(ids[whole], offset)
            turn = np.lexsort((k, group[whole]))
            ids[whole], sizes[whole], k = ids[whole][turn], sizes[whole][turn], k[turn]
            g = group[whole]
            split = np.zeros(len(ids), dtype=np.int64)
            split[whole[1:]] = (k[1:] != k[:-1]) & (g[1:] == g[:-1])
            edge = np.concatenate([[0], group[1:] != group[:-1]]).astype(np.int64)
            group = np.cumsum(edge | split)
            offset += per
        names[ids] = name + 1 + group
        name += int(group[-1]) + 1
        order[done : done + len(ids)] = ids
        done += len(ids)
    return order, names, name


def _stop(text: np.ndarray, seeds: np.ndarray, seed: int, symbol: int) -> int:
    """Where the seeds of a symbol end, which stand in order of their symbols: steps that double, then halves."""
    lo, step = seed, 1
    while lo + step < len(seeds) and int(text[seeds[lo + step]]) <= symbol:
        lo, step = lo + step, 2 * step
    hi = min(lo + step, len(seeds))
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if int(text[seeds[mid]]) <= symbol else (lo, mid)
    return hi


def _start(text: np.ndarray, positions: np.ndarray, end: int, symbol: int) -> int:
    """Where the positions of a symbol begin that stand before end, looked for from there."""
    hi, step = end - 1, 1
    while hi - step >= 0 and int(text[positions[hi - step]]) == symbol:
        hi, step = hi - step, 2 * step
    lo = max(hi - step, -1)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if int(text[positions[mid]]) == symbol else (mid, hi)
    return hi


def _run(text: np.ndarray, at: int, depth: int) -> int:
    piece = text[at : at + depth]
    other = np.flatnonzero(piece != piece[0])
    return int(other[0]) if len(other) else len(piece)


def suffix_order(text: np.ndarray, depth: int, folder: str, memory: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, prefixes) of all suffixes in order, in pieces; a prefix is that with the suffix before.

    text: symbols of 0 and more, the last one 0 and the one before larger. memory: the suffixes that are worked on at a
    time and kept in memory; text may be a memory map. depth is at most 255. folder: scratch space on disk.
    """
    n = len(text)
    if n == 1:
        yield np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.uint8)
        return
    rises = _types(text, folder, memory)
    bounds = _stars(rises, folder, memory)
    stars = bounds[:-1]
    order, names, distinct = _named(text, bounds, folder, memory)
    if len(stars) and distinct < len(stars):
        reduced = scratch(folder, len(stars) + 1, np.int64, memory)
        for lo, hi in pieces(len(stars), memory):
            reduced[lo:hi] = names[lo:hi]
        reduced[-1] = 0
        if len(reduced) <= memory:
            order = _in_memory(reduced, depth)[1:]
        else:
            at = -1  # the end of the text comes first and is no substring
            for p, _ in suffix_order(reduced, depth, folder, memory):
                order[max(at, 0) : at + len(p)] = p[1:] if at < 0 else p
                at += len(p)
    seeds, near = scratch(folder, len(stars), np.int64, memory), scratch(folder, len(stars), np.uint8, memory)
    for lo, hi in pieces(len(stars), memory):
        seeds[lo:hi] = stars[order[lo:hi]]
    near[:1] = 0
    for lo, hi in pieces(len(seeds) - 1, memory):
        near[lo + 1 : hi + 1] = _common(text, np.asarray(seeds[lo:hi]), np.asarray(seeds[lo + 1 : hi + 1]), depth)
    symbols = max(int(text[lo:hi].max()) for lo, hi in pieces(n, memory)) + 1

    falls, ups, zeros = _Column(folder), _Column(folder), False
    # L suffixes, upwards. Sources are L suffixes as they come out, then the S* suffixes of the symbol.
    queue, prefixes, seed = Queue(folder, memory, 1, symbols, n), _Prefixes(depth, symbols, folder, memory), 0

    def feed(pos: np.ndarray, pre: np.ndarray, want: bool) -> None:
        before = pos - 1
        ok = np.flatnonzero((pos > 0) & (rises[np.maximum(before, 0)] == want))
        p = before[ok]
        s = text[p]  # narrow symbols sort by radix
        queue.push(s, p, prefixes.step(pre, ok, s))

    while True:
        c, star = queue.first(), int(text[seeds[seed]]) if seed < len(seeds) else None
        if c is None and star is None:
            break
        c = min(x for x in (c, star) if x is not None)
        last = None
        while (got := queue.pop(c)) is not None:
            falls.add(*got)
            last = int(got[0][-1])
            feed(*got, False)
        queue.done(c)
        stop = _stop(text, seeds, seed, c) if star == c else seed
        while seed < stop:
            end = min(stop, seed + memory)
            pos, pre = np.array(seeds[seed:end]), near[seed:end].astype(np.int64)
            if seed == 0 or int(text[seeds[seed - 1]]) != c:
                pre[0] = min(_run(text, last, depth), _run(text, int(pos[0]), depth)) if last is not None else 0
            feed(pos, pre, False)
            seed = end
    queue.close()
    # S suffixes, downwards. Sources are S suffixes as they come out, then the L suffixes of the symbol, reversed.
    queue, prefixes = Queue(folder, memory, -1, symbols, n), _Prefixes(depth, symbols, folder, memory)
    fall_p, fall_l = falls.read()
    end = len(fall_p)
    while True:
        c, fall = queue.first(), int(text[fall_p[end - 1]]) if end else None
        if c is None and fall is None:
            break
        c = max(x for x in (c, fall) if x is not None)
        last = None
        while (got := queue.pop(c)) is not None:
            ups.add(*got)
            zeros = zeros or c == 0
            last = int(got[0][-1])
            feed(*got, True)
        queue.done(c)
        if fall == c:
            start, first = _start(text, fall_p, end, c), True
            while end > start:
                lo = max(start, end - memory)
                pos = np.asarray(fall_p[lo:end])[::-1]
                pre = np.empty(end - lo, dtype=np.int64)
                pre[1:] = np.asarray(fall_l[lo + 1 : end])[::-1]
                if first:
                    pre[0] = min(_run(text, last, depth), _run(text, int(pos[0]), depth)) if last is not None else 0
                    first = False
                else:
                    pre[0] = fall_l[end]
                feed(pos, pre, True)
                end = lo
    queue.close()
    ups.add(np.array([n - 1]), np.array([int(zeros)]))
    # Both, symbol by symbol: L suffixes come before S suffixes. ups is in descending order.
    up_p, up_l = ups.read()
    at, end = 0, len(up_p)
    while at < len(fall_p) or end:
        one, two = int(text[fall_p[at]]) if at < len(fall_p) else None, int(text[up_p[end - 1]]) if end else None
        c = min(x for x in (one, two) if x is not None)
        last = None
        stop = _stop(text, fall_p, at, c) if one == c else at
        while at < stop:
            hi = min(stop, at + memory)
            yield np.asarray(fall_p[at:hi]), np.asarray(fall_l[at:hi])
            last, at = int(fall_p[hi - 1]), hi
        start = _start(text, up_p, end, c) if two == c else end
        head = True
        while end > start:
            lo = max(start, end - memory)
            pos = np.asarray(up_p[lo:end])[::-1]
            pre = np.empty(end - lo, dtype=np.uint8)
            pre[1:] = np.asarray(up_l[lo + 1 : end])[::-1]
            if head:
                pre[0] = min(_run(text, last, depth), _run(text, int(pos[0]), depth)) if last is not None else 0
                head = False
            else:
                pre[0] = up_l[end]
            yield pos, pre
            end = lo
    falls.close()
    ups.close()
