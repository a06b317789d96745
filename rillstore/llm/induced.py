"""External induced sorting of suffixes, with common prefixes.

The text is a file of integers, mapped read-only: separators are 0, and end every region and the whole. Everything that
grows with it lies on disk; what is held in memory is a number of tuples that `bound` fixes.

* S* positions are found in one scan from the right, block by block. Their substrings are sorted by a run-and-merge sort
  on disk, a few symbols at a time; equal ones get one name, the place of the first. A proper prefix is the greater one:
  its last symbol is an S there and an L in the other.
* Unless all names differ, the string of names, with a separator after each region, is a text of the same kind, and its
  suffixes are sorted by the same routine (recursion). A level has at most half the positions of the one before.
* L pass, symbols rising: suffixes in order induce their predecessors through a priority queue on disk, keyed by symbol,
  first come first served within one. S pass, symbols falling: the same from the L suffixes read backwards. At the level
  of bytes a bucket of the queue is one symbol. At the levels of names a bucket is a range of names of a bounded number of
  positions, sorted in memory when its turn comes, or one name that alone has more, taken block by block; a suffix that
  induces into the range that is being taken is merged in by a heap.
* At the level of bytes a tuple carries the common prefix with the tuple before it, up to `cap`: an induced pair has one
  more than the least value between the two that induced it.
"""

from __future__ import annotations

import heapq
import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np

#: A tuple is position << PLACE | common prefix.
PLACE = 16
LOW = (1 << PLACE) - 1


class Rows:
    """An append-only file of int64 values without a name."""

    def __init__(self, folder: str) -> None:
        self.file, self.n = tempfile.TemporaryFile(dir=folder), 0

    def add(self, x: np.ndarray) -> tuple[int, int]:
        """Where it starts, and its length."""
        data, at = np.ascontiguousarray(x, np.int64).tobytes(), self.n * 8
        while data:
            done = os.pwrite(self.file.fileno(), data, at)
            data, at = data[done:], at + done
        self.n += len(x)
        return self.n - len(x), len(x)

    def read(self, at: int, n: int) -> np.ndarray:
        got = bytearray()
        while len(got) < n * 8:
            got += os.pread(self.file.fileno(), n * 8 - len(got), at * 8 + len(got))
        return np.frombuffer(bytes(got), np.int64)

    def backwards(self, at: int, n: int, block: int) -> Iterator[np.ndarray]:
        for end in range(at + n, at, -block):
            low = max(at, end - block)
            yield self.read(low, end - low)[::-1]

    def mapped(self) -> np.ndarray:
        return np.memmap(self.file, np.int64, "r", shape=(self.n,)) if self.n else np.zeros(0, np.int64)


def blank(folder: str, n: int, kind: type = np.int64) -> np.ndarray:
    """A mapped array of zeros in a file without a name."""
    if not n:
        return np.zeros(0, kind)
    f = tempfile.TemporaryFile(dir=folder)
    f.truncate(n * np.dtype(kind).itemsize)
    return np.memmap(f, kind, "r+", shape=(n,))


class Sorter:
    """Rows of int64 columns, sorted by the first two: sorted runs on disk, merged block by block."""

    def __init__(self, folder: str, columns: int, bound: int) -> None:
        self.file, self.columns, self.bound = Rows(folder), columns, bound
        self.held: list[np.ndarray] = []
        self.size, self.rows = 0, 0
        self.runs: list[list[int]] = []  # start and length in values

    @staticmethod
    def _sorted(x: np.ndarray) -> np.ndarray:
        return x[np.lexsort((x[:, 1], x[:, 0]))]

    def add(self, *cols: np.ndarray) -> None:
        if not len(cols[0]):
            return
        self.held.append(np.stack([c.astype(np.int64, copy=False) for c in cols], axis=1))
        self.size += len(cols[0])
        self.rows += len(cols[0])
        if self.size >= self.bound:
            self.runs.append(list(self.file.add(self._sorted(np.concatenate(self.held)).ravel())))
            self.held, self.size = [], 0

    def blocks(self) -> Iterator[np.ndarray]:
        last = self._sorted(np.concatenate(self.held)) if self.held else np.zeros((0, self.columns), np.int64)
        if not self.runs:
            if len(last):
                yield last
            return
        step = max(256, self.bound // (len(self.runs) + 1))
        front = [np.zeros((0, self.columns), np.int64) for _ in self.runs] + [last]
        left = [*self.runs, [0, 0]]
        self.held = []
        while True:
            for k, (at, n) in enumerate(left):
                if n and not len(front[k]):
                    take = min(n, step * self.columns)
                    front[k] = self.file.read(at, take).reshape(-1, self.columns)
                    left[k] = [at + take, n - take]
            open_ = [tuple(front[k][-1, :2]) for k, (_, n) in enumerate(left) if n]
            if not open_:
                rest = np.concatenate(front)
                if len(rest):
                    yield self._sorted(rest)
                return
            a, b = min(open_)
            part = []
            for k, x in enumerate(front):
                cut = int(np.count_nonzero((x[:, 0] < a) | (x[:, 0] == a) & (x[:, 1] <= b)))
                part.append(x[:cut])
                front[k] = x[cut:]
            yield self._sorted(np.concatenate(part))


class Queue:
    """A priority queue of tuples: one bucket after another, first come first served within one. Beyond `bound` tuples, what is held goes to disk."""

    def __init__(self, folder: str, buckets: int, bound: int) -> None:
        self.file, self.bound, self.size = Rows(folder), bound, 0
        self.held: list[list[np.ndarray]] = [[] for _ in range(buckets)]
        self.spilled: list[list[tuple[int, int]]] = [[] for _ in range(buckets)]

    def push(self, bucket: np.ndarray, x: np.ndarray) -> None:
        """bucket in order; equal ones in order of arrival."""
        if not len(x):
            return
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist()
        for b, lo, hi in zip(bucket[cut].tolist(), cut, [*cut[1:], len(x)], strict=True):
            self.held[b].append(x[lo:hi])
        self.size += len(x)
        if self.size > self.bound:
            for b, parts in enumerate(self.held):
                if parts:
                    self.spilled[b].append(self.file.add(np.concatenate(parts)))
                    self.held[b] = []
            self.size = 0

    def take(self, b: int, block: int) -> Iterator[np.ndarray]:
        """Blocks of a bucket until it is empty; more may be pushed meanwhile."""
        while self.spilled[b] or self.held[b]:
            if self.spilled[b]:
                at, n = self.spilled[b].pop(0)
                if n > block:
                    self.spilled[b].insert(0, (at + block, n - block))
                yield self.file.read(at, min(n, block))
            else:
                x, self.held[b] = np.concatenate(self.held[b]), []
                self.size -= len(x)
                for lo in range(0, len(x), block):
                    yield x[lo : lo + block]


class Carried:
    """Common prefixes of induced tuples: for each symbol, the least value since the last tuple that was pushed for it."""

    def __init__(self, symbols: int, cap: int) -> None:
        self.least, self.seen, self.cap = np.full(symbols, cap, np.int16), np.zeros(symbols, bool), cap

    def induce(self, prefix: np.ndarray, at: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """prefix: of the scanned tuples; at, symbol: which of them induce, and into which symbol. The order of pushing, and the new values in that order."""
        n = len(prefix)
        until = np.minimum.accumulate(prefix)
        if not len(at):
            self.least = np.minimum(self.least, until[-1])
            return at, prefix[:0]
        order = np.argsort(symbol, kind="stable")
        k, d = at[order], symbol[order]
        head = np.r_[True, d[1:] != d[:-1]]
        value = np.empty(len(k), np.int16)
        value[head] = np.minimum(self.least[d[head]], until[k[head]])
        value[head] = np.where(self.seen[d[head]], np.minimum(value[head] + 1, self.cap), 0)
        rest = np.flatnonzero(~head)
        if len(rest):
            lo, hi = k[rest - 1] + 1, k[rest]
            level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
            got = np.empty(len(rest), np.int16)
            row, span = prefix, 1
            for j in range(int(level.max()) + 1):
                here = np.flatnonzero(level == j)
                got[here] = np.minimum(row[lo[here]], row[hi[here] - span + 1])
                if len(row) > span:
                    row = np.minimum(row[:-span], row[span:])
                span *= 2
            value[rest] = np.minimum(got + 1, self.cap)
        # what remains after the last push of each symbol
        tail = np.r_[head[1:], True]
        after = np.full(n + 1, self.cap, np.int16)
        after[:n] = np.minimum.accumulate(prefix[::-1])[::-1]
        self.least = np.minimum(self.least, until[-1])
        self.least[d[tail]] = after[k[tail] + 1]
        self.seen[d] = True
        return order, value


def common_prefix(t: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Equal symbols from a and b on, up to cap or a separator."""
    out = np.zeros(len(a), np.int16)
    left = np.arange(len(a))
    n = len(t)
    for k in range(cap):
        x, y = t[np.minimum(a[left] + k, n - 1)], t[np.minimum(b[left] + k, n - 1)]
        left = left[(x == y) & (x != 0)]
        if not len(left):
            break
        out[left] = k + 1
    return out


def stars(t: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (position, length of its substring) of S* positions, and of separators with length 0, falling. S*: a smaller-than-next symbol after a greater-than-next one."""
    n = len(t)
    right, right_small = n, True  # the S* or separator last met, and the type of the first symbol of the block before
    for b in range(n, 0, -block):
        a = max(0, b - block)
        x = np.asarray(t[a : min(n, b + 1)]).astype(np.int64)  # positions a..b, b being of the block before
        diff = np.sign(np.diff(x))
        own = b - a  # of these are typed here
        small = np.empty(own + 1, bool)
        small[own] = right_small
        change = np.flatnonzero(diff)
        nxt = np.searchsorted(change, np.arange(own))
        beyond = nxt >= len(change)
        small[:own] = np.where(beyond, right_small, diff[change[np.minimum(nxt, len(change) - 1)]] > 0) if len(change) else right_small
        small[: len(x)][x == 0] = True
        full = np.r_[x, 0] if len(x) == own else x  # past the end of the text
        here = np.arange(1, own + 1 if b < n else own)  # position a is decided with the next block
        is_star = small[here] & ~small[here - 1] & (full[here] != 0)
        is_sep = full[here] == 0
        if a == 0 and x[0] == 0:
            here, is_star, is_sep = np.r_[0, here], np.r_[False, is_star], np.r_[True, is_sep]
        p = here[is_star | is_sep] + a
        if len(p):
            star = is_star[is_star | is_sep]
            length = np.where(star, np.r_[p[1:], right] - p + 1, 0)
            right = int(p[0])
            yield p[::-1], length[::-1]
        right_small = bool(small[0])


class Plan:
    """Which bucket of the queue a symbol belongs to. bounds: the first symbol of each; single: those of one symbol."""

    def __init__(self, bounds: np.ndarray, single: np.ndarray) -> None:
        self.bounds, self.single = bounds, single

    def of(self, symbols: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, symbols, "right") - 1

    @staticmethod
    def bytes() -> Plan:
        return Plan(np.arange(257), np.ones(257, bool))

    @staticmethod
    def names(r: np.ndarray, m: int, block: int) -> Plan:
        """Names are places (from 1), so a range of places is a range of as many positions, but for its last name, which may go beyond it."""
        k = -(-m // block) + 1
        count, most = np.zeros(k, np.int64), np.zeros(k, np.int64)
        for lo in range(0, len(r), block):
            x = np.asarray(r[lo : lo + block])
            x = x[x > 0]
            c = (x - 1) // block
            count += np.bincount(c, minlength=k)
            np.maximum.at(most, c, x)
        hot = most[count > 2 * block]
        bounds = np.unique(np.concatenate([[0, 1], np.arange(k) * block + 1, hot]))
        return Plan(bounds, np.isin(bounds, [0, *hot.tolist()]))


class Seeds:
    """Separators by position, then S* positions in order, from a file of falling ones; taken by symbol."""

    def __init__(self, t: np.ndarray, star: Rows, block: int) -> None:
        self.t, self.left = t, np.zeros(0, np.int64)
        self.more = self._read(star, block)

    def _read(self, star: Rows, block: int) -> Iterator[np.ndarray]:
        for lo in range(0, len(self.t), block):
            yield np.flatnonzero(np.asarray(self.t[lo : lo + block]) == 0) + lo
        yield from star.backwards(0, star.n, block)

    def below(self, symbol: int | None) -> Iterator[np.ndarray]:
        """Blocks of the next positions, as long as their symbol is less than this."""
        while True:
            if not len(self.left):
                got = next(self.more, None)
                if got is None:
                    return
                self.left = got
                continue
            s = np.asarray(self.t[self.left])
            cut = len(s) if symbol is None else int(np.searchsorted(s, symbol, "left"))
            if cut:
                out, self.left = self.left[:cut], self.left[cut:]
                yield out
            if len(self.left):
                return


class Induction:
    """One level: the text, its plan, and the two passes."""

    def __init__(self, t: np.ndarray, plan: Plan, folder: str, cap: int, bound: int) -> None:
        self.t, self.plan, self.folder, self.cap, self.bound = t, plan, folder, cap, bound
        self.block = max(16, bound // 4)

    def _next_bound(self, b: int) -> int | None:
        return int(self.plan.bounds[b + 1]) if b + 1 < len(self.plan.bounds) else None

    def _run(self, p: int) -> int:
        """How often the symbol at p stands in a row from there, up to cap."""
        x = np.asarray(self.t[p : p + self.cap])
        other = np.flatnonzero(x != x[0])
        return int(other[0]) if len(other) else len(x)

    def _scan(self, queue: Queue, carried: Carried | None, x: np.ndarray, c: int, kind: int, sign: int) -> None:
        """Tuples of one symbol, in order, induce their predecessors."""
        pos = x >> PLACE
        before = np.asarray(self.t[np.maximum(pos - 1, 0)]).astype(np.int64)
        at = np.flatnonzero((pos > 0) & (before != 0) & (sign * (before - c) >= kind))
        d = before[at]
        if carried is None:
            order, value = np.argsort(d, kind="stable"), 0
        else:
            order, value = carried.induce((x & LOW).astype(np.int16), at, d)
        queue.push(self.plan.of(d[order]), (pos[at][order] - 1) << PLACE | value)

    def _range(self, queue: Queue, b: int, first: np.ndarray, second: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray]:
        """A bucket of several names: positions in order, and their kinds (0 induced, 1 from `second`)."""
        t, plan = self.t, self.plan
        symbol = lambda p: np.asarray(t[p]).astype(np.int64)
        pos = np.concatenate([first, second])
        kind = np.repeat(np.array([0, 1]), [len(first), len(second)])
        key = 2 * sign * symbol(pos) + kind
        order = np.argsort(key, kind="stable")
        pos, kind, key = pos[order], kind[order], key[order]

        def targets(pos: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            d = symbol(np.maximum(pos - 1, 0))
            fits = (pos > 0) & (d != 0) & (sign * (d - symbol(pos)) >= kind)
            return d, np.where(fits, plan.of(d), -1)

        d, to = targets(pos, kind)
        own = np.flatnonzero(to == b)
        if len(own):
            # predecessors that fall into this very range, merged in by their place among those that are here
            low, high = int(plan.bounds[b]), self._next_bound(b) or 1 << 62
            heap, where, what, seq, i = [], [], [], 0, 0
            own_l, n_own = own.tolist(), len(own)
            while i < n_own or heap:
                if heap and (i == n_own or heap[0][0] <= own_l[i]):
                    at, _, _, p = heapq.heappop(heap)
                    where.append(at)
                    what.append(p)
                    e = int(t[p - 1]) if p else 0
                    if not e or sign * (e - int(t[p])) < 0 or not low <= e < high:
                        continue
                else:
                    p, e = int(pos[own_l[i]]), int(d[own_l[i]])
                    i += 1
                seq += 1
                heapq.heappush(heap, (int(np.searchsorted(key, 2 * sign * e + 1, "left")), sign * e, seq, p - 1))
            pos, kind = np.insert(pos, where, what), np.insert(kind, where, 0)
            d, to = targets(pos, kind)
        out = np.flatnonzero((to >= 0) & (to != b))
        out = out[np.argsort(to[out], kind="stable")]
        queue.push(to[out], (pos[out] - 1) << PLACE)
        return pos, kind

    def falling(self, star: Rows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (positions, common prefix with the one given before) of all suffixes but separators, falling. star: the S* positions, falling."""
        t, plan, block, cap = self.t, self.plan, self.block, self.cap
        buckets = range(len(plan.bounds))
        # L pass
        queue, carried = Queue(self.folder, len(buckets), self.bound), Carried(257, cap) if cap else None
        seeds, larger = Seeds(t, star, block), Rows(self.folder)
        parts: list[tuple[int, int]] = []
        for b in buckets:
            at, until = larger.n, self._next_bound(b)
            if plan.single[b]:
                c, last = int(plan.bounds[b]), -1
                for x in queue.take(b, block):
                    larger.add(x)
                    self._scan(queue, carried, x, c, 0, 1)
                    last = int(x[-1] >> PLACE)
                before = -1
                for p in seeds.below(until):
                    prefix = np.zeros(len(p), np.int64)
                    if cap:
                        prefix[1:] = common_prefix(t, p[:-1], p[1:], cap)
                        if before >= 0:
                            prefix[0] = common_prefix(t, np.array([before]), p[:1], cap)[0]
                        elif last >= 0:
                            prefix[0] = min(self._run(last), self._run(int(p[0])), cap)
                    before = int(p[-1])
                    self._scan(queue, carried, p << PLACE | prefix, c, 1, 1)
            else:
                first = [x >> PLACE for x in queue.take(b, block)]
                second = list(seeds.below(until))
                pos, kind = self._range(queue, b, *(np.concatenate([np.zeros(0, np.int64), *x]) for x in (first, second)), 1)
                larger.add(pos[kind == 0] << PLACE)
            parts.append((at, larger.n - at))
        # S pass
        queue, carried = Queue(self.folder, len(buckets), self.bound), Carried(257, cap) if cap else None
        for b in reversed(buckets):
            at, n = parts[b]
            if not plan.single[b]:
                first = [x >> PLACE for x in queue.take(b, block)]
                second = [x >> PLACE for x in larger.backwards(at, n, block)]
                pos, _ = self._range(queue, b, *(np.concatenate([np.zeros(0, np.int64), *x]) for x in (first, second)), -1)
                if len(pos):
                    yield pos, np.zeros(len(pos), np.int64)
                continue
            c, last = int(plan.bounds[b]), -1
            if not c:
                continue
            for x in queue.take(b, block):
                last = int(x[-1] >> PLACE)
                yield x >> PLACE, x & LOW
                self._scan(queue, carried, x, c, 0, -1)
            joint = None  # between the one given last and the one that comes
            for x in larger.backwards(at, n, block):
                pos, prefix = x >> PLACE, x & LOW
                if joint is None:
                    joint = min(self._run(last), self._run(int(pos[0])), cap) if cap and last >= 0 else 0
                shifted = np.r_[joint, prefix[:-1]]
                joint = int(prefix[-1])
                yield pos, shifted
                self._scan(queue, carried, pos << PLACE | shifted, c, 1, -1)


def sorted_stars(t: np.ndarray, top: int, folder: str, bound: int, depth: list[int]) -> Rows:
    """The S* positions, falling in the order of their suffixes. top: the greatest symbol."""
    block = max(16, bound // 4)
    bits = int(top + 1).bit_length()
    per, pad = max(1, 62 // bits), top + 1
    n = len(t)

    def key(pos: np.ndarray, length: np.ndarray, done: int) -> np.ndarray:
        out = np.zeros(len(pos), np.int64)
        for j in range(per):
            x = np.asarray(t[np.minimum(pos + done + j, n - 1)]).astype(np.int64)
            out = out << bits | np.where(done + j < length, x, pad)
        return out

    # what stands where in the string of names, from the right: its position, S* or separator
    place, sorter, done, m = Rows(folder), Sorter(folder, 5, bound), 0, 0
    for pos, length in stars(t, block):
        at, _ = place.add(pos)
        is_star = length > 0
        d = np.arange(at, at + len(pos))[is_star]
        pos, length = pos[is_star], length[is_star]
        m += len(pos)
        sorter.add(np.zeros(len(pos)), key(pos, length, 0), pos, length, d)
    total = place.n
    names, by_name = blank(folder, total), blank(folder, m)
    twice = False
    while sorter.rows:
        done += per
        more = Sorter(folder, 5, bound)
        i = 0
        group, start, last_key, name = -1, 0, 0, 0
        for x in sorter.blocks():
            g, k, pos, length, d = x.T
            index = np.arange(i, i + len(g))
            new_group = np.r_[g[0] != group, g[1:] != g[:-1]]
            begin = np.maximum.accumulate(np.where(new_group, index, start))
            new = new_group | np.r_[k[0] != last_key, k[1:] != k[:-1]]
            place_now = g + index - begin
            rank = np.maximum.accumulate(np.where(new, place_now, name))
            group, start, last_key, name, i = int(g[-1]), int(begin[-1]), int(k[-1]), int(rank[-1]), i + len(g)
            alone = new & np.r_[new[1:], False]
            open_ = ~alone & (length >= done)
            twice |= bool((~new & ~open_).any())
            closed = ~open_
            names[total - 1 - d[closed]] = rank[closed] + 1
            by_name[m - 1 - rank[closed]] = pos[closed]
            o = np.flatnonzero(open_)
            more.add(rank[o], key(pos[o], length[o], done), pos[o], length[o], d[o])
        sorter = more
    out = Rows(folder)
    depth.append(m)
    if not twice:
        for lo in range(0, m, block):
            out.add(by_name[lo : lo + block])
        return out
    at = place.mapped()
    level = Induction(names, Plan.names(names, m, block), folder, 0, bound)
    for pos, _ in level.falling(sorted_stars(names, m, folder, bound, depth)):
        out.add(at[total - 1 - pos])
    return out


def falling_suffixes(t: np.ndarray, folder: str, cap: int, bound: int = 1 << 18, depth: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (positions, common prefix with the suffix given before, up to cap) in falling order, without separators.

    t: symbols 1..256, and 0 after each region and at the end. depth, if given, gets the number of names of each level.
    """
    star = sorted_stars(t, 256, folder, bound, depth if depth is not None else [])
    yield from Induction(t, Plan.bytes(), folder, cap, bound).falling(star)


def repeats(t: np.ndarray, folder: str, width: int, bound: int = 1 << 18, depth: list[int] | None = None, order: Callable = falling_suffixes) -> np.ndarray:
    """A mapped array: 1 at the start positions of windows of `width` symbols that also start earlier."""
    mark = blank(folder, len(t), np.uint8)
    least = -1  # of the set of equal windows that may go on
    for pos, prefix in order(t, folder, width, bound, depth):
        tie = prefix >= width
        if least >= 0:
            pos, tie = np.r_[least, pos], np.r_[False, tie]
        else:
            tie[0] = False
        heads = np.flatnonzero(~tie)
        sets = np.minimum.reduceat(pos, heads)
        mark[pos[pos != np.repeat(sets, np.diff(np.r_[heads, len(pos)]))]] = 1
        least = int(sets[-1])
    return mark
