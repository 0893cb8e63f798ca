"""Suffix and common-prefix order of one shard by external induced sorting, on NumPy blocks.

The suffixes of a text that are smaller than their successor and follow one that isn't (S*) are sorted by recursion:
they are first ordered by the piece up to the next S*, named, and the string of names is sorted in the same way. From
their order all others are induced in two scans: each block taken from the queue puts the suffixes one character
longer into the queue, first those larger than their successor in ascending order, then the smaller ones in descending
order.

The queue is a priority queue by (character, arrival) on disk: each character has a stretch of known length in a mapped
file, filled in order of arrival. Its entries are the suffix and the length of the prefix shared with the entry before,
which is one more than the least in the stretch of the scan since the last entry of that character. A character is
complete when all smaller ones have been taken, but for the suffixes it gives to itself within a run, which are written
out from the lengths of the runs; so in the strings of names many characters are taken together in one block.

What is in memory is a block, counts by character, and arrays of less than a sixteenth of ``memory``; all other arrays,
the text and the names too, lie in mapped files. The recursion ends with names of which ``memory`` holds all.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

from .hashing import BASE, INVERSE, U, powers

MEMORY = 32 << 20
FAR = 1 << 40
#: Shared lengths are kept up to this.
TOP = 32_000


class Space:
    """Room for the arrays of one sort, in a folder of its own."""

    def __init__(self, folder: str, memory: int):
        self.folder, self.memory = folder, memory
        #: Entries taken at once, and names sorted at once.
        self.block, self.direct = max(16, memory // 128), memory // 256

    def array(self, n: int, kind: type) -> np.ndarray:
        if n * np.dtype(kind).itemsize <= self.memory // 16:
            return np.zeros(n, kind)
        handle, path = tempfile.mkstemp(dir=self.folder)
        os.close(handle)
        out = np.memmap(path, kind, "w+", shape=(n,))
        os.unlink(path)  # the mapping keeps the file until it is dropped
        return np.asarray(out)

    def places(self, n: int, of: int) -> np.ndarray:
        """Room for n positions in a text of ``of`` characters."""
        return self.array(n, np.int32 if of < 1 << 31 else np.int64)

    def blocks(self, n: int, start: int = 0) -> Iterator[tuple[int, int]]:
        for a in range(start, n, self.block):
            yield a, min(n, a + self.block)

    def where(self, n: int, test) -> np.ndarray:
        """Positions for which ``test(a, b)``, true or false for those from a to b, is true."""
        out = self.places(sum(int(test(a, b).sum()) for a, b in self.blocks(n)), n)
        at = 0
        for a, b in self.blocks(n):
            hit = np.flatnonzero(test(a, b)) + a
            out[at : at + len(hit)] = hit
            at += len(hit)
        return out


STEP = 1 << 12


class Hashes:
    """Prefix sums from which equality of any two stretches of a text is told; worked out a block at a time."""

    def __init__(self, t: np.ndarray, space: Space):
        self.n, block = len(t), space.block
        self.sums = space.array(self.n + 1, np.uint64)
        base, up = powers(BASE, block + 1), U(1)
        # INVERSE**a is the product of one of each
        self.low = powers(INVERSE, STEP + 1)
        self.high = np.cumprod(np.append(U(1), np.full(self.n // STEP, self.low[STEP])), dtype=U)
        with np.errstate(over="ignore"):
            for i in range(0, self.n, block):
                part = t[i : i + block]
                self.sums[i + 1 : i + 1 + len(part)] = self.sums[i] + np.cumsum((part.astype(U) + U(7)) * (base[: len(part)] * up))
                up = up * base[block]

    def _of(self, a: np.ndarray, m: np.ndarray) -> np.ndarray:
        return (self.sums[a + m] - self.sums[a]) * self.low[a % STEP] * self.high[a // STEP]

    def same(self, a: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return self._of(a, m) == self._of(b, m)

    def shared(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b, ``most`` at most."""
        low, high = np.zeros(len(a), np.int64), np.minimum(most, self.n - np.maximum(a, b))
        while (low < high).any():
            mid = (low + high + 1) // 2
            ok = self.same(a, b, mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low


class Queue:
    """Suffixes by character, in ascending order in the end; ``up``: they arrive in ascending order, else in descending."""

    def __init__(self, counts: np.ndarray, space: Space, up: bool, carry: bool, of: int):
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.filled, self.up = np.zeros(len(counts), np.int64), up
        self.pos = space.places(int(self.first[-1]), of)
        #: Length of the prefix shared with the next smaller suffix of the same character.
        self.shared = space.array(int(self.first[-1]) + 1, np.int16) if carry else None

    def put(self, to: np.ndarray, pos: np.ndarray, shared: np.ndarray | None = None) -> None:
        """``to``: characters, sorted; those of one character in order of arrival."""
        if not len(to):
            return
        starts = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        many = np.diff(np.append(starts, len(to)))
        at = self.filled[to] + np.arange(len(to)) - np.repeat(starts, many)
        slot = self.first[to] + at if self.up else self.first[to + 1] - 1 - at
        self.pos[slot] = pos
        if shared is not None:
            self.shared[slot if self.up else np.where(slot + 1 < self.first[to + 1], slot + 1, len(self.pos))] = np.minimum(shared, TOP)
        self.filled[to[starts]] += many

    def lacking(self, a: int, b: int) -> np.ndarray:
        return self.first[a + 1 : b + 1] - self.first[a:b] - self.filled[a:b]

    def arrived(self, c: int, a: int, b: int) -> np.ndarray:
        """The suffixes of ``c`` that came as number a to b."""
        if self.up:
            return self.pos[self.first[c] + a : self.first[c] + b].astype(np.int64)
        return self.pos[self.first[c + 1] - b : self.first[c + 1] - a][::-1].astype(np.int64)


class Text:
    """A text with the kinds of its suffixes, and the scans over it."""

    def __init__(self, t: np.ndarray, space: Space):
        self.t, self.space, self.n = t, space, len(t)
        self.kind = self._smaller()
        self.letters = 1 + max(int(t[a:b].max()) for a, b in space.blocks(self.n))
        self.starts = None

    def _smaller(self) -> np.ndarray:
        """True where a suffix is smaller than the one that follows; the last one is larger than nothing after it."""
        kind = self.space.array(self.n, bool)
        for a, b in reversed(list(self.space.blocks(self.n))):
            x = self.t[a : min(b + 1, self.n)].astype(np.int64)
            if b == self.n:
                x = np.append(x, -1)
            d = np.sign(np.diff(x))
            near = np.where(d != 0, np.arange(len(d)), len(d))
            near = np.minimum.accumulate(near[::-1])[::-1]
            d = np.append(d, 1 if b < self.n and kind[b] else -1)
            kind[a:b] = d[near] > 0
        return kind

    def star(self, a: int, b: int) -> np.ndarray:
        """Whether the suffixes from a to b are S*."""
        out = np.array(self.kind[a:b])
        out &= ~np.concatenate(([True], self.kind[:b]))[a:b] if a == 0 else ~self.kind[a - 1 : b - 1]
        return out

    def counts(self, which) -> np.ndarray:
        out = np.zeros(self.letters, np.int64)
        for a, b in self.space.blocks(self.n):
            out += np.bincount(self.t[a:b][which(a, b)], minlength=self.letters)
        return out

    def induce(self, seeds: Queue, joint, most: int) -> tuple[Queue, Queue]:
        """From the S* in ``seeds`` all suffixes: the larger and the smaller ones. ``joint``: the shared prefixes of suffixes
        of one character that no scan tells; None: none are carried."""
        larger = Queue(self.counts(lambda a, b: ~self.kind[a:b]), self.space, True, joint is not None, self.n)
        smaller = Queue(self.counts(lambda a, b: self.kind[a:b]), self.space, False, joint is not None, self.n)
        self._scan(larger, larger, seeds, True, joint)
        self._scan(smaller, larger, smaller, False, joint)
        return larger, smaller

    def _scan(self, target: Queue, low: Queue, high: Queue, up: bool, joint) -> None:
        """Take all characters in turn; those of one character: ``low`` before ``high`` in ascending order."""
        since = np.full(self.letters, FAR) if joint else None
        if up:  # the empty suffix comes first of all and gives the last one
            last = int(self.t[-1])
            target.put(np.array([last]), np.array([self.n - 1]), np.zeros(1, np.int64) if joint else None)
            if joint:
                since[last] = 0
        size = low.first + high.first
        c = 0 if up else self.letters - 1
        while 0 <= c < self.letters:
            if target.lacking(c, c + 1)[0]:
                self._within(c, target, joint)
            d = c if joint else self._together(c, target, size, up)
            for pos, shared in self._taken(min(c, d), max(c, d), low, high, up, joint):
                self._give(pos, shared, target, since, up)
            c = d + 1 if up else d - 1

    def _together(self, c: int, target: Queue, size: np.ndarray, up: bool) -> int:
        """The last character that is complete together with all from ``c`` on, within a block."""
        if up:
            end = max(c + 1, int(np.searchsorted(size, size[c] + self.space.block, side="right")) - 1)
            lack = np.flatnonzero(target.lacking(c + 1, end))
            return c + int(lack[0]) if len(lack) else end - 1
        end = min(c, int(np.searchsorted(size, size[c + 1] - self.space.block)))
        lack = np.flatnonzero(target.lacking(end, c))
        return end + int(lack[-1]) + 1 if len(lack) else end

    def _within(self, c: int, target: Queue, joint) -> None:
        """What the suffixes of ``c`` give to their own character: those before them in runs of it, in rounds."""
        block, at = self.space.block, 0
        most = joint.most if joint else 0

        def put(pos: np.ndarray) -> None:
            shared = None
            if joint:
                before = np.append(target.arrived(c, int(target.filled[c]) - 1, int(target.filled[c])), pos[:-1])
                shared = joint.hashes.shared(before, pos, most)
            target.put(np.full(len(pos), c), pos, shared)

        while target.filled[c] - at > block:
            pos = target.arrived(c, at, at + block)
            at += block
            pos = pos[pos > 0]
            pos = pos[self.t[pos - 1] == c] - 1
            if len(pos):
                put(pos)
        pos = target.arrived(c, at, int(target.filled[c]))
        pos = pos[pos > 0]
        pos = pos[self.t[pos - 1] == c]
        if self.starts is None:
            self.starts = self.space.where(self.n, lambda a, b: np.diff(self.t[max(0, a - 1) : b].astype(np.int64), prepend=-1 if a == 0 else [])[: b - a] != 0)
        left = pos - self.starts[np.searchsorted(self.starts, pos, side="right") - 1]
        done = 0
        while len(pos := pos[left > done]):
            left = left[left > done]
            end = done + max(1, block // len(pos))
            many = np.minimum(left, end) - done
            who = np.repeat(np.arange(len(pos)), many)
            step = done + 1 + np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
            by = np.lexsort((who, step))
            put((pos[who] - step)[by])
            done = end

    def _taken(self, c: int, d: int, low: Queue, high: Queue, up: bool, joint) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """Blocks (position, shared with the one taken before) of the characters c to d."""
        a, b, e, f = low.first[c], low.first[d + 1], high.first[c], high.first[d + 1]
        if c < d:
            pos = np.concatenate((low.pos[a:b], high.pos[e:f])).astype(np.int64)
            pos = pos[np.argsort(self.t[pos].astype(np.int64) * 2 + (np.arange(len(pos)) >= b - a), kind="stable")]
            yield (pos if up else pos[::-1]), None
            return
        parts = [(low, x, y) for x, y in self.space.blocks(b, a)] + [(high, x, y) for x, y in self.space.blocks(f, e)]
        above = 0
        for q, x, y in parts if up else parts[::-1]:
            pos, shared = q.pos[x:y].astype(np.int64), None
            if joint:
                shared = q.shared[x:y].astype(np.int64)
                if x == q.first[c]:
                    shared[0] = joint(int(low.pos[b - 1]), int(pos[0])) if q is high and b > a else 0
                if not up:
                    shared, above = np.append(shared[1:], above)[::-1], int(shared[0])
            yield (pos if up else pos[::-1]), shared

    def _give(self, pos: np.ndarray, shared: np.ndarray | None, target: Queue, since: np.ndarray | None, up: bool) -> None:
        before = np.maximum(pos - 1, 0)
        to = self.t[before].astype(np.int64)
        at = np.flatnonzero((pos > 0) & (self.kind[before] != up) & (to != self.t[pos]))
        at = at[np.argsort(to[at], kind="stable")]
        to = to[at]
        if shared is None:
            target.put(to, before[at])
            return
        new, starts = np.zeros(len(at), np.int64), np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1]))) if len(to) else []
        least, rest = int(shared.min()), {}
        for a, b in zip(starts, np.append(starts[1:], len(to))):
            mine, k = at[a:b], int(to[a])
            part = np.minimum.reduceat(shared[: mine[-1] + 1], np.concatenate(([0], mine[:-1] + 1)))
            part[0] = min(part[0], since[k])
            new[a:b] = part + 1
            if since[k] == FAR:
                new[a] = 0
            rest[k] = int(shared[mine[-1] + 1 :].min(initial=FAR - 1))
        target.put(to, before[at], new)
        seen = since != FAR
        since[seen] = np.minimum(since[seen], least)
        for k, v in rest.items():
            since[k] = v


class Joint:
    """Shared prefixes that the scans don't tell."""

    def __init__(self, hashes: Hashes, most: int):
        self.hashes, self.most = hashes, most

    def __call__(self, a: int, b: int) -> int:
        return int(self.hashes.shared(np.array([a]), np.array([b]), self.most)[0])


def _direct(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names that fits in memory, by doubling the length that ranks stand for."""
    rank, h, n = names.astype(np.int64), 1, len(names)
    while True:
        after = np.concatenate((rank[h:] + 1, np.zeros(min(h, n), np.int64)))[:n]
        order = np.lexsort((after, rank))
        a, b = rank[order], after[order]
        new = np.concatenate(([0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        if new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        h *= 2


def _equal(t: np.ndarray, a: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether the stretches of ``m`` (one at least) characters at a and b are equal, character by character."""
    ends = np.cumsum(m)
    step = np.arange(ends[-1]) - np.repeat(ends - m, m)
    return np.add.reduceat(t[np.repeat(a, m) + step] != t[np.repeat(b, m) + step], ends - m, dtype=np.int64) == 0


def _sorted_stars(x: Text, star: np.ndarray) -> np.ndarray:
    """The S* in order."""
    space, t = x.space, x.t
    seeds = Queue(x.counts(x.star), space, True, False, x.n)
    for a, b in space.blocks(len(star)):
        c = t[star[a:b]].astype(np.int64)
        by = np.argsort(c, kind="stable")
        seeds.put(c[by], star[a:b][by])
    if len(star) < 2:
        return seeds.pos
    _, smaller = x.induce(seeds, None, 0)
    got, n = space.places(len(star), x.n), 0
    for a, b in space.blocks(len(smaller.pos)):
        pos = smaller.pos[a:b].astype(np.int64)
        pos = pos[(pos > 0) & ~x.kind[np.maximum(pos - 1, 0)]]
        got[n : n + len(pos)] = pos
        n += len(pos)
    del seeds, smaller
    reduced, name, before = space.places(len(star), x.n), -1, None
    for a, b in space.blocks(len(got)):
        pos = got[a:b].astype(np.int64)
        at = np.searchsorted(star, pos)
        # the last piece ends with the text and equals no other
        length = np.where(at + 1 < len(star), star[np.minimum(at + 1, len(star) - 1)] - pos + 1, 0)
        prev, prev_length = (np.append(p[:1] if before is None else [q], p[:-1]) for p, q in ((pos, before and before[0]), (length, before and before[1])))
        new = (length != prev_length) | (length == 0) | (prev_length == 0)
        if before is None:
            new[0] = True
        same = np.flatnonzero(~new)
        if len(same):
            new[same] = ~_equal(t, pos[same], prev[same], length[same])
        names = name + np.cumsum(new)
        reduced[at], name, before = names, int(names[-1]), (int(pos[-1]), int(length[-1]))
    if name == len(star) - 1:
        return got
    if len(star) <= space.direct:
        return star[_direct(np.asarray(reduced))]
    n = 0
    for pos, _ in order(reduced, space, 0):
        got[n : n + len(pos)] = star[pos]
        n += len(pos)
    return got


def order(t: np.ndarray, space: Space, most: int) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Blocks (position, length shared with the suffix before) of all suffixes in order, lengths up to ``most`` being
    exact; ``most`` 0: without shared lengths."""
    x = Text(t, space)
    star = space.where(len(t), x.star)
    placed = _sorted_stars(x, star)
    seeds, joint = Queue(x.counts(x.star), space, True, bool(most), x.n), Joint(Hashes(t, space), most) if most else None
    for a, b in space.blocks(len(placed)):
        pos = placed[a:b].astype(np.int64)
        shared = joint.hashes.shared(np.append(int(placed[max(0, a - 1)]), pos[:-1]), pos, most) if most else None
        seeds.put(t[pos].astype(np.int64), pos, shared)
    larger, smaller = x.induce(seeds, joint, most)
    for c in range(x.letters) if most else ():
        yield from x._taken(c, c, larger, smaller, True, joint)
    size, c = larger.first + smaller.first, 0
    while not most and c < x.letters:
        end = max(c + 1, int(np.searchsorted(size, size[c] + space.block, side="right")) - 1)
        yield from x._taken(c, end - 1, larger, smaller, True, None)
        c = end


def repeated(t: np.ndarray, lengths: np.ndarray, size: int, space: Space) -> Iterator[np.ndarray]:
    """For each string of ``t`` (strings of these lengths, each followed by a 0, of characters above 0) the starts of its
    stretches of ``size`` that also start elsewhere in ``t``; each is compared once more, character by character."""
    mark, before = space.array(len(t) + 1, bool), 0
    partner = space.places(len(t), len(t))  # 1 + a place of the same stretch
    for pos, shared in order(t, space, size):
        hit = np.flatnonzero(shared >= size)
        partner[pos[hit]] = np.append(before, pos[:-1])[hit] + 1
        before = pos[-1]
    step = max(1, space.block // size)
    for a, b in space.blocks(len(t)):
        one = np.flatnonzero(partner[a:b]) + a
        two = partner[one].astype(np.int64) - 1
        # after a stretch that is equal, only the next character of both needs a look
        follows = np.concatenate(([False], (np.diff(one) == 1) & (np.diff(two) == 1)))[: len(one)]
        follows &= bool((t[one[follows] + size - 1] == t[two[follows] + size - 1]).all())
        ok, rest = follows.copy(), np.flatnonzero(~follows)
        for i in range(0, len(rest), step):
            at = rest[i : i + step]
            ok[at] = _equal(t, one[at], two[at], np.full(len(at), size))
        if not ok.all():  # hashes that agree by chance: nothing is taken over from a neighbour
            for i in range(0, len(one), step):
                ok[i : i + step] = _equal(t, one[i : i + step], two[i : i + step], np.full(len(one[i : i + step]), size))
        mark[one[ok]] = mark[two[ok]] = True
    a = 0
    for m in lengths.tolist():
        yield np.flatnonzero(mark[a : a + max(0, m - size + 1)])
        a += m + 1
