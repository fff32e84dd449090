"""External induced suffix sorting with common prefixes, for one shard of texts.

Suffixes are S or L by the character that follows their run.  Sorted S* suffixes (S after L) induce all L suffixes in
ascending order, these induce all S suffixes in descending order.  A tuple in the priority queues is a suffix's place and
the length of the prefix that it shares with the tuple before it in its bucket; the queues hand tuples out by first character
and, inside it, in order of arrival, which is their sorted order.  Tuples are handled in blocks of arrays; what the queues
hold beyond ``MEMORY`` items lies in a file, and so do text, types and marks of a larger shard.

S* suffixes are sorted by naming their substrings (an induction without prefixes) and, if names repeat, by the same
procedure on the names; up to ``DIRECT`` names the recursion ends with prefix doubling.  Order beyond the length that is asked for
does not matter, so it is left open.

Common prefixes are carried through both inductions, up to the length that is asked for.  Those of neighbouring S* suffixes are
read off the text, by running hashes.
"""

from __future__ import annotations

import os
import tempfile
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np

MEMORY = 1 << 23
BLOCK = 1 << 17
DIRECT = 1 << 22
PRIME = 0x9E3779B97F4A7C15


class Disk:
    """Arrays of a shard: in memory when small, else in files of a folder that goes with the sort."""

    def __init__(self, memory: int = MEMORY):
        self.memory = memory
        self.folder = tempfile.TemporaryDirectory(prefix="induced-")
        self.number = 0

    def path(self) -> str:
        self.number += 1
        return os.path.join(self.folder.name, str(self.number))

    def array(self, n: int, dtype) -> np.ndarray:
        if n <= self.memory:
            return np.zeros(n, dtype)
        return np.memmap(self.path(), dtype, "w+", shape=(n,))

    def close(self) -> None:
        self.folder.cleanup()


class Queue:
    """First-in-first-out lists of (place, prefix) blocks by character, in a file beyond the memory limit."""

    def __init__(self, disk: Disk):
        self.disk, self.lists = disk, defaultdict(deque)
        self.held, self.file = 0, None

    def push(self, char: int, place: np.ndarray, prefix: np.ndarray) -> None:
        if self.held + len(place) > self.disk.memory:
            if self.file is None:
                self.file = open(self.disk.path(), "w+b")
            self.file.seek(0, 2)
            at = self.file.tell()
            self.file.write(place.tobytes())
            self.file.write(prefix.tobytes())
            self.lists[char].append((at, len(place)))
        else:
            self.held += len(place)
            self.lists[char].append((place, prefix))

    def _load(self, entry) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(entry[0], np.ndarray):
            return entry
        self.file.seek(entry[0])
        return np.frombuffer(self.file.read(8 * entry[1]), np.int64), np.frombuffer(self.file.read(entry[1]), np.uint8)

    def pop(self, char: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The next block, joined with small ones behind it."""
        own = self.lists.get(char)
        if not own:
            return None
        parts, size = [], 0
        while own and (not parts or size < BLOCK):
            entry = own.popleft()
            if isinstance(entry[0], np.ndarray):
                self.held -= len(entry[0])
            parts.append(self._load(entry))
            size += len(parts[-1][0])
        if len(parts) == 1:
            return parts[0]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def backwards(self, char: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All blocks from last to first, without taking them away."""
        for entry in reversed(self.lists.get(char, ())):
            yield self._load(entry)

    def close(self) -> None:
        if self.file:
            self.file.close()


class Carry:
    """Common prefixes of successive tuples of a bucket: one more than the least prefix passed since the last one."""

    def __init__(self, chars: int, cap: int):
        self.cap = cap
        self.least = np.full(chars, -1, np.int64)  # -1: nothing sent yet, its first tuple shares nothing

    def push(self, target: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        """``target``: bucket of each traversed tuple, -1 for none; ``prefix``: shared with the tuple before."""
        n = len(target)
        sent = np.flatnonzero(target >= 0)
        order = sent[np.argsort(target[sent].astype(np.int16), kind="stable")]
        bucket = target[order]
        out = np.zeros(len(order), np.int64)
        opens = np.append(True, bucket[1:] != bucket[:-1]) if len(order) else np.zeros(0, bool)
        running = np.minimum.accumulate(prefix)
        if len(order):
            at = order[opens]
            out[opens] = np.minimum(self.least[bucket[opens]], running[at])
            inner = np.flatnonzero(~opens)
            lo, hi = order[inner - 1] + 1, order[inner]  # least prefix over lo .. hi
            span = hi - lo + 1
            level = np.frexp(span.astype(np.float64))[1] - 1
            table, width = prefix, 1
            for k in range(int(level.max(initial=-1)) + 1):
                pick = level == k
                if pick.any():
                    out[inner[pick]] = np.minimum(table[lo[pick]], table[hi[pick] - width + 1])
                if 2 * width <= n:
                    table = np.minimum(table[:len(table) - width], table[width:])
                width *= 2
        self.least = np.minimum(self.least, running[-1])
        if len(order):
            closes = np.append(opens[1:], True)
            last = order[closes]
            suffix = np.append(np.minimum.accumulate(prefix[::-1])[::-1], self.cap)
            self.least[bucket[closes]] = suffix[last + 1]
        result = np.zeros(n, np.uint8)
        result[order] = np.minimum(out + 1, self.cap)
        return result


def _types(text: np.ndarray, out: np.ndarray) -> None:
    """True for S; the last character, the smallest, is S."""
    n = len(text)
    out[n - 1] = True
    carry = True
    for hi in range(n - 1, 0, -4 * BLOCK):
        lo = max(0, hi - 4 * BLOCK)
        a, b = text[lo:hi], text[lo + 1:hi + 1]
        rising, differs = a < b, a != b
        # an equal neighbour takes the type of the next place that differs
        place = np.where(differs, np.arange(len(a)), len(a))
        following = np.minimum.accumulate(place[::-1])[::-1]
        known = np.append(rising, carry)
        out[lo:hi] = known[following]
        carry = bool(out[lo])


def _characters(text: np.ndarray) -> np.ndarray:
    """The distinct characters, ascending."""
    seen = np.zeros(int(text.max()) + 1, bool)
    seen[text] = True
    return np.flatnonzero(seen)


def _run(text: np.ndarray, place: int, cap: int) -> int:
    piece = text[place:place + cap]
    other = np.flatnonzero(piece != piece[0])
    return int(other[0]) if len(other) else len(piece)


def _induce(text, types, seeds, seed_prefix, disk: Disk, cap: int, mark=None, wanted=None) -> np.ndarray:
    """Both inductions from S* suffixes in order of their first character at least.

    ``mark(places)`` is called for suffixes with a neighbour that shares ``cap`` characters; ``wanted``: flags of places
    whose sorted order is returned.
    """
    chars = _characters(text)
    most = int(chars[-1]) + 1
    prefixes = mark is not None
    lefts, queue = Queue(disk), Queue(disk)
    carry = Carry(most, cap) if prefixes else None

    def send(place, prefix, ascending):
        """Put the predecessors of the wanted type into the queue."""
        before = place - 1
        ok = place > 0
        before[~ok] = 0
        ok &= ~types[before] if ascending else types[before]
        target = np.where(ok, text[before].astype(np.int64), -1)
        shared = carry.push(target, prefix.astype(np.int64)) if prefixes else None
        sent = np.flatnonzero(target >= 0)
        key = target[sent]
        order = sent[np.argsort(key.astype(np.int16) if most < 1 << 15 else key, kind="stable")]
        key = target[order]
        cuts = np.flatnonzero(np.diff(key, prepend=-1, append=-1))
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            own = order[a:b]
            queue.push(int(key[a]), before[own], shared[own] if prefixes else np.zeros(b - a, np.uint8))

    edges = np.searchsorted(text[seeds], chars, "left"), np.searchsorted(text[seeds], chars, "right")
    last_left = {}
    for c, lo, hi in zip(chars.tolist(), edges[0].tolist(), edges[1].tolist()):
        before = None
        while block := queue.pop(c):
            place, prefix = block
            lefts.push(c, place, prefix)
            if prefixes:
                near = np.flatnonzero(prefix >= cap)
                mark(place[near])
                mark(np.append(before if before is not None else place[0], place)[near])
            before = place[-1]
            send(place, prefix, True)
        if before is not None:
            last_left[c] = int(before)
        for a in range(lo, hi, BLOCK):
            place = seeds[a:min(a + BLOCK, hi)]
            prefix = seed_prefix[a:min(a + BLOCK, hi)].copy() if prefixes else np.zeros(len(place), np.uint8)
            if prefixes and a == lo:
                prefix[0] = 0 if before is None else min(_run(text, int(before), cap), _run(text, int(place[0]), cap))
            send(place.copy(), prefix, True)
    queue.close()
    queue = Queue(disk)
    if prefixes:
        carry = Carry(most, cap)
    found = []
    for c in reversed(chars.tolist()):
        before = None
        while block := queue.pop(c):
            place, prefix = block
            if prefixes:
                near = np.flatnonzero(prefix >= cap)
                mark(place[near])
                mark(np.append(before if before is not None else place[0], place)[near])
            if wanted is not None:
                found.append(place[wanted[place]])
            before = place[-1]
            send(place.copy(), prefix, False)
        shared = 0
        if before is not None and c in last_left and prefixes:
            shared = min(_run(text, int(before), cap), _run(text, last_left[c], cap))
            if shared >= cap:
                mark(np.array([before, last_left[c]]))
        for place, prefix in lefts.backwards(c):
            turned = np.append(shared, prefix[:0:-1]).astype(np.uint8)  # shared with the larger neighbour
            send(place[::-1].copy(), turned, False)
            shared = int(prefix[0])
    queue.close()
    lefts.close()
    return np.concatenate(found)[::-1] if found else np.zeros(0, np.int64)


def _doubling(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a sequence by at least ``depth`` names; only names of groups not yet split are sorted again."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    ranked = names[order]
    start = np.maximum.accumulate(np.where(np.append(True, ranked[1:] != ranked[:-1]), np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    slots = np.arange(n)  # of ``order``: those in groups of several
    step = 1
    while True:
        own = start[slots]
        several = np.append(own[1:] == own[:-1], False) | np.append(False, own[1:] == own[:-1]) if len(slots) else np.zeros(0, bool)
        slots = slots[several]
        if not len(slots) or step >= depth:
            return order
        place = order[slots]
        after = np.where(place + step < n, rank[np.minimum(place + step, n - 1)] + 1, 0)
        sort = np.argsort(rank[place] * (n + 1) + after)
        place, after = place[sort], after[sort]
        order[slots] = place
        group = rank[place]
        fresh = np.append(True, (group[1:] != group[:-1]) | (after[1:] != after[:-1]))
        start[slots] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        rank[place] = start[slots]
        step *= 2


def _starts(types: np.ndarray) -> np.ndarray:
    parts = [lo + np.flatnonzero(types[lo + 1:lo + 1 + 4 * BLOCK] & ~types[lo:len(types) - 1][:4 * BLOCK]) + 1
             for lo in range(0, len(types) - 1, 4 * BLOCK)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _sorted_stars(text, types, disk: Disk, depth: int) -> np.ndarray:
    """S* suffixes in order of ``depth`` characters at least.  Two of them are two or more apart."""
    stars = _starts(types)
    if len(stars) < 2:
        return stars
    flags = disk.array(len(text), bool)
    flags[stars] = True
    seeds = stars[np.argsort(text[stars], kind="stable")]
    order = _induce(text, types, seeds, None, disk, 0, wanted=flags)
    if len(order) < len(stars):  # the last character has no successor that could induce it
        order = np.append(stars[-1:], order)
    number = np.searchsorted(stars, order)
    length = np.append(stars[1:], len(text) - 1)[number] - order
    same = length[1:] == length[:-1]
    a, b, left = order[:-1], order[1:], length[1:]
    live = np.flatnonzero(same)
    at = 0
    while len(live):
        live = live[left[live] >= at]
        equal = text[a[live] + at] == text[b[live] + at]
        same[live[~equal]] = False
        live = live[equal]
        at += 1
    names = np.append(0, np.cumsum(~same))
    if names[-1] == len(order) - 1:
        return order
    reduced = np.empty(len(stars), np.int64)
    reduced[number] = names
    return stars[suffix_order(reduced, disk, depth // 2 + 1)]


def suffix_order(names: np.ndarray, disk: Disk, depth: int) -> np.ndarray:
    """Suffixes of a sequence in order of ``depth`` names at least; its last name is its smallest and occurs once."""
    if len(names) <= DIRECT:
        return _doubling(names, depth)
    types = disk.array(len(names), bool)
    _types(names, types)
    stars = _sorted_stars(names, types, disk, depth)
    class All:
        def __getitem__(self, place):
            return np.ones(len(place), bool)
    # ascending S order from the second induction, L order from the first, merged by first name
    rights = _induce(names, types, stars, None, disk, 0, wanted=All())
    rights = np.append(len(names) - 1, rights)  # nothing induces the last one, the smallest
    lefts = _left_order(names, types, stars, disk)
    lists = np.concatenate([lefts, rights])
    return lists[np.lexsort((np.append(np.zeros(len(lefts), np.int8), np.ones(len(rights), np.int8)), names[lists]))]


def _left_order(names, types, stars, disk: Disk) -> np.ndarray:
    """L suffixes in sorted order, induced from the sorted S* suffixes."""
    queue, out = Queue(disk), []
    chars = _characters(names)
    lo, hi = np.searchsorted(names[stars], chars, "left"), np.searchsorted(names[stars], chars, "right")

    def send(place):
        place = place[place > 0]
        before = place[~types[place - 1]] - 1
        key = names[before]
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order], prepend=-1, append=-1))
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            queue.push(int(key[order[a]]), before[order[a:b]], np.zeros(b - a, np.uint8))
    for c, a, b in zip(chars.tolist(), lo.tolist(), hi.tolist()):
        while block := queue.pop(c):
            out.append(block[0])
            send(block[0])
        if b > a:
            send(stars[a:b])
    queue.close()
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _shared(text: np.ndarray, order: np.ndarray, cap: int, disk: Disk) -> np.ndarray:
    """Common prefixes, up to ``cap``, of neighbours in ``order``; 0 for the first.

    Stretches are compared by a 64-bit running hash, of halving lengths.
    """
    n = len(text)
    numbers = np.random.default_rng(13).integers(1, 1 << 63, int(text.max()) + 1, np.int64).astype(np.uint64)
    sums, powers = disk.array(n + 1, np.uint64), disk.array(n + 1, np.uint64)
    prime, power, total = np.uint64(PRIME), np.uint64(1), np.uint64(0)
    with np.errstate(over="ignore"):
        for lo in range(0, n + 1, BLOCK):
            size = min(BLOCK, n + 1 - lo)
            powers[lo:lo + size] = power * np.multiply.accumulate(np.append(np.uint64(1), np.full(size - 1, prime)))
            power = powers[lo + size - 1] * prime
            own = np.cumsum(numbers[text[lo:lo + size]] * powers[lo:lo + size][:len(text[lo:lo + size])], dtype=np.uint64) + total
            sums[lo + 1:lo + 1 + len(own)] = own
            total = own[-1] if len(own) else total
        out = np.zeros(len(order), np.uint8)
        for lo in range(1, len(order), BLOCK):
            b = order[lo:lo + BLOCK]
            a = order[lo - 1:lo - 1 + len(b)]
            size = np.zeros(len(b), np.int64)
            step = 1 << (cap.bit_length() - 1)
            while step:
                x, y = a + size, b + size
                fits = (size + step <= cap) & (np.maximum(x, y) + step <= n)
                x, y = np.where(fits, x, 0), np.where(fits, y, 0)
                end = np.where(fits, step, 0)
                # each side moved to the other's power
                same = (sums[x + end] - sums[x]) * powers[y] == (sums[y + end] - sums[y]) * powers[x]
                size += np.where(fits & same, step, 0)
                step >>= 1
            out[lo:lo + len(b)] = size
    return out


def repeated(text: np.ndarray, size: int, disk: Disk) -> np.ndarray:
    """Flags of the places whose ``size`` characters also start elsewhere in ``text``.

    ``text`` holds small numbers; its last one is its smallest and occurs once.  ``size`` is below 255.
    """
    flags = disk.array(len(text), bool)
    types = disk.array(len(text), bool)
    _types(text, types)
    stars = _sorted_stars(text, types, disk, size)
    shared = _shared(text, stars, size, disk)
    near = np.flatnonzero(shared >= size)
    flags[stars[near]] = True
    flags[stars[near - 1]] = True

    def mark(places):
        flags[places] = True
    _induce(text, types, stars, shared, disk, size, mark=mark)
    return flags
