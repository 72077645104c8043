"""Fuzzy line deduplication: of lines that are nearly the same anywhere in a collection, one occurrence stays.

Lines are normalised (lower case; one space for every run of ASCII characters other than letters and digits).  Equal normalised
lines are one.  Lines are alike within three edits of a character, or two in a hundred characters if that is more, but one in ten
at most.  Each different line is filed in buckets by two kinds of keys:

* Parts get a SimHash of their own: the words with equal leading hash bits (sixteen parts, some of them together where they are
  small).  An edit touches few parts, so by the pigeonhole principle lines that differ by few edits mostly keep some part.
* Stretches make sure that no pair is missed.  So many edits leave a stretch of characters as it was: k edits of n characters one
  of (n - k) / (k + 1) at least.  Of a line under LONG characters the segments are keys, with length and place, at each of the
  places where a line alike may have them (segments k + 1, shifts as in Pass-Join).  Of a longer line the least q-gram hash of
  every window as long as the stretch is a key (winnowing), so both lines have the one of the stretch they share.

Keys are counted in packed arrays dealt out by leading bits, and only what several lines have comes back, if their signatures
(counts of characters) leave it open that two of them are alike.  Pairs that meet are
verified by edit similarity of the normalised lines, and connected groups of verified links keep their first occurrence, by
document id and line number.
"""

from __future__ import annotations

import functools
import itertools
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, components, group_starts, mixed, partitions, sliced, sorted_groups, table

NAME = "op5_fuzzy_lines"
SQL = None  # SQL has no SimHash; tested against brute force


class Likeness(NamedTuple):
    """How many edits of characters two lines may be apart: a few, or by the similarity if that is more; never beyond floor and ceiling.

    There is no ceiling unless a caller sets one.
    """

    similarity: float = 0.98
    edits: int = 3
    floor: float = 0.9
    ceiling: int = 1 << 40

    def allowed(self, size: np.ndarray) -> np.ndarray:
        """For the longer one's number of characters."""
        size = np.asarray(size)
        by = lambda x: ((1 - x) * size + 1e-9).astype(np.int64)
        return np.minimum(np.minimum(by(self.floor), self.ceiling), np.maximum(self.edits, by(self.similarity)))

    def most(self, size: int) -> int:
        return min(int((1 - self.floor) * size + 1e-9), self.ceiling, max(self.edits, int((1 - self.similarity) * size + 1e-9)))


LIKENESS = Likeness()
#: The normalised bytes below which lines are left alone: all but blank ones count.
LEAST_CHARS = 1
#: Bytes of words that a part chosen by hash must hold to be a block.
PART_BYTES = 24
#: Bytes of words in two, three and four sixths of a line between which they are a block.
SIXTHS = {2: (20, 48), 3: (12, 28), 4: (6, 14)}
#: Longer words, and writing without spaces, are cut: a word to pieces of so many bytes.
LONG_WORD, PIECE = 24, 12
#: Characters from which a line's stretches come from windows; lengths from which windows are longer.
LONG = (120, 150, 200, 400, 850, 1_600, 12_800)
#: Characters of the grams that windows choose from, at most: rare enough in unrelated lines, however many there are.
GRAM = 18
#: Keys are dealt out by so many leading bits; a task packs so many of them at a time.
SLOT_BITS, PACKED = 12, 1_000_000
#: Numbers of characters at which a signature's level rises, and at which its counters become coarser (twice each time).
LEVELS = (20, 30, 200, 250, 300, 350, 400, 500, 600, 700, 850, 1_050, 1_650, 3_300, 13_000)
COARSER = (350, 850, 1_650, 3_300)
#: Lines of a bucket up to which their signatures are compared pair by pair where the bucket is found.
SIGNED = 256
#: Lines of a bucket that are compared in one task; larger buckets are compared tile by tile.
TILE = 1_000
#: Buckets of two lines or more (some 50 bytes each), and documents with candidate lines or lines to go (some 100 bytes and 4 a
#: line), up to which they are joined by broadcast, so 100 MB at most; more by a shuffle.
FEW_BUCKETS, FEW_DOCS = 2_000_000, 600_000
#: ASCII characters other than letters and digits become spaces; bytes of other characters stay.
_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_PLAIN_LINES = _PLAIN[:10] + b"\n" + _PLAIN[11:]


def plain(line: str) -> bytes:
    """A normalised line, in UTF-8."""
    return b" ".join(line.lower().encode("utf-8", "replace").translate(_PLAIN).split())


def normalised(line: str) -> str:
    return plain(line).decode()


_FACTOR = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """_FACTOR to the power 0..n, and its inverse, modulo 2^64."""
    if len(_POWERS[0]) <= n:
        for k, x in enumerate((_FACTOR, pow(_FACTOR, -1, 2**64))):
            steps = np.full(2 * n + 1, x, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


def tokens_of(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, bytes, number of its line) of every word of normalised lines, none empty: no Python object for a word.

    Characters of three bytes or more, which scripts without spaces use, are words of their own; long words are cut.
    """
    data = np.frombuffer(b" ".join(lines) + b" ", np.uint8)
    up, down = _powers(len(data))
    space = data == 32
    start = ~space & np.r_[True, space[:-1]]
    wide = data >= 0xE0
    if wide.any():
        after = np.zeros(len(data), bool)
        after[3:] |= (wide & (data < 0xF0))[:-3]
        after[4:] |= (data >= 0xF0)[:-4]
        start |= wide | (after & ~space & ((data & 0xC0) != 0x80))
    starts = np.flatnonzero(start)
    spaces = np.flatnonzero(space)
    ends = np.minimum(spaces[np.searchsorted(spaces, starts)], np.r_[starts[1:], len(data)])
    size = ends - starts
    if len(size) and size.max() > LONG_WORD:
        pieces = np.where(size > LONG_WORD, size // PIECE, 1)
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts, last = np.repeat(starts, pieces) + PIECE * nth, np.repeat(ends, pieces)
        ends = np.where(nth + 1 == np.repeat(pieces, pieces), last, starts + PIECE)
        size = ends - starts
    total = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])]
    first = np.cumsum([0, *(len(x) + 1 for x in lines[:-1])])
    return mixed((total[ends] - total[starts]) * down[starts]), size, np.searchsorted(first, starts, side="right") - 1


#: The bits of a byte as eight counters of eight bits in one number.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).copy().view(np.uint64).ravel()


def simhashes(hashes: np.ndarray, part: np.ndarray, parts: int, width: int) -> np.ndarray:
    """SimHash of width bytes of each of so many parts, 0 where one is empty: a bit is set if most hashes have it.

    hashes come sorted by the number of their part; those of a part may come in any order.
    """
    out = np.zeros((parts, 8), np.uint8)
    if len(hashes):
        at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        sizes = np.diff(np.r_[at, len(part)])
        pieces = -(-sizes // 255)  # a counter holds 255
        of = np.repeat(np.arange(len(sizes)), pieces)
        starts = at[of] + 255 * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        lanes = _SPREAD[hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]]
        counts = np.add.reduceat(lanes, starts, axis=0).view(np.uint8).reshape(-1, 8 * width).astype(np.int32)
        if len(of) > len(sizes):
            counts = np.add.reduceat(counts, np.cumsum(pieces) - pieces, axis=0)
        out[part[at], :width] = np.packbits(2 * counts > sizes[:, None], axis=1)
    return out.view("<u8").ravel().astype(np.uint64)


_ODD = mixed(np.arange(5001, 5009, dtype=np.uint64)) | np.uint64(1)


def _drawn(kinds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """What a block's key is mixed from: the number of its kind and the SimHashes of its parts, along the last axis."""
    return (values * _ODD[: values.shape[-1]]).sum(-1, dtype=np.uint64) + mixed(kinds)


def _blocks(lines: list[bytes], sixths: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(number of the line, key) of every block of some lines."""
    h, size, line = tokens_of(lines)
    n = len(lines)
    # Parts by the leading four bits of a word's hash; where parts are too small, two, four or eight of them together.  A word
    # counts once, or else one that is often there would decide the part's SimHash alone.
    order = np.argsort((line.astype(np.uint64) << np.uint64(42)) | (h >> np.uint64(22)))
    once, of, held = h[order], line[order], size[order]
    new = np.r_[True, (once[1:] != once[:-1]) | (of[1:] != of[:-1])] if len(once) else np.zeros(0, bool)
    once, leaf, held = once[new], of[new] * 16 + (once[new] >> np.uint64(60)).astype(np.int64), held[new]
    sims = simhashes(once, leaf, 16 * n, 6).reshape(n, 16)
    held = np.bincount(leaf, held, 16 * n).reshape(n, 16)
    poor = held.sum(1) < 3 * PART_BYTES  # few different words: a part may be too small, so pairs of sixths count at any length
    owners, drawn = [], []
    below = np.zeros((n, 16), bool)
    for width in (1, 2, 4, 8):
        own = held.reshape(n, -1, width).sum(2) >= PART_BYTES
        own &= ~below.reshape(n, -1, width).any(2)
        at, k = np.nonzero(own)
        owners.append(at)
        drawn.append(_drawn(100 * width + k, sims.reshape(n, -1, width)[at, k]))
        below |= np.repeat(own, width, axis=1)
    if not sixths:
        return np.concatenate(owners), mixed(np.concatenate(drawn))
    # Sixths of short lines, by the place of a word; two sixths of a longer line hold too much to be a block.
    bytes_of = np.bincount(line, size, n)
    keep = (poor | (bytes_of < 6 * SIXTHS[2][1]))[line]
    h, size, line = h[keep], size[keep], line[keep]
    short, line = np.unique(line, return_inverse=True)
    n, poor, count = len(short), poor[short], np.bincount(line, minlength=len(short))
    nth = np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count)
    sixth = line * 6 + nth * 6 // count[line]
    held = np.bincount(sixth, size, 6 * n).reshape(n, 6)
    sims = simhashes(h, sixth, 6 * n, 3).reshape(n, 6)
    for many, (low, high) in SIXTHS.items():
        chosen = np.array(list(itertools.combinations(range(6), many)))
        bytes_ = held[:, chosen].sum(2)
        at, k = np.nonzero((bytes_ >= low) & ((bytes_ < high) | (poor[:, None] & (many == 2))))
        owners.append(short[at])
        drawn.append(_drawn(1000 * many + k, sims[at[:, None], chosen[k]]))
    return np.concatenate(owners), mixed(np.concatenate(drawn))


def blocks(lines: list[bytes], most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, keys): the keys of line i are keys[bounds[i] : bounds[i + 1]]; some bytes are worked on at a time."""
    owner, keys, at = [], [], 0
    while at < len(lines):
        end, size = at, 0
        while end < len(lines) and (end == at or size + len(lines[end]) < most):
            size += len(lines[end])
            end += 1
        o, k = _blocks(lines[at:end])
        order = np.lexsort((k, o))
        owner.append(o[order] + at)
        keys.append(k[order])
        at = end
    owner = np.concatenate(owner) if owner else np.empty(0, np.int64)
    return np.searchsorted(owner, np.arange(len(lines) + 1)), np.concatenate(keys) if keys else np.empty(0, np.uint64)


@functools.lru_cache(None)
def _places(n: int, likeness: Likeness) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, size, salt) of what a line of n characters is filed under, to meet each shorter or longer one it may be like.

    The shorter one is cut to one segment more than there may be edits, so one is left as it was; the longer one has it not
    further from its place than the edits before and after it allow.
    """

    def cut(size: int, edits: int) -> list[tuple[int, int]]:
        at = [size * i // (edits + 1) for i in range(edits + 2)]
        return [(a, b - a) for a, b in itertools.pairwise(at)]

    found, longer = set(), n
    while longer - (most := likeness.most(longer)) <= n and longer < LONG[0]:
        if most:
            found |= {(at, size, most, n, i) for i, (at, size) in enumerate(cut(n, most))}
        longer += 1
    if n < LONG[0] and (most := likeness.most(n)):
        for apart in range(most + 1):
            for i, (at, size) in enumerate(cut(n - apart, most)):
                low, high = max(at - i, at + apart - (most - i), 0), min(at + i, at + apart + most - i, n - size)
                found |= {(x, size, most, n - apart, i) for x in range(low, high + 1)}
    out = np.array(sorted(found), np.int64).reshape(-1, 5)
    salt = mixed((out[:, 2] * 1000 + out[:, 3]) * 1000 + out[:, 4] + 1)
    return out[:, 0], out[:, 1], salt


@functools.lru_cache(None)
def _windows(likeness: Likeness) -> list[tuple[int, int, int, int, int]]:
    """(least length, length too much, q, grams in a window, reach) for lines that meet one of LONG characters or more, by its length.

    Places in a line, and its length, are told apart by multiples of the reach, twice the edits at least.
    """
    out = []
    for low, high in zip(LONG, [*LONG[1:], 1 << 40], strict=True):
        size = np.arange(low, min(high, low + 20_000))
        most = likeness.allowed(size)
        stretch = int((-(-(size - most) // (most + 1))).min())
        q = min(GRAM, max(1, stretch * 3 // 5))
        reach = max(64, 4 * likeness.most(high)) if high <= LONG[-1] else 1 << 50
        out.append((low - likeness.most(low), high, q, stretch - q + 1, reach))
    return out


#: Bits of a place among the texts that are worked on at a time.
_AT_BITS = np.uint64(30)


def code_points(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of characters, all their code points) of some normalised lines."""
    texts = [x.decode("utf-8", "replace") for x in lines]
    return np.array([len(x) for x in texts], np.int64), np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")


#: A character as one of eight counters of eight bits in one number, by the low bits of its code point.
_KIND = np.uint64(1) << (np.uint64(8) * (np.arange(8, dtype=np.uint64)))


@functools.lru_cache(None)
def _limits(likeness: Likeness) -> tuple[np.ndarray, np.ndarray]:
    """(step, limit): how coarse counters are at a level, and by how much those of lines alike may be apart at two; -1: can't be alike."""
    low, high = [0, *LEVELS], [*LEVELS, 1 << 62]
    step = np.array([1 << int(np.searchsorted(COARSER, x, side="right")) for x in low])
    limit = np.full((len(low), len(low)), 1 << 30)
    for a, b in itertools.combinations_with_replacement(range(len(low)), 2):
        if low[b] - likeness.most(low[b]) >= high[a]:
            limit[a, b] = limit[b, a] = -1
        elif step[a] == step[b] and high[b] <= LEVELS[-1]:
            limit[a, b] = limit[b, a] = 2 * likeness.most(high[b] - 1)
    return step, limit


def signatures(lines: list[bytes], points: tuple[np.ndarray, np.ndarray], likeness: Likeness) -> np.ndarray:
    """A number for each line that stands for it: 28 bits of its hash, 4 of the level of its length, 8 counters of characters, 4 each."""
    size, data = points
    pieces = -(-size // 255)  # a counter holds 255
    of = np.repeat(np.arange(len(size)), pieces)
    starts = (np.cumsum(size) - size)[of] + 255 * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    counts = np.add.reduceat(_KIND[data & 7], starts).view(np.uint8).reshape(-1, 8).astype(np.int64)
    if len(of) > len(size):
        counts = np.add.reduceat(counts, np.cumsum(pieces) - pieces, axis=0)
    level = np.searchsorted(LEVELS, size, side="right")
    counts = counts // _limits(likeness)[0][level][:, None] & 15
    out = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x)[:4] for x in lines), ">u4").astype(np.uint64) >> np.uint64(4)
    out = out << np.uint64(4) | level.astype(np.uint64)
    return out << np.uint64(32) | (counts.astype(np.uint64) << (4 * np.arange(8, dtype=np.uint64))).sum(1, dtype=np.uint64)


def may_be_alike(a: np.ndarray, b: np.ndarray, likeness: Likeness) -> np.ndarray:
    """Whether the signatures leave it open that lines are alike: an edit changes two counters by one, at most."""
    step, limit = _limits(likeness)
    level = (a >> np.uint64(32) & np.uint64(15)).astype(np.int64)
    most = limit[level, (b >> np.uint64(32) & np.uint64(15)).astype(np.int64)]
    step = step[level]
    apart = np.zeros(len(a), np.int64)
    for k in range(0, 32, 4):
        d = ((a >> np.uint64(k)) - (b >> np.uint64(k)) & np.uint64(15)).astype(np.int64)
        d = np.minimum(d, 16 - d)
        apart += np.maximum(step * d - (step - 1), 0)
    return apart <= most


def with_partner(first: np.ndarray, n: np.ndarray, lines: np.ndarray, likeness: Likeness) -> np.ndarray:
    """Of buckets, by where each begins and how many lines it has: which lines may be like another there.  Large ones are left as they are."""
    keep = np.zeros(len(lines), bool)
    for size in np.unique(n).tolist():
        starts = first[n == size]
        if size > SIGNED:
            keep[(starts[:, None] + np.arange(size)).ravel()] = True
            continue
        i, j = np.triu_indices(size, 1)
        many = max(1, 200_000 // len(i))
        for at in range(0, len(starts), many):
            a, b = ((starts[at : at + many, None] + x).ravel() for x in (i, j))
            near = may_be_alike(lines[a], lines[b], likeness)
            keep[a[near]] = keep[b[near]] = True
    return keep


def stretches(
    lines: list[bytes],
    likeness: Likeness,
    points: tuple[np.ndarray, np.ndarray] | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """(number of the line, key) of some normalised lines: any two that are alike, but not equal, have a key in common."""
    size, data = points or code_points(lines)
    first = np.cumsum(size) - size
    data = data.astype(np.uint64)
    up, down = _powers(len(data) + 1)
    total = np.r_[np.uint64(0), np.cumsum((data + np.uint64(1)) * up[: len(data)])]
    owners, keys = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for n in np.unique(size[size < LONG[0]]).tolist():
        at, long, salt = _places(n, likeness)
        which = np.flatnonzero(size == n)
        start = first[which][:, None] + at
        keys.append(mixed((total[start + long] - total[start]) * down[start] + salt).ravel())
        owners.append(np.repeat(which, len(at)))
    for low, high, q, w, reach in _windows(likeness):
        which = np.flatnonzero((size >= max(low, q + w - 1)) & (size < high))
        if not len(which):
            continue
        grams = size[which] - q + 1
        ends = np.cumsum(grams)
        at = np.arange(ends[-1]) + np.repeat(first[which] - (ends - grams), grams)
        gram = mixed((total[at + q] - total[at]) * down[at])
        x, have = (gram >> _AT_BITS << _AT_BITS) | np.arange(len(at), dtype=np.uint64), 1  # the first of equal ones
        while have < w:
            step = min(have, w - have)
            x, have = np.minimum(x[:-step], x[step:]), have + step
        new = np.r_[True, x[1:] != x[:-1]]
        new[ends - grams] = True
        for k in range(1, w):  # windows that reach into the next line
            new[(ends - k)[ends - k < len(new)]] = False
        chosen = (x[new] & ((np.uint64(1) << _AT_BITS) - np.uint64(1))).astype(np.int64)
        of = np.searchsorted(ends, chosen, side="right")
        n, place = size[which][of], chosen - (ends - grams)[of]
        # In a line alike, place and length are off by the edits at most: so much higher, they count too.
        most = n
        for _ in range(3):
            most = likeness.allowed(n + most)
        here, long = place // reach, n // reach
        gram = gram[chosen]
        for up_, longer in itertools.product((False, True), repeat=2):
            there, size_ = (place + most) // reach if up_ else here, (n + most) // reach if longer else long
            key = mixed(mixed(gram + np.uint64(q)) + (there * 1_000_003 + size_).astype(np.uint64))
            go = np.r_[True, (key[1:] != key[:-1]) | (of[1:] != of[:-1])]
            go &= (not up_) | (there != here)
            go &= (not longer) | (size_ != long)
            keys.append(key[go])
            owners.append(which[of[go]])
    return np.concatenate(owners), np.concatenate(keys)


def edit_distance(a: str | list, b: str | list, most: int | None = None) -> int:
    """Levenshtein distance of two sequences, by bit vectors of the first's columns; past most, any number above it."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:  # longest common prefix
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    a, b = a[lo:], b[lo:]
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[-mid:] == b[-mid:] else (lo, mid - 1)
    a, b = a[: len(a) - lo], b[: len(b) - lo]
    if not a or not b:
        return len(a) + len(b)
    if most is None:
        most = len(a) + len(b)
    m, at = len(a), {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, left = full, 0, m, len(b)
    for c in b:
        eq = at.get(c, 0)
        v = eq | minus
        h = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | full & ~(h | plus), plus & h
        score += bool(up & top) - bool(down & top)
        left -= 1
        if score - left > most:  # what is left of b can take back one edit for each character
            return score - left
        up, down = (up << 1 | 1) & full, down << 1 & full
        plus, minus = down | full & ~(v | up), up & v
    return score


def within(a: str, b: str, most: int) -> bool:
    """Whether the Levenshtein distance is at most so much: how far each number of edits reaches, for each shift of b against a.

    Takes some most * most / 2 steps, each along a stretch of equal characters, whatever the lengths.
    """
    n, m = len(a), len(b)

    def along(i: int, j: int) -> int:
        """The end in a of the stretch that is equal from a[i] and b[j] on."""
        if a[i : i + 1] != b[j : j + 1]:
            return i
        step = 16
        while i < n and a[i : i + step] == b[j : j + step]:
            i, j, step = i + step, j + step, 4 * step
        while step > 1 and i < n:
            step //= 2
            if a[i : i + step] == b[j : j + step]:
                i, j = i + step, j + step
        return min(i, n)

    shift, far = m - n, {0: along(0, 0)}  # shift: where the end of b lies
    for edits in range(most + 1):
        if far.get(shift, -1) >= n:
            return True
        left = most - edits - 1  # edits that remain after the next one
        reach = {}
        for s in range(max(-edits - 1, shift - left), min(edits + 1, shift + left) + 1):
            # A character of a is replaced, left out, or one of b is put in.
            i = min(max(far.get(s, -2) + 1, far.get(s + 1, -2) + 1, far.get(s - 1, -1)), n, m - s)
            if i >= max(0, -s):
                reach[s] = along(i, i + s)
        far = reach
    return False


#: Characters of the pieces that a line is cut to before its edit distance is found.
CUT = 8


def torn(a: str, b: str, most: int) -> bool:
    """Whether lines are shown to be more than so many edits apart: more pieces of a aren't in b where these could have moved them."""
    missed = 0
    for at in range(0, len(a) - CUT + 1, CUT):
        if b.find(a[at : at + CUT], max(0, at - most), at + CUT + most) < 0:
            missed += 1
            if missed > most:
                return True
    return False


def words_apart(a: list[str], b: list[str], most: float = math.inf) -> int:
    """No less than the edit distance of lines of these words: the cost of one way to align them, found word by word.  Past most, any number above it."""
    i = j = cost = 0
    while i < len(a) and j < len(b) and cost <= most:
        if a[i] == b[j]:
            i, j = i + 1, j + 1
        elif a[i + 1 : i + 3] == b[j : j + 2]:
            cost += len(a[i]) + 1
            i += 1
        elif a[i : i + 2] == b[j + 1 : j + 3]:
            cost += len(b[j]) + 1
            j += 1
        else:
            cost += max(len(a[i]), len(b[j]))
            i, j = i + 1, j + 1
    return cost + sum(map(len, a[i:])) + len(a) - i + sum(map(len, b[j:])) + len(b) - j


def alike(a: str, b: str, likeness: Likeness, by_words: bool = False) -> bool:
    """Whether the edit distance is within what the likeness allows.

    by_words: look at words only, so that some similar lines don't count.
    """
    most = likeness.most(max(len(a), len(b)))
    if abs(len(a) - len(b)) > most or torn(a, b, most):
        return False
    return words_apart(a.split(" "), b.split(" "), most) <= most if by_words else within(a, b, most)


#: Lines of a bucket up to which all pairs are looked at one by one; the bytes of a line under which such pairs may be looked at again.
FEW_PAIRS, LIGHT = 4, 400
_ALL_PAIRS = {n: np.triu_indices(n, 1) for n in range(2, FEW_PAIRS + 1)}
#: Kinds of bytes that lines are counted by before their edit distance is found.
_KINDS = 32


def counts_of(line: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(line, np.uint8) % _KINDS, minlength=_KINDS).astype(np.int32)


def close_pairs(norms: list[bytes], left: np.ndarray | None, likeness: Likeness) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of a bucket that lengths and counts of bytes don't rule out.  left: of two tiles, who is in the first.

    An edit of a character changes at most four bytes, so bounds in bytes are four times those in characters, but for lines
    in ASCII only.
    """
    n = len(norms)
    size, counts = np.array([len(x) for x in norms]), np.stack([counts_of(x) for x in norms])
    plain_ = np.array([x.isascii() for x in norms])
    out_i, out_j = [], []
    for lo in range(0, n, 256):
        i, j = np.nonzero(np.arange(n)[None, :] > np.arange(lo, min(n, lo + 256))[:, None])
        i = i + lo
        if left is not None:
            i, j = i[(across := left[i] != left[j])], j[across]
        most = likeness.allowed(np.maximum(size[i], size[j])) * np.where(plain_[i] & plain_[j], 1, 4)
        near = np.abs(size[i] - size[j]) <= most
        i, j, most = i[near], j[near], most[near]
        for at in range(0, len(i), 100_000):
            a, b = i[at : at + 100_000], j[at : at + 100_000]
            d = counts[a] - counts[b]
            near = np.maximum(np.maximum(d, 0).sum(1), np.maximum(-d, 0).sum(1)) <= most[at : at + 100_000]
            out_i.append(a[near])
            out_j.append(b[near])
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.empty(0, np.int64), np.empty(0, np.int64))


def _key(docs: DataFrame) -> DataFrame:
    """The rows that have an id, with a key that tells rows of one id apart by their text."""
    key = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64("text").cast("string")))
    return docs.select("doc_id", F.coalesce(F.unhex(F.substring(key, 1, 24)), F.lit(b"")).alias("k"), "text")


def _norms(texts: list, least: int) -> tuple[list[int], list[int], list[bytes]]:
    """(number of the text, number of the line, normalised line) of every line of some texts that is long enough."""
    row, number, norms = [], [], []
    for i, text in enumerate(texts):
        # The whole text at once, line by line the same as plain().
        for n, line in enumerate(text.lower().encode("utf-8", "replace").translate(_PLAIN_LINES).split(b"\n") if text else ()):
            norm = b" ".join(line.split())
            if norm and len(norm) >= least:
                row.append(i)
                number.append(n)
                norms.append(norm)
    return row, number, norms


def lines_of(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, k, line, key) of every line that is long enough; line: its number from 0."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for b in sliced(batches, 128):
            row, number, norms = _norms(b.column(2).to_pylist(), least)
            at = pa.array(row, pa.int64())
            cols = [
                b.column(0).take(at),
                b.column(1).take(at),
                pa.array(number, pa.int32()),
                pa.array(list(map(xxhash.xxh3_128_digest, norms)), pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "k", "line", "key"])

    return docs.select("doc_id", "k", "text").filter("doc_id is not null").mapInArrow(run, f"doc_id {kind}, k binary, line int, key binary")


def met(keyed: DataFrame, least: int, likeness: Likeness) -> DataFrame:
    """(bucket, n, x, y, lines) of buckets of several lines, by their signatures; n, x, y tell which lines they are.

    A bucket is 36 bits of a key of blocks() or stretches().  They travel as arrays, some thousand to a row, dealt out by their
    leading bits; an array of those with equal bits is sorted, and what one line alone has goes no further, nor what can't be
    like another line of the bucket by their signatures.
    """
    rest_bytes = 3

    def pack(batches):
        held_keys, held_lines, held = [], [], 0

        def flush():
            key, line = np.concatenate(held_keys), np.concatenate(held_lines)
            slot = (key >> np.uint64(64 - SLOT_BITS)).astype(np.uint16)
            order = np.argsort(slot, kind="stable")
            slot = slot[order]
            rest = (key << np.uint64(SLOT_BITS)).astype(">u8").view(np.uint8).reshape(-1, 8)[order, :rest_bytes]
            line = line[order].astype("<u8")
            at = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
            ends = np.r_[at[1:], len(slot)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(slot[at].astype(np.int32)),
                    pa.array([rest[i:j].tobytes() for i, j in zip(at.tolist(), ends.tolist(), strict=True)], pa.binary()),
                    pa.array([line[i:j].tobytes() for i, j in zip(at.tolist(), ends.tolist(), strict=True)], pa.binary()),
                ],
                names=["slot", "keys", "lines"],
            )

        for b in sliced(batches, 256):
            norms = list(set(_norms(b.column(0).to_pylist(), least)[2]))
            at = 0
            while at < len(norms):
                end, size = at, 0
                while end < len(norms) and (end == at or size + len(norms[end]) < 300_000):
                    size += len(norms[end])
                    end += 1
                part = norms[at:end]
                at = end
                points = code_points(part)
                signed = signatures(part, points, likeness)
                for owner, key in (_blocks(part, False), stretches(part, likeness, points)):
                    held_keys.append(key)
                    held_lines.append(signed[owner])
                    held += len(key)
            if held >= PACKED:
                yield flush()
                held_keys, held_lines, held = [], [], 0
        if held:
            yield flush()

    def shared(batches):
        for g in sorted_groups(batches, ["slot"]):
            keys, lines = ([x or b"" for x in g.column(c).to_pylist()] for c in ("keys", "lines"))
            slot = np.repeat(g.column("slot").to_numpy().astype(np.uint64), [len(x) // rest_bytes for x in keys])
            bucket = np.zeros((len(slot), 8), np.uint8)
            bucket[:, -rest_bytes:] = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, rest_bytes)
            bucket = bucket.view(">u8").ravel().astype(np.uint64) | slot << np.uint64(8 * rest_bytes)
            h = np.frombuffer(b"".join(lines), "<u8").astype(np.uint64)
            order = np.argsort(bucket)
            same = np.r_[False, bucket[order][1:] == bucket[order][:-1], False]
            order = order[same[1:] | same[:-1]]
            bucket, h = bucket[order], h[order]
            order = np.lexsort((h, bucket))
            bucket, h = bucket[order], h[order]
            for last in (False, True):  # each line once in a bucket; then no bucket of one line
                if not len(bucket):
                    break
                new = np.r_[True, bucket[1:] != bucket[:-1]]
                go = new | np.r_[False, h[1:] != h[:-1]]
                if last:
                    go = ~(new & np.r_[new[1:], True])
                bucket, h = bucket[go], h[go]
            at = np.flatnonzero(np.r_[len(bucket) > 0, bucket[1:] != bucket[:-1]])
            go = with_partner(at, np.diff(np.r_[at, len(bucket)]), h, likeness)
            bucket, h = bucket[go], h[go]
            if not len(bucket):
                continue
            at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            n = np.diff(np.r_[at, len(bucket)])
            x, y = np.bitwise_xor.reduceat(mixed(h), at), np.add.reduceat(mixed(h + np.uint64(1)), at)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[at, len(bucket)], pa.int32()), pa.array(h.view(np.int64)))
            cols = [pa.array(c.view(np.int64)) for c in (bucket[at], n, x, y)]
            yield pa.RecordBatch.from_arrays([*cols, lists], names=["bucket", "n", "x", "y", "lines"])

    packed = keyed.filter("doc_id is not null").select("text").mapInArrow(pack, "slot int, keys binary, lines binary")
    packed = packed.repartition(partitions(keyed), "slot").sortWithinPartitions("slot")
    return packed.mapInArrow(shared, "bucket long, n long, x long, y long, lines array<long>")


def candidates(distinct: DataFrame, found: DataFrame) -> DataFrame:
    """(key, k, line, at) of the lines that meet another; at: their buckets, with how many lines each has.  found: as met().

    Of buckets with the same lines one is left, so that a pair's texts meet about once.
    """
    one = found.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket"), F.min_by("lines", "bucket").alias("lines"))
    rows = one.select("n", "bucket", F.explode("lines").alias("h"))
    # By the bits of the hash that a signature has; another line of equal bits only adds candidates.
    rows = rows.groupBy(F.shiftrightunsigned("h", 36).alias("h")).agg(F.collect_set(F.struct("n", "bucket")).alias("at"))
    short = F.shiftright(F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long"), 4)
    lines = distinct.select("key", "k", "line", short.alias("_h"))
    return lines.join(rows.hint("merge"), F.col("_h") == F.col("h")).select("key", "k", "line", "at")


def in_buckets(members: DataFrame, chosen: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """members with only the chosen buckets, those that are done marked so; lines without a chosen one are left out."""
    wanted = chosen.select(F.col("bucket").alias("b"), F.lit(True).alias("go"))
    if done is not None:
        wanted = wanted.union(done.select("bucket", F.lit(False)))
    wanted = checkpointed(wanted)
    hint = "broadcast" if wanted.count() <= FEW_BUCKETS else "merge"
    rows = members.select("key", F.explode("at").alias("x")).select("key", "x.*")
    rows = rows.join(wanted.hint(hint), F.col("bucket") == F.col("b"))
    tiles = F.ceil(F.col("n") / TILE).cast("int").alias("tiles")
    few = (F.col("n") <= FEW_PAIRS).alias("few")
    rows = rows.groupBy("key").agg(F.collect_list(F.struct("bucket", tiles, few, "go")).alias("at"))
    return checkpointed(rows.filter(F.exists("at", lambda x: x["go"])))


def groups(members: DataFrame, keyed: DataFrame, likeness: Likeness) -> DataFrame:
    """(node, component) of every line that a similar one is found for.  members: as candidates().

    First lines meet in the largest bucket of any of them.  Of the other buckets, those whose lines are all connected by then
    have nothing to add; the rest follow, and what they link are the groups found before.  So the texts of a large group meet
    a few times, not once for every block.
    """
    texts = checkpointed(texts_of(members, keyed))
    first = checkpointed(members.select(F.array_max("at")["bucket"].alias("bucket")).distinct())
    found = components(similar(in_buckets(members, first), texts, likeness, partitions(keyed)))
    rows = members.select("key", F.explode("at").alias("x")).select("key", "x.bucket")
    rows = rows.join(found.hint("merge"), F.col("key") == F.col("node"), "left").select("bucket", F.coalesce("component", "key").alias("c"))
    open_ = rows.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("bucket")
    rest = checkpointed(open_.join(first.withColumnRenamed("bucket", "f").hint("merge"), F.col("bucket") == F.col("f"), "left_anti"))
    if not rest.head(1):
        return found
    more = checkpointed(similar(in_buckets(members, rest, first), texts, likeness, partitions(keyed)))
    if not more.head(1):
        return found
    name = lambda df, c: df.join(found.select(F.col("node").alias("_n"), F.col("component").alias("_c")).hint("merge"), F.col(c) == F.col("_n"), "left").withColumn(c, F.coalesce("_c", c)).drop("_n", "_c")
    joined = components(name(name(more, "a"), "b")).select(F.col("node").alias("_g"), F.col("component").alias("_to"))
    new = more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(
        found.select(F.col("node").alias("_n")).hint("merge"),
        F.col("node") == F.col("_n"),
        "left_anti",
    )
    every = found.union(new.select("node", F.col("node").alias("component")))
    return every.join(
        joined.hint("merge"),
        F.col("component") == F.col("_g"),
        "left",
    ).select("node", F.coalesce("_to", "component").alias("component"))


def texts_of(members: DataFrame, keyed: DataFrame) -> DataFrame:
    """(key, norm) of the lines of members, normalised: one row for each."""
    wanted = checkpointed(members.groupBy(F.col("k").alias("_k")).agg(F.collect_set("line").alias("lines")))
    few = wanted.count() <= FEW_DOCS and (wanted.agg(F.sum(F.size("lines"))).first()[0] or 0) <= 10 * FEW_DOCS

    def cut(batches):
        for b in sliced(batches, 128):
            norms = []
            for text, lines in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts = text.split("\n")
                norms += [plain(parts[x]) for x in lines]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(map(xxhash.xxh3_128_digest, norms)), pa.binary()), pa.array(norms, pa.binary())],
                names=["key", "norm"],
            )

    rows = keyed.join(wanted.hint("broadcast" if few else "merge"), F.col("k") == F.col("_k")).select("text", "lines")
    return rows.mapInArrow(cut, "key binary, norm binary").dropDuplicates(["key"])  # rows that repeat id and text come again


def similar(members: DataFrame, texts: DataFrame, likeness: Likeness, parts: int) -> DataFrame:
    """(a, b): keys of similar lines, enough to connect all that share a bucket to go.  members: as in_buckets()."""

    def deal(batches):
        for b in sliced(batches, 512):
            out = [[] for _ in range(8)]
            for key, at, norm in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                h = int.from_bytes(key[:7], "big")
                to_go, done = (np.array([p["bucket"] for p in at if p["go"] == go], np.int64).tobytes() for go in (True, False))
                for p in at:
                    if not p["go"]:
                        continue
                    # To look at a few pairs of short lines again costs less than to tell of each line where else it was.
                    told = (b"", b"") if p["few"] and len(norm) < LIGHT else (to_go, done)
                    own = h % p["tiles"]
                    for other in range(p["tiles"]):
                        row = (p["bucket"], min(own, other), max(own, other), own <= other, key, *told, norm)
                        for column, v in zip(out, row, strict=True):
                            column.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                names=["bucket", "a", "b", "left", "key", "to_go", "done", "norm"],
            )

    both = members.join(texts.withColumnRenamed("key", "_key").hint("merge"), F.col("key") == F.col("_key"))
    dealt = both.select("key", "at", "norm").mapInArrow(
        deal,
        "bucket long, a int, b int, left boolean, key binary, to_go binary, done binary, norm binary",
    )
    dealt = dealt.repartition(parts, "bucket", "a", "b").sortWithinPartitions("bucket", "a", "b", "key")

    def verify(batches):
        for g in sorted_groups(batches, ["bucket", "a", "b"]):
            at = np.r_[group_starts(g, ["bucket", "a", "b"]), g.num_rows].tolist()
            bucket, a_, b_, left = (g.column(c).to_numpy() for c in ("bucket", "a", "b", "left"))
            keys, norms, to_go, done = (g.column(c).to_pylist() for c in ("key", "norm", "to_go", "done"))
            out_a, out_b = [], []
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                rows = list(range(lo, hi))
                if len(rows) < 2:
                    continue
                words = [norms[r].decode("utf-8", "replace") for r in rows]
                root, apart = list(range(len(rows))), len(rows)

                def find(x, root=root):
                    while root[x] != x:
                        root[x] = x = root[root[x]]
                    return x

                for y in range(1, len(rows)):  # the first line often links all others, which its words can tell
                    if alike(words[0], words[y], likeness, by_words=True):
                        root[y] = 0
                        apart -= 1
                        out_a.append(keys[rows[0]])
                        out_b.append(keys[rows[y]])
                if apart == 1:
                    continue
                sides = None if a_[lo] == b_[lo] else left[rows]
                if sides is None and len(rows) <= FEW_PAIRS:  # not worth arrays; alike() looks at lengths first
                    i, j = _ALL_PAIRS[len(rows)]
                else:
                    i, j = close_pairs([norms[r] for r in rows], sides, likeness)
                tied = np.array(root)
                new = tied[i] != tied[j]
                i, j = i[new], j[new]
                if not len(i):
                    continue
                met = [
                    {x for x in np.frombuffer(to_go[r], np.int64).tolist() if x < bucket[lo]}.union(np.frombuffer(done[r], np.int64).tolist())
                    for r in rows
                ]
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    # A pair that shares a lesser bucket, or one that is done, is settled there.
                    if find(x) != find(y) and met[x].isdisjoint(met[y]) and alike(words[x], words[y], likeness):
                        root[find(y)] = find(x)
                        apart -= 1
                        out_a.append(keys[rows[x]])
                        out_b.append(keys[rows[y]])
                        if apart == 1:
                            break
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], names=["a", "b"])

    return dealt.mapInArrow(verify, "a binary, b binary")


def lines_to_go(docs: DataFrame, likeness: Likeness, least: int) -> DataFrame:
    """(k, line) of every line that isn't the first of its group; k as in _key()."""
    keyed = _key(docs)
    place = F.struct("doc_id", "line", "k")
    distinct = lines_of(keyed, least).groupBy("key").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    distinct = checkpointed(distinct.select("key", "n", "first.doc_id", "first.line", "first.k"))
    members = checkpointed(candidates(distinct, met(keyed, least, likeness)))
    found = groups(members, keyed, likeness)
    joined = distinct.select("key", "n", "doc_id", "line", "k").join(
        found.hint("merge"),
        F.col("key") == F.col("node"),
        "left",
    ).filter("n > 1 or component is not null")
    joined = joined.select("key", F.coalesce("component", "key").alias("component"), place.alias("place"))
    first = joined.groupBy(F.col("component").alias("_c")).agg(F.min("place").alias("keep"))
    kept = joined.join(first.hint("merge"), F.col("component") == F.col("_c")).select(
        "key",
        F.col("keep.k").alias("keep_k"),
        F.col("keep.line").alias("keep_line"),
    )
    # Lines are read again rather than kept: that is cheaper than another copy of them all.
    gone = lines_of(keyed, least).select("k", "line", "key").join(
        checkpointed(kept).withColumnRenamed("key", "_key").hint("merge"),
        F.col("key") == F.col("_key"),
    )
    return gone.filter("k != keep_k or line != keep_line").select("k", "line")


def dedup_lines(docs: DataFrame, likeness: Likeness = LIKENESS, least: int = LEAST_CHARS, prefix: str = "_") -> DataFrame:
    """The rows of docs with all their columns, text without lines that nearly repeat one that stays, and n_lines, n_removed after prefix.

    Lines end with line feeds.  Lines of fewer than least normalised bytes, and those without letter or digit, are left alone.
    An occurrence stays if it is the first of its group by (doc_id, line number).  Lines too short for an edit within the
    likeness repeat only equal ones.  n_chars, if there, becomes the code points of the new text.  Null text stays null; a
    text that loses all its lines becomes empty.  Rows without doc_id are left alone.  Rows that repeat both id and text are
    treated alike.  An empty table gives none.  Other columns pass through.
    """
    gone = lines_to_go(docs.select("doc_id", "text"), likeness, least)
    gone = checkpointed(gone.groupBy(F.col("k").alias("__tm_k")).agg(F.collect_set("line").alias("__tm_gone")))
    key = F.coalesce(
        F.unhex(F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64("text").cast("string"))), 1, 24)),
        F.lit(b""),
    )
    hint = "broadcast" if gone.count() <= FEW_DOCS else "shuffle_hash"
    both = docs.withColumn("__tm_key", key).join(gone.hint(hint), F.col("__tm_key") == F.col("__tm_k"), "left")
    # A document's lines are few enough for an array; positions that are gone are left out.
    lines, out_of = F.split(F.col("text"), "\n", -1), F.col("__tm_gone")
    touched = out_of.isNotNull() & F.col("doc_id").isNotNull()
    text = F.when(touched, F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(out_of, i)), "\n")).otherwise(F.col("text"))
    both = both.withColumn("__tm_text", text)
    new = {"text": F.col("__tm_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(touched, F.length("__tm_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    feeds = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    counts = [
        F.coalesce(feeds + 1, F.lit(0)).cast("long").alias(f"{prefix}n_lines"),
        F.when(touched, F.size(out_of)).otherwise(0).cast("long").alias(f"{prefix}n_removed"),
    ]
    return both.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns], *counts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_removed").alias("n_removed"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("text"), 256).alias("text_sha256"),
    )
